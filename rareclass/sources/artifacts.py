"""Artifacts of finished runs: discovery, importance matrices, stability records and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STABILITY_SCHEMA = ("dataset string, model string, spearman double, jaccard double, kuncheva double, "
                    "degenerate_clients array<bigint>, top10 array<struct<feature: string, importance: double>>")


def run_parts(name: str | Column, models: Sequence[str]) -> list[Column]:
    """Model, condition, arm and alpha read out of a run's folder name.

    ``models`` are tried in order, so a longer name must stand before its own prefix; no match -> NULL.
    """
    n = F.col(name) if isinstance(name, str) else name
    bare = F.regexp_replace(n, "^centralized_", "")
    model = F.lit(None).cast("string")
    for m in reversed(models):
        model = F.when((bare == m) | bare.startswith(m + "_"), m).otherwise(model)
    condition = F.when(n.startswith("centralized_"), "centralized").when(n.contains("dirichlet"), "dirichlet").when(
        n.contains("iid"), "iid").otherwise("?")
    arm = F.when(n.contains("_smote_"), "smote").otherwise("none")
    alpha_text = F.regexp_extract(n, r"_alpha([^_]*)", 1)
    alpha = F.when(n.contains("dirichlet") & ~alpha_text.isin("", "-"), alpha_text)
    return [model.alias("model"), condition.alias("condition"), arm.alias("arm"),
            alpha.try_cast("double").alias("alpha")]


def discover(spark: SparkSession, root: str, models: Sequence[str]) -> DataFrame:
    """One row per manifest below ``root/<dataset>/<run>/manifest.json``."""
    found = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option(
        "pathGlobFilter", "manifest.json").json(root)
    path = found.withColumn("_path", F.input_file_name())
    named = path.withColumn("run_name", F.regexp_extract("_path", r"([^/]+)/manifest\.json$", 1)).withColumn(
        "dataset", F.regexp_extract("_path", r"([^/]+)/[^/]+/manifest\.json$", 1))
    return named.select("dataset", "run_name", *run_parts("run_name", models),
                        *[c for c in found.columns if c not in ("dataset", "run_name", "model", "condition", "arm", "alpha")]
                        ).where(F.col("model").isNotNull())


def importance_matrix(imp: DataFrame, clients: Sequence, client: str = "client_id") -> DataFrame:
    """One row per feature, one column per client, plus the mean."""
    wide = imp.groupBy("feature").pivot(client, list(clients)).agg(F.first("importance"))
    mean = imp.groupBy("feature").agg(F.avg("importance").alias("mean"))
    return wide.select("feature", *[F.col(f"`{c}`").alias(f"client_{c}") for c in clients]).join(mean, "feature")


def stability_json(cells: DataFrame, out: str = "json") -> DataFrame:
    """A nested record per cell; NaN becomes null, which JSON can hold."""
    clean = [F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in cells.dtypes]
    return cells.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias(out))


def read_stability(df: DataFrame, column: str = "json", schema: str = STABILITY_SCHEMA) -> DataFrame:
    """The records back as typed columns."""
    return df.select(F.from_json(column, schema).alias("r")).select("r.*")


def _named_number(text: Column, name: str) -> Column:
    """The number of the first ``name=number`` in ``text``, exponents included; NULL when there is none."""
    return F.regexp_extract(text, rf"\b{name}=([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)", 1).try_cast("double")


def mine_log(df: DataFrame, content: str = "content") -> DataFrame:
    """Final test metrics and the last round's validation metrics of each log.

    A log is cut at its first line with ``FINAL``: everything from there on holds the test metrics. Of the lines that open a
    server round, the last one holds the validation metrics. Each number is looked up by its own name.
    """
    lines = F.split(content, "\n")
    at = F.array_position(F.transform(lines, lambda v: v.contains("FINAL")), True)
    final = F.when(at > 0, F.array_join(F.slice(lines, at.cast("int"), F.size(lines)), "\n"))
    last = F.try_element_at(F.filter(lines, lambda v: v.rlike(r"server\] round [0-9]")), F.lit(-1))
    names = ("auprc", "f1", "precision", "recall")
    found = {f"test_{n}": _named_number(final, f"test_{n}") for n in names} | {f"val_{n}": _named_number(last, f"val_{n}") for n in names}
    return df.withColumns(found).drop(content)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """One row per log file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def thousands(c: str | Column) -> Column:
    """Number text with thousands separators as a number."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, ",", "").try_cast("bigint")
