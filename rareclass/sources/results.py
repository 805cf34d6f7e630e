"""Run summaries, round histories and ledgers on disk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rareclass.operators.groupfit import best_round
from rareclass.operators.ledger import SUMMARY_COLUMNS, blank
from rareclass.functions.ranks import null_safe_join

_INTS = {"random_seed", "rounds_configured", "num_clients", "best_round", "rounds_completed", "n_iter_selected",
         "n_clients_below_smote_floor"}
_TEXT = {"dataset", "model", "scheme", "oversampling", "threshold_policy", "data_hash", "partition_hash", "timestamp", "run_name"}


def summary_type(column: str) -> str:
    return "bigint" if column in _INTS else "string" if column in _TEXT else "double"


def typed_summary(df: DataFrame) -> DataFrame:
    """A summary in the ledger's column order and types.

    Text cells that hold no number become NULL; ``undefined`` lists the columns that said so (``NA``, ``n/a``),
    which is different from a blank.
    """
    cells = {c: F.col(c) if c in df.columns else F.lit(None).cast("string") for c in SUMMARY_COLUMNS}
    said = [F.when(cells[c].cast("string").isin("NA", "n/a"), F.lit(c)) for c in SUMMARY_COLUMNS if c not in _TEXT]
    typed = []
    for c in SUMMARY_COLUMNS:
        kind = summary_type(c)
        cell = F.when(blank(cells[c]), None).otherwise(cells[c])
        if kind == "string":
            typed.append(cell.cast("string").alias(c))
        else:
            value = cell.cast("string").try_cast("double") if hasattr(cell, "try_cast") else cell.cast("double")
            typed.append(value.cast(kind).alias(c))
    return df.select(*typed, F.array_compact(F.array(*said)).alias("undefined"))


def utc_stamp() -> F.Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def grouped_summary(runs: DataFrame, history: DataFrame, keys: Sequence[str] = ("dataset", "run_name"),
                    include_round_zero: bool = False) -> DataFrame:
    """Summary rows of grouped runs: best round and its metrics, completed rounds, run columns."""
    # no join with the history: where it is unfolded from small rows, Spark takes it for small and would broadcast it whole
    found = best_round(history, keys, include_round_zero, carry=["val_f1", "val_precision", "val_recall", "val_recall_at_fpr"])
    counts = history.groupBy(*keys).agg(F.count_if(F.coalesce(F.col("round"), F.lit(1)) >= 1).alias("rounds_completed"))
    joined = null_safe_join(null_safe_join(runs, found, keys, "left"), counts, keys, "left")
    return typed_summary(joined.withColumnRenamed("best_value", "best_val_auprc").drop("final_round"))


def pooled_summary(runs: DataFrame) -> DataFrame:
    """The same schema for pooled runs; round fields are NULL and listed as undefined."""
    rounds = {c: F.lit("n/a") for c in ("rounds_configured", "rounds_completed", "num_clients", "best_round")}
    return typed_summary(runs.withColumn("scheme", F.lit("centralized")).withColumns(
        {**rounds, "alpha": F.lit(None).cast("string"), "partition_hash": F.lit(None).cast("string")}))


def fit_rounds(history: DataFrame) -> DataFrame:
    """Rows of fit rounds; a row without a round number counts as one."""
    return history.where(F.coalesce(F.expr("try_cast(round AS double)"), F.lit(1.0)) >= 1)


def append_table(df: DataFrame, path: str, partition_by: Sequence[str] = ("dataset",)) -> None:
    """Add rows to a ledger, creating it the first time."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Add rows to a CSV ledger; every file carries its header, so a reader never depends on file order."""
    df.write.mode("append").option("header", True).csv(path)


def scan_ledger(spark: SparkSession, root: str, skip: str = r"_rounds\.csv(/|$)") -> DataFrame:
    """Every summary CSV below ``root``, whatever its columns, except files in or named as round files.

    Files are grouped by their first line; the CSV source reads each group, so quoted separators and line breaks are kept. The
    groups are united by column name. The driver sees one header and path per file, as any listing does.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(root, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.substring_index(F.regexp_replace("value", "\r", ""), "\n", 1).alias("header")).where(
        ~F.col("path").rlike(skip) & (F.col("header") != ""))
    groups = files.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("header").collect()
    if not groups:
        raise FileNotFoundError(f"no summaries below {root}")
    parts = [spark.read.option("header", True).option("multiLine", True).csv(list(g["paths"])) for g in groups]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace those with the same key; doing it twice changes nothing."""
    return existing.join(new, list(keys), "left_anti").unionByName(new, allowMissingColumns=True)
