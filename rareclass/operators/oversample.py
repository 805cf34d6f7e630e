"""Per-client oversampling of the rare class: SMOTE and ADASYN as joins.

A small plan table (one row per client) decides who is oversampled and by how many rows; neighbours
come from the exact neighbour join; synthetic rows are numbered draws whose base row, neighbour and
position are hash uniforms of (seed, client, draw). Draws are written out in chunks spread over the
tasks, so a client that needs most of the rows is no bottleneck.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rareclass.functions.hashing import hash_uniform
from rareclass.functions.ranks import hash_rank, shuffle_width
from rareclass.operators.neighbors import BLOCK_ROWS, knn_join

TARGET_RATIO = 0.01
NEIGHBORS = 5
DRAW_CHUNK = 10_000

Strategy = float | str


def skip_reason(n_min: Column, n_maj: Column, strategy: Strategy = TARGET_RATIO, k: int = NEIGHBORS,
                enabled: bool = True) -> Column:
    """Why a client is left alone, NULL if it is not; the order of the tests matters.

    Only a numeric target can be "met"; ``"auto"`` never is.
    """
    if not enabled:
        return F.lit("disabled")
    out = F.when(n_min < k + 1, "insufficient_minority")
    if not isinstance(strategy, str):
        out = out.when(n_min >= F.lit(float(strategy)) * n_maj, "target_met")
    return out


def wanted_rows(n_min: Column, n_maj: Column, strategy: Strategy = TARGET_RATIO) -> Column:
    """New minority rows needed: match the majority (``auto``) or reach ``floor(f * majority)``."""
    if isinstance(strategy, str):
        if strategy != "auto":
            raise ValueError(f"unknown sampling strategy {strategy!r}")
        target = n_maj
    else:
        target = F.floor(F.lit(float(strategy)) * n_maj)
    return F.greatest(target - n_min, F.lit(0)).cast("bigint")


def oversampling_plan(df: DataFrame, strategy: Strategy = TARGET_RATIO, k: int = NEIGHBORS,
                      enabled: bool = True, client: str = "client_id", label: str = "label") -> DataFrame:
    """One row per client: sizes, skip reason and rows to create."""
    counts = df.groupBy(client).agg(F.count(F.lit(1)).alias("n_samples"), F.count_if(F.col(label) == 1).alias("n_pos"))
    n_min, n_maj = F.col("n_pos"), F.col("n_samples") - F.col("n_pos")
    reason = skip_reason(n_min, n_maj, strategy, k, enabled)
    return counts.withColumn("skip_reason", reason).withColumn(
        "n_wanted", F.when(F.col("skip_reason").isNull(), wanted_rows(n_min, n_maj, strategy)).otherwise(F.lit(0)))


def report(plan: DataFrame, client: str = "client_id", made: str = "n_wanted") -> DataFrame:
    """The per-client account of an oversampling run."""
    made_ = F.col(made)
    after, pos_after = F.col("n_samples") + made_, F.col("n_pos") + made_
    applied = F.col("skip_reason").isNull()
    return plan.select(
        client, "n_samples", "n_pos", applied.alias("applied"), "skip_reason",
        after.alias("n_samples_after"), pos_after.alias("n_pos_after"),
        F.when(after > 0, pos_after / after).otherwise(F.lit(0.0)).alias("pos_ratio_after"),
        F.col("n_pos").alias("n_real_minority"), made_.alias("n_synthetic"),
        F.when(applied & (F.col("n_pos") > 0), made_ / F.col("n_pos")).otherwise(F.lit(0.0)).alias("synthesis_multiplier"))


def report_summary(rep: DataFrame) -> DataFrame:
    """How many clients were oversampled and how many were skipped for each reason."""
    reason = F.col("skip_reason")
    return rep.agg(F.count_if("applied").alias("n_applied"), F.count(F.lit(1)).alias("n_clients"),
                   F.count_if(reason == "insufficient_minority").alias("n_insufficient_minority"),
                   F.count_if(reason == "target_met").alias("n_target_met"),
                   F.count_if(reason == "no_candidates").alias("n_no_candidates"),
                   F.count_if(reason == "disabled").alias("n_disabled"))


DRAWS_PER_KEY = 10_000  # draws that meet one copy of a base row


def _numbered(df: DataFrame, n: str, keys: Sequence[str]) -> DataFrame:
    """Rows repeated as draws 1..n; chunked so that no task writes one key's draws alone."""
    chunks = df.where(F.col(n) > 0).withColumn("_c", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                                       F.floor((F.col(n) - 1) / DRAW_CHUNK))))
    spread = chunks.repartition(shuffle_width(df), *keys, "_c")
    last = F.least(F.col(n), (F.col("_c") + 1) * DRAW_CHUNK)
    return spread.withColumn("draw", F.explode(F.sequence(F.col("_c") * DRAW_CHUNK + 1, last))).drop("_c")


def _with_neighbours(minority: DataFrame, k: int, client: str, block_rows: int) -> DataFrame:
    """Each minority row (``_id, _v``) with the vectors of its k nearest minority rows of its client."""
    near = knn_join(minority, minority, k, "_id", "_v", by=[client], exclude_self=True, block_rows=block_rows)
    vectors = minority.select(client, F.col("_id").alias("nn_id"), F.col("_v").alias("_nv"))
    lists = near.join(vectors, [client, "nn_id"]).groupBy(client, F.col("query_id").alias("_id")).agg(
        F.sort_array(F.collect_list(F.struct("nn_rank", "_nv"))).alias("_near"))
    return minority.join(lists, [client, "_id"])


def _repeated(bases: DataFrame, width: DataFrame, keys: list[str]) -> DataFrame:
    """Base rows once per salt of their key, so that many draws of one row are spread over tasks."""
    return bases.join(width, keys).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_width") - 1))).drop("_width")


def _between(gap: Column) -> Column:
    other = F.get(F.col("_near"), F.col("_pick"))["_nv"]
    return F.zip_with(F.col("_v"), other, lambda a, b: a + gap * (b - a))


def _assemble(df: DataFrame, made: DataFrame, client: str, id_col: str, vec: str, label: str) -> DataFrame:
    originals = df.select(client, F.col(id_col).cast("string").alias(id_col),
                          F.col(vec).cast("array<double>").alias(vec), F.col(label).cast("int").alias(label),
                          F.lit(False).alias("is_synthetic"))
    return originals.unionByName(made)


def _minority(df: DataFrame, plan: DataFrame, client: str, id_col: str, vec: str, label: str) -> DataFrame:
    chosen = plan.where("skip_reason IS NULL AND n_wanted > 0").select(client, F.col("n_pos").alias("_m"))
    return df.where(F.col(label) == 1).select(
        client, F.col(id_col).alias("_id"), F.col(vec).cast("array<double>").alias("_v")).join(chosen, client)


def smote(df: DataFrame, strategy: Strategy = TARGET_RATIO, k: int = NEIGHBORS, seed: int = 42,
          enabled: bool = True, client: str = "client_id", id_col: str = "row_id", vec: str = "features",
          label: str = "label", block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """O1: (rows, report). Original rows first-class, synthetic rows flagged ``is_synthetic``.

    synthetic = a + u * (b - a): ``a`` a random minority row of the client, ``b`` one of its k nearest
    minority rows there, u uniform. Draws depend on (seed, client, draw number) only.
    """
    plan = oversampling_plan(df, strategy, k, enabled, client, label)
    minority = _minority(df, plan, client, id_col, vec, label)
    bases = hash_rank(_with_neighbours(minority.drop("_m"), k, client, block_rows), "_id", seed, [client], "_at", "_g")
    draws = _numbered(plan.select(client, "n_pos", "n_wanted"), "n_wanted", [client])
    at = F.floor(hash_uniform(seed, client, "draw", F.lit("base")) * F.col("n_pos")) + 1
    spread = F.ceil(F.col("n_wanted") / (F.col("n_pos") * DRAWS_PER_KEY))
    width = plan.where("n_wanted > 0 AND n_pos > 0").select(client, spread.alias("_width"))
    placed = draws.withColumn("_at", at.cast("bigint")).join(width, client).withColumn("_salt", F.pmod(F.col("draw"), F.col("_width"))).drop("_width").join(
        _repeated(bases.withColumn("_at", F.col("_at").cast("bigint")), width, [client]), [client, "_at", "_salt"])
    pick = F.floor(hash_uniform(seed, client, "draw", F.lit("near")) * k).cast("int")
    made = placed.withColumn("_pick", pick).select(
        client, F.concat_ws("-", F.lit("s"), client, "draw").alias(id_col),
        _between(hash_uniform(seed, client, "draw", F.lit("gap"))).alias(vec),
        F.lit(1).alias(label), F.lit(True).alias("is_synthetic"))
    return _assemble(df, made, client, id_col, vec, label), report(plan, client)


def adasyn_quotas(df: DataFrame, plan: DataFrame, k: int = NEIGHBORS, client: str = "client_id",
                  id_col: str = "row_id", vec: str = "features", label: str = "label",
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows to create per minority row, in proportion to the majority share of its k neighbours."""
    minority = _minority(df, plan, client, id_col, vec, label)
    everyone = df.select(client, F.col(id_col).alias("_id"), F.col(vec).cast("array<double>").alias("_v"), label)
    near = knn_join(minority, everyone, k, "_id", "_v", by=[client], carry=[label], exclude_self=True, block_rows=block_rows)
    hard = near.groupBy(client, F.col("query_id").alias("_id")).agg(
        (F.count_if(F.col(f"nn_{label}") != 1) / F.lit(float(k))).alias("_r"))
    totals = hard.groupBy(client).agg(F.sum("_r").alias("_t"))
    share = F.when(F.col("_t") > 0, F.col("_r") / F.col("_t")).otherwise(F.lit(0.0))
    return hard.join(totals, client).join(plan.select(client, "n_wanted"), client).select(
        client, "_id", F.rint(share * F.col("n_wanted")).cast("bigint").alias("n_quota"))


def adasyn(df: DataFrame, strategy: Strategy = TARGET_RATIO, k: int = NEIGHBORS, seed: int = 42,
           enabled: bool = True, client: str = "client_id", id_col: str = "row_id", vec: str = "features",
           label: str = "label", block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """O2: (rows, report). Hard minority rows get more synthetic rows; no hard rows -> unchanged."""
    plan = oversampling_plan(df, strategy, k, enabled, client, label)
    quotas = adasyn_quotas(df, plan, k, client, id_col, vec, label, block_rows)
    per_client = quotas.groupBy(client).agg(F.sum("n_quota").alias("_made"))
    made_n = F.coalesce("_made", F.lit(0))
    final = plan.join(per_client, client, "left").withColumn("n_made", made_n).withColumn(
        "skip_reason", F.when(F.col("skip_reason").isNull() & (made_n == 0), "no_candidates").otherwise(F.col("skip_reason")))
    minority = _minority(df, plan, client, id_col, vec, label).drop("_m")
    bases = _with_neighbours(minority, k, client, block_rows)
    width = quotas.where("n_quota > 0").select(client, "_id", F.ceil(F.col("n_quota") / DRAWS_PER_KEY).alias("_width"))
    numbered = _numbered(quotas, "n_quota", [client, "_id"]).join(width, [client, "_id"]).withColumn(
        "_salt", F.pmod(F.col("draw"), F.col("_width"))).drop("_width")
    draws = numbered.join(_repeated(bases, width, [client, "_id"]), [client, "_id", "_salt"])
    pick = F.floor(hash_uniform(seed, client, "_id", "draw", F.lit("near")) * k).cast("int")
    made = draws.withColumn("_pick", pick).select(
        client, F.concat_ws("-", F.lit("s"), client, "_id", "draw").alias(id_col),
        _between(hash_uniform(seed, client, "_id", "draw", F.lit("gap"))).alias(vec),
        F.lit(1).alias(label), F.lit(True).alias("is_synthetic"))
    return _assemble(df, made, client, id_col, vec, label), report(final, client, "n_made")


def oversample(df: DataFrame, method: str, **options) -> tuple[DataFrame, DataFrame]:
    """Choose by name; ``none`` leaves the rows alone but still reports."""
    if method == "smote":
        return smote(df, **options)
    if method == "adasyn":
        return adasyn(df, **options)
    if method == "none":
        return smote(df, **{**options, "enabled": False})
    raise ValueError(f"unknown oversampling method {method!r}")


def oversample_pooled(df: DataFrame, method: str, **options) -> tuple[DataFrame, DataFrame]:
    """One pool instead of clients; the report's ``note`` says why nothing was added, if so."""
    rows, rep = oversample(df.withColumn("_pool", F.lit(0)), method, client="_pool", **options)
    note = F.when(F.col("skip_reason").isNotNull(), F.concat(F.lit("trained on raw data: "), "skip_reason"))
    return rows.drop("_pool"), rep.drop("_pool").withColumn("note", note)


def positive_ratio(df: DataFrame, label: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """Positive share of a table, 0 when empty."""
    return df.groupBy(*keys).agg(F.coalesce(F.avg((F.col(label) == 1).cast("double")), F.lit(0.0)).alias("pos_ratio"))


def noop_cells(counts: DataFrame, keys: Sequence[str], strategy: float = TARGET_RATIO, k: int = NEIGHBORS) -> DataFrame:
    """From client counts alone, cells in which oversampling would change no client.

    ``n_below_floor`` counts clients with too few positives to interpolate between.
    """
    n_min, n_maj = F.col("n_pos"), F.col("n_samples") - F.col("n_pos")
    skips = (n_min < k + 1) | (n_min >= F.lit(float(strategy)) * n_maj)
    return counts.groupBy(*keys).agg(F.bool_and(skips).alias("is_noop"),
                                     F.count_if(n_min < k + 1).alias("n_below_floor"))
