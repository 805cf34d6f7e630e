"""Counts of the rare class per dataset, seed, scheme and client."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rareclass.functions.ranks import hash_rank
from rareclass.operators.oversample import NEIGHBORS, TARGET_RATIO, skip_reason, wanted_rows
from rareclass.operators.splits import dirichlet_shares

SEEDS = (42, 123, 2024)
ALPHAS = (0.5, 1.0, 5.0)


def _iid_counts(df: DataFrame, clients: int, seeds: Sequence[int], id_col: str, label: str) -> DataFrame:
    seeded = df.select("dataset", F.col(id_col).alias("_id"), F.col(label).alias("_y"),
                       F.explode(F.lit(list(seeds))).alias("seed"))
    ranked = hash_rank(seeded, "_id", F.col("seed"), ["dataset", "seed"], "_r", "_n")
    base, extra, at = F.floor(F.col("_n") / clients), F.col("_n") % clients, F.col("_r") - 1
    big = extra * (base + 1)
    client = F.when(at < big, F.floor(at / (base + 1))).otherwise(extra + F.floor((at - big) / F.greatest(base, F.lit(1))))
    return ranked.groupBy("dataset", "seed", client.cast("int").alias("client_id")).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("_y") == 1).alias("n_minority")
    ).select("dataset", "seed", F.lit("iid").alias("scheme"), F.lit(None).cast("double").alias("alpha"),
             "client_id", "n_total", "n_minority")


def _dirichlet_counts(df: DataFrame, clients: int, seeds: Sequence[int], alphas: Sequence[float], label: str) -> DataFrame:
    """Cuts fall at floor(share * class size), so class sizes alone give every client's counts."""
    totals = df.groupBy("dataset", F.col(label).alias("_y")).agg(F.count(F.lit(1)).alias("_n"))
    cells = []
    for seed in seeds:
        for alpha in alphas:
            for y, cum in dirichlet_shares((0, 1), alpha, clients, seed).items():
                for c in range(clients):
                    cells.append((seed, alpha, y, c, cum[c - 1] if c else 0.0, cum[c] if c < clients - 1 else None))
    spark = df.sparkSession
    shares = spark.createDataFrame(cells, "seed int, alpha double, _y int, client_id int, _from double, _to double")
    upper = F.coalesce(F.floor(F.col("_to") * F.col("_n")), F.col("_n"))
    part = totals.withColumn("_y", F.col("_y").cast("int")).join(shares, "_y").withColumn(
        "_k", upper - F.floor(F.col("_from") * F.col("_n")))
    return part.groupBy("dataset", "seed", "alpha", "client_id").agg(
        F.sum("_k").alias("n_total"), F.sum(F.when(F.col("_y") == 1, F.col("_k")).otherwise(0)).alias("n_minority")
    ).select("dataset", "seed", F.lit("dirichlet").alias("scheme"), "alpha", "client_id", "n_total", "n_minority")


def minority_census(df: DataFrame, n_features: int, clients: int = 5, seeds: Sequence[int] = SEEDS,
                    alphas: Sequence[float] = ALPHAS, target: float = TARGET_RATIO, k: int = NEIGHBORS,
                    id_col: str = "row_id", label: str = "label") -> DataFrame:
    """Every client of every partition of ``dataset`` groups, with what oversampling would do there."""
    counts = _iid_counts(df, clients, seeds, id_col, label).unionByName(
        _dirichlet_counts(df, clients, seeds, alphas, label))
    n_min, n_maj = F.col("n_minority"), F.col("n_total") - F.col("n_minority")
    reason = skip_reason(n_min, n_maj, target, k)
    made = F.when(F.col("smote_fires"), wanted_rows(n_min, n_maj, target)).otherwise(F.lit(0)).cast("bigint")
    return counts.withColumn("n_features", F.lit(n_features)).withColumn(
        "minority_fraction", F.when(F.col("n_total") > 0, n_min / F.col("n_total")).otherwise(F.lit(0.0))
    ).withColumn("local_ratio", F.when(n_maj > 0, n_min / n_maj)
    ).withColumn("events_per_parameter", n_min / F.lit(n_features)
    ).withColumn("skip_reason", reason).withColumn("smote_fires", F.col("skip_reason").isNull()
    ).withColumn("n_synthetic", made
    ).withColumn("synthesis_multiplier", F.when(F.col("smote_fires") & (n_min > 0), F.col("n_synthetic") / n_min).otherwise(F.lit(0.0))
    ).withColumn("flag_lt10", n_min < 10).withColumn("flag_zero", n_min == 0)


def census_rollup(census: DataFrame) -> DataFrame:
    """Per dataset and scheme; a group holds seeds x clients rows."""
    reason = F.col("skip_reason")
    return census.groupBy("dataset", "scheme", "alpha").agg(
        F.count(F.lit(1)).alias("n_clients"), F.count_if("flag_lt10").alias("n_lt10"),
        F.count_if("flag_zero").alias("n_zero"), F.min("n_minority").alias("min_minority"),
        F.floor(F.median("n_minority")).alias("median_minority"), F.max("n_minority").alias("max_minority"),
        F.max("synthesis_multiplier").alias("worst_multiplier"), F.count_if("smote_fires").alias("n_fires"),
        F.count_if(reason == "insufficient_minority").alias("n_skip_insufficient"),
        F.count_if(reason == "target_met").alias("n_skip_target"),
    ).withColumn("target_met_share", F.col("n_skip_target") / F.col("n_clients")
    ).withColumn("is_identity", F.col("n_fires") == 0)


def exposure(rollup: DataFrame, alpha: float = 0.5) -> DataFrame:
    """How exposed each dataset is under the most skewed partition."""
    return rollup.where((F.col("scheme") == "dirichlet") & (F.col("alpha") == alpha)).select(
        "dataset", "n_zero", "n_lt10", "n_clients", "min_minority")
