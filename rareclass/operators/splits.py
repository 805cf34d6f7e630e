"""Splits, client partitions and samples, all cut at exact ranks of one hash order.

Class shares are exact and the result depends only on (seed, row id). Only the rows next to a cut are ordered; all
others are decided where they are by the hashes found at the cuts.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rareclass.functions.ranks import hash_segments, null_safe_join


def stratified_split(df: DataFrame, id_col: str = "row_id", label: str = "label", seed: int = 42,
                     out: str = "split") -> DataFrame:
    """train/val/test 70/15/15 with exact class shares."""
    n = F.col("_n")
    cuts = F.array(F.round(n * F.lit(0.70)), F.round(n * F.lit(0.85)))
    cut = hash_segments(df, id_col, seed, cuts, 2, [label], "_s")
    return cut.withColumn(out, F.when(F.col("_s") == 0, "train").when(F.col("_s") == 1, "val").otherwise("test")).drop("_s")


def partition_iid(df: DataFrame, clients: int = 5, id_col: str = "row_id", seed: int = 42,
                  out: str = "client_id") -> DataFrame:
    """Near-equal random chunks; the first ``n mod K`` chunks hold one row more."""
    base, extra = F.floor(F.col("_n") / clients), F.col("_n") % clients
    cuts = F.transform(F.sequence(F.lit(1), F.lit(clients - 1)), lambda j: j * base + F.least(j, extra)) if clients > 1 else F.array()
    return hash_segments(df, id_col, seed, cuts, clients - 1, (), out)


def dirichlet_shares(classes: Sequence, alpha: float, clients: int, seed: int) -> dict:
    """Cumulative client shares per class, one draw of Dir(alpha) each; clients x classes numbers."""
    rng = np.random.default_rng(seed)
    return {c: [float(v) for v in np.cumsum(rng.dirichlet(np.full(clients, alpha)))][:-1]
            for c in sorted(classes)}


def partition_by_shares(df: DataFrame, shares: dict, id_col: str = "row_id", label: str = "label",
                        seed: int = 42, out: str = "client_id") -> DataFrame:
    """D3 core: cut each class at ``floor(cumulative share * class size)`` along its hash rank."""
    cuts = F.lit(None).cast("array<double>")
    for value, cumulative in shares.items():
        cuts = F.when(F.col(label) == F.lit(value), F.lit(list(cumulative)).cast("array<double>")).otherwise(cuts)
    most = max((len(c) for c in shares.values()), default=0)
    cut = hash_segments(df, id_col, seed, F.transform(cuts, lambda s: F.floor(s * F.col("_n"))), most, [label], "_s")
    known = F.col(label).isin(list(shares))
    return cut.withColumn(out, F.when(known, F.col("_s"))).drop("_s")


def partition_dirichlet(df: DataFrame, alpha: float | None, clients: int = 5, id_col: str = "row_id",
                        label: str = "label", seed: int = 42, out: str = "client_id",
                        classes: Sequence = (0, 1)) -> DataFrame:
    """D3: label-skewed partition; small ``alpha`` piles a class onto few clients."""
    if alpha is None:
        raise ValueError("a Dirichlet partition needs alpha")
    return partition_by_shares(df, dirichlet_shares(classes, alpha, clients, seed), id_col, label, seed, out)


def partition(df: DataFrame, scheme: str, alpha: float | None = None, clients: int = 5,
              id_col: str = "row_id", label: str = "label", seed: int = 42) -> DataFrame:
    """Choose the partition by name; an unknown scheme or a missing alpha is an error."""
    if scheme == "iid":
        return partition_iid(df, clients, id_col, seed)
    if scheme in ("dirichlet", "noniid"):
        return partition_dirichlet(df, alpha, clients, id_col, label, seed)
    raise ValueError(f"unknown partition scheme {scheme!r}")


def client_counts(df: DataFrame, clients: int | None = None, client: str = "client_id",
                  label: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """Rows, positives and positive share per client; clients without rows appear with zeros."""
    counts = df.groupBy(*keys, client).agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_if(F.col(label) == 1).alias("n_pos"))
    if clients is not None:
        groups = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
        wanted = groups.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(clients - 1))).alias(client))
        counts = null_safe_join(wanted, counts, [*keys, client], "left").fillna(0, ["n_samples", "n_pos"])
    share = F.when(F.col("n_samples") > 0, F.col("n_pos") / F.col("n_samples")).otherwise(F.lit(0.0))
    return counts.withColumn("pos_ratio", share)


def attach_assignment(features: DataFrame, assignment: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Rows with their stored client."""
    return features.join(assignment.select(id_col, "client_id"), id_col)


def partition_integrity(assignment: DataFrame, rows: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Rows assigned twice, missing from the assignment, or unknown; all zero when sound.

    One aggregate by row id over the two id lists side by side.
    """
    sides = assignment.select(id_col, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        rows.select(id_col, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    per_id = sides.groupBy(id_col).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    return per_id.agg(
        F.count_if(F.col("_a") > 1).alias("n_duplicated"),
        F.count_if((F.col("_a") == 0) & (F.col("_b") > 0)).alias("n_missing"),
        F.count_if((F.col("_a") > 0) & (F.col("_b") == 0)).alias("n_unknown"),
    ).withColumn("is_sound", (F.col("n_duplicated") + F.col("n_missing") + F.col("n_unknown")) == 0)


def shuffled_split(df: DataFrame, ratio: float = 0.75, id_col: str = "row_id", seed: int = 42,
                   out: str = "split") -> DataFrame:
    """Plain shuffled train/test split at ``int(n * ratio)``."""
    cut = hash_segments(df, id_col, seed, F.array(F.floor(F.col("_n") * F.lit(float(ratio)))), 1, (), "_s")
    return cut.withColumn(out, F.when(F.col("_s") == 0, "train").otherwise("test")).drop("_s")


def partition_equal(df: DataFrame, clients: int, id_col: str = "row_id", seed: int = 42,
                    val_ratio: float = 0.0) -> DataFrame:
    """Equal-length chunks, the remainder to the last client; optional val share per client."""
    size = F.greatest(F.floor(F.col("_n") / clients), F.lit(1))
    cuts = F.transform(F.sequence(F.lit(1), F.lit(clients - 1)), lambda j: j * size) if clients > 1 else F.array()
    out = hash_segments(df, id_col, seed, cuts, clients - 1, (), "client_id")
    if val_ratio <= 0:
        return out.withColumn("split", F.lit("train"))
    inner = hash_segments(out, id_col, f"{seed}-val", F.array(F.floor(F.col("_n") * F.lit(float(val_ratio)))), 1, ["client_id"], "_s")
    return inner.withColumn("split", F.when(F.col("_s") == 0, "val").otherwise("train")).drop("_s")


def _first_by_hash(df: DataFrame, id_col: str, seed, keys: Sequence[str], quota: Column, always: Column | None = None) -> DataFrame:
    """The first ``quota`` rows of each group in hash order, and those for which ``always`` holds."""
    cut = hash_segments(df, id_col, seed, F.array(quota), 1, keys, "_s")
    first = F.col("_s") == 0
    return cut.where(first if always is None else first | always).drop("_s")


def keep_positives(df: DataFrame, n_negatives: int | None, id_col: str = "row_id",
                   label: str = "label", seed: int = 42) -> DataFrame:
    """Every positive and at most ``n_negatives`` negatives (None keeps all)."""
    if n_negatives is None:
        return df
    return _first_by_hash(df, id_col, seed, [label], F.lit(n_negatives), F.col(label) == 1)


def balanced_subsample(df: DataFrame, cap: int | None, id_col: str = "row_id",
                       label: str = "label", seed: int = 42) -> DataFrame:
    """At most ``cap`` positives (None: all) and as many negatives."""
    counted = df.select(F.count_if(F.col(label) == 1).alias("n")).scalar()
    most = counted if cap is None else F.least(counted, F.lit(cap))
    return _first_by_hash(df, id_col, seed, [label], most)


def prevalence_sample(df: DataFrame, n: int = 500, id_col: str = "row_id", label: str = "label",
                      seed: int = 42) -> DataFrame:
    """``n`` rows at the table's own positive share, at least one positive."""
    share = df.select(F.avg(F.col(label).cast("double")).alias("p")).scalar()
    n_pos = F.greatest(F.lit(1), F.rint(F.lit(float(n)) * share).cast("int"))
    quota = F.when(F.col(label) == 1, n_pos).otherwise(F.lit(n) - n_pos)
    return _first_by_hash(df, id_col, seed, [label], quota)


def uniform_sample(df: DataFrame, n: int, id_col: str = "row_id", seed: int = 42) -> DataFrame:
    """``n`` rows chosen by hash order."""
    return _first_by_hash(df, id_col, seed, (), F.lit(n))


def client_background(df: DataFrame, n: int = 100, id_col: str = "row_id",
                      client: str | None = "client_id", seed: int = 43) -> DataFrame:
    """At most ``n`` rows per client, or ``n`` rows of one pool when there are no clients."""
    return _first_by_hash(df, id_col, seed, [client] if client else [], F.lit(n))


def background_centroids(df: DataFrame, features: Sequence[str], k: int = 10, seed: int = 42) -> DataFrame:
    """A background summarised to ``k`` centres with the share of rows each stands for."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    vectors = VectorAssembler(inputCols=list(features), outputCol="_v").transform(df)
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="centroid").fit(vectors)
    # the mean of a cluster's rows is its centre, so one aggregate yields centres and weights
    sizes = model.transform(vectors).groupBy("centroid").agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.avg(c).alias(c) for c in features])
    total = df.select(F.count(F.lit(1)).alias("n")).scalar()
    return sizes.withColumn("weight", F.col("n_rows") / total)
