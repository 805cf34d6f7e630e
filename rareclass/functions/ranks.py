"""Exact global ranks, running totals and quantiles without a single-task sort.

A window ordered over a whole table (or over one very large group) runs in one task. Here rows
are first cut into ordered buckets, bucket totals (a small table) are accumulated, and the window
runs inside each bucket; adding the bucket's offset makes the result exact. One group holding
most of the rows is spread over many buckets like any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rareclass.functions.hashing import hash_text
from rareclass.session import written


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; keeps the left key columns."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    condition = F.lit(True)
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(renamed, condition, how).drop(*[f"_r_{c}" for c in on])


def bucket_key(keys: Sequence[str]) -> Column:
    """Group and bucket as one struct: NULL keys compare equal inside it, and the join with the bucket
    offsets and the window inside a bucket share a single shuffle."""
    return F.struct(*keys, "_b")


# ---------------------------------------------------------------- hash order


def hash_rank(
    df: DataFrame, id_col: str, seed: int | str, keys: Sequence[str] = (),
    out: str = "hash_rank", total: str = "n_group",
) -> DataFrame:
    """Rank (1-based) of each row in md5 order of ``seed:id`` within ``keys``, plus group size.

    The leading hex digits of the hash are the buckets: uniform whatever the data looks like.
    """
    width = shuffle_width(df)
    digits = 2 if width <= 64 else 3 if width <= 1024 else 4
    hashed = df.withColumn("_h", hash_text(seed, id_col)).withColumn("_b", F.substring("_h", 1, digits))
    hashed = hashed.withColumn("_k", bucket_key(keys))
    counts = hashed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    order = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        bucket_key(keys).alias("_k"),
        F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_offset"),
        F.sum("_n").over(W.partitionBy(*keys)).alias(total),
    )
    inside = W.partitionBy("_k").orderBy("_h", id_col)
    return (
        hashed.join(offsets, "_k")
        .withColumn(out, F.row_number().over(inside) + F.col("_offset"))
        .drop("_k", "_h", "_b", "_offset")
    )


def hash_segments(df: DataFrame, id_col: str, seed: int | str, cuts: Column, n_cuts: int, keys: Sequence[str] = (), out: str = "segment") -> DataFrame:
    """How many of the group's cuts lie below each row's rank in md5 order of ``seed:id`` within ``keys``.

    ``cuts`` is an array of ``n_cuts`` ascending ranks made of the group size ``_n`` and the keys: a row of rank r has as many segments
    before it as there are cuts < r. Rows are not ranked. Counts per hash prefix show in which prefix each cut falls, only the rows of these
    prefixes (ids and hashes) are ordered, and the hash found at a cut then decides for all rows, which stay where they are. Ids must be unique.
    """
    hashed = df.select(*keys, F.col(id_col).alias("_id"), hash_text(seed, id_col).alias("_h")).withColumn("_b", F.substring("_h", 1, 4))
    counts = hashed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    whole = W.partitionBy(*keys)
    upto = whole.orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = counts.withColumn("_n", F.sum("_c").over(whole)).withColumn("_end", F.sum("_c").over(upto)).withColumn("_cuts", cuts.cast("array<bigint>"))
    inside = F.filter("_cuts", lambda c: (c > F.col("_end") - F.col("_c")) & (c <= F.col("_end")))
    # the prefixes that hold a cut and each group's first one: written, so that Spark knows how few they are
    held = placed.select(*keys, "_b", (F.col("_end") - F.col("_c")).alias("_before"), inside.alias("_inside"),
                         F.size(F.filter("_cuts", lambda c: c <= 0)).alias("_none")).where((F.col("_before") == 0) | (F.size("_inside") > 0))
    held = written(held, "cut-prefixes")
    near = null_safe_join(hashed, held.where(F.size("_inside") > 0), [*keys, "_b"])
    first = held.where(F.col("_before") == 0).select(*keys, "_none")  # a row for every group, with or without a cut inside
    near = written(near.unionByName(first, allowMissingColumns=True), "cut-rows")
    rank = F.col("_before") + F.row_number().over(W.partitionBy(*keys, "_b").orderBy("_h", "_id"))
    here = F.transform(F.filter("_inside", lambda c: c == F.col("_rank")), lambda c: F.struct("_h", "_id"))
    marks = near.withColumn("_rank", rank).groupBy(*keys).agg(
        F.max("_none").alias("_none"), F.array_sort(F.flatten(F.collect_list(here))).alias("_marks"))
    # a group may hold most rows: its marks come once per salt, so its rows are spread over tasks where the join has to shuffle
    width = shuffle_width(df)
    salted = marks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    own = df.withColumn("_own", F.struct(hash_text(seed, id_col).alias("_h"), F.col(id_col).alias("_id"))).withColumn(
        "_salt", F.pmod(F.xxhash64(id_col), F.lit(width)).cast("int"))
    met = null_safe_join(own, salted, [*keys, "_salt"])
    depth = max(1, n_cuts.bit_length())
    steps = F.lit([1 << j for j in reversed(range(depth))])
    below = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get("_marks", at + step - 1) < F.col("_own"), step).otherwise(0))
    return met.withColumn(out, (F.col("_none") + F.coalesce(below, F.lit(0))).cast("int")).drop("_own", "_salt", "_none", "_marks")


# ---------------------------------------------------------------- value order


def range_cuts(df: DataFrame, value: str | Column, buckets: int | None = None) -> list[float]:
    """Cut points that split ``value`` into about equal parts.

    One small job; at most 4,096 numbers reach the driver and they only steer balance: results are
    the same for any cuts. They become literals, so a re-run task sees the same buckets.
    """
    buckets = buckets or min(4096, max(16, 4 * shuffle_width(df)))
    shares = [i / buckets for i in range(1, buckets)]
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    row = df.select(v.alias("v")).agg(
        F.percentile_approx("v", shares, max(1000, 4 * buckets)).alias("cuts")
    ).first()
    return sorted({c for c in (row["cuts"] or []) if c is not None and c == c})


def bucket_of(value: str | Column, cuts: Sequence[float]) -> Column:
    """How many cuts are <= value, by binary search inside the expression."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    if not cuts:
        return F.lit(0)
    depth = len(cuts).bit_length()
    padded = F.lit([*cuts, *[float("inf")] * ((1 << depth) - 1 - len(cuts))])
    steps = F.lit([1 << j for j in reversed(range(depth))])
    found = F.aggregate(
        steps, F.lit(0),
        lambda at, step: at + F.when(F.get(padded, at + step - 1) <= v, step).otherwise(0),
    )
    return F.least(found, F.lit(len(cuts)))


def running_totals(
    df: DataFrame, order: str, sums: Mapping[str, str], keys: Sequence[str] = (),
    descending: bool = False, cuts: Sequence[float] | None = None, lead: Sequence[str] = (),
    maxes: Mapping[str, str] | None = None, prior_maxes: Mapping[str, str] | None = None,
) -> DataFrame:
    """Inclusive running sums of columns along ``order`` within ``keys``.

    ``sums`` maps an output name to an input column; ``tot_<output>`` carries the group total. Rows
    must be unique on (keys, order): aggregate equal values first, which also removes hot values.
    ``lead`` columns also come back as ``next_<col>`` from the following row, across buckets too.
    ``maxes`` are inclusive running maxima, ``prior_maxes`` those of the rows before (NULL at first).
    """
    maxes, prior_maxes = dict(maxes or {}), dict(prior_maxes or {})
    tops = {**maxes, **prior_maxes}
    if cuts is None:
        cuts = range_cuts(df, order)
    cut = df.withColumn("_b", bucket_of(order, cuts)).withColumn("_k", bucket_key(keys))
    by = F.col(order).desc() if descending else F.col(order).asc()
    first = F.struct(*[F.col(c) for c in lead]) if lead else None
    totals = [F.sum(c).alias(f"_s_{n}") for n, c in sums.items()]
    totals += [F.max(c).alias(f"_x_{n}") for n, c in tops.items()]
    if not totals:
        totals = [F.count(F.lit(1)).alias("_rows")]
    if lead:
        pick = F.max_by if descending else F.min_by
        totals.append(pick(first, F.col(order)).alias("_first"))
    per_bucket = cut.groupBy(*keys, "_b").agg(*totals)
    bucket_order = F.col("_b").desc() if descending else F.col("_b").asc()
    whole = W.partitionBy(*keys)
    before = whole.orderBy(bucket_order).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_bucket.select(
        bucket_key(keys).alias("_k"),
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_s_{n}").over(whole).alias(f"tot_{n}") for n in sums],
        *[F.max(f"_x_{n}").over(before).alias(f"_m_{n}") for n in tops],
        *([F.lead("_first").over(whole.orderBy(bucket_order)).alias("_following")] if lead else []),
    )
    joined = cut.join(offsets, "_k")
    inside = W.partitionBy("_k").orderBy(by)
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = inside.rowsBetween(W.unboundedPreceding, -1)
    out = joined.select(
        *df.columns,
        *[(F.sum(c).over(upto) + F.col(f"_o_{n}")).alias(n) for n, c in sums.items()],
        *[F.col(f"tot_{n}") for n in sums],
        *[F.greatest(F.max(c).over(upto), F.col(f"_m_{n}")).alias(n) for n, c in maxes.items()],
        *[F.greatest(F.max(c).over(earlier), F.col(f"_m_{n}")).alias(n) for n, c in prior_maxes.items()],
        *([F.coalesce(F.lead(first).over(inside), F.col("_following")).alias("_next")] if lead else []),
    )
    if lead:
        out = out.select(*[c for c in out.columns if c != "_next"],
                         *[F.col(f"_next.{c}").alias(f"next_{c}") for c in lead])
    return out


def exact_quantiles(
    df: DataFrame, value: str, probs: Mapping[str, float], keys: Sequence[str] = (),
) -> DataFrame:
    """Interpolated quantiles per group, exact, with no group's values held in one task.

    Equal values are merged, running counts located, and each quantile reads the two order
    statistics around position ``p * (n - 1)``.
    """
    kept = df.where(F.col(value).isNotNull())
    counted = kept.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_totals(counted, value, {"_cum": "_n"}, keys, cuts=range_cuts(kept, value))
    picks = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("tot__cum") - 1)
        picks += [
            F.min(F.when(F.col("_cum") > F.floor(at), F.col(value))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("_cum") > F.ceil(at), F.col(value))).alias(f"_hi_{name}"),
        ]
    found = ranked.groupBy(*keys).agg(F.max("tot__cum").alias("_total"), *picks)
    out = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_total") - 1)
        lo, hi = F.col(f"_lo_{name}").cast("double"), F.col(f"_hi_{name}").cast("double")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return found.select(*keys, *out)
