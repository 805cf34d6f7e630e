"""Feature attributions and how far groups ("clients") agree on what matters.

Importances are long tables (keys..., client_id, feature, importance). Means over client pairs are never
computed pair by pair: unit rank vectors are summed for Spearman, per-feature and per-subset counts
give the overlaps, so the work grows with clients x features only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rareclass.functions.hashing import hash_uniform
from rareclass.functions.ranks import exact_quantiles, null_safe_join, shuffle_width
from rareclass.session import written

TOP_K = 5
NEAR_ZERO = 1e-9
DEGENERATE_ATOL, DEGENERATE_RTOL = 1e-12, 1e-9
AGREEMENT_FLOOR = 0.95
MAX_SUBSET_K = 20


# ------------------------------------------------------------------ attributions


def linear_attribution(rows: DataFrame, weights: DataFrame, background: DataFrame, client: str = "client_id") -> DataFrame:
    """``w_j * (x_j - mean background_j)`` for every client, row and feature.

    ``rows`` (row_id, feature, value), ``weights`` ([client], feature, w), ``background``
    (client, feature, value). Weights without a client column are shared.
    """
    means = background.groupBy(client, "feature").agg(F.avg("value").alias("_mean"))
    on = [client, "feature"] if client in weights.columns else ["feature"]
    # a row per client and feature: written, so that Spark knows how few they are and the rows are not dealt by feature
    params = written(means.join(weights, on).select(client, "feature", "w", "_mean"), "attribution-params")
    return rows.join(params, "feature").select(
        client, "row_id", "feature", (F.col("w") * (F.col("value") - F.col("_mean"))).alias("phi"))


def coalition_design(d: int, samples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(masks, coefficients): attributions are ``coefficients @ [v(empty), v(masks)..., v(all)]``.

    All coalitions when they fit in the budget, otherwise complementary pairs drawn by the Shapley
    kernel's size weights. Weighted least squares under "attributions add up to the margin".
    """
    if d == 1:
        return np.zeros((0, 1), dtype=np.int64), np.array([[-1.0, 1.0]])
    if 2 ** d - 2 <= samples:
        masks = np.array([[(m >> j) & 1 for j in range(d)] for m in range(1, 2 ** d - 1)])
        size = masks.sum(1)
        weight = np.array([(d - 1) / (comb(d, int(s)) * s * (d - s)) for s in size])
    else:
        rng = np.random.default_rng(seed)
        sizes = np.arange(1, d)
        p = 1.0 / (sizes * (d - sizes))
        drawn = []
        for s in rng.choice(sizes, size=samples // 2, p=p / p.sum()):
            row = np.zeros(d, dtype=np.int64)
            row[rng.choice(d, size=s, replace=False)] = 1
            drawn += [row, 1 - row]
        masks, count = np.unique(np.array(drawn), axis=0, return_counts=True)
        weight = count.astype(float)
    z = masks.astype(float)
    inverse = np.linalg.pinv(z.T @ (z * weight[:, None]))
    ones = np.ones(d)
    lift = inverse @ ones / (ones @ inverse @ ones)
    h = (np.eye(d) - np.outer(lift, ones)) @ inverse @ (z * weight[:, None]).T
    # v(empty) is subtracted from every coalition value and from v(all)
    return masks, np.column_stack([-h.sum(1) - lift, h, lift])


def sampled_shapley(rows: DataFrame, background: DataFrame, score: Callable[[DataFrame], DataFrame],
                    n_features: int, samples: int = 500, seed: int = 42, client: str = "client_id") -> DataFrame:
    """Sampled Shapley attributions of any scored model on its margin scale.

    ``rows`` (client, row_id, features), ``background`` (client, weight, features: a few centroids each);
    ``score`` adds ``margin`` to a table with ``features``. Every coalition takes its features from the
    row and the rest from each background point; margins are averaged over the background, and a fixed
    linear map turns a row's coalition values into attributions.
    Result: (client, row_id, base_value, margin, phi).
    """
    masks, coefficients = coalition_design(n_features, samples, seed)
    full = [[0] * n_features, *masks.tolist(), [1] * n_features]
    # few points per client: written, so that Spark knows their size and the rows need not be dealt by client, of which one may hold most
    backs = written(background.where(F.col(client).isNotNull()).groupBy(client).agg(F.collect_list(F.struct(
        F.col("weight").cast("double").alias("weight"), F.col("features").cast("array<double>").alias("b"))).alias("_backs")), "background")
    width = shuffle_width(rows)
    salted = backs.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    # dealt by row before they are unfolded: both sums below find their rows together
    own = rows.where(F.col(client).isNotNull()).select(client, "row_id", F.col("features").cast("array<double>").alias("_x")).repartition(
        width, client, "row_id").withColumn(
        "_salt", F.pmod(F.xxhash64("row_id"), F.lit(width)).cast("int"))
    table = F.lit([[float(on) for on in mask] for mask in full])
    mixed = own.join(salted, [client, "_salt"]).select(client, "row_id", "_x", F.explode("_backs").alias("_back")).select(
        client, "row_id", F.col("_back.weight").alias("weight"), "_x", F.col("_back.b").alias("_b"), F.posexplode(table).alias("coalition", "mask")).select(
        client, "row_id", "coalition", "weight",
        F.transform(F.arrays_zip("mask", "_x", "_b"), lambda t: F.when(t["mask"] == 1, t["_x"]).otherwise(t["_b"])).alias("features"))
    value = (F.sum(F.col("weight") * F.col("margin")) / F.sum("weight")).alias("v")
    per = score(mixed).groupBy(client, "row_id", "coalition").agg(value)
    listed = per.groupBy(client, "row_id").agg(F.sort_array(F.collect_list(F.struct("coalition", "v")))["v"].alias("v"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                v = np.stack(batch["v"].to_numpy())
                yield batch.assign(base_value=v[:, 0], margin=v[:, -1], phi=list(v @ coefficients.T)).drop(columns="v")

    types = dict(listed.dtypes)
    return listed.mapInPandas(
        solve, f"`{client}` {types[client]}, row_id {types['row_id']}, base_value double, margin double, phi array<double>")


def long_attributions(phis: DataFrame, names: Sequence[str], client: str = "client_id") -> DataFrame:
    """Attribution arrays to (client, row_id, feature, phi)."""
    return phis.select(client, "row_id", F.posexplode("phi").alias("_j", "phi")).select(
        client, "row_id", F.get(F.lit(list(names)), F.col("_j")).alias("feature"), "phi")


def additivity_error(phis: DataFrame, keys: Sequence[str] = ("client_id",)) -> DataFrame:
    """Largest gap between the margin and base value plus attributions."""
    total = F.aggregate("phi", F.lit(0.0), lambda s, v: s + v)
    return phis.groupBy(*keys).agg(F.max(F.abs(F.col("margin") - F.col("base_value") - total)).alias("max_error"))


# ------------------------------------------------------------------ importances


def importance(attributions: DataFrame, keys: Sequence[str] = ("client_id",)) -> DataFrame:
    """Mean absolute attribution per client and feature."""
    return attributions.groupBy(*keys, "feature").agg(F.avg(F.abs("phi")).alias("importance"))


def consensus(imp: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean importance over clients, ranked within ``keys``."""
    mean = imp.groupBy(*keys, "feature").agg(F.avg("importance").alias("mean_importance"))
    order = W.partitionBy(*keys).orderBy(F.desc("mean_importance"), "feature")
    return mean.withColumn("rank", F.row_number().over(order))


def top_consensus(imp: DataFrame, keys: Sequence[str] = (), n: int = 10) -> DataFrame:
    """The ``n`` leading features; rank 1 is the top feature."""
    return consensus(imp, keys).where(F.col("rank") <= n)


def _top_sets(imp: DataFrame, keys: Sequence[str], k: int, client: str) -> DataFrame:
    order = W.partitionBy(*keys, client).orderBy(F.desc("importance"), "feature")
    return imp.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)


def _shape(imp: DataFrame, keys: Sequence[str], client: str) -> DataFrame:
    """Clients and features per cell; a NULL marker column keeps one row per cell."""
    per = imp.groupBy(*keys, client).agg(F.count(F.lit(1)).alias("_d"))
    return per.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_clients"), F.max("_d").alias("n_features"))


def spearman_stability(imp: DataFrame, keys: Sequence[str] = (), client: str = "client_id") -> DataFrame:
    """E5: mean Spearman correlation over client pairs; NULL if any is undefined or clients < 2.

    With unit-length centred rank vectors z, the pair sum is (|sum z|^2 - clients) / 2.
    """
    per_client = W.partitionBy(*keys, client)
    order = per_client.orderBy("importance")
    tied = W.partitionBy(*keys, client, "importance")
    rank = F.rank().over(order) + (F.count(F.lit(1)).over(tied) - 1) / F.lit(2.0)
    ranked = imp.select(*keys, client, "feature", rank.alias("_r"))
    centred = ranked.withColumn("_c", F.col("_r") - F.avg("_r").over(per_client))
    unit = centred.withColumn("_q", F.sum(F.col("_c") * F.col("_c")).over(per_client)).select(
        *keys, client, "feature", (F.col("_q") <= 0).alias("_flat"),
        F.when(F.col("_q") > 0, F.col("_c") / F.sqrt("_q")).otherwise(0.0).alias("_z"))
    summed = unit.groupBy(*keys, "feature").agg(F.sum("_z").alias("_s"), F.bool_or("_flat").alias("_flat"))
    cell = summed.groupBy(*keys).agg(F.sum(F.col("_s") * F.col("_s")).alias("_n2"), F.bool_or("_flat").alias("_flat"))
    k = F.col("n_clients")
    return null_safe_join(_shape(imp, keys, client), cell, keys).select(
        *keys, "n_clients", "n_features",
        F.when((k > 1) & ~F.col("_flat"), (F.col("_n2") - k) / (k * (k - 1))).alias("spearman"))


def jaccard_at_k(imp: DataFrame, k: int = TOP_K, keys: Sequence[str] = (), client: str = "client_id") -> DataFrame:
    """Mean Jaccard overlap of the clients' top-k features over all client pairs.

    Each client lists the subsets of its top set; a subset held by c clients lies in C(c, 2) pairs, and
    inclusion-exclusion over subset sizes turns those counts into the exact mean.
    """
    if not 1 <= k <= MAX_SUBSET_K:
        raise ValueError(f"k must be between 1 and {MAX_SUBSET_K}, got {k}")
    top = _top_sets(imp, keys, k, client)
    sets = top.groupBy(*keys, client).agg(F.sort_array(F.collect_list("feature")).alias("_f"))
    masks = sets.withColumn("_m", F.explode(F.expr("sequence(1, shiftleft(1, size(_f)) - 1)")))
    subset = F.expr("filter(_f, (f, i) -> (shiftright(_m, i) & 1) = 1)")
    shared = masks.withColumn("_sub", subset).groupBy(*keys, "_sub").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
    c = F.col("_c")
    by_size = shared.groupBy(*keys, F.size("_sub").alias("_m")).agg(F.sum(c * (c - 1) / 2).alias("_pairs"))
    coef = F.lit(0.0)
    size = F.least(F.col("n_features"), F.lit(k))
    joined = null_safe_join(by_size, _shape(imp, keys, client), keys)
    for m in range(1, k + 1):
        term = F.lit(0.0)
        for r in range(1, m + 1):
            term = term + F.lit(float((-1) ** (m - r) * comb(m, r) * r)) / (2 * size - r)
        coef = F.when(F.col("_m") == m, term).otherwise(coef)
    total = joined.groupBy(*keys).agg(F.sum(F.col("_pairs") * coef).alias("_t"))
    n = F.col("n_clients")
    return null_safe_join(_shape(imp, keys, client), total, keys, "left").select(
        *keys, F.when(n > 1, F.coalesce("_t", F.lit(0.0)) / (n * (n - 1) / 2)).alias("jaccard"))


def kuncheva(shared: Column, k: Column, d: Column) -> Column:
    """Overlap of two size-k selections from d features, corrected for chance."""
    k, d = k.cast("double"), d.cast("double")
    expected = k * k / d
    return F.when((k == 0) | (k == d), F.lit(1.0)).otherwise((shared - expected) / (k - expected))


def kuncheva_pair(pairs: DataFrame, a: str = "a", b: str = "b", d: str = "d", out: str = "kuncheva") -> DataFrame:
    """E7 on array columns; selections of different size raise an error."""
    checked = F.when(F.size(a) == F.size(b), F.size(a)).otherwise(
        F.raise_error(F.lit("selections must have equal size")).cast("int"))
    return pairs.withColumn(out, kuncheva(F.size(F.array_intersect(a, b)), checked, F.col(d)))


def kuncheva_index(imp: DataFrame, k: int = TOP_K, keys: Sequence[str] = (), client: str = "client_id") -> DataFrame:
    """Mean Kuncheva index over client pairs, from how many clients select each feature."""
    chosen = _top_sets(imp, keys, k, client).groupBy(*keys, "feature").agg(F.count(F.lit(1)).alias("_c"))
    c, n = F.col("_c"), F.col("n_clients")
    shared = chosen.groupBy(*keys).agg(F.sum(c * (c - 1) / 2).alias("_s"))
    size = F.least(F.col("n_features"), F.lit(k))
    mean_shared = F.col("_s") / (n * (n - 1) / 2)
    return null_safe_join(_shape(imp, keys, client), shared, keys).select(
        *keys, F.when(n > 1, kuncheva(mean_shared, size, F.col("n_features"))).alias("kuncheva"))


def near_zero_share(imp: DataFrame, keys: Sequence[str] = ("client_id",), eps: float = NEAR_ZERO) -> DataFrame:
    """Share of features a client gives (almost) no importance."""
    return imp.groupBy(*keys).agg(F.avg((F.abs("importance") <= eps).cast("double")).alias("near_zero"))


def degenerate_clients(imp: DataFrame, keys: Sequence[str] = (), client: str = "client_id") -> DataFrame:
    """Clients whose importances are all zero or all equal, so that they rank nothing."""
    size = F.abs("importance")
    per = imp.groupBy(*keys, client).agg(F.max(size).alias("_hi"), F.min(size).alias("_lo"))
    flat = (F.col("_hi") <= DEGENERATE_ATOL) | (F.col("_hi") - F.col("_lo") <= DEGENERATE_RTOL * F.col("_hi"))
    return per.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(flat, F.col(client)))).alias("degenerate_clients"))


def stability(imp: DataFrame, keys: Sequence[str] = (), k: int = TOP_K, client: str = "client_id") -> DataFrame:
    """The three agreement measures, all NULL with a reason where they would mean nothing."""
    base = spearman_stability(imp, keys, client)
    for part in (jaccard_at_k(imp, k, keys, client), kuncheva_index(imp, k, keys, client),
                 degenerate_clients(imp, keys, client)):
        base = null_safe_join(base, part, keys)
    bad = F.size("degenerate_clients") > 0
    reason = F.when(F.col("n_clients") < 2, "agreement needs two clients").when(
        bad, F.concat(F.lit("no ranking from clients "),
                      F.array_join(F.transform("degenerate_clients", lambda c: c.cast("string")), ", "))).when(
        F.col("spearman").isNull(), "rank correlation undefined")
    usable = (F.col("n_clients") >= 2) & ~bad
    return base.select(*keys, "n_clients", "n_features", *[
        F.when(usable, F.col(c)).alias(c) for c in ("spearman", "jaccard", "kuncheva")],
        "degenerate_clients", reason.alias("stability_note"))


def annotate_floor(cells: DataFrame, floors: Mapping[str, float], model: str = "model", value: str = "spearman") -> DataFrame:
    """The model's own noise floor and whether the value is at or below it; no floor -> NULL."""
    floor = F.lit(None).cast("double")
    for name, f in floors.items():
        floor = F.when(F.col(model) == name, F.lit(float(f))).otherwise(floor)
    number = F.expr(f"try_cast(`{value}` AS double)")
    return cells.withColumn("noise_floor", floor).withColumn("below_floor", number <= F.col("noise_floor"))


def self_agreement(imp: DataFrame, keys: Sequence[str], seed: str = "seed", k: int = TOP_K) -> DataFrame:
    """How well two runs of an estimator with different seeds agree with each other."""
    rho = spearman_stability(imp, keys, seed).select(*keys, "spearman")
    return null_safe_join(rho, jaccard_at_k(imp, k, keys, seed), keys)


def adopted_budget(agreement: DataFrame, budget: str = "budget", floor: float = AGREEMENT_FLOOR) -> DataFrame:
    """The smallest sampling budget at which every model agrees with itself beyond ``floor``."""
    ok = agreement.groupBy(budget).agg(F.bool_and(F.coalesce(F.col("spearman") > floor, F.lit(False))).alias("_ok"))
    return ok.agg(F.min(F.when(F.col("_ok"), F.col(budget))).alias("adopted_budget"))


def compare_importance(fresh: DataFrame, stored: DataFrame, keys: Sequence[str] = ("client_id", "feature"),
                       tol: float = 1e-6) -> DataFrame:
    """Largest difference to a stored importance table and rows only one side has."""
    a = fresh.select(*keys, F.col("importance").alias("_a"), F.lit(1).alias("_in_a"))
    b = stored.select(*keys, F.col("importance").alias("_b"), F.lit(1).alias("_in_b"))
    both = a.join(b, list(keys), "full")
    return both.agg(
        F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_difference"),
        F.count_if(F.col("_in_a").isNull()).alias("n_only_stored"),
        F.count_if(F.col("_in_b").isNull()).alias("n_only_fresh"),
    ).withColumn("matches", (F.coalesce("max_difference", F.lit(0.0)) <= tol)
                 & (F.col("n_only_stored") + F.col("n_only_fresh") == 0))


def pooled_order(attributions: DataFrame, k: int = 10) -> DataFrame:
    """Features by mean absolute attribution over all rows and clients."""
    mean = attributions.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs"))
    top = mean.orderBy(F.desc("mean_abs"), "feature").limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("mean_abs"), "feature")))


def beeswarm_points(attributions: DataFrame, rows: DataFrame, k: int = 10, seed: int = 42,
                    client: str = "client_id") -> DataFrame:
    """Attribution points of the leading features with a 0-1 colour value and a fixed jitter."""
    span = rows.groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    shade = (F.col("value") - F.col("_lo")) / F.when(width == 0, 1.0).otherwise(width)
    points = attributions.join(pooled_order(attributions, k), "feature").join(rows, ["row_id", "feature"]).join(span, "feature")
    jitter = hash_uniform(seed, client, "row_id", "feature") * 0.64 - 0.32
    return points.select(client, "row_id", "feature", "rank", "phi",
                         F.least(F.lit(1.0), F.greatest(F.lit(0.0), shade)).alias("shade"), jitter.alias("jitter"))


def beeswarm_limits(points: DataFrame) -> DataFrame:
    """Axis limits at the 0.5 and 99.5 percentiles."""
    return exact_quantiles(points, "phi", {"x_low": 0.005, "x_high": 0.995})


def client_bars(imp: DataFrame, order: DataFrame) -> DataFrame:
    """Per-client importance of the leading features."""
    return imp.join(order.select("feature"), "feature", "left_semi")


# ------------------------------------------------------------------ tables over cells


def comparable_cells(cells: DataFrame, floors: Mapping[str, float], metrics: Sequence[str] = ("spearman", "jaccard", "kuncheva")) -> DataFrame:
    """Cells with more than one client, text metrics as numbers, the model's floor attached."""
    numeric = cells.where(F.expr("try_cast(n_clients AS int) > 1")).withColumns(
        {m: F.expr(f"try_cast(`{m}` AS double)") for m in metrics})
    return annotate_floor(numeric, floors)


def margin_to_floor(cells: DataFrame) -> DataFrame:
    """Sampled-explainer cells by their distance to the floor, smallest first."""
    kept = cells.where(F.col("spearman").isNotNull() & F.col("noise_floor").isNotNull())
    return kept.withColumn("margin", F.col("spearman") - F.col("noise_floor")).orderBy("margin")


def floor_count(cells: DataFrame) -> DataFrame:
    """How many of those cells sit at or below their floor."""
    both = F.col("spearman").isNotNull() & F.col("noise_floor").isNotNull()
    return cells.agg(F.count_if(both & (F.col("spearman") <= F.col("noise_floor"))).alias("n_below"),
                     F.count_if(both).alias("n_cells"))


def box_statistics(cells: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("model",)) -> DataFrame:
    """Quartiles and whiskers (furthest values within 1.5 interquartile ranges) per group and metric."""
    long = cells.unpivot(list(keys), list(metrics), "metric", "value").where(F.col("value").isNotNull())
    group = [*keys, "metric"]
    q = exact_quantiles(long, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, group)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = null_safe_join(long, q, group).where(F.col("value").between(F.col("q1") - reach, F.col("q3") + reach))
    ends = inside.groupBy(*group).agg(F.min("value").alias("whisker_low"), F.max("value").alias("whisker_high"))
    counts = long.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    return null_safe_join(null_safe_join(q, ends, group), counts, group)


def pivot_mean(cells: DataFrame, row: str, column: str, value: str, columns: Sequence[str]) -> DataFrame:
    """Mean value per (row, column) with columns in the given order."""
    return cells.groupBy(row).pivot(column, list(columns)).agg(F.avg(value))


def least_stable(cells: DataFrame, value: str = "kuncheva", n: int = 5, ties: Sequence[str] = ()) -> DataFrame:
    """The ``n`` cells that agree least, with a text line."""
    return cells.where(F.col(value).isNotNull()).orderBy(value, *ties).limit(n).withColumn(
        "line", F.format_string("%.4f (jaccard=%.4f, spearman=%.4f)", value, "jaccard", "spearman"))
