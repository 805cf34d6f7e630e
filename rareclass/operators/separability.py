"""How hard the two classes are to tell apart: neighbourhood, overlap and per-feature measures."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from rareclass.functions.ranks import exact_quantiles, null_safe_join, range_cuts, running_totals
from rareclass.operators.neighbors import BLOCK_ROWS, knn_join, nearest_in_block, nearest_of_both, nearest_segments, pair_blocks, stack
from rareclass.session import cut_lineage, written

TYPOLOGY_K = 5
OVERLAP_BINS = 199
TREE_ROWS = 2048  # points whose spanning tree one task grows from all distances, and the least rows of a block of points
TREE_NEAR = 8  # nearest points that each point of a larger tree knows
TREE_EDGES = 1_000_000  # edges between components that one task merges


# ------------------------------------------------------------------ neighbourhoods


def minority_types(df: DataFrame, refs: DataFrame | None = None, id_col: str = "row_id",
                   vec: str = "features", label: str = "label") -> DataFrame:
    """Type of each minority row by positives among its 5 neighbours: 4+ safe, 2-3 borderline, 1 rare, 0 outlier."""
    queries = df.where(F.col(label) == 1)
    near = knn_join(queries, df if refs is None else refs, TYPOLOGY_K, id_col, vec, carry=[label], exclude_self=True)
    n = F.col("n_minority_neighbours")
    found = near.groupBy("query_id").agg(F.sum(f"nn_{label}").cast("bigint").alias("n_minority_neighbours"))
    # a row without any neighbour (a lone row, or one whose vector holds NaN or NULL) stays, as an outlier
    every = queries.select(F.col(id_col).alias("query_id")).join(found, "query_id", "left").withColumn(
        "n_minority_neighbours", F.coalesce("n_minority_neighbours", F.lit(0)).cast("bigint"))
    return every.withColumn(
        "kind", F.when(n >= 4, "safe").when(n >= 2, "borderline").when(n == 1, "rare").otherwise("outlier"))


def minority_typology(df: DataFrame, refs: DataFrame | None = None, id_col: str = "row_id",
                      vec: str = "features", label: str = "label") -> DataFrame:
    """Counts and percentages of the four minority types."""
    types = minority_types(df, refs, id_col, vec, label)
    kinds = ("safe", "borderline", "rare", "outlier")
    counts = types.agg(F.count(F.lit(1)).alias("n_minority"),
                       *[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    pct = {k: F.when(F.col("n_minority") > 0, F.lit(100.0) * F.col(k) / F.col("n_minority")) for k in kinds}
    return counts.select("*", *[pct[k].alias(f"{k}_pct") for k in kinds],
                         (pct["rare"] + pct["outlier"]).alias("rare_outlier_pct"))


def n3_error(df: DataFrame, id_col: str = "row_id", vec: str = "features", label: str = "label") -> DataFrame:
    """Leave-one-out error rate of the nearest neighbour."""
    near = knn_join(df, df, 1, id_col, vec, keep=[label], carry=[label], exclude_self=True)
    return near.agg(F.avg((F.col(label) != F.col(f"nn_{label}")).cast("double")).alias("n3"))


def n2_ratio(df: DataFrame, id_col: str = "row_id", vec: str = "features", label: str = "label") -> DataFrame:
    """Summed nearest distances inside the own class over those to the other class."""
    own = df.select(id_col, vec, F.col(label).alias("_side"))
    other = df.select(id_col, vec, (1 - F.col(label)).alias("_side"))
    intra = knn_join(own, own, 1, id_col, vec, by=["_side"], exclude_self=True)
    inter = knn_join(own, other, 1, id_col, vec, by=["_side"])
    both = intra.select(F.col("distance").alias("a"), F.lit(0.0).alias("b")).unionByName(
        inter.select(F.lit(0.0).alias("a"), F.col("distance").alias("b")))
    return both.agg((F.sum("a") / F.nullif(F.sum("b"), F.lit(0.0))).alias("n2"))


def _block_tree(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of a minimum spanning tree of the rows of one block pair.

    One matrix product gives all squared distances; where they are so small that rounding shows, they come from direct differences, as do
    the lengths of the edges.
    """
    n = len(v)
    centred = v - v.mean(0)
    norm = (centred * centred).sum(1)
    square = norm[:, None] + norm[None, :]
    square -= 2.0 * (centred @ centred.T)
    for start in range(0, n, 256):
        rows, cols = np.nonzero(square[start:start + 256] < 1e-6 * norm.max())
        for s in range(0, len(rows), 100_000):
            i, j = rows[s:s + 100_000] + start, cols[s:s + 100_000]
            gap = v[i] - v[j]
            square[i, j] = (gap * gap).sum(1)
    best, parent, open_ = np.full(n, np.inf), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    a, b = np.empty(n - 1, np.int64), np.empty(n - 1, np.int64)
    at = 0
    open_[0] = False
    for i in range(n - 1):
        closer = np.flatnonzero((square[at] < best) & open_)
        best[closer], parent[closer] = square[at, closer], at
        at = int(best.argmin())
        open_[at] = False
        a[i], b[i] = parent[at], at
        best[at] = np.inf
    gap = v[a] - v[b]
    return a, b, np.sqrt((gap * gap).sum(1))


def _near_lists(points: DataFrame, n: int, block_rows: int) -> DataFrame:
    """(id, near): the ``TREE_NEAR`` nearest other points, nearest first.

    Points meet those of their own block first; what they find bounds what they look for in the others. A task holds two blocks and serves
    both with the same products of matrices.
    """
    rows = max(block_rows, min(16 * block_rows, n // 12))
    blocks = -(-n // rows)
    id_type = points.schema["id"].dataType
    lists = [T.StructField("d", T.ArrayType(T.DoubleType())), T.StructField("other", T.ArrayType(id_type))]

    def found(side: pd.DataFrame, other: pd.DataFrame, near: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pd.DataFrame:
        own, at, d = near
        cuts, ids = np.searchsorted(own, np.arange(1, len(side))), other["id"].to_numpy()
        return pd.DataFrame({"id": side["id"].to_numpy(), "d": np.split(d, cuts), "other": np.split(ids[at], cuts)})

    def alone(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = stack(pdf["_v"])
        return found(pdf, pdf, nearest_of_both(x, x, TREE_NEAR, True)[0]).assign(_v=pdf["_v"].to_numpy(), _b=pdf["_b"].to_numpy())

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        sides = [pdf[pdf["_b"] == b] for b in (pdf["_i"].iloc[0], pdf["_j"].iloc[0])]
        if not min(map(len, sides)):
            return pd.DataFrame(columns=["id", "d", "other"])
        x, y = (stack(side["_v"]) for side in sides)
        near = nearest_of_both(x, y, TREE_NEAR, most=tuple(side["_most"].to_numpy() for side in sides))
        return pd.concat([found(sides[0], sides[1], near[0]), found(sides[1], sides[0], near[1])])

    placed = points.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(blocks).cast("bigint")))
    schema = T.StructType([T.StructField("id", id_type), *lists, points.schema["_v"], T.StructField("_b", T.LongType())])
    first = written(placed.repartition(4 * blocks, "_b").groupBy("_b").applyInPandas(alone, schema), "tree-blocks")
    most = F.when(F.size("d") < TREE_NEAR, F.lit(float("inf"))).otherwise(F.get("d", F.lit(TREE_NEAR - 1)))
    placed = first.select("id", "_v", "_b", most.alias("_most")).withColumn(
        "_o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))).where(F.col("_o") != F.col("_b"))
    placed = placed.withColumn("_i", F.least("_b", "_o")).withColumn("_j", F.greatest("_b", "_o")).drop("_o")
    rest = placed.repartition(2 * blocks * (blocks - 1), "_i", "_j").groupBy("_i", "_j").applyInPandas(
        meet, T.StructType([T.StructField("id", id_type), *lists]))
    every = F.sort_array(F.flatten(F.collect_list(F.arrays_zip(F.col("d").alias("distance"), F.col("other").alias("other")))))
    return first.select("id", "d", "other").union(rest.where(F.size("d") > 0)).groupBy("id").agg(F.slice(every, 1, TREE_NEAR).alias("near"))


def _grow(pdf: pd.DataFrame) -> pd.DataFrame:
    """Tree edges and the new name of every component, from all edges between components; a component takes its shortest edge where no
    unknown one can be shorter (``bound``)."""
    pdf = pdf.sort_values(["distance", "a_id", "b_id"])
    d = pdf["distance"].to_numpy()
    names, ends = np.unique(np.concatenate([pdf["ca"].to_numpy(), pdf["cb"].to_numpy()]), return_inverse=True)
    ends = ends.reshape(2, -1)
    bound = np.empty(len(names))
    for e, c in zip(ends, ("ba", "bb")):
        bound[e] = pdf[c].to_numpy()
    root, picked, live = np.arange(len(names)), [], np.arange(len(d))
    while True:
        a, b = root[ends[0][live]], root[ends[1][live]]
        apart = a != b
        live, a, b = live[apart], a[apart], b[apart]
        first = np.full(len(names), -1)
        for e in (a, b):  # the last one written stays: the shortest
            own = np.full(len(names), -1)
            own[e[::-1]] = np.arange(len(live))[::-1]
            first = np.where((own >= 0) & ((first < 0) | (own < first)), own, first)
        c = np.flatnonzero(first >= 0)
        c = c[d[live[first[c]]] <= bound[c]]
        if not len(c):
            break
        at = first[c]
        to = np.arange(len(names))
        to[c] = a[at] + b[at] - c
        mutual = (to[to] == np.arange(len(names))) & (np.arange(len(names)) < to)
        to[mutual] = np.flatnonzero(mutual)
        while (to[to] != to).any():
            to = to[to]
        picked.append(np.unique(live[at]))
        least = np.full(len(names), np.inf)
        np.minimum.at(least, to, bound)
        root, bound = to[root], least
    edges = pdf.iloc[np.concatenate(picked) if picked else []][["a_id", "b_id", "distance"]]
    return pd.concat([edges.assign(c=None, to=None), pd.DataFrame({"a_id": None, "b_id": None, "distance": np.nan, "c": names, "to": names[root]})])


def _roots(pick: DataFrame) -> DataFrame:
    """(c, to): the component in which each picking one ends up; of two that picked each other the smaller one becomes the root."""
    back = pick.select(F.col("c").alias("to"), F.col("to").alias("back"))
    link = pick.select("c", "to").join(back, "to", "left").select(
        "c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c"))
        .otherwise(F.col("to")).alias("to"))
    while True:
        for _ in range(2):  # links lead four times as far after each table
            hop = link.select(F.col("c").alias("to"), F.col("to").alias("next"))
            far = F.coalesce("next", "to")
            link = link.join(hop, "to", "left").select("c", far.alias("to"), (far != F.col("to")).alias("moved"))
        link = written(link, "tree-links")
        if link.where("moved").isEmpty():
            return link.drop("moved")
        link = link.drop("moved")


def _outside(points: DataFrame, state: DataFrame, open_: DataFrame, block_rows: int) -> DataFrame:
    """(id, c, distance, other, co): the nearest point of another component, for the points of the components ``open_`` that may be
    nearer to one than the component's shortest known edge."""
    placed = points.join(state, "id")
    near = F.col("known").isNull() | (F.col("bound") < F.col("known"))
    q = placed.join(open_, "c").where(near).select(F.lit(0).alias("_k"), F.col("id").alias("query_id"), "_v", "c")
    r = placed.select(F.lit(0).alias("_k"), F.col("id").alias("nn_id"), "_v", F.col("c").alias("co"))
    q, r = pair_blocks(q, r, ["_k"], "query_id", "nn_id", block_rows)

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["id", "c", "distance", "other", "co"])
        own, far = left["c"].to_numpy(), right["co"].to_numpy()
        codes = np.unique(np.concatenate([own, far]), return_inverse=True)[1]
        a, b = codes[:len(own)], codes[len(own):]
        i, j, d = nearest_in_block(stack(left["_v"]), stack(right["_v"]), right["nn_id"].to_numpy(), 1,
                                   lambda s, e: a[s:e, None] == b[None, :])
        return pd.DataFrame({"id": left["query_id"].to_numpy()[i], "c": own[i], "distance": d,
                             "other": right["nn_id"].to_numpy()[j], "co": far[j]})

    id_type = points.schema["id"].dataType
    schema = T.StructType([T.StructField(c, T.DoubleType() if c == "distance" else id_type) for c in ("id", "c", "distance", "other", "co")])
    task, r = ["_lb", "_rb"], r.toDF(*r.columns)
    found = q.groupBy(*task).cogroup(r.groupBy(*task)).applyInPandas(block, schema)
    return found.groupBy("id", "c").agg(F.min(F.struct("distance", "other", "co")).alias("m")).select("id", "c", "m.*")


def _canonical(df: DataFrame, a: str, b: str, ca: str, cb: str) -> DataFrame:
    low = F.col(a) < F.col(b)
    pick = [F.when(low, F.col(p)).otherwise(F.col(q)).alias(n) for n, p, q in
            (("a_id", a, b), ("b_id", b, a), ("ca", ca, cb), ("cb", cb, ca))]
    return df.select(*pick[:2], "distance", *pick[2:])


def spanning_tree(df: DataFrame, id_col: str = "row_id", vec: str = "features",
                  block_rows: int = TREE_ROWS) -> DataFrame:
    """Minimum spanning tree edges (a_id, b_id, distance) of the points; a point whose vector is NULL or holds NULL, NaN or infinity has none.

    Equal points are one, with edges of length 0 to the lowest id. Every point finds its nearest others, and components grow along
    those edges: one takes its shortest known edge if that is no longer than the k-th distance of all its points, beyond which there may be unknown
    ones. Where too few components can, all but the largest look for their nearest point outside, and go on. What is left of the edges
    between components is merged in one task once it is small.
    """
    v = df.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("_v")).where(
        F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    points = written(v.groupBy("_v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("_n")), "tree-points")
    first = points.where("_n > 1").select("_v", F.col("id").alias("a_id"))
    copies = v.join(first, "_v").where(F.col("id") != F.col("a_id")).select("a_id", F.col("id").alias("b_id"), F.lit(0.0).alias("distance"))
    points = points.select("id", "_v")
    n = points.count()
    id_type = v.schema["id"].dataType
    edge = [T.StructField("a_id", id_type), T.StructField("b_id", id_type), T.StructField("distance", T.DoubleType())]
    if n <= block_rows:
        def tree(pdf: pd.DataFrame) -> pd.DataFrame:
            if len(pdf) < 2:
                return pd.DataFrame(columns=["a_id", "b_id", "distance"])
            pdf = pdf.sort_values("id")
            ids = pdf["id"].to_numpy()
            a, b, d = _block_tree(stack(pdf["_v"]))
            return pd.DataFrame({"a_id": ids[np.minimum(a, b)], "b_id": ids[np.maximum(a, b)], "distance": d})

        return points.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(tree, T.StructType(edge)).union(copies)

    near = written(_near_lists(points, n, block_rows), "tree-near")
    beyond = F.when(F.size("near") < TREE_NEAR, F.lit(float("inf"))).otherwise(F.get("near", F.lit(TREE_NEAR - 1))["distance"])
    # c: a point's component; ca, cb: those joined by an edge
    state = near.select("id", F.col("id").alias("c"), beyond.alias("bound"))
    pairs = near.select("id", F.explode("near").alias("m")).select("id", F.col("m.other").alias("other"), F.col("m.distance").alias("distance"))
    live = written(_canonical(pairs, "id", "other", "id", "other").distinct(), "tree-edges")
    picked = [copies]
    while True:
        both = live.select("distance", "a_id", "b_id", "ca", "cb").union(
            live.select("distance", "a_id", "b_id", "cb", "ca"))
        shortest = both.groupBy(F.col("ca").alias("c")).agg(F.min(F.struct("distance", "a_id", "b_id", "cb")).alias("m"))
        parts = state.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("bound").alias("bound")).join(shortest, "c", "left").select(
            "c", "n", "bound", F.col("m.cb").alias("to"), "m.distance", "m.a_id", "m.b_id")
        parts = written(parts.withColumn("sure", F.coalesce(F.col("distance") <= F.col("bound"), F.lit(False))), "tree-picks")
        size = parts.agg(F.count(F.lit(1)).alias("n"), F.count_if("sure").alias("sure"), F.max(F.struct("n", "c")).alias("largest")).first()
        if size["n"] <= 1:
            break
        if size["sure"] and live.count() <= TREE_EDGES:
            sides = [parts.select(F.col("c").alias(c), F.col("bound").alias(b)) for c, b in (("ca", "ba"), ("cb", "bb"))]
            whole = live.join(sides[0], "ca").join(sides[1], "cb")
            schema = T.StructType([*edge, T.StructField("c", id_type), T.StructField("to", id_type)])
            grown = written(whole.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(_grow, schema), "tree-grown")
            picked.append(grown.where(F.col("c").isNull()).select("a_id", "b_id", "distance"))
            link = grown.where(F.col("c").isNotNull()).select("c", "to")
            end = link.agg(F.count(F.lit(1)).alias("n"), F.min("to").alias("low"), F.max("to").alias("high")).first()
            if end["n"] == size["n"] and end["low"] == end["high"]:
                break
        elif 2 * size["sure"] >= size["n"] - 1:
            pick = parts.where("sure")
            picked.append(pick.select("a_id", "b_id", "distance"))
            link = _roots(pick)
        else:
            open_ = parts.where(~F.col("sure") & (F.col("c") != F.lit(size["largest"]["c"]))).select("c", F.col("distance").alias("known"))
            out = written(_outside(points, state, open_, BLOCK_ROWS), "tree-outside")
            if out.isEmpty():  # distances beyond the largest double
                break
            farther = out.select("id", F.col("distance").alias("_d"))
            state = written(state.join(farther, "id", "left").withColumn("bound", F.greatest("bound", "_d")).drop("_d"), "tree-state")
            live = written(live.unionByName(_canonical(out, "id", "other", "c", "co")).distinct(), "tree-edges")
            continue
        now = F.coalesce("to", "c")
        state = written(state.join(link, "c", "left").select("id", now.alias("c"), "bound"), "tree-state")
        for c in ("ca", "cb"):
            live = live.join(link.withColumnRenamed("c", c), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        live = written(live.where(F.col("ca") != F.col("cb")), "tree-edges")
    return reduce(DataFrame.union, picked).distinct()


def n1_boundary(df: DataFrame, id_col: str = "row_id", vec: str = "features", label: str = "label",
                block_rows: int = TREE_ROWS) -> DataFrame:
    """Share of points on a tree edge that joins the two classes."""
    labels = df.select(F.col(id_col).alias("id"), F.col(label).alias("y"))
    edges = spanning_tree(df, id_col, vec, block_rows)
    a = labels.select(F.col("id").alias("a_id"), F.col("y").alias("ya"))
    b = labels.select(F.col("id").alias("b_id"), F.col("y").alias("yb"))
    cross = edges.join(a, "a_id").join(b, "b_id").where(F.col("ya") != F.col("yb"))
    touched = cross.select(F.explode(F.array("a_id", "b_id")).alias("id")).distinct()
    marked = labels.join(touched.withColumn("hit", F.lit(1.0)), "id", "left")
    return marked.agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("n1"))


# ------------------------------------------------------------------ single features


def long_features(df: DataFrame, vec: str = "features", label: str = "label", prefix: str = "f") -> DataFrame:
    """Vector column to (feature, label, value), features named ``f0, f1, ...``."""
    return df.select(F.col(label).alias("label"), F.posexplode(vec).alias("_p", "value")).select(
        F.concat(F.lit(prefix), F.col("_p").cast("string")).alias("feature"), "label",
        F.col("value").cast("double").alias("value"))


def fisher_inverse(long: DataFrame) -> DataFrame:
    """1 / (1 + largest Fisher ratio); a feature without variance counts as ratio 0."""
    pos, neg = F.when(F.col("label") == 1, F.col("value")), F.when(F.col("label") == 0, F.col("value"))
    per = long.groupBy("feature").agg(F.avg(pos).alias("mp"), F.avg(neg).alias("mn"),
                                      F.var_pop(pos).alias("vp"), F.var_pop(neg).alias("vn"))
    gap = F.col("mp") - F.col("mn")
    ratio = F.when(F.col("vp") + F.col("vn") > 0, gap * gap / (F.col("vp") + F.col("vn"))).otherwise(F.lit(0.0))
    return per.agg((F.lit(1.0) / (F.lit(1.0) + F.max(ratio))).alias("f1"))


def univariate_auc_ks(long: DataFrame) -> DataFrame:
    """Per feature the AUC (tied ranks averaged, at least 0.5) and the two-sample KS distance.

    Both come from one running count over distinct values per feature.
    """
    at = long.groupBy("feature", "value").agg(
        F.count_if(F.col("label") == 1).alias("pos_at"), F.count(F.lit(1)).alias("n_at")
    ).withColumn("neg_at", F.col("n_at") - F.col("pos_at"))
    run = running_totals(at, "value", {"pos": "pos_at", "neg": "neg_at"}, ["feature"], cuts=range_cuts(long, "value"))
    both = (F.col("tot_pos") > 0) & (F.col("tot_neg") > 0)
    wins = F.col("pos_at") * (F.col("neg") - F.col("neg_at") / F.lit(2.0))
    gap = F.abs(F.col("pos") / F.col("tot_pos") - F.col("neg") / F.col("tot_neg"))
    raw = run.groupBy("feature").agg(
        F.when(F.first(both), F.sum(wins) / (F.first("tot_pos").cast("double") * F.first("tot_neg"))).alias("_a"),
        F.max(F.when(both, gap)).alias("ks"))
    a = F.coalesce("_a", F.lit(0.5))
    return raw.select("feature", F.greatest(a, F.lit(1.0) - a).alias("auc"), "ks")


def top_features(univariate: DataFrame, m: int = 5) -> DataFrame:
    """The ``m`` best features by AUC, ranked."""
    best = univariate.orderBy(F.desc("auc"), "feature").limit(m)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("auc"), "feature")))


def top_features_text(univariate: DataFrame, m: int = 5) -> DataFrame:
    """The same as one line ``name(auc), ...``."""
    top = top_features(univariate, m)
    entry = F.struct("rank", F.concat("feature", F.lit("("), F.format_string("%.3f", "auc"), F.lit(")")).alias("text"))
    return top.agg(F.array_join(F.sort_array(F.collect_list(entry))["text"], ", ").alias("top_features"))


# ------------------------------------------------------------------ linear overlap


def class_moments(df: DataFrame, vec: str = "features", label: str = "label"):
    """Per class: count, mean and scatter matrix, summed per partition and then by entry.

    Only d*d sums per class reach the driver.
    """
    centre_rows = df.select(F.posexplode(F.col(vec).cast("array<double>")).alias("i", "v")).groupBy("i").agg(
        F.avg("v").alias("m")).collect()
    centre = np.array([r["m"] for r in sorted(centre_rows, key=lambda r: r["i"])])
    d = len(centre)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for y, part in batch.groupby("y"):
                x = stack(part["_v"]) - centre
                total = sums.setdefault(int(y), np.zeros(1 + d + d * d))
                total[0] += len(x)
                total[1:1 + d] += x.sum(0)
                total[1 + d:] += (x.T @ x).ravel()
        for y, total in sums.items():
            yield pd.DataFrame({"y": y, "pos": np.arange(len(total)), "v": total})

    rows = df.select(F.col(label).cast("int").alias("y"), F.col(vec).cast("array<double>").alias("_v"))
    summed = rows.mapInPandas(partial, "y int, pos int, v double").groupBy("y", "pos").agg(F.sum("v").alias("v")).collect()
    out = {}
    for y in {r["y"] for r in summed}:
        flat = np.zeros(1 + d + d * d)
        for r in summed:
            if r["y"] == y:
                flat[r["pos"]] = r["v"]
        mean = flat[1:1 + d] / flat[0]
        scatter = flat[1 + d:].reshape(d, d) - flat[0] * np.outer(mean, mean)
        out[y] = (flat[0], mean + centre, scatter)
    return out


def lda_direction(df: DataFrame, vec: str = "features", label: str = "label") -> list[float]:
    """Two-class discriminant direction, unit within-class deviation, class 1 on the high side."""
    moments = class_moments(df, vec, label)
    (n0, m0, s0), (n1, m1, s1) = moments[0], moments[1]
    within = (s0 + s1) / (n0 + n1 - 2)
    w = np.linalg.lstsq(within, m1 - m0, rcond=None)[0]
    return [float(v) for v in w / max(np.sqrt(w @ within @ w), 1e-300)]


def dot(vec: str, weights: Sequence[float]):
    products = F.zip_with(F.col(vec).cast("array<double>"), F.lit(list(weights)), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def lda_projection(df: DataFrame, vec: str = "features", label: str = "label", out: str = "z") -> DataFrame:
    """The table with its one-dimensional discriminant score."""
    return df.withColumn(out, dot(vec, lda_direction(df, vec, label)))


def overlap_coefficient(df: DataFrame, value: str = "z", label: str = "label", bins: int = OVERLAP_BINS) -> DataFrame:
    """Shared area of the two class densities between the 0.1 and 99.9 percentiles.

    Rows outside the range take no part in the densities; the last bin is closed on the right.
    """
    ends = exact_quantiles(df.select(F.col(value).cast("double").alias("v")), "v", {"lo": 0.001, "hi": 0.999}).first()
    lo, hi = ends["lo"], ends["hi"]
    width = (hi - lo) / bins
    v = F.col(value).cast("double")
    at = F.least(F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
    binned = df.where((v >= lo) & (v <= hi)).groupBy(at.alias("bin")).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    total = W.partitionBy()  # at most `bins` rows by now
    shares = binned.select((F.col("p") / F.sum("p").over(total)).alias("p"), (F.col("n") / F.sum("n").over(total)).alias("n"))
    return shares.agg(F.sum(F.least("p", "n")).alias("overlap"))


# ------------------------------------------------------------------ synthetic geometry


def segment_statistics(points: DataFrame, ends: DataFrame, id_col: str = "row_id", vec: str = "features",
                       by: Sequence[str] = ()) -> DataFrame:
    """How many minority segments the synthetic rows of each ``by`` group use and how far they are from them."""
    by = list(by)
    hits = cut_lineage(nearest_segments(points, ends, id_col, vec, by))  # read three times below
    per = hits.groupBy(*by, "a_id", "b_id").agg(F.count(F.lit(1)).alias("n"))
    used = per.groupBy(*by).agg(F.count(F.lit(1)).alias("n_segments_populated"), F.avg("n").alias("per_segment_mean"),
                                F.max("n").alias("per_segment_max"))
    end_points = per.select(*by, F.explode(F.array("a_id", "b_id")).alias("id")).groupBy(*by).agg(
        F.count_distinct("id").alias("n_distinct_seed_endpoints"))
    n = F.col("n_min")
    out = ends.groupBy(*by).agg(F.count(F.lit(1)).alias("n_min")).select(
        *by, (n * (n - 1) / 2).cast("bigint").alias("n_pairs_possible"))
    residual = exact_quantiles(hits, "residual", {"residual_median": 0.5, "residual_p99": 0.99}, by)
    for part in (used, end_points, residual):
        out = null_safe_join(out, part, by, "left")
    return out


def majority_territory(points: DataFrame, real: DataFrame, id_col: str = "row_id", vec: str = "features",
                       label: str = "label") -> DataFrame:
    """Share of synthetic rows whose nearest real row is a majority row."""
    near = knn_join(points, real, 1, id_col, vec, carry=[label])
    hit = F.col(f"nn_{label}") == 0
    return near.agg(F.count(F.lit(1)).alias("n_synth"), F.count_if(hit).alias("n_nn_majority"),
                    F.avg(hit.cast("double")).alias("frac_nn_majority"))


def worst_client(counts: DataFrame, client: str = "client_id", n_pos: str = "n_pos") -> DataFrame:
    """The client with the fewest positives, lowest id on ties."""
    return counts.agg(F.min(F.struct(n_pos, client)).alias("m")).select(
        F.col(f"m.{client}").alias(client), F.col(f"m.{n_pos}").alias(n_pos))


def lift_over_prevalence(ledger: DataFrame, model: str = "xgb", scheme: str = "centralized",
                         oversampling: str = "none") -> DataFrame:
    """Test average precision over the prevalence floor, one selected run per dataset."""
    chosen = ledger.where((F.col("model") == model) & (F.col("scheme") == scheme)
                          & (F.col("oversampling") == oversampling))
    return chosen.select("dataset", "test_auprc", "baseline_auprc",
                         (F.col("test_auprc") / F.nullif(F.col("baseline_auprc"), F.lit(0.0))).alias("lift"))
