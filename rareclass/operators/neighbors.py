"""Exact nearest-neighbour joins over vector columns.

Both sides are cut into bounded blocks and joined block against block; a task sees at most
``block_rows`` rows of each side (up to eight times as many of a large table) and returns at most ``k`` candidates per query, which a ranked
window merges. Reference rows are grouped around pivots, one per block of rows, and distance bounds decide which groups a chunk of
queries has to visit, so far groups are skipped without changing the result. A group holding most rows is simply split into more blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from rareclass.functions.hashing import hash_text
from rareclass.functions.ranks import null_safe_join
from rareclass.session import cut_lineage, written

BLOCK_ROWS = 4096
SEGMENT_ROWS = 2048
SEGMENT_ENDS = 65_536  # ends of a block: a point is compared with all of them at once, so their pairs cost little
STEP_CELLS = 4_000_000  # distances held at once while rows are compared with pivots
TILE_ROWS, TILE_COLS = 256, 2048  # a tile of single-precision distances stays in a core's cache


def stack(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def distances(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    square = (q * q).sum(1)[:, None] + (r * r).sum(1)[None, :] - 2.0 * (q @ r.T)
    return np.sqrt(np.maximum(square, 0.0))


def nearest_in_block(q: np.ndarray, r: np.ndarray, r_id: np.ndarray, k: int,
                     barred) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, ref row, distance) of the k nearest per query, ties by ref id.

    A matrix product finds every candidate within rounding of the k-th distance; those few get
    their distance from direct differences.
    """
    out_q, out_r, out_d = [], [], []
    k = min(k, len(r))
    r_norm = (r * r).sum(1)
    step = max(1, 2_000_000 // max(1, len(r)))
    for start in range(0, len(q), step):
        part = q[start:start + step]
        norm = (part * part).sum(1)
        square = norm[:, None] + r_norm[None, :] - 2.0 * (part @ r.T)
        mask = barred(start, start + len(part))
        if mask is not None:
            square[mask] = np.inf
        kth = square.min(1) if k == 1 else np.partition(square, k - 1, axis=1)[:, k - 1]
        slack = 1e-9 * (norm + r_norm.max() + 1.0)
        rows, cols = np.nonzero((square <= (kth + slack)[:, None]) & np.isfinite(square))
        exact = np.empty(len(rows))
        for s in range(0, len(rows), 100_000):
            gap = part[rows[s:s + 100_000]] - r[cols[s:s + 100_000]]
            exact[s:s + 100_000] = np.sqrt((gap * gap).sum(1))
        order = np.lexsort((r_id[cols], exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        first = np.searchsorted(rows, rows, side="left")
        keep = np.arange(len(rows)) - first < k
        out_q.append(rows[keep] + start)
        out_r.append(cols[keep])
        out_d.append(exact[keep])
    return np.concatenate(out_q), np.concatenate(out_r), np.concatenate(out_d)


def _nearest_kept(own: np.ndarray, other: np.ndarray, square: np.ndarray, k: int, slack: np.ndarray, gaps) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest ``other`` of each ``own`` among candidates with squared distances known to within half of ``slack``; ties to the lower one."""
    order = np.lexsort((square, own))
    own, other, square = own[order], other[order], square[order]
    first, end = np.searchsorted(own, own, "left"), np.searchsorted(own, own, "right")
    near = square <= square[np.minimum(first + k, end) - 1] + slack[own]
    own, other = own[near], other[near]
    d = gaps(own, other)
    order = np.lexsort((other, d, own))
    own, other, d = own[order], other[order], d[order]
    keep = np.arange(len(own)) - np.searchsorted(own, own, "left") < k
    return own[keep], other[keep], d[keep]


def nearest_of_both(x: np.ndarray, y: np.ndarray, k: int, same: bool = False,
                    most: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """[(row, other row, distance)] of the k nearest rows of ``y`` to every row of ``x``, then of ``x`` to every row of ``y``; ties to the lower row.

    ``most``: for the rows of both, a distance beyond which nothing is wanted (a few such rows may be returned); without it, some rows of the other side give one.
    Each product of matrices serves both sides. It is taken in single precision where the distances that count are far above its
    rounding; what may be among the k by a certain bound of that rounding is measured by direct differences. ``same``: ``y`` is ``x``, there is
    one result and no row is its own neighbour.
    """
    centre = x.mean(0)
    a, b = x - centre, y - centre
    norms = [(z * z).sum(1) for z in (a, b)]
    slack = [4.0 * (x.shape[1] + 4) * (norms[s] + norms[1 - s].max()) for s in (0, 1)]  # in units of rounding
    # some rows bound the k-th distance: more of them cost more products, fewer leave more rows to be measured
    taken = [np.arange(0, len(z), max(1, len(z) // isqrt(20 * k * len(z)))) for z in (a, b)]
    nth = k + same

    def kth(square: np.ndarray) -> np.ndarray:
        return np.partition(square, nth - 1, axis=1)[:, nth - 1] if square.shape[1] >= nth else np.full(len(square), np.inf)

    some = np.arange(0, len(a), max(1, len(a) // 64))
    usual = np.median(kth(distances(a[some], b[taken[1]]) ** 2) if most is None else most[0][some] ** 2)
    single = np.finfo(np.float32).eps
    kind = np.float32 if usual > 64 * single * np.median(slack[0]) and norms[0].max() + norms[1].max() < 1e30 else np.float64
    slack = [z * np.finfo(kind).eps for z in slack]
    left = np.column_stack([-2.0 * a, norms[0], np.ones(len(a))]).astype(kind)
    right = np.column_stack([b, np.ones(len(b)), norms[1]]).astype(kind)
    sides, limits = (left, right), []
    for s in (0, 1)[:1 if same else 2]:
        if most is not None:
            limits.append(most[s] ** 2 + slack[s])
            continue
        other = sides[1 - s][taken[1 - s]].T
        step = max(1, STEP_CELLS // other.shape[1])
        limits.append(np.concatenate([kth(sides[s][i:i + step] @ other) for i in range(0, len(sides[s]), step)]) + slack[s])

    def gaps(i: np.ndarray, j: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.empty(len(i))
        for s in range(0, len(i), 100_000):
            gap = u[i[s:s + 100_000]] - v[j[s:s + 100_000]]
            out[s:s + 100_000] = np.sqrt((gap * gap).sum(1))
        return out

    def merged(held: list, s: int) -> list:
        own, other, square = (np.concatenate(z) for z in zip(*held))
        u, v = (x, y) if s == 0 else (y, x)
        own, other, d = _nearest_kept(own, other, square, k, slack[s], lambda i, j: gaps(i, j, u, v))
        full = np.flatnonzero(np.arange(len(own)) - np.searchsorted(own, own, "left") == k - 1)
        limits[s][own[full]] = np.minimum(limits[s][own[full]], d[full] ** 2 + slack[s][own[full]])
        return [(own, other, d * d)]

    def result(held: list, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own, other, square = merged(held, s)[0] if held else (np.empty(0, int), np.empty(0, int), np.empty(0))
        return own, other, gaps(own, other, *((x, y) if s == 0 else (y, x)))

    limits = [z.astype(kind) for z in limits]
    found, back = [], []
    for top in range(0, len(a), TILE_ROWS):
        held = []
        for at in range(0, len(b), TILE_COLS):
            square = left[top:top + TILE_ROWS] @ right[at:at + TILE_COLS].T
            mask = square <= limits[0][top:top + TILE_ROWS, None]
            if not same:
                mask |= square <= limits[1][None, at:at + TILE_COLS]
            hit = np.flatnonzero(mask)
            i, j = np.divmod(hit, square.shape[1])
            value, i, j = square.ravel()[hit], i + top, j + at
            mine = value <= limits[0][i]
            if same:
                mine &= i != j
            held.append((i[mine], j[mine], value[mine]))
            if sum(len(z[0]) for z in held[1:]) > STEP_CELLS // 4:
                held = merged(held, 0)
            if not same:
                theirs = value <= limits[1][j]
                back.append((j[theirs], i[theirs], value[theirs]))
                if sum(len(z[0]) for z in back[1:]) > STEP_CELLS // 4:
                    back = merged(back, 1)
        found.append(result(held, 0))
    out = [tuple(np.concatenate(z) for z in zip(*found))]
    return out if same else [*out, result(back, 1)]


def _fields(df: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(n, df.schema[n].dataType, True) for n in names]


def _nearest_pivot(v: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cell, rad = np.empty(len(v), dtype=np.int64), np.empty(len(v))
    step = max(1, STEP_CELLS // len(pivots))
    for a in range(0, len(v), step):
        d = distances(v[a:a + step], pivots)
        cell[a:a + step] = d.argmin(1)
        rad[a:a + step] = d.min(1)
    return cell, rad


def _assign(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Nearest pivot and the distance to it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cell, rad = _nearest_pivot(stack(batch["_v"]), pivots)
                yield batch.assign(_cell=cell.astype("int32"), _rad=rad)

    schema = T.StructType([*_fields(df, df.columns), T.StructField("_cell", T.IntegerType()),
                           T.StructField("_rad", T.DoubleType())])
    return df.mapInPandas(run, schema)


def _pivot_bounds(refs: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """Per (group, pivot): nearest and farthest member and the k smallest distances."""
    group = [*by, "_cell"]
    near = refs.withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy("_rad"))).where(F.col("_n") <= k)
    small = near.groupBy(*group).agg(F.sort_array(F.collect_list("_rad")).alias("_small"))
    return refs.groupBy(*group).agg(F.min("_rad").alias("_min"), F.max("_rad").alias("_max")).join(small, group)


def _visits(queries: DataFrame, by: Sequence[str], pivots: np.ndarray, stats: DataFrame, k: int) -> DataFrame:
    """(by, _own, _chunk, _cell): the pivot groups in which a query of a chunk may have a neighbour, by distance bounds.

    Queries of a chunk share their nearest pivot, so they look at much the same groups. A task holds one chunk and a row per group; it returns
    no vectors, the join that follows takes them to the groups.
    """
    task = [*by, "_own", "_chunk"]
    chunks = queries.select(*task).distinct()
    held = chunks.join(stats, list(by)) if by else chunks.crossJoin(stats)

    def visit(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=[*task, "_cell"])
        cells, low, high = (right[c].to_numpy() for c in ("_cell", "_min", "_max"))
        small = np.full((len(right), k), np.inf)
        for i, values in enumerate(right["_small"]):
            small[i, :len(values)] = values
        v, seen = stack(left["_v"]), np.zeros(len(cells), dtype=bool)
        step = max(1, STEP_CELLS // (max(len(pivots), k * len(cells))))
        for a in range(0, len(v), step):
            d = distances(v[a:a + step], pivots)
            dc = d[:, cells]
            upper = np.partition((dc[:, :, None] + small[None]).reshape(len(d), -1), k - 1, axis=1)[:, k - 1]
            own, which = np.unique(d.argmin(1), return_inverse=True)
            gap = distances(pivots[own], pivots[cells])[which]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.where(gap > 0, (dc ** 2 - (d.min(1) ** 2)[:, None]) / (2 * gap), 0.0)
            lower = np.maximum(np.maximum(dc - high, low - dc), plane)
            seen |= (lower <= (upper * (1 + 1e-7) + 1e-7)[:, None]).any(0)
        out = pd.DataFrame({"_cell": cells[seen].astype("int32")})
        return out.assign(**{c: left[c].iloc[0] for c in task})[[*task, "_cell"]]

    schema = T.StructType([*_fields(queries, task), T.StructField("_cell", T.IntegerType())])
    held = held.toDF(*held.columns)
    return queries.select(*task, "_v").groupBy(*task).cogroup(held.groupBy(*task)).applyInPandas(visit, schema)


def _visit_blocks(q: DataFrame, r: DataFrame, by: Sequence[str], pivots: np.ndarray, k: int, rows: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the columns of their tasks: chunks of at most about ``rows`` queries meet blocks of as many references."""
    by = list(by)
    r = cut_lineage(_assign(r, pivots))
    own = _assign(q, pivots).drop("_rad").withColumnRenamed("_cell", "_own")
    own = written(own, "knn-queries")
    many = own.groupBy(*by, "_own").agg(F.ceil(F.count(F.lit(1)) / rows).alias("_chunks"))
    own = own.join(many, [*by, "_own"]).withColumn("_chunk", F.pmod(F.xxhash64("query_id"), F.col("_chunks"))).drop("_chunks")
    visits = written(_visits(own, by, pivots, _pivot_bounds(r.select(*by, "_cell", "_rad"), by, k), k), "knn-visits")
    blocks = r.groupBy(*by, "_cell").agg(F.ceil(F.count(F.lit(1)) / rows).alias("_R"))
    met = visits.join(blocks, [*by, "_cell"])
    left = own.join(met, [*by, "_own", "_chunk"]).withColumn("_rb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_R") - 1))).drop("_R")
    right = r.drop("_rad").join(met, [*by, "_cell"]).withColumn("_rb", F.pmod(F.xxhash64("nn_id"), F.col("_R"))).drop("_R")
    return left, right, [*by, "_cell", "_own", "_chunk", "_rb"]


def pair_blocks(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str,
                block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with block numbers ``_lb``/``_rb``: every left block meets every right block of its
    key exactly once and no block is larger than about ``block_rows``."""
    n_left = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nl"))
    n_right = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nr"))
    grid = n_left.join(n_right, list(keys)).select(
        *keys, F.ceil(F.col("_nl") / block_rows).alias("_L"), F.ceil(F.col("_nr") / block_rows).alias("_R"))

    def place(df: DataFrame, own: str, id_col: str, own_n: str, other: str, other_n: str) -> DataFrame:
        return df.join(grid, list(keys)).withColumn(
            own, F.pmod(F.xxhash64(id_col), F.col(own_n))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other_n) - 1))).drop("_L", "_R")

    return (place(left, "_lb", left_id, "_L", "_rb", "_R"), place(right, "_rb", right_id, "_R", "_lb", "_L"))


def knn_join(queries: DataFrame, refs: DataFrame, k: int, id_col: str = "row_id", vec: str = "features",
             by: Sequence[str] = (), keep: Sequence[str] = (), carry: Sequence[str] = (),
             exclude_self: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """G1: the k nearest reference rows of every query row (Euclidean), ties by reference id.

    ``by`` limits neighbours to rows with equal values; ``keep`` copies query columns, ``carry``
    copies reference columns as ``nn_<col>``; ``exclude_self`` bars the row with the same id.
    Result: (by..., query_id, keep..., nn_rank, nn_id, distance, nn_<carry>...).
    """
    q = queries.select(*by, F.col(id_col).alias("query_id"), F.col(vec).cast("array<double>").alias("_v"), *keep)
    r = refs.select(*by, F.col(id_col).alias("nn_id"), F.col(vec).cast("array<double>").alias("_v"),
                    *[F.col(c).alias(f"nn_{c}") for c in carry])
    # of many equal vectors only the lowest ids can be among k neighbours; the limit is applied before the shuffle
    copies = W.partitionBy(*by, "_h", "_v").orderBy("nn_id")
    r = r.withColumn("_h", F.xxhash64("_v")).withColumn("_n", F.row_number().over(copies)).where(
        F.col("_n") <= (k + 1 if exclude_self else k)).drop("_h", "_n")
    r = cut_lineage(r)  # counted, sampled, bounded and joined below
    n_refs = r.count()
    # blocks grow with the table up to a bound, so that rows meet few of them; pivots are one per block
    rows = max(block_rows, min(8 * block_rows, n_refs // 16))
    width = max(1, min(n_refs // rows, isqrt(n_refs)))
    chosen = r.orderBy(hash_text("pivot", "nn_id"), "nn_id").select("_v").limit(width).collect()
    if width == 1 or not chosen:
        q, r = q.withColumn("_cell", F.lit(0)), r.withColumn("_cell", F.lit(0))
        q, r = pair_blocks(q, r, [*by, "_cell"], "query_id", "nn_id", rows)
        task = [*by, "_cell", "_lb", "_rb"]
    else:
        q, r, task = _visit_blocks(q, r, by, np.array([c["_v"] for c in chosen], dtype=np.float64), k + 1 if exclude_self else k, rows)
    names = [f"nn_{c}" for c in carry]
    keep, by = list(keep), list(by)

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=[*by, "query_id", *keep, "nn_id", "distance", *names])
        q_id, r_id = left["query_id"].to_numpy(), right["nn_id"].to_numpy()
        barred = (lambda a, b: q_id[a:b, None] == r_id[None, :]) if exclude_self else (lambda a, b: None)
        qi, ri, d = nearest_in_block(stack(left["_v"]), stack(right["_v"]), r_id, k, barred)
        out = left[[*by, "query_id", *keep]].iloc[qi].reset_index(drop=True)
        out["nn_id"], out["distance"] = r_id[ri], d
        for n in names:
            out[n] = right[n].to_numpy()[ri]
        return out

    schema = T.StructType([
        *_fields(q, [*by, "query_id", *keep]), *_fields(r, ["nn_id"]), T.StructField("distance", T.DoubleType()),
        *_fields(r, names)])
    r = r.toDF(*r.columns)  # own column ids when both sides come from one table
    found = q.groupBy(*task).cogroup(r.groupBy(*task)).applyInPandas(block, schema)
    rank = F.row_number().over(W.partitionBy(*by, "query_id").orderBy("distance", "nn_id"))
    return found.withColumn("nn_rank", rank).where(F.col("nn_rank") <= k).select(
        *by, "query_id", *keep, "nn_rank", "nn_id", "distance", *names)


def _segment_gaps(x: np.ndarray, v: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of a point from the segments between the rows ``a`` and ``b`` of ``v``; zero-length ones are infinitely far."""
    out = np.full(len(a), np.inf)
    for s in range(0, len(a), 50_000):
        start, along = v[a[s:s + 50_000]], v[b[s:s + 50_000]] - v[a[s:s + 50_000]]
        length, rel = (along * along).sum(1), x - start
        t = np.clip((rel * along).sum(1) / np.where(length > 0, length, 1.0), 0.0, 1.0)
        gap = rel - t[:, None] * along
        out[s:s + 50_000] = np.where(length > 0, np.sqrt((gap * gap).sum(1)), np.inf)
    return out


def _opposite(s: np.ndarray, tol: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs i < j with ``|s_i + s_j| <= tol_i + tol_j``, each at least once; None where there are more than ``most`` to look at.

    Values are sorted once; a value meets those within twice its own tolerance of its opposite, so the wider one of a pair finds it.
    """
    order = np.argsort(s)
    low = np.searchsorted(s[order], -s - 2 * tol, "left")
    count = np.searchsorted(s[order], -s + 2 * tol, "right") - low
    if count.sum() > most:
        return None
    i = np.repeat(np.arange(len(s)), count)
    j = order[np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + low[i]]
    near = (i != j) & (np.abs(s[i] + s[j]) <= tol[i] + tol[j])
    return np.minimum(i, j)[near], np.maximum(i, j)[near]


def _close_opposites(s: np.ndarray, tol: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """As ``_opposite``, for many values with small tolerances: only values whose size comes close to that of another can have an opposite."""
    few = 2.0 * np.median(tol)
    wide = np.flatnonzero(tol > few)
    if len(wide) > 64:
        return _opposite(s, tol, most)
    order = np.argsort(np.abs(s))
    near = np.diff(np.abs(s[order])) <= 2.0 * few
    kept = order[np.append(near, False) | np.append(False, near)]
    kept = kept[tol[kept] <= few]
    found = _opposite(s[kept], tol[kept], most)
    if found is None:
        return None
    i, j = [np.minimum(kept[found[0]], kept[found[1]])], [np.maximum(kept[found[0]], kept[found[1]])]
    for w in wide:
        with_ = np.flatnonzero(np.abs(s + s[w]) <= tol + tol[w])
        with_ = with_[with_ != w]
        i.append(np.minimum(with_, w))
        j.append(np.maximum(with_, w))
    return np.concatenate(i), np.concatenate(j)


def segments_within(x: np.ndarray, most: np.ndarray, v: np.ndarray, owner: np.ndarray, crossing: bool,
                    upto: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first end, second end, distance) of each point's nearest segment no farther than ``most``; infinite where none is.

    ``crossing``: only segments between ends of different ``owner``. Seen from a point at distance d, the ends of a segment lie in opposite
    directions but for asin(d / distance) at either end, so along any one direction the two unit vectors nearly cancel: sorted values find
    the few pairs that can be so near. Where ``most`` rules too little out, or is NULL, all pairs are compared. ``upto``: a segment from i to
    j > i may also start at j where j < upto[i], and does if that rounds to less; its first end is the later one then.
    """
    n = len(v)
    upto = np.arange(n) if upto is None else upto
    best, a_best, b_best = np.full(len(x), np.inf), np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
    axis = np.random.default_rng(n).normal(size=v.shape[1])
    axis /= np.linalg.norm(axis)
    centre = v.mean(0)
    ends, heights, slack = v - centre, (v - centre) @ axis, 1e-14 * v.shape[1]
    step, hard = max(1, STEP_CELLS // n), []
    for start in range(0, len(x), step):
        part = x[start:start + step] - centre
        far = distances(part, ends)
        size = max(1e-300, (part * part).sum(1).max(initial=0.0) + (ends * ends).sum(1).max())
        close = np.nonzero(far * far < 1e-4 * size)
        gap = part[close[0]] - ends[close[1]]
        far[close] = np.sqrt((gap * gap).sum(1))
        for k in range(len(part)):
            at, r, limit = start + k, far[k], most[start + k]
            if not np.isfinite(limit) or not np.isfinite(r).all():
                hard.append(at)
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                sight = np.where(r > 0, np.clip((heights - part[k] @ axis) / r, -1.0, 1.0), 0.0)
                ratio = limit / r
                tol = ratio * (1.0 + ratio * ratio)  # more than the arc sine
                large = np.flatnonzero(~(ratio < 0.5))
                # an end no farther than the limit may be the foot itself and goes with every other one
                tol[large] = np.where(ratio[large] < 0.999, np.arcsin(np.minimum(ratio[large], 1.0)) * (1 + 1e-9), 2.0)
                tol = np.where(tol < 2.0, tol + slack * (size / (r * r) + 1), 2.0)
            extra = _at_an_end(x[at], v, r, owner, crossing)
            if extra is not None:  # every segment of that end is at distance 0: the first one stands for them
                tol[extra[2]], sight[extra[2]] = 0.0, 4.0
            found = _close_opposites(sight, tol, max(STEP_CELLS // 8, 8 * n))
            if found is None:
                hard.append(at)
                continue
            i, j = found
            if extra is not None:
                i, j = np.append(i, extra[0]), np.append(j, extra[1])
            if crossing:
                i, j = (z[owner[i] != owner[j]] for z in (i, j))
            if len(i):
                turned = j < upto[i]
                i, j = np.concatenate([i, j[turned]]), np.concatenate([j, i[turned]])
                d = _segment_gaps(x[at], v, i, j)
                first = np.lexsort((j, i, d))[0]
                if d[first] <= limit:
                    best[at], a_best[at], b_best[at] = d[first], i[first], j[first]
    if hard:
        own = np.array(hard)
        best[own], a_best[own], b_best[own] = _all_segments(x[own], v, owner, crossing, upto)
    return a_best, b_best, best


def _at_an_end(x: np.ndarray, v: np.ndarray, r: np.ndarray, owner: np.ndarray, crossing: bool) -> tuple[int, int, int] | None:
    """(first end, second end, the end at the point) of the first segment of the end that a point lies on."""
    zero = np.flatnonzero(r == 0)
    if len(zero) != 1:
        return None
    own = int(zero[0])
    other = np.flatnonzero(owner != owner[own])[:1] if crossing else np.array([0 if own else 1])
    if not len(other):
        return None
    i, j = min(own, int(other[0])), max(own, int(other[0]))
    return (i, j, own) if _segment_gaps(x, v, np.array([i]), np.array([j]))[0] == 0 else None


def _all_segments(x: np.ndarray, v: np.ndarray, owner: np.ndarray, crossing: bool,
                  upto: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance, first end, second end) of each point's nearest segment of all."""
    best = np.full(len(x), np.inf)
    a_best, b_best = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
    for a in range(len(v)):
        wanted = (owner != owner[a]) if crossing else np.ones(len(v), dtype=bool)
        wanted[:a] &= (a < upto[:a]) if upto is not None else False  # segments that start at their later end
        wanted[a] = False
        others = np.nonzero(wanted)[0]
        along = v[others] - v[a]
        length = (along * along).sum(1)
        others, along, length = others[length > 0], along[length > 0], length[length > 0]
        if not len(others):
            continue
        rel = x - v[a]
        step = max(1, STEP_CELLS // max(1, along.size))
        for s in range(0, len(x), step):
            # summed like the lengths, so that a point on an end is at distance 0 from all its segments
            t = np.clip((rel[s:s + step, None, :] * along[None]).sum(2) / length, 0.0, 1.0)
            gap = rel[s:s + step, None, :] - t[:, :, None] * along[None]
            d = np.sqrt((gap * gap).sum(2))
            at = d.argmin(1)
            low = d[np.arange(len(d)), at]
            better = low < best[s:s + step]
            idx = np.nonzero(better)[0] + s
            best[idx], a_best[idx], b_best[idx] = low[better], a, others[at[better]]
    return best, a_best, b_best


def _shortest_around(x: np.ndarray, v: np.ndarray, around: int = 6) -> np.ndarray:
    """Distance of each point from the nearest segment between two of the ends next to it."""
    out = np.full(len(x), np.inf)
    around = min(around, len(v))
    i, j = np.triu_indices(around, 1)
    step = max(1, STEP_CELLS // len(v))
    for start in range(0, len(x), step):
        near = np.argpartition(distances(x[start:start + step], v), around - 1, axis=1)[:, :around]
        for k, own in enumerate(near):
            out[start + k] = _segment_gaps(x[start + k], v, own[i], own[j]).min(initial=np.inf)
    return out


def nearest_segments(points: DataFrame, ends: DataFrame, id_col: str = "row_id", vec: str = "features",
                     by: Sequence[str] = (), block_rows: int = SEGMENT_ROWS, end_rows: int = SEGMENT_ENDS) -> DataFrame:
    """For each point the nearest segment between two ``ends`` rows of the same ``by`` group.

    Point-to-segment distance with the foot clipped to the segment; zero-length pairs are ignored and
    the pair first in (a, b) id order wins a tie. Tasks see one block of points and two of ends (one, where a group has no more than ``end_rows``)
    and return one segment per point; no pair of ends is ever written out. Equal ends are one. Points on a segment but for rounding are found first,
    in time that grows with the ends, not with their pairs; the others follow with the distance of a segment next to them as their limit.
    """
    by = list(by)
    p = points.select(*by, F.col(id_col).alias("point_id"), F.col(vec).cast("array<double>").alias("_v"))
    p = written(p.withColumn("_most", F.lit(1e-7) * F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x))), "segment-points")
    every = ends.select(*by, F.col(id_col).alias("end_id"), F.col(vec).cast("array<double>").alias("_v"))
    e = written(every.groupBy(*by, "_v").agg(F.min("end_id").alias("end_id"), F.max("end_id").alias("_last")), "segment-ends")
    first = F.min(F.struct("residual", "a_id", "b_id")).alias("_m")
    best = written(_segments_of(p, e, by, block_rows, end_rows).groupBy(*by, "point_id").agg(first), "segments-best")
    open_ = null_safe_join(p.drop("_most"), best.withColumn("_done", F.lit(True)).drop("_m"), [*by, "point_id"], "left").where(F.col("_done").isNull()).drop("_done")
    open_ = written(open_, "segments-open")
    if not open_.isEmpty():
        # a point without any row has only ends it cannot be measured from; it has no limit
        around = _segments_of(open_.withColumn("_most", F.lit(0.0)), e, by, block_rows, end_rows, around=True)
        around = around.groupBy(*by, "point_id").agg((F.min("residual") * (1 + 1e-9)).alias("_most"))
        open_ = written(null_safe_join(open_, around, [*by, "point_id"], "left"), "segments-limits")
        best = best.unionByName(_segments_of(open_, e, by, block_rows, end_rows).groupBy(*by, "point_id").agg(first))
    best = best.select(*by, "point_id", "_m.a_id", "_m.b_id", "_m.residual")
    copied = e.where(F.col("_last") > F.col("end_id"))
    if copied.isEmpty():
        return best
    # a segment that starts at its later end goes to the first copy of the other behind that one
    best = written(best, "segments-named")
    turned = best.where(F.col("a_id") > F.col("b_id"))
    copies = null_safe_join(every, copied.select(*by, "_v", F.col("end_id").alias("b_id")), [*by, "_v"], "inner").select(*by, "b_id", F.col("end_id").alias("_copy"))
    named = null_safe_join(turned, copies, [*by, "b_id"], "inner").where(F.col("_copy") > F.col("a_id")).groupBy(
        *by, "point_id", "a_id", "residual").agg(F.min("_copy").alias("b_id"))
    return best.where(F.col("a_id") < F.col("b_id")).unionByName(named.select(*by, "point_id", "a_id", "b_id", "residual"))


def _segments_of(p: DataFrame, e: DataFrame, by: list[str], block_rows: int, end_rows: int, around: bool = False) -> DataFrame:
    """(by, point_id, a_id, b_id, residual): a row per point and pair of blocks that holds a segment within the point's ``_most``; with
    ``around``, one per point and block, whose residual is that of some segment and which has no ids."""
    counts = e.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / end_rows).alias("_E"))
    n_points = p.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("_P"))
    if by:
        grid = counts.join(n_points, by)
    else:
        grid = counts.withColumn("_k", F.lit(1)).join(n_points.withColumn("_k", F.lit(1)), "_k").drop("_k")
    one = [*by] if by else ["_one"]
    if not by:
        p, e, grid = (d.withColumn("_one", F.lit(0)) for d in (p, e, grid))

    def numbers(n: str):
        return F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)

    placed_p = (p.join(grid, one).withColumn("_pb", F.pmod(F.xxhash64("point_id"), F.col("_P")))
                .withColumn("_i", F.explode(numbers("_E")))
                .withColumn("_j", F.explode(F.sequence(F.col("_i"), F.col("_i") if around else F.col("_E") - 1))))
    # an end of block b takes part in every block pair (i <= j) that contains b
    mine = F.pmod(F.xxhash64("end_id"), F.col("_E"))
    placed_e = (e.join(grid, one).withColumn("_b", mine)
                .withColumn("_o", F.explode(F.array("_b") if around else numbers("_E")))
                .withColumn("_i", F.least("_b", "_o")).withColumn("_j", F.greatest("_b", "_o"))
                .withColumn("_pb", F.explode(numbers("_P"))))

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cols = [*by, "point_id", "a_id", "b_id", "residual"]
        if not len(left) or len(right) < 2:
            return pd.DataFrame(columns=cols)
        i, j = right["_i"].iloc[0], right["_j"].iloc[0]
        right = right.sort_values("end_id")
        ids, owner, v = right["end_id"].to_numpy(), right["_b"].to_numpy(), stack(right["_v"])
        x = stack(left["_v"])
        if around:
            out = left[[*by, "point_id"]].reset_index(drop=True)
            out["a_id"], out["b_id"], out["residual"] = None, None, _shortest_around(x, v)
            return out[np.isfinite(out["residual"])]
        upto = np.searchsorted(ids, right["_last"].to_numpy(), "left")
        a, b, best = segments_within(x, left["_most"].to_numpy(dtype=np.float64), v, owner, i != j, upto)
        found = np.isfinite(best)
        out = left[[*by, "point_id"]][found].reset_index(drop=True)
        out["a_id"], out["b_id"], out["residual"] = ids[a[found]], ids[b[found]], best[found]
        return out

    id_type = e.schema["end_id"].dataType
    schema = T.StructType([*_fields(p, [*by, "point_id"]), T.StructField("a_id", id_type),
                           T.StructField("b_id", id_type), T.StructField("residual", T.DoubleType())])
    task = [*one, "_pb", "_i", "_j"]
    placed_e = placed_e.toDF(*placed_e.columns)
    return placed_p.groupBy(*task).cogroup(placed_e.groupBy(*task)).applyInPandas(block, schema)
