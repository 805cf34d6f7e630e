"""Boosted trees of all clients at once, and trees as flat arrays scored in one pass.

Features are cut into bins by exact quantiles. A level of a tree needs sums of gradients per (client, node, feature, bin) only; they are whole
numbers, so the trees are the same however rows are split into tasks. Clients whose rows fit one task are grown there, all in one
job; for the others every level is one job over all of them, in which tasks return sums and grouped tasks pick the splits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rareclass.functions.ranks import range_cuts, running_totals, shuffle_width
from rareclass.session import cut_lineage, written

#: Gradients are counted in this part of one.
SCALE = 1 << 24
FLAT = "tree int, feature array<int>, cut array<double>, value array<double>"
BLOCK = "code binary, y binary, bins binary, key binary, margin binary"


class Settings(NamedTuple):
    trees: int = 100
    rate: float = 0.1
    depth: int = 6
    subsample: float = 1.0
    seed: int = 42
    bins: int = 64
    penalty: float = 1.0
    least: float = 1.0


class Trees(NamedTuple):
    """Trees as flat arrays (trees, slots): the children of slot i are 2i + 1 (below the cut) and 2i + 2; feature -1 marks a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray


# ---------------------------------------------------------------- bins


def cut_points(df: DataFrame, vec: str = "features", bins: int = 64) -> list[np.ndarray]:
    """Per feature the values at which a new bin begins, at most ``bins`` - 1.

    Up to ``bins`` distinct values have a bin each; beyond that bins hold about equal numbers of rows. The ranks are exact and equal
    values are merged first; only the cuts reach the driver.
    """
    width = len(df.select(vec).first()[0])
    long = df.select(F.posexplode(F.col(vec).cast("array<double>")).alias("feature", "value")).where(F.col("value").isNotNull() & ~F.isnan("value"))
    counted = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1))
    ranked = running_totals(counted, "value", {"_cum": "_n", "_idx": "_one"}, ["feature"], cuts=range_cuts(long, "value"))
    number = F.when(F.col("tot__idx") <= bins, F.col("_idx") - 1).otherwise(F.floor((F.col("_cum") - F.col("_n")) * bins / F.col("tot__cum")))
    starts = ranked.groupBy("feature", number.alias("bin")).agg(F.min("value").alias("start")).collect()
    return [np.array(sorted(r["start"] for r in starts if r["feature"] == j)[1:]) for j in range(width)]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin of every value: how many cuts are at or below it; missing values come after all cuts."""
    return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)], axis=1).astype(np.uint16)


def _matrix(lists: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


# ---------------------------------------------------------------- growing


class Growth(NamedTuple):
    """One tree per client while it grows, (clients, slots): a leaf has feature -1; g and h are its sums."""

    feature: np.ndarray
    bin: np.ndarray
    g: np.ndarray
    h: np.ndarray

    @staticmethod
    def start(clients: int, depth: int) -> Growth:
        slots = (2 << depth) - 1
        return Growth(np.full((clients, slots), -1, np.int32), np.zeros((clients, slots), np.int32), np.zeros((clients, slots), np.int64), np.zeros((clients, slots), np.int64))

    def add(self, code: int, slot: int, feature: int, bin_: int, sums: Sequence[int]) -> None:
        """Record a node's sums and, when it is split, its split and those of its children."""
        g, h, gl, hl = sums
        self.g[code, slot], self.h[code, slot] = g, h
        if feature >= 0:
            self.feature[code, slot], self.bin[code, slot] = feature, bin_
            self.g[code, 2 * slot + 1], self.h[code, 2 * slot + 1] = gl, hl
            self.g[code, 2 * slot + 2], self.h[code, 2 * slot + 2] = g - gl, h - hl

    def values(self, s: Settings) -> np.ndarray:
        """What each slot adds to the margin; slots that are no leaves are never read."""
        return -s.rate * (self.g / SCALE) / (self.h / SCALE + s.penalty)


def drawn(keys: np.ndarray, tree: int, s: Settings) -> np.ndarray:
    """Which rows a tree sees: a hash of the row's key, the tree and the seed."""
    if s.subsample >= 1:
        return np.ones(len(keys), dtype=bool)
    x = keys ^ np.uint64((tree + 1) * 0x9E3779B97F4A7C15 + s.seed & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(np.float64) < s.subsample * 2.0**53


def gradients(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700)))
    return np.rint((p - y) * SCALE), np.rint(p * (1 - p) * SCALE)


def step(bins: np.ndarray, code: np.ndarray, slot: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Rows one level down; rows in a leaf stay."""
    f = feature[code, slot]
    right = bins[np.arange(len(bins)), np.maximum(f, 0)] > cut[code, slot]
    return np.where(f >= 0, 2 * slot + 1 + right, slot)


def histograms(bins: np.ndarray, group: np.ndarray, g: np.ndarray, h: np.ndarray, groups: int, width: int) -> np.ndarray:
    """(groups, 2, features, width): sums of g and h. Whole numbers below 2^53, so the floating sums are exact."""
    d = bins.shape[1]
    out = np.empty((groups, 2, d, width))
    for j in range(d):
        key = group * width + bins[:, j]
        for k, values in enumerate((g, h)):
            out[:, k, j] = np.bincount(key, values, groups * width).reshape(groups, width)
    return out.astype(np.int64)


def choose(hist: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, bin, sums) per group: the split with the highest gain, lowest feature then bin on ties; -1 where none gains.

    ``sums`` are g and h of the node and of its lower child.
    """
    n, _, d, width = hist.shape
    whole = hist[:, :, 0].sum(axis=2)
    left = np.cumsum(hist, axis=3)[..., :-1]
    right = whole[:, :, None, None] - left

    def worth(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return (g / SCALE) ** 2 / (h / SCALE + s.penalty)

    gain = worth(left[:, 0], left[:, 1]) + worth(right[:, 0], right[:, 1]) - worth(whole[:, 0], whole[:, 1])[:, None, None]
    enough = (left[:, 1] >= s.least * SCALE) & (right[:, 1] >= s.least * SCALE)
    gain = np.where(enough, gain, -np.inf).reshape(n, -1)
    best = gain.argmax(axis=1) if gain.shape[1] else np.zeros(n, dtype=np.int64)
    some = gain[np.arange(n), best] > 1e-9 if gain.shape[1] else np.zeros(n, dtype=bool)
    feature, bin_ = best // max(1, width - 1), best % max(1, width - 1)
    sums = np.stack([whole[:, 0], whole[:, 1], left[np.arange(n), 0, feature, bin_], left[np.arange(n), 1, feature, bin_]], axis=1) \
        if gain.shape[1] else np.concatenate([whole, whole], axis=1)
    return np.where(some, feature, -1), bin_, sums


def grow_alone(bins: np.ndarray, y: np.ndarray, keys: np.ndarray, width: int, s: Settings, times: np.ndarray | None = None) -> list[Growth]:
    """All trees of one client whose rows are in this task.

    ``times``: how many equal rows each stands for, as one number or, where trees draw rows, as the number that each tree sees.
    """
    code, margin, out = np.zeros(len(y), dtype=np.int64), np.zeros(len(y)), []
    for t in range(s.trees):
        tree, slot = Growth.start(1, s.depth), np.zeros(len(y), dtype=np.int64)
        g, h = gradients(margin, y)
        if times is None:
            seen = drawn(keys, t, s)
        else:
            many = times[:, t] if times.ndim == 2 else times
            g, h, seen = g * many, h * many, many > 0
        for level in range(s.depth):
            first = (1 << level) - 1
            rows = np.flatnonzero(seen & (slot >= first))
            if not len(rows):
                break
            places, group = np.unique(slot[rows], return_inverse=True)
            found = choose(histograms(bins[rows], group, g[rows], h[rows], len(places), width), s)
            for place, feature, bin_, sums in zip(places.tolist(), *(x.tolist() for x in found), strict=True):
                tree.add(0, place, feature, bin_, sums)
            slot = step(bins, code, slot, tree.feature, tree.bin)
        margin = margin + tree.values(s)[0, slot]
        out.append(tree)
    return out


def _flat_rows(trees: list[Growth], code: int, cuts: list[np.ndarray], s: Settings) -> list[tuple]:
    """(tree, feature, cut, value) of one client's trees."""
    longest = max([1, *(len(c) for c in cuts)])
    table = np.zeros((len(cuts), longest))
    for j, c in enumerate(cuts):
        table[j, :len(c)] = c
    return [(t, tree.feature[code].tolist(), np.where(tree.feature[code] >= 0, table[np.maximum(tree.feature[code], 0), np.minimum(tree.bin[code], longest - 1)], 0.0).tolist(),
             tree.values(s)[code].tolist()) for t, tree in enumerate(trees)]


def fit_forest(df: DataFrame, client: str = "client_id", vec: str = "features", label: str = "label", row_id: str | None = None,
               settings: Settings | None = None, task_cells: int = 1 << 22, group: int = 64, store_every: int = 10) -> DataFrame:
    """One booster per client from scratch, as rows (client, tree, feature, cut, value); one-class clients have none.

    Rows of a client with equal bins and label go the same way in every tree, so one of them stands for all, with the number of them; where trees draw
    rows, with the number that each tree draws. A client with at most ``task_cells`` feature values (or draw counts) is grown inside one task. Larger ones,
    ``group`` of them together, take one job per level; margins are written every ``store_every`` trees and the trees since then run again in each job.
    All ways give the same trees.
    ``row_id`` decides which rows a subsampled tree sees (else a hash of the row, which equal rows share). Rows without a label or a client
    are left out.
    """
    s = settings or Settings()
    key = F.xxhash64(row_id) if row_id else F.xxhash64(client, vec, label)
    rows = cut_lineage(df.where(F.col(label).isNotNull() & F.col(client).isNotNull()).select(
        client, F.col(vec).cast("array<double>").alias("_x"), F.col(label).cast("double").alias("_y"), key.alias("_key")))
    kind = rows.schema[client].dataType.simpleString()
    schema = f"`{client}` {kind}, {FLAT}"
    if rows.isEmpty():
        return df.sparkSession.createDataFrame([], schema)
    cuts = cut_points(rows, "_x", s.bins)
    width, d = max(len(c) for c in cuts) + 1, len(cuts)
    sizes = rows.groupBy(client).agg(F.count(F.lit(1)).alias("_rows"), (F.min("_y") != F.max("_y")).alias("_two")).where("_two")

    def alone(table: pa.Table) -> pa.Table:
        bins = binned(_matrix(table.column("_x"), d), cuts)
        trees = grow_alone(bins, table.column("_y").to_numpy(), table.column("_key").to_numpy().view(np.uint64), width, s)
        return _table([table.column(client)[0].as_py()] * len(trees), _flat_rows(trees, 0, cuts, s), table.schema.field(client))

    def merged(table: pa.Table) -> pa.Table:
        bins = np.frombuffer(b"".join(table.column("_bins").to_pylist()), "<u2").reshape(-1, d)
        y = table.column("_y").to_numpy()
        times = table.column("_times").to_numpy().astype(np.float64) if s.subsample >= 1 \
            else np.frombuffer(b"".join(table.column("_draws").to_pylist()), "<i8").reshape(len(y), -1).astype(np.float64)
        trees = grow_alone(bins, y, np.zeros(len(y), np.uint64), width, s, times)
        return _table([table.column(client)[0].as_py()] * len(trees), _flat_rows(trees, 0, cuts, s), table.schema.field(client))

    kinds = written(_counted(rows.join(sizes.select(client), client), client, cuts, d), "boosting-kinds")
    number = kinds.groupBy(client).agg(F.count(F.lit(1)).alias("_kinds"))
    held, fits = F.col("_kinds") * (d if s.subsample >= 1 else max(d, s.trees)), F.col("_rows") * d <= task_cells
    # counting draws pays where a row stands for many, or where the rows are too many for a task
    merge = (held <= task_cells) if s.subsample >= 1 else (held <= task_cells) & ((F.col("_kinds") * 2 <= F.col("_rows")) | ~fits)
    sizes = written(sizes.join(number, client).select(client, F.when(merge, "merged").when(fits & F.lit(s.subsample < 1), "alone").otherwise("large").alias("_way")), "boosting-ways")
    # a task per client, few bytes as they are: they take long to grow
    width_ = shuffle_width(rows)
    few = sizes.where("_way = 'merged'").select(client)
    source = kinds.join(few, client) if s.subsample >= 1 else _drawn_counts(rows.join(few, client), client, cuts, d, s)
    forest = source.repartition(width_, client).groupBy(client).applyInArrow(merged, schema)
    if s.subsample < 1:
        own = rows.join(sizes.where("_way = 'alone'").select(client), client)
        forest = forest.unionByName(own.repartition(width_, client).groupBy(client).applyInArrow(alone, schema))
    # at most all cells / task_cells of them
    large = sorted(r[client] for r in sizes.where("_way = 'large'").collect())
    for a in range(0, len(large), group):
        forest = forest.unionByName(_grow_together(rows, large[a:a + group], client, schema, cuts, width, s, store_every))
    return cut_lineage(forest)


def _counted(rows: DataFrame, client: str, cuts: list[np.ndarray], d: int) -> DataFrame:
    """(client, _bins, _y, _times): how many rows of a client have the same bins and label."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins = np.ascontiguousarray(binned(_matrix(batch.column("_x"), d), cuts).astype("<u2"))
                whole = pa.array([b.tobytes() for b in bins], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(client), whole, batch.column("_y")], names=[client, "_bins", "_y"])

    kind = rows.schema[client].dataType.simpleString()
    each = rows.select(client, "_x", "_y").mapInArrow(run, f"`{client}` {kind}, _bins binary, _y double")
    return each.groupBy(client, "_bins", "_y").agg(F.count(F.lit(1)).alias("_times"))


def _drawn_counts(rows: DataFrame, client: str, cuts: list[np.ndarray], d: int, s: Settings, flush: int = 1 << 18, cells: int = 64) -> DataFrame:
    """(client, _bins, _y, _draws): how many rows of a client with the same bins and label each tree draws, as packed whole numbers.

    Tasks count ``flush`` rows at a time; counts of a client are then added up in ``cells`` parts, so no task sees them once per task.
    """
    kind = rows.schema[client].dataType.simpleString()

    def counted(codes: np.ndarray, bins: np.ndarray, y: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of one row of each kind, counts of (kinds, trees))."""
        whole = np.ascontiguousarray(np.column_stack([codes.astype("<i8").view("<u2").reshape(len(y), 4), bins, y.astype("<f8").view("<u2").reshape(len(y), 4)]))
        _, first, at = np.unique(whole.view(f"V{whole.shape[1] * 2}").ravel(), return_index=True, return_inverse=True)
        return first, np.stack([np.bincount(at, drawn(keys, t, s), len(first)) for t in range(s.trees)], axis=1).astype("<i8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict = {}
        waiting: list[tuple[np.ndarray, ...]] = []

        def out() -> pa.RecordBatch:
            codes, bins, y, keys = (np.concatenate(x) for x in zip(*waiting, strict=True))
            first, draws = counted(codes, bins, y, keys)
            own = list(names)
            return pa.RecordBatch.from_arrays([
                pa.array([own[c] for c in codes[first].tolist()], arrow), pa.array([b.tobytes() for b in bins[first]], pa.binary()), pa.array(y[first]),
                pa.array([v.tobytes() for v in draws], pa.binary())], names=[client, "_bins", "_y", "_draws"])

        for batch in batches:
            if batch.num_rows:
                codes = np.array([names.setdefault(c, len(names)) for c in batch.column(client).to_pylist()], np.int64)
                waiting.append((codes, binned(_matrix(batch.column("_x"), d), cuts).astype("<u2"), batch.column("_y").to_numpy(), batch.column("_key").to_numpy().view(np.uint64)))
            if sum(len(w[0]) for w in waiting) >= flush:
                yield out()
                waiting.clear()
        if waiting:
            yield out()

    def added(table: pa.Table) -> pa.Table:
        bins, y, draws = (table.column(c).to_pylist() for c in ("_bins", "_y", "_draws"))
        sums: dict[tuple, np.ndarray] = {}
        for place, v in zip(zip(bins, y, strict=True), draws, strict=True):
            v = np.frombuffer(v, "<i8")
            sums[place] = sums[place] + v if place in sums else v
        return pa.table([pa.array([table.column(client)[0].as_py()] * len(sums), arrow), pa.array([b for b, _ in sums], pa.binary()), pa.array([v for _, v in sums], pa.float64()),
                         pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=[client, "_bins", "_y", "_draws"])

    arrow, schema = to_arrow_type(rows.schema[client].dataType), f"`{client}` {kind}, _bins binary, _y double, _draws binary"
    return rows.select(client, "_x", "_y", "_key").mapInArrow(run, schema).withColumn("_cell", F.pmod(F.xxhash64("_bins"), F.lit(cells))) \
        .groupBy(client, "_cell").applyInArrow(added, schema)


def _table(clients: list, rows: list[tuple], field: pa.Field) -> pa.Table:
    return pa.table([pa.array(clients, field.type), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.int32())),
                     pa.array([r[2] for r in rows], pa.list_(pa.float64())), pa.array([r[3] for r in rows], pa.list_(pa.float64()))],
                    names=[field.name, "tree", "feature", "cut", "value"])


def _grow_together(rows: DataFrame, clients: list, client: str, schema: str, cuts: list[np.ndarray], width: int, s: Settings, store_every: int) -> DataFrame:
    """Trees of clients too large for a task, level by level for all of them in one job."""
    spark, d = rows.sparkSession, len(cuts)
    place = {c: i for i, c in enumerate(clients)}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.array([place[c] for c in batch.column(client).to_pylist()], dtype="<i4")
            if len(code):
                bins = binned(_matrix(batch.column("_x"), d), cuts)
                yield _block(code, batch.column("_y").to_numpy(), bins, batch.column("_key").to_numpy().view(np.uint64), np.zeros(len(code)))

    blocks = cut_lineage(rows.where(F.col(client).isin(clients)).mapInArrow(pack, BLOCK))
    trees: list[Growth] = []
    stored = 0
    for t in range(s.trees):
        tree = Growth.start(len(clients), s.depth)
        for level in range(s.depth):
            found = _level(blocks, trees[stored:], tree, t, level, width, s).collect()  # one row per open node
            for r in found:
                tree.add(r["code"], r["slot"], r["feature"], r["bin"], (r["g"], r["h"], r["gl"], r["hl"]))
            if all(r["feature"] < 0 for r in found):
                break
        trees.append(tree)
        if len(trees) - stored == store_every and t + 1 < s.trees:
            blocks, stored = cut_lineage(_with_margins(blocks, trees[stored:], s)), len(trees)
    flat = [(c, *row) for c in clients for row in _flat_rows(trees, place[c], cuts, s)]
    return spark.createDataFrame(flat, schema)


def _block(code: np.ndarray, y: np.ndarray, bins: np.ndarray, key: np.ndarray, margin: np.ndarray) -> pa.RecordBatch:
    cells = (code.astype("<i4"), y.astype("<f8"), bins.astype("<u2"), key.astype("<u8"), margin.astype("<f8"))
    return pa.RecordBatch.from_arrays([pa.array([c.tobytes()]) for c in cells], names=[f.split()[0] for f in BLOCK.split(", ")])


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    for cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        code, y, bins, key, margin = (np.frombuffer(c, k) for c, k in zip(cells, ("<i4", "<f8", "<u2", "<u8", "<f8"), strict=True))
        yield code, y, bins.reshape(len(code), -1), key, margin


def _advanced(code: np.ndarray, bins: np.ndarray, margin: np.ndarray, trees: list[Growth], s: Settings) -> np.ndarray:
    for tree in trees:
        slot = np.zeros(len(code), dtype=np.int64)
        for _ in range(s.depth):
            slot = step(bins, code, slot, tree.feature, tree.bin)
        margin = margin + tree.values(s)[code, slot]
    return margin


def _with_margins(blocks: DataFrame, trees: list[Growth], s: Settings) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for code, y, bins, key, margin in _opened(batch):
                yield _block(code, y, bins, key, _advanced(code, bins, margin, trees, s))
    return blocks.mapInArrow(run, BLOCK)


def _level(blocks: DataFrame, trees: list[Growth], tree: Growth, number: int, level: int, width: int, s: Settings) -> DataFrame:
    """(code, slot, feature, bin, g, h, gl, hl) for every open node of a level: one job, one shuffle of one histogram per task and node."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for code, y, bins, key, margin in _opened(batch):
                margin = _advanced(code, bins, margin, trees, s)
                slot = np.zeros(len(code), dtype=np.int64)
                for _ in range(level):
                    slot = step(bins, code, slot, tree.feature, tree.bin)
                at = np.flatnonzero(drawn(key, number, s) & (slot >= (1 << level) - 1))
                if not len(at):
                    continue
                g, h = gradients(margin[at], y[at])
                nodes, group = np.unique(code[at].astype(np.int64) << 32 | slot[at], return_inverse=True)
                for node, hist in zip(nodes.tolist(), histograms(bins[at], group, g, h, len(nodes), width), strict=True):
                    where = node >> 32, node & 0xFFFFFFFF
                    held[where] = held[where] + hist if where in held else hist
        for (code_, slot_), hist in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([code_], pa.int32()), pa.array([slot_], pa.int32()), pa.array([hist.astype("<i8").tobytes()])],
                                             names=["code", "slot", "hist"])

    def pick(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<i8") for x in table.column("hist").to_pylist())
        feature, bin_, found = choose(total.reshape(1, 2, -1, width), s)
        return pa.table({"code": table.column("code")[:1], "slot": table.column("slot")[:1], "feature": feature.astype(np.int32), "bin": bin_.astype(np.int32),
                         "g": found[:, 0], "h": found[:, 1], "gl": found[:, 2], "hl": found[:, 3]})

    return blocks.mapInArrow(sums, "code int, slot int, hist binary").groupBy("code", "slot") \
        .applyInArrow(pick, "code int, slot int, feature int, bin int, g long, h long, gl long, hl long")


# ---------------------------------------------------------------- scoring


def load(forest: DataFrame, client: str = "client_id") -> dict:
    """The trees of each client as arrays. A client's trees take about 20 bytes a slot; take clients in groups where there are many."""
    found: dict = {}
    for r in forest.orderBy(client, "tree").toLocalIterator():
        found.setdefault(r[client], []).append((r["feature"], r["cut"], r["value"]))
    return {c: Trees(*(np.array(x) for x in zip(*own, strict=True))) for c, own in found.items()}


def leaf_values(x: np.ndarray, trees: Trees) -> np.ndarray:
    """(rows, trees): what each tree adds; all trees step down together. Missing values go to the upper child."""
    rows, tree = np.arange(len(x))[:, None], np.arange(len(trees.feature))
    slot = np.zeros((len(x), len(tree)), dtype=np.int64)
    for _ in range((trees.feature.shape[1] + 1).bit_length() - 2):
        f = trees.feature[tree, slot]
        upper = ~(x[rows, np.maximum(f, 0)] < trees.cut[tree, slot])
        slot = np.where(f >= 0, 2 * slot + 1 + upper, slot)
    return trees.value[tree, slot]


def _pieces(batch: pa.RecordBatch, vec: str, trees: int) -> Iterator[tuple[int, np.ndarray]]:
    x = batch.column(vec)
    width = len(x[0]) if len(x) else 0
    size = max(1, (1 << 20) // max(1, trees))
    for a in range(0, len(x), size):
        yield a, _matrix(x.slice(a, size), width)


def tree_margins(forest: DataFrame, clients: Sequence, df: DataFrame, trees: int | None = None, client: str = "client_id", vec: str = "features",
                 out: str = "margins") -> DataFrame:
    """One margin per (client, tree), blocks in client order; a client without trees gets those of the first client that has some.

    One pass over the rows, whatever the number of trees.
    """
    loaded = load(forest.where(F.col(client).isin(list(clients))), client)
    fallback = loaded[next(c for c in clients if c in loaded)]
    blocks = [Trees(*(a[:trees] for a in loaded.get(c, fallback))) for c in clients]
    whole = Trees(*(np.concatenate(x) for x in zip(*blocks, strict=True)))
    source, names = df.withColumn("_x", F.col(vec).cast("array<double>")), [*df.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, x in _pieces(batch, "_x", len(whole.feature)):
                values = leaf_values(x, whole)
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * values.shape[1])
                yield pa.RecordBatch.from_arrays([*batch.slice(a, len(x)).columns[:-1], pa.ListArray.from_arrays(ends, pa.array(values.ravel()))],
                                                 names=names)

    return source.mapInArrow(run, df.withColumn(out, F.lit(None).cast("array<double>")).schema)


def stacked_kinds(forest: DataFrame, clients: Sequence, df: DataFrame, trees: int | None = None, client: str = "client_id", vec: str = "features",
                  label: str = "label", out: str = "stack") -> DataFrame:
    """R16 for fitting: (client, label, out, times), the margins of :func:`tree_margins` once for all rows of a client and label that share them.

    Rows between the same cuts of all trees take the same ways. They are counted by these places, and a place's margins come from its lower ends;
    so there are no more rows than places, however long the table.
    """
    used = forest.select(F.explode(F.arrays_zip("feature", "cut")).alias("_s")).select("_s.feature", "_s.cut").where("feature >= 0").distinct().collect()
    d = len(df.select(vec).first()[0])
    cuts = [np.array(sorted({r["cut"] for r in used if r["feature"] == j})) for j in range(d)]
    ends = [np.concatenate([[-np.inf], c]) for c in cuts]
    rows = df.where(F.col(label).isNotNull() & F.col(client).isNotNull()).select(client, F.col(vec).cast("array<double>").alias("_x"), F.col(label).cast("double").alias("_y"))
    counted = written(_counted(rows, client, cuts, d), "stack-kinds")

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.frombuffer(b"".join(batch.column("_bins").to_pylist()), "<u2").reshape(-1, d)
            x = np.column_stack([e[bins[:, j]] for j, e in enumerate(ends)])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * d), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(client), batch.column("_y"), batch.column("_times"), lists], names=[client, label, "times", vec])

    kind = df.schema[client].dataType.simpleString()
    # few bytes but long margins: over all tasks
    places = counted.repartition(shuffle_width(df)).mapInArrow(back, f"`{client}` {kind}, `{label}` double, times long, `{vec}` array<double>")
    return tree_margins(forest, clients, places, trees, client, vec, out).drop(vec)


def prefix_counts(forest: DataFrame, df: DataFrame, client: str = "client_id", vec: str = "features", label: str = "label") -> DataFrame:
    """(client, prefix, score, tp_at, n_at): every client's first ``prefix`` trees on all rows of ``df``; equal scores of a batch are merged."""
    loaded = load(forest, client)
    kind, arrow = forest.schema[client].dataType.simpleString(), to_arrow_type(forest.schema[client].dataType)
    source = df.where(F.col(label).isNotNull()).select(F.col(vec).cast("array<double>").alias("_x"), F.col(label).cast("double").alias("_y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("_y").to_numpy()
            for c, trees in loaded.items():
                for a, x in _pieces(batch, "_x", len(trees.feature)):
                    running = np.cumsum(leaf_values(x, trees), axis=1)
                    parts = []
                    for p in range(running.shape[1]):
                        score, at, n = np.unique(running[:, p], return_inverse=True, return_counts=True)
                        parts.append((np.full(len(score), p + 1), score, np.rint(np.bincount(at, y[a:a + len(x)], len(score))).astype(np.int64), n))
                    prefix, score, tp, n = (np.concatenate(z) for z in zip(*parts, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([c] * len(prefix), arrow), pa.array(prefix.astype(np.int32)), pa.array(score), pa.array(tp), pa.array(n.astype(np.int64))],
                                                     names=[client, "prefix", "score", "tp_at", "n_at"])

    return source.mapInArrow(run, f"`{client}` {kind}, prefix int, score double, tp_at long, n_at long") \
        .groupBy(client, "prefix", "score").agg(F.sum("tp_at").alias("tp_at"), F.sum("n_at").alias("n_at"))


def margins_of_clients(forest: DataFrame, df: DataFrame, keep: Sequence[str], client: str = "client_id", vec: str = "features", out: str = "margin") -> DataFrame:
    """``keep`` columns of every row with each client's whole margin, one row per (row, client)."""
    loaded = load(forest, client)
    source = df.select(*keep, F.col(vec).cast("array<double>").alias("_x"))
    kind = forest.schema[client].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, trees in loaded.items():
                for a, x in _pieces(batch, "_x", len(trees.feature)):
                    yield pa.RecordBatch.from_arrays([*batch.slice(a, len(x)).columns[:-1], pa.array([c] * len(x), arrow), pa.array(leaf_values(x, trees).sum(axis=1))],
                                                     names=[*keep, client, out])

    return source.mapInArrow(run, df.select(*keep).withColumn(client, F.lit(None).cast(kind)).withColumn(out, F.lit(None).cast("double")).schema)
