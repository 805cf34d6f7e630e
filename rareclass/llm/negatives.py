"""Hard negatives by integer inner product: rotated one-bit codes bound every score, survivors are scored exactly (operator 13)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rareclass.llm.shared import stored

#: Vectors whose squares sum to this or more cannot be scored (and compared in hundredths) in 64 bits.
LARGEST = 1 << 56
CODED = "vec_id long, label long, dims int, point binary, bits binary, align binary, rest double"
FOUND = "slot long, vec_id long, score long"


class Codes(NamedTuple):
    """One-bit codes of rows, one per level, with the length of each level along its code and of what all levels leave over."""

    bits: np.ndarray
    align: np.ndarray
    rest: np.ndarray


class Planes(NamedTuple):
    """Rotated queries rounded to a grid: component = low + step * number, the numbers cut into planes of bits."""

    bits: np.ndarray
    low: np.ndarray
    step: np.ndarray
    total: np.ndarray
    error: np.ndarray
    length: np.ndarray


_turns: dict[tuple[int, int], np.ndarray] = {}


def rotation(dims: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every worker."""
    if (dims, seed) not in _turns:
        drawn = np.random.Generator(np.random.PCG64([seed, dims])).standard_normal((dims, dims))
        _turns[dims, seed] = np.linalg.qr(drawn)[0]
    return _turns[dims, seed]


def _words(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as rows of 64-bit words, filled with zeros."""
    packed = np.packbits(flags, axis=-1, bitorder="little")
    wide = np.zeros((*packed.shape[:-1], -(-packed.shape[-1] // 8) * 8), dtype=np.uint8)
    wide[..., :packed.shape[-1]] = packed
    return wide.view("<u8")


def encode(points: np.ndarray, levels: int, seed: int) -> Codes:
    """Codes of rows of numbers. Each level holds the signs of the rotated rest; its length along that code is then taken off."""
    dims = points.shape[1]
    left = points.astype(np.float64) @ rotation(dims, seed)
    bits, align = [], []
    for _ in range(levels):
        sign = left >= 0
        length = np.abs(left).sum(axis=1) / np.sqrt(dims)
        left -= np.where(sign, 1.0, -1.0) * (length / np.sqrt(dims))[:, None]
        bits.append(_words(sign))
        align.append(length)
    return Codes(np.stack(bits, axis=1), np.stack(align, axis=1), np.sqrt((left * left).sum(axis=1)))


def grid(points: np.ndarray, seed: int, count: int = 6) -> Planes:
    """Planes of ``count`` bits of rotated queries, with the length of the rounding error."""
    turned = points.astype(np.float64) @ rotation(points.shape[1], seed)
    low = turned.min(axis=1)
    step = (turned.max(axis=1) - low) / ((1 << count) - 1)
    step[step == 0] = 1.0
    number = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
    error = turned - (low[:, None] + step[:, None] * number)
    bits = np.stack([_words((number >> j & 1).astype(bool)) for j in range(count)], axis=1)
    return Planes(bits, low, step, number.sum(axis=1), np.sqrt((error * error).sum(axis=1)), np.sqrt((turned * turned).sum(axis=1)))


def bounds(codes: Codes, queries: Planes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(low, high): every inner product of query i and row j lies between low[i, j] and high[i, j].

    A row is the sum of its codes, each times its length, and a rest at right angles to the last code. Popcounts of codes with planes
    give the rounded query's product with each code; rounding moves that by the error's length at most, and the rest adds at most its
    own length times the length of the query beside the last code (Cauchy-Schwarz).
    """
    shape = len(queries.low), len(codes.rest)
    estimate = np.zeros(shape)
    both, count = np.empty(shape, np.uint64), np.empty(shape, np.uint8)
    wide = np.uint16 if dims << queries.bits.shape[1] < 1 << 16 else np.int64
    planes = [[np.ascontiguousarray(queries.bits[:, j, w])[:, None] for w in range(queries.bits.shape[2])] for j in range(queries.bits.shape[1])]
    for level in range(codes.bits.shape[1]):
        own = [np.ascontiguousarray(codes.bits[:, level, w]) for w in range(codes.bits.shape[2])]
        inner = np.zeros(shape, dtype=wide)
        for j, plane in enumerate(planes):
            for w, word in enumerate(own):
                np.bitwise_count(np.bitwise_and(plane[w], word, out=both), out=count)
                inner += np.left_shift(count, j, dtype=wide)
        ones = sum(np.bitwise_count(word).astype(np.int64) for word in own)
        along = inner * (2 * queries.step / np.sqrt(dims))[:, None]
        along += ((queries.low[:, None] * (2 * ones - dims)) - (queries.step * queries.total)[:, None]) / np.sqrt(dims)
        estimate += codes.align[:, level] * along
    reach = codes.align.sum(axis=1)
    beside = np.maximum(np.abs(along) - queries.error[:, None], 0.0)
    beside = np.sqrt(np.maximum(queries.length[:, None] ** 2 - beside * beside, 0.0))
    beside *= codes.rest
    beside += reach * queries.error[:, None] + 1e-9 * queries.length[:, None] * (reach + codes.rest) + 1e-6  # the last two: rounding of doubles
    return estimate - beside, estimate + beside


def coded(vectors: DataFrame, label: Column, levels: int, seed: int) -> DataFrame:
    """The rows that take part, with integer components, codes, alignments and rest."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"),
                          F.col("embedding").cast("array<double>").alias("embedding")) \
        .filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0").filter(fine).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            sizes = lists.value_lengths().to_numpy()
            flat = lists.flatten().to_numpy()
            begin = np.cumsum(sizes) - sizes
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                points = np.floor(256 * flat[begin[at][:, None] + np.arange(d)])
                with np.errstate(over="ignore"):
                    fits = (points * points).sum(axis=1) < LARGEST
                at, points = at[fits], points[fits]
                codes = encode(points, levels, seed)
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id").take(pa.array(at)), batch.column("label").take(pa.array(at)),
                    pa.array(np.full(len(at), d, dtype=np.int32)), _cells(points.astype("<i4")), _cells(codes.bits),
                    _cells(codes.align.astype("<f8")), pa.array(codes.rest)], names=[f.split()[0] for f in CODED.split(", ")])

    return rows.mapInArrow(run, CODED)


def _cells(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _stack(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    cells = column.to_pylist()
    return np.frombuffer(b"".join(cells), kind).reshape(len(cells), -1)


def _scores(points: np.ndarray, queries: np.ndarray, row: np.ndarray, query: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """Exact integer products of the given (query, row) pairs.

    Where a tenth of all pairs or more are asked for and no product can reach 2^53, one product of matrices of doubles gives the same numbers.
    """
    if 10 * len(row) >= len(points) * len(queries):
        p, q = points.astype(np.float64), queries.astype(np.float64)
        if (p * p).sum(axis=1).max(initial=0.0) * (q * q).sum(axis=1).max(initial=0.0) < 2.0**104:
            return (q @ p.T)[query, row].astype(np.int64)
    out = np.empty(len(row), dtype=np.int64)
    for a in range(0, len(row), step):
        out[a:a + step] = np.einsum("ij,ij->i", points[row[a:a + step]].astype(np.int64), queries[query[a:a + step]].astype(np.int64))
    return out


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of each row, -inf where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def _best(group: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each group: higher score first, then smaller id."""
    order = np.lexsort((ids, -scores, group))
    first = np.searchsorted(group[order], group[order], side="left")
    return order[np.arange(len(order)) - first < k]


class Block(NamedTuple):
    """Rows of a block and anchors that look at it."""

    ids: np.ndarray
    labels: np.ndarray
    points: np.ndarray
    codes: Codes
    slots: np.ndarray
    own_ids: np.ndarray
    own_labels: np.ndarray
    queries: np.ndarray


def _block(rows: pa.Table, anchors: pa.Table) -> Block:
    points = _stack(rows.column("point"), "<i4")
    align = _stack(rows.column("align"), "<f8")
    bits = _stack(rows.column("bits"), "<u8").reshape(len(points), align.shape[1], -1)
    return Block(rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), points,
                 Codes(bits, align, rows.column("rest").to_numpy()), anchors.column("slot").to_numpy(),
                 anchors.column("anchor_id").to_numpy(), anchors.column("anchor_label").to_numpy(), _stack(anchors.column("anchor"), "<i4"))


def _tiles(block: Block, rows: np.ndarray, anchors: np.ndarray, seed: int, side: int = 256, width: int = 512) -> Iterator[tuple[np.ndarray, Iterator]]:
    """Groups of anchors, each with tiles of rows: (rows, low, high). A tile's tables stay small enough for the processor's cache."""
    for a in range(0, len(anchors), side):
        part = anchors[a:a + side]
        planes = grid(block.queries[part], seed)

        def tiles(planes: Planes = planes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for b in range(0, len(rows), width):
                own = rows[b:b + width]
                codes = Codes(block.codes.bits[own], block.codes.align[own], block.codes.rest[own])
                yield own, *bounds(codes, planes, block.points.shape[1])

        yield part, tiles()


class Tops:
    """The best few (score, row) seen so far of each place, and what a newcomer must reach once there are ``k``."""

    def __init__(self, places: int, k: int) -> None:
        self.k, self.place, self.row, self.score = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.floor = np.full(places, -np.inf)

    def add(self, place: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(place):
            return
        place, row, score = np.concatenate([self.place, place]), np.concatenate([self.row, row]), np.concatenate([self.score, score])
        keep = _best(place, ids[row], score, self.k)
        self.place, self.row, self.score = place[keep], row[keep], score[keep]
        full = np.flatnonzero(np.bincount(self.place, minlength=len(self.floor)) == self.k)
        lowest = np.full(len(self.floor), np.inf)
        np.minimum.at(lowest, self.place, self.score)
        self.floor[full] = lowest[full]


def positives_of(block: Block, k: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score): the ``k`` best rows of each anchor's label in the block.

    Rows are not scored when their upper bound is below the k-th best score so far or the k-th best lower bound of their tile.
    """
    out = []
    for label in np.unique(block.own_labels):
        rows = np.flatnonzero(block.labels == label)
        for part, tiles in _tiles(block, rows, np.flatnonzero(block.own_labels == label), seed):
            tops = Tops(len(part), k)
            for own, low, high in tiles:
                fit = block.own_ids[part, None] != block.ids[own]
                floor = np.maximum(tops.floor, _kth(np.where(fit, low, -np.inf), k))
                anchor, row = np.nonzero(fit & (high >= floor[:, None]))
                tops.add(anchor, own[row], _scores(block.points[own], block.queries[part], row, anchor), block.ids)
            out.append((part[tops.place], tops.row, tops.score))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def negatives_of(block: Block, wanted: np.ma.MaskedArray, k: int, seed: int, low_share: int, high_share: int) -> tuple[np.ndarray, ...]:
    """(anchor, place, row, score): for each anchor and each of its positives the ``k`` best rows of other labels whose score lies between
    ``low_share`` and ``high_share`` hundredths of the positive's. ``wanted`` holds the positives' scores, masked where there are fewer.

    Rows are scored when their interval meets a window at or above the k-th best score found in it so far.
    """
    out, places = [], wanted.shape[1]
    for part, tiles in _tiles(block, np.arange(len(block.ids)), np.arange(len(block.slots)), seed):
        scores, real = wanted.data[part], ~np.ma.getmaskarray(wanted)[part]
        least, most = -(-low_share * scores // 100), high_share * scores // 100
        tops = Tops(len(part) * places, k)
        for own, low, high in tiles:
            fit = (block.own_labels[part, None] != block.labels[own]) & (block.own_ids[part, None] != block.ids[own])
            floors = np.maximum(tops.floor.reshape(len(part), places), least)
            alive = np.zeros(fit.shape, dtype=bool)
            for place in range(places):
                alive |= (high >= floors[:, place, None]) & (low <= most[:, place, None]) & real[:, place, None]
            anchor, row = np.nonzero(fit & alive)
            score = _scores(block.points[own], block.queries[part], row, anchor)
            inside = real[anchor] & (score[:, None] >= floors[anchor]) & (score[:, None] <= most[anchor])
            pair, place = np.nonzero(inside)
            tops.add(anchor[pair] * places + place, own[row[pair]], score[pair], block.ids)
        out.append((part[tops.place // places], tops.place % places, tops.row, tops.score))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def hard_negatives(vectors: DataFrame, label: Column, every: int = 100, positives: int = 5, negatives: int = 10, low_share: int = 30,
                   high_share: int = 90, levels: int = 4, seed: int = 17, block_rows: int = 32_768, least_blocks: int = 16) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), complete and exact.

    Components are floor(256 x). Anchors are rows whose ``vec_id`` is divisible by ``every``. Rows are dealt by a hash of the id into blocks of
    about ``block_rows``; anchors are cut the same way and every block of them meets every block of rows twice, once for the positives and
    once, when these are known over all blocks, for the negatives. A task returns the best few of its block, which windows merge.

    Rows with a null id, label or vector, an empty vector or a null or non-finite component take no part, nor do those too long to be scored in
    64 bits (see :data:`LARGEST`); a vector of zeros does. Vectors meet those of their own length only. Rows that repeat an (id, label, vector)
    count once; others that share an id are rows of their own, but never candidates of that id's anchors. Other columns are ignored.
    """
    rows = stored(coded(vectors, label, levels, seed), "negatives-coded")
    n = rows.count()
    anchors = stored(rows.filter(F.col("vec_id") % every == 0).select(
        F.monotonically_increasing_id().alias("slot"), F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), "dims",
        F.col("point").alias("anchor")), "negatives-anchors")
    parts = max(-(-n // block_rows), min(least_blocks, -(-n // 256)), 1)
    groups = max(-(-anchors.count() // block_rows), 1)
    keys = ["dims", "part", "group"]
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")) \
        .withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def looking(asked: DataFrame, find: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        spread = asked.withColumn("group", F.pmod(F.xxhash64("slot"), F.lit(groups)).cast("int")) \
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        return dealt.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(find, schema)

    def find_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table(FOUND, [[], [], []])
        block = _block(left, right)
        anchor, row, score = positives_of(block, positives, seed)
        return _table(FOUND, [block.slots[anchor], block.ids[row], score])

    best = W.partitionBy("slot").orderBy(F.desc("score"), "vec_id")
    nearest = stored(looking(anchors, find_positives, FOUND).withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= positives)
                     .groupBy("slot").agg(F.array_sort(F.collect_list(F.struct(
                         F.col("_r").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))).alias("own")),
                     "negatives-positives")
    schema = f"slot long, place int, {FOUND.split(', ', 1)[1]}"

    def find_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table(schema, [[], [], [], []])
        block = _block(left, right)
        wanted = np.ma.masked_all((right.num_rows, positives), dtype=np.int64)
        wanted.data[:] = 0
        for i, own in enumerate(right.column("scores").to_pylist()):
            wanted[i, :len(own)] = own
        anchor, place, row, score = negatives_of(block, wanted, negatives, seed, low_share, high_share)
        return _table(schema, [block.slots[anchor], place, block.ids[row], score])

    asked = anchors.join(nearest, "slot").select("slot", "anchor_id", "anchor_label", "dims", "anchor", F.col("own.positive_score").alias("scores"))
    top = W.partitionBy("slot", "place").orderBy(F.desc("score"), "vec_id")
    found = looking(asked, find_negatives, schema).withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= negatives)
    named = anchors.select("slot", "anchor_id").join(nearest, "slot").select("slot", "anchor_id", F.inline("own")) \
        .withColumn("place", F.col("place") - 1)
    return found.join(named, ["slot", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


def _table(schema: str, columns: list) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)})
