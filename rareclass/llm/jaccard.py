"""N-gram Jaccard self-join: MinHash bands find candidates, full n-gram sets decide (operator 6)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rareclass.llm.components import components
from rareclass.llm.shared import bounded_batches, stored
from rareclass.llm.vectors import local_links, runs
from rareclass.llm.words import hash_words, mix64, slices

#: Words are runs of ASCII letters, digits and all characters beyond ASCII.
BREAKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_STEP = np.uint64(0xD6E8FEB86659FD93)
UNIT = ["band", "code", "block_a", "block_b"]
#: Added to a set's size when buckets are cut into blocks, so that a block holds 512 sets at most.
ROW_WEIGHT = 4096
BLOCK_WEIGHT = ROW_WEIGHT * 512


def choose_bands(threshold: float, recall: float, most_hashes: int = 256) -> tuple[int, int]:
    """(bands, rows per band): the most selective rows for which a pair at ``threshold`` still meets with ``recall``."""
    best = None
    for rows in range(1, most_hashes + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-min(threshold**rows, 1 - 1e-12))))
        if bands * rows > most_hashes:
            break
        best = bands, rows
    if best is None:
        raise ValueError(f"{most_hashes} hashes cannot reach recall {recall} at {threshold}")
    return best


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Ascending distinct hashes of the runs of ``n`` words of each text; a shorter text is one run, one without words none."""
    words = hash_words([t.lower().encode("utf-8", "replace") for t in texts], BREAKS)
    counts = words.counts
    runs_ = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    first = np.cumsum(counts) - counts
    at = np.repeat(first - np.cumsum(runs_) + runs_, runs_) + np.arange(runs_.sum())
    end = np.repeat(first + counts, runs_)
    total = np.zeros(len(at), dtype=np.uint64)
    for j in range(n):
        place = np.minimum(at + j, len(words.hashes) - 1)
        total = total * _STEP + np.where(at + j < end, words.hashes[place], np.uint64(0)) if len(at) else total
    return [np.unique(part) for part in np.split(mix64(total), np.cumsum(runs_)[:-1])] if len(texts) else []


class Bands:
    """Band codes of sets: minima of ``bands * rows`` linear functions modulo 2^32, hashed band by band."""

    def __init__(self, bands: int, rows: int, seed: int = 19):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.bands, self.rows = bands, rows
        self.times = (rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.plus = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)[:, None]
        self.mixers = rng.integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def codes(self, shingles: np.ndarray) -> np.ndarray:
        values = (shingles >> np.uint64(32)).astype(np.uint32)
        low = np.full(self.bands * self.rows, 0xFFFFFFFF, dtype=np.uint32)
        for a in range(0, len(values), 2048):
            low = np.minimum(low, (values[a:a + 2048] * self.times + self.plus).min(axis=1))
        grid = low.reshape(self.bands, self.rows).astype(np.uint64)
        return mix64((grid * self.mixers).sum(axis=1, dtype=np.uint64)).view(np.int64)


def _sketches(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    schema = "doc_id long, key binary, size long, codes array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Bands(bands, rows)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in slices([len(t) for t in texts]):
                sets = shingle_sets(texts[a:b], n)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, b - a),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([coder.codes(s) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                    names=["doc_id", "key", "size", "codes"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _new_pairs(run: pa.Table, sizes: np.ndarray, codes: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs that this bucket has to decide: none meets in an earlier band, and their sizes allow the threshold."""
    first, second, band = run.column("block_a")[0].as_py(), run.column("block_b")[0].as_py(), run.column("band")[0].as_py()
    new = np.minimum(sizes[:, None], sizes[None, :]) >= threshold * np.maximum(sizes[:, None], sizes[None, :])
    nodes = run.column("node").to_numpy()
    new &= nodes[:, None] != nodes[None, :]
    if first != second:
        block = run.column("block").to_numpy()
        new &= block[:, None] != block[None, :]
    for t in range(band):
        if not new.any():
            break
        new &= codes[:, t][:, None] != codes[:, t][None, :]
    return new


def _code_rows(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy()
    return flat.reshape(len(column), -1)


def common(sets: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 blocks over the hashes that more than one set holds."""
    value, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    rank = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    row, column = row[keep], rank[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(sets), len(sets)))
    width = int(rank[-1]) + 1 if len(rank) else 0
    for a in range(0, width, columns):
        low, high = np.searchsorted(column, (a, a + columns))
        block = np.zeros((len(sets), min(columns, width - a)), dtype=np.float32)
        block[row[low:high], column[low:high] - a] = 1
        total += block @ block.T
    return total


def near_texts(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """(doc_id, class_id, component_id, n_links, kept): texts whose word n-gram sets have Jaccard ``threshold`` or more are linked.

    Texts with equal sets form a class, represented by its smallest doc_id and counted; only representatives are compared.
    They meet where all rows of a band agree. Buckets with more than one are cut into blocks of bounded weight, every
    pair is decided once, in the first band where it meets, on the full sets of exactly those texts that have a pair left. Tasks
    return sums and spanning links, never pairs.

    Lower-cased; null and texts without words link with nothing; a text shorter than ``n`` words is one n-gram. A row without
    ``doc_id`` links with nothing and keeps null ids. Rows that share a ``doc_id`` are one node. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    bands, rows = choose_bands(threshold, recall)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = stored(_sketches(plain, n, bands, rows), "shingle-sketches")
    classes = stored(sketches.filter("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("codes").alias("codes")),
        "shingle-classes")

    spread = classes.select("node", (F.col("size") + ROW_WEIGHT).alias("weight"), F.posexplode("codes").alias("band", "code"))
    full = spread.groupBy("band", "code").agg(F.count("*").alias("_rows"), F.sum("weight").alias("_weight")).filter("_rows > 1") \
        .select("band", "code", F.least(F.ceil(F.col("_weight") / BLOCK_WEIGHT), F.col("_rows")).cast("int").alias("_blocks"))
    met = spread.join(full, ["band", "code"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")) \
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))) \
        .select("node", "band", "code", F.least("block", "_other").alias("block_a"), F.greatest("block", "_other").alias("block_b"), "block")
    light = met.join(classes.select("node", "size", "codes"), "node")

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, 4):
            if run.num_rows > 1:
                new = _new_pairs(run, run.column("size").to_numpy(), _code_rows(run.column("codes")), threshold)
                rows_ = np.flatnonzero(new.any(axis=1))
                if len(rows_):
                    yield from run.select(["node", *UNIT, "block"]).take(pa.array(rows_)).combine_chunks().to_batches()

    schema = "node long, band int, code long, block_a int, block_b int, block int"
    units = light.select(*UNIT, "block", "node", "size", "codes").repartition(*UNIT).sortWithinPartitions(*UNIT).mapInArrow(wanted, schema)
    per_node = stored(units.groupBy("node").agg(F.collect_list(F.struct(*UNIT, "block")).alias("units"))
                      .join(classes.select("node", "key", "copies", "codes"), "node"), "shingle-units")

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, units_ = batch.column("text").to_pylist(), batch.column("units").to_pylist()
            keys, codes = batch.column("key").to_pylist(), batch.column("codes").to_pylist()
            nodes, copies = batch.column("node").to_pylist(), batch.column("copies").to_pylist()
            for a, b in slices([len(t) for t in texts]):
                out: list[tuple] = []
                held = 0
                for i, s in enumerate(shingle_sets(texts[a:b], n), a):
                    data = s.tobytes()
                    if xxhash.xxh3_128_digest(data) != keys[i]:
                        continue  # another text with this doc_id
                    for u in units_[i]:
                        out.append((*(u[k] for k in UNIT), u["block"], nodes[i], copies[i], codes[i], data))
                        held += len(data) + 8 * bands
                        if held > 1 << 22:
                            yield _unit_rows(out)
                            out, held = [], 0
                if out:
                    yield _unit_rows(out)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, 4):
            _, keep = np.unique(run.column("node").to_numpy(), return_index=True)
            if len(keep) < 2:
                continue
            run = run.take(pa.array(keep))
            sets = [np.frombuffer(s, "<u8") for s in run.column("shingles").to_pylist()]
            sizes = np.array([len(s) for s in sets])
            new = _new_pairs(run, sizes, _code_rows(run.column("codes")), threshold)
            shared = common(sets)
            new &= shared / (sizes[:, None] + sizes[None, :] - shared) >= threshold
            rows_ = np.flatnonzero(new.any(axis=1))
            if len(rows_):
                nodes, copies = run.column("node").to_numpy(), run.column("copies").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(nodes[rows_]), pa.array((new @ copies)[rows_]),
                                                  pa.array(local_links(new, nodes)[rows_])], names=["node", "links", "other"])

    needed = plain.join(per_node, plain["doc_id"] == per_node["node"]) \
        .select("node", "text", "units", "key", "copies", "codes").filter("text IS NOT NULL")
    sent = needed.mapInArrow(ship, f"{schema.replace('node long, ', '')}, node long, copies long, codes array<long>, shingles binary")
    found = stored(sent.repartition(*UNIT).sortWithinPartitions(*UNIT).mapInArrow(decide, "node long, links long, other long"), "shingle-links")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    per_class = stored(classes.select("key", "node", "copies").join(links, "node", "left").join(joined, "node", "left").select(
        "key", F.col("node").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "node").alias("component_id")), "shingle-results")
    return sketches.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")).join(per_class, "key", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")) \
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _unit_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                                      names=[*UNIT, "block", "node", "copies", "codes", "shingles"])
