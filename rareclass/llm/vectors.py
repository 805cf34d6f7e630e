"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosine, components (operator 1)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rareclass.llm.components import components
from rareclass.llm.shared import stored


def usable(embedding: Column) -> Column:
    """Not null, not zero, and every component a finite number."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def plan_tables(rows: int, cosine: float, recall: float = 0.9999) -> tuple[int, int]:
    """(bits, tables): buckets hold about 16 unrelated rows, and a pair at ``cosine`` meets in some table with ``recall``."""
    bits = min(32, max(4, math.ceil(math.log2(max(rows, 2))) - 4))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log1p(-agree))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, first by their largest component so that nothing overflows."""
    vectors = np.asarray(vectors, dtype=np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def matrix(cells: list[bytes]) -> np.ndarray:
    """Equal-length little-endian doubles as rows."""
    return np.frombuffer(b"".join(cells), "<f8").reshape(len(cells), -1)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal values in the first ``keys`` columns, from sorted batches."""
    carry: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if carry is not None:
            table = pa.concat_tables([carry, table]).combine_chunks()
        if not table.num_rows:
            continue
        values = [table.column(i).to_numpy() for i in range(keys)]
        change = np.zeros(table.num_rows - 1, dtype=bool)
        for v in values:
            change |= v[1:] != v[:-1]
        cut = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield table.slice(a, b - a)
        carry = table.slice(cut[-1])
    if carry is not None and carry.num_rows:
        yield carry


def blocked(rows: DataFrame, bucket: list[str], weight: str, size: int) -> DataFrame:
    """Adds block_a, block_b and block: every pair of rows of a bucket meets in exactly one (block_a, block_b).

    Buckets of more than ``size`` weight are cut into blocks by a hash of ``node``; a row goes to each pair of blocks that
    holds its own. Smaller buckets have the one pair (0, 0).
    """
    heavy = rows.groupBy(*bucket).agg(F.sum(weight).alias("_w"), F.count("*").alias("_rows")) \
        .filter((F.col("_w") > size) & (F.col("_rows") > 1)) \
        .select(*bucket, F.least(F.ceil(F.col("_w") / size), F.col("_rows")).cast("int").alias("_blocks"))
    marked = rows.join(heavy, bucket, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1))) \
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    return marked.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))) \
        .withColumn("block_a", F.least("block", "_other")).withColumn("block_b", F.greatest("block", "_other")) \
        .drop("_other", "_blocks")


def local_links(linked: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """For each row the smallest node of its group of linked rows (``linked`` is symmetric)."""
    label = np.asarray(nodes).copy()
    top = np.iinfo(np.int64).max
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], top).min(axis=1, initial=top))
        if (new == label).all():
            return label
        label = new


def _signed(dims: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, dims])).standard_normal((dims, bits * tables))


def near_vectors(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.9999, seed: int = 11,
                 block_rows: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept): links are pairs of vectors with cosine >= ``threshold``.

    Equal vectors are merged first and counted, so a mass of copies costs one row. Each distinct vector gets one signature per
    table; rows that share one are compared exactly in double precision, in blocks of bounded size when a bucket is
    large. A pair counts in the first table where it meets. Tasks return sums and a spanning link per row, never pairs.
    Null, zero or non-finite vectors, and vectors of another length, link with nothing. A row without ``vec_id`` links
    with nothing and has no component. Rows that share a ``vec_id`` are one node. Other columns are ignored.
    """
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = ids.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    classes = stored(fine.groupBy(F.transform("embedding", lambda x: x + 0.0).alias("embedding"))
                     .agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), "vector-classes")
    bits, tables = plan_tables(classes.count(), threshold, recall)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = (1 << np.arange(bits, dtype=np.uint64)).astype(np.uint64)
        for batch in batches:
            lists = batch.column("embedding")
            sizes = lists.value_lengths().to_numpy()
            flat = lists.flatten().to_numpy()
            begin = np.cumsum(sizes) - sizes
            cells, signatures = [b""] * len(sizes), [b""] * len(sizes)
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                unit = unit_rows(flat[begin[rows][:, None] + np.arange(d)])
                if d not in planes:
                    planes[d] = _signed(int(d), bits, tables, seed)
                side = (unit @ planes[d] > 0).reshape(len(rows), tables, bits)
                codes = (side * weights).sum(axis=2).astype("<u4")
                for r, u, c in zip(rows.tolist(), unit, codes, strict=True):
                    cells[r], signatures[r] = u.tobytes(), c.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("copies"), pa.array(sizes.astype(np.int32)), pa.array(cells, pa.binary()),
                 pa.array(signatures, pa.binary()),
                 pa.array([np.frombuffer(s, "<u4").astype(np.int64) for s in signatures], pa.list_(pa.int64()))],
                names=["node", "copies", "dims", "unit", "signature", "codes"])

    signed = stored(classes.mapInArrow(
        sign, "node long, copies long, dims int, unit binary, signature binary, codes array<long>"), "vector-signs")
    exploded = signed.select("node", "copies", "dims", "unit", "signature", F.posexplode("codes").alias("table", "code")) \
        .withColumn("_one", F.lit(1))
    placed = blocked(exploded, ["dims", "table", "code"], "_one", block_rows)
    keys = ["dims", "table", "code", "block_a", "block_b"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, 5):
            if run.num_rows < 2:
                continue
            table, first, second = (run.column(c)[0].as_py() for c in ("table", "block_a", "block_b"))
            unit = matrix(run.column("unit").to_pylist())
            linked = unit @ unit.T >= threshold
            np.fill_diagonal(linked, False)
            if first != second:
                block = run.column("block").to_numpy()
                linked &= block[:, None] != block[None, :]
            if not linked.any():
                continue
            nodes, copies = run.column("node").to_numpy(), run.column("copies").to_numpy()
            codes = np.frombuffer(b"".join(run.column("signature").to_pylist()), "<u4").reshape(len(nodes), -1)
            new = linked.copy()
            for t in range(table):
                new &= codes[:, t][:, None] != codes[:, t][None, :]
            label = local_links(linked, nodes)
            rows = np.flatnonzero(linked.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[rows]), pa.array((new @ copies)[rows]), pa.array(label[rows])],
                                             names=["node", "links", "other"])

    found = stored(placed.select(*keys, "block", "node", "copies", "unit", "signature").repartition(*keys)
                   .sortWithinPartitions(*keys).mapInArrow(compare, "node long, links long, other long"), "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    per_class = classes.select("embedding", "node", "copies").join(links, "node", "left").join(joined, "node", "left")
    per_class = per_class.select(F.col("embedding").alias("_vector"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                                 F.coalesce("component", "node").alias("component_id"))
    clean = F.when(F.col("vec_id").isNotNull() & usable(F.col("embedding")), F.transform("embedding", lambda x: x + 0.0))
    out = ids.withColumn("_vector", clean).join(per_class, "_vector", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component_id", "vec_id").alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
