"""Concatenate and cut: fixed windows over all token ids, placed by two-pass prefix sums (operator 9)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rareclass.llm.shared import bounded_batches, stored
from rareclass.llm.tokens import encoded, id_type

ENCODED = "part int, doc_id long, local_start long, n_tokens int, ids binary"
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_tokens long, padded_to long")


def token_table(docs: DataFrame, path: str, end_id: int = 1, name: str = "tokens") -> DataFrame:
    """Pass 1: ids of every text, with each row's place among the rows of its task; written to the shared folder.

    ``docs`` needs ``doc_id`` and ``text``; a null text counts as empty and still gets ``end_id``. Ids are stored in
    the type that :func:`id_type` gives.
    """
    bounded_batches(docs.sparkSession)
    kind = id_type(path, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            doc = batch.column("doc_id")
            for a, b, rows in encoded(batch, path, end_id):
                sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
                starts = at + np.cumsum(sizes) - sizes
                at += int(sizes.sum())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(rows), part, dtype=np.int32)), doc.slice(a, b - a), pa.array(starts),
                    pa.array(sizes.astype(np.int32)), pa.array([r.astype(kind).tobytes() for r in rows])],
                    names=["part", "doc_id", "local_start", "n_tokens", "ids"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return stored(source.mapInArrow(run, ENCODED), name)


def part_offsets(tokens: DataFrame) -> tuple[dict[int, int], int]:
    """Prefix sums over the totals of the written tasks: one number per task reaches the driver, never a row."""
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    offsets, at = {}, 0
    for row in totals:
        offsets[row["part"]] = at
        at += row["n"]
    return offsets, at


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: where ``length`` ids of ``doc_id`` from ``start`` lie in sequence ``sequence_id``.

    All ids of all rows form one stream, in the order of the written table; sequence ``k`` is its window
    ``[k * window, (k + 1) * window)``. Every id lies in exactly one piece, every sequence but the last is full and the
    last is padded to the next power of two (``padded_to``). Rows with equal texts or equal ids are packed like any other;
    other columns are ignored; an empty table gives no pieces.
    """
    tokens = token_table(docs, path, end_id, "pack-tokens")
    offsets, total = part_offsets(tokens)
    kind = id_type(path, end_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(9)]
            parts, docs_, local, sizes, ids = (batch.column(c).to_pylist() for c in
                                               ("part", "doc_id", "local_start", "n_tokens", "ids"))
            for part, doc, start, size, data in zip(parts, docs_, local, sizes, ids, strict=True):
                begin = offsets[part] + start
                view = memoryview(np.frombuffer(data, kind).astype("<u4").tobytes())
                done = 0
                while done < size:
                    sequence, offset = divmod(begin + done, window)
                    length = min(size - done, window - offset)
                    filled = min(window, total - sequence * window)
                    row = (doc, done, length, zlib.crc32(view[4 * done:4 * (done + length)]), size, sequence, offset,
                           filled, 1 << (filled - 1).bit_length())
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                    done += length
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns],
                                             names=[f.split()[0] for f in PIECES.split(", ")])

    return tokens.mapInArrow(cut, PIECES)
