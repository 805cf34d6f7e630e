"""Token-id files: canonical length-limited Huffman codes in independent blocks with checkpoints (operator 4).

A file set has three tables below one folder. ``code``: one row per id that occurs, with its code length. ``blocks``: one
row per block of whole documents in ascending ``doc_id``, holding the payload below. ``parts``: ids per written part.

Payload, little-endian: magic ``HTB1``; u32 documents, u64 ids, u32 checkpoint interval; u64 bit position of every
interval-th id; u64 ids of every document; the code bits, first bit highest, padded with zeros.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rareclass.llm.packing import token_table
from rareclass.llm.shared import scratch
from rareclass.llm.tokens import id_type

MAX_BITS = 16
MAGIC = b"HTB1"
_HEAD = struct.Struct("<4sIQI")
BLOCKS = "part int, block int, local_start long, n_docs int, n_ids long, first_doc long, last_doc long, doc_ids binary, payload binary"
DECODED = "doc_id long, start long, n_tokens long, ids_crc32 long"


class Code(NamedTuple):
    """Canonical code: per id its length and bits; ``table`` maps the next ``MAX_BITS`` bits to (id, length)."""

    length: np.ndarray
    bits: np.ndarray
    table_id: np.ndarray
    table_length: np.ndarray


def code_lengths(counts: dict[int, int], limit: int = MAX_BITS) -> dict[int, int]:
    """Optimal code lengths of at most ``limit`` bits (package-merge); ties go to smaller ids first."""
    symbols = sorted(counts, key=lambda s: (counts[s], s))
    n = len(symbols)
    if n > 1 << limit:
        raise ValueError(f"{n} ids need codes of more than {limit} bits")
    if n <= 1:
        return {s: 1 for s in symbols}
    weight = np.array([counts[s] for s in symbols], dtype=np.float64)
    # a coin is (weight, place); merged holds, per level, which coins of the sorted list are single symbols
    levels: list[np.ndarray] = []
    packages = np.zeros(0)
    for _ in range(limit):
        values = np.concatenate([weight, packages])
        order = np.argsort(values, kind="stable")
        levels.append(order < n)
        ranked = values[order]
        even = len(ranked) // 2 * 2
        packages = ranked[0:even:2] + ranked[1:even:2]
    length = np.zeros(n, dtype=np.int64)
    take = 2 * (n - 1)
    for single in reversed(levels):
        chosen = int(single[:take].sum())
        length[:chosen] += 1
        take = 2 * (take - chosen)
    return {s: int(k) for s, k in zip(symbols, length, strict=True)}


def canonical(lengths: dict[int, int], limit: int = MAX_BITS) -> Code:
    """Codes in order of (length, id), each one more than the one before."""
    size = max(lengths, default=0) + 1
    length = np.zeros(size, dtype=np.uint8)
    bits = np.zeros(size, dtype=np.uint32)
    table_id = np.zeros(1 << limit, dtype=np.uint32)
    table_length = np.zeros(1 << limit, dtype=np.uint8)
    code, previous = 0, 0
    for symbol, k in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= k - previous
        previous = k
        length[symbol], bits[symbol] = k, code
        first = code << (limit - k)
        table_id[first:first + (1 << (limit - k))] = symbol
        table_length[first:first + (1 << (limit - k))] = k
        code += 1
    return Code(length, bits, table_id, table_length)


def encode_block(ids: np.ndarray, sizes: np.ndarray, code: Code, interval: int = 64) -> bytes:
    """Payload of a block of documents with ``sizes`` ids each."""
    width = code.length[ids].astype(np.int64)
    ends = np.cumsum(width)
    begin = ends - width
    total = int(ends[-1]) if len(ends) else 0
    # every code lies within two neighbouring 32-bit words: add its bits to the pair that starts at its first word
    place = begin >> 5
    value = code.bits[ids].astype(np.uint64) << (64 - (begin & 31) - width).astype(np.uint64)
    out = np.zeros(total // 32 + 2, dtype=np.uint64)
    if len(ids):
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        pair = np.bitwise_or.reduceat(value, first)
        out[place[first]] |= pair >> np.uint64(32)
        out[place[first] + 1] |= pair & np.uint64(0xFFFFFFFF)
    data = out.astype(">u4").tobytes()[:(total + 7) // 8]
    head = _HEAD.pack(MAGIC, len(sizes), len(ids), interval)
    return head + begin[::interval].astype("<u8").tobytes() + np.asarray(sizes, dtype="<u8").tobytes() + data


def decode_block(payload: bytes, code: Code, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sizes) of a block. All checkpoints are followed at once, one id from each per step."""
    magic, n_docs, n_ids, interval = _HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a token block")
    lanes = -(-n_ids // interval)
    position = np.frombuffer(payload, "<u8", lanes, _HEAD.size).astype(np.int64)
    sizes = np.frombuffer(payload, "<u8", n_docs, _HEAD.size + 8 * lanes).astype(np.int64)
    data = np.frombuffer(payload + bytes(8), np.uint8, offset=_HEAD.size + 8 * (lanes + n_docs)).astype(np.uint32)
    window = (data[:-3] << np.uint32(24)) | (data[1:-2] << np.uint32(16)) | (data[2:-1] << np.uint32(8)) | data[3:]
    out = np.zeros((interval, lanes), dtype=np.uint32)
    mask = np.uint32((1 << limit) - 1)
    for step in range(min(interval, n_ids)):
        if step and step == n_ids - (lanes - 1) * interval:
            position = position[:-1]  # the last checkpoint covers fewer ids
        shift = (32 - limit - (position & 7)).astype(np.uint32)
        next_bits = (window[position >> 3] >> shift) & mask
        out[step, :len(position)] = code.table_id[next_bits]
        position = position + code.table_length[next_bits]
    return out.T.ravel()[:n_ids], sizes


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = 1, block_ids: int = 1 << 18,
                      interval: int = 64) -> None:
    """Encode ``docs`` (doc_id, text) below ``folder``.

    Ids are counted over all documents (partial counts per task), so one code serves every block. Rows are sorted by
    ``doc_id`` with a range shuffle (null first; equal doc_ids in any order, equal rows are kept), blocks are whole documents.
    """
    tokens = token_table(docs, path, end_id, "file-tokens")
    spark, kind = docs.sparkSession, id_type(path, end_id)
    item = np.dtype(kind).itemsize

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for data in batch.column("ids"):
                found = np.bincount(np.frombuffer(data.as_buffer(), kind))
                if len(found) > len(seen):
                    seen, found = found, seen
                seen[:len(found)] += found
        ids = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(seen[ids])], names=["id", "n"])

    # one row per id of the vocabulary, so its size is that of the tokenizer
    totals = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    lengths = code_lengths({r["id"]: r["n"] for r in totals})
    spark.createDataFrame(sorted(lengths.items()), "id long, bits int").coalesce(1).write.parquet(f"{folder}/code")
    held = spark.sparkContext.broadcast(canonical(lengths))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, code = TaskContext.get().partitionId(), held.value
        rows: list[tuple] = []
        size = block = at = 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(d for _, d in rows), kind)
            sizes = np.array([len(d) // item for _, d in rows])
            keys = [k for k, _ in rows]
            row = (part, block, at, len(rows), len(ids), keys[0], keys[-1],
                   pa.array(keys, pa.int64()).cast(pa.string()).to_pylist(), encode_block(ids, sizes, code, interval))
            row = (*row[:7], "\n".join("" if k is None else k for k in row[7]).encode(), row[8])
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (
                pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()),
                strict=True)], names=[f.split()[0] for f in BLOCKS.split(", ")])

        for batch in batches:
            for key, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                rows.append((key, data))
                size += len(data) // item
                if size >= block_ids:
                    yield flush()
                    rows, size, block, at = [], 0, block + 1, at + size
        if rows:
            yield flush()

    ordered = tokens.select("doc_id", "ids").repartitionByRange(F.col("doc_id").asc_nulls_first()) \
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    ordered.mapInArrow(encode, BLOCKS).write.parquet(f"{folder}/blocks")
    spark.read.parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n_ids")) \
        .write.parquet(f"{folder}/parts")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files alone.

    ``start`` counts the ids of all documents before it: the part's offset (prefix sums over ``parts``), the block's place
    in its part and the document's place in its block.
    """
    lengths = {r["id"]: r["bits"] for r in spark.read.parquet(f"{folder}/code").collect()}
    held = spark.sparkContext.broadcast(canonical(lengths))
    offsets, at = {}, 0
    for row in spark.read.parquet(f"{folder}/parts").orderBy("part").collect():
        offsets[row["part"]] = at
        at += row["n_ids"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = held.value
        for batch in batches:
            for row in batch.to_pylist():
                ids, sizes = decode_block(row["payload"], code)
                ends = np.cumsum(sizes)
                view = memoryview(ids.astype("<u4").tobytes())
                keys = [int(k) if k else None for k in row["doc_ids"].decode().split("\n")]
                starts = offsets[row["part"]] + row["local_start"] + ends - sizes
                crc = [zlib.crc32(view[4 * (b - n):4 * b]) for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(starts), pa.array(sizes), pa.array(crc, pa.int64())],
                    names=[f.split()[0] for f in DECODED.split(", ")])

    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    return blocks.select("part", "local_start", "doc_ids", "payload").mapInArrow(decode, DECODED)


def token_round_trip(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Write all documents to a fresh folder and read the files back."""
    folder = scratch(docs.sparkSession, "token-files")
    write_token_files(docs, folder, path, end_id)
    return read_token_files(docs.sparkSession, folder)
