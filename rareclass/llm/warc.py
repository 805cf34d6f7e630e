"""WARC archives: one gzip member per record, revisit records for repeated payloads, and a sequential reader (operator 12)."""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rareclass.llm.shared import bounded_batches, local_path, scratch, stored

MANIFEST = "path string, records long, bytes long"
RECORDS = ("path string, position long, record_type string, record_id string, page_id long, uri string, payload_bytes long, "
           "payload_digest string, refers_to long, payload binary")
#: Payloads below this many bytes are always written whole.
LEAST_REVISIT = 100
CHUNK = 1 << 20
_ID = "urn:page:"


class BrokenArchive(ValueError):
    """A record that does not follow the format or does not match its digest."""


# ---------------------------------------------------------------- which pages revisit others


def marked(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, uri, payload, digest, refers_to): of rows with equal payloads of ``least`` bytes or more the smallest id has no
    ``refers_to``, every larger one names it.

    Only digests with more than one row join back. The few that hold a thousandth of all rows or more are broadcast (at most 1,024 by
    count), and their rows and those of small payloads take the other join under a spread key, so no payload gathers its copies in one task.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("uri"),
                        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")) \
        .withColumn("digest", F.sha2("payload", 256)).withColumn("_large", F.octet_length("payload") >= least)
    narrow = rows.filter("_large").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    classes = stored(narrow.filter("n > 1 AND first IS NOT NULL"), "warc-classes")
    few = max(2, -(-rows.count() // 1024))
    heavy = classes.filter(F.col("n") >= few).select(F.col("digest").alias("_heavy"), F.col("first").alias("_heavy_first"))
    light = classes.filter(F.col("n") < few).select(F.col("digest").alias("_key"), F.col("first").alias("_light_first"))
    spread = F.concat(F.lit("#"), F.xxhash64("page_id", "uri").cast("string"))
    met = rows.join(F.broadcast(heavy), F.col("_large") & (F.col("digest") == F.col("_heavy")), "left") \
        .withColumn("_key", F.when(F.col("_large") & F.col("_heavy").isNull(), F.col("digest")).otherwise(spread)).join(light, "_key", "left")
    first = F.coalesce("_heavy_first", "_light_first")
    return met.select("page_id", "uri", "payload", "digest", F.when(F.col("page_id") > first, first).alias("refers_to"))


# ---------------------------------------------------------------- writing


@contextmanager
def _opened(folder: str, name: str, mode: str) -> Iterator[BinaryIO]:
    path = local_path(folder)
    if path is not None:
        os.makedirs(path, exist_ok=True)
        with open(f"{path}/{name}", mode) as f:
            yield f
        return
    from pyarrow import fs
    store, base = fs.FileSystem.from_uri(folder)
    if mode == "wb":
        store.create_dir(base, recursive=True)
    with (store.open_output_stream if mode == "wb" else store.open_input_stream)(f"{base}/{name}") as f:
        yield f


def _uri(text: str) -> str:
    """No character that could end a header line or the brackets around it."""
    return "".join(c if c > " " and c not in "<>\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def record(kind: str, page_id: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One gzip member. A revisit holds the response's headers, whose Content-Length is the payload's, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    name = f"{_ID}{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest)}"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_uri(uri)}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
              f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n"), packer.compress(block), packer.compress(b"\r\n\r\n"), packer.flush()])


def write_archives(pages: DataFrame, least: int = LEAST_REVISIT, file_bytes: int = 256 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html) to the shared folder; returns the manifest (path, records, bytes).

    A task writes its rows to files of its own, a new one after ``file_bytes``. Names carry the attempt, and only files of the
    manifest count, so an attempt that was lost or ran twice leaves nothing that is read. A null ``html`` is an empty payload. A row without
    ``page_id`` is a response that nothing refers to. Rows that share id and payload are alike: all responses or all revisits. A null
    ``url`` leaves the header out; white space and control characters in it are written as %XX.
    """
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        start = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        rows = ((batch, i) for batch in batches for i in range(batch.num_rows))
        row = next(rows, None)
        number = 0
        while row is not None:
            name, records, size = f"{start}-{number}.warc.gz", 0, 0
            number += 1
            with _opened(folder, name, "wb") as f:
                while row is not None and size < file_bytes:
                    batch, i = row
                    page_id, uri, payload, digest, refers_to = (c[i].as_py() for c in batch.columns)
                    data = record("response" if refers_to is None else "revisit", page_id, uri, payload, digest, refers_to, date)
                    f.write(data)
                    records, size = records + 1, size + len(data)
                    row = next(rows, None)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([records]), pa.array([size])],
                                             names=["path", "records", "bytes"])

    return stored(marked(pages, least).mapInArrow(run, MANIFEST), "warc-manifest")


# ---------------------------------------------------------------- reading


class Record(NamedTuple):
    """Headers by lower-case name (of the record and of the HTTP message) and what was measured while reading."""

    position: int
    kind: str
    headers: dict[str, str]
    http: dict[str, str]
    payload_bytes: int
    payload_digest: str
    payload: bytes | None


class Members:
    """The bytes of one gzip member after another, inflated as they are asked for."""

    def __init__(self, source: BinaryIO) -> None:
        self.source, self.raw, self.inflated, self.used = source, b"", bytearray(), 0
        self.packer = None

    def start(self) -> bool:
        """Go to the next member; False at the end of the file."""
        self.raw = self.raw or self.source.read(CHUNK)
        self.position = self.used
        self.packer = zlib.decompressobj(31)
        return bool(self.raw)

    def fill(self) -> bool:
        """Inflate some more of this member; False at its end."""
        while not self.packer.eof:
            before = len(self.raw)
            try:
                got = self.packer.decompress(self.raw, CHUNK)
            except zlib.error as e:
                raise BrokenArchive(f"the member at {self.position}: {e}") from e
            self.raw = self.packer.unused_data if self.packer.eof else self.packer.unconsumed_tail
            self.used += before - len(self.raw)
            if got:
                self.inflated += got
                return True
            if not self.raw and not self.packer.eof:
                self.raw = self.source.read(CHUNK)
                if not self.raw:
                    raise BrokenArchive(f"the member at {self.position} is cut off")
        return False

    def head(self, limit: int = 1 << 20) -> dict[str, str]:
        """Header lines up to an empty one, by lower-case name; the first line under ''."""
        while (end := self.inflated.find(b"\r\n\r\n")) < 0:
            if len(self.inflated) > limit or not self.fill():
                raise BrokenArchive(f"the member at {self.position} has no end of headers")
        first, *lines = bytes(self.inflated[:end]).decode("utf-8", "replace").split("\r\n")
        del self.inflated[:end + 4]
        return {"": first} | {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}

    def take(self, size: int) -> Iterator[bytes]:
        """Exactly ``size`` bytes, in pieces."""
        while size:
            if not self.inflated and not self.fill():
                raise BrokenArchive(f"the record at {self.position} is {size} bytes short")
            piece = bytes(self.inflated[:size])
            del self.inflated[:size]
            size -= len(piece)
            yield piece


def _length(headers: dict[str, str], position: int) -> int:
    text = headers.get("content-length", "")
    if not text.isdecimal():
        raise BrokenArchive(f"the record at {position} has no content length")
    return int(text)


def read_records(source: BinaryIO, payloads: bool = True) -> Iterator[Record]:
    """Records of an archive in order, each framed by its content length inside its own gzip member.

    Nothing but headers and one chunk of a record is held unless ``payloads`` are kept. Both digests are verified while the block
    passes; of a revisit the block only, as its payload lies in another record.
    """
    members = Members(source)
    while members.start():
        at = members.position
        headers = members.head()
        if not headers[""].startswith("WARC/"):
            raise BrokenArchive(f"the member at {at} is no record")
        kind, size = headers.get("warc-type", ""), _length(headers, at)
        block, body, kept, n = hashlib.sha256(), hashlib.sha256(), [], 0
        http: dict[str, str] = {}
        head, in_body = bytearray(), not headers.get("content-type", "").startswith("application/http")
        for piece in members.take(size):
            block.update(piece)
            if not in_body:
                head += piece
                end = head.find(b"\r\n\r\n")
                if end < 0:
                    continue
                first, *lines = bytes(head[:end]).decode("utf-8", "replace").split("\r\n")
                http = {"": first} | {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
                piece, in_body = bytes(head[end + 4:]), True
            body.update(piece)
            n += len(piece)
            if payloads:
                kept.append(piece)
        if not in_body:
            raise BrokenArchive(f"the record at {at} has no HTTP headers")
        if b"".join(members.take(4)) != b"\r\n\r\n" or members.inflated or members.fill():
            raise BrokenArchive(f"the record at {at} does not end where its length says")
        stated = headers.get("warc-payload-digest", "").removeprefix("sha256:")
        if headers.get("warc-block-digest", "").removeprefix("sha256:") != block.hexdigest() or (kind != "revisit" and stated != body.hexdigest()):
            raise BrokenArchive(f"the record at {at} does not match its digest")
        if kind == "revisit":
            yield Record(at, kind, headers, http, _length(http, at), stated, None)
        else:
            yield Record(at, kind, headers, http, n, stated, b"".join(kept) if payloads else None)


def _page(name: str | None) -> int | None:
    text = (name or "").strip("<>")
    return int(text.removeprefix(_ID)) if text.startswith(_ID) else None


def read_archives(spark: SparkSession, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of all files of a manifest (see :data:`RECORDS`); a broken or missing record is an error.

    ``payload`` is null unless ``payloads`` is set, and null for revisits.
    """
    files = manifest.select("path", "records").repartition(max(1, min(manifest.count(), 4096)), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                folder, _, name = path.rpartition("/")
                rows, held, seen = [], 0, 0
                with _opened(folder, name, "rb") as f:
                    for r in read_records(f, payloads):
                        rows.append((path, r.position, r.kind, r.headers.get("warc-record-id", "").strip("<>"), _page(r.headers.get("warc-record-id")),
                                     r.headers.get("warc-target-uri"), r.payload_bytes, r.payload_digest, _page(r.headers.get("warc-refers-to")), r.payload))
                        held, seen = held + 512 + len(r.payload or b""), seen + 1
                        if held > 8 << 20:
                            yield _rows(rows)
                            rows, held = [], 0
                if seen != records:
                    raise BrokenArchive(f"{path} holds {seen} records of {records}")
                if rows:
                    yield _rows(rows)

    return files.mapInArrow(run, RECORDS)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])


def unresolved(records: DataFrame) -> DataFrame:
    """(refers_to, payload_digest, payload_bytes, n) of revisits without a response of that page, digest and length.

    Revisits are counted before the join, so a payload with very many copies is one row.
    """
    keys = ["refers_to", "payload_digest", "payload_bytes"]
    asked = records.filter("record_type = 'revisit'").groupBy(*keys).agg(F.count("*").alias("n"))
    given = records.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes")
    return asked.join(given, keys, "left_anti")


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as the written archives say, every digest verified."""
    records = stored(read_archives(pages.sparkSession, write_archives(pages), payloads=False).drop("payload", "path", "record_id", "uri"), "warc-records")
    lost = unresolved(records).first()
    if lost is not None:
        raise BrokenArchive(f"page {lost['refers_to']} is referred to but has no such response")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
