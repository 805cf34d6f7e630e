"""Archives written and read back, the reader on damaged files, and revisits against a plain reading of the rule."""

import gzip
import hashlib
import io
import re
import zlib

import pytest

from rareclass.llm.warc import CHUNK, BrokenArchive, read_archives, read_records, record, round_trip, unresolved, write_archives

SCHEMA = "page_id long, url string, html string, digest string, n int"
DATE = "2024-01-01T00:00:00Z"


def plain(rows):
    out = []
    first = {}
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(i, first.get(data, i))
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        to = first.get(data)
        again = i is not None and to is not None and i > to
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=repr)


def pages():
    same, short = "<p>" + "é" * 60 + "</p>", "<p>short</p>"
    rows = [(i, f"http://h/{i}", same if i % 3 == 0 else short if i % 3 == 1 else f"<p>{'page %d ' % i * 30}</p>", "x", 1) for i in range(3, 300)]
    return rows + [(1, None, None, "x", 1), (2, "http://h/a b\r\nWARC-Type: x>", "", "x", 1), (2, "u", "", "x", 1), (500, "http://h/long", "ab\r\n\r\n" * 700_000, "x", 1),
                   (501, "http://h/long", "ab\r\n\r\n" * 700_000, "x", 1), (None, "http://h/none", same, "x", 1), (None, None, None, None, None),
                   (3, "http://h/3", same, "x", 1), (9, "http://h/9", same, "x", 1), (600, "http://h/é", "a" * 100, "x", 1), (601, "", "a" * 100, "x", 1),
                   (602, "", "b" * 99, "x", 1), (603, "", "b" * 99, "x", 1)]


def test_round_trip(spark):
    rows = pages()
    got = round_trip(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows)
    assert round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_files_are_gzip_members_and_keep_payloads(spark):
    rows = pages()
    manifest = write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3), file_bytes=5_000)
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows) and manifest.count() > 3
    found = read_archives(spark, manifest).collect()
    want = {i: (html or "").encode() for i, _, html, *_ in rows if i is not None}
    assert all(bytes(r["payload"]) == want[r["page_id"]] for r in found if r["record_type"] == "response" and r["page_id"] is not None)
    assert all(r["payload"] is None for r in found if r["record_type"] == "revisit")
    first = manifest.first()["path"].removeprefix("file:")
    with open(first, "rb") as f:
        raw = f.read()
    assert gzip.decompress(raw).startswith(b"WARC/1.1\r\n")
    at = {r["position"] for r in found if r["path"].endswith(first.rsplit("/", 1)[1])}
    for p in at:  # every record can be read from its own place
        assert zlib.decompressobj(31).decompress(raw[p:]).startswith(b"WARC/1.1\r\n")


def archive(*payloads):
    return b"".join(record("response", i, f"http://h/{i}", p, hashlib.sha256(p).hexdigest(), None, DATE) for i, p in enumerate(payloads))


def test_reader_works_in_pieces():
    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, 7))

    payloads = [b"", b"x" * (3 * CHUNK + 5), b"\r\n\r\nWARC/1.1\r\n", bytes(range(256)) * 9]
    for source in (io.BytesIO(archive(*payloads)), Slow(archive(*payloads))):
        found = list(read_records(source))
        assert [r.payload for r in found] == payloads and [r.payload_bytes for r in found] == [len(p) for p in payloads]
    assert [r.payload for r in read_records(io.BytesIO(archive(*payloads)), payloads=False)] == [None] * 4
    assert list(read_records(io.BytesIO(b""))) == []


def repacked(change):
    body = gzip.decompress(archive(b"some payload"))
    return gzip.compress(change(body))


@pytest.mark.parametrize("data", [
    archive(b"abc")[:-9], archive(b"abc")[:20], b"no gzip at all", repacked(lambda b: b.replace(b"some payload", b"same payload")),
    repacked(lambda b: re.sub(rb"Content-Length: \d+(?=\r\n\r\nHTTP)", b"Content-Length: 90", b)), repacked(lambda b: b.replace(b"WARC/1.1", b"XARC/1.1")),
    repacked(lambda b: b[:-2]), repacked(lambda b: b + b"x"), repacked(lambda b: b[:60]), archive(b"abc") + b"tail"])
def test_damage_is_an_error(data):
    with pytest.raises(BrokenArchive):
        list(read_records(io.BytesIO(data)))


def test_lost_files_and_lost_responses_are_errors(spark):
    rows = [(i, "u", "z" * 200, "x", 1) for i in range(4)]
    manifest = write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    with pytest.raises(Exception, match="records"):
        read_archives(spark, manifest.selectExpr("path", "records + 1 AS records", "bytes")).collect()
    records = read_archives(spark, manifest)
    assert unresolved(records).count() == 0
    assert [r["n"] for r in unresolved(records.filter("record_type = 'revisit'")).collect()] == [3]
