"""Token ids against the library, packing and token files against brute force and an exact round trip."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rareclass.llm.packing import pack
from rareclass.llm.tokenfile import canonical, code_lengths, decode_block, encode_block, token_round_trip
from rareclass.llm.tokens import WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def coder():
    return WordTokenizer(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(list("abXYéÉñßİıſŉ中한ΣΑ ̄́\t\n\x0b\x1c\x85\xa0 '.,!?19²×<|>_") + ["'re", "<|endoftext|>", " the "]), max_size=30).map("".join), max_size=5))
def test_ids_equal_the_library(coder, texts):
    ids, sizes = coder.encode([t.encode() for t in texts])
    parts = np.split(ids, np.cumsum(sizes)[:-1]) if texts else []
    assert [p.tolist() for p in parts] == [coder.full.encode(t, add_special_tokens=False).ids for t in texts]


def rows_of():
    random.seed(4)
    words = ["the", "house,", "Straße", "x1", "don't", "ththhe", "'s"]
    rows = [(i, " ".join(random.choices(words, k=random.choice((0, 1, 5, 80, 400)))), 1) for i in random.sample(range(1000), 60)]
    return rows + [(2000, None, 2), (2001, "", 2), (2002, "long " * 9000, 2), (2003, "the house", 3), (2004, "the house", 3)]


def ids_of(coder, text):
    return coder.full.encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_round_trip(spark, coder):
    rows = rows_of()
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long").withColumn("start", F.lit("x")).repartition(5)
    got = sorted(map(tuple, token_round_trip(df, PATH).collect()))
    want, at = [], 0
    for i, text, _ in sorted(rows):
        ids = ids_of(coder, text)
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == want


def test_round_trip_of_odd_tables(spark):
    assert token_round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    got = token_round_trip(spark.createDataFrame([(None, None), (7, ""), (7, "")], "doc_id long, text string"), PATH).collect()
    assert sorted((r["start"], r["n_tokens"]) for r in got) == [(0, 1), (1, 1), (2, 1)]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [None, 7, 7]


def test_code_is_optimal_within_its_limit():
    assert code_lengths({5: 1}) == {5: 1} and code_lengths({}) == {}
    rng = random.Random(1)
    for limit in (6, 16):
        counts = {i: rng.choice((1, 2, 50, 3000)) for i in range(60)}
        lengths = code_lengths(counts, limit)
        assert max(lengths.values()) <= limit and sum(2.0**-k for k in lengths.values()) <= 1
    heap = sorted(counts.values())
    cost = 0
    while len(heap) > 1:
        a, b, *heap = heap
        cost += a + b
        heap = sorted([*heap, a + b])
    assert sum(counts[i] * k for i, k in lengths.items()) == cost


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0, 1, 2, 9, 500, 49407]), max_size=90), max_size=6), st.sampled_from((1, 7, 64)))
def test_blocks_round_trip(docs, interval):
    flat = np.array([i for d in docs for i in d], dtype=np.uint32)
    code = canonical(code_lengths({0: 900, 1: 300, 2: 20, 9: 5, 500: 2, 49407: 1}))
    ids, sizes = decode_block(encode_block(flat, np.array([len(d) for d in docs]), code, interval), code)
    assert ids.tolist() == flat.tolist() and sizes.tolist() == [len(d) for d in docs]


def test_packing(spark, coder):
    rows = rows_of()
    pieces = pack(spark.createDataFrame(rows, "doc_id long, text string, length long").repartition(4), PATH, window=256).collect()
    ids = {i: ids_of(coder, t) for i, t, _ in rows}
    placed, seen = {}, {i: [] for i in ids}
    for p in pieces:
        part = ids[p["doc_id"]][p["start"]:p["start"] + p["length"]]
        assert len(part) == p["length"] > 0 and crc(part) == p["ids_crc32"] and p["doc_tokens"] == len(ids[p["doc_id"]])
        placed.setdefault(p["sequence_id"], []).append((p["offset"], p["length"], p["padded_to"]))
        seen[p["doc_id"]].append((p["start"], p["length"]))
    for i, parts in seen.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[i])
    for number, parts in placed.items():
        at = 0
        for offset, length, padded in sorted(parts):
            assert offset == at
            at += length
        assert at == 256 or number == max(placed)
        assert padded == 1 << (at - 1).bit_length()
    assert set(placed) == set(range(len(placed)))


def test_packing_odd_tables(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    got = pack(spark.createDataFrame([(None, None), (3, "a")], "doc_id long, text string").coalesce(1), PATH).collect()
    assert sorted((r["offset"], r["length"], r["padded_to"]) for r in got) == [(0, 1, 4), (1, 2, 4)]
