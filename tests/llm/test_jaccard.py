"""N-gram Jaccard join against brute force, in one block and in many."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rareclass.llm import jaccard
from rareclass.llm.jaccard import choose_bands, common, near_texts, shingle_sets


def grams(text, n=5):
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(rows, threshold=0.8):
    sets = {i: grams(t) for i, t, *_ in rows}
    ids = sorted(sets)
    links = {i: set() for i in ids}
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            a, b = sets[i], sets[j]
            if a and b and len(a & b) / len(a | b) >= threshold:
                links[i].add(j)
                links[j].add(i)
    root = {}
    for start in ids:
        stack = [start]
        while stack:
            k = stack.pop()
            if k not in root:
                root[k] = start
                stack += links[k]
    same = {i: min(j for j in ids if j == i or (sets[j] and sets[j] == sets[i])) for i in ids}
    return {i: (same[i], root[i], len(links[i]), root[i] == i) for i in ids}


def rows_of(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)] + ["Über", "été"]
    passage = rng.choices(words, k=70)
    rows, at = [], 0
    for size, members in ((120, 1), (60, 4), (200, 25), (30, 3), (400, 60), (5, 2), (3, 2), (90, 8)):
        for _ in range(3):
            base = rng.choices(words, k=size) + (passage if size > 80 else [])
            for _ in range(members):
                text = list(base)
                for _ in range(rng.randint(0, max(1, size // 60))):
                    text[rng.randrange(len(text))] = rng.choice(words)
                rows.append((at, rng.choice([" ", ", ", " - "]).join(text)))
                at += 1
    rows += [(at + k, rows[5][1].upper() + "!") for k in range(12)]
    at += 12
    rows += [(at, None), (at + 1, ""), (at + 2, " .. "), (at + 3, ""), (at + 4, "one two"), (at + 5, "One, two"), (at + 6, "one two three")]
    return rows


@pytest.mark.parametrize("weight", [jaccard.BLOCK_WEIGHT, jaccard.ROW_WEIGHT * 9])
def test_against_brute_force(spark, monkeypatch, weight):
    monkeypatch.setattr(jaccard, "BLOCK_WEIGHT", weight)
    rows = rows_of()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("n_links", F.lit("x"))
    got = {r["doc_id"]: (r["class_id"], r["component_id"], r["n_links"], r["kept"]) for r in near_texts(df).collect()}
    want = brute(rows)
    assert {i: v for i, v in got.items() if v != want[i]} == {}
    assert got == want


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    assert near_texts(spark.createDataFrame([], schema)).count() == 0
    got = near_texts(spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (9, "a b c d e f"), (9, "a b c d e f")], schema)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["n_links"], r["kept"]) for r in got) == [
        (0, 0, 0, True), (4, 4, 2, True), (9, 4, 2, False), (9, 4, 2, False)]


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.9), (0.95, 0.999)):
        bands, rows = choose_bands(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= 256


def test_sets_and_intersections():
    texts = ["A b, c d e f", "a b c d e f", "a b", "", "x " * 20_000, "a b c d e f g h"]
    sets = shingle_sets(texts, 5)
    assert [len(s) for s in sets] == [2, 2, 1, 0, 1, 4] and (sets[0] == sets[1]).all()
    some = [s for s in sets if len(s)]
    want = [[len(np.intersect1d(a, b)) for b in some] for a in some]
    got = common(some, columns=2)
    assert all(got[i][j] == want[i][j] for i in range(len(some)) for j in range(len(some)) if i != j)
