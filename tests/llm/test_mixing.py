"""Source mixing: targets by plain water filling, exact totals, bounds, even order, repeatability, odd inputs."""

import random
from collections import Counter

from pyspark.sql import functions as F
from test_pipeline import targets

from rareclass.llm.mixing import mixed_texts, mixture, taken_words

SCHEMA = "doc_id long, text string, source string"


def rows_of(seed=3):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.choice((0, 1, 7, 60, 500))), rng.choice(("hot", "hot", "hot", "a", "B", "é", "zz", "tiny", None))) for i in range(400)]
    return rows + [(1000, None, "a"), (1001, "", None), (1002, "x\t y\x0bz\n", "only"), (1003, "", "empty"), (1004, "w " * 30_000, "long")]


def results(df, **settings):
    return sorted((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in taken_words(*mixture(df, **settings)).collect())


def test_targets_and_totals(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("x")).withColumn("slot", F.lit(1)).repartition(5)
    by_block = [results(df, block_words=b) for b in (64, 1024)]
    size, sources = Counter(), {i: s for i, _, s in rows}
    words = {i: len((t or "").encode().split()) for i, t, _ in rows}
    for i, s in sources.items():
        size[s] += words[i]
    goal = targets({s: size[s] for s in set(sources.values())})
    for got in by_block:
        assert [r[:2] for r in got] == sorted((i, words[i]) for i in sources)
        taken = Counter()
        for i, n, source_size, target, k in got:
            s = sources[i]
            assert source_size == size[s] and abs(target - goal[s]) < 1e-3 and 0 <= k <= 3 * n
            taken[s] += k
        assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)
    assert results(df.repartition(2), block_words=64) == by_block[0]


def test_schedule_is_even(spark):
    df = spark.createDataFrame([(i, "w " * 50, "abc"[i % 3]) for i in range(900)], SCHEMA)
    _, pieces = mixture(df, block_words=50)
    order = [r["source"] for r in pieces.groupBy("slot").agg(F.first("source").alias("source")).orderBy("slot").collect()]
    share = {s: n / len(order) for s, n in Counter(order).items()}
    for at in range(100, len(order), 100):
        seen = Counter(order[:at])
        assert all(abs(seen[s] - share[s] * at) < 6 for s in share)


def test_pieces_are_whole_passes(spark):
    df = spark.createDataFrame(rows_of(), SCHEMA)
    placed, pieces = mixture(df, block_words=100)
    spans = {}
    for r in pieces.collect():
        spans.setdefault((r["source_key"], r["place"], r["epoch"]), []).append((r["start"], r["length"], r["size"]))
    for parts in spans.values():
        at = 0
        for start, length, size in sorted(parts):
            assert start == at and length > 0
            at += length
            assert at <= size


def test_odd_tables(spark):
    assert taken_words(*mixture(spark.createDataFrame([], SCHEMA))).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (None, "", None)], SCHEMA)
    assert [r["taken"] for r in taken_words(*mixture(nothing)).collect()] == [0, 0] and mixed_texts(nothing).count() == 0
    same = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (None, "d", None)], SCHEMA)
    got = taken_words(*mixture(same)).collect()
    assert len(got) == 3 and sum(r["taken"] for r in got) == 7
    assert Counter(r["text"] for r in mixed_texts(same).collect()) == Counter({"a b": 2, "d": 2})
