"""The audit against a dense reading of its rule in Python integers, on odd texts, with one fit and with many."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rareclass.llm import divergence
from rareclass.llm.divergence import _split, audit, share

SCHEMA = "doc_id long, text string, lang string, source string, rank int, term string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def dense(rows, min_docs, top=10):
    docs = [((r[2] or ""), (r[3] or ""), TERM.findall((r[1] or "").translate(LOWER))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= min_docs}
        counts = {s: Counter() for s in {d[1] for d in own}}
        for _, s, terms in own:
            counts[s].update(t for t in terms if t in kept)
        whole = Counter()
        for c in counts.values():
            whole.update(c)

        def p(c, t):
            return 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))

        for s, c in counts.items():
            pairs = [(sum((p(c, t) - p(o, t)) ** 2 // (p(c, t) + p(o, t)) for t in kept), i) for i, o in counts.items() if i != s]
            terms = [((p(c, t) - p(whole, t)) ** 2 // (p(c, t) + p(whole, t)), t) for t in kept if c[t] and p(c, t) > p(whole, t)]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, k) for k, (v, i) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out)


def corpus():
    rng = random.Random(4)
    words = ["the", "The", "House", "été", "naïve", "ÉTÉ", "a", "x1y", "𝒳", "don't", "日本", "k_l", "q r", "s\u0085t", "zz\x00yy"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    rows = []
    for i in range(240):
        lang = rng.choice(["en", "en", "en", "fr", None, ""])
        source = rng.choice(["s0"] * 6 + ["s1", "s2", "é", "Z", None, "", "s10"])
        size = rng.choice([0, 1, 5, 30])
        rows.append((i, " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=size)) + rng.choice(["", "!", " \n"]), lang, source, 7, "x"))
    rows += [(900, None, "en", "s1", 1, None), (901, "", "xx", "s1", 1, None), (902, "alone here", "xx", "s2", 1, None), (903, "alone", "yy", None, 1, None),
             (904, "The " * 60_000 + "END", "en", "s2", 1, None)]
    return rows + rows[:20]


@pytest.mark.parametrize("settings", [{}, {"shards": 7, "tile": 3}])
def test_audit_equals_dense_integers(spark, settings):
    rows = corpus()
    got = audit(spark.createDataFrame(rows, SCHEMA), min_docs=10, **settings)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == dense(rows, 10)


def test_empty_table(spark):
    assert audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares_stay_exact_in_large_corpora(spark):
    cases = [(0, 1, 1), (3, 10, 4), (9 * 10**14, 9 * 10**14, 10**6), (123456789012345, 8 * 10**15, 10**9), (10**10, 10**13, 5)]
    df = spark.createDataFrame(cases, "c long, n long, v long")
    got = [r[0] for r in df.select(share(F.col("c"), F.col("n"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in cases]


def test_rows_stand_for_portions_of_documents(spark):
    text, n = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)), 400
    texts = spark.range(n, numPartitions=1).select(F.lit(7).cast("long").alias("gid"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(text).cast("binary").alias("text"))
    cut = _split(texts, 3)
    lists = [F.coalesce(F.size(name), F.lit(0)) for name, kind in cut.dtypes if kind == "array<string>"]
    written = cut.select(F.sum(sum(lists[1:], lists[0]))).first()[0]
    assert written <= 300 * (10 + n.bit_length())


def test_small_portions_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(divergence, "_TERMS", 20)
    monkeypatch.setattr(divergence, "_COUNTS", 50)
    rows = corpus()
    assert sorted(tuple(r) for r in audit(spark.createDataFrame(rows, SCHEMA), min_docs=10).collect()) == dense(rows, 10)
