"""The bigram model against a plain reading of its definition."""

import math
import random
import zlib
from collections import Counter, defaultdict

from rareclass.llm.lm import discounts, score_corpus


def tokens_of(text):
    return (text or "").encode().lower().split() + [None]


def brute(rows):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    unigram, pairs = Counter(), Counter()
    for i, text in rows:
        if not held[i]:
            toks = tokens_of(text)
            unigram.update(toks)
            pairs.update(zip([b"<s>"] + toks[:-1], toks))
    n, v = sum(unigram.values()), len(unigram)
    before, total, kinds = Counter(), Counter(), defaultdict(lambda: [0, 0, 0])
    for (a, b), c in pairs.items():
        before[b] += 1
        total[a] += c
        kinds[a][min(c, 3) - 1] += 1
    high = discounts(*[sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)])
    low = discounts(*[sum(c == k for c in before.values()) for k in (1, 2, 3, 4)])
    all_before = sum(before.values())
    spare = sum(low[min(c, 3) - 1] for c in before.values()) / all_before if all_before else 1.0

    def q(w):
        c = before.get(w, 0)
        return (c - low[min(c, 3) - 1] if c else 0) / max(all_before, 1) + spare / (v + 1)

    def p(a, w):
        if not total.get(a):
            return q(w)
        c = pairs.get((a, w), 0)
        d = high[min(c, 3) - 1] if c else 0
        return (c - d) / total[a] + sum(x * y for x, y in zip(high, kinds[a])) / total[a] * q(w)

    out = {}
    for i, text in rows:
        toks = tokens_of(text)
        base = sum(math.log10((unigram.get(t, 0) + 1) / (n + v + 1)) for t in toks)
        model = sum(math.log10(p(a, w)) for a, w in zip([b"<s>"] + toks[:-1], toks))
        out[i] = (held[i], len(toks), sum(t in unigram for t in toks), n, base, model)
    return out, (p, unigram, v)


def check(spark, rows):
    want, _ = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in score_corpus(df).collect()}
    assert set(got) == set(want)
    for i, (held, n, known, train, base, model) in want.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, train)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r["score"], model, rel_tol=1e-9, abs_tol=1e-9)


def test_against_definition(spark):
    random.seed(3)
    words = ["a", "B", "b", "cc", "dé", "e,", "f", "x" * 3000] + [f"w{i}" for i in range(40)]
    rows = [(i, " \t".join(random.choices(words, weights=range(len(words), 0, -1), k=random.randint(0, 60)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "  \n "), (203, "É \x1c x\x0by"), (204, "never seen words here")]
    check(spark, rows)


def test_tiny_and_empty(spark):
    check(spark, [(0, "one"), (1, None)])
    assert score_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_probabilities_sum_to_one():
    rows = [(i, "a b a c b a " * (i % 3 + 1) + f"z{i}") for i in range(30)]
    _, (p, unigram, v) = brute(rows)
    for context in (b"<s>", b"a", b"never"):
        assert math.isclose(sum(p(context, w) for w in [*unigram, b"unknown"]), 1.0, rel_tol=1e-9)


def test_repeated_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 0.5, True)] * 3 + [(None, "a", 0.1, False)],
                               "doc_id long, text string, score double, held_out boolean")
    got = score_corpus(df).collect()
    assert len(got) == 4 and len({r["score"] for r in got if r["doc_id"] == 1}) == 1
