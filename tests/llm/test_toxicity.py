"""Toxicity: the automaton against plain edit distance, terms and context of hits, held-out results, odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rareclass.llm.lm import held_out
from rareclass.llm.toxicity import FEATURES, Toxicity, Trie, choose_terms, find_terms, fit_logistic, learn, score, score_corpus

SF = "/root/testdata/sf0.1"


def distance(a, b):
    """Edits of the restricted kind (a swapped pair is never edited again)."""
    d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_is_edit_distance():
    random.seed(2)
    terms = ["loser", "moron", "trash", "stupid", "abcabc", "bad", "abcab", "ñandú"]
    trie = Trie(terms)
    words = terms + ["".join(random.choices("abcmoronstñ", k=random.randint(0, 8))) for _ in range(3000)]
    for t in terms:
        words += [t[:i] + c + t[i + k:] for i in range(len(t) + 1) for c in ("", "x", "r") for k in (0, 1)]
        words += [t[:i] + t[i + 1:i + 2] + t[i:i + 1] + t[i + 2:] for i in range(len(t))]
    for w in words:
        near = [i for i, t in enumerate(terms) if w == t or (len(t) >= 5 and distance(w, t) <= 1)]
        exact = terms.index(w) if w in terms else None
        want = (exact, 0) if exact is not None else (min(near), 1) if near else (-1, 0)
        assert trie.match(w) == want, w


def test_hits_and_context(spark):
    model = Toxicity(["idiot", "trash"], [3.0, 2.0], ["trasy"], [0.0] * 9)
    rows = [(1, 'You IDIOT, you are a traash###'), (2, 'He said "what an idiot" once'), (3, "trasy “idiot” idoit."), (4, None), (5, "")]
    got = sorted(tuple(r) for r in find_terms(spark.createDataFrame(rows, "doc_id long, text string"), model).collect())
    assert [(r[0], r[3], r[4], r[5]) for r in got] == [(1, "idiot", 0, False), (1, "trash", 1, False), (2, "idiot", 0, True),
                                                       (3, "idiot", 0, True), (3, "idiot", 1, False)]
    assert got[0][1:3] == (4, 9) and got[0][6] == 2 and got[2][7] == 1


@pytest.fixture(scope="module")
def results(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return score_corpus(docs, labels).join(labels, "doc_id").collect()


def test_held_out_results(results):
    rows = [r for r in results if r["held_out"]]
    caught = np.mean([r["predicted"] for r in rows if r["toxic"] == 1])
    blamed = np.mean([r["predicted"] for r in rows if r["toxic"] == 0])
    assert caught > 0.8 and blamed < 0.01
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in results)


def test_misspelled_terms_are_caught(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    keep = ~held_out(F.col("doc_id"), 5, 0)
    model = learn(docs.filter(keep), labels.filter(keep), sample=3000)
    df = spark.createDataFrame([(1, "the anding stuppid and worthles of loserr ered pathetik"), (2, "the anding and of ered")], "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in score(df, model, F.lit(False)).collect()}
    assert got == {1: 1, 2: 0} and len(model.weights) == len(FEATURES) + 1


def test_odd_tables(spark):
    schema = "doc_id long, text string, score double, toxic int"
    docs = spark.createDataFrame([(1, None, 0.0, 1), (2, "", 0.0, 1), (2, "", 0.0, 1), (None, "a", 0.0, 1)], schema)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert sorted((r["doc_id"] or 0, r["score"], r["predicted"]) for r in score_corpus(docs, none).collect()) == [
        (0, 0.0, 0), (1, 0.0, 0), (2, 0.0, 0), (2, 0.0, 0)]
    some = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    assert score_corpus(docs, some).count() == 4
    assert score_corpus(spark.createDataFrame([], schema), some).count() == 0


def test_terms_and_weights():
    terms, odds = choose_terms([("vile", 40, 1), ("the", 100, 900), ("rare", 3, 0)], 100, 900)
    assert terms == ["vile"] and odds[0] > 2
    x = np.array([[0.0], [0.0], [1.0], [1.0]])
    w = fit_logistic(x, np.array([0.0, 1.0, 1.0, 1.0]))
    p = 1 / (1 + np.exp(-(np.column_stack([x, np.ones(4)]) @ w)))
    gradient = np.column_stack([x, np.ones(4)]).T @ (p - [0, 1, 1, 1]) + 1e-2 * w
    assert np.abs(gradient).max() < 1e-4
