"""Language spans: the path against plain dynamic programming, held-out accuracy, odd inputs."""

import numpy as np
from pyspark.sql import functions as F

from rareclass.llm.langid import best_path, identify_corpus

SF = "/root/testdata/sf0.01"


def plain(scores, penalty):
    n, k = scores.shape
    value, back = scores[0].copy(), []
    for t in range(1, n):
        top = value.argmax()
        come = [j if value[j] >= value[top] - penalty else top for j in range(k)]
        value = np.array([max(value[j], value[top] - penalty) for j in range(k)]) + scores[t]
        back.append(come)
    path = [int(value.argmax())]
    for come in reversed(back):
        path.append(int(come[path[-1]]))
    return path[::-1]


def worth(scores, path, penalty):
    return sum(scores[t, p] for t, p in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))


def test_path_is_best():
    rng = np.random.default_rng(0)
    sizes = np.array([0, 1, 5, 40, 0, 300, 7, 2, 90])
    for scale in (0.5, 2.0, 6.0):
        scores = rng.normal(0, scale, (sizes.sum(), 4))
        scores[60:120, 2] += 2
        got = best_path(scores, sizes, 5.0)
        at = 0
        for n in sizes:
            if n:
                part = scores[at:at + n]
                assert np.isclose(worth(part, got[at:at + n], 5.0), worth(part, plain(part, 5.0), 5.0))
            at += n


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = identify_corpus(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_mixed_spans_and_odd_texts(spark):
    en, fr, ru = "the house and the garden of this town were with water ", "le chien est dans la maison avec une fille ", "и вот дом у реки где мы жили "
    rows = [(i, t * 3, lang, 1.0) for i, (t, lang) in enumerate([(en, "en"), (fr, "fr"), (ru, "ru")] * 8)]
    rows += [(100, (en * 4) + (fr * 4) + ru, None, None), (101, None, "fr", 0.0), (102, " 12 34 !!", "en", 0.0), (103, "", None, 0.0),
             (104, "中文字", None, 0.0), (105, "le chien dans la maison", None, 0.0), (105, "le chien dans la maison", None, 0.0), (None, "the house", None, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").withColumn("spans", F.lit(1))
    got = {}
    for r in identify_corpus(df).collect():
        got.setdefault(r["doc_id"], []).append(r)
    mixed = got[100][0]
    assert [s["lang"] for s in mixed["spans"]] == ["en", "fr", "ru"] and mixed["lang_pred"] == "en"
    text = rows[24][1]
    assert text[mixed["spans"][1]["start"]:mixed["spans"][1]["end"]].strip().startswith("le chien")
    assert [(got[i][0]["lang_pred"], got[i][0]["score"]) for i in (101, 102, 103)] == [("und", 0.0)] * 3
    assert got[104][0]["lang_pred"] in ("en", "fr", "ru") and got[104][0]["score"] == 0.0
    assert [r["lang_pred"] for r in got[105]] == ["fr", "fr"] and got[None][0]["lang_pred"] == "en"
    assert not got[None][0]["held_out"]


def test_nothing_to_learn(spark):
    schema = "doc_id long, text string, lang string"
    assert identify_corpus(spark.createDataFrame([], schema)).count() == 0
    got = identify_corpus(spark.createDataFrame([(1, "abc", None)], schema)).first()
    assert (got["lang_pred"], got["score"]) == ("und", 0.0)
