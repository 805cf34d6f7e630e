"""Pipeline stages on a small corpus with planted cases, each against a plain reading of its rule."""

import random
import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from rareclass.llm.shared import stored

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    words = {"en": "the and of house garden water with this that were under town they".split(),
             "fr": "le la les maison avec jardin dans une fille était sous ville elle".split()}
    rare = [f"z{i}q" for i in range(3000)]
    rows, labels = [], []
    for i in range(400):
        lang = rng.choice(("en", "fr"))
        text = rng.choices(words[lang], k=40) + rng.choices([w.replace("z", "th").replace("q", "ing") for w in rare], k=6)
        rng.shuffle(text)
        toxic = i % 5 == 0
        if toxic:
            for k in (3, 17, 29):
                text[k] = rng.choice(("moron", "loser", "scumbag"))
        rows.append((i, " ".join(text), lang, f"s{min(i % 9, 4)}"))
        labels.append((i, int(toxic)))
    base = rows[1][1].split()
    for k in range(6):
        copy = list(base)
        copy[k] = "changed"
        rows.append((500 + k, " ".join(copy), "en", "s1"))
    rows += [(600, rows[2][1].upper() + " !", "en", "s2"), (601, None, "en", "s0"), (602, "", None, None), (603, "123 !!", "en", "s1"),
             (604, "the house and the garden with a losser and a moronn and scumbagg", "en", "s1"), (605, " ".join(words["en"] * 400), "en", None),
             (606, "under this house with water and the town garden they were", None, "s3")]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def results(spark, corpus):
    docs, out = spark.read.parquet(f"{corpus}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, corpus), f"test-{name}")
        out.append((docs, after))
        docs = after
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns_stay(results):
    for before, after in results[:-1]:
        assert after.dtypes == before.dtypes


def test_language_and_toxicity(results):
    before, after = results[0]
    assert set(ids(before)) - set(ids(after)) == {601, 602, 603}
    before, after = results[1]
    gone = set(ids(before)) - set(ids(after))
    assert gone == {i for i in range(400) if i % 5 == 0} | {604}


def test_near_copies(results):
    before, after = results[2]

    def grams(t):
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {r["doc_id"]: grams(r["text"]) for r in before.collect()}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    assert ids(after) == sorted(i for i in sets if root[i] == i)
    assert not {500, 600} & set(ids(after))


def test_mix(results):
    before, after = results[3]

    def n(t):
        return len(re.findall(rb"[^\x20\x09-\x0D]+", t.encode()))

    size, taken, words = Counter(), Counter(), {}
    for r in before.collect():
        size[r["source"]] += n(r["text"])
        words[r["doc_id"]] = r["text"].split()
    copies = Counter()
    for r in after.collect():
        taken[r["source"]] += n(r["text"])
        copies[r["doc_id"]] += n(r["text"])
        assert r["text"].split() == words[r["doc_id"]][:n(r["text"])] and r["n_chars"] == len(r["text"])
    assert all(copies[i] <= 3 * len(words[i]) for i in copies)
    goal = targets(size)
    assert {s: int(goal[s] + 1e-6) for s in size} == {s: taken[s] for s in size}


def targets(size):
    """Water filling as its rule says it: share by weight, stop at three times the size, share the excess again."""
    names = sorted((s for s in size if s is not None)) + [s for s in size if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    goal, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(size.values()))
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s, v in share.items():
            goal[s] += v
            if goal[s] >= 3 * size[s]:
                left += goal[s] - 3 * size[s]
                goal[s] = 3.0 * size[s]
                open_.discard(s)
    return goal


def test_packing(results):
    before, after = results[4]
    total = Counter()
    for r in after.collect():
        total[r["sequence_id"]] += r["length"]
    assert all(v == 2048 for k, v in total.items() if k != max(total)) and set(total) == set(range(len(total)))
    assert {r["doc_id"] for r in after.collect()} == set(ids(before))


def test_odd_rows_and_empty_tables(spark, corpus):
    rows = [(None, "the house and the garden of the town", "en", None, 1), (7, "le jardin dans la maison de la ville", "fr", "a", 1),
            (7, "le jardin dans la maison de la ville", "fr", "a", 1), (None, None, None, None, None), (9, "", "en", "b", 0)]
    for data in (rows, [], rows[3:]):
        docs = spark.createDataFrame(data, COLUMNS)
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, corpus), "odd")
        assert (docs.count() > 0) == (data is rows)
    wide = spark.createDataFrame(rows, COLUMNS)
    for name in ("score", "size", "key", "node", "slot", "_rank", "lang_pred", "taken", "part", "ids"):
        wide = wide.withColumn(name, F.lit(name))
    columns = wide.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        wide = stored(stage(spark, wide, corpus), "wide")
        assert wide.columns == columns
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, COLUMNS), corpus).collect()
    assert Counter(r["doc_id"] for r in got) == Counter({None: 2, 7: 1, 9: 1})


def test_run_is_the_stages(spark, corpus, results):
    got = corpus_pipeline.run(spark, corpus)
    assert got.columns == results[-1][1].columns
    assert got.agg(F.sum("length")).first()[0] == results[-1][1].agg(F.sum("length")).first()[0]
