"""Boosted trees against a plain recursive booster, in one task and level by level; flat scoring against walking each tree."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rareclass.operators import boosting as b
from rareclass.operators import trees as t
from rareclass.operators.groupfit import select_prefix
from rareclass.plans.grouped import round_weights

SCHEMA = "row_id long, client_id int, label int, features array<double>"


def rows_of(n=400, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        x = [float(rng.integers(0, 9)), round(float(rng.normal()), 1), float(rng.integers(0, 2))]
        out.append((i, int(rng.choice([1, 1, 1, 2])), int(rng.random() < 1 / (1 + math.exp(-(x[0] - 4 + 2 * x[1])))), x))
    return out + [(n + i, 9, 1, [1.0, 2.0, 0.0]) for i in range(5)]


def plain(rows, trees, depth, rate=0.1, penalty=1.0, least=1.0):
    """Nested tuples (feature, cut, below, above) or leaf values, grown by trying every value of every feature."""
    margin = {r[0]: 0.0 for r in rows}
    values = [sorted({r[3][j] for r in rows}) for j in range(3)]
    out = []

    def grow(own, g, h, left):
        G, H = sum(g[r[0]] for r in own), sum(h[r[0]] for r in own)
        best = None
        for j in range(3) if left else ():
            for cut in values[j][1:]:
                low = [r for r in own if r[3][j] < cut]
                gl, hl = sum(g[r[0]] for r in low), sum(h[r[0]] for r in low)
                if hl < least * b.SCALE or H - hl < least * b.SCALE:
                    continue

                def worth(a, c):
                    return (a / b.SCALE) ** 2 / (c / b.SCALE + penalty)
                gain = worth(gl, hl) + worth(G - gl, H - hl) - worth(G, H)
                if gain > 1e-9 and (best is None or gain > best[0]):
                    best = gain, j, cut
        if best is None:
            value = -rate * (G / b.SCALE) / (H / b.SCALE + penalty)
            for r in own:
                margin[r[0]] += value
            return value
        _, j, cut = best
        return j, cut, grow([r for r in own if r[3][j] < cut], g, h, left - 1), grow([r for r in own if not r[3][j] < cut], g, h, left - 1)

    for _ in range(trees):
        p = {i: 1 / (1 + math.exp(-m)) for i, m in margin.items()}
        g = {r[0]: round((p[r[0]] - r[2]) * b.SCALE) for r in rows}
        h = {i: round(q * (1 - q) * b.SCALE) for i, q in p.items()}
        out.append(grow(rows, g, h, depth))
    return out, margin


def walk(tree, x):
    while isinstance(tree, tuple):
        j, cut, below, above = tree
        tree = below if x[j] < cut else above
    return tree


@pytest.mark.parametrize("task_cells", [1 << 22, 0])
def test_same_trees_as_plain_booster(spark, task_cells):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    forest = b.fit_forest(df, settings=b.Settings(trees=4, depth=3), task_cells=task_cells, store_every=2)
    loaded = b.load(forest)
    assert set(loaded) == {1, 2}  # the client with one class has none
    for c, trees in loaded.items():
        own = [r for r in rows if r[1] == c]
        # bins come from the rows of all clients, so cuts may lie between two values of one client
        want, margin = plain_with_cuts(own, rows, 4, 3)
        got = b.leaf_values(np.array([r[3] for r in own]), trees)
        assert np.allclose(got, [[walk(tree, r[3]) for tree in want] for r in own], atol=1e-12)
        assert np.allclose(got.sum(axis=1), [margin[r[0]] for r in own], atol=1e-12)


def plain_with_cuts(own, rows, trees, depth):
    marks = [sorted({r[3][j] for r in rows}) for j in range(3)]
    place = [{v: float(i) for i, v in enumerate(m)} for m in marks]
    moved = [(r[0], r[1], r[2], [place[j][v] for j, v in enumerate(r[3])]) for r in own]
    filled = moved  # ties between cuts with no own value between go to the lowest: a cut is the first value above
    found, margin = plain(filled, trees, depth)

    def back(tree):
        if not isinstance(tree, tuple):
            return tree
        j, cut, below, above = tree
        return j, marks[j][int(cut)], back(below), back(above)
    return [back(tree) for tree in found], margin


def test_both_ways_agree_with_subsampling(spark):
    df = spark.createDataFrame(rows_of(900), SCHEMA)
    s = b.Settings(trees=7, depth=4, subsample=0.7)
    alone = b.fit_forest(df.repartition(3), row_id="row_id", settings=s).orderBy("client_id", "tree").collect()
    together = b.fit_forest(df.repartition(7), row_id="row_id", settings=s, task_cells=0, store_every=3).orderBy("client_id", "tree").collect()
    assert alone == together and len(alone) == 14
    assert alone != b.fit_forest(df, row_id="row_id", settings=s._replace(subsample=1.0)).orderBy("client_id", "tree").collect()


def test_many_bins_missing_values_and_empty(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 1, int(i % 3 == 0), [float(rng.normal()), float("nan") if i % 3 == 0 else 0.5, None if i % 7 == 0 else 1.0]) for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    cuts = b.cut_points(df, bins=16)
    assert [len(c) for c in cuts] == [15, 0, 0]
    ordered = sorted(r[3][0] for r in rows)
    inside = np.histogram(ordered, [-np.inf, *cuts[0], np.inf])[0]
    assert inside.sum() == 500 and inside.max() <= 33
    forest = b.fit_forest(df, settings=b.Settings(trees=20, depth=2, bins=16))
    assert forest.count() == 20
    assert b.fit_forest(df.limit(0)).count() == 0
    assert b.fit_forest(df.where("label = 0")).count() == 0


def test_margins_and_prefixes(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA)
    forest = t.fit_boosters(df, row_id="row_id", iterations=6, depth=3)
    loaded = b.load(forest)
    wide = b.tree_margins(forest, [9, 2, 1], df)  # 9 has no trees: the first that has some stands in
    assert wide.columns == [*df.columns, "margins"]
    for r in wide.collect():
        x = np.array([r["features"]])
        want = np.concatenate([b.leaf_values(x, loaded[2])[0], b.leaf_values(x, loaded[2])[0], b.leaf_values(x, loaded[1])[0]])
        assert np.array_equal(r["margins"], want)
    parts = [select_prefix(b.tree_margins(forest, [c], df).select(F.lit(c).alias("client_id"), "label", "margins"), keys=["client_id"]) for c in (1, 2)]
    want = {r["client_id"]: (r["prefix"], r["auprc"]) for p in parts for r in p.collect()}
    got = {r["client_id"]: (r["prefix"], r["auprc"]) for r in t.best_prefix(forest, df).collect()}
    assert {c: p for c, (p, _) in got.items()} == {c: p for c, (p, _) in want.items()}
    assert all(abs(got[c][1] - want[c][1]) < 1e-12 for c in want)
    one_class = {r["client_id"]: (r["prefix"], r["auprc"]) for r in t.best_prefix(forest, df.where("label = 1")).collect()}
    assert one_class == {1: (6, 0.0), 2: (6, 0.0)}


def test_equal_rows_of_a_large_client_are_grown_in_one_task(spark, monkeypatch):
    rows = [(k * 1000 + r[0], *r[1:]) for k in range(6) for r in rows_of()]
    df = spark.createDataFrame(rows, SCHEMA)
    how = dict(row_id="row_id", settings=b.Settings(4, depth=3))
    whole = sorted(tuple(map(str, r)) for r in b.fit_forest(df, **how).collect())

    def never(*_):
        raise AssertionError("level by level")
    monkeypatch.setattr(b, "_grow_together", never)
    assert sorted(tuple(map(str, r)) for r in b.fit_forest(df, task_cells=1500, **how).collect()) == whole


def test_drawn_equal_rows_of_a_large_client_are_grown_in_one_task(spark, monkeypatch):
    rows = [(k * 1000 + r[0], *r[1:]) for k in range(6) for r in rows_of()]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    how = dict(row_id="row_id", settings=b.Settings(4, depth=3, subsample=0.7))
    together = sorted(tuple(map(str, r)) for r in b.fit_forest(df, task_cells=0, **how).collect())

    def never(*_):
        raise AssertionError("level by level")
    monkeypatch.setattr(b, "_grow_together", never)
    assert sorted(tuple(map(str, r)) for r in b.fit_forest(df, task_cells=2000, **how).collect()) == together
    assert sorted(tuple(map(str, r)) for r in b.fit_forest(df, **how).collect()) == together


def test_stack_is_fitted_on_places_instead_of_rows(spark):
    rows = [(k * 1000 + r[0], r[1], r[2], [r[3][0], r[3][1], None if r[0] % 11 == 0 else r[3][2]]) for k in range(3) for r in rows_of()]
    df = spark.createDataFrame(rows, SCHEMA)
    forest = t.fit_boosters(df, row_id="row_id", iterations=4, depth=3, subsample=0.8)
    whole = b.tree_margins(forest, [1, 2, 9], df, out="stack")
    kinds = b.stacked_kinds(forest, [1, 2, 9], df)
    got = {}
    for r in kinds.collect():
        key = r["client_id"], r["label"], tuple(r["stack"])
        got[key] = got.get(key, 0) + r["times"]
    want = {}
    for r in whole.collect():
        key = r["client_id"], r["label"], tuple(r["stack"])
        want[key] = want.get(key, 0) + 1
    assert got == want and kinds.count() * 3 <= len(rows)
    for kind in ("logistic", "hinge"):
        by_rows, _ = round_weights(whole, [1, 2, 9], 12, kind, rounds=1, vec="stack")
        by_kinds, _ = round_weights(kinds, [1, 2, 9], 12, kind, rounds=1, vec="stack", times="times")
        assert np.allclose(by_rows[-1], by_kinds[-1], atol=1e-7 if kind == "logistic" else 1e-3)
