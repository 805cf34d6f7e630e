"""Neighbour joins, segments and trees against brute force, with many small blocks so that every route is taken."""

import numpy as np
import pytest

from rareclass.operators import separability as g
from rareclass.operators.neighbors import knn_join, nearest_segments


def points(spark, x, label, by=None):
    rows = [(int(i), [float(v) for v in x[i]], int(label[i]), int(by[i]) if by is not None else 0) for i in range(len(x))]
    return spark.createDataFrame(rows, "row_id bigint, features array<double>, label int, grp int")


def clustered(n=600, d=4, seed=2):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, d)) * 8
    x = centre[rng.integers(0, 12, n)] + rng.normal(size=(n, d))
    x[: n // 3] = x[0]  # a third of all rows are copies of one row
    return x, (rng.random(n) < 0.3).astype(int), rng.integers(0, 3, n)


def brute(x, q, r, k, exclude):
    out = {}
    for i in q:
        d = np.sqrt(((x[i] - x[r]) ** 2).sum(1))
        order = sorted((dist, j) for dist, j in zip(d, r) if not (exclude and i == j))
        out[i] = order[:k]
    return out


@pytest.mark.parametrize("block_rows", [4096, 40])
def test_knn_is_exact(spark, block_rows):
    x, y, grp = clustered()
    df = points(spark, x, y, grp)
    got = {}
    for r in knn_join(df, df, 4, carry=["label"], by=["grp"], exclude_self=True, block_rows=block_rows).collect():
        got.setdefault(r["query_id"], []).append((r["nn_rank"], r["nn_id"], r["distance"], r["nn_label"]))
    for c in range(3):
        ids = np.nonzero(grp == c)[0]
        for i, want in brute(x, ids, ids, 4, True).items():
            mine = sorted(got[i])
            assert [m[1] for m in mine] == [w[1] for w in want]
            np.testing.assert_allclose([m[2] for m in mine], [w[0] for w in want], atol=1e-12)
            assert [m[3] for m in mine] == [y[w[1]] for w in want]


def test_nearest_segments_over_blocks(spark):
    rng = np.random.default_rng(4)
    ends, pts = rng.normal(size=(24, 3)), rng.normal(size=(40, 3))
    ends[5] = ends[6]  # a zero-length pair
    e, p = points(spark, ends, np.ones(24)), points(spark, pts, np.ones(40))
    got = {r["point_id"]: r for r in nearest_segments(p, e, block_rows=7).collect()}

    def distance(s, i, j):
        ab = ends[j] - ends[i]
        if ab @ ab == 0:
            return np.inf
        t = np.clip((pts[s] - ends[i]) @ ab / (ab @ ab), 0, 1)
        return np.linalg.norm(pts[s] - ends[i] - t * ab)

    for s in range(40):
        best = min(distance(s, i, j) for i in range(24) for j in range(i + 1, 24))
        assert got[s]["residual"] == pytest.approx(best, abs=1e-12)
        assert got[s]["a_id"] < got[s]["b_id"]
        assert distance(s, got[s]["a_id"], got[s]["b_id"]) == pytest.approx(best, abs=1e-12)


def test_spanning_tree_weight(spark):
    x, y, _ = clustered(90)
    one = g.spanning_tree(points(spark, x, y)).collect()
    many = g.spanning_tree(points(spark, x, y), block_rows=45).collect()
    assert len(one) == len(many) == 89
    assert sum(r["distance"] for r in one) == pytest.approx(sum(r["distance"] for r in many))
    root = list(range(90))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for r in many:
        a, b = find(r["a_id"]), find(r["b_id"])
        assert a != b
        root[a] = b


def test_two_clouds(spark):
    rng = np.random.default_rng(0)
    apart = np.vstack([rng.normal(5, 0.3, (200, 4)), rng.normal(-5, 0.3, (200, 4))])
    y = np.repeat([1, 0], 200)
    clear = points(spark, apart, y)
    mixed = points(spark, rng.normal(0, 0.3, (400, 4)), rng.integers(0, 2, 400))
    n3 = [g.n3_error(d).first()["n3"] for d in (clear, mixed)]
    n1 = [g.n1_boundary(d).first()["n1"] for d in (clear, mixed)]
    f1 = [g.fisher_inverse(g.long_features(d)).first()["f1"] for d in (clear, mixed)]
    assert n3[0] < 0.02 and 0.4 < n3[1] < 0.6
    assert n1[0] < 0.1 < n1[1] and f1[0] < f1[1]
    kinds = g.minority_typology(clear).first()
    assert kinds["safe"] == kinds["n_minority"] == 200
    assert g.overlap_coefficient(g.lda_projection(clear)).first()["overlap"] < 0.02


def test_block_tree_with_copies_far_from_the_origin():
    rng = np.random.default_rng(6)
    v = rng.normal(size=(800, 64)) + 100.0
    v[:40] = v[40:80] + rng.normal(size=(40, 64)) * 1e-6  # near copies, and some that are equal
    v[80:90] = v[90]
    a, b, d = g._block_tree(v)
    best, open_, at, total = np.full(800, np.inf), np.ones(800, dtype=bool), 0, 0.0
    open_[0] = False
    for _ in range(799):
        best = np.minimum(best, np.sqrt(((v - v[at]) ** 2).sum(1)))
        at = int(np.where(open_, best, np.inf).argmin())
        open_[at], total = False, total + best[at]
    assert d.sum() == pytest.approx(total, rel=1e-12) and (d == 0).sum() == 10 and len(d) == 799


def test_spanning_tree_takes_few_jobs(spark):
    x, y, _ = clustered(90)
    spark.sparkContext.setJobGroup("tree", "tree")
    try:
        assert len(g.spanning_tree(points(spark, x, y), block_rows=45).collect()) == 89
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("tree")) <= 70  # 94 with a checkpoint per link
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_points_on_segments_are_found_without_all_pairs(monkeypatch):
    from rareclass.operators import neighbors as nb
    rng = np.random.default_rng(3)
    v, owner = rng.normal(size=(1500, 16)) + 20.0, rng.integers(0, 2, 1500)
    v[700] = v[701]  # a zero-length pair
    a, b = rng.integers(0, 1500, 60), rng.integers(0, 1500, 60)
    a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
    t = rng.random(len(a))
    x = v[a] + t[:, None] * (v[b] - v[a])
    x[0] = v[a[0]]  # an end itself: every segment from it is at distance 0, the first one wins
    plain = nb._all_segments
    wide = x[1:6] + rng.normal(size=(5, 16)) * 0.3  # not on a segment: the limit rules less out, or nothing
    for crossing in (False, True):
        want = plain(np.vstack([x[:1], wide]), v, owner, crossing)
        limits = np.array([1e-7, *(want[0][1:4] * 1.01), np.nan, np.inf])
        got = nb.segments_within(np.vstack([x[:1], wide]), limits, v, owner, crossing)
        np.testing.assert_allclose(got[2], want[0], atol=1e-9)
        assert (got[0] == want[1]).all() and (got[1] == want[2]).all()
    assert np.isinf(nb.segments_within(wide, np.full(5, 1e-6), v, owner, False)[2]).all()

    def never(*_):
        raise AssertionError("all pairs compared")
    monkeypatch.setattr(nb, "_all_segments", never)
    i, j, d = nb.segments_within(x[1:], np.full(len(x) - 1, 1e-6), v, owner, False)
    assert (i == a[1:]).all() and (j == b[1:]).all() and d.max() < 1e-12


def test_knn_tasks_are_bounded_and_routes_carry_no_vectors(spark):
    from pyspark.sql import functions as F

    from rareclass.operators import neighbors as nb
    x = np.random.default_rng(8).normal(size=(600, 12))  # bounds rule nothing out, every chunk visits every group
    df = points(spark, x, np.zeros(600))
    q = df.select(F.col("row_id").alias("query_id"), F.col("features").alias("_v"))
    r = df.select(F.col("row_id").alias("nn_id"), F.col("features").alias("_v"))
    left, right, task = nb._visit_blocks(q, r, [], x[:15], 3, 40)
    for side in (left, right):
        assert max(c["count"] for c in side.groupBy(*task).count().collect()) <= 3 * 40
    own = nb._assign(q, x[:15]).withColumnRenamed("_cell", "_own").withColumn("_chunk", F.lit(0).cast("bigint"))
    bounds = nb._pivot_bounds(nb._assign(r, x[:15]).select("_cell", "_rad"), [], 3)
    visits = nb._visits(own, [], x[:15], bounds, 3)
    assert visits.columns == ["_own", "_chunk", "_cell"] and visits.count() <= 15 * 15


def test_nearest_of_both_sides_are_exact():
    from rareclass.operators.neighbors import nearest_of_both
    rng = np.random.default_rng(5)

    def rows(x, q, r, k, exclude):
        return [(i, j, d) for i, near in brute(x, q, r, k, exclude).items() for d, j in near]
    for x in (rng.normal(size=(700, 16)), rng.normal(size=(300, 8)) * 1e-6 + 100, rng.integers(0, 2, (500, 7)).astype(float), rng.normal(size=(5, 4))):
        half = len(x) // 2
        a, b = np.arange(half), np.arange(half, len(x))
        near = nearest_of_both(x[a], x[b], 4)
        want = rows(x, a, b, 4, False), rows(x, b, a, 4, False)
        assert [(i, j + half, d) for i, j, d in zip(*near[0])] == want[0] and [(i + half, j, d) for i, j, d in zip(*near[1])] == want[1]
        assert list(zip(*nearest_of_both(x, x, 4, True)[0])) == rows(x, range(len(x)), range(len(x)), 4, True)
        if half >= 4:
            most = tuple(d.reshape(-1, 4)[:, 3] for _, _, d in near)
            again = nearest_of_both(x[a], x[b], 4, most=most)
            assert all((u == v).all() for p, q in zip(near, again) for u, v in zip(p, q))


def test_spanning_tree_knows_few_edges_of_a_point(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(size=(300, 6)), *[rng.normal(size=(60, 6)) * 0.01 + c for c in rng.normal(size=(5, 6)) * 30]])
    x[:20] = x[20]
    tables, plain = [], g.written
    monkeypatch.setattr(g, "written", lambda df, name: tables.append((name, plain(df, name))) or tables[-1][1])
    monkeypatch.setattr(g, "TREE_EDGES", 500, raising=False)  # so that tasks of all kinds take part
    df = points(spark, x, np.zeros(len(x))).union(spark.sql(
        "SELECT 1000L, NULL, 0, 0 UNION ALL SELECT 1001L, array(0D, 0D, 0D, 0D, 0D, double('NaN')), 0, 0"))
    edges = g.spanning_tree(df, block_rows=40).collect()
    assert max(t.count() for name, t in tables if name == "tree-edges") <= 9 * len(x)  # every pair of blocks gave a tree before
    assert any(name == "tree-outside" for name, _ in tables)  # the far groups know none of their nearest outside
    assert len(edges) == len(x) - 1 and sum(r["distance"] for r in edges) == pytest.approx(g._block_tree(x)[2].sum())
    assert {r["a_id"] for r in edges if r["distance"] == 0} == {0}


@pytest.mark.parametrize("end_rows", [100, 9])
def test_segments_between_copied_ends(spark, end_rows):
    rng = np.random.default_rng(9)
    ends = rng.integers(0, 3, (40, 4)).astype(float) + 0.1  # many are equal
    pts = np.vstack([ends[:6], (ends[rng.integers(0, 40, 20)] + ends[rng.integers(0, 40, 20)]) / 2, rng.normal(size=(8, 4))])
    got = {r["point_id"]: r for r in nearest_segments(points(spark, pts, np.ones(len(pts))), points(spark, ends, np.ones(40)),
                                                      block_rows=16, end_rows=end_rows).collect()}
    from rareclass.operators import neighbors as nb
    want = nb._all_segments(pts, ends, np.zeros(40, dtype=int), False)  # every pair of rows, copies included
    assert len(got) == len(pts)
    for s in range(len(pts)):
        assert (got[s]["residual"], got[s]["a_id"], got[s]["b_id"]) == (want[0][s], want[1][s], want[2][s])


def test_a_point_on_copied_ends_is_not_compared_with_all_pairs(spark):
    # 30 copies of every end and points on them: before, each of a point's copies went with every other end, or all pairs were compared
    rng = np.random.default_rng(11)
    base = rng.normal(size=(200, 8))
    ends = np.repeat(base, 30, axis=0)
    got = nearest_segments(points(spark, base, np.ones(200)), points(spark, ends, np.ones(len(ends)))).collect()
    assert len(got) == 200 and all(r["residual"] == 0 for r in got)
    assert all((r["a_id"], r["b_id"]) == ((0, 30) if r["point_id"] == 0 else (0, 30 * r["point_id"])) for r in got)
