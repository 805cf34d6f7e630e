"""Graph search against brute force: exact scores and order, recall of at least 0.9, odd inputs."""

import numpy as np

import pytest

from rareclass.llm.hnsw import BEAM, SHARD_ROWS, build, nearest, search

SCHEMA = "vec_id long, embedding array<float>, score double"


def rows_of(seed=2, n=1500, dims=16):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims)) * rng.uniform(0.5, 2, (n, 1))
    x[200:500] = x[200] + 0.03 * rng.standard_normal((300, dims))
    x[600:700] = x[600]
    return [(i, v.tolist(), 0.0) for i, v in enumerate(x.astype(np.float32).astype(float))]


def exact(rows, every, k):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v, _ in rows if i is not None and v and None not in v
            and np.isfinite(np.array(v)).all() and np.any(v)]
    out = {}
    for i, q in good:
        if i % every == 0:
            near = sorted((-float((q * v).sum()), j) for j, v in good if j != i and len(v) == len(q))
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_recall_and_scores(spark):
    rows = rows_of()
    want = exact(rows, 20, 20)
    got = by_query(nearest(spark.createDataFrame(rows, SCHEMA), shards=3))
    vectors = {i: np.array(v) for i, v, _ in rows}
    hits = 0
    assert set(got) == set(want)
    for q, found in got.items():
        assert [r for r, *_ in found] == list(range(1, 21))
        assert all(v != q for _, v, _ in found) and len({v for _, v, _ in found}) == 20
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        assert all(np.isclose(s, vectors[q] @ vectors[v], rtol=1e-12) for _, v, s in found)
        floor = want[q][-1][1] - 1e-9
        hits += sum(s >= floor for _, _, s in found)
    assert hits / (20 * len(got)) >= 0.9


def test_small_tables_are_exact(spark):
    rows = [(0, [1.0, 0.0], 0.0), (20, [1.0, 0.0], 0.0), (3, [0.5, 0.5], 0.0), (4, None, 0.0), (40, [0.0, 0.0], 0.0),
            (60, [float("nan"), 1.0], 0.0), (5, [1.0, None], 0.0), (80, [2.0], 0.0), (None, [1.0, 1.0], 0.0), (6, [-1.0, 0.0], 0.0),
            (3, [0.5, 0.5], 0.0)]
    got = by_query(nearest(spark.createDataFrame(rows, SCHEMA)))
    assert got == {0: [(1, 20, 1.0), (2, 3, 0.5), (3, 6, -1.0)], 20: [(1, 0, 1.0), (2, 3, 0.5), (3, 6, -1.0)]}
    assert nearest(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_of_a_full_shard(clustered):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((SHARD_ROWS, 64))
    if clustered:
        x[:SHARD_ROWS // 3] = x[0] + 0.05 * rng.standard_normal((SHARD_ROWS // 3, 64))
    graph, order = build(x, np.arange(SHARD_ROWS))
    nodes = x[order]
    queries = nodes[rng.choice(SHARD_ROWS, 200, replace=False)]
    found, _ = search(graph, queries, 21, BEAM)
    exact = queries @ nodes.T
    floor = np.sort(exact, axis=1)[:, -21] - 1e-9
    assert np.mean([(exact[i, f[f >= 0]] >= floor[i]).sum() / 21 for i, f in enumerate(found)]) >= 0.95
