"""Hard negatives against all integer products, and the bounds of the codes against the products themselves."""

import math

import numpy as np
from pyspark.sql import functions as F

from rareclass.llm.negatives import bounds, encode, grid, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int"


def moved():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def brute(rows, every=100, positives=5, negatives=10):
    fine = {}
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or not len(v) or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        fine[i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)] = True
    out = []
    for i, label, v in fine:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, own) for j, own, w in fine if j != i and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [x for x in scored if x[2] != label and -30 * s <= -100 * x[0] <= -90 * s][:negatives]
            out += [(i, j, k, n, -s, -t) for k, (t, n, _) in enumerate(fits, 1)]
    return sorted(out)


def rows_of(seed=5, n=900, dims=24):
    rng = np.random.default_rng(seed)
    x = 0.3 * rng.standard_normal((n, dims))
    x[100:400] = x[100] + 0.02 * rng.standard_normal((300, dims))
    x[500:760] = x[500]
    return [(i, v.astype(float).tolist(), int(rng.integers(0, 10)), 0.0, 1) for i, v in enumerate(x.astype(np.float32))]


ODD = [(1000, [0.0] * 24, 3, 0.0, 1), (1001, None, 3, 0.0, 1), (1002, [float("nan")] + [0.1] * 23, 3, 0.0, 1), (1100, [0.2] * 24, None, 0.0, 1),
       (1200, [float("inf")] + [0.1] * 23, 1, 0.0, 1), (1300, [None] + [0.1] * 23, 1, 0.0, 1), (None, [0.3] * 24, 1, 0.0, 1), (1400, [0.5, 0.5], 1, 0.0, 1),
       (1401, [0.5, 0.25], 1, 0.0, 1), (1402, [0.25, 0.25], 2, 0.0, 1), (1403, [0.2, 0.25], 2, 0.0, 1), (1500, [], 1, 0.0, 1), (1600, [0.4] * 24, -3, 0.0, 1)]


def test_all_rows_as_brute_force(spark):
    rows = rows_of() + ODD
    rows += rows[:30]
    want = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    for settings in ({}, {"levels": 1, "block_rows": 200, "least_blocks": 3}):
        got = hard_negatives(df, moved(), **settings)
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert sorted(tuple(r) for r in got.collect()) == want
    assert len(want) > 200


def test_empty_and_single(spark):
    assert hard_negatives(spark.createDataFrame([], SCHEMA), moved()).count() == 0
    assert hard_negatives(spark.createDataFrame([(0, [1.0], 1, 0.0, 1)], SCHEMA), moved()).count() == 0


def test_vectors_too_long_for_64_bits_take_no_part(spark):
    rows = [(0, [1.0, 1.0], 1, 0.0, 1), (1, [1.0, 0.5], 1, 0.0, 1), (2, [0.5, 0.25], 2, 0.0, 1), (3, [1e30, 1.0], 1, 0.0, 1), (4, [3e38, -3e38], 2, 0.0, 1)]
    got = [tuple(r) for r in hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("label")).collect()]
    assert got == [(0, 1, 1, 2, 98304, 49152)]


def test_bounds_hold_and_tighten_with_levels():
    rng = np.random.default_rng(8)
    for dims in (1, 3, 64, 100):
        x = np.floor(256 * rng.standard_normal((300, dims)) * rng.uniform(0, 3, (300, 1)))
        x[:5] = 0
        exact = x[:40] @ x.T
        widths = []
        for levels in (1, 2, 4):
            low, high = bounds(encode(x, levels, 1), grid(x[:40], 1), dims)
            assert (low <= exact).all() and (exact <= high).all()
            widths.append((high - low).mean())
        assert widths[2] < widths[1] < widths[0] or dims == 1
