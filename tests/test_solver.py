"""Client solver against NumPy: hinge objective on skewed clients, early stops, many clients, blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rareclass.operators.solver import combined, packed, solve_clients


def data(spark, seed=0):
    rng = np.random.default_rng(seed)
    n = 700
    c = rng.choice(["big", "small", "rare", "one"], n, p=[0.6, 0.2, 0.15, 0.05])
    x = rng.normal(size=(n, 3)) * [1.0, 3.0, 0.2] + (c == "rare")[:, None] * 0.5
    y = ((x @ [1.0, -0.7, 2.0] + 1.5 * rng.normal(size=n) > np.where(c == "rare", 3.0, 0.0)) & (c != "one")).astype(int)
    rows = [(i, str(c[i]), int(y[i]), [float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "row_id int, client_id string, label int, features array<double>"), x, y, c


def hinge(x, y, w, alpha):
    return np.maximum(0, 1 - (2 * y - 1) * (np.column_stack([x, np.ones(len(y))]) @ w)).mean() + alpha / 2 * (w[:-1] ** 2).sum()


def reference(x, y, alpha, steps=200_000):
    """Averaged subgradient descent from a long run, then the best point seen."""
    a = np.column_stack([x, np.ones(len(y))])
    s, w, best, value = 2.0 * y - 1, np.zeros(a.shape[1]), None, np.inf
    pen = np.append(np.ones(x.shape[1]), 0)
    for t in range(1, steps):
        active = s * (a @ w) < 1
        w = w - (0.5 / np.sqrt(t)) * (-(a[active].T @ s[active]) / len(y) + alpha * pen * w)
        if t % 50 == 0 and (now := hinge(x, y, w, alpha)) < value:
            best, value = w.copy(), now
    return value


@pytest.mark.parametrize("task_cells", [1 << 22, 500])
def test_hinge_objective(spark, task_cells):
    df, x, y, c = data(spark)
    found = {r["c"]: r for r in solve_clients(df.repartition(4), 3, "hinge", alpha=1e-2, task_cells=task_cells).collect()}
    assert set(found) == {"big", "small", "rare", "one"}
    assert not found["one"]["two"] and found["one"]["w"] == [0.0] * 4
    for k in ("big", "small", "rare"):
        own = c == k
        assert found[k]["settled"] and found[k]["rows"] == own.sum()
        assert hinge(x[own], y[own], np.array(found[k]["w"]), 1e-2) < reference(x[own], y[own], 1e-2, 20_000) + 1e-4


def test_steps_and_starts(spark):
    df, x, y, c = data(spark)
    whole = {r["c"]: np.array(r["w"]) for r in solve_clients(df, 3).collect()}
    start = spark.createDataFrame([(k, w.tolist()) for k, w in whole.items() if k != "one"] + [("one", [1.0, 2.0, 3.0, 4.0])], "c string, w array<double>")
    again = {r["c"]: r for r in solve_clients(df, 3, start=start).collect()}
    assert all(np.allclose(again[k]["w"], whole[k], atol=1e-7) and again[k]["steps"] <= 2 for k in ("big", "small", "rare"))
    assert again["one"]["w"] == [1.0, 2.0, 3.0, 4.0]
    one = {r["c"]: r for r in solve_clients(df, 3, steps=1).collect()}
    own = c == "big"
    a, yb = np.column_stack([x[own], np.ones(own.sum())]), y[own]
    want = -np.linalg.solve(np.diag([1, 1, 1, 0]) + 0.25 * a.T @ a, a.T @ (0.5 - yb))
    np.testing.assert_allclose(one["big"]["w"], want, atol=1e-9)
    assert not one["big"]["settled"]


def test_blocks_and_means(spark):
    df, x, y, c = data(spark)
    blocks = packed(df.repartition(3), "client_id", "features", "label", block_rows=64)
    sizes = blocks.select("c", (F.length("y") / 8).alias("n")).collect()
    assert max(r["n"] for r in sizes) <= 128 and sum(r["n"] for r in sizes) == 700
    solved = solve_clients(df, 3, blocks=blocks)
    plain = {r["c"]: np.array(r["w"]) for r in solve_clients(df, 3, task_cells=0).collect()}  # step by step
    assert all(np.allclose(r["w"], plain[r["c"]], atol=1e-7) for r in solved.collect())
    want = sum(plain[k] * (c == k).sum() for k in plain) / 700
    np.testing.assert_allclose(combined(solved), want, atol=1e-7)
    assert combined(solved.limit(0)) is None
    assert solve_clients(df.limit(0), 3).count() == 0
    many = df.withColumn("client_id", F.concat("client_id", (F.col("row_id") % 60).cast("string")))
    assert solve_clients(many, 3).count() == many.select("client_id").distinct().count()
