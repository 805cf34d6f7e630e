"""Group fits against NumPy, combination rules, prefix selection and stop rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rareclass.operators import groupfit as r
from rareclass.plans.grouped import grouped_run, round_weights


def data(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    c = rng.choice(["a", "b", "none"], n, p=[0.6, 0.3, 0.1])
    y = ((x @ [1.0, -2.0, 0.5] + rng.normal(size=n) > 0) & (c != "none")).astype(int)
    rows = [(i, str(c[i]), int(y[i]), [float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "row_id int, client_id string, label int, features array<double>"), x, y, c


def test_local_logistic(spark):
    df, x, y, c = data(spark)
    w, n = r.fit_clients(df.repartition(5), ["a", "b", "none"], 3)
    for k in ("a", "b"):
        xk, yk, v = np.column_stack([x[c == k], np.ones((c == k).sum())]), y[c == k], np.zeros(4)
        for _ in range(50):
            mu = 1 / (1 + np.exp(-xk @ v))
            pen = np.array([1.0, 1, 1, 0])
            v = v - np.linalg.solve(np.diag(pen) + xk.T @ (xk * (mu * (1 - mu))[:, None]), pen * v + xk.T @ (mu - yk))
        np.testing.assert_allclose(w[k], v, atol=1e-7)
        assert n[k] == (c == k).sum()
    assert (w["none"] == 0).all()  # one class: incoming weights stay


def test_grouped_run_learns(spark):
    df, *_ = data(spark, 600)
    split = df.withColumn("split", F.when(F.col("row_id") % 10 < 7, "train").when(F.col("row_id") % 10 < 9, "val").otherwise("test"))
    metrics, weights = grouped_run(split, ["a", "b", "none"], 3, rounds=2)
    got = {(m["round"], m["split"]): m["auprc"] for m in metrics.collect()}
    assert set(got) == {(0, "val"), (1, "val"), (2, "val"), (2, "test")} and got[(2, "val")] > got[(0, "val")] + 0.2
    assert len(weights) == 3


def test_one_class_client_moves_the_average_every_round(spark):
    df, x, y, c = data(spark, 300)
    df = df.withColumn("client_id", F.when(F.col("row_id") % 3 == 0, "none").otherwise(F.col("client_id"))).withColumn(
        "label", F.when(F.col("client_id") == "none", 0).otherwise(F.col("label")))
    c = np.where(np.arange(300) % 3 == 0, "none", c)
    names, n = ["a", "b", "none"], {k: int((c == k).sum()) for k in ("a", "b", "none")}
    assert n["none"] >= 100
    got, local = round_weights(df, names, 3, rounds=20)
    want = [np.zeros(4)]
    for _ in range(20):  # the plain loop
        w = {k: want[-1].copy() for k in names}
        for k in ("a", "b"):
            xk, yk, pen = np.column_stack([x[c == k], np.ones(n[k])]), y[c == k], np.array([1.0, 1, 1, 0])
            for _ in range(50):
                mu = 1 / (1 + np.exp(-xk @ w[k]))
                w[k] = w[k] - np.linalg.solve(np.diag(pen) + xk.T @ (xk * (mu * (1 - mu))[:, None]), pen * w[k] + xk.T @ (mu - yk))
        want.append(sum(w[k] * n[k] for k in names) / 300)
    np.testing.assert_allclose(got, want, atol=1e-6)
    np.testing.assert_allclose(local[-1]["none"], want[-2], atol=1e-6)
    assert np.abs(got[20]).max() > 1.3 * np.abs(got[1]).max()


def test_accuracy_weights_fall_back_to_rows(spark):
    up = spark.createDataFrame([(1, "a", 10, 0.0), (1, "b", 30, 0.0), (2, "a", 10, 0.5), (2, "b", 30, 0.5), (2, "z", 0, 0.9), (3, "a", 0, 0.2)],
                               "round int, client_id string, n int, alpha double")
    got = {(w["round"], w["client_id"]): w["weight"] for w in r.client_weights(up, alpha="alpha").collect()}
    assert got[(1, "a")] == 0.25 and got[(2, "b")] == pytest.approx(0.75) and got[(2, "z")] == 0 and got[(3, "a")] is None
    params = up.select("round", "client_id", F.lit("l").alias("layer"), F.array(F.lit(1.0), F.col("n").cast("double")).alias("w"))
    comb = {(p["round"], p["pos"]): p["w"] for p in r.combine_parameters(params, up, "alpha").collect()}
    assert comb[(1, 1)] == pytest.approx(25.0) and comb[(2, 0)] == pytest.approx(1.0) and (3, 0) not in comb
    with pytest.raises(RuntimeError):
        r.require_results(up.where("round = 1"), up.select("round").distinct())


def test_missing_metric_counts_as_zero(spark):
    up = spark.createDataFrame([(1, "a", 10), (1, "b", 30)], "round int, client_id string, n int")
    ms = spark.createDataFrame([(1, "a", "loss", 4.0), (1, "b", "loss", 8.0), (1, "a", "auc", 1.0)], "round int, client_id string, metric string, value double")
    assert {m["metric"]: m["value"] for m in r.combine_metrics(ms, up).collect()} == {"loss": 7.0, "auc": 0.25}


def test_prefix_selection(spark):
    rows = [(0, 1, [1.0, 0.0, 5.0]), (1, 0, [0.0, 0.5, 9.0]), (2, 0, [-1.0, 0.0, 0.0]), (3, 1, [0.5, 0.5, 0.0])]
    df = spark.createDataFrame(rows, "row_id int, label int, margins array<double>")
    best = r.select_prefix(df).first()
    assert (best["prefix"], best["auprc"]) == (1, 1.0)  # prefix 2 ties, the shorter one is kept
    one = r.select_prefix(df.where("label = 1")).first()
    assert (one["prefix"], one["auprc"]) == (3, 0.0)


def test_stop_rules_differ_on_ties(spark):
    def stops(values, patience):
        h = spark.createDataFrame([("x", i, float(v)) for i, v in enumerate(values)], "run_id string, round int, val_auprc double")
        a = r.early_stop_flag(h, patience=patience).first()["early_stop_round"]
        b = r.early_stop_cut(h, patience=patience).select(F.max("stop_round")).first()[0]
        return a, b
    assert stops([9, 1, 2, 2, 2, 2], 2) == (4, 2)   # the flag ignores round 0; drops below it count for the cut
    assert stops([0, 1, 2, 2, 2, 2], 2) == (4, None)
    assert stops([0, 1, 2, 1, 2, 1, 3], 2) == (4, 5)
    assert stops([0, 1, 2, 3], 2) == (None, None)


def test_best_round(spark):
    h = spark.createDataFrame([("a", 0, 0.9, 0.1), ("a", 1, 0.5, 0.2), ("a", 2, 0.5, 0.3), ("b", 1, None, 0.4), ("b", 2, None, 0.4)],
                              "run_id string, round int, val_auprc double, test_auprc double")
    got = {x["run_id"]: (x["best_round"], x["final_round"]) for x in r.best_round(h).collect()}
    assert got == {"a": (1, 2), "b": (1, 2)}
    assert r.best_round(h, include_round_zero=True).where("run_id = 'a'").first()["best_round"] == 0


def test_accuracy_is_measured_once_for_clients_solved_once(spark, monkeypatch):
    from rareclass.plans import grouped
    df, *_ = data(spark, 300)
    asked, plain = [], grouped.local_auprc
    monkeypatch.setattr(grouped, "local_auprc", lambda *a, **k: asked.append(1) or plain(*a, **k))
    whole, local = round_weights(df, ["a", "b", "none"], 3, rounds=3, weighting="accuracy")
    assert len(asked) == 1 and len(whole) == 4
    ap = {x["c"]: x["local_auprc"] for x in plain(df.withColumn("c", F.col("client_id")).withColumn("score", grouped.margin(
        F.col("features"), F.when(F.col("c") == "a", F.lit(local[-1]["a"].tolist())).otherwise(F.lit(local[-1]["b"].tolist())))), "c").collect()}
    n = {x["client_id"]: x["count"] for x in df.groupBy("client_id").count().collect()}
    share = {k: n[k] * ap[k] for k in ("a", "b")}  # the client with one class has precision 0
    np.testing.assert_allclose(whole[-1], sum(share[k] * local[-1][k] for k in share) / sum(share.values()), atol=1e-9)
