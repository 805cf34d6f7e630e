"""Agreement between clients: fixed cases and brute force over all pairs."""

from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rareclass.operators import explain as e


def table(spark, vectors):
    rows = [(c, f"f{j:02d}", float(v)) for c, vec in enumerate(vectors) for j, v in enumerate(vec)]
    return spark.createDataFrame(rows, "client_id int, feature string, importance double")


def test_identical_rankings(spark):
    r = e.stability(table(spark, [[5, 4, 3, 2, 1] + [0] * 8] * 4)).first()
    assert (r["spearman"], r["jaccard"], r["kuncheva"]) == pytest.approx((1.0, 1.0, 1.0))
    assert r["stability_note"] is None


def test_degenerate_clients_make_it_undefined(spark):
    r = e.stability(table(spark, [[1, 2, 3, 4, 5, 6], [0] * 6, [3] * 6, [2, 1, 4, 3, 6, 5], [1e-15] * 6])).first()
    assert r["degenerate_clients"] == [1, 2, 4] and r["spearman"] is None and r["jaccard"] is None and r["kuncheva"] is None
    single = e.stability(table(spark, [[1, 2, 3]])).first()
    assert single["spearman"] is None and single["stability_note"] == "agreement needs two clients"
    assert e.near_zero_share(table(spark, [[0, 0, 0, 1, 2]])).first()["near_zero"] == pytest.approx(0.6)


def test_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    vectors = np.round(rng.random((9, 13)), 1)  # ties on purpose
    imp = table(spark, vectors)
    ranks = [pd.Series(v).rank() for v in vectors]
    rho = np.mean([np.corrcoef(ranks[i], ranks[j])[0, 1] for i, j in combinations(range(9), 2)])
    tops = [set(sorted(range(13), key=lambda j: (-v[j], j))[:5]) for v in vectors]
    jac = np.mean([len(a & b) / len(a | b) for a, b in combinations(tops, 2)])
    kun = np.mean([(len(a & b) - 25 / 13) / (5 - 25 / 13) for a, b in combinations(tops, 2)])
    r = e.stability(imp).first()
    assert (r["spearman"], r["jaccard"], r["kuncheva"]) == pytest.approx((rho, jac, kun), abs=1e-12)
    wide = e.jaccard_at_k(imp, 12).first()["jaccard"]
    full = [set(sorted(range(13), key=lambda j: (-v[j], j))[:12]) for v in vectors]
    assert wide == pytest.approx(np.mean([len(a & b) / len(a | b) for a, b in combinations(full, 2)]))


def test_kuncheva_of_random_selections_is_about_zero(spark):
    rng = np.random.default_rng(0)
    for d in (13, 55):
        rows = [(s, c, f"f{j:02d}", float(v)) for s in range(200) for c in range(4) for j, v in enumerate(rng.random(d))]
        imp = spark.createDataFrame(pd.DataFrame(rows, columns=["s", "client_id", "feature", "importance"]))
        kun = e.kuncheva_index(imp, 5, ["s"]).agg({"kuncheva": "avg"}).first()[0]
        jac = e.jaccard_at_k(imp, 5, ["s"]).agg({"jaccard": "avg"}).first()[0]
        assert abs(kun) < 0.03 and (jac > 0.10 if d == 13 else jac < 0.10)


def test_unequal_selections_are_refused(spark):
    df = spark.createDataFrame([(["a", "b"], ["a"], 5)], "a array<string>, b array<string>, d int")
    with pytest.raises(Exception, match="equal size"):
        e.kuncheva_pair(df).collect()


def test_sampled_shapley_of_a_product(spark):
    """Exact values of a model with an interaction, from all coalitions; sampling stays close and adds up."""
    rng = np.random.default_rng(1)
    x, b = rng.normal(size=(5, 4)), rng.normal(size=(3, 4))
    f = lambda v: v[..., 0] * v[..., 1] + 2 * v[..., 2]
    rows = spark.createDataFrame([(0, i, [float(q) for q in v]) for i, v in enumerate(x)], "client_id int, row_id int, features array<double>")
    back = spark.createDataFrame([(0, 1.0, [float(q) for q in v]) for v in b], "client_id int, weight double, features array<double>")
    score = lambda d: d.selectExpr("*", "features[0] * features[1] + 2 * features[2] AS margin")
    got = {r["row_id"]: r["phi"] for r in e.sampled_shapley(rows, back, score, 4).collect()}
    from math import factorial
    for i in range(5):
        v = lambda S: np.mean([f(np.where([j in S for j in range(4)], x[i], r)) for r in b])
        for j in range(4):
            rest = [q for q in range(4) if q != j]
            want = sum(factorial(len(S)) * factorial(3 - len(S)) / 24 * (v(set(S) | {j}) - v(set(S)))
                       for n in range(4) for S in combinations(rest, n))
            assert got[i][j] == pytest.approx(want, abs=1e-9)
    few = e.sampled_shapley(rows, back, score, 4, samples=8)
    assert e.additivity_error(few).first()["max_error"] < 1e-9


def test_sampled_shapley_spreads_a_hot_client_over_tasks(spark):
    """One client holds nearly all rows: where joins shuffle, its rows must not be scored by one task."""
    rows = spark.range(2000).select(F.when(F.col("id") % 100 == 0, "b").otherwise("a").alias("client_id"), F.col("id").alias("row_id"),
                                    F.array(F.col("id") / 10.0, F.lit(1.0)).alias("features"))
    background = spark.createDataFrame([("a", 1.0, [0.0, 0.0]), ("b", 1.0, [1.0, 1.0])], "client_id string, weight double, features array<double>")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        task = lambda d: d.withColumn("margin", F.spark_partition_id().cast("double"))
        got = e.sampled_shapley(rows, background, task, 2).toPandas()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(got) == 2000
    assert got.groupby("margin").size().max() < 0.8 * len(got)
