"""Exact ranks, running totals and quantiles against pandas, with hot groups, ties and NULL keys."""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rareclass.functions.ranks import exact_quantiles, hash_rank, hash_segments, running_totals


def frame(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"id": np.arange(n), "k": np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b"], n)),
                         "v": rng.normal(size=n), "n": rng.integers(1, 5, n)})


def test_running_totals_and_maxima(spark):
    pdf = frame()
    df = spark.createDataFrame(pdf)
    got = running_totals(df, "v", {"cum": "n"}, ["k"], descending=True, lead=["n"], maxes={"top": "id"},
                         prior_maxes={"before": "id"}).toPandas().sort_values("id")
    s = pdf.sort_values("v", ascending=False)
    g = s.groupby("k")
    want = s.assign(cum=g["n"].cumsum(), nxt=g["n"].shift(-1), tot=g["n"].transform("sum"), top=g["id"].cummax(),
                    before=g["id"].cummax().groupby(s["k"]).shift(1)).sort_values("id")
    assert (got["cum"].to_numpy() == want["cum"].to_numpy()).all()
    assert (got["tot_cum"].to_numpy() == want["tot"].to_numpy()).all()
    assert (got["top"].to_numpy() == want["top"].to_numpy()).all()
    np.testing.assert_array_equal(got["next_n"].to_numpy(), want["nxt"].to_numpy())
    np.testing.assert_array_equal(got["before"].to_numpy(dtype=float), want["before"].to_numpy())


def test_null_key_is_a_group(spark):
    df = spark.createDataFrame([(None, 1.0, 2), (None, 2.0, 3), ("a", 1.0, 5)], "k string, v double, n int")
    got = {(r["k"], r["v"]): r["c"] for r in running_totals(df, "v", {"c": "n"}, ["k"]).collect()}
    assert got == {(None, 1.0): 2, (None, 2.0): 5, ("a", 1.0): 5}


def test_hash_rank_is_a_permutation(spark):
    df = spark.createDataFrame(frame())
    got = hash_rank(df, "id", 7, ["k"]).toPandas()
    for _, part in got.groupby("k"):
        assert sorted(part["hash_rank"]) == list(range(1, len(part) + 1))
        assert (part["n_group"] == len(part)).all()
    again = hash_rank(df.repartition(7), "id", 7, ["k"]).toPandas()
    assert (got.sort_values("id")["hash_rank"].to_numpy() == again.sort_values("id")["hash_rank"].to_numpy()).all()


def test_quantiles(spark):
    pdf = frame()
    pdf.loc[::3, "v"] = 0.25  # one value holds a third of all rows
    got = exact_quantiles(spark.createDataFrame(pdf), "v", {"q1": 0.25, "m": 0.5, "t": 0.999}, ["k"]).toPandas().set_index("k")
    for k, part in pdf.groupby("k"):
        np.testing.assert_allclose(got.loc[k, ["q1", "m", "t"]].to_numpy(dtype=float),
                                   np.quantile(part["v"], [0.25, 0.5, 0.999]), rtol=0, atol=1e-12)


def test_segments_agree_with_ranks_and_leave_rows_in_place(spark):
    from rareclass.functions.ranks import hash_segments
    rows = [(i, None if i % 11 == 0 else i % 3, "w" * 40) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, k int, wide string")
    for keys, cuts in ((["k"], [0, 1, 7, 7, 200, 5000]), ((), [0, 350, 699, 700, 701]), (["k"], [])):
        segment = hash_segments(df, "id", 5, F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), len(cuts), keys)
        ranked = {r["id"]: r["hash_rank"] for r in hash_rank(df, "id", 5, keys).collect()}
        got = {r["id"]: r["segment"] for r in segment.collect()}
        assert got == {i: sum(c < r for c in cuts) for i, r in ranked.items()}
    plan = segment._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and not any("wide" in line for line in plan.splitlines() if "Window" in line or "Aggregate" in line or "Sort" in line)
    assert hash_segments(df.limit(0), "id", 5, F.array(F.lit(3)), 1, ["k"]).count() == 0


def test_segments_of_a_hot_group_are_spread_over_tasks(spark):
    """One class holds nearly all rows: no task may hold more than its share, also where every join shuffles."""
    pdf = pd.DataFrame({"id": np.arange(4000), "y": (np.arange(4000) % 100 == 0).astype(int)})
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        cuts = F.array(F.floor(F.col("_n") * 0.25), F.floor(F.col("_n") * 0.5))
        got = hash_segments(spark.createDataFrame(pdf).repartition(8), "id", 3, cuts, 2, ["y"]).withColumn("task", F.spark_partition_id()).toPandas()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got.groupby("task").size().max() < 0.7 * len(pdf)
    pdf["h"] = [hashlib.md5(f"3:{i}".encode()).hexdigest() for i in pdf["id"]]
    pdf["rank"] = pdf.sort_values(["h", "id"]).groupby("y").cumcount() + 1
    n = pdf.groupby("y")["id"].transform("size")
    want = (pdf["rank"] > n // 4).astype(int) + (pdf["rank"] > n // 2).astype(int)
    assert (got.sort_values("id")["segment"].to_numpy() == want.to_numpy()).all()
