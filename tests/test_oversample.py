"""Oversampling: skip order, counts, determinism, and every synthetic row on a minority segment."""

import numpy as np
import pytest

from rareclass.operators import oversample as o
from rareclass.operators import splits as s
from rareclass.operators.census import minority_census
from rareclass.operators.neighbors import nearest_segments


def clients(spark, sizes, seed=0):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for c, (n_min, n_maj) in enumerate(sizes):
        for y in [1] * n_min + [0] * n_maj:
            rows.append((i, c, y, [float(v) for v in rng.normal(2.0 * y, 1.0, 3)]))
            i += 1
    return spark.createDataFrame(rows, "row_id bigint, client_id int, label int, features array<double>")


def test_skip_order(spark):
    df = spark.createDataFrame([(5, 1000), (20, 1000), (6, 100000), (100, 0)], "n int, m int")
    got = [r[0] for r in df.select(o.skip_reason(df.n, df.m, 0.01)).collect()]
    assert got == ["insufficient_minority", "target_met", None, "target_met"]
    assert [r[0] for r in df.select(o.skip_reason(df.n, df.m, "auto")).collect()] == ["insufficient_minority", None, None, None]
    assert df.select(o.skip_reason(df.n, df.m, 0.01, enabled=False)).first()[0] == "disabled"
    noop = o.noop_cells(df.selectExpr("n AS n_pos", "n + m AS n_samples"), []).first()
    assert (noop["is_noop"], noop["n_below_floor"]) == (False, 1)


@pytest.mark.parametrize("method", ["smote", "adasyn"])
def test_synthetic_rows(spark, method, monkeypatch):
    monkeypatch.setattr(o, "DRAW_CHUNK", 7)  # several chunks per client
    df = clients(spark, [(8, 200), (4, 50), (30, 60)])
    rows, rep = o.oversample(df, method, strategy=0.25)
    report = {r["client_id"]: r for r in rep.collect()}
    assert report[1]["skip_reason"] == "insufficient_minority" and report[2]["skip_reason"] == "target_met"
    made = rows.where("is_synthetic")
    n = made.count()
    assert n == report[0]["n_synthetic"] and (n == 42 if method == "smote" else abs(n - 42) <= 8)
    assert rows.count() == df.count() + n and made.select("row_id").distinct().count() == n
    hits = nearest_segments(made, rows.where("label = 1 AND NOT is_synthetic"), by=["client_id"])
    assert max(r["residual"] for r in hits.collect()) < 1e-9
    again = o.oversample(df.repartition(5), method, strategy=0.25)[0].where("is_synthetic")
    assert sorted(map(str, made.collect())) == sorted(map(str, again.collect()))


def test_no_candidates(spark):
    rng = np.random.default_rng(0)
    rows = [(i, 0, 1, [float(v) for v in rng.normal(50, 0.1, 2)]) for i in range(10)]
    rows += [(100 + i, 0, 0, [float(v) for v in rng.normal(-50, 0.1, 2)]) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id bigint, client_id int, label int, features array<double>")
    out, rep = o.adasyn(df, "auto")
    assert rep.first()["skip_reason"] == "no_candidates" and out.count() == 50


def test_splits_and_partitions(spark):
    df = clients(spark, [(37, 900)])
    split = s.stratified_split(df).groupBy("label", "split").count().collect()
    got = {(r["label"], r["split"]): r["count"] for r in split}
    for y, n in ((1, 37), (0, 900)):
        assert sum(got[(y, p)] for p in ("train", "val", "test")) == n
        assert abs(got[(y, "train")] - 0.70 * n) <= 1 and abs(got[(y, "val")] - 0.15 * n) <= 1
    iid = s.client_counts(s.partition(df.drop("client_id"), "iid"), 5)
    assert sorted(r["n_samples"] for r in iid.collect()) == [187, 187, 187, 188, 188]
    parts = s.partition(df.drop("client_id"), "dirichlet", 0.5)
    assert s.partition_integrity(parts, df).first()["is_sound"]
    assert not s.partition_integrity(parts.where("row_id <> 3"), df).first()["is_sound"]
    with pytest.raises(ValueError):
        s.partition(df, "dirichlet")
    with pytest.raises(ValueError):
        s.partition(df, "other")


def test_census_counts_match_the_partition(spark):
    df = clients(spark, [(37, 900)]).drop("client_id").selectExpr("'d' AS dataset", "*")
    census = minority_census(df, 3, seeds=(42,), alphas=(0.5,))
    for scheme in ("iid", "dirichlet"):
        part = s.client_counts(s.partition(df, scheme, 0.5, seed=42), 5)
        want = {r["client_id"]: (r["n_samples"], r["n_pos"]) for r in part.collect()}
        got = {r["client_id"]: (r["n_total"], r["n_minority"]) for r in census.where(f"scheme = '{scheme}'").collect()}
        assert got == want
