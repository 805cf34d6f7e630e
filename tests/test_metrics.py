"""Hand-computed metric cases: ties, one class, budgets, calibration."""

import math

import numpy as np
import pytest

from rareclass.operators import metrics as m


def table(spark, groups):
    rows = [(g, int(y), float(s)) for g, ys in groups.items() for y, s in ys]
    return spark.createDataFrame(rows, "g string, label int, score double")


GROUPS = {
    "tied": [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)],
    "one": [(1, 0.3), (1, 0.7), (1, 0.8)],
    "f1tie": [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.6)],
}


def test_average_precision(spark):
    got = {r["g"]: r["auprc"] for r in m.average_precision(table(spark, GROUPS), keys=["g"]).collect()}
    assert got["tied"] == pytest.approx(0.5 * 0.5 + 0.5 * (2 / 3))
    assert got["one"] == 0.0
    assert got["f1tie"] == pytest.approx(0.5 * 1 + 0.5 * (2 / 3))


def test_threshold_goes_to_the_lowest_tie_and_one_class_to_the_median(spark):
    flat = {"low": [(1, 4.0), (0, 3.0), (0, 2.0), (1, 1.0)], "one": GROUPS["one"]}
    got = {r["g"]: r["threshold"] for r in m.best_f1_threshold(table(spark, flat), keys=["g"]).collect()}
    # cuts 4.0 and 1.0 both reach F1 = 2/3: the lower score wins
    assert got == {"low": 1.0, "one": 0.7}


def test_recall_at_budget(spark):
    groups = {"first_over": [(0, 0.9), (1, 0.9), (1, 0.2), (0, 0.1)], "one": GROUPS["one"],
              "clean": [(1, 0.9), (1, 0.8), (0, 0.1), (0, 0.05)]}
    got = {r["g"]: r for r in m.recall_at_fpr(table(spark, groups), keys=["g"]).collect()}
    assert got["first_over"]["recall_at_fpr"] == 0.0 and math.isinf(got["first_over"]["threshold_at_fpr"])
    assert got["one"]["recall_at_fpr"] == 0.0 and got["one"]["actual_fpr"] is None
    assert (got["clean"]["recall_at_fpr"], got["clean"]["threshold_at_fpr"]) == (1.0, 0.8)


def test_collinear_points_are_dropped(spark):
    got = m.roc_curve(table(spark, {"g": [(1, 5.0), (1, 4.0), (1, 3.0), (0, 2.0), (0, 1.0)]}), keys=["g"]).collect()
    assert sorted(r["threshold"] for r in got) == [1.0, 3.0, 5.0]


def test_calibration(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.4 + 0.7 * x)))).astype(int)
    p = 1 / (1 + np.exp(-x))
    rows = [("fit", int(a), float(b)) for a, b in zip(y, p)] + [("flat", i % 2, 0.3) for i in range(10)] + [("one", 1, 0.2)]
    df = spark.createDataFrame(rows, "g string, label int, score double")
    got = {r["g"]: r for r in m.calibration(df, keys=["g"]).collect()}
    a = b = 0.0
    for _ in range(30):
        mu = 1 / (1 + np.exp(-(a + b * x)))
        w = mu * (1 - mu)
        step = np.linalg.solve([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum()]], [(y - mu).sum(), ((y - mu) * x).sum()])
        a, b = a + step[0], b + step[1]
    assert got["fit"]["cal_slope"] == pytest.approx(b, abs=1e-6)
    c = got["fit"]["cal_intercept"]
    assert np.mean(1 / (1 + np.exp(-(x + c)))) == pytest.approx(y.mean(), abs=1e-8) and c > 0
    assert got["flat"]["cal_slope"] is None and got["flat"]["brier"] is not None
    assert got["one"]["brier"] is None
    margins = m.calibration_for_test(df, keys=["g"], is_probability=False).collect()
    assert all(r["test_brier"] is None and r["test_cal_slope"] is None for r in margins)


def test_operating_point_text_rounds_the_binary_value(spark):
    """1/32 lies halfway and goes to the even digit; 0.00015 is stored above and 0.00025 below the half; missing numbers read NA."""
    rows = [(1, 0.03125, float("inf"), 0.00015), (2, None, 0.00025, -0.03125), (3, 1.0, float("nan"), None)]
    df = spark.createDataFrame(rows, "id int, recall_at_fpr double, threshold_at_fpr double, actual_fpr double")
    got = {r["id"]: r["line"] for r in m.operating_point_text(df).collect()}
    assert got == {1: f"recall@5%fpr=0.0312 (thr=Infinity, fpr={0.00015:.4f})", 2: f"recall@5%fpr=NA (thr={0.00025:.4f}, fpr=-0.0312)",
                   3: "recall@5%fpr=1.0000 (thr=NaN, fpr=NA)"}
