"""Grouped ranking, threshold and calibration metrics over a score table.

All take ``keys`` (run, split, client, round, ...) and work from one aggregate: equal scores are
merged first, so heavy ties cost nothing and running counts use :func:`running_totals`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rareclass.functions.ranks import null_safe_join, range_cuts, running_totals
from rareclass.session import cut_lineage

FPR_BUDGET = 0.05
LOGIT_CLIP = 1e-6


def score_curve(
    df: DataFrame, label: str = "label", score: str = "score", keys: Sequence[str] = (),
    lead: bool = False,
) -> DataFrame:
    """One row per distinct score: counts at it and at or above it, and group totals.

    Columns: ``score, tp_at, n_at, fp_at, tp, n, fp, n_pos, n_all, n_neg`` (+ ``next_tp_at``,
    ``next_fp_at`` with ``lead``).
    """
    at = df.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.col(label).cast("bigint")).alias("tp_at"), F.count(F.lit(1)).alias("n_at"))
    return curve_of_counts(at, keys, range_cuts(df, score), lead)


def curve_of_counts(at: DataFrame, keys: Sequence[str] = (), cuts: Sequence[float] | None = None, lead: bool = False) -> DataFrame:
    """:func:`score_curve` from counts: one row per distinct score of a group with ``score, tp_at, n_at``."""
    at = at.withColumn("fp_at", F.col("n_at") - F.col("tp_at"))
    curve = running_totals(
        at, "score", {"tp": "tp_at", "n": "n_at"}, keys, descending=True,
        cuts=cuts, lead=["tp_at", "fp_at"] if lead else [],
    )
    return (
        curve.withColumnRenamed("tot_tp", "n_pos").withColumnRenamed("tot_n", "n_all")
        .withColumn("fp", F.col("n") - F.col("tp"))
        .withColumn("n_neg", F.col("n_all") - F.col("n_pos"))
    )


def _two_classes() -> Column:
    return (F.col("n_pos") > 0) & (F.col("n_neg") > 0)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _f1(precision: Column, recall: Column) -> Column:
    return F.when(
        precision + recall > 0, F.lit(2.0) * precision * recall / (precision + recall)
    ).otherwise(F.lit(0.0))


def average_precision(df: DataFrame, label: str = "label", score: str = "score",
                      keys: Sequence[str] = (), out: str = "auprc") -> DataFrame:
    """M1: sum of recall steps times precision over distinct scores; one class -> 0.0."""
    return precision_of_curve(score_curve(df, label, score, keys), keys, out)


def precision_of_curve(curve: DataFrame, keys: Sequence[str], out: str = "auprc") -> DataFrame:
    step = (F.col("tp_at") / F.col("n_pos")) * (F.col("tp") / F.col("n"))
    return curve.groupBy(*keys).agg(
        F.sum(F.when(_two_classes(), step).otherwise(F.lit(0.0))).alias(out)
    )


def pr_curve(df: DataFrame, label: str = "label", score: str = "score",
             keys: Sequence[str] = ()) -> DataFrame:
    """M2: (threshold, precision, recall) per distinct score, closed by the point (NULL, 1, 0)."""
    curve = score_curve(df, label, score, keys).where(_two_classes())
    points = curve.select(
        *keys, F.col("score").alias("threshold"),
        (F.col("tp") / F.col("n")).alias("precision"), (F.col("tp") / F.col("n_pos")).alias("recall"),
    )
    end = curve.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 0").select(
        *keys, F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"),
    )
    return points.unionByName(end)


def best_f1_threshold(df: DataFrame, label: str = "label", score: str = "score",
                      keys: Sequence[str] = ()) -> DataFrame:
    """M3: score cut with the highest F1, the lowest such cut on ties; one class -> median score."""
    return _best_f1(score_curve(df, label, score, keys), keys)


def _best_f1(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    precision, recall = F.col("tp") / F.col("n"), F.col("tp") / F.col("n_pos")
    below_or_at = F.col("n_all") - F.col("n") + F.col("n_at")
    middle = (F.col("n_all") - 1) / F.lit(2.0)
    pick = F.when(_two_classes(), F.struct(_f1(precision, recall).alias("f1"),
                                           (-F.col("score")).alias("neg")))
    best = curve.groupBy(*keys).agg(
        F.max(pick).alias("_best"),
        F.min(F.when(below_or_at > F.floor(middle), F.col("score"))).alias("_lo"),
        F.min(F.when(below_or_at > F.ceil(middle), F.col("score"))).alias("_hi"),
    )
    return best.select(
        *keys,
        F.coalesce(F.lit(0.0) - F.col("_best.neg"),
                   F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.lit(0.5)).alias("threshold"),
        F.col("_best.f1").alias("best_f1"),
    )


def metrics_at_threshold(df: DataFrame, threshold: str | float | DataFrame, label: str = "label",
                         score: str = "score", keys: Sequence[str] = (),
                         on: Sequence[str] | None = None) -> DataFrame:
    """M4: precision, recall and F1 of ``score >= threshold``; empty denominators -> 0.

    ``threshold`` is a number, a column name, or a table with one ``threshold`` per ``on`` key.
    """
    if isinstance(threshold, DataFrame):
        on = list(keys if on is None else on)
        rows = null_safe_join(df, threshold.select(*on, "threshold"), on, "left")
        cut = F.col("threshold")
    else:
        rows, cut = df, (F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold)))
    flagged, positive = F.col(score).cast("double") >= cut, F.col(label) == 1
    counts = rows.groupBy(*keys).agg(
        F.max(cut).alias("threshold"), F.count(F.lit(1)).alias("n_rows"),
        F.count_if(flagged & positive).alias("tp"), F.count_if(flagged & ~positive).alias("fp"),
        F.count_if(positive).alias("n_pos"),
    )
    precision = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = _ratio(F.col("tp"), F.col("n_pos"))
    f1 = _ratio(F.lit(2.0) * F.col("tp"), F.col("n_pos") + F.col("tp") + F.col("fp"))
    return counts.select(*keys, "threshold", "n_rows", f1.alias("f1"), precision.alias("precision"),
                         recall.alias("recall"))


def roc_curve(df: DataFrame, label: str = "label", score: str = "score",
              keys: Sequence[str] = ()) -> DataFrame:
    """Kept ROC points: the first and last score group and every group where the slope turns."""
    curve = score_curve(df, label, score, keys, lead=True).where(_two_classes())
    return curve.where(_kept_point()).select(
        *keys, F.col("score").alias("threshold"), (F.col("fp") / F.col("n_neg")).alias("fpr"),
        (F.col("tp") / F.col("n_pos")).alias("tpr"), F.col("n").alias("n_flagged"),
    )


def recall_at_fpr(df: DataFrame, label: str = "label", score: str = "score",
                  keys: Sequence[str] = (), budget: float = FPR_BUDGET) -> DataFrame:
    """M5: the last ROC point whose false-positive rate is within ``budget``.

    No interpolation. Nothing inside the budget -> the (0, 0) start at threshold +inf; one class
    -> recall 0.0 with NULL threshold and rate.
    """
    points = roc_curve(df, label, score, keys)
    hit = points.where(F.col("fpr") <= F.lit(budget)).groupBy(*keys).agg(
        F.max(F.struct("n_flagged", "tpr", "threshold", "fpr")).alias("_p")
    )
    groups = df.groupBy(*keys).agg(
        (F.count_if(F.col(label) == 1) > 0).alias("_pos"),
        (F.count_if(F.col(label) == 0) > 0).alias("_neg"),
    )
    both = F.col("_pos") & F.col("_neg")
    joined = null_safe_join(groups, hit, keys, "left")
    return joined.select(
        *keys,
        F.coalesce(F.col("_p.tpr"), F.lit(0.0)).alias("recall_at_fpr"),
        F.when(both, F.coalesce(F.col("_p.threshold"), F.lit(float("inf")))).alias("threshold_at_fpr"),
        F.when(both, F.coalesce(F.col("_p.fpr"), F.lit(0.0))).alias("actual_fpr"),
    )


def brier_score(df: DataFrame, label: str = "label", score: str = "score",
                keys: Sequence[str] = ()) -> DataFrame:
    """M6: mean squared difference between probability and outcome."""
    gap = F.col(score).cast("double") - F.col(label)
    return df.groupBy(*keys).agg(F.avg(gap * gap).alias("brier"))


def prevalence(df: DataFrame, label: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """Share of positives, the average precision of a random ranking."""
    return df.groupBy(*keys).agg(F.coalesce(F.avg(F.col(label).cast("double")), F.lit(0.0))
                                 .alias("baseline_auprc"))


def calibration(df: DataFrame, label: str = "label", score: str = "score",
                keys: Sequence[str] = (), is_probability: str | bool = True,
                max_steps: int = 200, tol: float = 1e-9, steps_per_job: int = 2) -> DataFrame:
    """M6-M9: Brier score, calibration-in-the-large and calibration slope per group.

    Rows collapse to distinct logits first. Each step is one aggregate over that table for all
    groups: Newton sums for ``y ~ a + b*logit`` and a bracketed Newton step for the shift of the
    slope-one model. Margins, one-class groups -> all NULL; equal logits, and fits that have not settled
    after ``max_steps`` (as with separable labels), -> only the Brier score.
    """
    prob = F.lit(is_probability) if isinstance(is_probability, bool) else F.col(is_probability)
    p = F.col(score).cast("double")
    y = F.col(label).cast("double")
    clipped = F.greatest(F.lit(LOGIT_CLIP), F.least(F.lit(1.0 - LOGIT_CLIP), p))
    rows = df.select(*keys, y.alias("_y"), p.alias("_p"), prob.alias("_prob"),
                     F.log(clipped / (F.lit(1.0) - clipped)).alias("_x"))
    base = rows.groupBy(*keys).agg(
        F.bool_and("_prob").alias("_prob"), F.avg("_y").alias("_ybar"),
        F.avg((F.col("_p") - F.col("_y")) * (F.col("_p") - F.col("_y"))).alias("_brier"),
        F.min("_x").alias("_min"), F.max("_x").alias("_max"), F.count(F.lit(1)).alias("_n"),
    )
    usable = F.col("_prob") & (F.col("_ybar") > 0) & (F.col("_ybar") < 1)
    spread = F.col("_max") - F.col("_min") > F.lit(1e-8) + F.lit(1e-5) * F.abs(F.col("_min"))
    points = cut_lineage(rows.groupBy(*keys, "_x").agg(
        F.sum("_y").alias("_pos"), F.count(F.lit(1)).alias("_w")))
    base = cut_lineage(base)
    state = cut_lineage(base.where(usable & spread).select(
        *keys, "_ybar", "_n", F.log(F.col("_ybar") / (1 - F.col("_ybar"))).alias("_a"),
        F.lit(0.0).alias("_b"), F.lit(0.0).alias("_c"), F.lit(-50.0).alias("_lo"),
        F.lit(50.0).alias("_hi"), F.lit(1.0).alias("_move")))
    x, w = F.col("_x"), F.col("_w")

    def sigmoid(z: Column) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    for at in range(1, max_steps + 1):
        mu = sigmoid(F.col("_a") + F.col("_b") * x)
        nu = sigmoid(F.col("_c") + x)
        params = ["_ybar", "_n", "_a", "_b", "_c", "_lo", "_hi"]
        sums = null_safe_join(points, state, keys).groupBy(*keys, *params).agg(
            F.sum(F.col("_pos") - w * mu).alias("_ga"), F.sum((F.col("_pos") - w * mu) * x).alias("_gb"),
            F.sum(w * mu * (1 - mu)).alias("_haa"), F.sum(w * mu * (1 - mu) * x).alias("_hab"),
            F.sum(w * mu * (1 - mu) * x * x).alias("_hbb"),
            (F.sum(w * nu) / F.first("_n")).alias("_mean"),
            (F.sum(w * nu * (1 - nu)) / F.first("_n")).alias("_slope"),
        )
        det = F.col("_haa") * F.col("_hbb") - F.col("_hab") * F.col("_hab")
        safe = det > 1e-300
        da = F.when(safe, (F.col("_hbb") * F.col("_ga") - F.col("_hab") * F.col("_gb")) / det).otherwise(0.0)
        db = F.when(safe, (F.col("_haa") * F.col("_gb") - F.col("_hab") * F.col("_ga")) / det).otherwise(0.0)
        # a long step is shortened so that a far start cannot overshoot
        shrink = F.least(F.lit(1.0), F.lit(8.0) / F.greatest(F.abs(da), F.abs(db), F.lit(1e-12)))
        too_low = F.col("_mean") < F.col("_ybar")
        lo = F.when(too_low, F.col("_c")).otherwise(F.col("_lo"))
        hi = F.when(too_low, F.col("_hi")).otherwise(F.col("_c"))
        newton = F.col("_c") - (F.col("_mean") - F.col("_ybar")) / F.greatest(F.col("_slope"), F.lit(1e-300))
        stepped = sums.select(
            *keys, "_ybar", "_n", (F.col("_a") + da * shrink).alias("_a"),
            (F.col("_b") + db * shrink).alias("_b"), F.col("_c").alias("_old"),
            lo.alias("_lo"), hi.alias("_hi"), newton.alias("_newton"),
            F.greatest(F.abs(da), F.abs(db)).alias("_d"),
        )
        inside = (F.col("_newton") >= F.col("_lo")) & (F.col("_newton") <= F.col("_hi"))
        nxt = F.when(inside, F.col("_newton")).otherwise((F.col("_lo") + F.col("_hi")) / 2)
        state = stepped.select(
            *keys, "_ybar", "_n", "_a", "_b", nxt.alias("_c"), "_lo", "_hi",
            F.greatest("_d", F.abs(nxt - F.col("_old"))).alias("_move"))
        if at % steps_per_job and at < max_steps:
            continue
        state = cut_lineage(state)
        if (state.agg(F.max("_move")).first()[0] or 0.0) < tol:
            break
    fitted = state.where(F.col("_move") < tol).select(*keys, F.col("_c").alias("_int"), F.col("_b").alias("_sl"))
    return null_safe_join(base, fitted, keys, "left").select(
        *keys, F.when(usable, F.col("_brier")).alias("brier"),
        F.col("_int").alias("cal_intercept"), F.col("_sl").alias("cal_slope"),
    )


def calibration_for_test(df: DataFrame, label: str = "label", score: str = "score",
                         keys: Sequence[str] = (), is_probability: str | bool = True) -> DataFrame:
    """M9: the calibration fields under their test names; all NULL for margin scores."""
    fields = calibration(df, label, score, keys, is_probability)
    return fields.select(*keys, *[F.col(c).alias(f"test_{c}") for c in ("brier", "cal_intercept", "cal_slope")])


def _kept_point() -> Column:
    """First and last score group of a curve and every group where the ROC slope turns."""
    first, last = F.col("n") == F.col("n_at"), F.col("n") == F.col("n_all")
    turns = (F.col("next_tp_at") != F.col("tp_at")) | (F.col("next_fp_at") != F.col("fp_at"))
    return first | last | turns


def _curve_metrics(curve: DataFrame, keys: Sequence[str], budget: float) -> DataFrame:
    """Every metric of a group in one aggregate over its curve; ``threshold`` is a curve column."""
    both = _two_classes()
    fpr = F.col("fp") / F.col("n_neg")
    point = F.when(both & F.coalesce(_kept_point(), F.lit(True)) & (fpr <= F.lit(budget)), F.struct(
        F.col("n"), (F.col("tp") / F.col("n_pos")).alias("tpr"), F.col("score").alias("cut"), fpr.alias("fpr")))
    flagged = F.col("score") >= F.col("threshold")
    step = F.when(both, (F.col("tp_at") / F.col("n_pos")) * (F.col("tp") / F.col("n"))).otherwise(F.lit(0.0))
    sums = curve.groupBy(*keys).agg(
        F.max("threshold").alias("threshold"), F.max("n_all").alias("n_rows"), F.max("n_pos").alias("n_pos"),
        F.bool_or(both).alias("_both"),
        F.coalesce(F.sum(F.when(flagged, F.col("tp_at"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(flagged, F.col("fp_at"))), F.lit(0)).alias("fp"),
        F.sum(step).alias("auprc"), F.max(point).alias("_p"))
    both = F.col("_both")
    return sums.select(
        *keys, "threshold", "n_rows",
        _ratio(F.lit(2.0) * F.col("tp"), F.col("n_pos") + F.col("tp") + F.col("fp")).alias("f1"),
        _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _ratio(F.col("tp"), F.col("n_pos")).alias("recall"), "auprc",
        F.coalesce(F.col("_p.tpr"), F.lit(0.0)).alias("recall_at_fpr"),
        F.when(both, F.coalesce(F.col("_p.cut"), F.lit(float("inf")))).alias("threshold_at_fpr"),
        F.when(both, F.coalesce(F.col("_p.fpr"), F.lit(0.0))).alias("actual_fpr"))


def full_metrics(df: DataFrame, threshold: DataFrame, label: str = "label", score: str = "score",
                 keys: Sequence[str] = (), on: Sequence[str] | None = None,
                 budget: float = FPR_BUDGET) -> DataFrame:
    """Average precision, threshold metrics and the operating point, one row per group, from one curve."""
    on = list(keys if on is None else on)
    curve = score_curve(df, label, score, keys, lead=True)
    return _curve_metrics(null_safe_join(curve, threshold.select(*on, "threshold"), on, "left"), keys, budget)


def tuned_metrics(df: DataFrame, split: str = "split", label: str = "label", score: str = "score",
                  keys: Sequence[str] = (), budget: float = FPR_BUDGET) -> DataFrame:
    """Tune the F1 cut on ``val`` per group, score ``val`` and ``test`` with it unchanged.

    One curve serves both: its ``val`` part gives the cut, which is joined back by group.
    """
    scored = df.where(F.col(split).isin("val", "test"))
    curve = score_curve(scored, label, score, [*keys, split], lead=True)
    threshold = _best_f1(curve.where(F.col(split) == "val"), keys).select(*keys, "threshold")
    return _curve_metrics(null_safe_join(curve, threshold, keys, "left"), [*keys, split], budget)


def task_score(df: DataFrame, task: str, label: str = "label", prediction: str = "prediction",
               keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy for a binary task, mean squared error for a regression."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    if task.upper() == "BINARY":
        return df.groupBy(*keys).agg(F.avg((y == p).cast("double")).alias("accuracy"))
    if task.upper() == "REG":
        return df.groupBy(*keys).agg(F.avg((y - p) * (y - p)).alias("mse"))
    raise ValueError(f"unknown task {task!r}: expected 'BINARY' or 'REG'")


def weighted_batch_mean(df: DataFrame, values: Sequence[str], weight: str,
                        keys: Sequence[str] = ()) -> DataFrame:
    """Mean of per-batch losses/metrics weighted by rows in the batch."""
    w = F.col(weight).cast("double")
    return df.groupBy(*keys).agg(*[
        (F.sum(F.col(v) * w) / F.nullif(F.sum(w), F.lit(0.0))).alias(v) for v in values])


@F.pandas_udf(StringType())
def four_places(values: pd.Series) -> pd.Series:
    """Four decimals, rounded from the exact binary value as C's printf does: 1/32 is 0.0312. Java's formatter rounds the shortest text, half up."""
    names = {np.inf: "Infinity", -np.inf: "-Infinity"}
    return values.map(lambda v: None if v is None or v != v else names.get(v) or f"{v:.4f}")


def operating_point_text(df: DataFrame, budget: float = FPR_BUDGET, out: str = "line") -> DataFrame:
    """One line per operating point; a missing number reads ``NA``."""
    safe = {c: F.when(F.isnan(c), "NaN").otherwise(F.coalesce(four_places(F.col(c)), F.lit("NA"))) for c in ("recall_at_fpr", "threshold_at_fpr", "actual_fpr")}
    return df.withColumn(out, F.concat(
        F.lit(f"recall@{budget * 100:g}%fpr="), safe["recall_at_fpr"],
        F.lit(" (thr="), safe["threshold_at_fpr"], F.lit(", fpr="), safe["actual_fpr"], F.lit(")")))
