"""Queries over score tables: M1-M14 and the tuned flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from rareclass.operators import metrics as m
from rareclass.operators.splits import stratified_split
from suite.common import (PROBABILITIES, RETURNED, SCORED, TOXIC, curve_sql, probabilities, returned,
                          rounded, scored, split_sql, table)


def tuned(spark, sf_dir):
    df = stratified_split(scored(spark, sf_dir), "row_id", "label", 42)
    return rounded(m.tuned_metrics(df, keys=["lang"]))


def operating_points(df, keys):
    return rounded(m.recall_at_fpr(df, keys=keys))


def batches(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    batch = ev.groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("loss"),
        F.avg((F.col("value") > 20).cast("double")).alias("hit"))
    return rounded(m.weighted_batch_mean(batch, ["loss", "hit"], "n", ["user_id"]))


def accuracy(spark, sf_dir):
    df = scored(spark, sf_dir).withColumn("prediction", (F.col("score") > -600).cast("int"))
    return rounded(m.task_score(df, "BINARY", keys=["lang"]))


def squared_error(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        "l_linestatus", F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("prediction"))
    return m.task_score(df, "REG", keys=["l_linestatus"]).select("l_linestatus", F.round("mse", 2).alias("mse"))


def margin_calibration(spark, sf_dir):
    df = scored(spark, sf_dir)
    return m.calibration_for_test(df, keys=["lang"], is_probability=False)


QUERIES = {
    "m1_average_precision": lambda s, d: rounded(m.average_precision(scored(s, d), keys=["lang"])),
    "m1_average_precision_tied": lambda s, d: rounded(m.average_precision(returned(s, d), keys=["l_linestatus"])),
    "m1_average_precision_toxic": lambda s, d: rounded(
        m.average_precision(scored(s, d, "toxic"), keys=["lang", "source"])),
    "m2_pr_curve": lambda s, d: rounded(m.pr_curve(scored(s, d), keys=["lang"])),
    "m3_best_f1_threshold": lambda s, d: rounded(m.best_f1_threshold(scored(s, d, "toxic"), keys=["lang", "source"])),
    "m3_best_f1_threshold_tied": lambda s, d: rounded(m.best_f1_threshold(returned(s, d), keys=["l_linestatus"])),
    "m4_metrics_at_threshold": lambda s, d: rounded(m.metrics_at_threshold(scored(s, d), -800.0, keys=["lang"])),
    "m5_roc_curve": lambda s, d: rounded(m.roc_curve(scored(s, d, "toxic"), keys=["lang"])),
    "m5_recall_at_fpr": lambda s, d: operating_points(scored(s, d, "toxic"), ["lang", "source"]),
    "m5_recall_at_fpr_tied": lambda s, d: operating_points(returned(s, d), ["l_linestatus"]),
    "m6_brier": lambda s, d: rounded(m.brier_score(probabilities(s, d), keys=["l_linestatus"])),
    "m7_m8_calibration": lambda s, d: rounded(m.calibration(probabilities(s, d), keys=["l_linestatus"]), 6),
    "m9_margin_calibration": margin_calibration,
    "m10_prevalence": lambda s, d: rounded(m.prevalence(scored(s, d), keys=["lang", "source"])),
    "m11_tuned_metrics": tuned,
    "m12_accuracy": accuracy,
    "m12_mse": squared_error,
    "m13_weighted_batch_mean": batches,
    "m14_operating_point_text": lambda s, d: m.operating_point_text(
        m.recall_at_fpr(scored(s, d, "toxic"), keys=["lang", "source"])).select("lang", "source", "line"),
}


def ap_sql(source, keys):
    return f"""WITH {curve_sql(source, keys)}
SELECT {keys}, round(SUM(CASE WHEN n_pos > 0 AND n_neg > 0
       THEN (tp_at::DOUBLE / n_pos) * (tp::DOUBLE / n) ELSE 0.0::DOUBLE END), 9) AS auprc
FROM curve GROUP BY {keys}"""


F1 = """CASE WHEN p + r > 0 THEN 2.0::DOUBLE * p * r / (p + r) ELSE 0.0::DOUBLE END"""


def f1_cte(keys):
    return f"""ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY f1 DESC, score ASC) AS pick FROM (
    SELECT *, {F1} AS f1 FROM (SELECT *, tp::DOUBLE / n AS p, tp::DOUBLE / n_pos AS r FROM curve
                               WHERE n_pos > 0 AND n_neg > 0))),
cutoff AS (
  SELECT {', '.join('g.' + k.strip() for k in keys.split(','))},
         coalesce(b.score, g.mid) AS threshold, b.f1 AS best_f1
  FROM (SELECT {keys}, median(score) AS mid FROM src GROUP BY {keys}) g
  LEFT JOIN (SELECT * FROM ranked WHERE pick = 1) b USING ({keys}))"""


def f1_sql(source, keys):
    return f"""WITH {curve_sql(source, keys)}, {f1_cte(keys)}
SELECT {keys}, round(threshold, 9) AS threshold, round(best_f1, 9) AS best_f1 FROM cutoff"""


def roc_cte(keys):
    return f"""steps AS (
  SELECT *, LEAD(tp_at) OVER w AS ntp, LEAD(fp_at) OVER w AS nfp FROM curve WHERE n_pos > 0 AND n_neg > 0
  WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC)),
roc AS (SELECT {keys}, score AS threshold, fp::DOUBLE / n_neg AS fpr, tp::DOUBLE / n_pos AS tpr, n AS n_flagged
        FROM steps WHERE n = n_at OR n = n_all OR ntp <> tp_at OR nfp <> fp_at)"""


def point_cte(keys):
    return f"""{roc_cte(keys)},
inside AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY n_flagged DESC) AS pick
           FROM roc WHERE fpr <= 0.05::DOUBLE),
point AS (
  SELECT {', '.join('g.' + k.strip() for k in keys.split(','))}, coalesce(i.tpr, 0.0::DOUBLE) AS recall_at_fpr,
         CASE WHEN both_classes THEN coalesce(i.threshold, 'inf'::DOUBLE) END AS threshold_at_fpr,
         CASE WHEN both_classes THEN coalesce(i.fpr, 0.0::DOUBLE) END AS actual_fpr
  FROM (SELECT {keys}, MAX(label) = 1 AND MIN(label) = 0 AS both_classes FROM src GROUP BY {keys}) g
  LEFT JOIN (SELECT * FROM inside WHERE pick = 1) i USING ({keys}))"""


def point_sql(source, keys):
    return f"""WITH {curve_sql(source, keys)}, {point_cte(keys)}
SELECT {keys}, round(recall_at_fpr, 9) AS recall_at_fpr, round(threshold_at_fpr, 9) AS threshold_at_fpr,
       round(actual_fpr, 9) AS actual_fpr FROM point"""


AT_CUT = """round(CASE WHEN n_pos + tp + fp > 0 THEN 2.0::DOUBLE * tp / (n_pos + tp + fp) ELSE 0.0::DOUBLE END, 9) AS f1,
round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0::DOUBLE END, 9) AS "precision",
round(CASE WHEN n_pos > 0 THEN tp::DOUBLE / n_pos ELSE 0.0::DOUBLE END, 9) AS recall"""

COUNTS = """COUNT(*) AS n_rows, COUNT(*) FILTER (score >= threshold AND label = 1) AS tp,
COUNT(*) FILTER (score >= threshold AND label = 0) AS fp, COUNT(*) FILTER (label = 1) AS n_pos"""

# Newton steps for the slope model and bisection for the shift, over distinct logits
CALIBRATION = f"""
WITH RECURSIVE src AS ({PROBABILITIES}),
pts AS (SELECT l_linestatus, ln(c / (1 - c)) AS x, SUM(label)::DOUBLE AS pos, COUNT(*)::DOUBLE AS w FROM (
          SELECT l_linestatus, label, greatest(1e-6::DOUBLE, least(1.0::DOUBLE - 1e-6::DOUBLE, score)) AS c FROM src)
        GROUP BY 1, 2),
base AS (SELECT l_linestatus, AVG(label::DOUBLE) AS ybar, COUNT(*)::DOUBLE AS n,
                AVG((score - label) * (score - label)) AS brier FROM src GROUP BY 1),
slope AS (
  SELECT l_linestatus, 0 AS i, ln(ybar / (1 - ybar)) AS a, 0.0::DOUBLE AS b FROM base
  UNION ALL
  SELECT l_linestatus, i + 1, a + (hbb * ga - hab * gb) / (haa * hbb - hab * hab),
         b + (haa * gb - hab * ga) / (haa * hbb - hab * hab)
  FROM (SELECT l_linestatus, i, a, b, SUM(pos - w * mu) AS ga, SUM((pos - w * mu) * x) AS gb,
               SUM(w * mu * (1 - mu)) AS haa, SUM(w * mu * (1 - mu) * x) AS hab, SUM(w * mu * (1 - mu) * x * x) AS hbb
        FROM (SELECT s.*, x, pos, w, 1 / (1 + exp(-(a + b * x))) AS mu FROM slope s JOIN pts USING (l_linestatus))
        GROUP BY l_linestatus, i, a, b) WHERE i < 12),
shift AS (
  SELECT l_linestatus, 0 AS i, -50.0::DOUBLE AS lo, 50.0::DOUBLE AS hi, ybar, n FROM base
  UNION ALL
  SELECT l_linestatus, i + 1, CASE WHEN mean < ybar THEN (lo + hi) / 2 ELSE lo END,
         CASE WHEN mean < ybar THEN hi ELSE (lo + hi) / 2 END, ybar, n
  FROM (SELECT l_linestatus, i, lo, hi, ybar, n, SUM(w / (1 + exp(-((lo + hi) / 2 + x)))) / n AS mean
        FROM shift JOIN pts USING (l_linestatus) GROUP BY l_linestatus, i, lo, hi, ybar, n) WHERE i < 50)
SELECT base.l_linestatus, round(brier, 6) AS brier, round((lo + hi) / 2, 6) AS cal_intercept, round(b, 6) AS cal_slope
FROM base JOIN slope ON slope.l_linestatus = base.l_linestatus AND slope.i = 12
JOIN shift ON shift.l_linestatus = base.l_linestatus AND shift.i = 50"""

ORACLES = {
    "m1_average_precision": ap_sql(SCORED, "lang"),
    "m1_average_precision_tied": ap_sql(RETURNED, "l_linestatus"),
    "m1_average_precision_toxic": ap_sql(TOXIC, "lang, source"),
    "m2_pr_curve": f"""WITH {curve_sql(SCORED, 'lang')}
SELECT lang, round(score, 9) AS threshold, round(tp::DOUBLE / n, 9) AS "precision", round(tp::DOUBLE / n_pos, 9) AS recall
FROM curve WHERE n_pos > 0 AND n_neg > 0
UNION ALL SELECT DISTINCT lang, NULL::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE FROM curve WHERE n_pos > 0 AND n_neg > 0""",
    "m3_best_f1_threshold": f1_sql(TOXIC, "lang, source"),
    "m3_best_f1_threshold_tied": f1_sql(RETURNED, "l_linestatus"),
    "m4_metrics_at_threshold": f"""SELECT lang, threshold, n_rows, {AT_CUT}
FROM (SELECT lang, -800.0::DOUBLE AS threshold, {COUNTS.replace('threshold', '-800.0')} FROM ({SCORED}) GROUP BY lang)""",
    "m5_roc_curve": f"""WITH {curve_sql(TOXIC, 'lang')}, {roc_cte('lang')}
SELECT lang, threshold, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr, n_flagged FROM roc""",
    "m5_recall_at_fpr": point_sql(TOXIC, "lang, source"),
    "m5_recall_at_fpr_tied": point_sql(RETURNED, "l_linestatus"),
    "m6_brier": f"""SELECT l_linestatus, round(AVG((score - label) * (score - label)), 9) AS brier
FROM ({PROBABILITIES}) GROUP BY l_linestatus""",
    "m7_m8_calibration": CALIBRATION,
    "m9_margin_calibration": f"""SELECT lang, NULL::DOUBLE AS test_brier, NULL::DOUBLE AS test_cal_intercept,
NULL::DOUBLE AS test_cal_slope FROM ({SCORED}) GROUP BY lang""",
    "m10_prevalence": f"""SELECT lang, source, round(AVG(label::DOUBLE), 9) AS baseline_auprc
FROM ({SCORED}) GROUP BY lang, source""",
    "m11_tuned_metrics": f"""WITH everything AS ({split_sql(SCORED)}),
tune AS (WITH {curve_sql("SELECT * FROM everything WHERE split = 'val'", 'lang')}, {f1_cte('lang')} SELECT * FROM cutoff),
sc AS (SELECT * FROM everything WHERE split IN ('val', 'test')),
ap AS (WITH {curve_sql('SELECT * FROM sc', 'lang, split')}
  SELECT lang, split, SUM(CASE WHEN n_pos > 0 AND n_neg > 0 THEN (tp_at::DOUBLE / n_pos) * (tp::DOUBLE / n)
         ELSE 0.0::DOUBLE END) AS auprc FROM curve GROUP BY lang, split),
pt AS (WITH {curve_sql('SELECT * FROM sc', 'lang, split')}, {point_cte('lang, split')} SELECT * FROM point),
cn AS (SELECT lang, split, any_value(threshold) AS threshold, {COUNTS}
       FROM sc LEFT JOIN tune USING (lang) GROUP BY lang, split)
SELECT lang, split, round(threshold, 9) AS threshold, n_rows, {AT_CUT}, round(auprc, 9) AS auprc,
       round(recall_at_fpr, 9) AS recall_at_fpr, round(threshold_at_fpr, 9) AS threshold_at_fpr,
       round(actual_fpr, 9) AS actual_fpr
FROM cn JOIN ap USING (lang, split) JOIN pt USING (lang, split)""",
    "m12_accuracy": f"""SELECT lang, round(AVG(CASE WHEN label = CAST(score > -600 AS INT) THEN 1.0::DOUBLE
ELSE 0.0::DOUBLE END), 9) AS accuracy FROM ({SCORED}) GROUP BY lang""",
    "m12_mse": """SELECT l_linestatus, round(AVG((l_extendedprice - l_quantity * 1500) *
(l_extendedprice - l_quantity * 1500)), 2) AS mse FROM lineitem GROUP BY l_linestatus""",
    "m13_weighted_batch_mean": """WITH b AS (SELECT user_id, event_type, COUNT(*) AS n, AVG(value) AS loss,
AVG(CASE WHEN value > 20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS hit FROM events GROUP BY user_id, event_type)
SELECT user_id, round(SUM(loss * n) / SUM(n), 9) AS loss, round(SUM(hit * n) / SUM(n), 9) AS hit FROM b GROUP BY user_id""",
    "m14_operating_point_text": f"""WITH {curve_sql(TOXIC, 'lang, source')}, {point_cte('lang, source')}
SELECT lang, source, 'recall@5%fpr=' || printf('%.4f', recall_at_fpr) || ' (thr=' ||
  coalesce(CASE WHEN isinf(threshold_at_fpr) THEN 'Infinity' ELSE printf('%.4f', threshold_at_fpr) END, 'NA') ||
  ', fpr=' || coalesce(printf('%.4f', actual_fpr), 'NA') || ')' AS line FROM point""",
}
