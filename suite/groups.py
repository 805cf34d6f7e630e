"""Queries over group fitting, combination and round histories: R1-R26, S20, S21 live in storage."""

from __future__ import annotations

from pyspark.sql import functions as F

from rareclass.functions.hashing import hash_uniform
from rareclass.functions.ranks import running_totals
from rareclass.operators import groupfit as r
from rareclass.operators import trees as t
from rareclass.operators.solver import solve_clients
from rareclass.operators.splits import stratified_split
from rareclass.plans.grouped import grouped_run, round_weights
from rareclass.session import cut_lineage
from suite.common import SCORED, curve_sql, md5_uniform, rounded, scored, split_sql, table
from suite.explanations import EXPLAINED, explained
from suite.scores import AT_CUT, COUNTS, f1_cte, point_cte

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
STACK = dict(iterations=t.STACK_TREES, subsample=t.STACK_SUBSAMPLE)


def history(spark, sf_dir):
    """A run per user: its events in order are rounds 0, 1, ...; coarse values give many ties."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.lit(1).alias("one"))
    run = running_totals(ev, "event_id", {"seq": "one"}, ["user_id"])
    return run.select(
        F.col("user_id").alias("run_id"), (F.col("seq") - 1).cast("int").alias("round"),
        F.when(F.col("user_id") % 5 != 0, F.floor(F.col("value") / 10) / 50).alias("val_auprc"),
        (F.floor(F.col("value")) / 500).alias("test_auprc"), (F.floor(F.col("value")) / 1000).alias("val_f1"))


HISTORY = """SELECT user_id AS run_id, (ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS round,
 CASE WHEN user_id % 5 <> 0 THEN floor(value / 10) / 50 END AS val_auprc, floor(value) / 500 AS test_auprc,
 floor(value) / 1000 AS val_f1 FROM events"""


def updates(spark, sf_dir):
    """Round = user, client = event type; rows, accuracy and two layers of parameters."""
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(F.col("user_id").alias("round"), F.col("event_type").alias("client_id")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(((F.col("value") > 60) & (F.col("user_id") % 4 != 0)).cast("double")).alias("alpha"),
        F.array(F.avg("value"), F.min("value"), F.max("value")).alias("first"), F.array(F.stddev_pop("value")).alias("second"))


def params(spark, sf_dir):
    return updates(spark, sf_dir).select("round", "client_id", F.explode(
        F.create_map(F.lit("first"), F.col("first"), F.lit("second"), F.col("second"))).alias("layer", "w"))


UPDATES = """up AS (SELECT user_id AS round, event_type AS client_id, COUNT(*) AS n,
 AVG(CAST(value > 60 AND user_id % 4 <> 0 AS DOUBLE)) AS alpha, [AVG(value), MIN(value), MAX(value)] AS first, [stddev_pop(value)] AS second
 FROM events GROUP BY ALL),
wt AS (SELECT *, na = 0 AS is_fallback, CASE WHEN na = 0 THEN n::DOUBLE / nn ELSE n * alpha / na END AS weight FROM (
 SELECT *, SUM(n * alpha) OVER (PARTITION BY round) AS na, SUM(n) OVER (PARTITION BY round) AS nn FROM up)),
pr AS (SELECT round, client_id, 'first' AS layer, i - 1 AS pos, first[i] AS w FROM up, range(1, 4) t(i)
 UNION ALL SELECT round, client_id, 'second', 0, second[1] FROM up)"""


def metric_rows(spark, sf_dir):
    """Client metrics; the second one is missing on some clients."""
    u = updates(spark, sf_dir)
    return u.select("round", "client_id", F.explode(F.create_map(
        F.lit("loss"), F.col("first")[0], F.lit("spread"), F.when(F.col("n") % 2 == 0, F.col("second")[0]))).alias("metric", "value")
    ).where("value IS NOT NULL")


def client_scores(spark, sf_dir):
    return updates(spark, sf_dir).select(
        "round", (F.length("client_id") % 6).alias("client_id"), F.round("alpha", 1).alias("auprc"),
        (F.col("n") < F.when(F.col("round") % 7 == 0, 1000).otherwise(10)).alias("skipped"))


BEST = f"""WITH {UPDATES}, cs AS (SELECT round, (len(client_id) % 6)::INT AS client_id, round(alpha, 1) AS auprc,
 n < CASE WHEN round % 7 = 0 THEN 1000 ELSE 10 END AS skipped FROM up),
best AS (SELECT round, -MAX(-client_id) FILTER (rk = 1) AS client_id, MAX(auprc) FILTER (rk = 1) AS auprc, COUNT(*) FILTER (NOT skipped) AS n_eligible
 FROM (SELECT *, CASE WHEN NOT skipped THEN ROW_NUMBER() OVER (PARTITION BY round, skipped ORDER BY auprc DESC, client_id) END AS rk FROM cs) GROUP BY round)"""


def carried(spark, sf_dir):
    best = r.best_model(client_scores(spark, sf_dir), ["round"]).withColumn("run", F.col("round") % 3)
    return r.carry_best(best, ["run"]).select("run", "round", "client_id", "kept")


def margins(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), (F.col("label") == 0).cast("int").alias("label"), (F.col("vec_id") % 3).alias("grp"),
        F.transform("embedding", lambda v: v.cast("double")).alias("margins"))


PREFIX = "SELECT vec_id % 3 AS grp, k AS prefix, CAST(label = 0 AS INT) AS label, list_sum(embedding[1:k]::DOUBLE[]) AS score FROM embeddings, range(1, 65) t(k)"


def kept(spark, sf_dir):
    """Some groups of events have one class only and keep what they came with."""
    ev = table(spark, sf_dir, "events").select(
        F.concat_ws("/", "user_id", "event_type").alias("client_id"), (F.col("value") > 120).cast("int").alias("label"), "value")
    fitted = ev.groupBy("client_id").agg(F.round(F.max("value"), 2).alias("w"))
    incoming = ev.groupBy("client_id").agg(F.round(F.min("value"), 2).alias("w"))
    return r.keep_incoming(fitted, incoming, ev)


def rounds_scored(spark, sf_dir):
    df = stratified_split(scored(spark, sf_dir), "row_id", "label", 42).withColumn("round", F.explode(F.lit([0, 1, 2, 3])))
    return df.withColumn("score", F.round(hash_uniform(F.col("round"), "row_id") + F.col("round") * 0.1 * F.col("label"), 2))


ROUNDS_SCORED = f"""SELECT row_id, label, split, round, round({md5_uniform("round || ':' || row_id")} + round * 0.1 * label, 2) AS score
 FROM ({split_sql(SCORED)}), (VALUES (0), (1), (2), (3)) t(round)"""


def wide_back(spark, sf_dir):
    long = history(spark, sf_dir).unpivot(["run_id", "round"], ["val_auprc", "test_auprc", "val_f1"], "metric", "value")
    return r.history_wide(long, ["val_auprc", "test_auprc", "val_f1"])


def best_metrics(spark, sf_dir):
    long = history(spark, sf_dir).unpivot(["run_id", "round"], ["val_auprc", "test_auprc", "val_f1"], "metric", "value")
    return r.best_per_metric(long.where("value IS NOT NULL"))


def at_best(spark, sf_dir):
    h = history(spark, sf_dir)
    return r.metrics_at_best(r.best_round(h), h, ["val_f1", "test_auprc"])


def stop_cut(spark, sf_dir):
    h = r.monitored(history(spark, sf_dir))
    return r.early_stop_cut(h, value="watched", patience=5).groupBy("run_id").agg(
        F.max("stop_round").alias("stop_round"), F.count(F.lit(1)).alias("n_kept"))


def split_clients(spark, sf_dir):
    return cut_lineage(stratified_split(explained(spark, sf_dir), "row_id", "label", 42))


def local_fits(kind):
    def run(spark, sf_dir):
        w, _ = r.fit_clients(explained(spark, sf_dir), SEGMENTS, 3, kind)
        return rounded(r.weights_table(spark, w), 6)
    return run


def two_features(spark, sf_dir):
    """R1 as a table: the weights of every client on the first two features."""
    rows = explained(spark, sf_dir).withColumn("features", F.slice("features", 1, 2))
    return rounded(solve_clients(rows, 2).select(F.col("c").alias("client_id"), "rows", F.posexplode("w").alias("pos", "w")), 6)


def grouped(kind, steps=None, **how):
    def run(spark, sf_dir):
        return rounded(grouped_run(split_clients(spark, sf_dir), SEGMENTS, 3, kind, rounds=20, steps=steps, **how)[0], 6)
    return run


def boosted(spark, sf_dir, **settings):
    df = split_clients(spark, sf_dir)
    return t.fit_boosters(df.where("split = 'train'"), row_id="row_id", **settings), df


def best_booster(spark, sf_dir):
    """Every client's booster at its best prefix on val; the best one wins."""
    forest, df = boosted(spark, sf_dir)
    ap = t.best_prefix(forest, df.where("split = 'val'")).withColumn("skipped", F.lit(False))
    return rounded(r.best_model(ap))


def shipped(spark, sf_dir):
    """Order lines with three features of few values and fifty clients."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 50).alias("client_id"), (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.array(F.col("l_quantity").cast("double"), F.col("l_discount").cast("double"), F.col("l_tax").cast("double")).alias("features"))


def first_splits(**how):
    """The first split of each client, with what it gives on either side."""
    def run(spark, sf_dir):
        forest = t.fit_boosters(shipped(spark, sf_dir), iterations=1, depth=1, **how)
        split = F.col("feature")[0] >= 0
        return rounded(forest.select("client_id", F.col("feature")[0].alias("feature"), F.when(split, F.col("cut")[0]).alias("cut"),
                                     F.when(split, F.col("value")[1]).alias("below"), F.when(split, F.col("value")[2]).alias("above")))
    return run


def stacked(spark, sf_dir):
    """R16 + R17: margins of all clients' trees, weights for them learnt per client and averaged by rows."""
    forest, df = boosted(spark, sf_dir, **STACK)
    width = STACK["iterations"] * len(SEGMENTS)
    train = df.where("split = 'train'")
    sizes = {x["client_id"]: x["n"] for x in train.groupBy("client_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    kinds = t.stacked_kinds(forest, SEGMENTS, train)
    combined, _ = round_weights(kinds, SEGMENTS, width, rounds=1, vec="stack", sizes=sizes, times="times")
    return rounded(r.weights_table(spark, {"combined": combined[-1]}), 6)


def pooled(model):
    def run(spark, sf_dir):
        return rounded(t.pooled_baseline(split_clients(spark, sf_dir), model)[1], 6)
    return run


def standalone(spark, sf_dir):
    df = split_clients(spark, sf_dir)
    return rounded(t.standalone_clients(df.where("split = 'train'"), df.where("split = 'test'")))


def batch_scores(spark, sf_dir):
    df = split_clients(spark, sf_dir)
    fitted = t.fit_pooled(df.where("split = 'train'"))
    return rounded(t.margin_scores(fitted, df.where("split <> 'train'").select("row_id", "split", "features")).drop("features"), 6)


QUERIES = {
    "r1_local_logistic": local_fits("logistic"),
    "r1_two_features": two_features,
    "r2_local_hinge": local_fits("hinge"),
    "r3_keep_incoming": kept,
    "r4_average_by_rows": lambda s, d: rounded(r.combine_parameters(params(s, d), updates(s, d))),
    "r5_average_by_accuracy": lambda s, d: rounded(r.combine_parameters(params(s, d), updates(s, d), "alpha")),
    "r6_combine_metrics": lambda s, d: rounded(r.combine_metrics(metric_rows(s, d), updates(s, d))),
    "r7_client_weights": lambda s, d: rounded(r.client_weights(updates(s, d), alpha="alpha").select(
        "round", "client_id", "n", "alpha", "weight", "is_fallback")),
    "r8_local_auprc": lambda s, d: rounded(r.local_auprc(scored(s, d, "toxic"), "source")),
    "r10_grouped_run_logistic": grouped("logistic"),
    "r10_grouped_run_hinge": grouped("hinge"),
    "r10_grouped_run_accuracy": grouped("logistic", weighting="accuracy"),
    "r11_first_splits": first_splits(),
    "r11_first_splits_by_level": first_splits(task_cells=0),
    "r11_r12_best_booster": best_booster,
    "r12_best_model": lambda s, d: r.best_model(client_scores(s, d), ["round"]),
    "r12_carry_best": carried,
    "r13_select_prefix": lambda s, d: rounded(r.select_prefix(margins(s, d), keys=["grp"])),
    "r14_truncate_margins": lambda s, d: rounded(r.truncate_margins(margins(s, d), 5).select("row_id", "score")),
    "r16_r17_stacked_trees": stacked,
    "r18_pooled_logistic": pooled("lr"),
    "r18_pooled_hinge": pooled("svm"),
    "r18_pooled_boosted": pooled("gbm"),
    "r19_round_evaluation": lambda s, d: rounded(r.round_evaluation(rounds_scored(s, d))),
    "r20_early_stop_flag": lambda s, d: r.early_stop_flag(history(s, d), value="test_auprc"),
    "r21_early_stop_cut": stop_cut,
    "r22_history_wide": wide_back,
    "r22_best_round": lambda s, d: r.best_round(history(s, d)),
    "r22_final_test_row": lambda s, d: r.final_test_row(history(s, d)),
    "r23_metrics_at_best": at_best,
    "r24_best_per_metric": best_metrics,
    "r25_standalone_clients": standalone,
    "r26_batch_scores": batch_scores,
}

COMBINED = """SELECT round, layer, pos::INT AS pos, round(SUM({w} * w), 9) AS w FROM pr JOIN wt USING (round, client_id) GROUP BY ALL"""

FIRST_MAX = """best AS (SELECT run_id, best_round, best_value, final_round FROM (
 SELECT run_id, CASE WHEN any_value(val_auprc) IS NULL THEN arg_max(round, (test_auprc, -round)) ELSE arg_max(round, (val_auprc, -round)) END AS best_round,
  coalesce(MAX(val_auprc), MAX(test_auprc)) AS best_value, MAX(round) AS final_round FROM h WHERE round >= 1 GROUP BY run_id))"""

STOP_B = f"""WITH h AS (SELECT *, coalesce(val_auprc, test_auprc) AS v FROM ({HISTORY})),
a AS (SELECT *, MAX(v) OVER (PARTITION BY run_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM h),
c AS (SELECT *, b IS NULL OR v > b AS up, SUM(CASE WHEN v < b THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY round ROWS UNBOUNDED PRECEDING) AS drops FROM a),
e AS (SELECT *, drops - MAX(CASE WHEN up THEN drops END) OVER (PARTITION BY run_id ORDER BY round ROWS UNBOUNDED PRECEDING) AS waited FROM c),
s AS (SELECT run_id, MIN(round) FILTER (waited >= 5) AS stop_round FROM e GROUP BY run_id)
SELECT run_id, any_value(stop_round) AS stop_round, COUNT(*) AS n_kept FROM h JOIN s USING (run_id)
WHERE stop_round IS NULL OR round <= stop_round GROUP BY run_id"""

FIRST_SPLITS = """WITH x AS (SELECT l_suppkey % 50 AS client_id, CAST(l_returnflag = 'R' AS INT) AS y, [l_quantity, l_discount, l_tax] AS f FROM lineitem),
e AS (SELECT client_id, y, j::INT - 1 AS feature, f[j] AS v FROM x, range(1, 4) t(j)),
b AS (SELECT feature, v AS cut, ROW_NUMBER() OVER (PARTITION BY feature ORDER BY v) AS bin FROM (SELECT DISTINCT feature, v FROM e)),
s AS (SELECT client_id, feature, bin, cut, SUM(CASE WHEN v < cut THEN 0.5 - y ELSE 0 END)::DOUBLE AS gl, SUM(CASE WHEN v < cut THEN 0.25 ELSE 0 END)::DOUBLE AS hl,
 SUM(0.5 - y)::DOUBLE AS g, SUM(0.25)::DOUBLE AS h FROM e JOIN b USING (feature) WHERE bin > 1 GROUP BY ALL),
w AS (SELECT *, gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1) AS gain FROM s WHERE hl >= 1 AND h - hl >= 1),
best AS (SELECT * FROM w WHERE gain > 1e-9 QUALIFY ROW_NUMBER() OVER (PARTITION BY client_id ORDER BY gain DESC, feature, bin) = 1)
SELECT client_id, coalesce(feature, -1) AS feature, round(cut, 9) AS cut, round(-0.1::DOUBLE * gl / (hl + 1), 9) AS below, round(-0.1::DOUBLE * (g - gl) / (h - hl + 1), 9) AS above
FROM (SELECT client_id FROM x GROUP BY client_id HAVING MIN(y) <> MAX(y)) LEFT JOIN best USING (client_id)"""

NEWTON = f"""WITH RECURSIVE x AS (SELECT client_id, label::DOUBLE AS y, features[1] AS a, features[2] AS b FROM ({EXPLAINED})),
nw AS (SELECT 0 AS it, client_id, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v, 0.0::DOUBLE AS c FROM x GROUP BY client_id
 UNION ALL SELECT it + 1, client_id,
  u - (g1 * (h22 * h33 - h23 * h23) - h12 * (g2 * h33 - h23 * g3) + h13 * (g2 * h23 - h22 * g3)) / det,
  v - (h11 * (g2 * h33 - g3 * h23) - g1 * (h12 * h33 - h23 * h13) + h13 * (h12 * g3 - g2 * h13)) / det,
  c - (h11 * (h22 * g3 - h23 * g2) - h12 * (h12 * g3 - g2 * h13) + g1 * (h12 * h23 - h22 * h13)) / det
 FROM (SELECT *, h11 * (h22 * h33 - h23 * h23) - h12 * (h12 * h33 - h23 * h13) + h13 * (h12 * h23 - h22 * h13) AS det FROM (
  SELECT it, client_id, u, v, c, u + SUM((m - y) * a) AS g1, v + SUM((m - y) * b) AS g2, SUM(m - y) AS g3, 1 + SUM(s * a * a) AS h11, SUM(s * a * b) AS h12,
   SUM(s * a) AS h13, 1 + SUM(s * b * b) AS h22, SUM(s * b) AS h23, SUM(s) AS h33
  FROM (SELECT *, m * (1 - m) AS s FROM (SELECT nw.*, y, a, b, 1 / (1 + exp(-(u * a + v * b + c))) AS m FROM nw JOIN x USING (client_id)))
  GROUP BY it, client_id, u, v, c)) WHERE it < 25),
n AS (SELECT client_id, COUNT(*) AS rows FROM x GROUP BY client_id)
SELECT client_id, rows, i::INT AS pos, round([u, v, c][i + 1], 6) + 0.0 AS w FROM nw JOIN n USING (client_id), range(3) t(i) WHERE it = 25"""

ORACLES = {
    "r1_two_features": NEWTON,
    "r11_first_splits": FIRST_SPLITS,
    "r11_first_splits_by_level": FIRST_SPLITS,
    "r3_keep_incoming": """SELECT client_id, CASE WHEN lo < hi THEN mx ELSE mn END AS w, lo = hi AS skipped FROM (
 SELECT user_id || '/' || event_type AS client_id, MIN(CAST(value > 120 AS INT)) AS lo, MAX(CAST(value > 120 AS INT)) AS hi,
  round(MAX(value), 2) AS mx, round(MIN(value), 2) AS mn FROM events GROUP BY 1)""",
    "r4_average_by_rows": f"WITH {UPDATES} " + COMBINED.format(w="(n::DOUBLE / nn)"),
    "r5_average_by_accuracy": f"WITH {UPDATES} " + COMBINED.format(w="weight"),
    "r6_combine_metrics": f"""WITH {UPDATES} SELECT round, 'loss' AS metric, round(SUM(n * first[1]) / SUM(n), 9) AS value FROM up GROUP BY round
 UNION ALL SELECT round, 'spread', round(SUM(CASE WHEN n % 2 = 0 THEN n * second[1] ELSE 0 END) / SUM(n), 9) FROM up GROUP BY round HAVING bool_or(n % 2 = 0)""",
    "r7_client_weights": f"WITH {UPDATES} SELECT round, client_id, n, round(alpha, 9) AS alpha, round(weight, 9) AS weight, is_fallback FROM wt",
    "r8_local_auprc": f"""WITH {curve_sql(SCORED.replace('l.quality', 'l.toxic'), 'source')}
SELECT source, round(SUM(CASE WHEN n_pos > 0 AND n_neg > 0 THEN (tp_at::DOUBLE / n_pos) * (tp::DOUBLE / n) ELSE 0.0::DOUBLE END), 9) AS local_auprc
FROM curve GROUP BY source""",
    "r12_best_model": BEST + " SELECT round, client_id, auprc, n_eligible FROM best",
    "r12_carry_best": BEST + """ SELECT round % 3 AS run, round, client_id, last_value(client_id IGNORE NULLS) OVER (
 PARTITION BY round % 3 ORDER BY round ROWS UNBOUNDED PRECEDING) AS kept FROM best""",
    "r13_select_prefix": f"""WITH {curve_sql(PREFIX, 'grp, prefix')}, ap AS (SELECT grp, prefix, SUM((tp_at::DOUBLE / n_pos) * (tp::DOUBLE / n)) AS auprc
 FROM curve WHERE n_pos > 0 AND n_neg > 0 GROUP BY ALL)
SELECT grp, prefix::INT AS prefix, round(auprc, 9) AS auprc FROM ap QUALIFY ROW_NUMBER() OVER (PARTITION BY grp ORDER BY auprc DESC, prefix) = 1""",
    "r14_truncate_margins": "SELECT vec_id AS row_id, round(list_sum(embedding[1:5]::DOUBLE[]), 9) AS score FROM embeddings",
    "r19_round_evaluation": f"""WITH everything AS (SELECT * FROM ({ROUNDS_SCORED}) WHERE split = 'val' OR (split = 'test' AND round = 3)),
tune AS (WITH {curve_sql("SELECT * FROM everything WHERE split = 'val'", 'round')}, {f1_cte('round')} SELECT * FROM cutoff),
ap AS (WITH {curve_sql('SELECT * FROM everything', 'round, split')} SELECT round, split, SUM(CASE WHEN n_pos > 0 AND n_neg > 0 THEN (tp_at::DOUBLE / n_pos) * (tp::DOUBLE / n)
 ELSE 0.0::DOUBLE END) AS auprc FROM curve GROUP BY round, split),
pt AS (WITH {curve_sql('SELECT * FROM everything', 'round, split')}, {point_cte('round, split')} SELECT * FROM point),
cn AS (SELECT round, split, any_value(threshold) AS threshold, {COUNTS} FROM everything LEFT JOIN tune USING (round) GROUP BY round, split)
SELECT round, split, round(threshold, 9) AS threshold, n_rows, {AT_CUT}, round(auprc, 9) AS auprc, round(recall_at_fpr, 9) AS recall_at_fpr,
 round(threshold_at_fpr, 9) AS threshold_at_fpr, round(actual_fpr, 9) AS actual_fpr FROM cn JOIN ap USING (round, split) JOIN pt USING (round, split)""",
    "r20_early_stop_flag": f"""WITH h AS (SELECT * FROM ({HISTORY}) WHERE round > 0),
a AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY round) AS idx,
 MAX(test_auprc) OVER (PARTITION BY run_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM h),
c AS (SELECT *, idx - MAX(CASE WHEN b IS NULL OR test_auprc > b THEN idx END) OVER (PARTITION BY run_id ORDER BY round ROWS UNBOUNDED PRECEDING) AS waited FROM a)
SELECT run_id, MIN(round) FILTER (waited >= 10) AS early_stop_round FROM c GROUP BY run_id""",
    "r21_early_stop_cut": STOP_B,
    "r22_history_wide": HISTORY,
    "r22_best_round": f"WITH h AS ({HISTORY}), {FIRST_MAX} SELECT * FROM best",
    "r22_final_test_row": f"SELECT * FROM ({HISTORY}) QUALIFY round = MAX(round) OVER (PARTITION BY run_id)",
    "r23_metrics_at_best": f"""WITH h AS ({HISTORY}), {FIRST_MAX} SELECT best.*, h.val_f1 AS best_val_f1, h.test_auprc AS best_test_auprc
 FROM best LEFT JOIN h ON h.run_id = best.run_id AND h.round = best.best_round""",
    "r24_best_per_metric": f"""WITH h AS ({HISTORY}), l AS (UNPIVOT h ON val_auprc, test_auprc, val_f1 INTO NAME metric VALUE value)
SELECT run_id, metric, MAX(value) AS best_res, arg_max(round, (value, -round)) AS best_res_round FROM l GROUP BY ALL""",
}
