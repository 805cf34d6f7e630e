"""Queries over the run ledger: L1-L24, S11, S17. A run is a group of orders; its cells are text as in a stored ledger."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rareclass.operators import ledger as l
from suite.common import rounded, table

DATASETS = ("AUTOMOBILE", "BUILDING", "FURNITURE")
BUDGETS = {"m5": 50}
ALPHAS, SEEDS = [0.5, 1.0, 5.0], [42, 123]


def text(x, div):
    return F.format_string("%.4f", (x % div) / F.lit(float(div)))


def runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    nation = F.col("c_nationkey")
    scheme = F.when(F.col("o_orderstatus") == "F", "centralized").when(F.col("o_orderstatus") == "O", "iid").otherwise("dirichlet")
    base = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("c_mktsegment").alias("dataset"), F.concat(F.lit("m"), F.substring("o_orderpriority", 1, 1)).alias("model"),
        scheme.alias("scheme"), F.when(F.col("o_orderstatus") == "P", F.when(nation % 2 == 0, "0.5").otherwise("1.0")).otherwise("").alias("alpha"),
        F.when(nation % 3 == 0, "smote").otherwise("none").alias("oversampling"), nation.cast("string").alias("random_seed"),
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_orderkey") % 101).alias("s"))
    n, s, grouped = F.col("n"), F.col("s"), F.col("scheme") != "centralized"
    return base.select(
        "dataset", "model", "scheme", "alpha", "oversampling", "random_seed", "n", "s",
        F.concat_ws("_", "dataset", "model", "scheme", "random_seed").alias("run_name"),
        text(s, 97).alias("test_auprc"), F.when(n % 3 == 0, "").otherwise(text(s, 13)).alias("baseline_auprc"),
        F.when(n % 7 == 0, "NA").when(n % 5 == 0, "").otherwise(text(s, 89)).alias("test_brier"),
        F.when(~grouped, "n/a").otherwise(n.cast("string")).alias("rounds_completed"),
        F.when(n % 2 == 0, "").otherwise("30").alias("num_rounds"),
        F.when(n % 4 == 0, "").when(n % 4 == 1, F.md5(F.concat("dataset", F.lit("x")))).otherwise(F.md5("dataset")).alias("data_hash"),
        F.when(grouped, F.md5(F.concat("dataset", "scheme", "alpha"))).otherwise("").alias("partition_hash"),
        F.when(n % 6 == 0, "failed").otherwise("success").alias("status"))


RUNS = """SELECT *, dataset || '_' || model || '_' || scheme || '_' || random_seed AS run_name, printf('%.4f', (s % 97) / 97.0::DOUBLE) AS test_auprc,
 CASE WHEN n % 3 = 0 THEN '' ELSE printf('%.4f', (s % 13) / 13.0::DOUBLE) END AS baseline_auprc,
 CASE WHEN n % 7 = 0 THEN 'NA' WHEN n % 5 = 0 THEN '' ELSE printf('%.4f', (s % 89) / 89.0::DOUBLE) END AS test_brier,
 CASE WHEN scheme = 'centralized' THEN 'n/a' ELSE n::VARCHAR END AS rounds_completed, CASE WHEN n % 2 = 0 THEN '' ELSE '30' END AS num_rounds,
 CASE WHEN n % 4 = 0 THEN '' WHEN n % 4 = 1 THEN md5(dataset || 'x') ELSE md5(dataset) END AS data_hash,
 CASE WHEN scheme = 'centralized' THEN '' ELSE md5(dataset || scheme || alpha) END AS partition_hash,
 CASE WHEN n % 6 = 0 THEN 'failed' ELSE 'success' END AS status FROM (
 SELECT c_mktsegment AS dataset, 'm' || substr(o_orderpriority, 1, 1) AS model,
  CASE o_orderstatus WHEN 'F' THEN 'centralized' WHEN 'O' THEN 'iid' ELSE 'dirichlet' END AS scheme,
  CASE WHEN o_orderstatus = 'P' THEN CASE WHEN c_nationkey % 2 = 0 THEN '0.5' ELSE '1.0' END ELSE '' END AS alpha,
  CASE WHEN c_nationkey % 3 = 0 THEN 'smote' ELSE 'none' END AS oversampling, c_nationkey::VARCHAR AS random_seed,
  COUNT(*) AS n, SUM(o_orderkey % 101)::BIGINT AS s FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"""


def histories(spark, sf_dir):
    """Stored histories: rounds 0..n of four runs in five."""
    r = runs(spark, sf_dir).where("s % 5 <> 0 AND scheme <> 'centralized'")
    return r.select("dataset", "run_name", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n"))).alias("round")
                    ).withColumn("round", F.col("round").cast("string"))


HISTORIES = f"""SELECT dataset, run_name, unnest(range(0, n + 1))::VARCHAR AS round FROM ({RUNS}) WHERE s % 5 <> 0 AND scheme <> 'centralized'"""


def cells(spark, sf_dir):
    return runs(spark, sf_dir).select("dataset", "model").distinct()


def matrix(spark, sf_dir):
    m = l.experiment_matrix(cells(spark, sf_dir), ["smote", "no-smote"], ["centralized", "iid", "noniid"], ALPHAS, SEEDS)
    return m.withColumn("cell", l.cell_name()).withColumn("child", l.child_run_name({"m5": "x5"}))


def registry(spark, sf_dir):
    return l.registry_runs(cells(spark, sf_dir), ALPHAS, ["none", "smote"], SEEDS)


MATRIX = f"""mx AS (SELECT dataset, model, seed, arm, condition, alpha FROM (SELECT DISTINCT dataset, model FROM ({RUNS})),
 (VALUES (42), (123)) s(seed), (VALUES ('smote'), ('no-smote')) a(arm),
 (VALUES ('centralized', NULL::DOUBLE), ('iid', NULL), ('noniid', 0.5), ('noniid', 1.0), ('noniid', 5.0)) c(condition, alpha)),
mxn AS (SELECT *, dataset || '_' || arm || '_' || condition || '_' || model || '_a' || CASE WHEN alpha IS NULL THEN 'na' ELSE printf('%g', alpha) END || '_s' || seed AS cell,
 CASE WHEN condition = 'centralized' THEN 'centralized_' || CASE WHEN model = 'm5' THEN 'x5' ELSE model END || '_' || CASE WHEN arm = 'smote' THEN 'smote' ELSE 'none' END || '_seed' || seed
 ELSE model || '_' || CASE WHEN condition = 'iid' THEN 'iid_alpha-' ELSE 'dirichlet_alpha' || printf('%g', alpha) END || '_' || CASE WHEN arm = 'smote' THEN 'smote' ELSE 'none' END || '_seed' || seed END AS child FROM mx)"""

REGISTRY = f"""rg AS (SELECT *, CASE WHEN scheme = 'centralized' THEN 'pooled' ELSE 'grouped' END AS kind,
 CASE WHEN scheme = 'centralized' THEN 'centralized_' || model || '_' || oversampling || '_seed' || seed
 ELSE model || '_' || scheme || '_alpha' || coalesce(printf('%.1f', alpha), '-') || '_' || oversampling || '_seed' || seed END AS run_name
 FROM (SELECT DISTINCT dataset, model FROM ({RUNS})), (VALUES ('none'), ('smote')) o(oversampling), (VALUES (42), (123)) s(seed),
 (VALUES ('centralized', NULL::DOUBLE), ('iid', NULL), ('dirichlet', 0.5), ('dirichlet', 1.0), ('dirichlet', 5.0)) c(scheme, alpha))"""


def done(spark, sf_dir):
    """Some registry runs are done: those whose name hashes low."""
    return registry(spark, sf_dir).where(F.substring(F.md5(F.concat("dataset", "run_name")), 1, 1) < "6").select("dataset", "run_name")


def collected(spark, sf_dir):
    r = runs(spark, sf_dir)
    a = r.where("scheme = 'iid'").select("dataset", "run_name", "test_auprc")
    b = r.where("scheme <> 'iid'").select("dataset", "run_name", "test_brier", "num_rounds")
    return l.collect_tables([a, b])


def positions(spark, sf_dir):
    df = l.order_position(runs(spark, sf_dir))
    return df.select("run_name", F.col("position.dataset").alias("k_dataset"), F.col("position.alpha").alias("k_alpha"),
                     F.col("position.seed").alias("k_seed"))


def first_rows(spark, sf_dir):
    """The head of the ordered ledger: a top-20 report."""
    return l.ledger_order(runs(spark, sf_dir)).select("dataset", "model", "scheme", "alpha", "oversampling", "random_seed").limit(20)


def ledger_places(spark, sf_dir):
    """The place of every run in the ordered ledger of its dataset."""
    keyed = l.order_position(runs(spark, sf_dir))
    place = F.row_number().over(W.partitionBy("dataset").orderBy("position"))
    return keyed.select("dataset", "run_name", "model", "scheme", "alpha", "oversampling", "random_seed", place.alias("place"))


def stamped(spark, sf_dir):
    base = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("dataset")).agg(
        (F.count_if(F.col("c_acctbal") < 0) / F.count(F.lit(1))).alias("baseline")).where(F.col("dataset") != "MACHINERY")
    return rounded(l.stamp_baseline(runs(spark, sf_dir).select("dataset", "run_name", "baseline_auprc"), base), 6)


def verified(spark, sf_dir):
    r = runs(spark, sf_dir)
    data = r.select("dataset", "random_seed").distinct().withColumn("data_hash", F.md5("dataset"))
    parts = r.where("scheme <> 'centralized'").select("dataset", "random_seed", "scheme", "alpha").distinct().withColumn(
        "partition_hash", F.md5(F.concat("dataset", "scheme", F.when(F.col("random_seed") == "7", "?").otherwise(F.col("alpha")))))
    return l.verify_hashes(r, data, parts)


VERIFIED = f"""vf AS (SELECT *, CASE WHEN data_hash = '' THEN 'unverified' WHEN data_hash = md5(dataset) THEN 'ok' ELSE 'failed' END AS data_status,
 CASE WHEN data_hash = '' OR scheme = 'centralized' THEN NULL WHEN random_seed = '7' THEN 'failed' ELSE 'ok' END AS partition_status FROM ({RUNS}))"""


def crosscheck(spark, sf_dir):
    r = runs(spark, sf_dir).withColumn("client_id", F.col("random_seed")).withColumn("n_minority", F.col("s"))
    b = r.withColumn("n_minority", F.when((F.col("dataset") == "FURNITURE") & (F.col("model") == "m1"), F.col("s") + 1).otherwise(F.col("s")))
    return l.census_crosscheck(r, b, ["dataset", "model", "scheme"])


def feature_orders(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").groupBy("source").agg(F.sort_array(F.collect_set("lang")).alias("names"))
    a = docs.select(F.col("source").alias("artifact"), "names")
    b = a.withColumn("names", F.when(F.col("artifact").isin("src1", "src2"), F.reverse("names")).otherwise(F.col("names")))
    return l.feature_order_check(a, b)


def recomputed(spark, sf_dir):
    """Fresh values: most runs reproduce, every ninth is off."""
    r = runs(spark, sf_dir)
    shift = F.when(F.col("n") % 9 == 0, 0.1).otherwise(0.0005)
    return r.select("dataset", "run_name", (F.col("test_auprc").cast("double") + shift).alias("test_auprc"),
                    text(F.col("s"), 83).alias("test_brier"), text(F.col("s"), 79).alias("best_val"))


def filled(spark, sf_dir):
    return l.fill_blanks(runs(spark, sf_dir).select("dataset", "run_name", "test_auprc", "test_brier"),
                         recomputed(spark, sf_dir).select("dataset", "run_name", "test_brier", "best_val"), ["test_brier", "best_val"])


def untouched(spark, sf_dir):
    before = runs(spark, sf_dir).select("dataset", "run_name", "test_auprc", "test_brier")
    bad = l.changed_cells(before, filled(spark, sf_dir), ["test_brier", "best_val"])
    return bad.agg(F.count(F.lit(1)).alias("n_changed"))


def accepted(spark, sf_dir):
    return l.accept_recomputed(runs(spark, sf_dir), recomputed(spark, sf_dir), ["test_brier", "best_val"], val_columns=["best_val"])


def migrated(spark, sf_dir):
    old = runs(spark, sf_dir).drop("n", "s", "status")
    return l.migrate_summary(old, histories(spark, sf_dir), BUDGETS).select(
        "dataset", "run_name", "alpha", "rounds_configured", "rounds_completed", "n_iter_selected", "test_f1")


def fit_rounds(spark, sf_dir):
    return l.drop_initial_round(histories(spark, sf_dir)).groupBy("dataset", "run_name").agg(
        F.count(F.lit(1)).alias("n_rounds"), F.min(F.col("round").cast("int")).alias("first_round"))


def master(spark, sf_dir):
    """Sweep rows and histories stored under the child name."""
    m = matrix(spark, sf_dir)
    key = F.conv(F.substring(F.md5("cell"), 1, 4), 16, 10).cast("int")
    old = m.select(F.col("cell").alias("run_name"), "dataset", "model", F.col("arm").alias("smote_arm"), "condition", "alpha", "seed",
                   "child", key.alias("key"), F.when(F.col("condition") == "centralized", "n/a").otherwise((key % 30).cast("string")).alias("rounds_completed"))
    rounds = old.where("key % 3 = 0").select("dataset", F.col("child").alias("run_name"), F.explode(
        F.sequence(F.lit(0), F.col("key") % 12)).alias("round")).withColumn("round", F.col("round").cast("string"))
    return l.migrate_master(old.drop("child", "key"), rounds, BUDGETS, pooled_names={"m5": "x5"}).select(
        "run_name", "dataset", "rounds_completed", "rounds_configured")


def tally(spark, sf_dir):
    r = runs(spark, sf_dir).select("n", "s")
    summaries = r.select(F.lit("summary").alias("kind"), F.lit(False).alias("has_round_zero"), F.when(
        F.col("n") % 5 == 0, F.array().cast("array<string>")).when(F.col("n") % 5 == 1, F.array(F.lit("rounds_configured")))
        .when(F.col("n") % 5 == 2, F.array(F.lit("other"))).otherwise(F.array(F.lit("num_rounds"))).alias("names"))
    rounds = r.select(F.lit("rounds").alias("kind"), (F.col("s") % 2 == 0).alias("has_round_zero"),
                      F.when(F.col("s") % 7 == 0, F.array(F.lit("loss"))).otherwise(F.array(F.lit("round"))).alias("names"))
    return l.migration_tally(l.migration_action(summaries.unionByName(rounds)))


FP = ["run_name", "oversampling", "alpha", "data_hash", "partition_hash"]


def resumable(spark, sf_dir):
    r = runs(spark, sf_dir).withColumn("fingerprint", l.fingerprint(FP))
    markers = r.withColumn("fingerprint", F.when(F.col("n") % 10 == 3, "stale").otherwise(F.col("fingerprint"))).select("run_name", "fingerprint", "status")
    return l.not_complete(r, markers).select("run_name", "fingerprint")


def incomplete(spark, sf_dir):
    df = l.missing_columns(runs(spark, sf_dir), ["test_auprc", "baseline_auprc", "test_brier", "data_hash", "test_f1"])
    return df.select("run_name", F.array_join("missing", ",").alias("missing"), "is_complete")


def outcomes(spark, sf_dir):
    r = runs(spark, sf_dir).withColumn("condition", F.col("scheme")).withColumn(
        "rounds_completed", F.when(F.col("s") % 11 == 0, "0").otherwise(F.col("rounds_completed")))
    return l.reclassify(r, r.where("s % 4 <> 0").select("dataset", "run_name")).select("run_name", "status")


def planned(spark, sf_dir):
    m = matrix(spark, sf_dir).withColumn("is_noop", F.substring(F.md5("cell"), 1, 1) < "4")
    return l.plan_report(m)


def scoped(spark, sf_dir):
    return l.scope_order(runs(spark, sf_dir).select("dataset", "model", "run_name"), ["m1", "m2"], DATASETS)


def per_round(spark, sf_dir):
    r = runs(spark, sf_dir).select("run_name", F.col("s").alias("wall_seconds"), (F.col("n") % 5).alias("rounds_completed"))
    return rounded(l.seconds_per_round(r))


METRICS = ["test_auprc", "test_brier", "baseline_auprc"]

QUERIES = {
    "l1_l3_experiment_matrix": matrix,
    "l2_registry_runs": registry,
    "l4_planned_against_done": lambda s, d: rounded(l.planned_against_done(registry(s, d), done(s, d))),
    "l4_pending": lambda s, d: l.pending(registry(s, d), done(s, d)).select("dataset", "run_name"),
    "l5_collect_tables": collected,
    "l6_order_position": positions,
    "l6_ledger_head": first_rows,
    "l6_ledger_order": ledger_places,
    "l7_stamp_baseline": stamped,
    "l8_report_rows": lambda s, d: l.report_rows(runs(s, d), METRICS, {"test_brier": 2}),
    "l9_verify_hashes": lambda s, d: verified(s, d).select("run_name", "data_status", "partition_status"),
    "l9_verification_tally": lambda s, d: l.verification_tally(verified(s, d)),
    "l10_split_hash_cells": lambda s, d: l.split_hash_cells(runs(s, d), ["dataset", "model", "scheme"]),
    "l11_census_crosscheck": crosscheck,
    "l12_fill_blanks": filled,
    "l12_untouched_cells": untouched,
    "l13_accept_recomputed": accepted,
    "l14_migrate_summary": migrated,
    "l15_s11_fit_rounds": fit_rounds,
    "l16_migrate_master": master,
    "l17_migration_tally": tally,
    "l18_resume_filter": resumable,
    "l19_missing_columns": incomplete,
    "l20_reclassify": outcomes,
    "l21_plan_report": planned,
    "l22_scope_order": scoped,
    "l23_feature_order": feature_orders,
    "l24_seconds_per_round": per_round,
}


def cell_text(c, digits=4):
    return f"CASE WHEN trim({c}) = '' THEN '-' WHEN try_cast({c} AS DOUBLE) IS NULL THEN {c} ELSE printf('%.{digits}f', try_cast({c} AS DOUBLE)) END AS {c}"


ORACLES = {
    "l1_l3_experiment_matrix": f"WITH {MATRIX} SELECT * FROM mxn",
    "l2_registry_runs": f"WITH {REGISTRY} SELECT * FROM rg",
    "l4_planned_against_done": f"""WITH {REGISTRY} SELECT kind, COUNT(*) AS n_planned, COUNT(*) FILTER (d) AS n_done, COUNT(*) FILTER (NOT d) AS n_pending,
 round(100.0::DOUBLE * COUNT(*) FILTER (d) / COUNT(*), 9) AS pct_complete FROM (SELECT *, substr(md5(dataset || run_name), 1, 1) < '6' AS d FROM rg) GROUP BY kind""",
    "l4_pending": f"WITH {REGISTRY} SELECT dataset, run_name FROM rg WHERE NOT substr(md5(dataset || run_name), 1, 1) < '6'",
    "l5_collect_tables": f"""SELECT dataset, run_name, CASE WHEN scheme = 'iid' THEN test_auprc END AS test_auprc,
 CASE WHEN scheme <> 'iid' THEN test_brier END AS test_brier, CASE WHEN scheme <> 'iid' THEN num_rounds END AS num_rounds FROM ({RUNS})""",
    "l6_order_position": f"""SELECT run_name, dataset AS k_dataset, coalesce(try_cast(nullif(alpha, '') AS DOUBLE), 1e9) AS k_alpha,
 random_seed::DOUBLE AS k_seed FROM ({RUNS})""",
    "l6_ledger_head": f"""SELECT dataset, model, scheme, alpha, oversampling, random_seed FROM ({RUNS})
 ORDER BY dataset, model, scheme, coalesce(try_cast(nullif(alpha, '') AS DOUBLE), 1e9), oversampling, random_seed::DOUBLE LIMIT 20""",
    "l6_ledger_order": f"""SELECT dataset, run_name, model, scheme, alpha, oversampling, random_seed, ROW_NUMBER() OVER (PARTITION BY dataset
 ORDER BY model, scheme, coalesce(try_cast(nullif(alpha, '') AS DOUBLE), 1e9), oversampling, random_seed::DOUBLE) AS place FROM ({RUNS})""",
    "l7_stamp_baseline": f"""SELECT r.dataset, run_name, round(coalesce(try_cast(nullif(baseline_auprc, '') AS DOUBLE), baseline), 6) AS baseline_auprc
 FROM ({RUNS}) r LEFT JOIN (SELECT c_mktsegment AS dataset, COUNT(*) FILTER (c_acctbal < 0)::DOUBLE / COUNT(*) AS baseline FROM customer
 WHERE c_mktsegment <> 'MACHINERY' GROUP BY 1) b USING (dataset)""",
    "l8_report_rows": f"""SELECT dataset, model, CASE scheme WHEN 'iid' THEN 'IID' WHEN 'dirichlet' THEN 'Dirichlet α=' || printf('%g', alpha::DOUBLE) ELSE scheme END AS scheme_label,
 oversampling, random_seed, {cell_text('test_auprc')}, {cell_text('test_brier', 2)}, {cell_text('baseline_auprc')} FROM ({RUNS})""",
    "l9_verify_hashes": f"WITH {VERIFIED} SELECT run_name, data_status, partition_status FROM vf",
    "l9_verification_tally": f"WITH {VERIFIED} SELECT data_status, partition_status, COUNT(*) AS n_runs FROM vf GROUP BY ALL",
    "l10_split_hash_cells": f"""SELECT dataset, model, scheme, COUNT(DISTINCT data_hash) AS n_hashes, COUNT(*) AS n_runs FROM ({RUNS})
 WHERE data_hash <> '' GROUP BY ALL HAVING COUNT(DISTINCT data_hash) > 1""",
    "l11_census_crosscheck": f"SELECT dataset, model, scheme, NOT (dataset = 'FURNITURE' AND model = 'm1') AS match FROM ({RUNS}) GROUP BY ALL",
    "l12_fill_blanks": f"""SELECT dataset, run_name, test_auprc, CASE WHEN test_brier = '' THEN printf('%.4f', (s % 83) / 83.0::DOUBLE) ELSE test_brier END AS test_brier,
 printf('%.4f', (s % 79) / 79.0::DOUBLE) AS best_val FROM ({RUNS})""",
    "l12_untouched_cells": "SELECT 0::BIGINT AS n_changed",
    "l13_accept_recomputed": f"""SELECT dataset, run_name, printf('%.4f', (s % 83) / 83.0::DOUBLE) AS test_brier,
 CASE WHEN scheme = 'centralized' THEN printf('%.4f', (s % 79) / 79.0::DOUBLE) END AS best_val FROM ({RUNS}) WHERE n % 9 <> 0""",
    "l14_migrate_summary": f"""SELECT dataset, run_name, alpha,
 CASE WHEN scheme = 'centralized' THEN 'n/a' WHEN num_rounds <> '' THEN num_rounds WHEN model = 'm5' THEN '50' ELSE '20' END AS rounds_configured,
 CASE WHEN scheme = 'centralized' THEN 'n/a' WHEN s % 5 <> 0 THEN n::VARCHAR ELSE greatest(n - 1, 0)::VARCHAR END AS rounds_completed,
 'n/a' AS n_iter_selected, '' AS test_f1 FROM ({RUNS})""",
    "l15_s11_fit_rounds": f"SELECT dataset, run_name, COUNT(*) AS n_rounds, MIN(round::INT) AS first_round FROM ({HISTORIES}) WHERE round <> '0' GROUP BY ALL",
    "l16_migrate_master": f"""WITH {MATRIX}, k AS (SELECT *, ('0x' || substr(md5(cell), 1, 4))::INT AS key FROM mxn),
 rc AS (SELECT dataset, child, SUM(key % 12)::BIGINT AS n FROM k WHERE key % 3 = 0 GROUP BY ALL)
SELECT cell AS run_name, k.dataset, CASE WHEN condition = 'centralized' THEN 'n/a' WHEN rc.n IS NOT NULL THEN rc.n::VARCHAR
  ELSE greatest(key % 30 - 1, 0)::VARCHAR END AS rounds_completed,
 CASE WHEN condition = 'centralized' THEN 'n/a' WHEN model = 'm5' THEN '50' ELSE '20' END AS rounds_configured
FROM k LEFT JOIN rc ON rc.dataset = k.dataset AND rc.child = k.child""",
    "l17_migration_tally": f"""SELECT kind, action, COUNT(*) AS n_files FROM (
 SELECT 'summary' AS kind, CASE n % 5 WHEN 0 THEN 'skip-empty' WHEN 1 THEN 'skip-new' WHEN 2 THEN 'skip-unrelated' ELSE 'migrated' END AS action FROM ({RUNS})
 UNION ALL SELECT 'rounds', CASE WHEN s % 7 = 0 THEN 'skip-unrelated' WHEN s % 2 = 0 THEN 'migrated' ELSE 'skip-noround0' END FROM ({RUNS})) GROUP BY ALL""",
    "l18_resume_filter": f"""SELECT run_name, sha256('{{' || concat_ws(',', '"alpha":"' || alpha || '"', '"data_hash":"' || data_hash || '"', '"oversampling":"' || oversampling || '"',
 '"partition_hash":"' || partition_hash || '"', '"run_name":"' || run_name || '"') || '}}') AS fingerprint FROM ({RUNS}) WHERE status <> 'success' OR n % 10 = 3""",
    "l19_missing_columns": f"""SELECT run_name, array_to_string(m, ',') AS missing, len(m) = 0 AS is_complete FROM (SELECT run_name, list_filter([CASE WHEN test_auprc = '' THEN 'test_auprc' END,
 CASE WHEN baseline_auprc = '' THEN 'baseline_auprc' END, CASE WHEN test_brier = '' THEN 'test_brier' END, CASE WHEN data_hash = '' THEN 'data_hash' END, 'test_f1'],
 lambda v: v IS NOT NULL) AS m FROM ({RUNS}))""",
    "l20_reclassify": f"""SELECT run_name, CASE WHEN status = 'success' AND s % 4 = 0 THEN 'failed_no_artifact'
 WHEN status = 'success' AND scheme <> 'centralized' AND s % 11 = 0 THEN 'failed_zero_rounds' ELSE status END AS status FROM ({RUNS})""",
    "l21_plan_report": f"""WITH {MATRIX} SELECT COUNT(*) AS n_planned, COUNT(*) FILTER (NOT (arm = 'smote' AND substr(md5(cell), 1, 1) < '4')) AS n_to_run,
 COUNT(*) FILTER (arm = 'smote' AND substr(md5(cell), 1, 1) < '4') AS n_skipped FROM mxn""",
    "l22_scope_order": f"""SELECT dataset, model, run_name, CASE WHEN model IN ('m1', 'm2') THEN 0 WHEN dataset = 'AUTOMOBILE' THEN 1 WHEN dataset = 'BUILDING' THEN 2
 WHEN dataset = 'FURNITURE' THEN 3 ELSE 4 END AS scope_rank FROM ({RUNS})""",
    "l23_feature_order": """SELECT source AS artifact, CASE WHEN source IN ('src1', 'src2') AND n > 1 THEN 0 END AS first_difference,
 NOT (source IN ('src1', 'src2') AND n > 1) AS same_order FROM (SELECT source, COUNT(DISTINCT lang) AS n FROM documents GROUP BY source)""",
    "l24_seconds_per_round": f"""SELECT run_name, s AS wall_seconds, n % 5 AS rounds_completed, round(s::DOUBLE / nullif(n % 5, 0), 9) AS seconds_per_round FROM ({RUNS})""",
}
