"""Queries that write to the shared folder and read back, or parse stored text: S1-S21."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from rareclass.operators import explain as e
from rareclass.operators.splits import partition_dirichlet
from rareclass.session import checkpoint_folder
from rareclass.sources import artifacts, models, prepared, results, tables
from suite.common import md5_rank, rounded, split_sql, table
from suite.explanations import IMPORTANCES, agree_sql, importances
from suite.groups import HISTORY, history
from suite.ledgers import HISTORIES, RUNS, histories, runs
from suite.neighbours import VECTORS, vectors
from suite.partitions import ASSIGNED, CLIENTS, ROWS, SHARES, rows
from suite.prepare import ORDERS, RECIPE, orders

MODELS = ["m11", "m1", "m2", "m3", "m4", "m5"]


def folder(spark, name):
    return f"{checkpoint_folder(spark)}/suite-{uuid.uuid4().hex}/{name}"


def csv_round_trip(spark, sf_dir, name, columns):
    """Rows written as CSV in a dataset's own columns, read with its explicit schema."""
    path = folder(spark, name)
    columns.write.option("header", True).csv(path)
    return tables.read_raw(spark, name, path)


def transactions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    kinds = F.lit([*tables.PAYSIM_TYPES, "OTHER"])
    df = o.select((key % 700).cast("int").alias("step"), F.get(kinds, (key % 6).cast("int")).alias("type"),
                  F.col("o_totalprice").alias("amount"), F.concat(F.lit("C"), key).alias("nameOrig"),
                  (F.col("o_totalprice") * 2).alias("oldbalanceOrg"), F.col("o_totalprice").alias("newbalanceOrig"),
                  F.concat(F.lit("M"), "o_custkey").alias("nameDest"), F.lit(0.0).alias("oldbalanceDest"),
                  (F.col("o_totalprice") / 2).alias("newbalanceDest"), (key % 97 == 0).cast("int").alias("isFraud"),
                  F.lit(0).alias("isFlaggedFraud"))
    raw = tables.with_row_id(csv_round_trip(spark, sf_dir, "paysim", df))
    f = tables.raw_features(raw, "paysim")
    return rounded(f.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("n_ids"), F.sum("type_DEBIT").alias("n_debit"),
        F.sum("type_TRANSFER").alias("n_transfer"), F.round(F.avg("step"), 6).alias("mean_step")))


def cards(spark, sf_dir):
    v = vectors(spark, sf_dir)
    df = v.select(F.col("row_id").cast("double").alias("Time"), *[F.round(F.col("features")[i], 4).alias(f"V{i + 1}") for i in range(28)],
                  F.round(F.abs(F.col("features")[30]) * 100, 2).alias("Amount"), F.col("label").alias("Class"))
    raw = csv_round_trip(spark, sf_dir, "creditcard", df)
    return rounded(raw.groupBy("Class").agg(F.count(F.lit(1)).alias("n"), F.sum("Time").alias("sum_time")), 4)


def applications(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    cells = {}
    for name, kind in tables.BAF_COLUMNS:
        if name in tables.BAF_CATEGORIES:
            cells[name] = F.get(F.lit([*tables.BAF_CATEGORIES[name], "ZZ"]), (key % (len(tables.BAF_CATEGORIES[name]) + 1)).cast("int"))
        elif name in tables.BAF_SENTINELS:
            cells[name] = F.when(key % 5 == 0, -1).otherwise(key % 50).cast(kind)
        else:
            cells[name] = (key % 13).cast(kind)
    cells["fraud_bool"] = (key % 91 == 0).cast("int")
    raw = csv_round_trip(spark, sf_dir, "baf", o.select(*[c.alias(n) for n, c in cells.items()]))
    f = tables.raw_features(tables.with_row_id(raw), "baf")
    return f.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.lit(len(f.columns)).alias("n_columns"),
                                  F.sum("bank_months_count_missing").alias("n_missing"), F.sum("source_TELEAPP").alias("n_teleapp"))


def libsvm(spark, sf_dir):
    v = vectors(spark, sf_dir)
    terms = F.transform(F.col("features"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(":"), F.round(x, 4).cast("string")))
    lines = v.select(F.concat_ws(" ", F.col("label").cast("string"), F.array_join(terms, " ")).alias("value"), "row_id")
    a, b = folder(spark, "a"), folder(spark, "b")
    lines.where("row_id % 2 = 0").select("value").write.text(a)
    lines.where("row_id % 2 = 1").select("value").write.text(b)
    df = tables.read_libsvm(spark, [a, b])
    return df.groupBy(F.col("label").cast("int").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.sum(vector_to_array("features")[i]), 4).alias(f"sum_{i + 1}") for i in range(64)])


def split_store(spark, sf_dir):
    root, config = folder(spark, "store"), {"kind": "prepared", "dataset": "orders", "seed": 42}
    raw = orders(spark, sf_dir)
    build = lambda: prepared.prepare(raw, RECIPE)
    first, h1 = prepared.stored_split(spark, root, config, build)
    again, h2 = prepared.stored_split(spark, root, config, build)
    return rounded(again.groupBy("split", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("days_missing").isNotNull().alias("has_flags"), F.lit(h1 == h2).alias("same_hash")))


def assignment_store(sizes: bool):
    def run(spark, sf_dir):
        root, config = folder(spark, "store"), {"kind": "partition", "seed": 42, "alpha": 0.5, "condition": "noniid", "num_clients": CLIENTS}
        rows_, _ = prepared.stored_assignment(spark, root, config, lambda: partition_dirichlet(rows(spark, sf_dir), 0.5, CLIENTS))
        return rounded(prepared.stored_sizes(spark, root, config)) if sizes else rows_
    return run


def run_table(spark, sf_dir):
    r = runs(spark, sf_dir)
    return r.withColumnRenamed("num_rounds", "rounds_configured").drop("rounds_completed", "n", "s", "status")


def long_history(spark, sf_dir):
    h = histories(spark, sf_dir)
    r = F.col("round").cast("int")
    return h.select("dataset", "run_name", r.alias("round"), ((r * 7) % 10 / 10).alias("val_auprc"), F.lit(None).cast("double").alias("test_auprc"),
                    (r / 100).alias("val_f1"), (r / 200).alias("val_precision"), (r / 300).alias("val_recall"), (r / 400).alias("val_recall_at_fpr"))


def grouped_summaries(spark, sf_dir):
    path = folder(spark, "ledger")
    df = results.grouped_summary(run_table(spark, sf_dir).where("scheme <> 'centralized'"), long_history(spark, sf_dir))
    results.append_table(df, path)
    back = spark.read.parquet(path)
    return rounded(back.select("dataset", "run_name", "best_round", "best_val_auprc", "best_val_f1", "rounds_completed", "rounds_configured",
                               F.col("test_auprc")))


def pooled_summaries(spark, sf_dir):
    path = folder(spark, "ledger")
    results.append_table(results.pooled_summary(run_table(spark, sf_dir).where("scheme = 'centralized'")), path)
    back = spark.read.parquet(path)
    return rounded(back.select("dataset", "run_name", "best_round", "rounds_completed", "test_auprc", "test_brier",
                               F.array_join("undefined", ",").alias("undefined")))


def scanned(spark, sf_dir):
    """Two layouts of summaries, one with quoted separators and line breaks, and round files in one folder tree, read as one ledger."""
    root = folder(spark, "logs")
    r = runs(spark, sf_dir)
    note = F.concat("run_name", F.lit(',\n"x"'))
    results.append_csv(r.where("scheme = 'iid'").select("dataset", "run_name", "test_auprc", note.alias("note")), f"{root}/a/x")
    results.append_csv(r.select("dataset", "run_name", F.lit("1").alias("round")), f"{root}/a/x_rounds.csv")
    results.append_csv(r.where("scheme <> 'iid'").select("run_name", "dataset", "data_hash"), f"{root}/b/y")
    return results.scan_ledger(spark, root)


def appended(spark, sf_dir):
    path = folder(spark, "master")
    r = runs(spark, sf_dir).select("dataset", "run_name", "status")
    results.append_table(r.where("status = 'success'"), path)
    results.append_table(r.where("status <> 'success'"), path)
    return spark.read.parquet(path)


def names(spark, sf_dir):
    n = runs(spark, sf_dir).select(F.when(
        F.col("scheme") == "centralized", F.concat_ws("_", F.lit("centralized"), "model", "oversampling", F.concat(F.lit("seed"), "random_seed"))
    ).otherwise(F.concat_ws("_", "model", "scheme", F.concat(F.lit("alpha"), F.when(F.col("alpha") == "", "-").otherwise(F.col("alpha"))),
                            "oversampling", F.concat(F.lit("seed"), "random_seed"))).alias("run_name"), "dataset")
    return n.select("dataset", "run_name", *artifacts.run_parts("run_name", MODELS))


NAMES = f"""SELECT dataset, CASE WHEN scheme = 'centralized' THEN 'centralized_' || model || '_' || oversampling || '_seed' || random_seed
 ELSE model || '_' || scheme || '_alpha' || CASE WHEN alpha = '' THEN '-' ELSE alpha END || '_' || oversampling || '_seed' || random_seed END AS run_name,
 model, scheme AS condition, oversampling AS arm, try_cast(nullif(alpha, '') AS DOUBLE) AS alpha FROM ({RUNS})"""


def by_nation(spark, sf_dir):
    return importances(spark, sf_dir).groupBy(F.col("cell").alias("client_id"), "feature").agg(F.avg("importance").alias("importance"))


def matrix(spark, sf_dir):
    return rounded(artifacts.importance_matrix(by_nation(spark, sf_dir), list(range(25))), 6)


def stability_records(spark, sf_dir):
    imp = importances(spark, sf_dir)
    cells = e.stability(imp, ["cell"])
    top = e.top_consensus(imp, ["cell"], 10).groupBy("cell").agg(F.sort_array(F.collect_list(
        F.struct("rank", F.struct("feature", F.round("mean_importance", 4).alias("importance")).alias("t"))))["t"].alias("top10"))
    records = cells.join(top, "cell").select(
        F.col("cell").cast("string").alias("dataset"), F.lit("lines").alias("model"), F.coalesce("spearman", F.lit(float("nan"))).alias("spearman"),
        "jaccard", "kuncheva", F.col("degenerate_clients").cast("array<bigint>").alias("degenerate_clients"), "top10")
    path = folder(spark, "stability")
    artifacts.stability_json(records).write.text(path)
    back = artifacts.read_stability(spark.read.text(path), "value")
    return rounded(back.select("dataset", "spearman", "jaccard", F.size("top10").alias("n_top"), F.col("top10")[0]["feature"].alias("top_feature")))


def upserted(spark, sf_dir):
    r = runs(spark, sf_dir).select("dataset", "run_name", "test_auprc")
    new = r.where("dataset = 'BUILDING'").withColumn("test_auprc", F.lit("0.5")).unionByName(
        r.where("dataset = 'FURNITURE'").withColumn("run_name", F.concat("run_name", F.lit("_new"))))
    once = results.upsert(r, new, ["dataset", "run_name"])
    return results.upsert(once, new, ["dataset", "run_name"])


LOG = """concat('[server] round 1 | thr=0.5 | val_auprc=', n_chars % 7, '.25 | val_f1=0.5 | val_precision=0.1 | val_recall=0.2\n',
 '[server] round 2 | thr=0.5 | val_auprc=', n_chars % 9, '.5 | val_f1=0.25 | val_precision=0.125 | val_recall=0.75\n', text,
 CASE WHEN n_chars % 3 = 0 THEN '' ELSE concat('\n[server] FINAL round 2 | test_auprc=0.', n_chars % 1000 + 1000,
 ' | test_f1=0.5 |\n test_precision=0.25 | test_recall=0.125') END)"""


def mined(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(LOG).alias("content"))
    return rounded(artifacts.mine_log(docs))


def separators(spark, sf_dir):
    text = F.format_number((F.col("o_totalprice") * 100).cast("bigint"), 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", artifacts.thousands(text).alias("cents"))


def model_round_trip(spark, sf_dir):
    cols = ["o_totalprice", "days"]
    df = orders(spark, sf_dir).withColumn("days", F.col("days").cast("double"))
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="raw"),
                                StandardScaler(inputCol="raw", outputCol="vec", withMean=True),
                                LogisticRegression(featuresCol="vec", labelCol="label", regParam=0.01)])
    fitted = pipeline.fit(df)
    path = folder(spark, "model")
    models.save_model(fitted, path, spark, "logistic", "none", cols, threshold=0.5)
    again, _ = models.load_model(spark, path)
    score = lambda m: m.transform(df).select("row_id", vector_to_array("probability")[1].alias("score"))
    return models.compare_predictions(score(fitted), score(again))


def tolerance(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("score"))
    b = o.withColumn("score", F.when(F.col("row_id") % 1000 == 1, F.col("score") + 0.25).otherwise(F.col("score")))
    return models.compare_predictions(o, b, rtol=1e-9)


QUERIES = {
    "s1_transactions_csv": transactions,
    "s2_card_csv": cards,
    "s3_applications_csv": applications,
    "s5_libsvm": libsvm,
    "s6_split_store": split_store,
    "s7_assignment_store": assignment_store(False),
    "s8_stored_sizes": assignment_store(True),
    "s9_grouped_summary": grouped_summaries,
    "s10_pooled_summary": pooled_summaries,
    "s11_fit_rounds": lambda s, d: results.fit_rounds(history(s, d)).select("run_id", "round"),
    "s12_scan_ledger": scanned,
    "s13_append": appended,
    "s14_run_parts": names,
    "s15_importance_matrix": matrix,
    "s16_stability_records": stability_records,
    "s17_upsert": upserted,
    "s18_mine_log": mined,
    "s19_thousands": separators,
    "s20_model_round_trip": model_round_trip,
    "s21_compare_predictions": tolerance,
}

ORACLES = {
    "s1_transactions_csv": """SELECT CAST(o_orderkey % 97 = 0 AS INT) AS label, COUNT(*) AS n, COUNT(*) AS n_ids,
 SUM(CASE WHEN o_orderkey % 6 = 2 THEN 1.0::DOUBLE ELSE 0 END) AS n_debit, SUM(CASE WHEN o_orderkey % 6 = 4 THEN 1.0::DOUBLE ELSE 0 END) AS n_transfer,
 round(AVG(o_orderkey % 700), 6) AS mean_step FROM orders GROUP BY 1""",
    "s2_card_csv": "SELECT CAST(label = 0 AS INT) AS \"Class\", COUNT(*) AS n, SUM(vec_id)::DOUBLE AS sum_time FROM embeddings GROUP BY 1",
    "s3_applications_csv": """SELECT CAST(o_orderkey % 91 = 0 AS INT) AS label, COUNT(*) AS n, 58 AS n_columns,
 SUM(CASE WHEN o_orderkey % 5 = 0 THEN 1.0::DOUBLE ELSE 0 END) AS n_missing, SUM(CASE WHEN o_orderkey % 3 = 1 THEN 1.0::DOUBLE ELSE 0 END) AS n_teleapp
 FROM orders GROUP BY 1""",
    "s5_libsvm": f"""SELECT label, COUNT(*) AS n, {', '.join(f'round(SUM(round(features[{i}], 4)), 4) AS sum_{i}' for i in range(1, 65))}
 FROM ({VECTORS}) GROUP BY label""",
    "s6_split_store": f"SELECT split, label, COUNT(*) AS n, TRUE AS has_flags, TRUE AS same_hash FROM ({split_sql(ORDERS)}) GROUP BY ALL",
    "s7_assignment_store": f"SELECT row_id, client_id FROM ({ASSIGNED})",
    "s8_stored_sizes": f"""SELECT client_id, COUNT(*) AS n_samples, SUM(label)::BIGINT AS n_pos, round(SUM(label)::DOUBLE / COUNT(*), 9) AS pos_ratio
 FROM ({ASSIGNED}) GROUP BY client_id""",
    "s9_grouped_summary": f"""WITH h AS (SELECT dataset, run_name, round::INT AS round, ((round::INT * 7) % 10) / 10.0::DOUBLE AS v FROM ({HISTORIES})),
 b AS (SELECT dataset, run_name, arg_max(round, (v, -round)) AS best_round, MAX(v) AS best FROM h WHERE round >= 1 GROUP BY ALL),
 n AS (SELECT dataset, run_name, COUNT(*) FILTER (round >= 1) AS done FROM h GROUP BY ALL)
SELECT r.dataset, r.run_name, best_round::BIGINT AS best_round, best AS best_val_auprc, round(best_round / 100.0::DOUBLE, 9) AS best_val_f1, done AS rounds_completed,
 try_cast(nullif(num_rounds, '') AS BIGINT) AS rounds_configured, test_auprc::DOUBLE AS test_auprc
FROM ({RUNS}) r LEFT JOIN b ON b.dataset = r.dataset AND b.run_name = r.run_name LEFT JOIN n ON n.dataset = r.dataset AND n.run_name = r.run_name WHERE scheme <> 'centralized'""",
    "s10_pooled_summary": f"""SELECT dataset, run_name, NULL::BIGINT AS best_round, NULL::BIGINT AS rounds_completed, test_auprc::DOUBLE AS test_auprc,
 try_cast(nullif(test_brier, '') AS DOUBLE) AS test_brier, 'rounds_configured,num_clients,best_round' || CASE WHEN test_brier = 'NA' THEN ',test_brier' ELSE '' END
 || ',rounds_completed' AS undefined FROM ({RUNS}) WHERE scheme = 'centralized'""",
    "s11_fit_rounds": f"SELECT run_id, round FROM ({HISTORY}) WHERE round >= 1",
    "s12_scan_ledger": f"""SELECT dataset, run_name, CASE WHEN scheme = 'iid' THEN test_auprc END AS test_auprc,
 CASE WHEN scheme = 'iid' THEN run_name || ',' || chr(10) || '"x"' END AS note,
 CASE WHEN scheme <> 'iid' THEN nullif(data_hash, '') END AS data_hash FROM ({RUNS})""",
    "s13_append": f"SELECT dataset, run_name, status FROM ({RUNS})",
    "s14_run_parts": NAMES,
    "s15_importance_matrix": f"""WITH x AS (SELECT cell, feature, AVG(importance) AS v FROM ({IMPORTANCES}) GROUP BY ALL)
SELECT feature, {', '.join(f'round(MAX(v) FILTER (cell = {i}), 6) AS client_{i}' for i in range(25))}, round(AVG(v), 6) AS mean FROM x GROUP BY feature""",
    "s16_stability_records": f"""WITH {agree_sql(IMPORTANCES)}, m AS (SELECT cell, feature, AVG(importance) AS v FROM imp GROUP BY ALL)
SELECT cell::VARCHAR AS dataset, round(spearman, 9) AS spearman, round(jaccard, 9) AS jaccard, least(n_features, 10)::INT AS n_top,
 (SELECT feature FROM m WHERE m.cell = shp.cell ORDER BY v DESC, feature LIMIT 1) AS top_feature
FROM shp LEFT JOIN spear USING (cell) LEFT JOIN over USING (cell)""",
    "s17_upsert": f"""SELECT dataset, run_name, CASE WHEN dataset = 'BUILDING' THEN '0.5' ELSE test_auprc END AS test_auprc FROM ({RUNS})
 UNION ALL SELECT dataset, run_name || '_new', test_auprc FROM ({RUNS}) WHERE dataset = 'FURNITURE'""",
    "s18_mine_log": """SELECT doc_id, CASE WHEN n_chars % 3 <> 0 THEN ('0.' || (n_chars % 1000 + 1000))::DOUBLE END AS test_auprc,
 CASE WHEN n_chars % 3 <> 0 THEN 0.5::DOUBLE END AS test_f1, CASE WHEN n_chars % 3 <> 0 THEN 0.25::DOUBLE END AS test_precision,
 CASE WHEN n_chars % 3 <> 0 THEN 0.125::DOUBLE END AS test_recall, (n_chars % 9 || '.5')::DOUBLE AS val_auprc, 0.25::DOUBLE AS val_f1,
 0.125::DOUBLE AS val_precision, 0.75::DOUBLE AS val_recall FROM documents""",
    "s19_thousands": "SELECT o_orderkey, trunc(o_totalprice * 100)::BIGINT AS cents FROM orders",
    "s20_model_round_trip": "SELECT COUNT(*) AS n_rows, 0.0::DOUBLE AS max_difference, TRUE AS identical, TRUE AS within_tolerance FROM orders",
    "s21_compare_predictions": """SELECT COUNT(*) AS n_rows, MAX(abs(o_totalprice - b)) AS max_difference, bool_and(o_totalprice = b) AS identical,
 bool_and(abs(o_totalprice - b) <= 1e-6::DOUBLE + 1e-9::DOUBLE * abs(b)) AS within_tolerance
 FROM (SELECT o_totalprice, CASE WHEN o_orderkey % 1000 = 1 THEN o_totalprice + 0.25 ELSE o_totalprice END AS b FROM orders)""",
}
