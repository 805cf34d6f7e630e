"""Queries over vectors and features: G1-G17, P10."""

from __future__ import annotations

from pyspark.sql import functions as F

from rareclass.operators import features as f
from rareclass.operators import separability as g
from rareclass.operators.neighbors import knn_join, nearest_segments
from rareclass.operators.splits import client_counts
from rareclass.plans.difficulty import difficulty_summary
from suite.common import rounded, table
from suite.partitions import ASSIGNED, CLIENTS, assigned


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"),
        (F.col("label") == 0).cast("int").alias("label"))


VECTORS = """SELECT vec_id AS row_id, embedding::DOUBLE[] AS features, CAST(label = 0 AS INT) AS label FROM embeddings"""

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"), *NUMERIC)


def long_lines(spark, sf_dir):
    return f.unpivot(lines(spark, sf_dir), NUMERIC, ["label"])


LONG = " UNION ALL ".join(
    f"SELECT CAST(l_returnflag = 'R' AS INT) AS label, '{c}' AS feature, {c}::DOUBLE AS value FROM lineitem" for c in NUMERIC)


def best_columns(spark, sf_dir):
    """P10: keep the two columns with the best single-feature AUC."""
    names = f.top_features(g.univariate_auc_ks(long_lines(spark, sf_dir)), 2)
    kept = f.unpivot(lines(spark, sf_dir).select("label", *names), names, ["label"])
    return kept.groupBy("label", "feature").agg(F.round(F.sum("value"), 2).alias("total"))


def discriminant(spark, sf_dir):
    df = g.lda_projection(vectors(spark, sf_dir))
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("z"), 6).alias("mean_z"),
                                   F.round(F.stddev_samp("z"), 6).alias("sd_z"))


def lda_overlap(spark, sf_dir):
    return rounded(g.overlap_coefficient(g.lda_projection(vectors(spark, sf_dir))), 6)


def price_overlap(spark, sf_dir):
    df = lines(spark, sf_dir).select("label", F.col("l_extendedprice").alias("z"))
    return rounded(g.overlap_coefficient(df))


def ledger_rows(spark, sf_dir):
    """A ledger made of orders: one run per (segment, priority, status) with its metrics."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("c_mktsegment").alias("dataset"), F.col("o_orderpriority").alias("model"),
        F.col("o_orderstatus").alias("scheme")).agg(
        F.avg((F.col("o_totalprice") > 250000).cast("double")).alias("test_auprc"),
        F.avg((F.col("o_totalprice") > 400000).cast("double")).alias("baseline_auprc")
    ).withColumn("oversampling", F.lit("none"))


def lift(spark, sf_dir):
    return rounded(g.lift_over_prevalence(ledger_rows(spark, sf_dir), "1-URGENT", "F", "none"))


def top_text(spark, sf_dir):
    return g.top_features_text(g.univariate_auc_ks(g.long_features(vectors(spark, sf_dir))))


def pairs_sql(k, q="SELECT * FROM v", r="SELECT * FROM v", on="q.row_id <> r.row_id"):
    return f"""WITH v AS ({VECTORS}), near AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY distance, nn_id) AS nn_rank FROM (
    SELECT q.row_id AS query_id, q.label AS label, r.row_id AS nn_id, r.label AS nn_label,
           sqrt(list_sum(list_transform(list_zip(q.features, r.features), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS distance
    FROM ({q}) q JOIN ({r}) r ON {on}) QUALIFY nn_rank <= {k})"""


AUC_KS = f"""WITH l AS ({LONG}), counted AS (
  SELECT feature, value, COUNT(*) FILTER (label = 1) AS p, COUNT(*) FILTER (label = 0) AS n FROM l GROUP BY ALL),
run AS (SELECT *, SUM(p) OVER w AS cp, SUM(n) OVER w AS cn, SUM(p) OVER g AS tp, SUM(n) OVER g AS tn FROM counted
        WINDOW g AS (PARTITION BY feature), w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING)),
uni AS (SELECT feature, greatest(a, 1 - a) AS auc, ks FROM (
  SELECT feature, SUM(p * (cn - n / 2.0::DOUBLE)) / (any_value(tp)::DOUBLE * any_value(tn)) AS a,
         MAX(abs(cp::DOUBLE / tp - cn::DOUBLE / tn)) AS ks FROM run GROUP BY feature))"""

QUERIES = {
    "g1_knn_join": lambda s, d: rounded(knn_join(
        vectors(s, d), vectors(s, d), 5, keep=["label"], carry=["label"], exclude_self=True)),
    "g2_minority_typology": lambda s, d: rounded(g.minority_typology(vectors(s, d))),
    "g3_n3_error": lambda s, d: rounded(g.n3_error(vectors(s, d))),
    "g4_n2_ratio": lambda s, d: rounded(g.n2_ratio(vectors(s, d))),
    "g5_n1_boundary": lambda s, d: rounded(g.n1_boundary(vectors(s, d))),
    "g6_fisher_inverse": lambda s, d: rounded(g.fisher_inverse(g.long_features(vectors(s, d)))),
    "g6_fisher_inverse_lines": lambda s, d: rounded(g.fisher_inverse(long_lines(s, d))),
    "g7_g8_univariate_auc_ks": lambda s, d: rounded(g.univariate_auc_ks(long_lines(s, d))),
    "g7_g8_univariate_vectors": lambda s, d: rounded(g.univariate_auc_ks(g.long_features(vectors(s, d)))),
    "g9_top_features": lambda s, d: rounded(g.top_features(g.univariate_auc_ks(long_lines(s, d)), 3)),
    "g9_top_features_text": top_text,
    "p10_best_columns": best_columns,
    "g10_lda_projection": discriminant,
    "g11_lda_overlap": lda_overlap,
    "g11_price_overlap": price_overlap,
    "g12_difficulty_summary": lambda s, d: rounded(difficulty_summary(vectors(s, d), "embeddings"), 6),
    "g13_lift_over_prevalence": lift,
    "g17_worst_client": lambda s, d: g.worst_client(client_counts(assigned(s, d), CLIENTS)),
}

FISHER = """SELECT round(1.0::DOUBLE / (1.0::DOUBLE + max(CASE WHEN vp + vn > 0 THEN (mp - mn) * (mp - mn) / (vp + vn) ELSE 0 END)), 9) AS f1
FROM (SELECT feature, avg(value) FILTER (label = 1) AS mp, avg(value) FILTER (label = 0) AS mn,
             var_pop(value) FILTER (label = 1) AS vp, var_pop(value) FILTER (label = 0) AS vn FROM ({}) GROUP BY feature)"""

LONG_VECTORS = f"SELECT label, 'f' || (i - 1) AS feature, features[i] AS value FROM ({VECTORS}), range(1, 65) t(i)"

ORACLES = {
    "g1_knn_join": pairs_sql(5) + "SELECT query_id, label, nn_rank::INT AS nn_rank, nn_id, round(distance, 9) AS distance, nn_label FROM near",
    "g2_minority_typology": pairs_sql(5, q="SELECT * FROM v WHERE label = 1") + """, t AS (
  SELECT query_id, SUM(nn_label) AS m FROM near GROUP BY query_id),
c AS (SELECT COUNT(*) AS n_minority, COUNT(*) FILTER (m >= 4) AS safe, COUNT(*) FILTER (m IN (2, 3)) AS borderline,
             COUNT(*) FILTER (m = 1) AS rare, COUNT(*) FILTER (m = 0) AS outlier FROM t)
SELECT *, round(100.0::DOUBLE * safe / n_minority, 9) AS safe_pct, round(100.0::DOUBLE * borderline / n_minority, 9) AS borderline_pct,
 round(100.0::DOUBLE * rare / n_minority, 9) AS rare_pct, round(100.0::DOUBLE * outlier / n_minority, 9) AS outlier_pct,
 round(100.0::DOUBLE * rare / n_minority + 100.0::DOUBLE * outlier / n_minority, 9) AS rare_outlier_pct FROM c""",
    "g3_n3_error": pairs_sql(1) + "SELECT round(AVG(CAST(label <> nn_label AS DOUBLE)), 9) AS n3 FROM near",
    "g4_n2_ratio": pairs_sql(1, on="q.row_id <> r.row_id AND q.label = r.label") + f""", other AS (
  SELECT q.row_id, min(sqrt(list_sum(list_transform(list_zip(q.features, r.features), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))) AS d
  FROM v q JOIN v r ON q.label <> r.label GROUP BY q.row_id)
SELECT round((SELECT SUM(distance) FROM near) / (SELECT SUM(d) FROM other), 9) AS n2""",
    "g6_fisher_inverse": FISHER.format(LONG_VECTORS),
    "g6_fisher_inverse_lines": FISHER.format(LONG),
    "g7_g8_univariate_auc_ks": AUC_KS + "SELECT feature, round(auc, 9) AS auc, round(ks, 9) AS ks FROM uni",
    "g7_g8_univariate_vectors": AUC_KS.replace(LONG, LONG_VECTORS) + "SELECT feature, round(auc, 9) AS auc, round(ks, 9) AS ks FROM uni",
    "p10_best_columns": AUC_KS + """SELECT label, feature, round(SUM(value), 2) AS total FROM l
WHERE feature IN (SELECT feature FROM uni ORDER BY auc DESC, feature LIMIT 2) GROUP BY ALL""",
    "g9_top_features": AUC_KS + """SELECT feature, round(auc, 9) AS auc, round(ks, 9) AS ks,
ROW_NUMBER() OVER (ORDER BY auc DESC, feature)::INT AS rank FROM uni ORDER BY rank LIMIT 3""",
    "g9_top_features_text": AUC_KS.replace(LONG, LONG_VECTORS) + """SELECT string_agg(feature || '(' || printf('%.3f', auc) || ')', ', ' ORDER BY auc DESC, feature)
AS top_features FROM (SELECT * FROM uni ORDER BY auc DESC, feature LIMIT 5)""",
    "g11_price_overlap": """WITH s AS (SELECT CAST(l_returnflag = 'R' AS INT) AS label, l_extendedprice AS z FROM lineitem),
e AS (SELECT quantile_cont(z, 0.001) AS lo, quantile_cont(z, 0.999) AS hi FROM s),
b AS (SELECT least(floor((z - lo) / ((hi - lo) / 199)), 198) AS bin, COUNT(*) FILTER (label = 1) AS p, COUNT(*) FILTER (label = 0) AS n
      FROM s, e WHERE z BETWEEN lo AND hi GROUP BY 1)
SELECT round(SUM(least(p::DOUBLE / (SELECT SUM(p) FROM b), n::DOUBLE / (SELECT SUM(n) FROM b))), 9) AS overlap FROM b""",
    "g13_lift_over_prevalence": """SELECT c_mktsegment AS dataset, round(AVG(CAST(o_totalprice > 250000 AS DOUBLE)), 9) AS test_auprc,
round(AVG(CAST(o_totalprice > 400000 AS DOUBLE)), 9) AS baseline_auprc,
round(AVG(CAST(o_totalprice > 250000 AS DOUBLE)) / AVG(CAST(o_totalprice > 400000 AS DOUBLE)), 9) AS lift
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' GROUP BY 1""",
    "g17_worst_client": f"""SELECT client_id, SUM(label)::BIGINT AS n_pos FROM ({ASSIGNED}) GROUP BY client_id
ORDER BY n_pos, client_id LIMIT 1""",
}
