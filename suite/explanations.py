"""Queries over attributions and agreement: E1-E22, P12.

Importances come from order lines: a supplier is a client, a nation of suppliers a cell, and line status with
line number the feature; linear attributions explain orders with customers' segments as clients.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rareclass.operators import explain as e
from rareclass.operators.separability import dot
from rareclass.operators.splits import client_background
from suite.common import md5_rank, md5_uniform, rounded, table
from suite.prepare import ORDERS, orders

KEYS = ["cell"]
FLOORS = {"FURNITURE": 0.02, "MACHINERY": 0.9}
WEIGHTS = {"price": 0.8, "days": -0.5, "urgent": 0.3}


def importances(spark, sf_dir):
    li, su = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    feature = F.concat("l_linestatus", F.col("l_linenumber").cast("string"))
    per = li.groupBy("l_suppkey", feature.alias("feature")).agg(F.round(F.avg("l_extendedprice"), 2).alias("importance"))
    return per.join(su, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_nationkey").alias("cell"), F.col("l_suppkey").alias("client_id"), "feature", "importance")


IMPORTANCES = """SELECT s_nationkey AS cell, l_suppkey AS client_id, feature, importance FROM (
  SELECT l_suppkey, l_linestatus || l_linenumber AS feature, round(AVG(l_extendedprice), 2) AS importance
  FROM lineitem GROUP BY ALL) JOIN supplier ON s_suppkey = l_suppkey"""


def flat_importances(spark, sf_dir):
    """The same with some clients made constant or zero, to reach the guards."""
    k = F.col("client_id") % 9
    return importances(spark, sf_dir).withColumn(
        "importance", F.when(k == 0, 0.0).when(k == 1, 3.0).otherwise(F.col("importance")))


FLAT = f"""SELECT * REPLACE (CASE WHEN client_id % 9 = 0 THEN 0.0 WHEN client_id % 9 = 1 THEN 3.0 ELSE importance END AS importance)
FROM ({IMPORTANCES})"""


def explained(spark, sf_dir):
    """Orders as (row_id, client_id, label, features); the price is blurred, as the label is a cut on it."""
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("client_id"))
    return orders(spark, sf_dir).join(cust, "o_custkey").select(
        "row_id", "client_id", "label", F.array(
            (F.col("o_totalprice") + F.col("row_id") * 7919 % 400 * 1000) / 100000.0, F.col("days") / 1000.0,
            (F.col("o_orderpriority") == "1-URGENT").cast("double")).alias("features"))


EXPLAINED = f"""SELECT row_id, c_mktsegment AS client_id, label, [(o_totalprice + row_id * 7919 % 400 * 1000) / 100000.0, days / 1000.0,
CAST(o_orderpriority = '1-URGENT' AS DOUBLE)] AS features FROM ({ORDERS}) JOIN customer ON c_custkey = o_custkey"""

NAMES = list(WEIGHTS)


def by_feature(df, *ids):
    return df.select(*ids, F.posexplode("features").alias("_j", "value")).select(
        *ids, F.get(F.lit(NAMES), F.col("_j")).alias("feature"), "value")


def weights(spark):
    return spark.range(1).select(F.explode(F.create_map(*[F.lit(v) for kv in WEIGHTS.items() for v in kv])).alias("feature", "w"))


def linear(spark, sf_dir):
    df = explained(spark, sf_dir)
    return e.linear_attribution(by_feature(df, "row_id"), weights(spark), by_feature(df, "client_id"))


LINEAR = f"""x AS ({EXPLAINED}), names AS (SELECT * FROM (VALUES {', '.join(f"({i + 1}, '{n}', {w}::DOUBLE)" for i, (n, w) in enumerate(WEIGHTS.items()))}) t(i, feature, w)),
lng AS (SELECT row_id, client_id, feature, w, features[i] AS value FROM x, names),
bg AS (SELECT client_id, feature, AVG(value) AS mean FROM lng GROUP BY ALL),
phi AS (SELECT bg.client_id, l.row_id, feature, w * (value - mean) AS phi, value FROM lng l JOIN bg USING (feature))"""

MARGIN = "features[1] * 0.8 + features[2] * -0.5 + features[3] * 0.3"


def shapley(spark, sf_dir):
    """Every order against the background sample of its own segment."""
    df = explained(spark, sf_dir)
    background = client_background(df, 10).select("client_id", F.lit(1.0).alias("weight"), "features")
    return e.sampled_shapley(df.select("client_id", "row_id", "features"), background,
                             lambda d: d.withColumn("margin", dot("features", list(WEIGHTS.values()))), 3)


SHAPLEY = f"""WITH x AS ({EXPLAINED}),
b AS (SELECT client_id, AVG(features[1]) AS m1, AVG(features[2]) AS m2, AVG(features[3]) AS m3
      FROM (SELECT *, {md5_rank('row_id', 43, 'client_id')} AS rk FROM x) WHERE rk <= 10 GROUP BY client_id)
SELECT b.client_id, x.row_id, round(m1 * 0.8 - m2 * 0.5 + m3 * 0.3, 6) AS base_value, round({MARGIN}, 6) AS margin,
 round(0.8 * (features[1] - m1), 6) AS price, round(-0.5 * (features[2] - m2), 6) AS days, round(0.3 * (features[3] - m3), 6) AS urgent
FROM x JOIN b ON b.client_id = x.client_id"""


def shapley_table(spark, sf_dir):
    df = shapley(spark, sf_dir)
    return rounded(df.select("client_id", "row_id", "base_value", "margin",
                             *[F.col("phi")[i].alias(n) for i, n in enumerate(NAMES)]), 6)


def cells(spark, sf_dir):
    """Agreement per cell with a model label, as a stored text table would hold it."""
    c = e.stability(importances(spark, sf_dir), KEYS)
    return c.select("cell", "n_clients", "spearman", "jaccard", "kuncheva",
                    F.when(F.col("cell") % 3 == 0, "FURNITURE").when(F.col("cell") % 3 == 1, "MACHINERY")
                    .otherwise("BUILDING").alias("model"))


def floored(spark, sf_dir):
    return e.comparable_cells(cells(spark, sf_dir), FLOORS)


def two_seeds(spark, sf_dir):
    """Two half samples of the same importances per budget: seed = order parity, budget = line limit."""
    li = table(spark, sf_dir, "lineitem")
    feature = F.concat("l_linestatus", F.col("l_linenumber").cast("string"))
    sized = li.select((F.col("l_orderkey") % 2).alias("seed"), F.col("l_returnflag").alias("model"), feature.alias("feature"),
                      "l_extendedprice", F.explode(F.lit([10.0, 25.0, 50.0])).alias("budget")).where(F.col("l_quantity") <= F.col("budget"))
    return sized.groupBy("budget", "model", "seed", "feature").agg(F.sum("l_extendedprice").alias("importance"))


TWO_SEEDS = """SELECT l_orderkey % 2 AS client_id, l_returnflag AS model, l_linestatus || l_linenumber AS feature, budget,
SUM(l_extendedprice) AS importance FROM lineitem, (VALUES (10.0::DOUBLE), (25.0::DOUBLE), (50.0::DOUBLE)) t(budget) WHERE l_quantity <= budget
GROUP BY ALL"""


def agreement(spark, sf_dir):
    return e.self_agreement(two_seeds(spark, sf_dir), ["budget", "model"])


def compared(spark, sf_dir):
    a = importances(spark, sf_dir)
    b = a.where("client_id % 50 <> 7").withColumn("importance", F.col("importance") + F.when(F.col("client_id") == 3, 0.25).otherwise(0.0))
    return rounded(e.compare_importance(a, b))


def pairs(spark, sf_dir):
    """Every order's set of line numbers against its part set, as equal-size selections of 7."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set("l_linenumber")).alias("a"))
    b = F.transform("a", lambda v: (v % 7 + 1).cast("int"))
    return rounded(e.kuncheva_pair(li.select("l_orderkey", "a", b.alias("b"), F.lit(7).alias("d"))).select("l_orderkey", "kuncheva"))


def agree_sql(source, keys="cell", k=5):
    using = f"USING ({keys})"
    gkeys = ", ".join("g." + x.strip() for x in keys.split(","))
    akeys = ", ".join("a." + x.strip() for x in keys.split(","))
    on = " AND ".join(f"a.{x.strip()} = b.{x.strip()}" for x in keys.split(","))
    return f"""imp AS ({source}),
rnk AS (SELECT *, RANK() OVER (PARTITION BY {keys}, client_id ORDER BY importance) + (COUNT(*) OVER (PARTITION BY {keys}, client_id, importance) - 1) / 2.0::DOUBLE AS r,
        ROW_NUMBER() OVER (PARTITION BY {keys}, client_id ORDER BY importance DESC, feature) AS pos FROM imp),
rho AS (SELECT {akeys}, a.client_id AS ca, b.client_id AS cb, corr(a.r, b.r) AS rho FROM rnk a JOIN rnk b
        ON {on} AND a.feature = b.feature AND a.client_id < b.client_id GROUP BY ALL),
tops AS (SELECT {keys}, client_id, list(feature) AS f FROM rnk WHERE pos <= {k} GROUP BY ALL),
ov AS (SELECT {akeys}, len(list_intersect(a.f, b.f)) AS r, len(a.f) AS k FROM tops a JOIN tops b ON {on} AND a.client_id < b.client_id),
shp AS (SELECT {keys}, COUNT(*) AS n_clients, MAX(d) AS n_features FROM (SELECT {keys}, client_id, COUNT(*) AS d FROM imp GROUP BY ALL) GROUP BY {keys}),
spear AS (SELECT {keys}, CASE WHEN bool_or(rho IS NULL OR isnan(rho)) THEN NULL ELSE AVG(rho) END AS spearman FROM rho GROUP BY {keys}),
over AS (SELECT {keys}, AVG(r::DOUBLE / (2 * k - r)) AS jaccard,
   AVG(CASE WHEN k = n_features THEN 1.0::DOUBLE ELSE (r - k * k::DOUBLE / n_features) / (k - k * k::DOUBLE / n_features) END) AS kuncheva
   FROM ov JOIN shp {using} GROUP BY {keys}),
degen AS (SELECT {keys}, coalesce(list(client_id ORDER BY client_id) FILTER (hi <= 1e-12 OR hi - lo <= 1e-9 * hi), []) AS degenerate_clients
   FROM (SELECT {keys}, client_id, MAX(abs(importance)) AS hi, MIN(abs(importance)) AS lo FROM imp GROUP BY ALL) GROUP BY {keys})"""


STABLE = """SELECT cell, n_clients, n_features, CASE WHEN ok THEN round(spearman, 9) END AS spearman, CASE WHEN ok THEN round(jaccard, 9) END AS jaccard,
 CASE WHEN ok THEN round(kuncheva, 9) END AS kuncheva, degenerate_clients,
 CASE WHEN n_clients < 2 THEN 'agreement needs two clients'
      WHEN len(degenerate_clients) > 0 THEN 'no ranking from clients ' || array_to_string(degenerate_clients, ', ')
      WHEN spearman IS NULL THEN 'rank correlation undefined' END AS stability_note
FROM (SELECT *, n_clients >= 2 AND len(degenerate_clients) = 0 AS ok
      FROM shp LEFT JOIN spear USING (cell) LEFT JOIN over USING (cell) JOIN degen USING (cell))"""

CELLS = f"""{agree_sql(IMPORTANCES)}, st AS ({STABLE}),
cells AS (SELECT cell, n_clients, spearman, jaccard, kuncheva, CASE cell % 3 WHEN 0 THEN 'FURNITURE' WHEN 1 THEN 'MACHINERY' ELSE 'BUILDING' END AS model FROM st),
fl AS (SELECT *, CASE model WHEN 'FURNITURE' THEN 0.02::DOUBLE WHEN 'MACHINERY' THEN 0.9::DOUBLE END AS noise_floor,
       spearman <= CASE model WHEN 'FURNITURE' THEN 0.02::DOUBLE WHEN 'MACHINERY' THEN 0.9::DOUBLE END AS below_floor FROM cells WHERE n_clients > 1)"""

QUERIES = {
    "e1_linear_attribution": lambda s, d: rounded(linear(s, d), 6),
    "e2_sampled_shapley": shapley_table,
    "e3_importance": lambda s, d: rounded(e.importance(linear(s, d)), 6),
    "e4_consensus_top10": lambda s, d: rounded(e.top_consensus(importances(s, d), KEYS), 6),
    "e5_spearman_stability": lambda s, d: rounded(e.spearman_stability(importances(s, d), KEYS)),
    "e6_jaccard_at_k": lambda s, d: rounded(e.jaccard_at_k(importances(s, d), 5, KEYS)),
    "e7_kuncheva_pair": pairs,
    "e8_kuncheva_index": lambda s, d: rounded(e.kuncheva_index(importances(s, d), 5, KEYS)),
    "e9_near_zero_share": lambda s, d: rounded(e.near_zero_share(flat_importances(s, d), ["cell", "client_id"])),
    "e10_degenerate_clients": lambda s, d: e.degenerate_clients(flat_importances(s, d), KEYS),
    "e11_stability_guarded": lambda s, d: rounded(e.stability(flat_importances(s, d), KEYS)),
    "p12_e12_comparable_cells": lambda s, d: rounded(floored(s, d)),
    "e13_self_agreement": lambda s, d: rounded(agreement(s, d)),
    "e13_adopted_budget": lambda s, d: e.adopted_budget(agreement(s, d), floor=0.5),
    "e14_compare_importance": compared,
    "e15_pooled_order": lambda s, d: rounded(e.pooled_order(linear(s, d)), 6),
    "e16_beeswarm_points": lambda s, d: rounded(e.beeswarm_points(
        linear(s, d), by_feature(explained(s, d), "row_id"), 2), 6),
    "e16_beeswarm_limits": lambda s, d: rounded(e.beeswarm_limits(linear(s, d)), 6),
    "e17_margin_to_floor": lambda s, d: rounded(e.margin_to_floor(floored(s, d)).select("cell", "model", "margin")),
    "e17_floor_count": lambda s, d: e.floor_count(floored(s, d)),
    "e18_box_statistics": lambda s, d: rounded(e.box_statistics(floored(s, d), ["spearman", "jaccard", "kuncheva"]), 6),
    "e19_pivot_mean": lambda s, d: rounded(e.pivot_mean(
        floored(s, d), "n_clients", "model", "kuncheva", ["MACHINERY", "FURNITURE", "BUILDING"]), 6),
    "e20_least_stable": lambda s, d: rounded(e.least_stable(floored(s, d), "kuncheva", 5, ["cell"]).select("cell", "model", "line")),
    "e21_client_bars": lambda s, d: rounded(e.client_bars(e.importance(linear(s, d)), e.pooled_order(linear(s, d), 2)), 6),
    "e22_additivity": lambda s, d: rounded(e.additivity_error(shapley(s, d)), 6),
}

ORACLES = {
    "e1_linear_attribution": f"WITH {LINEAR} SELECT client_id, row_id, feature, round(phi, 6) AS phi FROM phi",
    "e2_sampled_shapley": SHAPLEY,
    "e3_importance": f"WITH {LINEAR} SELECT client_id, feature, round(AVG(abs(phi)), 6) AS importance FROM phi GROUP BY ALL",
    "e4_consensus_top10": f"""SELECT cell, feature, round(m, 6) AS mean_importance, rk::INT AS rank FROM (
 SELECT cell, feature, AVG(importance) AS m, ROW_NUMBER() OVER (PARTITION BY cell ORDER BY AVG(importance) DESC, feature) AS rk
 FROM ({IMPORTANCES}) GROUP BY cell, feature) WHERE rk <= 10""",
    "e5_spearman_stability": f"WITH {agree_sql(IMPORTANCES)} SELECT cell, n_clients, n_features, round(spearman, 9) AS spearman FROM shp LEFT JOIN spear USING (cell)",
    "e6_jaccard_at_k": f"WITH {agree_sql(IMPORTANCES)} SELECT cell, round(jaccard, 9) AS jaccard FROM shp LEFT JOIN over USING (cell)",
    "e7_kuncheva_pair": """SELECT l_orderkey, round(CASE WHEN len(a) = 7 THEN 1.0::DOUBLE ELSE
 (len(list_intersect(a, list_transform(a, lambda v: v % 7 + 1))) - len(a) * len(a) / 7.0::DOUBLE) / (len(a) - len(a) * len(a) / 7.0::DOUBLE) END, 9) AS kuncheva
FROM (SELECT l_orderkey, list(DISTINCT l_linenumber) AS a FROM lineitem GROUP BY l_orderkey)""",
    "e8_kuncheva_index": f"WITH {agree_sql(IMPORTANCES)} SELECT cell, round(kuncheva, 9) AS kuncheva FROM shp LEFT JOIN over USING (cell)",
    "e9_near_zero_share": f"SELECT cell, client_id, round(AVG(CAST(abs(importance) <= 1e-9 AS DOUBLE)), 9) AS near_zero FROM ({FLAT}) GROUP BY ALL",
    "e10_degenerate_clients": f"WITH {agree_sql(FLAT)} SELECT cell, degenerate_clients FROM degen",
    "e11_stability_guarded": f"WITH {agree_sql(FLAT)} {STABLE}",
    "p12_e12_comparable_cells": f"WITH {CELLS} SELECT * FROM fl",
    "e13_self_agreement": f"""WITH {agree_sql(TWO_SEEDS, 'budget, model')} SELECT budget, model, round(spearman, 9) AS spearman,
 round(jaccard, 9) AS jaccard FROM shp LEFT JOIN spear USING (budget, model) LEFT JOIN over USING (budget, model)""",
    "e13_adopted_budget": f"""WITH {agree_sql(TWO_SEEDS, 'budget, model')} SELECT MIN(budget) FILTER (ok) AS adopted_budget FROM (
 SELECT budget, bool_and(coalesce(spearman > 0.5, FALSE)) AS ok FROM shp LEFT JOIN spear USING (budget, model) GROUP BY budget)""",
    "e14_compare_importance": f"""SELECT CASE WHEN COUNT(*) FILTER (client_id = 3) > 0 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS max_difference,
 0::BIGINT AS n_only_stored, COUNT(*) FILTER (client_id % 50 = 7) AS n_only_fresh, FALSE AS matches FROM ({IMPORTANCES})""",
    "e15_pooled_order": f"""WITH {LINEAR} SELECT feature, round(m, 6) AS mean_abs, ROW_NUMBER() OVER (ORDER BY m DESC, feature)::INT AS rank
 FROM (SELECT feature, AVG(abs(phi)) AS m FROM phi GROUP BY feature)""",
    "e16_beeswarm_points": f"""WITH {LINEAR}, o AS (SELECT feature, ROW_NUMBER() OVER (ORDER BY AVG(abs(phi)) DESC, feature) AS rank FROM phi GROUP BY feature QUALIFY rank <= 2),
 sp AS (SELECT feature, MIN(value) AS lo, MAX(value) AS hi FROM lng GROUP BY feature)
 SELECT client_id, row_id, feature, rank::INT AS rank, round(phi, 6) AS phi,
  round(least(1, greatest(0, (value - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END)), 6) AS shade,
  round({md5_uniform("'42:' || client_id || ':' || row_id || ':' || feature")} * 0.64 - 0.32, 6) AS jitter
 FROM phi JOIN o USING (feature) JOIN sp USING (feature)""",
    "e16_beeswarm_limits": f"WITH {LINEAR} SELECT round(quantile_cont(phi, 0.005), 6) AS x_low, round(quantile_cont(phi, 0.995), 6) AS x_high FROM phi",
    "e17_margin_to_floor": f"WITH {CELLS} SELECT cell, model, round(spearman - noise_floor, 9) AS margin FROM fl WHERE spearman IS NOT NULL AND noise_floor IS NOT NULL",
    "e17_floor_count": f"""WITH {CELLS} SELECT COUNT(*) FILTER (spearman <= noise_floor) AS n_below,
 COUNT(*) FILTER (spearman IS NOT NULL AND noise_floor IS NOT NULL) AS n_cells FROM fl""",
    "e18_box_statistics": f"""WITH {CELLS}, lg AS (UNPIVOT (SELECT model, spearman, jaccard, kuncheva FROM fl) ON spearman, jaccard, kuncheva INTO NAME metric VALUE value),
 q AS (SELECT model, metric, quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3, COUNT(*) AS n FROM lg GROUP BY ALL)
 SELECT model, metric, round(q1, 6) AS q1, round(any_value(q.median), 6) AS median, round(q3, 6) AS q3,
  round(MIN(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,
  round(MAX(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_high, n
 FROM lg JOIN q USING (model, metric) GROUP BY model, metric, q1, q3, n""",
    "e19_pivot_mean": f"""WITH {CELLS} SELECT n_clients, round(AVG(kuncheva) FILTER (model = 'MACHINERY'), 6) AS "MACHINERY",
 round(AVG(kuncheva) FILTER (model = 'FURNITURE'), 6) AS "FURNITURE", round(AVG(kuncheva) FILTER (model = 'BUILDING'), 6) AS "BUILDING" FROM fl GROUP BY n_clients""",
    "e20_least_stable": f"""WITH {CELLS} SELECT cell, model, printf('%.4f (jaccard=%.4f, spearman=%.4f)', kuncheva, jaccard, spearman) AS line FROM fl
 WHERE kuncheva IS NOT NULL ORDER BY round(kuncheva, 12), cell LIMIT 5""",
    "e21_client_bars": f"""WITH {LINEAR}, o AS (SELECT feature FROM phi GROUP BY feature ORDER BY AVG(abs(phi)) DESC, feature LIMIT 2)
 SELECT client_id, feature, round(AVG(abs(phi)), 6) AS importance FROM phi WHERE feature IN (SELECT feature FROM o) GROUP BY ALL""",
    "e22_additivity": "SELECT c_mktsegment AS client_id, 0.0::DOUBLE AS max_error FROM customer GROUP BY 1",
}
