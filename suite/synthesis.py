"""Queries over oversampling and the minority census: O1-O8, G14-G16, G18, G19."""

from __future__ import annotations

from pyspark.sql import functions as F

from rareclass.operators import census as c
from rareclass.operators import oversample as o
from rareclass.operators import separability as g
from rareclass.operators.neighbors import nearest_segments
from rareclass.operators.splits import client_counts, dirichlet_shares
from suite.common import md5_rank, md5_uniform, rounded, table
from suite.neighbours import VECTORS, vectors
from suite.partitions import ASSIGNED, CLIENTS, assigned
from suite.prepare import ORDERS, orders

TARGET, K, SEED = 0.5, 5, 42
DISTANCE = "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"


def members(spark, sf_dir):
    """Vectors with a natural client; one client is far larger than the others."""
    client = F.when(F.col("row_id") % 10 < 6, 0).when(F.col("row_id") % 10 < 9, 1).otherwise(2)
    return vectors(spark, sf_dir).withColumn("client_id", client)


MEMBERS = f"""SELECT *, CASE WHEN row_id % 10 < 6 THEN 0 WHEN row_id % 10 < 9 THEN 1 ELSE 2 END AS client_id
FROM ({VECTORS})"""


def plan_sql(target=TARGET, source=MEMBERS):
    return f"""SELECT *, CASE WHEN skip_reason IS NULL THEN greatest(floor({target}::DOUBLE * (n_samples - n_pos)) - n_pos, 0)::BIGINT
  ELSE 0 END AS n_wanted FROM (
  SELECT *, CASE WHEN n_pos < {K + 1} THEN 'insufficient_minority'
                 WHEN n_pos >= {target}::DOUBLE * (n_samples - n_pos) THEN 'target_met' END AS skip_reason FROM (
    SELECT client_id, COUNT(*) AS n_samples, COUNT(*) FILTER (label = 1) AS n_pos FROM ({source}) GROUP BY client_id))"""


def report_sql(made="n_wanted", plan="plan"):
    return f"""SELECT client_id, n_samples, n_pos, skip_reason IS NULL AS applied, skip_reason,
n_samples + {made} AS n_samples_after, n_pos + {made} AS n_pos_after,
round((n_pos + {made})::DOUBLE / (n_samples + {made}), 9) AS pos_ratio_after, n_pos AS n_real_minority,
{made} AS n_synthetic, round(CASE WHEN skip_reason IS NULL AND n_pos > 0 THEN {made}::DOUBLE / n_pos ELSE 0 END, 9)
AS synthesis_multiplier FROM {plan}"""


SMOTE = f"""WITH m AS ({MEMBERS}), plan AS ({plan_sql(source='SELECT * FROM m')}),
mino AS (SELECT m.*, {md5_rank('row_id', SEED, 'client_id')} AS pos FROM m
         JOIN plan USING (client_id) WHERE label = 1 AND skip_reason IS NULL AND n_wanted > 0),
near AS (SELECT a.client_id, a.row_id, b.features AS other,
                ROW_NUMBER() OVER (PARTITION BY a.row_id ORDER BY {DISTANCE.format(a='a.features', b='b.features')}, b.row_id) AS rk
         FROM mino a JOIN mino b ON a.client_id = b.client_id AND a.row_id <> b.row_id QUALIFY rk <= {K}),
draws AS (SELECT client_id, n_pos, unnest(range(1, n_wanted + 1)) AS draw FROM plan WHERE n_wanted > 0),
u AS (SELECT *, {md5_uniform(f"'{SEED}:' || client_id || ':' || draw || ':base'")} AS ub,
             {md5_uniform(f"'{SEED}:' || client_id || ':' || draw || ':near'")} AS un,
             {md5_uniform(f"'{SEED}:' || client_id || ':' || draw || ':gap'")} AS ug FROM draws),
made AS (SELECT u.client_id, 's-' || u.client_id || '-' || draw AS row_id,
                list_transform(list_zip(mino.features, near.other), lambda p: p[1] + ug * (p[2] - p[1])) AS features,
                1 AS label, TRUE AS is_synthetic
         FROM u JOIN mino ON mino.client_id = u.client_id AND mino.pos = floor(ub * n_pos) + 1
         JOIN near ON near.row_id = mino.row_id AND near.rk = floor(un * {K}) + 1)"""

WHOLE = """SELECT client_id, row_id, label, is_synthetic, list_transform(features, lambda v: round(v, 9)) AS features FROM (
SELECT * FROM made UNION ALL SELECT client_id, row_id::VARCHAR, features, label, FALSE FROM m)"""

ADASYN = f"""WITH m AS ({MEMBERS}), plan AS ({plan_sql(source='SELECT * FROM m')}),
mino AS (SELECT m.* FROM m JOIN plan USING (client_id) WHERE label = 1 AND skip_reason IS NULL AND n_wanted > 0),
around AS (SELECT a.client_id, a.row_id, b.label,
                  ROW_NUMBER() OVER (PARTITION BY a.row_id ORDER BY {DISTANCE.format(a='a.features', b='b.features')}, b.row_id) AS rk
           FROM mino a JOIN m b ON a.client_id = b.client_id AND a.row_id <> b.row_id QUALIFY rk <= {K}),
hard AS (SELECT client_id, row_id, COUNT(*) FILTER (label <> 1) / {float(K)}::DOUBLE AS r FROM around GROUP BY 1, 2),
quota AS (SELECT h.client_id, row_id, CASE WHEN t > 0 THEN round_even(r / t * n_wanted, 0)::BIGINT ELSE 0 END AS n
          FROM hard h JOIN (SELECT client_id, SUM(r) AS t FROM hard GROUP BY 1) USING (client_id) JOIN plan USING (client_id)),
near AS (SELECT a.client_id, a.row_id, b.features AS other,
                ROW_NUMBER() OVER (PARTITION BY a.row_id ORDER BY {DISTANCE.format(a='a.features', b='b.features')}, b.row_id) AS rk
         FROM mino a JOIN mino b ON a.client_id = b.client_id AND a.row_id <> b.row_id QUALIFY rk <= {K}),
draws AS (SELECT client_id, row_id, unnest(range(1, n + 1)) AS draw FROM quota WHERE n > 0),
u AS (SELECT *, {md5_uniform(f"'{SEED}:' || client_id || ':' || row_id || ':' || draw || ':near'")} AS un,
             {md5_uniform(f"'{SEED}:' || client_id || ':' || row_id || ':' || draw || ':gap'")} AS ug FROM draws),
made AS (SELECT u.client_id, 's-' || u.client_id || '-' || u.row_id || '-' || draw AS row_id,
                list_transform(list_zip(mino.features, near.other), lambda p: p[1] + ug * (p[2] - p[1])) AS features,
                1 AS label, TRUE AS is_synthetic
         FROM u JOIN mino ON mino.row_id = u.row_id JOIN near ON near.row_id = u.row_id AND near.rk = floor(un * {K}) + 1)"""


def listed(df):
    return df.withColumn("features", F.transform("features", lambda v: F.round(v, 9) + F.lit(0.0)))


def smote_rows(spark, sf_dir):
    return listed(o.smote(members(spark, sf_dir), TARGET, K, SEED)[0])


def adasyn_rows(spark, sf_dir):
    return listed(o.adasyn(members(spark, sf_dir), TARGET, K, SEED)[0])


def synthetic(spark, sf_dir):
    rows = o.smote(members(spark, sf_dir), TARGET, K, SEED)[0]
    return rows.where("is_synthetic"), rows.where("NOT is_synthetic")


def segments(spark, sf_dir):
    made, real = synthetic(spark, sf_dir)
    return rounded(nearest_segments(made, real.where("label = 1"), by=["client_id"]), 6)


def segment_stats(spark, sf_dir):
    made, real = synthetic(spark, sf_dir)
    return rounded(g.segment_statistics(made, real.where("label = 1"), by=["client_id"]), 6)


def territory(spark, sf_dir):
    return rounded(g.majority_territory(*synthetic(spark, sf_dir)))


def pooled(spark, sf_dir):
    return rounded(o.oversample_pooled(members(spark, sf_dir), "smote", strategy=TARGET)[1])


def pooled_fallback(spark, sf_dir):
    return rounded(o.oversample_pooled(members(spark, sf_dir), "smote", strategy=0.01)[1])


def skips(spark, sf_dir):
    """Every (nation, order status) as a client: the whole range of skip reasons."""
    df = by_customer(spark, sf_dir)
    return rounded(o.report(o.oversampling_plan(df, 0.115, K)))


def by_customer(spark, sf_dir):
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
    return orders(spark, sf_dir).join(cust, "o_custkey").select(
        "row_id", "label", F.concat_ws("/", "c_nationkey", "c_mktsegment").alias("client_id"), "c_nationkey")


BY_CUSTOMER = f"""SELECT row_id, label, c_nationkey || '/' || c_mktsegment AS client_id, c_nationkey
FROM ({ORDERS}) JOIN customer ON c_custkey = o_custkey"""


def noops(spark, sf_dir):
    counts = client_counts(by_customer(spark, sf_dir), keys=["c_nationkey"])
    return o.noop_cells(counts, ["c_nationkey"], 0.08, K)


def census_rows(spark, sf_dir):
    df = orders(spark, sf_dir).withColumnRenamed("o_orderstatus", "dataset").select("row_id", "label", "dataset")
    return c.minority_census(df, n_features=13, target=0.12)


def _share_rows():
    out = []
    for seed in c.SEEDS:
        for alpha in c.ALPHAS:
            for y, cum in dirichlet_shares((0, 1), alpha, CLIENTS, seed).items():
                for k in range(CLIENTS):
                    out.append(f"({seed}, {alpha}::DOUBLE, {y}, {k}, {cum[k - 1] if k else 0.0!r}::DOUBLE, "
                               + (f"{cum[k]!r}::DOUBLE)" if k < CLIENTS - 1 else "NULL)"))
    return ", ".join(out)


CENSUS = f"""WITH src AS (SELECT row_id, label, o_orderstatus AS dataset FROM ({ORDERS})),
iid AS (SELECT dataset, seed, 'iid' AS scheme, NULL::DOUBLE AS alpha,
   (CASE WHEN pos < big THEN pos // (base + 1) ELSE n % {CLIENTS} + (pos - big) // greatest(base, 1) END)::INT AS client_id,
   COUNT(*) AS n_total, COUNT(*) FILTER (label = 1) AS n_minority
  FROM (SELECT *, n // {CLIENTS} AS base, (n % {CLIENTS}) * (n // {CLIENTS} + 1) AS big FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY dataset, seed ORDER BY md5(seed || ':' || row_id), row_id) - 1 AS pos,
           COUNT(*) OVER (PARTITION BY dataset, seed) AS n
    FROM src, (VALUES {', '.join(f'({s})' for s in c.SEEDS)}) t(seed))) GROUP BY ALL),
dir AS (SELECT dataset, seed, 'dirichlet' AS scheme, alpha, client_id, SUM(k)::BIGINT AS n_total,
   SUM(CASE WHEN label = 1 THEN k ELSE 0 END)::BIGINT AS n_minority
  FROM (SELECT dataset, seed, alpha, client_id, label, (coalesce(floor(hi * n), n) - floor(lo * n))::BIGINT AS k
        FROM (SELECT dataset, label, COUNT(*) AS n FROM src GROUP BY ALL)
        JOIN (VALUES {_share_rows()}) s(seed, alpha, label, client_id, lo, hi) USING (label)) GROUP BY ALL),
census AS (SELECT *, 13 AS n_features, round(n_minority::DOUBLE / n_total, 9) AS minority_fraction,
  round(n_minority::DOUBLE / nullif(n_total - n_minority, 0), 9) AS local_ratio,
  round(n_minority::DOUBLE / 13, 9) AS events_per_parameter, skip_reason IS NULL AS smote_fires,
  round(CASE WHEN skip_reason IS NULL AND n_minority > 0 THEN n_synthetic::DOUBLE / n_minority ELSE 0 END, 9) AS synthesis_multiplier,
  n_minority < 10 AS flag_lt10, n_minority = 0 AS flag_zero FROM (
  SELECT *, CASE WHEN skip_reason IS NULL THEN greatest(floor(0.12::DOUBLE * (n_total - n_minority)) - n_minority, 0)::BIGINT ELSE 0 END AS n_synthetic FROM (
    SELECT *, CASE WHEN n_minority < 6 THEN 'insufficient_minority'
                   WHEN n_minority >= 0.12::DOUBLE * (n_total - n_minority) THEN 'target_met' END AS skip_reason
    FROM (SELECT * FROM iid UNION ALL SELECT * FROM dir)))),
roll AS (SELECT dataset, scheme, alpha, COUNT(*) AS n_clients, COUNT(*) FILTER (flag_lt10) AS n_lt10,
  COUNT(*) FILTER (flag_zero) AS n_zero, MIN(n_minority) AS min_minority, floor(median(n_minority))::BIGINT AS median_minority,
  MAX(n_minority) AS max_minority, MAX(synthesis_multiplier) AS worst_multiplier, COUNT(*) FILTER (smote_fires) AS n_fires,
  COUNT(*) FILTER (skip_reason = 'insufficient_minority') AS n_skip_insufficient,
  COUNT(*) FILTER (skip_reason = 'target_met') AS n_skip_target FROM census GROUP BY ALL)
"""

QUERIES = {
    "o1_smote": smote_rows,
    "o1_smote_report": lambda s, d: rounded(o.smote(members(s, d), TARGET, K, SEED)[1]),
    "o1_none_report": lambda s, d: rounded(o.oversample(members(s, d), "none", strategy=TARGET)[1]),
    "o2_adasyn": adasyn_rows,
    "o2_adasyn_report": lambda s, d: rounded(o.adasyn(members(s, d), TARGET, K, SEED)[1]),
    "o4_skip_reasons": skips,
    "o5_report_summary": lambda s, d: o.report_summary(skips(s, d)),
    "o6_pooled": pooled,
    "o6_pooled_fallback": pooled_fallback,
    "o7_noop_cells": noops,
    "o8_positive_ratio": lambda s, d: rounded(o.positive_ratio(
        o.smote(members(s, d), TARGET, K, SEED)[0], keys=["client_id"])),
    "g14_nearest_segments": segments,
    "g15_segment_statistics": segment_stats,
    "g16_majority_territory": territory,
    "g18_minority_census": lambda s, d: rounded(census_rows(s, d)),
    "g19_census_rollup": lambda s, d: rounded(c.census_rollup(census_rows(s, d))),
    "g19_exposure": lambda s, d: c.exposure(c.census_rollup(census_rows(s, d))),
}

# point-to-segment distance by list arithmetic; the first pair in (a, b) text order wins a tie
SEGMENT = SMOTE + """, pts AS (SELECT client_id, row_id, features FROM made),
seg AS (SELECT a.client_id, a.row_id::VARCHAR AS a_id, b.row_id::VARCHAR AS b_id, a.features AS av,
        list_transform(list_zip(b.features, a.features), lambda p: p[1] - p[2]) AS ab
        FROM m a JOIN m b ON a.client_id = b.client_id AND a.label = 1 AND b.label = 1 AND a.row_id::VARCHAR < b.row_id::VARCHAR),
foot AS (SELECT pts.client_id, pts.row_id AS point_id, a_id, b_id, ab,
        list_transform(list_zip(pts.features, av), lambda p: p[1] - p[2]) AS rel, list_dot_product(ab, ab) AS len
        FROM pts JOIN seg USING (client_id)),
dist AS (SELECT client_id, point_id, a_id, b_id, sqrt(list_sum(list_transform(list_zip(rel, ab),
        lambda p: (p[1] - t * p[2]) * (p[1] - t * p[2])))) AS residual
        FROM (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, list_dot_product(rel, ab) / len)) AS t FROM foot WHERE len > 0)),
hit AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY client_id, point_id ORDER BY residual, a_id, b_id) AS rk
        FROM dist) WHERE rk = 1)
"""

ORACLES = {
    "o1_smote": SMOTE + WHOLE,
    "o1_smote_report": f"WITH plan AS ({plan_sql()}) {report_sql()}",
    "o1_none_report": f"""SELECT client_id, COUNT(*) AS n_samples, COUNT(*) FILTER (label = 1) AS n_pos, FALSE AS applied,
'disabled' AS skip_reason, COUNT(*) AS n_samples_after, COUNT(*) FILTER (label = 1) AS n_pos_after,
round(COUNT(*) FILTER (label = 1)::DOUBLE / COUNT(*), 9) AS pos_ratio_after, COUNT(*) FILTER (label = 1) AS n_real_minority,
0::BIGINT AS n_synthetic, 0.0::DOUBLE AS synthesis_multiplier FROM ({MEMBERS}) GROUP BY client_id""",
    "o2_adasyn": ADASYN + WHOLE,
    "o2_adasyn_report": ADASYN + f""", final AS (SELECT p.* REPLACE (CASE WHEN p.skip_reason IS NULL AND coalesce(n, 0) = 0
  THEN 'no_candidates' ELSE p.skip_reason END AS skip_reason), coalesce(n, 0)::BIGINT AS n_made FROM plan p
  LEFT JOIN (SELECT client_id, SUM(n) AS n FROM quota GROUP BY 1) USING (client_id)) {report_sql('n_made', 'final')}""",
    "o4_skip_reasons": f"WITH plan AS ({plan_sql(0.115, BY_CUSTOMER)}) {report_sql()}",
    "o5_report_summary": f"""WITH plan AS ({plan_sql(0.115, BY_CUSTOMER)}) SELECT COUNT(*) FILTER (skip_reason IS NULL) AS n_applied,
COUNT(*) AS n_clients, COUNT(*) FILTER (skip_reason = 'insufficient_minority') AS n_insufficient_minority,
COUNT(*) FILTER (skip_reason = 'target_met') AS n_target_met, COUNT(*) FILTER (skip_reason = 'no_candidates') AS n_no_candidates,
COUNT(*) FILTER (skip_reason = 'disabled') AS n_disabled FROM plan""",
    "o6_pooled": f"""WITH plan AS ({plan_sql(source=f'SELECT * REPLACE (0 AS client_id) FROM ({MEMBERS})')})
SELECT * EXCLUDE (client_id), NULL::VARCHAR AS note FROM ({report_sql()})""",
    "o6_pooled_fallback": f"""WITH plan AS ({plan_sql(0.01, f'SELECT * REPLACE (0 AS client_id) FROM ({MEMBERS})')})
SELECT * EXCLUDE (client_id), 'trained on raw data: ' || skip_reason AS note FROM ({report_sql()})""",
    "o7_noop_cells": f"""SELECT c_nationkey, bool_and(n_pos < 6 OR n_pos >= 0.08::DOUBLE * (n - n_pos)) AS is_noop,
COUNT(*) FILTER (n_pos < 6) AS n_below_floor FROM (SELECT c_nationkey, client_id, COUNT(*) AS n, SUM(label) AS n_pos
FROM ({BY_CUSTOMER}) GROUP BY ALL) GROUP BY c_nationkey""",
    "o8_positive_ratio": f"""WITH plan AS ({plan_sql()}) SELECT client_id,
round((n_pos + n_wanted)::DOUBLE / (n_samples + n_wanted), 9) AS pos_ratio FROM plan""",
    "g14_nearest_segments": SEGMENT + "SELECT client_id, point_id, a_id, b_id, round(residual, 6) AS residual FROM hit",
    "g15_segment_statistics": SEGMENT + """, g15s AS (SELECT client_id, a_id, b_id, COUNT(*) AS n FROM hit GROUP BY ALL),
g15p AS (SELECT client_id, (COUNT(*) * (COUNT(*) - 1) // 2)::BIGINT AS n_pairs_possible FROM m WHERE label = 1 GROUP BY 1),
g15u AS (SELECT client_id, COUNT(*) AS n_segments_populated, round(AVG(n), 6) AS per_segment_mean, MAX(n) AS per_segment_max FROM g15s GROUP BY 1),
g15e AS (SELECT client_id, COUNT(DISTINCT id) AS n_distinct_seed_endpoints
      FROM (SELECT client_id, a_id AS id FROM g15s UNION ALL SELECT client_id, b_id FROM g15s) GROUP BY 1),
g15r AS (SELECT client_id, round(median(residual), 6) AS residual_median, round(quantile_cont(residual, 0.99), 6) AS residual_p99 FROM hit GROUP BY 1)
SELECT * FROM g15p LEFT JOIN g15u USING (client_id) LEFT JOIN g15e USING (client_id) LEFT JOIN g15r USING (client_id)""",
    "g16_majority_territory": SMOTE + f""", near1 AS (SELECT made.row_id, m.label,
  ROW_NUMBER() OVER (PARTITION BY made.row_id ORDER BY {DISTANCE.format(a='made.features', b='m.features')}, m.row_id::VARCHAR) AS rk1
  FROM made JOIN m ON TRUE QUALIFY rk1 = 1)
SELECT COUNT(*) AS n_synth, COUNT(*) FILTER (label = 0) AS n_nn_majority,
       round(AVG(CAST(label = 0 AS DOUBLE)), 9) AS frac_nn_majority FROM near1""",
    "g18_minority_census": CENSUS + "SELECT * FROM census",
    "g19_census_rollup": CENSUS + """SELECT *, round(n_skip_target::DOUBLE / n_clients, 9) AS target_met_share,
n_fires = 0 AS is_identity FROM roll""",
    "g19_exposure": CENSUS + "SELECT dataset, n_zero, n_lt10, n_clients, min_minority FROM roll WHERE scheme = 'dirichlet' AND alpha = 0.5",
}
