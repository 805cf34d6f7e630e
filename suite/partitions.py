"""Queries over splits, client partitions and samples: D1-D15, H2, S8."""

from __future__ import annotations

from pyspark.sql import functions as F

from rareclass.functions.hashing import partition_fingerprint
from rareclass.operators import splits as p
from suite.common import md5_rank, rounded, split_sql, table
from suite.prepare import ORDERS, orders

ALPHA, CLIENTS = 0.5, 5


def rows(spark, sf_dir):
    return orders(spark, sf_dir).select("row_id", "label")


ROWS = f"SELECT row_id, label FROM ({ORDERS})"


def assigned(spark, sf_dir):
    return p.partition_dirichlet(rows(spark, sf_dir), ALPHA, CLIENTS)


def dirichlet_sql(source: str, shares: dict, seed: int = 42) -> str:
    """Client = number of cut points at or below the zero-based rank inside the class."""
    cuts = " ".join(f"WHEN label = {c} THEN [{', '.join(repr(v) + '::DOUBLE' for v in cum)}]"
                    for c, cum in shares.items())
    return f"""SELECT * EXCLUDE (rk, nc, cuts), len(list_filter(cuts, lambda s: floor(s * nc) <= rk - 1))::INT AS client_id
FROM (SELECT *, CASE {cuts} END AS cuts, {md5_rank('row_id', seed, 'label')} AS rk,
             COUNT(*) OVER (PARTITION BY label) AS nc FROM ({source}))"""


SHARES = p.dirichlet_shares((0, 1), ALPHA, CLIENTS, 42)
ASSIGNED = dirichlet_sql(ROWS, SHARES)

IID = f"""SELECT row_id, label, CASE WHEN pos < big THEN pos // (base + 1)
  ELSE n % 5 + (pos - big) // greatest(base, 1) END::INT AS client_id
FROM (SELECT *, n // 5 AS base, (n % 5) * (n // 5 + 1) AS big FROM (
  SELECT *, {md5_rank('row_id', 42)} - 1 AS pos, COUNT(*) OVER () AS n FROM ({ROWS})))"""

COUNTS = """SELECT client_id, COUNT(*) AS n_samples, COUNT(*) FILTER (label = 1) AS n_pos,
round(COUNT(*) FILTER (label = 1)::DOUBLE / COUNT(*), 9) AS pos_ratio"""


def integrity(spark, sf_dir):
    return p.partition_integrity(assigned(spark, sf_dir), rows(spark, sf_dir))


def attached(spark, sf_dir):
    features = orders(spark, sf_dir).select("row_id", "o_totalprice")
    return p.attach_assignment(features, assigned(spark, sf_dir))


def centroids(spark, sf_dir):
    df = orders(spark, sf_dir).withColumn("days", F.col("days").cast("double"))
    return p.background_centroids(df, ["o_totalprice", "days"], 10)


def top_sql(keys: str, seed, keep: str, source: str = ROWS) -> str:
    return f"""SELECT * EXCLUDE (rk) FROM (SELECT *, {md5_rank('row_id', seed, keys)} AS rk FROM ({source}))
WHERE {keep}"""


QUERIES = {
    "d1_stratified_split": lambda s, d: p.stratified_split(rows(s, d)),
    "d2_partition_iid": lambda s, d: p.partition_iid(rows(s, d), CLIENTS),
    "d3_partition_dirichlet": assigned,
    "d5_client_counts": lambda s, d: rounded(p.client_counts(assigned(s, d), CLIENTS)),
    "d5_empty_clients": lambda s, d: rounded(p.client_counts(
        rows(s, d).where("label = 1").withColumn("client_id", (F.col("row_id") % 3).cast("int")), 6)),
    "d6_attach_assignment": attached,
    "d7_partition_integrity": integrity,
    "d8_shuffled_split": lambda s, d: p.shuffled_split(rows(s, d), 0.75),
    "d9_partition_equal": lambda s, d: p.partition_equal(rows(s, d), 7, val_ratio=0.1),
    "d10_keep_positives": lambda s, d: p.keep_positives(rows(s, d), 500),
    "d11_balanced_subsample": lambda s, d: p.balanced_subsample(rows(s, d), 3000),
    "d12_prevalence_sample": lambda s, d: p.prevalence_sample(rows(s, d), 500),
    "d13_uniform_sample": lambda s, d: p.uniform_sample(rows(s, d), 700),
    "d14_client_background": lambda s, d: p.client_background(assigned(s, d), 100),
    "d15_background_centroids": centroids,
    "h2_partition_fingerprint": lambda s, d: partition_fingerprint(assigned(s, d)),
}

LANES = ", '|', ".join(
    f"SUM(('0x' || substr(md, {1 + 8 * i}, 8))::BIGINT)::HUGEINT::VARCHAR" for i in range(4))

ORACLES = {
    "d1_stratified_split": split_sql(ROWS),
    "d2_partition_iid": IID,
    "d3_partition_dirichlet": ASSIGNED,
    "d5_client_counts": f"""{COUNTS} FROM ({ASSIGNED}) GROUP BY client_id
UNION ALL SELECT c::INT, 0, 0, 0.0::DOUBLE FROM range({CLIENTS}) t(c)
WHERE c NOT IN (SELECT client_id FROM ({ASSIGNED}))""",
    "d5_empty_clients": f"""{COUNTS} FROM (SELECT label, (row_id % 3)::INT AS client_id FROM ({ROWS}) WHERE label = 1)
GROUP BY client_id UNION ALL SELECT c::INT, 0, 0, 0.0::DOUBLE FROM range(3, 6) t(c)""",
    "d6_attach_assignment": f"""SELECT row_id, o_totalprice, client_id FROM ({ORDERS}) JOIN
(SELECT row_id, client_id FROM ({ASSIGNED})) USING (row_id)""",
    "d7_partition_integrity": f"""WITH a AS ({ASSIGNED}), r AS ({ROWS})
SELECT (SELECT COUNT(*) FROM (SELECT row_id FROM a GROUP BY row_id HAVING COUNT(*) > 1)) AS n_duplicated,
 (SELECT COUNT(*) FROM r WHERE row_id NOT IN (SELECT row_id FROM a)) AS n_missing,
 (SELECT COUNT(*) FROM a WHERE row_id NOT IN (SELECT row_id FROM r)) AS n_unknown, TRUE AS is_sound""",
    "d8_shuffled_split": f"""SELECT row_id, label, CASE WHEN rk <= floor(n * 0.75::DOUBLE) THEN 'train' ELSE 'test' END AS split
FROM (SELECT *, {md5_rank('row_id', 42)} AS rk, COUNT(*) OVER () AS n FROM ({ROWS}))""",
    "d9_partition_equal": f"""SELECT row_id, label, client_id,
CASE WHEN {md5_rank('row_id', '42-val', 'client_id')} <= floor(COUNT(*) OVER (PARTITION BY client_id) * 0.1::DOUBLE)
     THEN 'val' ELSE 'train' END AS split
FROM (SELECT row_id, label, least((rk - 1) // greatest(n // 7, 1), 6)::INT AS client_id FROM (
  SELECT *, {md5_rank('row_id', 42)} AS rk, COUNT(*) OVER () AS n FROM ({ROWS})))""",
    "d10_keep_positives": top_sql("label", 42, "label = 1 OR rk <= 500"),
    "d11_balanced_subsample": top_sql("label", 42, f"rk <= least(3000, (SELECT SUM(label) FROM ({ROWS})))"),
    "d12_prevalence_sample": top_sql("label", 42, f"""rk <= CASE WHEN label = 1 THEN
  greatest(1, round_even(500 * (SELECT AVG(label::DOUBLE) FROM ({ROWS})), 0))
  ELSE 500 - greatest(1, round_even(500 * (SELECT AVG(label::DOUBLE) FROM ({ROWS})), 0)) END"""),
    "d13_uniform_sample": top_sql("", 42, "rk <= 700"),
    "d14_client_background": top_sql("client_id", 43, "rk <= 100", ASSIGNED),
    "h2_partition_fingerprint": f"""SELECT SUM(n)::BIGINT AS n_rows,
  sha256(string_agg(len(client_id::VARCHAR) || ':' || client_id || ':' || h, '|' ORDER BY client_id)) AS partition_hash
FROM (SELECT client_id, COUNT(*) AS n, sha256(concat('13:row_id bigint|', COUNT(*), '|', {LANES})) AS h
      FROM (SELECT client_id, md5(len(row_id::VARCHAR) || ':' || row_id) AS md FROM ({ASSIGNED})) GROUP BY client_id)""",
}
