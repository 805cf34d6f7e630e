"""Queries over projections, encodings and train-only statistics: P1-P13, T1-T4, H1, S1-S3 shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from rareclass.functions.hashing import dataset_fingerprint
from rareclass.operators import features as f
from rareclass.operators.splits import stratified_split
from suite.common import rounded, split_sql, table

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")  # one value left out: it encodes to zeros
PRIORITY = {"o_orderpriority": PRIORITIES}
RECIPE = f.Recipe(label="label", drop=("o_custkey",), side=("o_orderstatus",), sentinels=("days",),
                  categories=PRIORITY)


def orders(spark, sf_dir):
    """Orders with a rare label and a day count whose -1 stands for a missing value."""
    o = table(spark, sf_dir, "orders")
    days = F.datediff("o_orderdate", F.lit("1995-01-01").cast("date"))
    return o.select(
        F.col("o_orderkey").alias("row_id"), "o_custkey", "o_orderstatus", "o_totalprice",
        F.when(days % 7 == 0, -1).otherwise(days).alias("days"), "o_orderpriority",
        (F.col("o_totalprice") > 450000).cast("int").alias("label"))


ORDERS = """
SELECT o_orderkey AS row_id, o_custkey, o_orderstatus, o_totalprice,
       CASE WHEN datediff('day', DATE '1995-01-01', o_orderdate::DATE) % 7 = 0 THEN -1
            ELSE datediff('day', DATE '1995-01-01', o_orderdate::DATE) END AS days, o_orderpriority,
       CAST(o_totalprice > 450000 AS INT) AS label FROM orders"""

HOT_SQL = ", ".join(
    f"""coalesce(CAST(o_orderpriority = '{p}' AS DOUBLE), 0) AS "o_orderpriority_{p}" """ for p in PRIORITIES)


def split_orders(spark, sf_dir):
    return stratified_split(orders(spark, sf_dir), "row_id", "label", 42)


def features(spark, sf_dir):
    df = f.feature_frame(orders(spark, sf_dir), RECIPE)
    return df.select(*[F.col(c).cast("double").alias(c) if t == "float" else F.col(c) for c, t in df.dtypes])


def balance(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return rounded(f.balance_errors(li, "l_extendedprice", "l_quantity", "l_tax", "l_discount", "l_quantity")
                   .groupBy("l_returnflag").agg(F.avg("errorBalanceOrig").alias("orig"),
                                                F.avg("errorBalanceDest").alias("dest")), 5)


def imputed(spark, sf_dir):
    df = f.flag_sentinels(split_orders(spark, sf_dir).withColumn("days", F.col("days").cast("double")), ["days"])
    return f.impute_medians(df, ["days"]).select("row_id", "split", "days", "days_missing")


def scaled(columns):
    def run(spark, sf_dir):
        df = split_orders(spark, sf_dir).withColumn("days", F.col("days").cast("double")).withColumn("one", F.lit(3.0))
        return rounded(f.standard_scale(df, columns).select("row_id", "split", "o_totalprice", "days", "one"))
    return run


def scaled_sql(columns):
    def cell(c, expr):
        if c not in columns:
            return f"round({expr}, 9) AS {c}"
        return f"""round(({expr} - (SELECT avg({expr}) FROM s WHERE split = 'train')) /
 (SELECT CASE WHEN stddev_pop({expr}) = 0 THEN 1 ELSE stddev_pop({expr}) END FROM s WHERE split = 'train'), 9) AS {c}"""
    return f"""WITH s AS ({split_sql(ORDERS)})
SELECT row_id, split, {cell('o_totalprice', 'o_totalprice')}, {cell('days', 'days::DOUBLE')}, {cell('one', '3.0::DOUBLE')}
FROM s"""


def target(spark, sf_dir):
    left, right = f.split_target(orders(spark, sf_dir), "label")
    return left.select("row_id", "o_totalprice").join(right, "row_id")


def remapped(spark, sf_dir):
    df = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 2 - 1).alias("label"))
    return f.remap_labels(df)


def narrowed(spark, sf_dir):
    df = f.narrow(orders(spark, sf_dir), ["o_totalprice", "days"])
    return df.select("row_id", F.col("o_totalprice").cast("double").alias("o_totalprice"),
                     F.col("days").cast("double").alias("days"), "label")


def axes(spark, sf_dir):
    df = split_orders(spark, sf_dir).withColumn("days", F.col("days").cast("double"))
    wide = f.one_hot(df, PRIORITY)
    cols = ["o_totalprice", "days", *[f"o_orderpriority_{p}" for p in PRIORITIES]]
    return f.pca_projection(f.standard_scale(wide, cols), cols)


def fingerprint(spark, sf_dir):
    """Orders, with separators, quotes, NULL and the text \\N in some cells."""
    return dataset_fingerprint(table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.expr(ODD_STATUS).alias("o_orderstatus"), "o_orderpriority"),
        ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


def confusable(spark, sf_dir):
    """Pairs of one-row tables that differ only in where separators, NULL or quotes stand: their hashes must differ."""
    orders_ = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    cells = {"cut_early": (F.concat("s", F.lit("|x")), F.lit("y")), "cut_late": (F.col("s"), F.lit("x|y")),
             "null": (F.col("s"), F.lit(None).cast("string")), "text_null": (F.col("s"), F.lit("\\N")), "empty": (F.col("s"), F.lit("")),
             "quoted": (F.concat(F.lit('"'), "s", F.lit('"')), F.lit(""))}
    all_ = [orders_.select("k", F.lit(n).alias("kind"), a.alias("a"), b.alias("b")) for n, (a, b) in cells.items()]
    stacked = all_[0]
    for part in all_[1:]:
        stacked = stacked.unionByName(part)
    return dataset_fingerprint(stacked, ["a", "b"], ["k", "kind"]).groupBy("k").agg(F.count_distinct("data_hash").alias("n_hashes"))


ODD_STATUS = """CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN o_orderstatus || '|' || o_orderpriority
 WHEN 3 THEN '"' || o_orderstatus || ':' ELSE o_orderstatus END"""

QUERIES = {
    "p1_drop_columns": lambda s, d: f.drop_columns(table(s, d, "customer"), ["c_name", "c_nationkey"]),
    "p2_balance_errors": balance,
    "p3_one_hot": lambda s, d: f.one_hot(orders(s, d).select("row_id", "o_orderpriority"), PRIORITY),
    "p4_flag_sentinels": lambda s, d: f.flag_sentinels(
        orders(s, d).select("row_id", F.col("days").cast("double").alias("days")), ["days"]),
    "p4_signed_column_kept": lambda s, d: table(s, d, "customer").groupBy("c_mktsegment").agg(
        F.count_if(F.col("c_acctbal") < 0).alias("n_negative"), F.count("c_acctbal").alias("n_kept")),
    "p5_p6_feature_frame": features,
    "p7_narrow": narrowed,
    "p8_split_target": target,
    "p9_remap_labels": remapped,
    "p11_keep_class": lambda s, d: f.keep_class(orders(s, d), 1).select("row_id", "o_totalprice"),
    "p13_split_summary": lambda s, d: rounded(f.split_summary(split_orders(s, d))),
    "t1_impute_medians": imputed,
    "t2_standard_scale": scaled(["o_totalprice", "days", "one"]),
    "t3_standard_scale_named": scaled(["o_totalprice"]),
    "t4_pca_projection": axes,
    "h1_dataset_fingerprint": fingerprint,
    "h1_confusable_rows": confusable,
}

CELLS = ", ".join(f"coalesce(len({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
                  for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))
LANES = ", '|', ".join(
    f"SUM(('0x' || substr(md, {1 + 8 * i}, 8))::BIGINT)::HUGEINT::VARCHAR" for i in range(4))

ORACLES = {
    "p1_drop_columns": "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer",
    "p2_balance_errors": """SELECT l_returnflag, round(avg(l_tax - l_quantity + l_extendedprice), 5) AS orig,
round(avg(l_discount + l_extendedprice - l_quantity), 5) AS dest FROM lineitem GROUP BY l_returnflag""",
    "p3_one_hot": f"SELECT o_orderkey AS row_id, {HOT_SQL} FROM orders",
    "p4_flag_sentinels": f"""SELECT row_id, CASE WHEN days <> -1 THEN days::DOUBLE END AS days,
CAST(days = -1 AS DOUBLE) AS days_missing FROM ({ORDERS})""",
    "p4_signed_column_kept": """SELECT c_mktsegment, COUNT(*) FILTER (c_acctbal < 0) AS n_negative,
COUNT(c_acctbal) AS n_kept FROM customer GROUP BY c_mktsegment""",
    "p5_p6_feature_frame": f"""SELECT row_id, o_orderstatus, label, o_totalprice::FLOAT::DOUBLE AS o_totalprice,
CASE WHEN days <> -1 THEN days::DOUBLE END AS days, CAST(days = -1 AS DOUBLE) AS days_missing, {HOT_SQL} FROM ({ORDERS})""",
    "p7_narrow": f"SELECT row_id, o_totalprice::FLOAT::DOUBLE AS o_totalprice, days::DOUBLE AS days, label FROM ({ORDERS})",
    "p8_split_target": f"SELECT row_id, o_totalprice, label FROM ({ORDERS})",
    "p9_remap_labels": "SELECT doc_id, CASE WHEN quality * 2 - 1 = -1 THEN 0 ELSE quality * 2 - 1 END AS label FROM labels",
    "p11_keep_class": f"SELECT row_id, o_totalprice FROM ({ORDERS}) WHERE label = 1",
    "p13_split_summary": f"""SELECT split, COUNT(*) AS n_rows, SUM(label)::BIGINT AS n_pos,
round(AVG(label::DOUBLE) * 100, 9) AS pos_pct FROM ({split_sql(ORDERS)}) GROUP BY split""",
    "t1_impute_medians": f"""WITH s AS ({split_sql(ORDERS)})
SELECT row_id, split, CASE WHEN days <> -1 THEN days::DOUBLE ELSE
 (SELECT median(days::DOUBLE) FROM s WHERE split = 'train' AND days <> -1) END AS days,
 CAST(days = -1 AS DOUBLE) AS days_missing FROM s""",
    "t2_standard_scale": scaled_sql(["o_totalprice", "days", "one"]),
    "t3_standard_scale_named": scaled_sql(["o_totalprice"]),
    "h1_dataset_fingerprint": f"""SELECT n_rows, sha256(concat(
'78:o_orderkey bigint,o_custkey bigint,o_orderstatus string,o_orderpriority string|', n_rows, '|', lanes)) AS data_hash
FROM (SELECT COUNT(*) AS n_rows, concat({LANES}) AS lanes FROM (SELECT md5(concat({CELLS})) AS md
  FROM (SELECT * REPLACE ({ODD_STATUS} AS o_orderstatus) FROM orders)))""",
    "h1_confusable_rows": "SELECT o_orderkey AS k, 6 AS n_hashes FROM orders GROUP BY 1",
}
