"""Tables and SQL fragments shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored(spark: SparkSession, sf_dir: str, label: str = "quality") -> DataFrame:
    """Labelled documents scored by shortness: (row_id, label, score, lang, source)."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("label"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("row_id"), "label",
        (-F.col("n_chars").cast("double")).alias("score"), "lang", "source")


SCORED = """
SELECT l.doc_id AS row_id, l.quality AS label, -CAST(d.n_chars AS DOUBLE) AS score, d.lang, d.source
FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""

TOXIC = SCORED.replace("l.quality", "l.toxic")


def returned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines: returned or not, scored by discount (11 values, so heavily tied)."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.col("l_discount").alias("score"), "l_linestatus")


RETURNED = """
SELECT CAST(l_returnflag = 'R' AS INT) AS label, l_discount AS score, l_linestatus FROM lineitem"""


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines with a probability-like score made of discount and tax."""
    p = F.lit(0.2) + F.col("l_discount") * 2.0 + F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"), p.alias("score"), "l_linestatus")


PROBABILITIES = """
SELECT CAST(l_returnflag = 'R' AS INT) AS label, 0.2::DOUBLE + l_discount * 2.0::DOUBLE + l_tax AS score,
       l_linestatus FROM lineitem"""


def curve_sql(source: str, keys: str) -> str:
    """CTEs ``src, at_score, curve``: running counts over distinct scores, from the highest down."""
    return f"""src AS ({source}),
at_score AS (
  SELECT {keys}, score, CAST(SUM(label) AS BIGINT) AS tp_at, COUNT(*) AS n_at
  FROM src GROUP BY {keys}, score),
curve AS (
  SELECT *, n_at - tp_at AS fp_at, n - tp AS fp, n_all - n_pos AS n_neg FROM (
    SELECT *, CAST(SUM(tp_at) OVER up AS BIGINT) AS tp, CAST(SUM(n_at) OVER up AS BIGINT) AS n,
           CAST(SUM(tp_at) OVER g AS BIGINT) AS n_pos, CAST(SUM(n_at) OVER g AS BIGINT) AS n_all
    FROM at_score
    WINDOW g AS (PARTITION BY {keys}),
           up AS (PARTITION BY {keys} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)))"""


def md5_rank(id_expr: str, seed, keys: str = "") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    return f"ROW_NUMBER() OVER ({part}ORDER BY md5('{seed}:' || {id_expr}), {id_expr})"


def md5_uniform(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def split_case(rank: str, n: str) -> str:
    return (f"CASE WHEN {rank} <= round({n} * 0.70::DOUBLE) THEN 'train' "
            f"WHEN {rank} <= round({n} * 0.85::DOUBLE) THEN 'val' ELSE 'test' END")


def split_sql(source: str, seed: int = 42) -> str:
    """``source`` plus the stratified split column."""
    return f"""SELECT * EXCLUDE (rk, nc), {split_case('rk', 'nc')} AS split FROM (
  SELECT *, {md5_rank('row_id', seed, 'label')} AS rk, COUNT(*) OVER (PARTITION BY label) AS nc
  FROM ({source}))"""


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded so that summation order does not show."""
    return df.select(*[
        (F.round(c, digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c)
        for c, t in df.dtypes])
