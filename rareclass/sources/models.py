"""Stored models with what is needed to trust them again."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rareclass.functions.ranks import null_safe_join

REQUIRED_KEYS = ("model_kind", "data_hash", "feature_names_n")
RTOL, ATOL = 1e-5, 1e-6


def save_model(model: PipelineModel, path: str, spark: SparkSession, model_kind: str, data_hash: str, features: list[str],
               **extra) -> None:
    """The fitted pipeline (its scaler is one of its stages), feature names and a manifest, written last."""
    model.write().overwrite().save(f"{path}/model")
    body = {"model_kind": model_kind, "data_hash": data_hash, "feature_names_n": len(features), "feature_names": features, **extra}
    spark.createDataFrame([(json.dumps(body, sort_keys=True),)], "body string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest if it is there and has the required keys."""
    try:
        row = spark.read.schema("body string").json(f"{path}/manifest").first()
        body = json.loads(row["body"])
    except (AnalysisException, TypeError, ValueError):
        return None
    return body if set(REQUIRED_KEYS) <= set(body) else None


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    body = manifest(spark, path)
    if body is None:
        raise FileNotFoundError(f"no complete manifest at {path}")
    return PipelineModel.load(f"{path}/model"), body


def compare_predictions(a: DataFrame, b: DataFrame, id_col: str = "row_id", score: str = "score",
                        rtol: float = RTOL, atol: float = ATOL) -> DataFrame:
    """Are two prediction tables identical, or equal within ``atol + rtol * |b|``; ids on one side only fail both."""
    left = a.select(F.col(id_col), F.col(score).alias("_a"))
    right = b.select(F.col(id_col), F.col(score).alias("_b"))
    both = left.join(right, id_col, "full")
    gap = F.abs(F.col("_a") - F.col("_b"))
    close = F.coalesce(gap <= F.lit(atol) + F.lit(rtol) * F.abs(F.col("_b")), F.lit(False))
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.max(gap).alias("max_difference"),
                    F.bool_and(F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))).alias("identical"),
                    F.bool_and(close).alias("within_tolerance"))
