"""Prepared splits and client assignments kept under content-addressed folders."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rareclass.functions.hashing import dataset_fingerprint, partition_fingerprint
from rareclass.operators.features import feature_frame, feature_names, impute_medians, standard_scale
from rareclass.operators.splits import client_counts, stratified_split


def config_key(config: dict) -> str:
    """A short hash of a resolved configuration; any changed setting gives another key."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]


def _manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest row of a finished folder; it is written last, so an unfinished one has none."""
    try:
        row = spark.read.schema("body string").json(f"{path}/manifest").first()
    except AnalysisException:
        return None
    return None if row is None else json.loads(row["body"])


def _finish(spark: SparkSession, path: str, body: dict) -> None:
    spark.createDataFrame([(json.dumps(body, sort_keys=True),)], "body string").coalesce(1).write.mode(
        "overwrite").json(f"{path}/manifest")


def prepare(raw: DataFrame, recipe, seed: int = 42, id_col: str = "row_id") -> DataFrame:
    """Raw labelled rows -> features with exact split, training medians and training scale."""
    names = feature_names(raw, recipe, (id_col,))
    split = stratified_split(feature_frame(raw, recipe, (id_col,)), id_col, "label", seed)
    filled = impute_medians(split, recipe.sentinels) if recipe.sentinels else split
    return standard_scale(filled, list(recipe.scale) if recipe.scale is not None else names)


def stored_split(spark: SparkSession, root: str, config: dict, build: Callable[[], DataFrame],
                 label: str = "label") -> tuple[DataFrame, str]:
    """The prepared table of ``config``, built once, and its data hash.

    Reading back refuses a table whose column types differ from those written.
    """
    path = f"{root}/prepared/{config_key(config)}"
    manifest = _manifest(spark, path)
    if manifest is None:
        df = build()
        df.write.mode("overwrite").partitionBy("split").parquet(f"{path}/data")
        columns = sorted(c for c in df.columns if c != "split")
        stored = spark.read.parquet(f"{path}/data")
        digest = dataset_fingerprint(stored, [*columns, "split"]).first()["data_hash"]
        manifest = {"config": config, "data_hash": digest, "types": {c: t for c, t in df.dtypes}}
        _finish(spark, path, manifest)
    stored = spark.read.parquet(f"{path}/data")
    if dict(stored.dtypes) != manifest["types"]:
        raise TypeError(f"stored column types changed: {dict(stored.dtypes)} != {manifest['types']}")
    return stored, manifest["data_hash"]


def stored_assignment(spark: SparkSession, root: str, config: dict, build: Callable[[], DataFrame],
                      id_col: str = "row_id", label: str = "label") -> tuple[DataFrame, str]:
    """The client assignment of ``config`` with its hash; sizes per client go beside it."""
    if config.get("condition") == "centralized":
        raise ValueError("a pooled run has no client assignment")
    path = f"{root}/assignment/{config_key(config)}"
    manifest = _manifest(spark, path)
    if manifest is None:
        rows = build()
        rows.select(id_col, "client_id").write.mode("overwrite").parquet(f"{path}/data")
        client_counts(rows, label=label).write.mode("overwrite").parquet(f"{path}/sizes")
        stored = spark.read.parquet(f"{path}/data")
        digest = partition_fingerprint(stored.withColumnRenamed(id_col, "row_id")).first()["partition_hash"]
        manifest = {"config": config, "partition_hash": digest}
        _finish(spark, path, manifest)
    return spark.read.parquet(f"{path}/data"), manifest["partition_hash"]


def stored_sizes(spark: SparkSession, root: str, config: dict) -> DataFrame:
    """Client sizes from the small table beside the assignment; counted from the rows if it is missing."""
    path = f"{root}/assignment/{config_key(config)}"
    try:
        return spark.read.parquet(f"{path}/sizes")
    except AnalysisException:
        return spark.read.parquet(f"{path}/data").groupBy("client_id").agg(F.count(F.lit(1)).alias("n_samples"))
