"""Raw tables: explicit schemas, stable row ids and the prepared feature frame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rareclass.functions.hashing import row_digest
from rareclass.functions.ranks import shuffle_width
from rareclass.operators.features import Recipe, balance_errors, feature_frame

# ---- fixed values of the public datasets: columns, category lists, sentinel columns ----
PAYSIM_COLUMNS = (
    ("step", "int"), ("type", "string"), ("amount", "double"), ("nameOrig", "string"),
    ("oldbalanceOrg", "double"), ("newbalanceOrig", "double"), ("nameDest", "string"),
    ("oldbalanceDest", "double"), ("newbalanceDest", "double"), ("isFraud", "int"),
    ("isFlaggedFraud", "int"),
)
PAYSIM_TYPES = ("CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER")
CREDITCARD_COLUMNS = (
    ("Time", "double"), *[(f"V{i}", "double") for i in range(1, 29)], ("Amount", "double"), ("Class", "int"),
)
BAF_COLUMNS = (
    ("fraud_bool", "int"), ("income", "double"), ("name_email_similarity", "double"),
    ("prev_address_months_count", "int"), ("current_address_months_count", "int"),
    ("customer_age", "int"), ("days_since_request", "double"), ("intended_balcon_amount", "double"),
    ("payment_type", "string"), ("zip_count_4w", "int"), ("velocity_6h", "double"),
    ("velocity_24h", "double"), ("velocity_4w", "double"), ("bank_branch_count_8w", "int"),
    ("date_of_birth_distinct_emails_4w", "int"), ("employment_status", "string"),
    ("credit_risk_score", "int"), ("email_is_free", "int"), ("housing_status", "string"),
    ("phone_home_valid", "int"), ("phone_mobile_valid", "int"), ("bank_months_count", "int"),
    ("has_other_cards", "int"), ("proposed_credit_limit", "double"), ("foreign_request", "int"),
    ("source", "string"), ("session_length_in_minutes", "double"), ("device_os", "string"),
    ("keep_alive_session", "int"), ("device_distinct_emails_8w", "int"),
    ("device_fraud_count", "int"), ("month", "int"),
)
BAF_SENTINELS = ("prev_address_months_count", "bank_months_count", "current_address_months_count",
                 "session_length_in_minutes", "device_distinct_emails_8w")
BAF_CATEGORIES = {
    "payment_type": ("AA", "AB", "AC", "AD", "AE"),
    "employment_status": ("CA", "CB", "CC", "CD", "CE", "CF", "CG"),
    "housing_status": ("BA", "BB", "BC", "BD", "BE", "BF", "BG"),
    "source": ("INTERNET", "TELEAPP"),
    "device_os": ("linux", "macintosh", "other", "windows", "x11"),
}
# ---- end of fixed values ----


@dataclass(frozen=True)
class Dataset:
    name: str
    columns: tuple
    recipe: Recipe

    @property
    def schema(self) -> T.StructType:
        return T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in self.columns))


DATASETS = {
    "paysim": Dataset("paysim", PAYSIM_COLUMNS, Recipe(
        label="isFraud", drop=("nameOrig", "nameDest", "isFlaggedFraud"), categories={"type": PAYSIM_TYPES})),
    "creditcard": Dataset("creditcard", CREDITCARD_COLUMNS, Recipe(label="Class", scale=("Time", "Amount"))),
    "baf": Dataset("baf", BAF_COLUMNS, Recipe(
        label="fraud_bool", drop=("device_fraud_count",), side=("month",), sentinels=BAF_SENTINELS,
        categories=BAF_CATEGORIES)),
}


def dataset(name: str) -> Dataset:
    if name not in DATASETS:
        raise ValueError(f"unknown dataset {name!r}: expected one of {sorted(DATASETS)}")
    return DATASETS[name]


def read_raw(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A raw CSV with its explicit schema; a header that does not match is an error."""
    return (spark.read.schema(dataset(name).schema).option("header", True)
            .option("enforceSchema", False).option("mode", "FAILFAST").csv(path))


def with_row_id(df: DataFrame, out: str = "row_id", chunk: int = 10_000) -> DataFrame:
    """A reproducible id: hash of the row, plus an ordinal among exact duplicates.

    Copies are merged map-side into one row with a count and written out again as numbered copies in
    chunks spread over the tasks, so many copies of one row neither share a task nor change the ids.
    """
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_d", row_digest(df.columns))
    chunks = counted.withColumn("_c", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / chunk))))
    spread = chunks.repartition(shuffle_width(df), "_d", "_c")
    last = F.least(F.col("_n"), (F.col("_c") + 1) * chunk)
    numbered = spread.withColumn("_i", F.explode(F.sequence(F.col("_c") * chunk + 1, last)))
    return numbered.select(F.concat_ws("-", "_d", "_i").alias(out), *df.columns)


def raw_features(df: DataFrame, name: str, id_cols=("row_id",)) -> DataFrame:
    """Raw rows -> ids, side columns, label and the fixed float feature columns."""
    spec = dataset(name)
    if name == "paysim":
        df = balance_errors(df, "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest")
    return feature_frame(df, spec.recipe, id_cols)


def read_libsvm(spark: SparkSession, paths: list[str], n_features: int | None = None) -> DataFrame:
    """LibSVM files stacked; the width is given or comes from the first file."""
    if n_features is None:
        first = spark.read.format("libsvm").load(paths[0]).schema["features"]
        n_features = int(first.metadata["numFeatures"])
    return spark.read.format("libsvm").option("numFeatures", str(n_features)).load(paths)
