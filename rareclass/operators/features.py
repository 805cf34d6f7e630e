"""Projection, encoding and train-only statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rareclass.functions.ranks import exact_quantiles


@dataclass(frozen=True)
class Recipe:
    """How a raw table becomes features: what to drop, flag, encode, scale and hold out."""

    label: str
    drop: tuple[str, ...] = ()
    side: tuple[str, ...] = ()
    sentinels: tuple[str, ...] = ()
    categories: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    scale: tuple[str, ...] | None = None  # None scales every feature


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop identifier or constant columns."""
    return df.drop(*columns)


def balance_errors(df: DataFrame, amount: str, old_from: str, new_from: str, old_to: str,
                   new_to: str, names: tuple[str, str] = ("errorBalanceOrig", "errorBalanceDest")) -> DataFrame:
    """How far two account balances are from what the amount explains."""
    return df.withColumns({
        names[0]: F.col(new_from) - F.col(old_from) + F.col(amount),
        names[1]: F.col(old_to) + F.col(amount) - F.col(new_to),
    })


def one_hot_columns(column: str, categories: Sequence[str]) -> list[Column]:
    """One indicator per listed category; a value outside the list gives all zeros."""
    return [F.coalesce((F.col(column) == F.lit(c)).cast("double"), F.lit(0.0)).alias(f"{column}_{c}")
            for c in categories]


def one_hot(df: DataFrame, categories: Mapping[str, Sequence[str]]) -> DataFrame:
    """P3 on a table: the encoded columns are replaced by their indicators."""
    encoded = [c for column, values in categories.items() for c in one_hot_columns(column, values)]
    return df.select(*[c for c in df.columns if c not in categories], *encoded)


def flag_sentinels(df: DataFrame, columns: Sequence[str], sentinel: float = -1) -> DataFrame:
    """``<col>_missing`` flag plus NULL where the sentinel stood; other columns keep theirs."""
    return df.withColumns({
        **{f"{c}_missing": F.coalesce((F.col(c) == sentinel).cast("double"), F.lit(0.0)) for c in columns},
        **{c: F.when(F.col(c) != sentinel, F.col(c)) for c in columns},
    })


def feature_frame(df: DataFrame, recipe: Recipe, id_cols: Sequence[str] = ("row_id",)) -> DataFrame:
    """Ids, side columns, int label, then float features: numeric, flags, indicators."""
    held = {recipe.label, *recipe.drop, *recipe.side, *id_cols, *recipe.categories}
    numeric = [c for c in df.columns if c not in held]
    flagged = flag_sentinels(df, recipe.sentinels) if recipe.sentinels else df
    flags = [f"{c}_missing" for c in recipe.sentinels]
    hot = [c for column, values in recipe.categories.items() for c in one_hot_columns(column, values)]
    return flagged.select(
        *id_cols, *recipe.side, F.col(recipe.label).cast("int").alias("label"),
        *[F.col(c).cast("float").alias(c) for c in [*numeric, *flags]],
        *[c.cast("float") for c in hot],
    )


def feature_names(df: DataFrame, recipe: Recipe, id_cols: Sequence[str] = ("row_id",)) -> list[str]:
    """The fixed feature order of :func:`feature_frame`."""
    held = {recipe.label, *recipe.drop, *recipe.side, *id_cols, *recipe.categories}
    return [*[c for c in df.columns if c not in held], *[f"{c}_missing" for c in recipe.sentinels],
            *[f"{c}_{v}" for c, values in recipe.categories.items() for v in values]]


def narrow(df: DataFrame, floats: Sequence[str], ints: Sequence[str] = ("label",)) -> DataFrame:
    """Float features, int labels; done before any statistic is fitted."""
    return df.withColumns({**{c: F.col(c).cast("float") for c in floats},
                           **{c: F.col(c).cast("int") for c in ints}})


def split_target(df: DataFrame, label: str, id_cols: Sequence[str] = ("row_id",)) -> tuple[DataFrame, DataFrame]:
    """(features, target), both keyed by the id columns."""
    return df.drop(label), df.select(*id_cols, label)


def remap_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Labels -1/1 become 0/1."""
    return df.withColumn(label, F.when(F.col(label) == -1, 0).otherwise(F.col(label)))


def keep_class(df: DataFrame, value: int, label: str = "label") -> DataFrame:
    """Rows of one class."""
    return df.where(F.col(label) == value)


def split_summary(df: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    """Rows, positives and positive percentage per split."""
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col(label).cast("bigint")).alias("n_pos"),
        (F.avg(F.col(label).cast("double")) * 100).alias("pos_pct"))


def unpivot(df: DataFrame, features: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """Long form (ids, feature, value), values as double."""
    return df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        list(ids), list(features), "feature", "value")


def train_medians(df: DataFrame, columns: Sequence[str], split: str = "split") -> dict[str, float]:
    """Exact interpolated medians of the training rows; one number per column reaches the driver."""
    long = unpivot(df.where(F.col(split) == "train"), columns)
    rows = exact_quantiles(long, "value", {"median": 0.5}, ["feature"]).collect()
    return {r["feature"]: r["median"] for r in rows}


def impute_medians(df: DataFrame, columns: Sequence[str], split: str = "split") -> DataFrame:
    """NULLs of every split filled with the training median."""
    medians = train_medians(df, columns, split)
    types = dict(df.dtypes)
    return df.withColumns({
        c: F.coalesce(F.col(c), F.lit(medians.get(c)).cast(types[c])) for c in columns})


def standard_scale(df: DataFrame, columns: Sequence[str], split: str = "split") -> DataFrame:
    """Centre and scale the named columns by the training mean and population deviation.

    A constant column is only centred. The statistics are one row of a single aggregate.
    """
    stats = df.where(F.col(split) == "train").agg(
        *[F.avg(F.col(c).cast("double")).alias(f"m_{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{i}") for i, c in enumerate(columns)]).first()
    types = dict(df.dtypes)
    scaled = {}
    for i, c in enumerate(columns):
        mean, std = stats[f"m_{i}"], stats[f"s_{i}"]
        scaled[c] = ((F.col(c).cast("double") - F.lit(mean)) / F.lit(std if std else 1.0)).cast(types[c])
    return df.withColumns(scaled)


def top_features(univariate: DataFrame, m: int) -> list[str]:
    """P10: names of the ``m`` features with the highest univariate AUC."""
    return [r["feature"] for r in univariate.orderBy(F.desc("auc"), "feature").limit(m).collect()]


def pca_projection(df: DataFrame, features: Sequence[str], k: int = 2, split: str = "split",
                   keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """T4: principal axes fitted once on centred training rows, then applied to every row."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    vectors = VectorAssembler(inputCols=list(features), outputCol="_v").transform(df)
    train = vectors.where(F.col(split) == "train")
    centre = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(train)
    axes = PCA(k=k, inputCol="_c", outputCol="_p").fit(centre.transform(train))
    projected = axes.transform(centre.transform(vectors)).withColumn("_p", vector_to_array("_p"))
    return projected.select(*keep, split, *[F.col("_p")[i].alias(f"pc{i + 1}") for i in range(k)])
