"""Stock models per client or pooled (R18, R25, R26); boosted ones come from :mod:`rareclass.operators.boosting`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rareclass.operators import metrics as m
from rareclass.operators.boosting import Settings, fit_forest, margins_of_clients, prefix_counts, stacked_kinds, tree_margins
from rareclass.operators.groupfit import fit_clients, truncate_margins
from rareclass.session import cut_lineage

# fixed values: the published study's tree settings
TREE_ROUNDS, TREE_RATE, TREE_DEPTH = 100, 0.1, 6
STACK_TREES, STACK_SUBSAMPLE = 50, 0.8


def with_vector(df: DataFrame, vec: str = "features") -> DataFrame:
    return df.withColumn("_vec", array_to_vector(F.col(vec).cast("array<double>")))


def booster(iterations: int = TREE_ROUNDS, rate: float = TREE_RATE, depth: int = TREE_DEPTH, subsample: float = 1.0, seed: int = 42,
            **more) -> Settings:
    return Settings(iterations, rate, depth, subsample, seed, **more)


def fit_boosters(df: DataFrame, client: str = "client_id", vec: str = "features", label: str = "label", row_id: str | None = None,
                 task_cells: int = 1 << 22, **settings) -> DataFrame:
    """The trees of every client from scratch; one-class clients have none. Any number of clients takes the jobs of one."""
    return fit_forest(df, client, vec, label, row_id, booster(**settings), task_cells)


def margin_scores(model, df: DataFrame, vec: str = "features", out: str = "score", probability: bool = True) -> DataFrame:
    """Batch scoring by a fitted model: positive-class probability, or the raw margin."""
    source = "probability" if probability and model.hasParam("probabilityCol") else "rawPrediction"
    scored = model.transform(with_vector(df, vec))
    return scored.withColumn(out, vector_to_array(source)[1]).select(*df.columns, out)


def fit_pooled(df: DataFrame, vec: str = "features", label: str = "label", c: float = 1.0):
    """A pooled logistic model by Spark ML, to be stored and scored in batches.

    The penalty is given per summed loss (C), Spark's per mean loss: 1 / (C * n).
    """
    train = with_vector(df, vec)
    reg = 1.0 / (c * max(df.count(), 1))
    return LogisticRegression(featuresCol="_vec", labelCol=label, regParam=reg, standardization=False, maxIter=1000).fit(train)


def best_prefix(forest: DataFrame, val: DataFrame, vec: str = "features", label: str = "label", client: str = "client_id") -> DataFrame:
    """R13 for fitted boosters: (client, prefix, auprc), the number of trees with the best average precision on ``val``, fewer on ties.

    Rows of one class only leave the full number and 0.0.
    """
    counts = cut_lineage(prefix_counts(forest, val, client, vec, label))
    ap = m.precision_of_curve(m.curve_of_counts(counts, [client, "prefix"]), [client, "prefix"])
    two = counts.where("prefix = 1").groupBy(client).agg(((F.sum("tp_at") > 0) & (F.sum("tp_at") < F.sum("n_at"))).alias("_two"))
    best = ap.groupBy(client).agg(F.max(F.struct("auprc", (-F.col("prefix")).alias("neg"))).alias("_b"), F.max("prefix").alias("_full"))
    return best.join(two, client).select(client, F.when(F.col("_two"), -F.col("_b.neg")).otherwise(F.col("_full")).alias("prefix"),
                                         F.when(F.col("_two"), F.col("_b.auprc")).otherwise(F.lit(0.0)).alias("auprc"))


def prefix_probability(forest: DataFrame, client: object, df: DataFrame, prefix: int, column: str = "client_id", vec: str = "features",
                       out: str = "score") -> DataFrame:
    """The probability that the first ``prefix`` trees of a client give."""
    margins = truncate_margins(tree_margins(forest, [client], df, prefix, column, vec), prefix, out="_margin")
    return margins.withColumn(out, 1.0 / (1.0 + F.exp(-F.col("_margin")))).drop("_margin", "margins")


def pooled_baseline(df: DataFrame, model: str, split: str = "split", vec: str = "features", label: str = "label",
                    **settings) -> tuple[object, DataFrame]:
    """Fit on train, tune the threshold on val, report val and test with calibration.

    Boosted trees are cut to their best prefix on val first (``n_trees``); a hinge margin is no probability, so its
    calibration is NULL.
    """
    df = cut_lineage(df)  # fitted on, tuned on and scored: the split below it is made once
    train, rest = df.where(F.col(split) == "train"), df.where(F.col(split).isin("val", "test"))
    prefix = None
    if model in ("lr", "svm"):
        # half the squared weights plus C times the summed loss for both; the hinge solver counts per mean loss
        width = len(train.select(vec).first()[0])
        how = dict(kind="logistic") if model == "lr" else dict(kind="hinge", alpha=1.0 / max(train.count(), 1))
        fitted = fit_clients(train.withColumn("_pool", F.lit("pool")), ["pool"], width, client="_pool", vec=vec, label=label, **how, **settings)[0]["pool"]
        terms = F.zip_with(F.col(vec).cast("array<double>"), F.lit([float(v) for v in fitted[:-1]]), lambda a, b: a * b)
        margin = F.aggregate(terms, F.lit(float(fitted[-1])), lambda a, v: a + v)
        scored = rest.withColumn("score", 1.0 / (1.0 + F.exp(-margin)) if model == "lr" else margin)
    elif model == "gbm":
        fitted = fit_boosters(train.withColumn("_pool", F.lit("pool")), "_pool", vec, label, **settings)
        prefix = best_prefix(fitted, rest.where(F.col(split) == "val"), vec, label, "_pool").first()["prefix"]
        scored = prefix_probability(fitted, "pool", rest, prefix, "_pool", vec)
    else:
        raise ValueError(f"unknown pooled model {model!r}")
    calibrated = m.calibration(scored, label, "score", [split], is_probability=model != "svm")
    return fitted, m.tuned_metrics(scored, split, label).join(calibrated, split).withColumn("n_trees", F.lit(prefix).cast("int"))


def standalone_clients(df: DataFrame, test: DataFrame, client: str = "client_id", vec: str = "features", label: str = "label",
                       **settings) -> DataFrame:
    """How each client's own model does on the common test rows."""
    forest = fit_boosters(df, client, vec, label, **settings)
    scored = margins_of_clients(forest, test, [label], client, vec).withColumn("prediction", (F.col("margin") > 0).cast("double"))
    return m.task_score(scored, "BINARY", label, "prediction", [client])
