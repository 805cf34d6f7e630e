"""Per-client model fitting, group-weighted combination and round histories."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rareclass.functions.ranks import null_safe_join, running_totals
from rareclass.operators import metrics as m
from rareclass.operators.solver import solve_clients

LOGISTIC_C = 1.0
HINGE_ALPHA = 1e-4
PATIENCE = 10


# ------------------------------------------------------------------ fitting


def fit_clients(df: DataFrame, clients: Sequence, d: int, kind: str = "logistic", start: dict | None = None,
                steps: int | None = None, tol: float = 1e-8, c: float = LOGISTIC_C, alpha: float = HINGE_ALPHA,
                client: str = "client_id", vec: str = "features", label: str = "label") -> tuple[dict, dict]:
    """The named clients' models, warm-started, as (weights, rows used) per client in the driver.

    For few clients; :func:`rareclass.operators.solver.solve_clients` gives the same as a table for any number. ``logistic`` and ``hinge`` are
    solved until no weight moves by ``tol``; ``steps`` stops earlier on purpose. A client with one class, or without rows, keeps the
    weights it came with.
    """
    names = [str(k) for k in clients]
    own = df.where(F.col(client).cast("string").isin(names))
    begin = df.sparkSession.createDataFrame([(k, [float(v) for v in start[k]]) for k in names], "c string, w array<double>") if start else None
    found = solve_clients(own, d, kind, begin, steps, tol, c, alpha, client, vec, label).collect()
    weights = {k: np.zeros(d + 1) if start is None else np.array(start[k], dtype=float) for k in names}
    return weights | {r["c"]: np.array(r["w"]) for r in found}, {r["c"]: float(r["rows"]) for r in found}


def weights_table(spark, weights: dict, layer: str = "linear", **columns) -> DataFrame:
    """Parameters as a long table (client_id, layer, pos, w)."""
    rows = [(k, layer, i, float(v)) for k, arr in weights.items() for i, v in enumerate(arr)]
    df = spark.createDataFrame(rows, "client_id string, layer string, pos int, w double")
    return df.withColumns({k: F.lit(v) for k, v in columns.items()}) if columns else df


# ------------------------------------------------------------------ combination


def client_weights(updates: DataFrame, n: str = "n", alpha: str | None = None,
                   keys: Sequence[str] = ("round",)) -> DataFrame:
    """Each client's share in its round: by rows, or by rows times accuracy ``alpha``.

    All accuracies 0 -> rows only (``is_fallback``); no rows at all -> NULL weight.
    """
    rows = F.col(n).cast("double")
    a = F.coalesce(F.col(alpha), F.lit(0.0)) if alpha else F.lit(1.0)
    totals = updates.groupBy(*keys).agg(F.sum(rows).alias("_n"), F.sum(rows * a).alias("_na"))
    fallback = F.col("_na") == 0
    share = F.when(F.col("_n") > 0, F.when(fallback, rows / F.col("_n")).otherwise(rows * a / F.col("_na")))
    return null_safe_join(updates, totals, keys).withColumn("weight", share).withColumn(
        "is_fallback", fallback).drop("_n", "_na")


def combine_parameters(params: DataFrame, updates: DataFrame, alpha: str | None = None, n: str = "n",
                       keys: Sequence[str] = ("round",), client: str = "client_id") -> DataFrame:
    """Weighted mean of the clients' parameter arrays.

    ``params`` (keys, client, layer, w array); ``updates`` (keys, client, n[, alpha]). Rounds without any rows
    give no result.
    """
    weighted = client_weights(updates, n, alpha, keys).where(F.col("weight").isNotNull()).select(*keys, client, "weight")
    long = params.join(weighted, [*keys, client]).select(*keys, "layer", "weight", F.posexplode("w").alias("pos", "w"))
    return long.groupBy(*keys, "layer", "pos").agg(F.sum(F.col("weight") * F.col("w")).alias("w"))


def parameter_arrays(combined: DataFrame, keys: Sequence[str] = ("round",)) -> DataFrame:
    """Combined parameters back to one array per layer (an array is as long as the layer)."""
    return combined.groupBy(*keys, "layer").agg(F.sort_array(F.collect_list(F.struct("pos", "w")))["w"].alias("w"))


def require_results(updates: DataFrame, rounds: DataFrame, keys: Sequence[str] = ("round",)) -> None:
    """A round in which no client returned anything fails the run."""
    empty = rounds.join(updates.select(*keys).distinct(), list(keys), "left_anti").limit(1).collect()
    if empty:
        raise RuntimeError(f"no client results in round {empty[0].asDict()}")


def combine_metrics(metrics: DataFrame, updates: DataFrame, n: str = "n", keys: Sequence[str] = ("round",),
                    client: str = "client_id") -> DataFrame:
    """Row-weighted mean of client metrics; a metric a client did not report counts as 0."""
    totals = updates.groupBy(*keys).agg(F.sum(F.col(n).cast("double")).alias("_n"))
    sized = metrics.join(updates.select(*keys, client, F.col(n).cast("double").alias("_w")), [*keys, client])
    summed = sized.groupBy(*keys, "metric").agg(F.sum(F.col("_w") * F.coalesce("value", F.lit(0.0))).alias("_s"))
    return null_safe_join(summed, totals, keys).where(F.col("_n") > 0).select(
        *keys, "metric", (F.col("_s") / F.col("_n")).alias("value"))


def keep_incoming(fitted: DataFrame, incoming: DataFrame, classes: DataFrame, client: str = "client_id") -> DataFrame:
    """R3 on tables: clients with fewer than two classes keep the incoming weights.

    ``classes`` (client, label rows); ``fitted`` and ``incoming`` (client, w).
    """
    seen = classes.groupBy(client).agg((F.min("label") != F.max("label")).alias("_two"))
    new = fitted.select(client, F.col("w").alias("_new"))
    return incoming.join(seen, client, "left").join(new, client, "left").select(
        client, F.when(F.coalesce("_two", F.lit(False)), F.coalesce("_new", "w")).otherwise(F.col("w")).alias("w"),
        (~F.coalesce("_two", F.lit(False))).alias("skipped"))


def local_auprc(df: DataFrame, client: str = "client_id", label: str = "label", score: str = "score",
                keys: Sequence[str] = ()) -> DataFrame:
    """Each client's average precision on its own rows; one class -> 0."""
    return m.average_precision(df, label, score, [*keys, client], out="local_auprc")


# ------------------------------------------------------------------ model selection


def best_model(scores: DataFrame, keys: Sequence[str] = (), client: str = "client_id",
               auprc: str = "auprc", skipped: str = "skipped") -> DataFrame:
    """The client with the highest validation score, lowest id on ties; none eligible -> NULL."""
    pick = F.when(~F.col(skipped), F.struct((-F.col(auprc)).alias("a"), F.col(client).alias("c")))
    best = scores.groupBy(*keys).agg(F.min(pick).alias("_b"), F.count_if(~F.col(skipped)).alias("n_eligible"))
    return best.select(*keys, F.col("_b.c").alias(client), (-F.col("_b.a")).alias(auprc), "n_eligible")


def carry_best(best: DataFrame, runs: Sequence[str] = (), client: str = "client_id", order: str = "round") -> DataFrame:
    """A round without an eligible client keeps the previous winner (one row per round)."""
    upto = W.partitionBy(*runs).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return best.withColumn("kept", F.last(client, ignorenulls=True).over(upto))


def prefix_scores(df: DataFrame, margins: str = "margins", keep: Sequence[str] = ("row_id", "label")) -> DataFrame:
    """Score of every boosting prefix: the running sum of per-tree margins, one vectorised sum per batch of rows."""
    source = df.select(*keep, F.col(margins).cast("array<double>").alias("_running"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_running")
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            first, out = np.cumsum(size) - size, np.empty(len(flat))
            for k in np.unique(size[size > 0]):  # rows of one length together; each is summed on its own, so equal rows stay equal
                cells = first[size == k][:, None] + np.arange(k)
                out[cells] = np.cumsum(flat[cells], axis=1)
            running = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(out))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], running], names=batch.schema.names)

    return source.mapInArrow(run, source.schema).select(*keep, F.posexplode("_running").alias("_p", "score")).select(
        *keep, (F.col("_p") + 1).alias("prefix"), "score")


def select_prefix(df: DataFrame, margins: str = "margins", label: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """The prefix length with the best average precision, shorter on ties; one class -> full length."""
    scored = prefix_scores(df, margins, [*keys, label])
    ap = m.average_precision(scored, label, "score", [*keys, "prefix"])
    classes = df.groupBy(*keys).agg((F.min(label) != F.max(label)).alias("_two"), F.max(F.size(margins)).alias("_full"))
    best = ap.groupBy(*keys).agg(F.max(F.struct(F.col("auprc"), (-F.col("prefix")).alias("neg"))).alias("_b"))
    return null_safe_join(classes, best, keys).select(
        *keys, F.when(F.col("_two"), -F.col("_b.neg")).otherwise(F.col("_full")).alias("prefix"),
        F.when(F.col("_two"), F.col("_b.auprc")).otherwise(F.lit(0.0)).alias("auprc"))


def truncate_margins(df: DataFrame, prefix: int | Column, margins: str = "margins", out: str = "score") -> DataFrame:
    """Score with the first ``prefix`` trees only."""
    kept = F.slice(margins, F.lit(1), prefix if isinstance(prefix, Column) else F.lit(prefix))
    return df.withColumn(out, F.aggregate(kept, F.lit(0.0), lambda s, v: s + v))


# ------------------------------------------------------------------ round histories


def round_evaluation(scores: DataFrame, keys: Sequence[str] = (), split: str = "split") -> DataFrame:
    """Validation metrics with a tuned threshold every round; test once, on the last round, with that threshold."""
    last = scores.groupBy(*keys).agg(F.max("round").alias("_last"))
    kept = null_safe_join(scores, last, keys).where((F.col(split) == "val") | (F.col("round") == F.col("_last"))).drop("_last")
    return m.tuned_metrics(kept, split, keys=[*keys, "round"])


def _progress(history: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """History with its 1-based position and the best value before each round."""
    ones = history.withColumn("_one", F.lit(1))
    run = running_totals(ones, "round", {"_idx": "_one"}, keys, prior_maxes={"_before": value})
    return run.withColumn("_up", F.col("_before").isNull() | (F.col(value) > F.col("_before")))


def early_stop_flag(history: DataFrame, keys: Sequence[str] = ("run_id",), value: str = "val_auprc",
                    patience: int = PATIENCE) -> DataFrame:
    """The first round with ``patience`` rounds since the last strict improvement; ties are no progress.

    Round 0 does not count and training is not stopped; NULL when never reached.
    """
    fit = history.where(F.col("round") > 0)
    seen = _progress(fit.select(*keys, "round", value), value, keys)
    seen = seen.withColumn("_at", F.when(F.col("_up"), F.col("_idx"))).drop("tot__idx")
    run = running_totals(seen, "round", {}, keys, maxes={"_last": "_at"})
    waited = F.col("_idx") - F.col("_last")
    return run.groupBy(*keys).agg(F.min(F.when(waited >= patience, F.col("round"))).alias("early_stop_round"))


def early_stop_cut(history: DataFrame, keys: Sequence[str] = ("run_id",), value: str = "val_auprc",
                   patience: int = PATIENCE, maximise: bool = True) -> DataFrame:
    """History up to the round in which the ``patience``-th drop since the last improvement happens.

    A tie changes nothing: only a value strictly worse than the best counts. ``maximise=False`` watches a loss.
    """
    signed = F.col(value) if maximise else -F.col(value)
    seen = _progress(history.select(*keys, "round", signed.alias("_v")), "_v", keys)
    seen = seen.withColumn("_down", F.coalesce((F.col("_v") < F.col("_before")).cast("int"), F.lit(0)))
    drops = running_totals(seen.select(*keys, "round", "_up", "_down"), "round", {"_drops": "_down"}, keys)
    drops = drops.withColumn("_mark", F.when(F.col("_up"), F.col("_drops"))).drop("tot__drops")
    run = running_totals(drops, "round", {}, keys, maxes={"_base": "_mark"})
    stop = run.groupBy(*keys).agg(
        F.min(F.when(F.col("_drops") - F.col("_base") >= patience, F.col("round"))).alias("stop_round"))
    return null_safe_join(history, stop, keys).where(
        F.col("stop_round").isNull() | (F.col("round") <= F.col("stop_round")))


def monitored(history: DataFrame, out: str = "watched") -> DataFrame:
    """The value the stop rule watches: validation score, else test score."""
    return history.withColumn(out, F.coalesce("val_auprc", "test_auprc"))


def history_wide(long: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """(round, metric, value) to one column per metric."""
    return long.groupBy(*keys, "round").pivot("metric", list(metrics)).agg(F.first("value"))


def best_round(history: DataFrame, keys: Sequence[str] = ("run_id",), include_round_zero: bool = False,
               val: str = "val_auprc", test: str = "test_auprc", carry: Sequence[str] = ()) -> DataFrame:
    """First round with the highest validation score; without validation scores the test score decides.

    ``carry`` columns of that round come along as ``best_<col>``, from the same aggregate.
    """
    rows = history if include_round_zero else history.where(F.col("round") >= 1)

    def first_max(c: str) -> Column:
        return F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), (-F.col("round")).alias("neg"), *carry)))

    found = rows.groupBy(*keys).agg(first_max(val).alias("_v"), first_max(test).alias("_t"), F.max("round").alias("final_round"))
    best = F.coalesce("_v", "_t")
    return found.select(*keys, (-best["neg"]).alias("best_round"), best["v"].alias("best_value"), "final_round",
                        *[best[c].alias(f"best_{c}") for c in carry])


def final_test_row(history: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """The last round's row."""
    last = history.groupBy(*keys).agg(F.max("round").alias("_last"))
    return null_safe_join(history, last, keys).where(F.col("round") == F.col("_last")).drop("_last")


def metrics_at_best(best: DataFrame, history: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Validation metrics of the best round, NULL where the round is missing."""
    at = history.select(*keys, F.col("round").alias("best_round"), *[F.col(c).alias(f"best_{c}") for c in columns])
    return null_safe_join(best, at, [*keys, "best_round"], "left")


def best_per_metric(long: DataFrame, task: str = "BINARY", keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Best value of each metric series and its first round; smallest for a regression."""
    sign = {"BINARY": F.lit(1.0), "REG": F.lit(-1.0)}[task.upper()]
    best = long.groupBy(*keys, "metric").agg(
        F.max(F.struct((sign * F.col("value")).alias("v"), (-F.col("round")).alias("neg"))).alias("_b"))
    return best.select(*keys, "metric", (sign * F.col("_b.v")).alias("best_res"), (-F.col("_b.neg")).alias("best_res_round"))
