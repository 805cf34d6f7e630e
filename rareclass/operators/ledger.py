"""The run ledger as tables: plan, collect, order, verify, complete and migrate.

Stored ledgers are text tables whose blanks are ``""`` and whose undefined cells are ``NA`` or ``n/a``; the key of a
run is (dataset, run_name), and rows are never merged because their metrics agree.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rareclass.functions.ranks import null_safe_join

# fixed values: ledger columns and their order
SUMMARY_COLUMNS = (
    "dataset", "model", "scheme", "alpha", "oversampling", "random_seed", "rounds_configured",
    "num_clients", "best_round", "best_val_auprc", "best_val_f1", "best_val_precision",
    "best_val_recall", "best_val_recall_at_fpr", "test_auprc", "test_f1", "test_precision",
    "test_recall", "test_recall_at_fpr", "test_threshold_at_fpr", "test_actual_fpr", "test_brier",
    "test_cal_intercept", "test_cal_slope", "threshold_policy", "threshold", "data_hash",
    "partition_hash", "rounds_completed", "n_iter_selected", "n_clients_below_smote_floor",
    "baseline_auprc", "timestamp", "duration_seconds", "run_name",
)
ROUND_COLUMNS = ("round", "val_auprc", "val_f1", "val_precision", "val_recall", "val_recall_at_fpr", "train_loss")
MASTER_COLUMNS = (
    "run_name", "dataset", "model", "smote_arm", "condition", "alpha", "seed", "status", "exit_code",
    "wall_seconds", "smote_inoperative", "sub6_count", "data_hash", "partition_hash",
    "rounds_completed", "rounds_configured", "aggregation", "log",
)
REQUIRED_COLUMNS = (
    "test_auprc", "test_f1", "test_precision", "test_recall", "test_recall_at_fpr", "best_val_auprc",
    "best_val_f1", "threshold", "data_hash", "baseline_auprc", "timestamp", "duration_seconds", "run_name",
)
BASELINE_AUPRC = {"paysim": 0.00129, "creditcard": 0.00173, "baf": 0.01103}
NO_ALPHA_ORDER = 1e9
DEFAULT_ROUNDS = 20
RECOMPUTE_TOLERANCE = 2e-3


def blank(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | (F.trim(c.cast("string")) == "")


def number(c: str) -> Column:
    """A text cell as a number, NULL when it is none."""
    return F.expr(f"try_cast(`{c}` AS double)")


def plain(c: str | Column) -> Column:
    """A number as short text: 1.0 -> 1, 0.5 -> 0.5."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


# ------------------------------------------------------------------ plans and names


def experiment_matrix(cells: DataFrame, arms: Sequence[str], conditions: Sequence[str], alphas: Sequence[float],
                      seeds: Sequence[int]) -> DataFrame:
    """L1: every (dataset, model) under every arm, condition and seed; alphas multiply ``noniid`` only."""
    listed = cells.select("dataset", "model", F.explode(F.lit(list(seeds))).alias("seed")).withColumn(
        "arm", F.explode(F.lit(list(arms)))).withColumn("condition", F.explode(F.lit(list(conditions))))
    per = F.when(F.col("condition") == "noniid", F.lit([float(a) for a in alphas])).otherwise(
        F.array(F.lit(None).cast("double")))
    return listed.withColumn("alpha", F.explode(per))


def registry_runs(cells: DataFrame, alphas: Sequence[float], oversampling: Sequence[str], seeds: Sequence[int]) -> DataFrame:
    """L2: grouped runs (one IID scheme, one Dirichlet scheme per alpha) and pooled runs."""
    base = cells.select("dataset", "model", F.explode(F.lit(list(oversampling))).alias("oversampling")).withColumn(
        "seed", F.explode(F.lit(list(seeds))))
    schemes = F.array(
        F.struct(F.lit("centralized").alias("scheme"), F.lit(None).cast("double").alias("alpha")),
        F.struct(F.lit("iid").alias("scheme"), F.lit(None).cast("double").alias("alpha")),
        *[F.struct(F.lit("dirichlet").alias("scheme"), F.lit(float(a)).alias("alpha")) for a in alphas])
    runs = base.withColumn("_s", F.explode(schemes)).select("*", "_s.scheme", "_s.alpha").drop("_s")
    return runs.withColumn("kind", F.when(F.col("scheme") == "centralized", "pooled").otherwise("grouped")
                           ).withColumn("run_name", run_name())


def run_name(model: str = "model", scheme: str = "scheme", alpha: str = "alpha", oversampling: str = "oversampling",
             seed: str = "seed", short_alpha: bool = False) -> Column:
    """L3: canonical run name; ``-`` stands for no alpha, pooled runs carry neither scheme nor alpha."""
    a = F.coalesce(plain(alpha) if short_alpha else F.col(alpha).cast("string"), F.lit("-"))
    grouped = F.concat_ws("_", F.col(model), F.col(scheme), F.concat(F.lit("alpha"), a), F.col(oversampling),
                          F.concat(F.lit("seed"), F.col(seed).cast("string")))
    pooled = F.concat_ws("_", F.lit("centralized"), F.col(model), F.col(oversampling),
                         F.concat(F.lit("seed"), F.col(seed).cast("string")))
    return F.when(F.col(scheme) == "centralized", pooled).otherwise(grouped)


def cell_name(alpha: str = "alpha") -> Column:
    """L1/L3: name of a matrix cell: dataset, arm, condition, model, alpha (``na`` if none), seed."""
    return F.concat(F.concat_ws("_", "dataset", "arm", "condition", "model"), F.lit("_a"),
                    F.coalesce(plain(alpha), F.lit("na")), F.lit("_s"), F.col("seed").cast("string"))


def child_run_name(pooled_names: Mapping[str, str] | None = None) -> Column:
    """L3: the name under which a matrix cell's results are stored; some models have another pooled name."""
    model = F.col("model")
    for m, p in (pooled_names or {}).items():
        model = F.when((F.col("condition") == "centralized") & (F.col("model") == m), p).otherwise(model)
    arm = F.when(F.col("arm") == "smote", "smote").otherwise("none")
    scheme = F.when(F.col("condition") == "iid", "iid").otherwise("dirichlet")
    alpha = F.when(F.col("condition") == "iid", "-").otherwise(plain("alpha"))
    seed = F.concat(F.lit("seed"), F.col("seed").cast("string"))
    return F.when(F.col("condition") == "centralized", F.concat_ws("_", F.lit("centralized"), model, arm, seed)).otherwise(
        F.concat_ws("_", model, scheme, F.concat(F.lit("alpha"), alpha), arm, seed))


def planned_against_done(planned: DataFrame, done: DataFrame, keys: Sequence[str] = ("dataset", "run_name")) -> DataFrame:
    """L4: done, pending and percent complete per kind."""
    marked = planned.join(done.select(*keys).distinct().withColumn("_done", F.lit(True)), list(keys), "left")
    hit = F.coalesce("_done", F.lit(False))
    return marked.groupBy("kind").agg(F.count(F.lit(1)).alias("n_planned"), F.count_if(hit).alias("n_done"),
                                      F.count_if(~hit).alias("n_pending")).withColumn(
        "pct_complete", F.lit(100.0) * F.col("n_done") / F.col("n_planned"))


def pending(planned: DataFrame, done: DataFrame, keys: Sequence[str] = ("dataset", "run_name")) -> DataFrame:
    """L4: planned runs without a result."""
    return planned.join(done, list(keys), "left_anti")


# ------------------------------------------------------------------ collection


def collect_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of tables with different columns, columns in first-seen order."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def ledger_order(df: DataFrame) -> DataFrame:
    """By dataset, model, scheme, alpha (none last), oversampling, seed."""
    alpha = F.when(blank("alpha"), None).otherwise(number("alpha"))
    return df.orderBy("dataset", "model", "scheme", F.coalesce(alpha, F.lit(NO_ALPHA_ORDER)), "oversampling",
                      F.coalesce(number("random_seed"), F.lit(0.0)))


def order_position(df: DataFrame, out: str = "position") -> DataFrame:
    """L6 as numbers: the sort key columns beside each row, for use in further joins."""
    alpha = F.when(blank("alpha"), None).otherwise(number("alpha"))
    return df.withColumn(out, F.struct(
        "dataset", "model", "scheme", F.coalesce(alpha, F.lit(NO_ALPHA_ORDER)).alias("alpha"), "oversampling",
        F.coalesce(number("random_seed"), F.lit(0.0)).alias("seed")))


def stamp_baseline(df: DataFrame, baselines: DataFrame, column: str = "baseline_auprc") -> DataFrame:
    """Fill missing prevalence floors from a (dataset, baseline) table; stored values stay."""
    stored = df.withColumn("_stored", F.when(blank(column), None).otherwise(F.col(column))) if column in df.columns \
        else df.withColumn("_stored", F.lit(None).cast("double"))
    known = baselines.select(F.lower("dataset").alias("_key"), F.col("baseline").alias("_base"))
    joined = stored.join(known, F.lower(F.col("dataset")) == F.col("_key"), "left")
    return joined.withColumn(column, F.coalesce(F.col("_stored").cast("double"), "_base")).drop("_stored", "_key", "_base")


def shown_number(c: str, digits: int = 4) -> Column:
    """A cell as fixed-digit text, ``-`` for a blank, other text unchanged."""
    value = number(c)
    return F.when(blank(c), "-").when(value.isNull(), F.col(c).cast("string")).otherwise(
        F.format_string(f"%.{digits}f", value))


def report_rows(df: DataFrame, metrics: Sequence[str], digits: Mapping[str, int] | None = None) -> DataFrame:
    """Display rows: scheme label and metrics as text."""
    alpha = F.when(blank("alpha"), "—").when(number("alpha").isNull(), F.col("alpha")).otherwise(
        F.concat(F.lit("α="), plain(number("alpha"))))
    label = F.when(F.col("scheme") == "dirichlet", F.concat(F.lit("Dirichlet "), alpha)).when(
        F.col("scheme") == "iid", "IID").otherwise(F.when(blank("scheme"), "—").otherwise(F.col("scheme")))
    digits = digits or {}
    return df.select("dataset", "model", label.alias("scheme_label"), "oversampling", "random_seed",
                     *[shown_number(c, digits.get(c, 4)).alias(c) for c in metrics])


# ------------------------------------------------------------------ verification


def verify_hashes(ledger: DataFrame, data: DataFrame, parts: DataFrame) -> DataFrame:
    """Stored data and partition hashes against recomputed ones.

    ``data`` (dataset, random_seed, data_hash), ``parts`` (dataset, random_seed, scheme, alpha, partition_hash).
    Status: ``unverified`` (no hash stored), ``ok`` or ``failed``; partition status NULL where none applies.
    """
    d = data.select("dataset", "random_seed", F.col("data_hash").alias("_dh"))
    p = parts.select("dataset", "random_seed", "scheme", "alpha", F.col("partition_hash").alias("_ph"))
    joined = null_safe_join(null_safe_join(ledger, d, ["dataset", "random_seed"], "left"), p,
                            ["dataset", "random_seed", "scheme", "alpha"], "left")
    data_status = F.when(blank("data_hash"), "unverified").when(F.col("data_hash") == F.col("_dh"), "ok").otherwise("failed")
    part_status = F.when(blank("data_hash") | ~F.col("scheme").isin("iid", "dirichlet") | blank("partition_hash"), None).when(
        F.col("partition_hash") == F.col("_ph"), "ok").otherwise("failed")
    return joined.withColumn("data_status", data_status).withColumn("partition_status", part_status).drop("_dh", "_ph")


def verification_tally(verified: DataFrame) -> DataFrame:
    """Rows per status."""
    return verified.groupBy("data_status", "partition_status").agg(F.count(F.lit(1)).alias("n_runs"))


def split_hash_cells(ledger: DataFrame, keys: Sequence[str] = ("dataset", "random_seed", "scheme", "alpha")) -> DataFrame:
    """Cells whose runs saw more than one data hash."""
    return ledger.where(~blank("data_hash")).groupBy(*keys).agg(
        F.count_distinct("data_hash").alias("n_hashes"), F.count(F.lit(1)).alias("n_runs")).where("n_hashes > 1")


def census_crosscheck(a: DataFrame, b: DataFrame, keys: Sequence[str], client: str = "client_id",
                      value: str = "n_minority") -> DataFrame:
    """Do two per-client count tables agree exactly, cell by cell."""
    left = a.select(*keys, client, F.col(value).alias("_a"))
    right = b.select(*keys, client, F.col(value).alias("_b"))
    both = left.join(right, [*keys, client], "full")
    return both.groupBy(*keys).agg(F.bool_and(F.col("_a").eqNullSafe(F.col("_b"))).alias("match"))


def feature_order_check(stored: DataFrame, current: DataFrame, keys: Sequence[str] = ("artifact",)) -> DataFrame:
    """Do stored feature names (array) equal the current ones in order; first position that differs."""
    a = stored.select(*keys, F.posexplode("names").alias("position", "stored"))
    b = current.select(*keys, F.posexplode("names").alias("position", "current"))
    both = a.join(b, [*keys, "position"], "full")
    differs = ~F.col("stored").eqNullSafe(F.col("current"))
    return both.groupBy(*keys).agg(F.min(F.when(differs, F.col("position"))).alias("first_difference")).withColumn(
        "same_order", F.col("first_difference").isNull())


# ------------------------------------------------------------------ completion and repair


def fill_blanks(df: DataFrame, new: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("dataset", "run_name")) -> DataFrame:
    """Recomputed values go into blank cells only; everything else stays as it was."""
    fresh = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    base = df
    for c in columns:
        if c not in base.columns:
            base = base.withColumn(c, F.lit(None).cast(dict(new.dtypes)[c]))
    joined = null_safe_join(base, fresh, keys, "left")
    return joined.select(*[
        F.when(blank(c), F.coalesce(F.col(f"_new_{c}"), F.col(c))).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
        for c in base.columns])


def changed_cells(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """L12 dry run: rows whose other columns changed (must be none)."""
    others = [c for c in before.columns if c not in columns]
    return before.select(*others).exceptAll(after.select(*others))


def accept_recomputed(stored: DataFrame, recomputed: DataFrame, columns: Sequence[str],
                      keys: Sequence[str] = ("dataset", "run_name"), metric: str = "test_auprc",
                      val_columns: Sequence[str] = (), tol: float = RECOMPUTE_TOLERANCE) -> DataFrame:
    """New values only from runs whose recomputed score is within ``tol`` of the stored one.

    ``val_columns`` are kept for pooled runs alone.
    """
    s = stored.select(*keys, "scheme", F.col(metric).cast("double").alias("_stored"))
    r = recomputed.select(*keys, F.col(metric).cast("double").alias("_new"), *columns)
    joined = s.join(r, list(keys))
    close = F.abs(F.col("_stored") - F.col("_new")) <= tol
    pooled = F.col("scheme") == "centralized"
    return joined.where(close).select(*keys, *[
        F.when(pooled, F.col(c)).alias(c) if c in val_columns else F.col(c) for c in columns])


def _rounds_completed(counted: bool, uncounted_zero: Sequence[str]) -> Column:
    old = F.trim(F.coalesce(F.col("_old_completed"), F.lit("")))
    as_int = F.expr("try_cast(trim(coalesce(_old_completed, '')) AS double)").cast("bigint")
    offset = F.when(F.col("model").isin(*uncounted_zero), 0).otherwise(1)
    text = F.when(F.col("scheme") == "centralized", "n/a")
    if counted:
        text = text.when(F.col("_n_rounds").isNotNull(), F.col("_n_rounds").cast("string"))
    return text.when(old.isin("", "n/a"), F.lit("n/a")).when(as_int.isNull(), old).otherwise(
        F.greatest(as_int - offset, F.lit(0)).cast("string"))


def fit_round_counts(rounds: DataFrame, keys: Sequence[str] = ("dataset", "run_name")) -> DataFrame:
    """Fit rounds (round >= 1) per run with a stored history."""
    return rounds.groupBy(*keys).agg(F.count_if(F.expr("try_cast(round AS double)") >= 1).alias("_n_rounds"))


def configured_rounds(scheme: str = "scheme", budgets: Mapping[str, int] | None = None, default: int = DEFAULT_ROUNDS) -> Column:
    """Round budget of a model; pooled runs have none."""
    out = F.lit(str(default))
    for model, n in (budgets or {}).items():
        out = F.when(F.col("model") == model, str(n)).otherwise(out)
    return F.when(F.col(scheme) == "centralized", "n/a").otherwise(out)


def migrate_summary(old: DataFrame, rounds: DataFrame, budgets: Mapping[str, int] | None = None,
                    uncounted_zero: Sequence[str] = ("gbm",), keys: Sequence[str] = ("dataset", "run_name"),
                    columns: Sequence[str] = SUMMARY_COLUMNS) -> DataFrame:
    """Old summaries in the current columns; already migrated tables come back unchanged.

    Completed rounds are counted from the run's own history, else the old number less the initial
    evaluation (models in ``uncounted_zero`` never logged one).
    """
    if "rounds_configured" in old.columns:
        return old
    counts = fit_round_counts(rounds, keys)
    carried = old.withColumn("_old_completed", F.col("rounds_completed").cast("string") if "rounds_completed" in old.columns
                             else F.lit(None).cast("string"))
    joined = null_safe_join(carried, counts, keys, "left")
    budget = F.trim(F.col("num_rounds").cast("string")) if "num_rounds" in old.columns else F.lit("")
    configured = F.when(F.col("scheme") == "centralized", "n/a").when(
        ~F.coalesce(budget, F.lit("")).isin("", "n/a"), budget).otherwise(configured_rounds(budgets=budgets))
    values = {"rounds_configured": configured, "rounds_completed": _rounds_completed(True, uncounted_zero),
              "n_iter_selected": F.coalesce(F.when(~blank("n_iter_selected"), F.col("n_iter_selected")), F.lit("n/a"))
              if "n_iter_selected" in old.columns else F.lit("n/a")}
    return joined.select(*[
        (values[c] if c in values else F.col(c) if c in old.columns else F.lit("")).alias(c) for c in columns])


def drop_initial_round(rounds: DataFrame) -> DataFrame:
    """Histories without the round-0 evaluation; rows without a number stay."""
    return rounds.where(~F.expr("try_cast(round AS double)").cast("bigint").eqNullSafe(F.lit(0)))


def migrate_master(master: DataFrame, rounds: DataFrame, budgets: Mapping[str, int] | None = None,
                   uncounted_zero: Sequence[str] = ("gbm",), pooled_names: Mapping[str, str] | None = None) -> DataFrame:
    """The sweep ledger with recounted and configured rounds; histories are found by the stored run name."""
    if "rounds_configured" in master.columns:
        return master
    counts = fit_round_counts(rounds).withColumnRenamed("run_name", "_child")
    named = master.withColumn("arm", F.col("smote_arm")).withColumn("_child", child_run_name(pooled_names)).drop("arm")
    named = named.withColumn("_old_completed", F.col("rounds_completed").cast("string")).withColumn(
        "scheme", F.when(F.col("condition") == "centralized", "centralized").otherwise("grouped"))
    joined = null_safe_join(named, counts, ["dataset", "_child"], "left")
    return joined.withColumn("rounds_completed", _rounds_completed(True, uncounted_zero)).withColumn(
        "rounds_configured", configured_rounds(budgets=budgets)).select(
        *master.columns, "rounds_configured")


def migration_tally(actions: DataFrame) -> DataFrame:
    """Files per kind and action."""
    return actions.groupBy("kind", "action").agg(F.count(F.lit(1)).alias("n_files"))


def migration_action(headers: DataFrame, names: str = "names") -> DataFrame:
    """What a migration does with a file, from its header."""
    has = lambda c: F.array_contains(names, c)
    action = F.when(F.size(names) == 0, "skip-empty").when(
        F.col("kind") == "rounds", F.when(~has("round"), "skip-unrelated").when(F.col("has_round_zero"), "migrated")
        .otherwise("skip-noround0")).when(has("rounds_configured"), "skip-new").when(
        ~has("rounds_completed") & ~has("num_rounds"), "skip-unrelated").otherwise("migrated")
    return headers.withColumn("action", action)


# ------------------------------------------------------------------ resuming


def fingerprint(columns: Sequence[str]) -> Column:
    """sha256 of the configuration, keys in name order, NULL kept apart from blank."""
    record = F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(columns)])
    return F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256)


def not_complete(planned: DataFrame, markers: DataFrame) -> DataFrame:
    """Runs without a success marker of the same fingerprint; a changed configuration runs again."""
    ok = markers.where(F.col("status") == "success").select("run_name", "fingerprint")
    return planned.join(ok, ["run_name", "fingerprint"], "left_anti")


def missing_columns(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS, out: str = "missing") -> DataFrame:
    """Required cells that are blank, in order; ``NA`` counts as recorded."""
    gone = [F.when(blank(c), F.lit(c)) if c in df.columns else F.lit(c) for c in required]
    return df.withColumn(out, F.array_compact(F.array(*gone))).withColumn("is_complete", F.size(out) == 0)


def reclassify(runs: DataFrame, artifacts: DataFrame, keys: Sequence[str] = ("dataset", "run_name")) -> DataFrame:
    """A success without a stored artifact, or a grouped success with zero rounds, is a failure."""
    have = artifacts.select(*keys).distinct().withColumn("_have", F.lit(True))
    joined = runs.join(have, list(keys), "left")
    success = F.col("status") == "success"
    zero = (F.col("condition") != "centralized") & (F.expr("try_cast(rounds_completed AS int)") == 0)
    status = F.when(success & F.col("_have").isNull(), "failed_no_artifact").when(
        success & zero, "failed_zero_rounds").otherwise(F.col("status"))
    return joined.withColumn("status", status).drop("_have")


def plan_report(planned: DataFrame, arm: str = "arm", noop: str = "is_noop") -> DataFrame:
    """Planned cells, cells to run and oversampling cells skipped because they change nothing."""
    skip = (F.col(arm) == "smote") & F.coalesce(noop, F.lit(False))
    return planned.agg(F.count(F.lit(1)).alias("n_planned"), F.count_if(~skip).alias("n_to_run"),
                       F.count_if(skip).alias("n_skipped"))


def scope_order(cells: DataFrame, cheap: Sequence[str], dataset_order: Sequence[str]) -> DataFrame:
    """Cheap models first, then by dataset priority; unknown datasets last."""
    is_cheap = F.col("model").isin(*cheap)
    at = F.array_position(F.lit(list(dataset_order)), F.col("dataset"))
    rank = F.when(is_cheap, 0).otherwise(F.when(at > 0, at).otherwise(len(dataset_order) + 1))
    return cells.withColumn("scope_rank", rank.cast("int")).orderBy("scope_rank")


def seconds_per_round(runs: DataFrame) -> DataFrame:
    """Wall seconds over completed rounds, NULL without rounds."""
    return runs.withColumn("seconds_per_round", F.col("wall_seconds") / F.nullif(F.col("rounds_completed"), F.lit(0)))
