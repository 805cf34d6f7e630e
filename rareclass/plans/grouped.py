"""The grouped run: per-client fits combined round after round, then evaluated."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rareclass.operators.groupfit import HINGE_ALPHA, LOGISTIC_C, local_auprc, round_evaluation
from rareclass.operators.solver import combined as mean_weights
from rareclass.operators.solver import packed, solve_clients
from rareclass.session import cut_lineage, written

ROUNDS = 20


class ClientWeights(Mapping):
    """A table (c, w) of client weights, looked up by client; only the weights asked for reach the driver."""

    def __init__(self, table: DataFrame) -> None:
        self.table = table

    def __getitem__(self, client: object) -> np.ndarray:
        row = self.table.where(F.col("c") == str(client)).first()
        if row is None:
            raise KeyError(client)
        return np.array(row["w"])

    def __iter__(self) -> Iterator[str]:
        return (r["c"] for r in self.table.select("c").toLocalIterator())

    def __len__(self) -> int:
        return self.table.count()


def shares(solved: DataFrame, rows: DataFrame, client: str, vec: str, label: str, weighting: str, sizes: dict | None) -> DataFrame:
    """``solved`` with ``share``, each client's part in the round's mean.

    ``rows``: its rows, or ``sizes`` where given. ``accuracy``: rows times the average precision of its model on its own rows, and rows alone
    when that is 0 for all.
    """
    n = F.col("rows").cast("double")
    if sizes is not None:
        given = solved.sparkSession.createDataFrame([(str(k), float(v)) for k, v in sizes.items()], "c string, _n double")
        solved = solved.join(given, "c", "left")
        n = F.coalesce("_n", F.lit(0.0))
    if weighting == "rows":
        return solved.withColumn("share", n)
    if weighting != "accuracy":
        raise ValueError(f"unknown weighting {weighting!r}")
    met = rows.select(F.col(client).cast("string").alias("c"), F.col(label).alias("label"), F.col(vec).cast("array<double>").alias("_x")).join(solved.select("c", "w"), "c")
    scored = met.select("c", "label", margin(F.col("_x"), F.col("w")).alias("score"))
    own = solved.join(local_auprc(scored, "c"), "c", "left").withColumn("_na", n * F.coalesce("local_auprc", F.lit(0.0)))
    total = own.agg(F.sum("_na").alias("t")).first()["t"]
    return own.withColumn("share", F.col("_na") if total else n)


def margin(x, w):
    """Linear score of a row by weights that end with the intercept."""
    return F.aggregate(F.zip_with(x, F.slice(w, 1, F.size(x)), lambda a, b: a * b), F.element_at(w, -1), lambda s, v: s + v)


def round_weights(train: DataFrame, clients: Sequence, d: int, kind: str = "logistic", rounds: int = ROUNDS,
                  steps: int | None = None, client: str = "client_id", vec: str = "features",
                  label: str = "label", sizes: dict | None = None, weighting: str = "rows",
                  times: str | None = None) -> tuple[list[np.ndarray], list[ClientWeights]]:
    """Combined weights of rounds 0..n and the client weights behind them.

    Round 0 is the start. In a round every client starts from the combined weights, fits on its own rows, and the
    results are averaged (:func:`shares`). Rows are packed once; client weights stay in tables, and only the combined weights, as long as the
    model, reach the driver. The problem of a client has one solution, whatever the start, so without ``steps`` it is solved in the first round,
    to convergence, and later rounds go on with it; a client with one class comes back with the weights of the round before, which moves the
    mean. With ``steps`` every round takes so many steps from the combined weights. ``times`` names a column with the number of equal rows that a row
    stands for (with ``weighting`` rows only).
    """
    if times and weighting != "rows":
        raise ValueError("merged rows have no precision of their own: weigh by rows")
    rows = train.where(F.col(client).cast("string").isin([str(c) for c in clients]))
    blocks = cut_lineage(packed(rows, client, vec, label, times=times))
    spark = train.sparkSession
    path, local = [np.zeros(d + 1)], []
    solved: DataFrame | None = None
    parts: DataFrame | None = None
    for done in range(rounds):
        start = spark.createDataFrame([([float(v) for v in path[-1]],)], "_b array<double>")
        if solved is None or steps is not None:
            begin = blocks.select("c").distinct().crossJoin(start).select("c", F.col("_b").alias("w"))  # one row on the right
            solved = solve_clients(rows, d, kind, begin, steps, c=LOGISTIC_C, alpha=HINGE_ALPHA, blocks=blocks)
        here = solved.crossJoin(start).withColumn("w", F.when(F.col("two"), F.col("w")).otherwise(F.col("_b"))).drop("_b")
        if parts is None or steps is not None:
            # a client solved once keeps its share: one with one class has precision 0, whatever its weights
            parts = written(shares(here, rows, client, vec, label, weighting, sizes).select("c", "share"), "client-shares")
        found = mean_weights(here.join(parts, "c"), "share")
        if found is None:
            raise RuntimeError("no client returned a result: the run fails")
        path.append(found)
        local.append(ClientWeights(here.select("c", "w")))
    return path, local


def score_rounds(rows: DataFrame, combined: Sequence[np.ndarray], vec: str = "features",
                 probability: bool = True) -> DataFrame:
    """Rows scored by the combined weights of every round, in one job."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(i, [float(v) for v in w]) for i, w in enumerate(combined)], "round int, _w array<double>")
    each = rows.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(len(combined) - 1)))).join(table, "round")
    z = margin(F.col(vec).cast("array<double>"), F.col("_w"))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-z)) if probability else z
    return each.withColumn("score", score).drop("_w", vec)


def grouped_run(df: DataFrame, clients: Sequence, d: int, kind: str = "logistic", rounds: int = ROUNDS,
                steps: int | None = None, vec: str = "features", weighting: str = "rows") -> tuple[DataFrame, list[np.ndarray]]:
    """Train on ``split = train`` by client, evaluate val every round and test on the last.

    ``df`` (row_id, client_id, label, split, features). Returns (metrics per round and split, weights).
    """
    combined, _ = round_weights(df.where("split = 'train'"), clients, d, kind, rounds, steps, vec=vec, weighting=weighting)
    held = df.where("split IN ('val', 'test')").select("row_id", "label", "split", vec)
    scored = score_rounds(held, combined, vec, probability=kind == "logistic")
    return round_evaluation(scored), combined
