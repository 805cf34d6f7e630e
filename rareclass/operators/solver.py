"""Linear models of all clients at once, solved where their sums are.

Rows are packed once into blocks of one client each. The state of every client (weights, next step, stage) is a table. A client whose rows fit
one task is solved there. For larger ones a pass joins the state to the blocks, tasks return one set of sums per client, and a grouped task takes
each client's next step. The driver only learns whether clients are still open, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rareclass.session import cut_lineage, written

STATE = "c string, w array<double>, step array<double>, stage int, done boolean, settled boolean, rows long, two boolean, loss double, steps int"
#: Widths of the smoothed corner of the hinge, one after another; the last leaves the loss within half of it.
WIDTHS = (2.0, 0.7, 0.25, 0.08, 0.025, 0.008, 0.0025, 0.0008, 0.00025)
#: Parts of a Newton step that one pass tries.
TRIED = {"logistic": (1.0,), "hinge": (1.0, 0.4, 0.1, 0.02, 0.004)}
BLOCK_ROWS = 4096


def packed(df: DataFrame, client: str, vec: str, label: str, block_rows: int = BLOCK_ROWS, times: str | None = None) -> DataFrame:
    """(c, x, y, n): rows of one client and at most ``block_rows`` of them per block, as bytes. Rows without client or label are left out.

    ``times`` names a column that says how many equal rows a row stands for; one each without it.
    """
    rows = df.where(F.col(client).isNotNull() & F.col(label).isNotNull()).select(
        F.col(client).cast("string").alias("c"), F.col(vec).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"),
        (F.col(times) if times else F.lit(1)).cast("double").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, ...]]] = {}
        n = 0

        def out(names: list[str]) -> pa.RecordBatch:
            parts = [held.pop(k) for k in names]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(
                pa.array([np.concatenate([b[i] for b in p]).tobytes() for p in parts], pa.binary()) for i in range(3))], names=["c", "x", "y", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("x")
            x = lists.flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(batch.num_rows, -1)
            y, t = (batch.column(k).to_numpy(zero_copy_only=False).astype("<f8") for k in ("y", "n"))
            names, code = np.unique(np.array(batch.column("c").to_pylist(), dtype=object), return_inverse=True)
            order = np.argsort(code, kind="stable")
            ends = np.cumsum(np.bincount(code))
            for k, own in zip(names.tolist(), np.split(order, ends[:-1]), strict=True):
                for a in range(0, len(own), block_rows):
                    held.setdefault(k, []).append(tuple(v[own[a:a + block_rows]] for v in (x, y, t)))
                    if sum(len(b[1]) for b in held[k]) >= block_rows:
                        yield out([k])
            n += len(y)
            if n > 16 * block_rows:
                yield out(list(held))
                n = 0
        if held:
            yield out(list(held))

    return rows.mapInArrow(run, "c string, x binary, y binary, n binary")


def logistic_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, n: np.ndarray | float = 1.0) -> tuple[float, np.ndarray, np.ndarray]:
    """Each row counts ``n`` times."""
    z = x @ w
    mu = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
    return float((n * (np.logaddexp(0.0, z) - y * z)).sum()), x.T @ (n * (mu - y)), x.T @ (x * (n * mu * (1 - mu))[:, None])


def hinge_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, width: float, n: np.ndarray | float = 1.0) -> tuple[float, np.ndarray, np.ndarray]:
    """Hinge loss with its corner replaced by a parabola of the given width; each row counts ``n`` times."""
    s = 2.0 * y - 1.0
    short = 1.0 - s * (x @ w)
    bent, straight = (short > 0) & (short < width), short >= width
    n = np.broadcast_to(n, len(s))
    loss = (n[bent] * short[bent] ** 2).sum() / (2 * width) + (n[straight] * (short[straight] - width / 2)).sum()
    slope = n * np.where(straight, 1.0, np.where(bent, short / width, 0.0))
    return float(loss), -x.T @ (s * slope), x[bent].T @ (x[bent] * n[bent, None]) / width


def advance(state: dict, n: float, positives: float, sums: list[tuple[float, np.ndarray, np.ndarray]], kind: str, c: float, alpha: float,
            tol: float, limit: int | None) -> dict:
    """A client's state once its sums at the tried points ``w - part * step`` are known.

    The best point is taken when it lowers the objective, and a Newton step from there comes next. ``logistic``: half the squared weights plus
    ``c`` times the summed loss; a step that lowers nothing is quartered; settled when steps fall below ``tol``. ``hinge``: the mean loss plus
    ``alpha`` / 2 times the squared weights; a stage ends when a pass gains less than a millionth, the last one settles. The intercept, the
    last weight, is free.
    """
    w, step, before = np.array(state["w"]), np.array(state["step"]), state["loss"]
    two = 0 < positives < n
    new = state | {"rows": int(n), "two": two, "steps": state["steps"] + 1}
    if not two:
        return new | {"done": True}
    pen = np.append(np.ones(len(w) - 1), 0.0)
    weight, ridge = (c, 1.0) if kind == "logistic" else (1.0 / n, alpha)
    points = [w - part * step for part in TRIED[kind]]
    totals = [weight * loss + 0.5 * ridge * float((pen * p * p).sum()) for p, (loss, _, _) in zip(points, sums, strict=True)]
    best = int(np.argmin(totals))
    first, total = before is None, totals[best]
    if first or total <= before + 1e-10 * abs(before):
        w = points[best]
        new |= {"w": w.tolist(), "loss": total}
    elif kind == "logistic":
        step = 0.25 * step
        stuck = bool(np.abs(step).max() < tol)
        return new | {"step": step.tolist(), "done": stuck or (limit is not None and new["steps"] > limit), "settled": stuck}
    if limit is not None and new["steps"] > limit:
        return new | {"done": True}
    if kind == "hinge" and not first and total >= before - 1e-6 * (1 + abs(before)):
        if state["stage"] + 1 == len(WIDTHS):
            return new | {"done": True, "settled": True}
        return new | {"stage": state["stage"] + 1, "loss": None, "step": np.zeros(len(w)).tolist()}
    _, grad, hess = sums[best]
    curve = ridge * np.diag(pen) + weight * hess + (1e-9 * np.eye(len(w)) if kind == "hinge" else 0.0)
    step = np.linalg.lstsq(curve, ridge * pen * w + weight * grad, rcond=None)[0]
    if kind == "logistic" and np.abs(step).max() < tol:
        return new | {"w": (w - step).tolist(), "done": True, "settled": True}
    return new | {"step": step.tolist()}


def solve_clients(df: DataFrame, d: int, kind: str = "logistic", start: DataFrame | None = None, steps: int | None = None, tol: float = 1e-8,
                  c: float = 1.0, alpha: float = 1e-4, client: str = "client_id", vec: str = "features", label: str = "label",
                  blocks: DataFrame | None = None, most: int = 200, task_cells: int = 1 << 22) -> DataFrame:
    """(c, w, rows, two, loss, steps, settled) for every client with rows; ``w`` ends with the intercept.

    ``start`` (c, w) gives weights to begin with, zeros elsewhere. A client with one class (``two`` false) keeps them. ``steps`` stops after so
    many steps on purpose (one that is cut counts as well), and ``most`` bounds the steps of a client that does not settle; both leave ``settled``
    false. ``blocks`` are the packed rows, where they are at hand. Clients of at most ``task_cells`` feature values are solved inside one task,
    all in one job; larger ones together, a job per step.
    """
    if kind not in ("logistic", "hinge"):
        raise ValueError(f"unknown loss {kind!r}")
    if blocks is None:
        blocks = cut_lineage(packed(df, client, vec, label))
    names = blocks.select("c").distinct()
    zeros = F.array_repeat(F.lit(0.0), d + 1)
    known = names.join(start.select("c", F.col("w").alias("_w")), "c", "left") if start is not None else names.withColumn("_w", F.lit(None).cast("array<double>"))
    w = F.coalesce("_w", zeros)
    state = written(known.select(
        "c", w.alias("w"), zeros.alias("step"), F.lit(0).alias("stage"), F.lit(False).alias("done"), F.lit(False).alias("settled"),
        F.lit(0).cast("long").alias("rows"), F.lit(False).alias("two"), F.lit(None).cast("double").alias("loss"), F.lit(0).alias("steps")),
        "solver-start")
    passes = most if steps is None else steps + 1
    sizes = written(blocks.groupBy("c").agg((F.sum(F.octet_length("x")) / 8).alias("_cells")), "solver-sizes")
    small = sizes.where(F.col("_cells") <= task_cells).select("c")
    solved = written(_alone(blocks.join(small, "c"), state.join(small, "c"), d, kind, c, alpha, tol, steps, passes), "solver-alone")
    large = sizes.where(F.col("_cells") > task_cells).select("c")
    if not large.isEmpty():
        own, open_ = blocks.join(large, "c"), state.join(large, "c").select(*state.columns)
        for _ in range(passes):
            open_ = written(_stepped(own, open_, d, kind, c, alpha, tol, steps), "solver-state")
            if open_.where("NOT done").isEmpty():
                break
        solved = solved.unionByName(open_)
    return solved.select("c", "w", "rows", "two", "loss", "steps", "settled")


def _sums(x: np.ndarray, y: np.ndarray, n: np.ndarray, state: dict, kind: str) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Loss, slope and curvature at each tried point of a client's state."""
    w, step = np.array(state["w"]), np.array(state["step"])
    return [logistic_sums(x, y, w - part * step, n) if kind == "logistic" else hinge_sums(x, y, w - part * step, WIDTHS[state["stage"]], n)
            for part in TRIED[kind]]


def _rows(x: bytes, y: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's rows with a last column of ones, labels, and how often each row counts."""
    labels = np.frombuffer(y, "<f8")
    return np.column_stack([np.frombuffer(x, "<f8").reshape(len(labels), -1), np.ones(len(labels))]), labels, np.frombuffer(n, "<f8")


KINDS = [pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.bool_(), pa.float64(), pa.int32()]


def _state_row(state: dict, names: list[str]) -> pa.Table:
    return pa.table([pa.array([state[k]], t) for k, t in zip(names, KINDS, strict=True)], names=names)


def _alone(blocks: DataFrame, state: DataFrame, d: int, kind: str, c: float, alpha: float, tol: float, limit: int | None, passes: int) -> DataFrame:
    """Clients whose rows fit a task, each solved in one by the same steps."""
    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        own = right.to_pylist()[0]
        rows = [_rows(*cells) for cells in zip(*(left.column(k).to_pylist() for k in ("x", "y", "n")), strict=True)]
        x, y, n = (np.concatenate([r[i] for r in rows]) for i in range(3))
        for _ in range(passes):
            own = advance(own, n.sum(), (n * y).sum(), _sums(x, y, n, own, kind), kind, c, alpha, tol, limit)
            if own["done"]:
                break
        return _state_row(own, right.column_names)

    columns = [f.split()[0] for f in STATE.split(", ")]
    left = blocks.select(F.col("c").alias("_c"), "x", "y", "n")  # states come from the blocks: another name for the key
    return left.groupBy("_c").cogroup(state.select(*columns).groupBy("c")).applyInArrow(solve, STATE)


def _stepped(blocks: DataFrame, state: DataFrame, d: int, kind: str, c: float, alpha: float, tol: float, limit: int | None) -> DataFrame:
    """The state one step later."""
    tried, size = len(TRIED[kind]), 1 + (d + 1) + (d + 1) ** 2

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for name, x_, y_, n_, w, step, stage, part in zip(*(batch.column(k).to_pylist() for k in ("c", "x", "y", "n", "w", "step", "stage", "part")), strict=True):
                x, y, n = _rows(x_, y_, n_)
                found = _sums(x, y, n, {"w": w, "step": step, "stage": stage}, kind)
                new = np.concatenate([[n.sum(), (n * y).sum()], *(v for loss, grad, hess in found for v in ([loss], grad, hess.ravel()))])
                held[name, part] = held[name, part] + new if (name, part) in held else new
        for (name, part), v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([v.astype("<f8").tobytes()])], names=["c", "part", "v"])

    def merged(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, "<f8") for v in table.column("v").to_pylist())
        return pa.table({"c": table.column("c")[:1], "part": table.column("part")[:1], "v": pa.array([total.tobytes()])})

    def next_state(left: pa.Table, right: pa.Table) -> pa.Table:
        old = right.to_pylist()[0]
        if left.num_rows:
            v = sum(np.frombuffer(x, "<f8") for x in left.column("v").to_pylist())
            found = [(p[0], p[1:2 + d], p[2 + d:].reshape(d + 1, d + 1)) for p in v[2:].reshape(tried, size)]
            old = advance(old, v[0], v[1], found, kind, c, alpha, tol, limit)
        return _state_row(old, right.column_names)

    # sums of up to 64 tasks are merged per client at once, of more in groups first
    tasks = blocks.rdd.getNumPartitions()
    parts = 1 if tasks <= 64 else 32
    open_ = state.where("NOT done").select("c", "w", "step", "stage")
    met = blocks.join(open_, "c").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(parts)))
    partial = met.mapInArrow(sums, "c string, part int, v binary")
    if parts > 1:
        partial = partial.groupBy("c", "part").applyInArrow(merged, "c string, part int, v binary")
    return partial.groupBy("c").cogroup(state.groupBy("c")).applyInArrow(next_state, STATE)


def combined(solved: DataFrame, share: str = "rows") -> np.ndarray | None:
    """Mean of the clients' weights by ``share``; as long as the model, so the driver takes it. None when nothing has a share."""
    long = solved.select(F.col(share).cast("double").alias("_n"), F.posexplode("w").alias("pos", "v"))
    rows = long.groupBy("pos").agg((F.sum(F.col("_n") * F.col("v")) / F.sum("_n")).alias("v")).collect()
    if not rows or any(r["v"] is None for r in rows):
        return None
    return np.array([r["v"] for r in sorted(rows, key=lambda r: r["pos"])])
