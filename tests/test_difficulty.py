"""The difficulty summary makes what several measures read once, and equals the measures taken one by one."""

import numpy as np
import pytest

from rareclass.operators import separability as g
from rareclass.operators.splits import balanced_subsample
from rareclass.plans.difficulty import difficulty_summary


def test_shared_tables_are_made_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 6 == 0), [float(v) for v in rng.normal(size=4) + (i % 6 == 0)]) for i in range(240)]
    df = spark.createDataFrame(rows, "row_id long, label int, features array<double>")
    plans = []

    def watched(name):
        real = getattr(g, name)

        def run(given, *more):
            plans.append(given._jdf.queryExecution().optimizedPlan().toString())
            return real(given, *more)
        monkeypatch.setattr(g, name, run)

    want = {"n1": g.n1_boundary, "n2": g.n2_ratio, "n3": g.n3_error}
    balanced = balanced_subsample(df, None)
    want = {k: f(balanced).first()[k] for k, f in want.items()}
    for name in ("n1_boundary", "n2_ratio", "n3_error"):
        watched(name)
    got = difficulty_summary(df, "x", width=2)
    assert [t for _, t in got.dtypes] == ["string", *["double"] * 11] and got.count() == 1
    got = got.first()
    assert got["dataset"] == "x" and all(got[k] == pytest.approx(v, abs=1e-12) for k, v in want.items())
    assert len(plans) == 4 and not any("Join" in p for p in plans)
