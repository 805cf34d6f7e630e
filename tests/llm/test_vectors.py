"""Near-duplicate vectors and components against brute force."""

import numpy as np
from pyspark.sql import functions as F

from rareclass.llm.components import components
from rareclass.llm.vectors import near_vectors, plan_tables

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.95):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v, _ in rows
            if i is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, dtype=np.float32)).all() and np.any(v)]
    links = {i: set() for i, *_ in rows}
    for x, (i, u) in enumerate(good):
        for j, v in good[x + 1:]:
            if len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= threshold:
                links[i].add(j)
                links[j].add(i)
    root = {}
    for start in sorted(i for i in links if i is not None):
        if start in root:
            continue
        stack = [start]
        while stack:
            k = stack.pop()
            if k not in root:
                root[k] = start
                stack += links[k]
    return {i: (len(links[i]), root[i], root[i] == i) for i in root}


def make(seed=5):
    rng = np.random.default_rng(seed)
    rows, at = [], 0
    for group in (1, 1, 2, 5, 40, 90):
        for _ in range(6 if group < 40 else 1):
            centre = rng.standard_normal(24)
            for _ in range(group):
                rows.append((at, (centre + 0.17 * rng.standard_normal(24)).tolist(), 0))
                at += 1
    copy = rng.standard_normal(24).tolist()
    rows += [(at + k, copy, k) for k in range(30)]
    at += 30
    chain = rng.standard_normal(24)
    step = rng.standard_normal(24) * 0.25
    rows += [(at + k, (chain + k * step).tolist(), 1) for k in range(12)]
    at += 12
    rows += [(at, None, 1), (at + 1, [0.0] * 24, 1), (at + 2, [1.0, None] * 12, 1), (at + 3, [float("nan")] + [1.0] * 23, 1),
             (at + 4, [float("inf")] + [1.0] * 23, 1), (at + 5, [], 1), (at + 6, [1.0, 2.0], 1), (at + 7, [1.0, 2.0001], 1),
             (at + 8, [-0.0, 1.0], None), (at + 9, [0.0, 1.0], None)]
    return rows


def test_against_brute_force(spark):
    rows = make()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_links", F.lit("x")).withColumn("component_id", F.lit(1.5))
    for block in (1024, 16):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(df, block_rows=block).collect()}
        assert got == brute(rows)


def test_empty_and_null_ids(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    got = near_vectors(spark.createDataFrame([(None, [1.0], 1), (3, [1.0], 1)], SCHEMA)).collect()
    assert sorted((r["vec_id"] or -1, r["n_links"], r["kept"]) for r in got) == [(-1, 0, False), (3, 0, True)]


def test_recall_plan():
    for rows in (10, 10_000, 10**9):
        bits, tables = plan_tables(rows, 0.95)
        agree = (1 - np.arccos(0.95) / np.pi) ** bits
        assert 1 - (1 - agree) ** tables >= 0.9999


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(k, k + 1) for k in range(500, 560)] \
        + [(1000, 1000 + k) for k in range(1, 50)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    assert got == {n: find(n) for n in list(parent)}
