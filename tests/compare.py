"""Run registered queries and their SQL side by side: ``python tests/compare.py sf_dir [name-part ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def canonical(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return f"b{v}"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"f{v + 0.0!r}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canonical(x) for x in v) + "]"
    if isinstance(v, int):
        return f"i{v}"
    return f"{type(v).__name__[0]}{v}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, query, sql):
    """(ok, note) for one query."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return (len(got[1]) > 0, f"{len(got[1])} rows, no SQL")
    res = con.execute(sql)
    want = rows_of([d[0] for d in res.description], res.fetchall())
    if got[0] != want[0]:
        return (False, f"columns {got[0]} != {want[0]}")
    if got[1] == want[1]:
        return (len(got[1]) > 0, f"{len(got[1])} rows")
    a, b = set(got[1]), set(want[1])
    return (False, f"spark {len(got[1])} rows, sql {len(want[1])} rows\n   cols  {got[0]}\n   spark {sorted(a - b)[:3]}\n   sql   {sorted(b - a)[:3]}")


def main():
    from rareclass.session import build_session
    from suite import all_oracles, all_queries
    sf_dir, parts = sys.argv[1], sys.argv[2:]
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g",
                                         "spark.ui.enabled": "false",
                                         "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = all_queries(), all_oracles()
    bad = 0
    for name, query in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            ok, note = compare(spark, con, sf_dir, query, oracles.get(name))
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{bad} failing")
    spark.stop()


if __name__ == "__main__":
    main()
