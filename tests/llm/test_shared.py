"""Texts reach a judge in slices of bounded size, whatever the Arrow batch holds."""

import pyarrow as pa
from pyspark.sql import types as T

from rareclass.llm.shared import annotated


def test_batches_are_judged_in_slices(spark):
    rows = [(i, "ab " * 50_000, i % 3) for i in range(60)] + [(60, None, None), (61, "", 1), (62, "x" * 3_000_000, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int").coalesce(1)

    def judge(texts):
        return [pa.array([sum(len(t or "") for t in texts)] * len(texts), pa.int64())]

    out = annotated(docs, [T.StructField("_seen", T.LongType())], judge).collect()
    assert sorted((r["doc_id"], r["text"], r["extra"]) for r in out if r["doc_id"] != 60) == sorted(r for r in rows if r[0] != 60)
    assert max(r["_seen"] for r in out if r["doc_id"] != 62) <= 1 << 20
    assert [r["_seen"] for r in out if r["doc_id"] == 62] == [3_000_000]
