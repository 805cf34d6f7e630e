"""Source divergence audit: exact term counts of every (lang, source) group, compared pair by pair and with the whole lang (operator 11)."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rareclass.llm.shared import bounded_batches, scratch, stored
from rareclass.llm.words import slices, summed

UNIT = 1_000_000_000
GROUP = ["lang", "source"]
#: Terms are ASCII letters, in lower case, and everything beyond ASCII; all else ends them.
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
#: Ends the language in front of a term; it is in no term.
_END = "\0"


#: A task writes what it has counted when it holds so many different terms or counts of a group.
_TERMS, _COUNTS = 1 << 19, 1 << 20


class _Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key) -> int:
        self[key] = number = len(self)
        return number


class _Counted:
    """Whole numbers added up by (major, minor) keys; new ones wait until there are many."""

    def __init__(self) -> None:
        self.keys, self.sums, self.parts, self.waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, major: np.ndarray, minor: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((major << 32 | minor, n))
        self.waiting += len(n)
        if self.waiting > _COUNTS:
            self.merge()

    def merge(self) -> int:
        self.keys, self.sums = summed(np.concatenate([self.keys, *(k for k, _ in self.parts)]), np.concatenate([self.sums, *(n for _, n in self.parts)]))
        self.parts, self.waiting = [], 0
        return len(self.keys)


def _split(texts: DataFrame, shards: int, min_docs: int = 10) -> DataFrame:
    """(gid, weight, seen_0, ..., held_0, ...): the terms of many documents at once, with their language in front, dealt to columns by a hash of the term.

    A task counts its documents in bounded portions and writes rows that stand for a portion, not for a document. ``seen``: ``min_docs`` rows, of which a term
    is in as many as the portion has documents with it, in all of them from ``min_docs`` on; so the term is in at least ``min_docs`` rows of the table
    exactly when it is in at least ``min_docs`` documents. ``held``: a row for each group and binary digit of a count, ``weight`` that digit's value, with the
    terms that the group holds a number of times with that digit; so weights over the rows that hold a term add up to its exact count.
    """
    bounded_batches(texts.sparkSession)
    columns = [f"{kind}_{s}" for kind in ("seen", "held") for s in range(shards)]

    def rows(gid: np.ndarray, weight: int, kind: int, terms: pa.Array, shard: np.ndarray, row: np.ndarray, pick: np.ndarray) -> pa.RecordBatch:
        """Row ``row`` of ``gid`` gets term ``pick``, in the column of its shard; rows ascend."""
        lists = [pa.ListArray.from_arrays(pa.array(np.zeros(len(gid) + 1, np.int32)), pa.array([], pa.string()))] * (2 * shards)
        for s in range(shards):
            own = shard[pick] == s
            ends = np.cumsum(np.bincount(row[own], minlength=len(gid)))
            lists[kind * shards + s] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), terms.take(pa.array(pick[own])))
        return pa.RecordBatch.from_arrays([pa.array(gid, pa.int64()), pa.array([weight] * len(gid), pa.int64()), *lists], names=["gid", "weight", *columns])

    def portion(ids: _Numbers, langs: _Numbers, groups: _Numbers, lang_of: dict[int, int], docs: _Counted, counts: _Counted) -> Iterator[pa.RecordBatch]:
        docs.merge(), counts.merge()
        words, fronts = list(ids), [f"{lang}{_END}".encode() for lang in langs]
        major, minor = docs.keys >> 32, docs.keys & 0xFFFFFFFF
        terms = pa.array([fronts[a] + words[b] for a, b in zip(major.tolist(), minor.tolist())], pa.binary()).cast(pa.string())
        shard = np.fromiter((zlib.crc32(t) % shards for t in words), np.int64, len(words))[minor]
        for j in range(min_docs):
            pick = np.flatnonzero(docs.sums > j)
            if len(pick):
                yield rows(np.zeros(1, np.int64), 0, 0, terms, shard, np.zeros(len(pick), np.int64), pick)
        gids = np.array(list(groups), np.int64)
        lang = np.array([lang_of[g] for g in range(len(groups))], np.int64)
        group = counts.keys >> 32
        place = np.searchsorted(docs.keys, lang[group] << 32 | counts.keys & 0xFFFFFFFF)
        for digit in range(int(counts.sums.max(initial=0)).bit_length()):
            own = np.flatnonzero(counts.sums >> digit & 1)
            if len(own):
                named, row = np.unique(group[own], return_inverse=True)
                yield rows(gids[named], 1 << digit, 1, terms, shard, row, place[own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = ids, langs, groups, lang_of, docs, counts = _Numbers(), _Numbers(), _Numbers(), {}, _Counted(), _Counted()
        for batch in batches:
            texts_ = batch.column("text").to_pylist()
            own = np.array([groups[g] for g in batch.column("gid").to_pylist()], np.int64)
            spoken = np.array([langs[x] for x in batch.column("lang").to_pylist()], np.int64)
            lang_of.update(zip(own.tolist(), spoken.tolist()))
            for a, b in slices([len(t) for t in texts_], 1 << 20):
                lists = [t.translate(_FOLD).split() for t in texts_[a:b]]
                sizes = np.array([len(terms) for terms in lists], np.int64)
                key = np.repeat(np.arange(a, b), sizes) << 32 | np.fromiter(map(ids.__getitem__, chain.from_iterable(lists)), np.int64, sizes.sum())
                if not len(key):
                    continue
                key.sort()
                first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                doc, term = key[first] >> 32, key[first] & 0xFFFFFFFF
                docs.add(spoken[doc], term, np.ones(len(first), np.int64))
                counts.add(own[doc], term, np.diff(np.append(first, len(key))))
                if len(ids) > _TERMS or len(counts.keys) > _COUNTS:
                    yield from portion(*held)
                    ids.clear(), docs.__init__(), counts.__init__()
        yield from portion(*held)

    return texts.select("gid", "lang", "text").mapInArrow(run, ", ".join(["gid long", "weight long", *(f"{n} array<string>" for n in columns)]))


def _group_sums(vectors: DataFrame, cells: int) -> DataFrame:
    """(gid, index, n): sparse vectors times their rows' weights, summed per group in whole numbers; tasks hold sums, not dense rows.

    Sums of a task travel as arrays, one for each of ``cells`` parts of the vocabulary, and are merged part by part.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, int] = {}
        keys, sums, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            vector = batch.column("vector")
            lists, values = vector.field("indices"), vector.field("values").flatten().to_numpy()
            own = np.array([groups.setdefault(g, len(groups)) for g in batch.column("gid").to_pylist()], np.int64)
            sizes = lists.value_lengths().to_numpy()
            key = np.repeat(own, sizes) << 32 | lists.flatten().to_numpy().astype(np.int64)
            parts.append((key, values.astype(np.int64) * np.repeat(batch.column("weight").to_numpy(), sizes)))
            waiting += len(key)
            if waiting > 1 << 20:
                keys, sums = summed(np.concatenate([keys, *(k for k, _ in parts)]), np.concatenate([sums, *(n for _, n in parts)]))
                parts, waiting = [], 0
        keys, sums = summed(np.concatenate([keys, *(k for k, _ in parts)]), np.concatenate([sums, *(n for _, n in parts)]))
        names = np.array(list(groups), dtype=np.int64)
        part = (keys & 0xFFFFFFFF) % cells
        for cell in range(cells if len(keys) else 0):
            own = keys[part == cell]
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), *(pa.array([x.astype("<i8").tobytes()]) for x in (
                    names[own >> 32], own & 0xFFFFFFFF, sums[part == cell]))], names=["cell", "gid", "index", "n"])

    def merge(table: pa.Table) -> pa.Table:
        gid, index, n = (np.frombuffer(b"".join(table.column(c).to_pylist()), "<i8") for c in ("gid", "index", "n"))
        order = np.lexsort((index, gid))
        gid, index = gid[order], index[order]
        first = np.flatnonzero(np.concatenate(([True], (gid[1:] != gid[:-1]) | (index[1:] != index[:-1]))))
        return pa.table({"gid": gid[first], "index": index[first], "n": np.add.reduceat(n[order], first)})

    return vectors.select("gid", "weight", "vector").mapInArrow(run, "cell int, gid binary, index binary, n binary") \
        .groupBy("cell").applyInArrow(merge, "gid long, index long, n long")


def term_counts(docs: DataFrame, min_docs: int = 10, shards: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, counts, terms): lang, source, gid of every group; gid, tid, n of every kept term that a group holds; tid, term.

    A lang keeps the terms of at least ``min_docs`` of its documents. A ``CountVectorizer`` without a limit on its vocabulary counts the rows that hold
    a term and gives the exact sparse vector of each row. Its rows stand for portions of many documents and lead to the same terms and sums, see
    :func:`_split`. Terms carry their language, so one fit counts every language apart. Spark keeps a fitted vocabulary on
    the driver, so terms are dealt to ``shards`` fits by a hash: four up to 1 GiB of text, then more with the power 0.6 of it, as vocabularies
    grow. Texts are cut once; each fit reads its columns. Groups and terms travel as numbers.
    """
    spark = docs.sparkSession
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in GROUP],
                        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).withColumn("gid", F.xxhash64(*GROUP))
    groups = stored(texts.select(*GROUP, "gid").distinct(), "divergence-names")
    if groups.count() != groups.select("gid").distinct().count():
        raise RuntimeError("two groups share a 64-bit hash")
    if shards is None:
        size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
        shards = math.ceil(4 * max(1.0, size / 2**30) ** 0.6)
    cut = stored(_split(texts, shards, min_docs), "divergence-terms")
    counts, names = scratch(spark, "divergence-counts"), scratch(spark, "divergence-vocabulary")
    # keeps a vocabulary from being empty, which CountVectorizer refuses
    filler = spark.range(min_docs).select(F.array(F.lit(_END)).alias("terms"))
    for shard in range(shards):
        seen = cut.select(F.col(f"seen_{shard}").alias("terms")).where(F.size("terms") > 0)
        held = cut.select("gid", "weight", F.col(f"held_{shard}").alias("terms")).where(F.size("terms") > 0)
        model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_docs), vocabSize=2**31 - 1).fit(seen.unionByName(filler))
        terms = pa.array(model.vocabulary, pa.string())
        spark.createDataFrame(pa.table({"tid": pa.array(np.arange(len(terms)) + (shard << 32)), "term": terms})) \
            .select("tid", F.substring_index("term", _END, -1).alias("term")).write.parquet(f"{names}/{shard}")
        _group_sums(model.transform(held), max(8, len(terms) // 4096 + 1)).select("gid", (F.col("index") + F.lit(shard << 32)).alias("tid"), "n").write.parquet(f"{counts}/{shard}")
    folders = [str(shard) for shard in range(shards)]
    return (groups, spark.read.schema("gid long, tid long, n long").parquet(*(f"{counts}/{f}" for f in folders)),
            spark.read.schema("tid long, term string").parquet(*(f"{names}/{f}" for f in folders)))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * terms)) by long division in thousands: exact up to totals of 9e15."""
    whole = total + 2 * terms
    left, found = count + 2, F.lit(0).cast("long")
    for _ in range(3):
        found = found * 1000 + _div(left * 1000, whole)
        left = left * 1000 % whole
    return found + 1


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of whole numbers."""
    return F.call_function("div", a, b)


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))."""
    return _div((p - q) * (p - q), p + q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _shared_terms(rows: DataFrame, tile: int, cell_rows: int = 1 << 17) -> DataFrame:
    """(lang, a, b, value), a < b: what the terms that both groups hold add to the value found from each group's own counts.

    Rows are lang, tid (of the term), no (of the group), last (the lang's highest), p, z (the share of a term that the group lacks). Groups are cut into tiles of ``tile`` numbers,
    and a row goes to each pair of tiles that holds its own; terms are cut into cells of about ``cell_rows`` rows. A task sees one cell of one
    pair of tiles and returns a sum per pair of groups, never pairs per term.
    """
    cells = max(1, -(-rows.count() // cell_rows))
    spread = rows.withColumn("_own", _div(F.col("no"), F.lit(tile)).cast("int")) \
        .withColumn("_other", F.explode(F.sequence(F.lit(0), _div(F.col("last"), F.lit(tile)).cast("int")))) \
        .select("lang", F.least("_own", "_other").alias("ta"), F.greatest("_own", "_other").alias("tb"),
                F.pmod(F.xxhash64("tid"), F.lit(cells)).alias("cell"), "tid", "no", "p", "z")

    def found(table: pa.Table) -> pa.Table:
        lang, ta, tb = (table.column(c)[0].as_py() for c in ("lang", "ta", "tb"))
        term, no, p, z = (table.column(c).to_numpy().astype(np.int64) for c in ("tid", "no", "p", "z"))
        order = np.lexsort((no, term))
        term, no, p, z = term[order], no[order], p[order], z[order]
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, step = np.arange(len(term)), 1
        while len(at := at[at + step < len(term)]) and len(at := at[term[at] == term[at + step]]):
            a, b = at, at + step
            if ta != tb:
                other = no[a] // tile != no[b] // tile
                a, b = a[other], b[other]
            value = _gap(p[a], p[b]) - _gap(p[a], z[b]) - _gap(z[a], p[b]) + _gap(z[a], z[b])
            keys, sums = summed(np.concatenate([keys, no[a] << 32 | no[b]]), np.concatenate([sums, value]))
            step += 1
        return pa.table({"lang": pa.array([lang] * len(keys), pa.string()), "a": (keys >> 32).astype(np.int32),
                         "b": (keys & 0xFFFFFFFF).astype(np.int32), "value": sums})

    return spread.groupBy("lang", "ta", "tb", "cell").applyInArrow(found, "lang string, a int, b int, value long") \
        .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10, shards: int | None = None, tile: int = 1024) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each (lang, source) group lies from the other sources of its lang, and by which terms.

    Shares are whole numbers of billionths with two added to every count; see :func:`share` and :func:`gap`. Part ``pair``: the other
    source and the sum of gaps over all kept terms of the lang. Part ``term``: the ``top`` terms that the group holds with a larger share than
    its lang, by gap. Higher values first, ties by item in UTF-8 order.

    A pair's sum is put together from parts: each group's own terms against the other's share of a missing term (from the few distinct
    shares of a group), the terms that both hold, and the number of kept terms times the gap of two missing ones; so no group is
    filled up with the terms that it lacks.

    Null text, lang and source are ''. Groups without kept terms have pairs too; a lang without kept terms has pairs of value 0.
    Repeated rows are documents of their own. Other columns are ignored; an empty table gives no rows.
    """
    groups, counts, terms = term_counts(docs, min_docs, shards)
    totals = counts.groupBy("gid").agg(F.sum("n").alias("total"))
    kept = counts.groupBy("tid").agg(F.min("gid").alias("gid"), F.sum("n").alias("lang_n"))  # any group of the term's lang
    langs = kept.join(groups, "gid").groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    zero = F.lit(0).cast("long")
    known = groups.join(langs, "lang", "left").join(totals, "gid", "left").na.fill(0, ["terms", "lang_total", "total"]) \
        .withColumn("no", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1) \
        .withColumn("last", F.max("no").over(W.partitionBy("lang"))) \
        .withColumn("z", F.when(F.col("terms") > 0, share(zero, F.col("total"), F.col("terms"))).otherwise(1))
    known = stored(known, "divergence-groups")
    shares = stored(counts.join(known, "gid").withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
                    .select("lang", "gid", "tid", "no", "last", "n", "p", "z", "terms", "lang_total"), "divergence-shares")

    against = shares.groupBy("tid").agg(F.sum("n").alias("_n"), F.max("lang_total").alias("_total"), F.max("terms").alias("_terms")) \
        .select("tid", share(F.col("_n"), F.col("_total"), F.col("_terms")).alias("q"))
    best = W.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    # all that tie with the last one stay until their names decide
    near = shares.select("gid", "tid", "p").join(against, "tid").filter("p > q").select("gid", "tid", gap(F.col("p"), F.col("q")).alias("value")) \
        .withColumn("_r", F.rank().over(W.partitionBy("gid").orderBy(F.desc("value")))).filter(F.col("_r") <= top)
    by_term = near.join(terms, "tid").join(groups, "gid").select(*GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), "value") \
        .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)

    own = shares.groupBy("lang", "no", "p").agg(F.count("*").alias("h"))
    mine = known.select("lang", F.col("no").alias("a"), F.col("z").alias("za"), "terms") \
        .join(own.select("lang", F.col("no").alias("a"), "p", "h"), ["lang", "a"], "left")
    other = known.select("lang", F.col("no").alias("b"), F.col("z").alias("zb"))
    both_lack = gap(F.col("za"), F.col("zb"))
    sides = mine.join(other, "lang").filter("a <> b").groupBy("lang", "a", "b", "za", "zb", "terms").agg(
        F.coalesce(F.sum(F.col("h") * (gap(F.col("p"), F.col("zb")) - both_lack)), zero).alias("side")) \
        .select("lang", "a", "b", (F.col("side") + F.when(F.col("a") < F.col("b"), F.col("terms") * both_lack).otherwise(0)).alias("value"))
    parts = sides.unionByName(_shared_terms(shares.select("lang", "tid", "no", "last", "p", "z"), tile))
    ordered = parts.unionByName(parts.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")) \
        .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    by_pair = ordered.join(known.select("lang", F.col("no").alias("a"), "source"), ["lang", "a"]) \
        .join(known.select("lang", F.col("no").alias("b"), F.col("source").alias("item")), ["lang", "b"]) \
        .select(*GROUP, F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(best))
    return by_pair.unionByName(by_term)
