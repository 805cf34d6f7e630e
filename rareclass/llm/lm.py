"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted arrays, memory-mapped (operator 3).

Files below one folder, one per shard: the vocabulary as ascending word hashes with counts (a word's id is its rank over
all shards), bigrams as ascending scrambled keys with counts, and per range of ids what a context and a lower-order
word need. Counting ships packed arrays, one per task and shard, instead of a row per n-gram; shards grow in number with the
text, so no task gathers more than a bounded share, and a frequent word adds one entry per task only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rareclass.llm.shared import bounded_batches, map_array, save_array, scratch
from rareclass.llm.words import hash_words, mix64, pack, pack_sorted, slices, summed, unpack, unpack_sorted

#: ``bytes.lower`` as a table: A-Z only.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Hash of the end token; no word is empty, so it stands for none.
END = mix64(np.zeros(1, dtype=np.uint64) + np.uint64(0xE0D))[0]
_FLUSH = 4_000_000
BLOBS = "shard int, kind int, keys binary, a binary, b binary, c binary, d binary"
SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


class Model(NamedTuple):
    """Where the arrays lie, and the few numbers that every worker needs."""

    folder: str
    shards: int
    first_id: list[int]
    vocabulary: int
    tokens: int
    bigrams: int
    discounts: tuple[float, float, float]
    lower_discounts: tuple[float, float, float]
    lower_spare: float
    pair_shards: frozenset[int]


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the texts in a row (an end token after each) and the tokens per text."""
    words = hash_words(texts, fold=FOLD)
    return np.insert(words.hashes, np.cumsum(words.counts), END), words.counts + 1


def _bits(vocabulary: int) -> int:
    """Bits of a scrambled bigram key: two ids, with one more each for an unknown word or the start of a text."""
    bits = max(8, ((vocabulary + 2) ** 2 - 1).bit_length())
    if bits > 64:
        raise ValueError("over four billion distinct words: bigram keys no longer fit 64 bits")
    return bits


_ODD = 0x9E3779B97F4A7C15


def _scramble(keys: np.ndarray, bits: int, odd: int = _ODD) -> np.ndarray:
    """Multiplication by an odd number modulo 2^bits: a bijection that spreads frequent contexts over all shards."""
    return (keys * np.uint64(odd & ((1 << 64) - 1))) & np.uint64((1 << bits) - 1)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32()] + [pa.binary()] * 5
    rows = [(*r, *[None] * (7 - len(r))) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                                      names=["shard", "kind", "keys", "a", "b", "c", "d"])


def _ranges(keys: np.ndarray, shards: int, bits: int) -> np.ndarray:
    """Where each shard's share of ascending keys begins; shards are equal ranges of [0, 2^bits)."""
    bounds = np.array([(i << bits) // shards for i in range(1, shards)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)]))


def _blobs(keys: np.ndarray, counts: np.ndarray, shards: int, bits: int) -> pa.RecordBatch:
    cut = _ranges(keys, shards, bits)
    return _batch([(s, 0, pack_sorted(keys[a:b]), pack(counts[a:b]))
                   for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a])


def _counted(batches: Iterator[pa.RecordBatch], keys_of, shards: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Count keys per task and ship them shard by shard."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        texts = [t or b"" for t in batch.column("text").to_pylist()]
        for a, b in slices([len(t) for t in texts]):
            keys, counts = np.unique(keys_of(texts[a:b]), return_counts=True)
            held.append((keys, counts))
            size += len(keys)
            if size > _FLUSH:
                held = [summed(*map(np.concatenate, zip(*held, strict=True)))]
                size = len(held[0][0])
                if size > _FLUSH // 2:
                    yield _blobs(*held[0], shards, bits)
                    held, size = [], 0
    if held:
        yield _blobs(*summed(*map(np.concatenate, zip(*held, strict=True))), shards, bits)


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([unpack_sorted(k) for k in table.column("keys").to_pylist()])
    counts = np.concatenate([unpack(c) for c in table.column("a").to_pylist()])
    return summed(keys, counts)


def _small(values: np.ndarray) -> np.ndarray:
    """The narrowest unsigned type that holds the values."""
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


def _lookup(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Positions of keys in a sorted array, -1 where missing."""
    if not len(sorted_keys):
        return np.full(len(keys), -1, dtype=np.int64)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == keys, at, -1)


class _Reader:
    """A worker's view of the model files."""

    def __init__(self, folder: str, shards: int, first_id: list[int]):
        self.folder, self.shards, self.first_id = folder, shards, first_id
        self.maps: dict[str, np.ndarray] = {}

    def array(self, name: str) -> np.ndarray:
        if name not in self.maps:
            self.maps[name] = map_array(self.folder, name)
        return self.maps[name]

    def ids(self, hashes: np.ndarray, unknown: int) -> np.ndarray:
        """Word ids of token hashes."""
        distinct, which = np.unique(hashes, return_inverse=True)
        out = np.full(len(distinct), unknown, dtype=np.int64)
        cut = _ranges(distinct, self.shards, 64)
        for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if b > a and self.first_id[s + 1] > self.first_id[s]:
                at = _lookup(self.array(f"words-{s}"), distinct[a:b])
                out[a:b] = np.where(at >= 0, at + self.first_id[s], unknown)
        return out[which]

    def by_id(self, name: str, ids: np.ndarray) -> np.ndarray:
        """Values of ascending distinct ids from the arrays per range of ids."""
        out = np.zeros(len(ids), dtype=np.int64)
        cut = np.searchsorted(ids, self.first_id)
        for s in range(self.shards):
            a, b = cut[s], cut[s + 1]
            if b > a:
                out[a:b] = self.array(f"{name}-{s}")[ids[a:b] - self.first_id[s]]
        return out

    def bigrams(self, keys: np.ndarray, bits: int, present: frozenset[int]) -> np.ndarray:
        """Counts of ascending scrambled keys; ``present`` names the shards that hold any."""
        out = np.zeros(len(keys), dtype=np.int64)
        cut = _ranges(keys, self.shards, bits)
        for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if b > a and s in present:
                at = _lookup(self.array(f"pairs-{s}"), keys[a:b])
                out[a:b] = np.where(at >= 0, self.array(f"pair_counts-{s}")[at], 0)
        return out


_readers: dict[str, _Reader] = {}


def _reader(folder: str, shards: int, first_id: list[int]) -> _Reader:
    if folder not in _readers:
        _readers.clear()
        _readers[folder] = _Reader(folder, shards, first_id)
    return _readers[folder]


def _context_keys(ids: np.ndarray, sizes: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """(context ids, bigram keys) of token ids; the start of a text is the context ``vocabulary + 1``."""
    context = np.empty_like(ids)
    context[1:] = ids[:-1]
    context[np.cumsum(sizes) - sizes] = vocabulary + 1
    return context, context.astype(np.uint64) * np.uint64(vocabulary + 2) + ids.astype(np.uint64)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts from counts of counts; 0.5, 1 and 1.5 where the counts are too few to tell."""
    if min(n1, n2, n3, n4) > 0:
        y = n1 / (n1 + 2 * n2)
        found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        if all(0.05 <= d <= k - 0.05 for d, k in zip(found, (1, 2, 3), strict=True)):
            return found
    return 0.5, 1.0, 1.5


def train(docs: DataFrame, shard_bytes: int = 16 << 20) -> Model:
    """Count the model on all of ``docs`` (text; null: empty) and write its arrays to the shared folder."""
    spark = docs.sparkSession
    folder = scratch(spark, "lm")
    bounded_batches(spark)
    source = docs.select(F.col("text").cast("binary").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    shards = max(8, -(-size // shard_bytes))

    def words(batches):
        return _counted(batches, lambda texts: _tokens(texts)[0], shards, 64)

    def keep_words(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, counts = _merged(table)
        save_array(folder, f"words-{shard}", keys)
        save_array(folder, f"word_counts-{shard}", _small(counts))
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(keys)], pa.int64()),
                         "total": pa.array([int(counts.sum())], pa.int64())})

    # one row per shard reaches the driver
    sizes = {r["shard"]: r for r in source.mapInArrow(words, BLOBS).groupBy("shard")
             .applyInArrow(keep_words, "shard int, n long, total long").collect()}
    first_id = [0]
    for s in range(shards):
        first_id.append(first_id[-1] + (sizes[s]["n"] if s in sizes else 0))
    vocabulary, tokens = first_id[-1], sum(r["total"] for r in sizes.values())
    bits = _bits(vocabulary)
    inverse = pow(_ODD, -1, 1 << bits)

    def pairs(batches):
        reader = _reader(folder, shards, first_id)

        def keys_of(texts: list[bytes]) -> np.ndarray:
            hashes, sizes_ = _tokens(texts)
            return _scramble(_context_keys(reader.ids(hashes, vocabulary), sizes_, vocabulary)[1], bits)

        return _counted(batches, keys_of, shards, bits)

    bounds = np.array(first_id, dtype=np.int64)

    def keep_pairs(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, counts = _merged(table)
        save_array(folder, f"pairs-{shard}", keys)
        save_array(folder, f"pair_counts-{shard}", _small(counts))
        plain = _scramble(keys, bits, inverse)
        context, word = plain // np.uint64(vocabulary + 2), (plain % np.uint64(vocabulary + 2)).astype(np.int64)
        counts = counts.astype(np.int64)
        by_context = summed(context.astype(np.int64), counts, (counts == 1).astype(np.int64),
                            (counts == 2).astype(np.int64), (counts > 2).astype(np.int64))
        by_word = summed(word, np.ones(len(word), dtype=np.int64))
        rows = [(-1, 0, pack(np.array([(counts == k).sum() for k in (1, 2, 3, 4)])), pack(np.array([shard])))]
        for kind, (ids, *values) in ((1, by_context), (2, by_word)):
            cut = np.searchsorted(ids, bounds)
            cut[-1] = len(ids)  # the start of a text counts as an id of the last range
            rows += [(s, kind, pack_sorted(ids[a:b]), *[pack(v[a:b]) for v in values])
                     for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
        return pa.Table.from_batches([_batch(rows)])

    def keep_stats(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        rows = table.to_pylist()
        if shard < 0:
            found = np.sum([unpack(r["keys"]) for r in rows], axis=0).astype(np.int64)
            present = [int(unpack(r["a"])[0]) for r in rows]
            return pa.table({"kind": pa.array([0], pa.int32()), "n": pa.array([found.tolist() + present])})
        width = first_id[shard + 1] - first_id[shard] + (2 if shard == shards - 1 else 0)
        stats = np.zeros((5, width), dtype=np.int64)
        for r in rows:
            ids = unpack_sorted(r["keys"]).astype(np.int64) - first_id[shard]
            for i, name in enumerate("abcd") if r["kind"] == 1 else ((4, "a"),):
                stats[i][ids] += unpack(r[name]).astype(np.int64)
        for name, values in zip(("total", "n1", "n2", "n3", "before"), stats, strict=True):
            save_array(folder, f"{name}-{shard}", _small(values))
        seen = stats[4]
        found = [int((seen == k).sum()) for k in (1, 2, 3, 4)] + [int((seen > 2).sum()), int(seen.sum())]
        return pa.table({"kind": pa.array([1], pa.int32()), "n": pa.array([found])})

    facts = source.mapInArrow(pairs, BLOBS).groupBy("shard").applyInArrow(keep_pairs, BLOBS) \
        .groupBy("shard").applyInArrow(keep_stats, "kind int, n array<long>").collect()
    high = next((r["n"] for r in facts if r["kind"] == 0), [0] * 4)
    low = np.sum([r["n"] for r in facts if r["kind"] == 1] or [[0] * 6], axis=0).tolist()
    lower = discounts(*low[:4])
    spare = (lower[0] * low[0] + lower[1] * low[1] + lower[2] * low[4]) / low[5] if low[5] else 1.0
    return Model(folder, shards, first_id, vocabulary, tokens, low[5], discounts(*high[:4]), lower, spare,
                 frozenset(high[4:]))


def _discounted(counts: np.ndarray, cut: tuple[float, float, float]) -> np.ndarray:
    off = np.where(counts > 2, cut[2], np.where(counts == 2, cut[1], np.where(counts == 1, cut[0], 0.0)))
    return counts - off


def score(docs: DataFrame, model: Model, held: Column) -> DataFrame:
    """Score every text (doc_id, text; null: empty): see :data:`SCORES`. ``held`` tells held-out rows.

    p(w | v) = (c(vw) - D) / c(v) + spare(v) * q(w), and q(w) the same over the number of distinct words before w, mixed with
    1 / (V + 1) for all words and one unknown word. A context never seen leaves q(w) alone.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = model.vocabulary
        bits = _bits(vocabulary)
        reader = _reader(model.folder, model.shards, model.first_id)
        log_base = math.log10(model.tokens + vocabulary + 1)
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            for a, b in slices([len(t) for t in texts]):
                hashes, sizes = _tokens(texts[a:b])
                ids = reader.ids(hashes, vocabulary)
                context, keys = _context_keys(ids, sizes, vocabulary)
                words, which_word = np.unique(ids, return_inverse=True)
                known = words < vocabulary
                count = np.zeros(len(words), dtype=np.int64)
                before = np.zeros(len(words), dtype=np.int64)
                count[known] = reader.by_id("word_counts", words[known])
                before[known] = reader.by_id("before", words[known])
                low = model.lower_spare / (vocabulary + 1)
                if model.bigrams:
                    low = low + _discounted(before, model.lower_discounts) / model.bigrams
                low = np.broadcast_to(low, len(words))[which_word]
                # contexts: an unknown word has no counts, the start of a text has its own
                seen, which_context = np.unique(context, return_inverse=True)
                ask = seen != vocabulary
                stats = np.zeros((4, len(seen)))
                if vocabulary:
                    for i, name in enumerate(("total", "n1", "n2", "n3")):
                        stats[i][ask] = _context_stat(reader, name, seen[ask])
                total = np.maximum(stats[0], 1)
                spare = np.where(stats[0] > 0, np.dot(model.discounts, stats[1:]) / total, 1.0)
                pairs, which_pair = np.unique(_scramble(keys, bits), return_inverse=True)
                both = _discounted(reader.bigrams(pairs, bits, model.pair_shards), model.discounts)[which_pair] if vocabulary else 0.0
                p = both / total[which_context] + spare[which_context] * low
                first = np.cumsum(sizes) - sizes
                base = np.log10(count + 1.0) - log_base
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a), pa.array(sizes),
                    pa.array(np.add.reduceat((count > 0)[which_word].astype(np.int64), first)),
                    pa.array(np.full(b - a, model.tokens)), pa.array(np.add.reduceat(base[which_word], first)),
                    pa.array(np.add.reduceat(np.log10(p), first))], names=[f.split()[0] for f in SCORES.split(", ")])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"),
                         F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(run, SCORES)


def _context_stat(reader: _Reader, name: str, contexts: np.ndarray) -> np.ndarray:
    """Like ``by_id``, where the last range also holds the start of a text."""
    last = reader.shards - 1
    split = int(np.searchsorted(contexts, reader.first_id[-1]))
    out = np.zeros(len(contexts), dtype=np.int64)
    out[:split] = reader.by_id(name, contexts[:split])
    if split < len(contexts):
        out[split:] = reader.array(f"{name}-{last}")[contexts[split:] - reader.first_id[last]]
    return out


def score_corpus(docs: DataFrame, modulus: int = 7, remainder: int = 2) -> DataFrame:
    """Learn from the documents that are not held out, score all. Only ``doc_id`` and ``text`` are used.

    Null texts are empty (their end token is scored); repeated rows are counted and scored like any other. With nothing to
    learn from, both scores are 0.
    """
    held = held_out(F.col("doc_id"), modulus, remainder)
    return score(docs, train(docs.filter(~held)), held)
