"""Language of words and spans: script ranges narrow the candidates, Viterbi with a switching penalty labels them (operator 5)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rareclass.llm.lm import held_out
from rareclass.llm.shared import annotated, bounded_batches, map_array, save_array, scratch
from rareclass.llm.words import slices

#: Unicode ranges of scripts (public block bounds); a letter outside all of them has script 0.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF),
    ("arabic", 0x750, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F),
    ("gujarati", 0xA80, 0xAFF), ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F), ("kannada", 0xC80, 0xCFF),
    ("malayalam", 0xD00, 0xD7F), ("thai", 0xE00, 0xE7F), ("lao", 0xE80, 0xEFF), ("myanmar", 0x1000, 0x109F),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x2FA1F),
)
NAMES = ["other", *dict.fromkeys(s[0] for s in SCRIPTS)]
BUCKETS = 1 << 16
#: A script is a language's own when it holds this share of its letters.
OWN_SHARE = 0.01
UNKNOWN = "und"
SPANS = "array<struct<start:int,end:int,lang:string>>"
OUT = f"doc_id long, held_out boolean, lang_pred string, score double, spans {SPANS}"
_tables: dict[str, np.ndarray] = {}


class Languages(NamedTuple):
    """Learned languages in order; ``own`` tells which scripts each uses."""

    folder: str
    names: list[str]
    own: list[list[bool]]


def _table(name: str) -> np.ndarray:
    """Per code point: part of a word, lower case (where that is one character), script."""
    if not _tables:
        points = range(0x110000)
        _tables["letter"] = np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in points), bool, 0x110000)
        lower = (chr(c).lower() for c in points)
        _tables["lower"] = np.fromiter((ord(x) if len(x) == 1 else c for c, x in enumerate(lower)), np.uint32, 0x110000)
        script = np.zeros(0x110000, dtype=np.uint8)
        for s, a, b in SCRIPTS:
            script[a:b + 1] = NAMES.index(s)
        _tables["script"] = script
    return _tables[name]


class Letters(NamedTuple):
    """Words of texts: per letter its feature, per word where its letters begin, its place in the text, and its text."""

    bucket: np.ndarray
    script: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray


def letters(texts: list[str]) -> Letters:
    """One feature per letter: a hash of it and its neighbours inside the word. Words are runs of letters and marks."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    joined = "\n".join(texts) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    inside = _table("letter")[code]
    at = np.flatnonzero(inside)
    padded = np.concatenate(([np.uint32(0)], np.where(inside, _table("lower")[code], np.uint32(0)), [np.uint32(0)]))
    h = padded[at] * np.uint32(0x9E3779B1) ^ padded[at + 1] * np.uint32(0x85EBCA77) ^ padded[at + 2] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    bucket = (h * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.cumsum(end - start) - (end - start)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.searchsorted(begin, start, side="right") - 1
    return Letters(bucket.astype(np.int64), _table("script")[code[start]], first, start - begin[text], end - begin[text], text)


def train(docs: DataFrame) -> Languages:
    """Letter features per language over all rows of ``docs`` with a text and a ``lang``; log shares go to the shared folder."""
    folder = scratch(docs.sparkSession, "languages")
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            by_lang: dict[str, list[str]] = {}
            for t, lang in zip(texts, langs, strict=True):
                by_lang.setdefault(lang, []).append(t)
            for lang, own in by_lang.items():
                total = seen.setdefault(lang, np.zeros(BUCKETS + len(NAMES), dtype=np.int64))
                for a, b in slices([len(t) for t in own], 1 << 20):
                    found = letters(own[a:b])
                    total[:BUCKETS] += np.bincount(found.bucket, minlength=BUCKETS)
                    width = np.diff(np.append(found.first, len(found.bucket)))
                    total[BUCKETS:] += np.bincount(found.script, width, len(NAMES)).astype(np.int64)
        for lang, total in seen.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at])],
                                             names=["lang", "bucket", "n"])

    def keep(table: pa.Table) -> pa.Table:
        total = np.zeros(BUCKETS + len(NAMES), dtype=np.int64)
        total[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
        lang = table.column("lang")[0].as_py()
        features = total[:BUCKETS] + 0.5
        save_array(folder, lang.encode().hex() or "empty", np.log(features / features.sum()).astype(np.float32))
        share = total[BUCKETS:] / max(1, total[BUCKETS:].sum())
        return pa.table({"lang": pa.array([lang], pa.string()), "own": pa.array([(share >= OWN_SHARE).tolist()])})

    # one row per language reaches the driver
    rows = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang") \
        .mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")) \
        .groupBy("lang").applyInArrow(keep, "lang string, own array<boolean>").collect()
    rows = sorted(rows, key=lambda r: r["lang"])
    return Languages(folder, [r["lang"] for r in rows], [r["own"] for r in rows])


def best_path(scores: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """Label per word with the largest sum of scores less ``penalty`` per change of label; ``sizes`` words per text.

    A text whose best single label beats every other on each stretch of words up to half a penalty keeps that label: no path can
    win. All other texts step together, longest first. Ties go to staying, then to the first label.
    """
    n_words, n_labels = scores.shape
    first = np.cumsum(sizes) - sizes
    filled = np.flatnonzero(sizes)
    if not n_words:
        return np.zeros(0, dtype=np.int64)
    single = np.add.reduceat(scores, first[filled], axis=0).argmax(axis=1)
    label = np.repeat(single, sizes[filled])
    gain = np.zeros(len(filled))
    own = scores[np.arange(n_words), label]
    for k in range(n_labels):
        run = np.cumsum(scores[:, k] - own)
        before = np.concatenate(([0.0], run[:-1]))
        # lowest running sum so far in the same text: shift texts apart so that one running minimum serves all
        span = (run.max() - run.min() + abs(before).max() + 1) if n_words else 1
        shift = np.repeat(np.arange(len(filled), dtype=np.float64), sizes[filled]) * span
        low = np.minimum.accumulate(before - shift) + shift
        gain = np.maximum(gain, np.maximum.reduceat(run - low, first[filled]))
    todo = filled[gain > penalty / 2 - 1e-6]
    todo = todo[np.argsort(-sizes[todo], kind="stable")]
    if not len(todo):
        return label
    begin, length = first[todo], sizes[todo]
    value = scores[begin].copy()
    back = np.zeros((int(length.sum()), n_labels), dtype=np.int16)
    steps = int(length[0])
    alive = np.searchsorted(-length, -np.arange(steps), side="left")
    place = np.cumsum(length) - length
    stay = np.arange(n_labels)
    for t in range(1, steps):
        k = int(alive[t])
        top = value[:k].argmax(axis=1)
        jump = value[np.arange(k), top] - penalty
        move = jump[:, None] > value[:k]
        back[place[:k] + t] = np.where(move, top[:, None], stay)
        value[:k] = np.where(move, jump[:, None], value[:k]) + scores[begin[:k] + t]
    at = value.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        k = int(alive[t])
        label[begin[:k] + t] = at[:k]
        at[:k] = back[place[:k] + t, at[:k]] if t else at[:k]
    return label


def identify(docs: DataFrame, known: Languages, held: Column, penalty: float = 20.0) -> DataFrame:
    """Spans, language and share of every whole text (doc_id, text): see :data:`OUT`.

    A word's score is the sum of its letters' log shares; languages that do not use its script are out unless none does. The
    language with most letters wins, ties to the first name; ``score`` is its share of the letters, where
    letters in a script that no learned language uses count for none. ``und`` with score 0 for null, texts without a
    letter, or nothing learned.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices([len(t or "") for t in texts], 1 << 20):
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a),
                    *_judged(texts[a:b], known, penalty)], names=["doc_id", "held_out", "lang_pred", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(run, OUT)


def _judged(texts: list[str | None], known: Languages, penalty: float) -> list[pa.Array]:
    """Language, its share of the letters and the spans of each text."""
    table = [map_array(known.folder, n.encode().hex() or "empty") for n in known.names]
    own = np.array(known.own, dtype=bool).reshape(len(known.names), len(NAMES))
    names = np.array([*known.names, UNKNOWN], dtype=object)
    texts = [t or "" for t in texts]
    found = letters(texts)
    rows, labels = len(texts), len(known.names)
    width = np.diff(np.append(found.first, len(found.bucket)))
    some = own.any(axis=0)[found.script] if labels else np.zeros(len(width), dtype=bool)
    best, share = np.full(rows, labels), np.zeros(rows)
    spans: list[list[dict]] = [[] for _ in range(rows)]
    if labels and len(width):
        scores = np.empty((len(width), labels))
        for k, values in enumerate(table):
            scores[:, k] = np.add.reduceat(values[found.bucket].astype(np.float64), found.first)
            scores[~own[k][found.script] & some, k] = -1e4
        scores[~some] = 0.0
        label = best_path(scores, np.bincount(found.text, minlength=rows), penalty)
        counted = np.bincount(found.text * labels + label, np.where(some, width, 0), rows * labels).reshape(rows, -1)
        real = np.array([any(map(str.isalpha, t)) for t in texts])
        total = np.bincount(found.text, width, rows)
        best = np.where(real, counted.argmax(axis=1), labels)
        share = np.where(real, counted.max(axis=1) / np.maximum(total, 1), 0.0)
        shown = np.where(some, label, labels)
        cut = np.flatnonzero(np.concatenate(([True], (shown[1:] != shown[:-1]) | (found.text[1:] != found.text[:-1]))))
        last = np.append(cut[1:], len(shown)) - 1
        for row, s, e, lang in zip(found.text[cut].tolist(), found.start[cut].tolist(), found.end[last].tolist(),
                                   names[shown[cut]], strict=True):
            spans[row].append({"start": s, "end": e, "lang": lang})
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    return [pa.array(names[best], pa.string()), pa.array(share), pa.array(spans, kind)]


def with_language(docs: DataFrame, known: Languages, penalty: float = 20.0) -> DataFrame:
    """All columns of ``docs`` with ``_llm_lang`` and ``_llm_share`` as :func:`identify` gives them."""
    return annotated(docs, [T.StructField("_llm_lang", T.StringType()), T.StructField("_llm_share", T.DoubleType())],
                     lambda texts: _judged(texts, known, penalty)[:2])


def identify_corpus(docs: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """Learn from the rows that are not held out, label all. ``lang`` is only learned from, never an input of a prediction."""
    held = held_out(F.col("doc_id"), modulus, remainder)
    return identify(docs, train(docs.filter(~held)), held)
