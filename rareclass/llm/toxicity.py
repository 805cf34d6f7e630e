"""Toxicity: a learned lexicon, misspellings by Levenshtein automata on its trie, and scores of the words around (operator 8)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rareclass.llm.lm import held_out
from rareclass.llm.shared import annotated, bounded_batches
from rareclass.llm.words import SPACE, hash_words, slices

#: Words end at white space and at these signs; others (such as ``*``, ``@``, ``$`` and digits) stay, as they disguise letters.
BREAKS = SPACE.copy()
BREAKS[list(b'.,;:!?"()[]{}<>|/\\`')] = True
QUOTES = "“”„«»"
#: Words that point at the reader, and words that report what others said; English, German, French, Spanish.
ADDRESS = ("you", "your", "you're", "youre", "u", "ur", "du", "dein", "deine", "ihr", "euch", "tu", "toi", "vous", "votre", "ton", "tú", "tus", "usted")
REPORT = ("said", "says", "say", "quote", "quoted", "called", "calls", "wrote", "term", "word", "sagte", "sagt", "zitat", "schrieb", "wort",
          "dit", "disait", "cité", "écrit", "mot", "dijo", "dice", "cita", "escribió", "palabra")
#: Signs that are cut from the ends of a word before it is matched.
EDGE = "#%&$*=+~^'-_@’"
WINDOW = 5
MIN_FUZZY = 5
_KEEP = 1_000_000
FEATURES = ("plain", "quoted", "misspelled", "strongest", "weight", "density", "address", "report")
OUT = "doc_id long, held_out boolean, score double, predicted int"
_QUOTE = ord('"')


class Toxicity(NamedTuple):
    """Lexicon terms with their log odds, words that look like a term but are not one, and the weights of the features."""

    terms: list[str]
    odds: list[float]
    spared: list[str]
    weights: list[float]


class Trie:
    """The lexicon as nested dictionaries; the key None holds the term's number."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.root: dict = {}
        for i, term in enumerate(terms):
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[None] = i
        self.near = {t for term in terms if len(term) >= MIN_FUZZY for t in (term, *_shorter(term))}
        self.exact = {t: i for i, t in enumerate(terms)}

    def match(self, word: str) -> tuple[int, int]:
        """(term, edits) of the nearest term within one edit, (-1, 0) if there is none; edits swap, add, drop or change a letter.

        The automaton of the word is run along the trie: a state is, for each place in the word, the fewest edits to get
        there (two at most kept apart), and branches whose state is dead are left. A set of shortened terms answers most words first.
        """
        found = self.exact.get(word)
        if found is not None:
            return found, 0
        if len(word) < MIN_FUZZY - 1 or not (word in self.near or any(s in self.near for s in _shorter(word))):
            return -1, 0
        best: list[int] = []
        stack = [(self.root, list(range(len(word) + 1)), None, "")]
        while stack:
            node, state, older, letter = stack.pop()
            for c, child in node.items():
                if c is None:
                    if state[-1] <= 1 and len(self.terms[child]) >= MIN_FUZZY:
                        best.append(child)
                    continue
                new = [state[0] + 1]
                for j, w in enumerate(word):
                    cost = min(new[j] + 1, state[j + 1] + 1, state[j] + (w != c))
                    if older is not None and j and w == letter and word[j - 1] == c:
                        cost = min(cost, older[j - 1] + 1)
                    new.append(cost)
                if min(new) <= 1:
                    stack.append((child, new, state, c))
        return (min(best), 1) if best else (-1, 0)


def _shorter(word: str) -> Iterator[str]:
    return (word[:i] + word[i + 1:] for i in range(len(word)))


def _clean(text: str | None) -> bytes:
    text = (text or "").lower()
    for q in QUOTES:
        if q in text:
            text = text.replace(q, '"')
    return text.encode("utf-8", "replace")


class Matcher:
    """Numbers of words, looked up by hash in a sorted array: term number, misspelling, address or report cue."""

    NONE, ADDRESS, REPORT = -1, -2, -3

    def __init__(self, terms: list[str], spared: list[str]):
        self.trie = Trie(terms)
        self.fixed = {w: (self.NONE, 0) for w in spared} | {w: (self.ADDRESS, 0) for w in ADDRESS} | {w: (self.REPORT, 0) for w in REPORT}
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.term = np.zeros(0, dtype=np.int32)
        self.edits = np.zeros(0, dtype=np.int8)

    def look(self, word: str) -> tuple[int, int]:
        word = word.strip(EDGE)
        found = self.trie.exact.get(word)
        if found is not None:
            return found, 0
        return self.fixed.get(word) or self.trie.match(word)

    def numbers(self, words) -> tuple[np.ndarray, np.ndarray]:
        """(term, edits) of every word of the texts."""
        keys, sample, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        if len(self.keys) > _KEEP:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), dtype=bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        if new.any():
            spans = zip(words.starts[sample[new]].tolist(), words.ends[sample[new]].tolist(), strict=True)
            found = np.array([self.look(words.blob[a:b].decode("utf-8", "replace")) for a, b in spans], dtype=np.int32)
            at = np.searchsorted(self.keys, keys[new])
            self.keys = np.insert(self.keys, at, keys[new])
            self.term, self.edits = np.insert(self.term, at, found[:, 0]), np.insert(self.edits, at, found[:, 1])
            at = np.searchsorted(self.keys, keys)
        return self.term[at][which], self.edits[at][which]


class Hits(NamedTuple):
    """Lexicon hits: text, word range in the cleaned text, term, edits, in quotes, cues within the window."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    term: np.ndarray
    edits: np.ndarray
    quoted: np.ndarray
    address: np.ndarray
    report: np.ndarray
    n_words: np.ndarray


def hits_of(texts: list[bytes], matcher: Matcher) -> Hits:
    words = hash_words(texts, BREAKS)
    row = np.repeat(np.arange(len(texts)), words.counts)
    if not len(row):
        none = np.zeros(0, dtype=np.int64)
        return Hits(none, none, none, none, none, none.astype(bool), none, none, words.counts)
    term, edits = matcher.numbers(words)
    at = np.flatnonzero(term >= 0)
    first = (np.cumsum(words.counts) - words.counts)[row[at]]
    last = np.cumsum(words.counts)[row[at]]
    low, high = np.maximum(at - WINDOW, first), np.minimum(at + WINDOW + 1, last)

    def around(cue: int) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(term == cue)))
        return total[high] - total[low]

    marks = np.flatnonzero(np.frombuffer(words.blob, np.uint8) == _QUOTE)
    begin = (np.cumsum([len(t) + 1 for t in texts]) - [len(t) + 1 for t in texts])[row[at]]
    before = np.searchsorted(marks, words.starts[at]) - np.searchsorted(marks, begin)
    return Hits(row[at], words.starts[at] - begin, words.ends[at] - begin, term[at], edits[at], before % 2 == 1,
                around(Matcher.ADDRESS), around(Matcher.REPORT), words.counts)


def features(hits: Hits, odds: np.ndarray, rows: int) -> np.ndarray:
    """One row of :data:`FEATURES` per text. A hit in quotes or near a reporting word counts as quoted, not as plain."""
    def total(weight: np.ndarray) -> np.ndarray:
        return np.bincount(hits.row, weight, rows)

    value = odds[hits.term] if len(hits.row) else np.zeros(0)
    said = hits.quoted | (hits.report > hits.address)
    strongest = np.zeros(rows)
    np.maximum.at(strongest, hits.row, value)
    plain = total(~said & (hits.edits == 0))
    return np.stack([np.log1p(plain), np.log1p(total(said)), np.log1p(total(hits.edits > 0)), strongest, np.log1p(total(value)),
                     np.log1p(100 * total(np.ones(len(hits.row))) / np.maximum(hits.n_words, 1)),
                     np.log1p(total(hits.address)), np.log1p(total(hits.report))], axis=1)


def choose_terms(counts: list[tuple[str, int, int]], toxic: int, clean: int, evidence: float = 10.0,
                 ratio: float = 8.0) -> tuple[list[str], list[float]]:
    """Words that toxic training texts hold far more often: ``counts`` has (word, toxic texts, clean texts) of candidates.

    The log-likelihood ratio must reach ``evidence`` and the rates differ by ``ratio``; strongest first, ties by word.
    """
    share = toxic / max(1, toxic + clean)
    found = []
    for word, a, b in counts:
        n = a + b
        llr = sum(x * math.log(x / (n * s)) for x, s in ((a, share), (b, 1 - share)) if x and s > 0)
        odds = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
        if llr >= evidence and odds >= math.log(ratio):
            found.append((-odds, word))
    found.sort()
    return [w for _, w in found], [-o for o, _ in found]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, tolerance: float = 1e-10) -> np.ndarray:
    """Penalised logistic weights (the last is the constant) by Newton steps with halving, to convergence."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(x.shape[1], ridge)
    w = np.zeros(x.shape[1])

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * (penalty * v * v).sum())

    now = loss(w)
    while True:
        p = 1 / (1 + np.exp(-np.clip(x @ w, -700, 700)))
        gradient = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), gradient)
        size = 1.0
        while size > 1e-12 and loss(w - size * step) > now:
            size /= 2
        after = loss(w - size * step)
        if size <= 1e-12 or now - after <= tolerance * (1 + abs(now)):
            return w if size <= 1e-12 else w - size * step
        w, now = w - size * step, after


def learn(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Toxicity:
    """Lexicon and weights from labelled documents (labels: doc_id, toxic).

    About ``sample`` rows of each label at most are used, chosen by a hash of the id; that bounds the broadcast ids, the candidate words
    and the feature rows that the driver sees. Equal texts count once. Without both labels nothing is learned.
    """
    known = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("_toxic")).distinct()
    sizes = {r["_toxic"]: r["n"] for r in known.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Toxicity([], [], [], [])
    share = F.when(F.col("_toxic") == 1, F.lit(sample / sizes[1])).otherwise(F.lit(sample / sizes[0]))
    chosen = known.filter(F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    # bounded by 2 * sample rows of two numbers
    texts = docs.join(F.broadcast(chosen), "doc_id").select("text", "_toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("_toxic").to_pylist(), strict=True):
                for word in {w.strip(EDGE) for w in _clean(text).translate(_TO_SPACE).decode("utf-8", "replace").split(" ")} - {""}:
                    seen.setdefault(word, [0, 0])[1 - toxic] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()),
                                          pa.array([v[1] for v in seen.values()], pa.int64())], names=["word", "a", "b"])

    texts = texts.groupBy(F.md5("text").alias("_key")).agg(F.first("text").alias("text"), F.max("_toxic").alias("_toxic"))
    totals = {r["_toxic"]: r["n"] for r in texts.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    words = texts.mapInArrow(count, "word string, a long, b long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # candidates: seen in 3 toxic texts, and in toxic ones at least as large a share as in clean ones
    rows = words.filter((F.col("a") >= 3) & (F.col("a") * max(clean, 1) >= 2 * F.col("b") * max(toxic, 1))).collect()
    terms, odds = choose_terms([(r["word"], r["a"], r["b"]) for r in rows], toxic, clean)
    trie = Trie(terms)
    alike = F.col("word").isin([w for w in ADDRESS + REPORT])
    shared = _near_words(words.filter(~alike & (F.col("b") >= 2)), terms)
    spared = sorted(r["word"] for r in shared.collect() if trie.match(r["word"])[0] >= 0 and r["word"] not in trie.exact)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms, spared)
        values = np.array(odds)
        for batch in batches:
            own = [_clean(t) for t in batch.column("text").to_pylist()]
            for a, b in slices([len(t) for t in own]):
                table = features(hits_of(own[a:b], matcher), values, b - a)
                yield pa.RecordBatch.from_arrays([batch.column("_toxic").slice(a, b - a), pa.array(list(table))], names=["y", "x"])

    fitted = texts.mapInArrow(measure, "y int, x array<double>").collect()
    x = np.array([r["x"] for r in fitted]).reshape(len(fitted), len(FEATURES))
    order = np.lexsort(x.T)
    weights = fit_logistic(x[order], np.array([r["y"] for r in fitted], dtype=float)[order])
    return Toxicity(terms, odds, spared, weights.tolist())


_TO_SPACE = bytes(32 if BREAKS[i] else i for i in range(256))


def _near_words(words: DataFrame, terms: list[str]) -> DataFrame:
    """Words within one edit of a term, by running the automaton over the sample's words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(terms)
        for batch in batches:
            own = batch.column("word").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([w for w in own if trie.match(w)[1]], pa.string())], names=["word"])
    return words.select("word").mapInArrow(run, "word string")


_matchers: dict[tuple, Matcher] = {}


def _matcher(model: Toxicity) -> Matcher:
    key = (tuple(model.terms), tuple(model.spared))
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(model.terms, model.spared)
    return _matchers[key]


def score(docs: DataFrame, model: Toxicity, held: Column) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text; null texts are empty. Nothing learned: score 0."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices([len(t or "") for t in texts]):
                p = _scores(texts[a:b], model)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a), pa.array(p),
                    pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(run, OUT)


def _scores(texts: list[str | None], model: Toxicity) -> np.ndarray:
    if not model.weights:
        return np.zeros(len(texts))
    weights = np.array(model.weights)
    table = features(hits_of([_clean(t) for t in texts], _matcher(model)), np.array(model.odds), len(texts))
    return 1 / (1 + np.exp(-np.clip(table @ weights[:-1] + weights[-1], -700, 700)))


def with_toxicity(docs: DataFrame, model: Toxicity) -> DataFrame:
    """All columns of ``docs`` with ``_llm_toxicity``, the score."""
    return annotated(docs, [T.StructField("_llm_toxicity", T.DoubleType())], lambda texts: [pa.array(_scores(texts, model))])


def find_terms(docs: DataFrame, model: Toxicity) -> DataFrame:
    """One row per hit: doc_id, byte range in the lower-cased UTF-8 text, term, edits, quoted, address and report cues around."""
    schema = "doc_id long, start long, end long, term string, edits int, quoted boolean, address int, report int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(model)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids = batch.column("doc_id").to_pylist()
            for a, b in slices([len(t or "") for t in texts]):
                h = hits_of([_clean(t) for t in texts[a:b]], matcher)
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[a + r] for r in h.row], pa.int64()), pa.array(h.start, pa.int64()), pa.array(h.end, pa.int64()),
                    pa.array([model.terms[t] for t in h.term], pa.string()), pa.array(h.edits, pa.int32()), pa.array(h.quoted, pa.bool_()),
                    pa.array(h.address, pa.int32()), pa.array(h.report, pa.int32())], names=[f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def score_corpus(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """Learn from labels of rows that are not held out, score all documents."""
    held = held_out(F.col("doc_id"), modulus, remainder)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = learn(plain.filter(~held), labels.filter(~held))
    return score(plain, model, held)
