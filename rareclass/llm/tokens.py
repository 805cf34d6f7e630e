"""Token ids of whole texts by a public tokenizer, with a dictionary of words in front of it."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from rareclass.llm.words import hash_words, slices

#: Words of these letters, digits and signs are split, lower-cased and mapped to byte symbols here; all others go to the
#: library as they are. Left out: letters whose lower case is longer or that normalisation changes.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-įı-ňŊ-ž]+")
_LETTER = r"[a-zß-öø-ž]"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|{_LETTER}+|[0-9]|(?:(?!{_LETTER})[^0-9])+")
_KEEP = 2_000_000
_KEEP_PIECES = 150_000


def _byte_symbols() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: bytes with no visible sign get code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class WordTokenizer:
    """Ids of texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)`` of the word-end vocabulary.

    White space always ends a piece there and is dropped, so a text's ids are those of its words in order. Words are
    looked up by a 64-bit hash in a sorted array that the worker keeps; unknown ones are encoded by the library once.
    The dictionaries are emptied when they have outgrown ``_KEEP`` words and ``_KEEP_PIECES`` pieces; that costs time, never
    results.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        symbols = _byte_symbols()
        letters = [chr(c) for c in range(0x21, 0x180)]
        self.symbols = str.maketrans({c: "".join(symbols[b] for b in c.encode()) for c in letters})
        self.pieces: dict[str, bytes] = {}
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.first = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype="<u2")
        self.pieces.clear()

    def word(self, word: str) -> bytes:
        """The ids of one word as little-endian 32-bit integers."""
        if not _PLAIN.fullmatch(word) or "<|" in word:
            return _bytes(self.full.encode(word, add_special_tokens=False).ids)
        pieces = _PIECE.findall(word.lower())
        known = list(map(self.pieces.get, pieces))
        for i, ids in enumerate(known):
            if ids is None:
                ids = _bytes([t.id for t in self.model.tokenize(pieces[i].translate(self.symbols))])
                self.pieces[pieces[i]] = known[i] = ids
        return known[0] if len(known) == 1 else b"".join(known)

    def _learn(self, words: list[str], keys: np.ndarray) -> None:
        if len(self.keys) > _KEEP:
            self.clear()
        if len(self.pieces) > _KEEP_PIECES:
            self.pieces.clear()
        found = list(map(self.word, words))
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        if len(flat) and flat.max() > 0xFFFF:
            self.pool = self.pool.astype("<u4")
        first = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate([self.pool, flat.astype(self.pool.dtype)])
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.first = np.insert(self.first, at, first)
        self.size = np.insert(self.size, at, size)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and how many each text has."""
        words = hash_words(texts)
        if not len(words.hashes):
            return np.zeros(0, dtype="<u2"), np.zeros(len(texts), dtype=np.int64)
        keys, sample, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), dtype=bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        if new.any():
            learn = np.ones(len(keys), dtype=bool) if len(self.keys) > _KEEP else new
            spans = zip(words.starts[sample[learn]].tolist(), words.ends[sample[learn]].tolist(), strict=True)
            self._learn([words.blob[a:b].decode() for a, b in spans], keys[learn])
            at = np.searchsorted(self.keys, keys)
        first, size = self.first[at][which], self.size[at][which]
        ends = np.cumsum(size)
        ids = self.pool[np.repeat(first - ends + size, size) + np.arange(ends[-1])]
        sizes = np.diff(np.concatenate(([0], ends))[np.cumsum(words.counts)], prepend=0)
        return ids, sizes


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per worker process, kept between tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def id_type(path: str, end_id: int) -> str:
    """The narrowest little-endian type that holds every id."""
    return "<u2" if max(tokenizer(path).full.get_vocab_size() - 1, end_id) <= 0xFFFF else "<u4"


def encoded(batch: pa.RecordBatch, path: str, end_id: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Row ranges of a batch with the ids of each row's ``text`` (binary; null: empty), ``end_id`` appended."""
    coder = tokenizer(path)
    texts = [t or b"" for t in batch.column("text").to_pylist()]
    for a, b in slices([len(t) for t in texts]):
        ids, sizes = coder.encode(texts[a:b])
        cuts = np.cumsum(sizes)
        ids = np.insert(ids, cuts, end_id)
        yield a, b, np.split(ids, (cuts + np.arange(1, len(cuts) + 1))[:-1])
