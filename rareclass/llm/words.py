"""Vectorised work on words: splitting, 64-bit hashes and compact blobs of integer arrays."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa


def _give_back() -> None:
    """Arrays of over 1 MB return to the system when they are freed, so that a worker that is kept does not hold its largest batch."""
    if sys.platform == "linux":
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    pa.set_memory_pool(pa.system_memory_pool())


_give_back()

#: Bytes that end a word: space and \x09-\x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BLOCK = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Words(NamedTuple):
    """Words of a list of texts: hashes, byte ranges in ``blob`` and the number of words of each text."""

    blob: bytes
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        size = max(n, _BLOCK + 4096)
        _tables["up"], _tables["down"] = _powers(_STEP, size), _powers(_BACK, size)
    return _tables["up"], _tables["down"]


def hash_words(texts: list[bytes], breaks: np.ndarray = SPACE, fold: np.ndarray | None = None) -> Words:
    """Words of UTF-8 texts. ``breaks`` tells which bytes end a word, ``fold`` maps bytes before hashing.

    A word's hash depends on its bytes alone: a sum of random byte codes times powers of an odd number (mod 2^64),
    scrambled. Work goes in blocks of about 1 MB, cut between words, so a very long text needs no more memory.
    """
    if not texts:
        none = np.zeros(0, dtype=np.int64)
        return Words(b"", np.zeros(0, dtype=np.uint64), none, none, none)
    blob = b"\n".join(texts) + b"\n"
    data = np.frombuffer(blob, dtype=np.uint8)
    codes = _BYTE if fold is None else _BYTE[fold]
    hashes, starts, ends = [], [], []
    at = 0
    while at < len(data):
        end = min(at + _BLOCK, len(data))
        while end < len(data) and not breaks[data[end - 1]]:
            ahead = np.flatnonzero(breaks[data[end:end + 4096]])
            end = end + int(ahead[0]) + 1 if len(ahead) else min(end + 4096, len(data))
        part = data[at:end]
        gap = breaks[part]
        edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=np.int8(1)))
        first, last = edge[0::2], edge[1::2]
        up, down = _power_tables(len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(codes[part] * up[:len(part)], out=total[1:])
        hashes.append(mix64((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64)))
        starts.append(first + at)
        ends.append(last + at)
        at = end
    starts_all = np.concatenate(starts)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts_all, bounds), prepend=0)
    return Words(blob, np.concatenate(hashes), starts_all, np.concatenate(ends), counts)


def slices(sizes: list[int], budget: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``budget`` units of size each; a longer row stands alone."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > budget:
            yield start, i
            start, total = i, 0
        total += size
    if sizes:
        yield start, len(sizes)


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as planes of bytes, only as many planes as the largest value needs."""
    values = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned integers as packed differences."""
    values = np.asarray(values, dtype=np.uint64)
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def summed(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, with the sums of their weights."""
    if not len(keys):
        return (keys, *weights)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return (keys[first], *(np.add.reduceat(w[order], first) for w in weights))
