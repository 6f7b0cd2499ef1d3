"""Words of a column of texts as NumPy arrays.

A text column arrives from Spark as an Arrow array, i.e. one buffer of UTF-8
bytes and one of offsets.  All word classes used here are decided by single
bytes (every byte of a non-ASCII character is >= 0x80), so words are found
and hashed for a whole block of documents at once, without a Python object
per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1          # odd, so it has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)
_SLICE = 1 << 19                        # bytes hashed at a time (tables stay in cache)

#: space and tab .. carriage return separate words
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII letters and digits (after lower-casing) and all non-ASCII characters
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit value over all bits (bijective)."""
    h = h ^ (h >> U64(31))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(29))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(32))


_tables: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``_BASE**i`` and its inverse modulo 2**64 for i < n."""
    have = _tables.get("p")
    if have is None or len(have) < n:
        size = max(n, _SLICE + 1024)
        steps = np.full(size, _BASE, U64)
        steps[0] = 1
        _tables["p"] = np.multiply.accumulate(steps)
        steps[1:] = _BASE_INV
        _tables["q"] = np.multiply.accumulate(steps)
    return _tables["p"], _tables["q"]


@dataclass
class Words:
    """Words of a block of documents, in text order."""

    data: np.ndarray     # bytes of the block (lower-cased if asked for)
    start: np.ndarray    # first byte of each word
    end: np.ndarray      # byte after each word
    hash: np.ndarray     # 64-bit hash of each word
    first: np.ndarray    # index of each document's first word, plus the total at the end

    @property
    def n_docs(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts())


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (starting at 0) of a string or binary column; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None and len(column) \
        else np.zeros(0, np.uint8)
    return data, offsets - (offsets[0] if len(offsets) else 0)


def blocks(column: pa.Array, limit: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Row ranges of ``column`` with about ``limit`` bytes of text each (a
    longer text is a range of its own)."""
    _, offsets = buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(column: pa.Array, is_word: np.ndarray = SPACE_WORDS, lower: bool = False) -> Words:
    data, offsets = buffers(column)
    if lower:
        data = _LOWER[data]
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(data, z, z, np.zeros(0, U64), np.zeros(len(offsets), np.int64))
    w = is_word[data]
    begins, ends = w.copy(), w.copy()
    begins[1:] &= ~w[:-1]
    ends[:-1] &= ~w[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]       # a word never crosses documents
    begins[cut] = w[cut]
    ends[cut - 1] = w[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, start, end, _hash(data, start, end), np.searchsorted(start, offsets))


def _hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of every byte range, from prefix sums modulo 2**64.
    The data is taken in slices that begin at a word; a word longer than a
    slice makes its slice longer."""
    out = np.empty(len(start), U64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _SLICE, "right")))
        lo, hi = int(start[i]), int(end[j - 1])
        p, q = powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, U64)
        np.cumsum((data[lo:hi].astype(U64) + U64(1)) * p[:hi - lo], out=total[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = (total[e] - total[s]) * q[s]
        i = j
    return mix(out)


def phrase_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive words (``len(h) - k + 1`` values,
    including phrases that cross documents: the caller drops those)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = h[:n].copy()
    for i in range(1, k):
        total *= U64(_BASE)
        total += h[i:n + i]
    return mix(total)
