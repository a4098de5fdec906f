"""Texts of an Arrow batch as one byte array: words, word hashes and window hashes, vectorised.

Words are the runs of bytes other than 0x20 and 0x09-0x0D. Hashes are polynomials over 64 bits
with random letters, finished by a mixing step; whoever uses them as evidence confirms it on the
words themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_LETTERS = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_SPAN = 1 << 18  # bytes hashed at a time: each takes some 32 bytes of memory meanwhile
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """``base ** i`` for ``i < n``, modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, 1 << 16)
        known = np.full(size, base, np.uint64)
        known[0] = 1
        known = _powers[base] = np.multiply.accumulate(known)
    return known[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Texts:
    """A string column: ``data`` holds all bytes, text ``i`` lies at ``offsets[i]:offsets[i+1]``.

    Null texts are empty. ``lower`` maps A-Z to a-z and nothing else.
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        column = column.cast(pa.large_binary())
        if column.null_count:
            column = column.fill_null(b"")
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        raw = raw[ends[0]:ends[-1]]
        self.data = LOWER[raw] if lower else raw
        self.offsets = ends - ends[0]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self) -> Words:
        return Words(self)


class Words:
    """Word ``j`` lies at ``starts[j]:ends[j]``; text ``i`` has words ``first[i]:first[i+1]``."""

    def __init__(self, texts: Texts):
        self.texts = texts
        n = len(texts.data)
        letter = ~BLANK[texts.data]
        opens, closes = letter.copy(), letter.copy()
        opens[1:] &= ~letter[:-1]
        closes[:-1] &= ~letter[1:]
        inner = texts.offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        opens[inner] = letter[inner]
        closes[inner - 1] = letter[inner - 1]
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, texts.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """Text number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self), np.uint64)
        at = 0
        while at < len(self):
            begin = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, begin + _SPAN)))
            part = self.texts.data[begin:self.ends[to - 1]]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_LETTERS[part] * _power(_BASE, len(part)), out=sums[1:])
            s, e = self.starts[at:to] - begin, self.ends[at:to] - begin
            out[at:to] = mixed((sums[e] - sums[s]) * _power(_INVERSE, len(part) + 1)[s]
                               + (e - s).astype(np.uint64))
            at = to
        return out

    def strings(self) -> pa.Array:
        """All words as one Arrow array (a copy of the words' bytes)."""
        return slices(self.texts.data, self.starts, self.ends)


    def numbers(self) -> np.ndarray:
        """A number for each word, equal for equal words only (within this object)."""
        return self.strings().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number for each pair ``left[i], right[i]``, equal for equal pairs only."""
    if not len(left):
        return left
    return np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1]


def slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """``data[starts[j]:ends[j]]`` as a large_string array; spans are ordered and disjoint."""
    bounds = np.empty(2 * len(starts) + 1, np.int64)
    bounds[0:-1:2], bounds[1::2] = starts, ends
    bounds[-1] = ends[-1] if len(ends) else 0
    every = pa.Array.from_buffers(
        pa.large_string(), 2 * len(starts),
        [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    return every.take(pa.array(np.arange(0, 2 * len(starts), 2)))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` consecutive word hashes (``len - width + 1`` of them, or none)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _power(_BASE, len(hashes)), out=sums[1:])
    return mixed((sums[width:] - sums[:n]) * _power(_INVERSE, n))


def within(first: np.ndarray, width: int, total: int) -> np.ndarray:
    """Which of the windows over all words lie inside one text."""
    n = max(0, total - width + 1)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return owner[:n] == owner[width - 1:width - 1 + n]


def parts(batch: pa.RecordBatch, column: str = "text", size: int = 1 << 23):
    """The batch in slices of at most about ``size`` bytes of ``column`` (one row at least)."""
    values = batch.column(column).cast(pa.large_binary())
    ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + len(values) + 1] \
        if len(values) else np.zeros(1, np.int64)
    at = 0
    while at < len(values):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
