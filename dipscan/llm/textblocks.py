"""Vectorised word work on Arrow text columns, for use inside Spark tasks.

A word is a maximal run of bytes other than space and ``\\t \\n \\v \\f \\r``
after lower-casing A-Z.  UTF-8 continuation bytes are all above 0x7F, so the
byte view and the character view cut texts at the same places.

Null and empty texts have no words.  A text longer than ``max_bytes`` forms a
block of its own, so memory follows the longest text rather than the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"): ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply, xor-shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def series(base: int) -> np.ndarray:
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return series(_BASE), series(_BASE_INV)


def _room(n: int) -> int:
    """Room for n bytes in steps that keep the table of powers small."""
    return -(-max(n, BLOCK_BYTES + (1 << 16)) // (1 << 19)) * (1 << 19)


@dataclass
class Words:
    """The words of one block of texts: byte spans, owner text, 64-bit hash."""

    data: np.ndarray  # bytes as stored
    lowered: np.ndarray
    base: np.ndarray  # first byte of each text, and the end of the last
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """Index of each text's first word, and the number of words."""
        return np.searchsorted(self.doc, np.arange(len(self.base)))


def blocks(column: pa.Array | pa.ChunkedArray, max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) pairs whose texts have about ``max_bytes`` together."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    row = 0
    while row < len(column):
        done = ends[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, done + max_bytes, side="right")))
        yield row, pc.fill_null(column.slice(row, stop - row).cast(pa.large_string()), "")
        row = stop
    pa.default_memory_pool().release_unused()  # a worker that waits for its next task holds no batches


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string slice and the offsets into them."""
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, dtype=np.uint8)[at[0]: at[-1]], at - at[0]


def words(texts: pa.Array) -> Words:
    data, base = raw(texts)
    n = len(data)
    low = _LOWER[data]
    space = _SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[base] = True
    before = np.ones(n, dtype=bool)
    before[1:] = space[:-1]
    before |= edge[:n]
    after = np.ones(n, dtype=bool)
    after[:-1] = space[1:]
    after |= edge[1:]
    solid = ~space
    start = np.flatnonzero(solid & before)
    end = np.flatnonzero(solid & after) + 1
    up, down = _powers(_room(n))
    total = low.astype(np.uint64)
    total += _U(1)
    total *= up[:n]
    np.cumsum(total, out=total)
    value = total[end - 1]
    value[start > 0] -= total[start[start > 0] - 1]
    value *= down[start]
    del total
    value ^= (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93)
    doc = np.searchsorted(base[1:], start, side="right")
    return Words(data, low, base, start, end, doc, mix(value))


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every run of k words in one text."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(w.doc[:n] == w.doc[k - 1:])
    out = np.zeros(len(at), dtype=np.uint64)
    for j in range(k):
        out = out * _U(_BASE) + w.hash[at + j]
    return at, mix(out)


def shingle_sets(texts: pa.Array, k: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes); fewer than k words count as one shingle."""
    w = words(texts)
    at, value = grams(w, k)
    first = w.first
    left = np.searchsorted(at, first[:-1])
    right = np.searchsorted(at, first[1:])
    for row in range(len(texts)):
        if right[row] > left[row]:
            yield row, np.unique(value[left[row]: right[row]])
        elif first[row + 1] > first[row]:
            whole = np.zeros(1, dtype=np.uint64)
            for h in w.hash[first[row]: first[row + 1]]:
                whole = whole * _U(_BASE) + h
            yield row, mix(whole ^ _U(first[row + 1] - first[row]))
        else:
            yield row, np.zeros(0, dtype=np.uint64)
