"""Words and shingles of whole texts as numpy arrays.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]`` of the UTF-8
text with A-Z lower-cased.  Each word gets a 64-bit hash: a polynomial over its
bytes, taken from prefix sums, then mixed.  Texts are handled in slices of a
quarter of a megabyte (a longer text is a slice of its own), so memory follows
the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[str, np.ndarray] = {}


def _power_table(kind: str, base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i below n; grown by doubling."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1, 2 * len(have) if have is not None else 0)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        _powers[kind] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) or pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def pieces_of(batches, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of at most ``limit`` bytes of this column, or one row."""
    for batch in batches:
        _, off = utf8(batch.columns[column])
        for i, j in slices(off, limit):
            yield batch.slice(i, j - i)


@dataclass
class Words:
    """Words of several rows: row r has words ``indptr[r]`` to ``indptr[r + 1]``."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    indptr: np.ndarray
    raw: np.ndarray


def words(buf: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of the rows with these offsets; start and end are relative to the first."""
    rel = offsets - offsets[0]
    raw = _LOWER[buf[offsets[0] : offsets[-1]]]
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64), raw)
    space = _SPACE[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[rel] = True
    edge[0] = edge[n] = True
    before = edge[:-1].copy()
    before[1:] |= space[:-1]
    after = edge[1:].copy()
    after[:-1] |= space[1:]
    inside = ~space
    start = np.flatnonzero(inside & before)
    end = np.flatnonzero(inside & after) + 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power_table("up", _BASE, n), out=sums[1:])
    h = (sums[end] - sums[start]) * _power_table("down", _INVERSE, n)[start]
    return Words(mix(h + (end - start).astype(np.uint64)), start, end, np.searchsorted(start, rel).astype(np.int64), raw)


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles (repeats kept) and their row pointers.

    A row with one to k-1 words has its whole sequence as one shingle; a row
    without words has none.
    """
    h = w.hash
    count = np.diff(w.indptr)
    factors = [np.uint64(pow(_BASE, 3 * i + 1, 1 << 64)) for i in range(k)]
    size = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    ptr = np.zeros(len(count) + 1, dtype=np.int64)
    np.cumsum(size, out=ptr[1:])
    out = np.empty(ptr[-1], dtype=np.uint64)
    if len(h) >= k:
        acc = np.zeros(len(h) - k + 1, dtype=np.uint64)
        for i, f in enumerate(factors):
            acc += h[i : len(h) - k + 1 + i] * f
        full = np.zeros(len(h) - k + 1, dtype=bool)
        left = np.repeat(w.indptr[1:], count)[: len(full)] - np.arange(len(full))
        full[left >= k] = True
        long_rows = np.repeat(count >= k, size)
        out[long_rows] = mix(acc[full])
    for c in range(1, k):
        rows = np.flatnonzero(count == c)
        if len(rows):
            acc = np.full(len(rows), c, dtype=np.uint64)
            for i in range(c):
                acc += h[w.indptr[rows] + i] * factors[i]
            out[ptr[rows]] = mix(acc)
    return out, ptr
