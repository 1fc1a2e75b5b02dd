"""Vectorised text kernels: whole Arrow batches as flat byte, word and shingle arrays.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. Word and window hashes are
64 bits; two different sequences share one with a probability of about 2**-64.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D  # odd
_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 64), _BASE, np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the row offsets in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each, or one row where that alone is longer."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the index of its first word (n+1)."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    gap = _SPACE[raw]
    before = np.empty_like(gap)
    before[0], before[1:] = True, gap[:-1]
    after = np.empty_like(gap)
    after[-1], after[:-1] = True, gap[1:]
    inner = off[(off > 0) & (off < len(raw))]
    before[inner] = True
    after[inner - 1] = True
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(~gap & after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    ends_at = np.cumsum(size)
    within = np.arange(ends_at[-1]) - np.repeat(ends_at - size, size)
    byte = raw[np.repeat(starts, size) + within]
    if lower:
        byte = _LOWER[byte]
    value = _BYTE[byte] * _power_table(int(size.max()) + 1)[within]
    total = np.add.reduceat(value, ends_at - size)
    return mix(total + size.astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of every row, flat, and the row pointers.

    A row of 1 to k-1 words has its whole sequence as the one shingle; one without words has none.
    """
    starts, ends, ptr = words(raw, off)
    h = word_hashes(raw, starts, ends, lower)
    rows = len(off) - 1
    n = np.diff(ptr)
    if not len(h):
        return h, np.zeros(rows + 1, np.int64)
    weights = mix(np.arange(101, 101 + k, dtype=np.uint64)) | _U(1)
    full = np.maximum(n - k + 1, 0)
    row = np.repeat(np.arange(rows), full)
    first = np.cumsum(full) - full
    at = np.arange(len(row)) - first[row] + ptr[:-1][row]
    total = np.zeros(len(row), np.uint64)
    for j in range(k):
        total += h[at + j] * weights[j]
    value = [mix(total)]
    shorts = []
    for c in range(1, k):
        short = np.flatnonzero(n == c)
        if len(short):
            total = np.full(len(short), c, np.uint64) * _U(0xA0761D6478BD642F)
            for j in range(c):
                total += h[ptr[short] + j] * weights[j]
            shorts.append((short, mix(total)))
    ends_at = np.cumsum(full)
    value = value[0]
    for a, b in zip(first[full > 1].tolist(), ends_at[full > 1].tolist()):
        value[a:b].sort()
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, count = value[keep], np.bincount(row[keep], minlength=rows)
    if shorts:
        at = np.concatenate([s for s, _ in shorts])
        order = np.argsort(at, kind="stable")
        at, extra = at[order], np.concatenate([v for _, v in shorts])[order]
        value = np.insert(value, (np.cumsum(count) - count)[at], extra)
        count[at] = 1
    return value, np.concatenate([[0], np.cumsum(count)])


def rolling(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of `size` consecutive values, by doubling."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    level, width = h, 1
    out, covered = None, 0
    while width <= size:
        if size & width:
            part = level[covered : covered + len(h) - size + 1]
            out = part.copy() if out is None else mix(out * _U(0xE7037ED1A0B428DB) + part)
            covered += width
        if width * 2 <= size:
            level = mix(level[: len(level) - width] * _U(0x8EBC6AF09C88C6E3) + level[width:])
        width *= 2
    return out


def lean(run):
    """Wrap a function over batches: what it has held goes back to the system when it ends.

    Python workers serve one task after another; without this each would keep its largest task's memory.
    """

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return wrapped
