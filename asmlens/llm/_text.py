"""Numpy kernels over the UTF-8 bytes of many texts at once.

Texts arrive as an Arrow string column; its value buffer is read without a
copy, in runs of whole texts of about ``limit`` bytes so that the working
arrays stay in cache. Memory grows with the longest single text only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)

#: What separates words: bytes 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur style); wraps around by design."""
    h = np.asarray(h, U).copy()
    h ^= h >> U(33)
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


#: A random 64-bit value for each byte.
BYTE = mix((np.arange(1, 257, dtype=U)) * U(0x9E3779B97F4A7C15))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 21)
        for name, factor in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, factor, U)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


class RangeHash:
    """Hashes of any byte range of ``data`` from one prefix sum."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(BYTE[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(raw + (np.asarray(end) - np.asarray(start)).astype(U) * U(0xD6E8FEB86659FD93))


def texts(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts: first row, byte offsets of the texts (n + 1), bytes. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    ends = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, side="right")) - 1)
        stop = min(stop, n)
        yield row, ends[row : stop + 1] - ends[row], raw[ends[row] : ends[stop]]
        row = stop


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (one a byte) over each text."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the first word's index of each text (n + 1). ``between``: the bytes that separate words."""
    n = len(data)
    gap = np.ones(n + 2, bool)
    gap[1:-1] = between[data]
    solid = ~gap[1:-1]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(solid & (gap[:-2] | edge[:-1]))
    end = np.flatnonzero(solid & (gap[2:] | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks over ``keys``: equal to an earlier one; equal to any other one."""
    again, shared = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        same = np.flatnonzero(ranked[1:] == ranked[:-1])
        again[order[same + 1]] = True
        shared[order[same]] = True
        shared |= again
    return again, shared
