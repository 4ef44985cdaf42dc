"""Vectorised words, hashes and shingles over Arrow string buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Those bytes never occur inside a
multi-byte UTF-8 character, so the buffers are worked on as bytes without decoding. Nulls count as
empty strings. Long texts are whole: a block ends only between rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


class Words(NamedTuple):
    """Words of a block of rows: byte spans, 64-bit hash, row, and where each row's words begin (n_rows + 1)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row: np.ndarray
    first: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column; nulls have length 0."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets, data


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo..hi with their own offsets (from 0) and bytes, of about `most` bytes (one row may be longer)."""
    offsets, data = buffers(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
        lo = hi


_powers: tuple[np.ndarray, np.ndarray] | None = None


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        m = max(n, BLOCK_BYTES + (1 << 17))
        up, down = np.full(m, _BASE), np.full(m, _INVERSE)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[0][:n], _powers[1][:n]


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span (content only, not position)."""
    up, down = _powers_to(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start] ^ (end - start).astype(np.uint64))


def spans(offsets: np.ndarray, data: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that aren't breaks; a row's end breaks too."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ink = ~breaks[data]
    start = ink.copy()
    start[1:] &= ~ink[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    start[inner] = ink[inner]
    stop = ink.copy()
    stop[:-1] &= ~ink[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    stop[last] = ink[last]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def words(offsets: np.ndarray, data: np.ndarray, lower: bool = False) -> Words:
    """The words of a block; lower folds ASCII letters before hashing."""
    start, end = spans(offsets, data)
    h = span_hash(LOWER[data] if lower else data, start, end)
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(start, end, h, row, first)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, by its first word (len(h) - k + 1); runs may cross rows, see inside()."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = (out ^ (out >> np.uint64(29))) * _BASE + h[j : j + n]
    return mix(out)


def inside(row: np.ndarray, k: int) -> np.ndarray:
    """Which runs of k words stay within one row."""
    n = len(row) - k + 1
    return row[:n] == row[k - 1 :] if n > 0 else np.zeros(0, bool)


def fold(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's sequence of word hashes (0, 0 for a row without words)."""
    n = np.diff(first)
    up, down = _powers_to(len(h) + 1)
    out = []
    with np.errstate(over="ignore"):
        for salt in (np.uint64(0), np.uint64(0xD6E8FEB86659FD93)):
            total = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(mix(h ^ salt) * up[: len(h)], out=total[1:])
            x = mix((total[first[1:]] - total[first[:-1]]) * down[first[:-1]] ^ n.astype(np.uint64))
            out.append(np.where(n > 0, x, np.uint64(0)))
    return out[0], out[1]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + lengths[i] - 1, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    step = np.ones(total, np.int64)
    ends = np.cumsum(lengths)[:-1]
    step[0] = starts[0]
    step[ends] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(step)


def longs(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit hashes as Spark's long."""
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())
