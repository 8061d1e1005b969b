"""Vectorised word kernels over Arrow string buffers.

Everything here works on one Arrow batch inside a task; Spark partitions the
documents.  A *word* is a maximal run of bytes other than space and 0x09-0x0D,
which on UTF-8 equals the pattern ``[^\\x20\\x09-\\x0D]+`` on code points.
Words are identified by a 64-bit hash of their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEGMENT_BYTES = 2 << 20  # bytes hashed at once; bounds a worker's memory
_M = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _M)
_BYTE[_SPACE] = 0
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_POW = np.multiply.accumulate(np.full(1 << 16, np.uint64(0xD6E8FEB86659FD93)))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where words begin (a row's first word byte always begins one)."""
    if not len(data):
        return np.zeros(0, np.int64)
    space = _SPACE[data]
    begins = np.empty(len(data), dtype=bool)
    begins[0] = True
    begins[1:] = space[:-1]
    inner = offsets[:-1]
    begins[inner[inner < len(data)]] = True
    begins &= ~space
    return np.flatnonzero(begins)


def word_hashes(column, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every row, and the n + 1 offsets of the rows' words.

    Long rows are hashed a segment at a time, cut where a word begins.
    """
    data, offsets = text_buffer(column)
    starts = word_starts(data, offsets)
    rows = np.searchsorted(starts, offsets)
    out = np.empty(len(starts), dtype=np.uint64)
    table = _LOWER if lower else _BYTE
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(starts, starts[i] + SEGMENT_BYTES))
        j = max(j, i + 1)
        a, b = int(starts[i]), int(starts[j]) if j < len(starts) else len(data)
        part = data[a:b]
        at = starts[i:j] - a
        value = table[part]
        within = np.arange(len(part), dtype=np.int64)
        within -= np.repeat(at, np.diff(np.append(at, len(part))))
        value *= _POW[within & 0xFFFF]
        # a space adds 0, and so do the spaces behind a word
        out[i:j] = mix64(np.add.reduceat(value, at))
        i = j
    return out, rows


_MULTIPLIERS = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words (over row ends too; callers drop those)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total += words[k : k + n] * _MULTIPLIERS[k]
    return mix64(total)


def shingle_sets(words: np.ndarray, rows: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct ``size``-word shingles of each row; a shorter row is one shingle, an empty row none."""
    runs = window_hashes(words, size)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        n = b - a
        if n >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif n:
            head = (words[a:b] * _MULTIPLIERS[:n]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix64(head + np.uint64(n * int(_M) % (1 << 64))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
