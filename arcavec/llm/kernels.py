"""Numpy kernels over Arrow string columns, shared by the text operators.

A column of texts is one byte buffer plus row offsets; everything here works on that pair without
making Python strings. Work is done in chunks of whole rows of about ``CHUNK_BYTES``, so a task's
memory follows the chunk (or its longest single row), not the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is empty. offsets has a row more and starts at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows, each of at most ``size`` bytes or a single row."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def text_chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for each chunk of a column."""
    data, offsets = text_buffer(column)
    for lo, hi in chunks(offsets, size):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
    release()


def release() -> None:
    """Gives freed memory back to the system: Python workers live on after their tasks, beside each other."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def row_of(offsets: np.ndarray, n: int) -> np.ndarray:
    """The row of each of n positions."""
    return np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))[:n]


def row_starts(offsets: np.ndarray, n: int) -> np.ndarray:
    """A flag at the first position of every row that is not empty; one flag more than positions, set at the end."""
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    return first


def runs(member: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``member`` that no row boundary in ``first`` cuts."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.zeros(n, bool)
    before[1:] = member[:-1]
    after = np.zeros(n, bool)
    after[:-1] = member[1:]
    return np.flatnonzero(member & (~before | first[:-1])), np.flatnonzero(member & (~after | first[1:])) + 1


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _power(base: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(key := str(int(base)))
    if known is None or len(known) < n:
        size = max(n, 1 << 20)
        known = np.empty(size, np.uint64)
        known[0] = 1
        known[1:] = base
        np.multiply.accumulate(known, out=known)
        if size <= 8 << 20:  # a longer table, for one very long row, isn't kept
            _powers[key] = known
    return known[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of byte * base**position modulo 2**64: any slice's polynomial hash is a difference of two."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of slices; equal bytes have equal hashes wherever they stand."""
    h = (prefix[ends] - prefix[starts]) * _power(_BASE_INV, len(prefix))[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all slices of one width."""
    n = len(prefix) - width
    return mix((prefix[width:] - prefix[:n]) * _power(_BASE_INV, len(prefix))[:n])


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row offsets in words) of the runs of bytes that ``table`` marks."""
    starts, ends = runs(table[data], row_starts(offsets, len(data)))
    return starts, ends, np.searchsorted(starts, offsets)


def shingle_hash(word_hash: np.ndarray, word_offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row offsets) of k-word shingles of each row; a row of fewer words, but not none, has one of all its words."""
    n = np.diff(word_offsets)
    per_row = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out = np.concatenate([[0], np.cumsum(per_row)])
    row = np.repeat(np.arange(len(n)), per_row)
    at = word_offsets[:-1][row] + (np.arange(out[-1]) - out[:-1][row])
    length = np.minimum(n, k)[row]
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        on = length > j
        h[on] = mix(h[on] * np.uint64(0x9E3779B97F4A7C15) + word_hash[at[on] + j] + np.uint64(j + 1))
    return h ^ mix(length.astype(np.uint64)), out


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, start + 1, ... of the given counts."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def spans_of(flags: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of set flags within rows."""
    return runs(flags, first)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Flags of the positions in 0..n inside any of the ranges."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1], dtype=np.int32) > 0
