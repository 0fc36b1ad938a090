"""Vectorised words and word shingles over Arrow string arrays.

A word is a maximal run of bytes outside space and 0x09-0x0D, with A-Z lower-cased. It becomes a 64-bit
hash from prefix sums of a polynomial over its bytes, so a whole batch is hashed by a few numpy passes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
SLICE_BYTES = 1 << 20
LONG_WORD = 1024
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: A byte's value, as it is and after lower-casing.
RAW = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_BYTE = RAW[LOWER]
#: Other values of the bytes as they are, for a second hash.
OTHER = mix(np.arange(1001, 1257, dtype=U) * U(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C55 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, dtype=U), np.ones(1, dtype=U)]
_SEATS = mix(np.arange(101, 101 + 64, dtype=U)) | U(1)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    size = max(n, SLICE_BYTES)
    made = []
    for base in (_BASE, _INVERSE):
        steps = np.full(size, base, dtype=U)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps))
    if size <= 8 * SLICE_BYTES:
        _powers[:] = made
    return made[0][:n], made[1][:n]


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string array, without a copy of the bytes; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if not (pa.types.is_string(array.type) or pa.types.is_large_string(array.type)):
        array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    offsets = np.frombuffer(array.buffers()[1], dtype=kind)[array.offset : array.offset + len(array) + 1].astype(np.int64) if len(array) else np.zeros(1, np.int64)
    data = np.frombuffer(array.buffers()[2], dtype=np.uint8) if array.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets


#: Rows whose offsets are looked at, and nulls filled, at once.
SLICE_ROWS = 1024


def slices(array: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of about `most` bytes; a longer row comes alone."""
    for first in range(0, len(array), SLICE_ROWS):
        data, offsets = raw(array.slice(first, SLICE_ROWS))
        lo, n = 0, len(offsets) - 1
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
            yield first + lo, first + hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            lo = hi


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of SLICE_ROWS rows, so that what is made of one stays small."""
    for batch in batches:
        for first in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(first, SLICE_ROWS)


@cache
def _trim():
    """The C library's call that gives freed memory back, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda _: 0


def release() -> None:
    """Gives the worker's freed memory back to the system: workers live on, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, with freed memory given back at a task's end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


#: Also every ASCII byte that is neither a letter nor a digit parts words.
PUNCTUATION = _SPACE.copy()
PUNCTUATION[[i for i in range(128) if not chr(i).isalnum()]] = True


def spans(data: np.ndarray, offsets: np.ndarray, parting: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each row (with the total at the end)."""
    solid = ~parting[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    full = offsets[:-1] < offsets[1:]
    at = offsets[:-1][full]
    first[at] = solid[at]
    at = offsets[1:][full] - 1
    last[at] = solid[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_sums(data: np.ndarray, values: np.ndarray = _BYTE) -> tuple[np.ndarray, np.ndarray]:
    """(sums, inverse): (sums[e] - sums[s]) * inverse[s] is the polynomial of bytes s to e."""
    power, inverse = _power_tables(len(data))
    sums = np.empty(len(data) + 1, dtype=U)
    sums[0] = 0
    np.cumsum(values[data] * power, out=sums[1:])
    return sums, inverse


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums, inverse = prefix_sums(data)
    out = mix((sums[ends] - sums[starts]) * inverse[starts])
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(LOWER[data[starts[i] : ends[i]]].tobytes())
    return out


def words(array: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, first word of each row and the total) by slices."""
    for lo, hi, data, offsets in slices(array):
        starts, ends, bounds = spans(data, offsets)
        yield lo, hi, hashes(data, starts, ends), bounds


def shingle(hashed: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of `width` words in text order, repeats included, and row bounds. Fewer words make one shingle, none none."""
    counts = np.diff(bounds)
    sizes = np.where(counts >= width, counts - (width - 1), np.minimum(counts, 1))
    edges = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(edges[-1], dtype=U)
    short = np.flatnonzero((counts > 0) & (counts < width))
    seats = np.ones(len(out), dtype=bool)
    seats[edges[short]] = False
    n = len(hashed) - width + 1
    if n > 0:
        runs = np.zeros(n, dtype=U)
        for k in range(width):
            runs += hashed[k : n + k] * _SEATS[k]
        whole = np.ones(n, dtype=bool)
        tails = (bounds[1:, None] - np.arange(1, width)).ravel()
        whole[tails[(tails >= 0) & (tails < n)]] = False
        out[seats] = runs[whole]
    for row, at in zip(short, edges[short], strict=True):
        mine = hashed[bounds[row] : bounds[row + 1]]
        out[at] = (mine * _SEATS[: len(mine)]).sum(dtype=U) + U(len(mine))
    return mix(out), edges


def shingles(array: pa.Array, width: int = 5) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi, hashed, bounds in words(array):
        yield lo, hi, *shingle(hashed, bounds, width)


def shingle_sets(array: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each row."""
    for lo, hi, found, edges in shingles(array, width):
        for i in range(hi - lo):
            yield np.unique(found[edges[i] : edges[i + 1]])


def digests(found: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's number of distinct shingles, and a 128-bit digest of the set as two signed numbers."""
    sizes, out = np.zeros(len(edges) - 1, np.int64), np.zeros((len(edges) - 1, 2), dtype=U)
    for i in np.flatnonzero(np.diff(edges)):
        own = np.unique(found[edges[i] : edges[i + 1]])
        sizes[i] = len(own)
        out[i] = own.sum(dtype=U), mix(own).sum(dtype=U)
    return sizes, mix(out).view(np.int64)
