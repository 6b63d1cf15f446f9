"""Vectorised text helpers for the tasks: Arrow buffers, words, rolling hashes.

All functions work on one *chunk*: the UTF-8 bytes of some documents laid end
to end, with ``offsets`` saying where each document starts.  Chunks are small
(``CHUNK_BYTES``, or one document if that is longer), so memory in a task is
bounded by the longest document and not by the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

CHUNK_BYTES = 1 << 19

#: Odd multiplier of the rolling hash and the two mixing factors.
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX1 = np.uint64(0xFF51AFD7ED558CCD)
_MIX2 = np.uint64(0xC4CEB9FE1A85EC53)
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

#: The bytes that part words in the op contracts: 0x20 and 0x09-0x0D.
WHITESPACE = np.zeros(256, dtype=bool)
WHITESPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Anything ASCII that is neither letter nor digit.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

#: A-Z to a-z; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE_VALUE = np.random.Generator(np.random.PCG64(20240521)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX1
    x ^= x >> np.uint64(33)
    x *= _MIX2
    x ^= x >> np.uint64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, CHUNK_BYTES * 2)
        p, q = np.full(size, _BASE, np.uint64), np.full(size, _BASE_INVERSE, np.uint64)
        p[0] = q[0] = 1
        _powers, _inverses = np.cumprod(p), np.cumprod(q)
    return _powers[:n], _inverses[:n]


def binary_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64, len(column) + 1, column.offset * 8) if where else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `size` bytes; a longer document stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, part: np.ndarray = WHITESPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words of a chunk, and each document's first word (n + 1)."""
    inside = ~part[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    if len(data):
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    begin, end = cuts[:-1], cuts[1:]
    real = inside[begin] if len(begin) else np.zeros(0, bool)
    begin, end = begin[real], end[real]
    return begin, end, np.searchsorted(begin, offsets, side="left")


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[b:e] for each span; equal bytes, equal hash."""
    p, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * p[:-1], out=sums[1:])
    return mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


def value_span_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of values[b:e] for each span."""
    p, inverse = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[:-1], out=sums[1:])
    return mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive 64-bit values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p, inverse = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[:-1], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * inverse[:n])


def byte_values(data: np.ndarray) -> np.ndarray:
    """A 64-bit value for each byte, as input of gram_hashes."""
    return _BYTE_VALUE[data]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values, in log2(width) passes."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, ..., for each range in turn."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(begin - (np.cumsum(length) - length), length)
    return shift + np.arange(total)


_SPANS = 1 << 14


def take_spans(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """data[b:b+n] of each span, laid end to end; in blocks, so that the index stays small."""
    parts = [data[ranges(begin[i : i + _SPANS], length[i : i + _SPANS])] for i in range(0, len(begin), _SPANS)]
    return np.concatenate(parts) if parts else data[:0]


def equal_spans(data: np.ndarray, left: np.ndarray, left_length: np.ndarray, right: np.ndarray, right_length: np.ndarray) -> bool:
    """Whether each left span has the bytes of its right span."""
    if not np.array_equal(left_length, right_length):
        return False
    return all(np.array_equal(data[ranges(left[i : i + _SPANS], left_length[i : i + _SPANS])], data[ranges(right[i : i + _SPANS], left_length[i : i + _SPANS])]) for i in range(0, len(left), _SPANS))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string; `unpack` needs their types."""
    sizes = np.array([len(a) for a in arrays], np.int64)
    return zstandard.compress(b"".join([sizes.tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]]), 1)


def unpack(packed: bytes, *types: type) -> list[np.ndarray]:
    """The arrays of a packed string."""
    raw = zstandard.decompress(packed)
    sizes = np.frombuffer(raw, np.int64, len(types))
    out, at = [], 8 * len(types)
    for size, kind in zip(sizes.tolist(), types, strict=True):
        out.append(np.frombuffer(raw, kind, size, at))
        at += size * np.dtype(kind).itemsize
    return out


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column whose i-th cell takes the next counts[i] values."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def flat(column: pa.ChunkedArray, dtype=None) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and how many each row has."""
    if not len(column):
        return np.zeros(0, dtype or np.int64), np.zeros(0, np.int64)
    one = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return one.flatten().to_numpy(zero_copy_only=False), one.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
