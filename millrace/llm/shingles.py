"""Word shingles of Arrow text columns as sorted sets of 64-bit hashes, by numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> list[np.ndarray]:
    global _powers
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        _powers = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (_BASE, _BASE_INVERSE)]
    return _powers


def _offsets(texts: pa.LargeStringArray) -> np.ndarray:
    found = texts.buffers()[1]
    return np.frombuffer(found, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them) of runs of rows of about SLICE_BYTES."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    offsets = _offsets(texts)
    if texts.null_count and np.diff(offsets)[texts.is_null().to_numpy(zero_copy_only=False)].any():  # Spark writes no bytes for nulls
        texts = pc.fill_null(texts, "")
        offsets = _offsets(texts)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, first word of each row, number of words of each row)."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~_SPACE[data]
    starts = inside[:n].copy()
    starts[1:] &= ~inside[: n - 1]
    ends = inside[:n] & ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    starts[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    power, inverse = _power(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[:n])])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, offsets)
    return hashes, first[:-1], np.diff(first)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all rows, row by row and sorted; where each row starts, and the end).

    A row with fewer than k words has its whole sequence as one shingle; without words, none."""
    hashes, first, count = words(data, offsets)
    sets: list[np.ndarray] = []
    full = np.zeros(0, np.uint64)
    if len(hashes) >= k:
        full = np.zeros(len(hashes) - k + 1, np.uint64)
        for j in range(k):
            full += hashes[j : j + len(full)] * _PLACE[j]
        full = mix(full)
    for a, n in zip(first.tolist(), count.tolist(), strict=True):
        if n >= k:
            s = np.sort(full[a : a + n - k + 1])
            sets.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif n:
            sets.append(mix((hashes[a : a + n] * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + _PLACE[60 - n]))
        else:
            sets.append(full[:0])
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else full[:0]), starts


def identities(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """16 bytes for each set, equal for equal sets: an (n, 2) array of uint64."""
    a = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
    b = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values + np.uint64(0x632BE59BD9B4E019)))])
    n = np.diff(starts).astype(np.uint64)
    return np.stack([mix(a[starts[1:]] - a[starts[:-1]] + n), mix(b[starts[1:]] - b[starts[:-1]] + n)], axis=1)
