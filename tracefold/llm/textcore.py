"""Vectorised text work inside tasks: bytes, words and ragged arrays.

Spark hands a task Arrow batches; the functions here look at the bytes of a whole
batch through numpy, in pieces of bounded size, so no Python loop runs per word.
Nothing in this module knows about Spark plans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are looked at in one numpy pass; a longer text is a piece of its own.
PIECE = 1 << 20
U64 = np.uint64
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_GRAM = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)
#: 0 for bytes outside words, else the byte in lower case (A-Z only); bytes from 0x80 belong to words.
WORD_BYTE = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128
                      else 0 for b in range(256)], dtype=np.uint8)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, PIECE // 2 + 4096)
        have = np.empty(size, dtype=np.uint64)
        have[0] = 1
        done = 1
        while done < size:  # doubling: the next block is the first one times base**done
            step = min(done, size - done)
            have[done:done + step] = have[:step] * U64(pow(base, done, 1 << 64))
            done += step
        _powers[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def slices(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The given slices of ``data`` one after the other."""
    total = int(lengths.sum())
    if total == 0:
        return data[:0]
    ends = np.cumsum(lengths)
    index = np.ones(total, dtype=np.int64)
    keep = lengths > 0
    starts, lengths, ends = starts[keep], lengths[keep], ends[keep]
    index[0] = starts[0]
    index[ends[:-1]] = starts[1:] - (starts[:-1] + lengths[:-1]) + 1
    return data[np.cumsum(index)]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buffer and row offsets (int64, from 0) of a binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each (one row at least)."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = max(first + 1, min(last, n))
        yield first, last
        first = last


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash: slice hash = (P[e] - P[s]) * inverse**s."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[values] * powers(_BASE, len(values))[:len(values)], out=sums[1:])
    return sums


def slice_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of slices given by positions; equal bytes give equal hashes in any buffer."""
    raw = (sums[ends] - sums[starts]) * powers(_INVERSE, len(sums))[starts]
    return mix(raw ^ ((ends - starts).astype(np.uint64) * U64(0xD6E8FEB86659FD93)))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the rows and the first word index of each row (plus the end).

    A word is a run of ASCII letters, digits and bytes from 0x80; A-Z count as a-z.
    """
    mapped = WORD_BYTE[data]
    inside = np.zeros(len(mapped) + 1, dtype=bool)
    inside[:-1] = mapped > 0
    before = np.zeros(len(mapped) + 1, dtype=bool)
    before[1:] = inside[:-1]
    before[offsets] = False  # a word ends with its row
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(mapped) + 1, dtype=bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return (slice_hash(prefix_hash(mapped), starts, ends),
            np.searchsorted(starts, offsets))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` word hashes, by the index of its first word."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total = np.full(len(hashes) - n + 1, n, dtype=np.uint64)
    for j in range(n):
        total += hashes[j:len(hashes) - n + 1 + j] * _GRAM[j]
    return mix(total)


def row_of(bounds: np.ndarray) -> np.ndarray:
    """Row number of every element, from the element bounds of the rows."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """List column whose rows take ``counts`` values each."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
