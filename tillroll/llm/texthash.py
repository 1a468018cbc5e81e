"""Words, lines and shingles of whole texts as 64-bit hashes, straight from Arrow buffers.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D after lower-casing A-Z, so UTF-8
needs no decoding.  All word hashes of a chunk of texts come from one prefix sum of a polynomial
over byte codes; no Python loop runs over words.
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK_BYTES = 1 << 17
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_CODES = mix(np.arange(1, 257, dtype=U) * _BASE)
_CODES[65:91] = _CODES[97:123]  # A-Z hash as a-z

_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        steps = np.full(1 << max(n - 1, 1).bit_length(), _BASE if kind == "up" else _BASE_INVERSE, U)
        steps[0] = U(1)
        have = _powers[kind] = np.multiply.accumulate(steps)
    return have[:n]


class Chunk(NamedTuple):
    """Rows lo..hi of a batch: their text bytes end to end and len(rows)+1 offsets from 0."""
    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    row: np.ndarray     # row within the chunk
    hash: np.ndarray
    start: np.ndarray   # byte offsets within the chunk
    end: np.ndarray
    sums: np.ndarray    # prefix sums of the chunk, for run_hash


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if column.buffers()[2] is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The column in runs of whole texts of about ``size`` bytes (one text may be longer)."""
    data, offsets = text_buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield Chunk(lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        lo = hi


def prefix_sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_CODES[data] * _power("up", len(data)), out=sums[1:])
    return sums


def run_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of runs of bytes, wherever in the chunk they are."""
    hashed = (sums[end] - sums[start]) * _power("down", len(sums))[start]
    return mix(hashed ^ ((end - start).astype(U) * U(0xD6E8FEB86659FD93)))


def words(data: np.ndarray, starts: np.ndarray, rows: bool = True) -> Words:
    """Words of texts that begin at ``starts`` (ascending, from 0) in ``data``; without ``rows``, they are not told which."""
    n = len(data)
    inside = (data != 0x20) & (data - np.uint8(0x09) > 4)  # as SPACE has them
    edge = np.zeros(n + 1, bool)
    edge[starts[starts < n]] = True
    edge[n] = True
    begins = inside & edge[:n]
    begins[1:] |= inside[1:] & ~inside[:-1]
    ends = inside & edge[1:]
    ends[:-1] |= inside[:-1] & ~inside[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = prefix_sums(data)
    row = np.searchsorted(starts, start, "right") - 1 if rows else np.zeros(0, np.int64)
    return Words(row, run_hash(sums, start, end), start, end, sums)


def _combine(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    total = np.full(len(at), k, U)
    for j in range(k):
        total = total * U(0xC2B2AE3D27D4EB4F) + hashes[at + j]
    return mix(total)


def shingles(found: Words, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every k-word shingle, by row; a text of fewer words is one shingle."""
    counts = np.bincount(found.row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    at = np.flatnonzero(found.row[k - 1:] == found.row[:len(found.row) - k + 1]) if len(found.row) >= k else np.zeros(0, np.int64)
    row, hashed = found.row[at], _combine(found.hash, at, k)
    for c in range(1, k):
        few = np.flatnonzero(counts == c)
        if len(few):
            row = np.concatenate([row, few])
            hashed = np.concatenate([hashed, _combine(found.hash, first[few], c)])
    order = np.argsort(row, kind="stable")
    return row[order], hashed[order]


def distinct(row: np.ndarray, hashed: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, ascending within the row; ``row`` must ascend."""
    hashed = hashed.copy()
    ends = np.searchsorted(row, np.arange(rows + 1))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        hashed[a:b].sort()
    keep = np.ones(len(row), bool)
    keep[1:] = (hashed[1:] != hashed[:-1]) | (row[1:] != row[:-1])
    return row[keep], hashed[keep]


def group_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Wrapping sums of the runs of ``values`` that begin at ``starts`` (none empty)."""
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0, values.dtype)


def shingle_hash(text: str, k: int) -> set[int]:
    """The distinct shingle hashes of one text (for small tables and tests)."""
    data = np.frombuffer(text.encode(), np.uint8)
    found = words(data, np.zeros(1, np.int64))
    return set(shingles(found, 1, k)[1].tolist())
