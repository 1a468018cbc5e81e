"""Many small fixed-size records as few binary rows, dealt to buckets by key.

A task packs its records of one bucket into one row; after a shuffle by bucket a task unpacks the
rows it got.  The shuffle then moves bytes, not millions of small rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

U48 = np.dtype("V6")


def to48(x: np.ndarray) -> np.ndarray:
    """The low 48 bits of each number, in six bytes."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).view(U48).ravel()


def from48(data: bytes | np.ndarray) -> np.ndarray:
    six = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view("<u8").ravel()


def pack(columns: list[np.ndarray]) -> bytes:
    return b"".join(c.tobytes() for c in columns)


def unpack(data: bytes, kinds: list[str]) -> list[np.ndarray]:
    """The columns of a blob; kind "u6" stands for 48-bit numbers."""
    sizes = [6 if k == "u6" else np.dtype(k).itemsize for k in kinds]
    n, at, out = len(data) // sum(sizes), 0, []
    for kind, size in zip(kinds, sizes, strict=True):
        part = data[at:at + n * size]
        out.append(from48(part) if kind == "u6" else np.frombuffer(part, kind))
        at += n * size
    return out


def deal(columns: list[np.ndarray], bucket: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, blob) of the records of each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    columns = [c[order] for c in columns]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, int)
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=True):
        yield int(bucket[lo]), pack([c[lo:hi] for c in columns])


#: Bits of a membership filter: its size is fixed, so it may be sent to every task.
FILTER_BITS = 24


def membership(ids: DataFrame, column: str) -> np.ndarray:
    """A one-hash Bloom filter of 64-bit ids, FILTER_BITS bits whatever the input."""
    bit = F.col(column).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = (ids.select(F.shiftright(bit, 6).alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")).toPandas())
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)
    return out


def may_contain(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = ids & np.uint64((1 << FILTER_BITS) - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def positive(column: Column) -> Column:
    """The bucket number of a 64-bit key."""
    return F.pmod(column, F.lit(1 << 31))
