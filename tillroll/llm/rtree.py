"""An R-tree over count vectors that finds pairs whose overlap may reach a similarity.

A set's point has, for each group of a fixed hash grouping, the number of its members there.  Two
sets share at most the sum of the smaller coordinates; a node keeps the largest coordinate of its
points in every dimension, so the same sum bounds the overlap of a query with all of them.
"""
from __future__ import annotations

import numpy as np

GROUPS, FANOUT = 64, 32
#: Bits of a parity vector (powers of two, whole words).
LEAST_BITS, MOST_BITS = 256, 1 << 13


def vectors(row: np.ndarray, hashed: np.ndarray, rows: int) -> np.ndarray:
    """Counts of each row's hashes by group."""
    at = row * GROUPS + (hashed >> np.uint64(58)).astype(np.int64)
    return np.bincount(at, minlength=rows * GROUPS).reshape(rows, GROUPS).astype("<u4")


def least_overlap(a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray:
    """The overlap that sets of a and b members need for a Jaccard similarity of percent/100."""
    return -(-percent * (np.asarray(a) + np.asarray(b)) // (100 + percent))


class RTree:
    """Packed by size and then by the first coordinates, so that a leaf's points are alike."""

    def __init__(self, points: np.ndarray) -> None:
        size = points.sum(1)
        self.order = np.lexsort((*points.T[:4], size))
        self.points, self.size = points[self.order], size[self.order]
        starts = np.arange(0, len(points), FANOUT)
        self.high = [np.maximum.reduceat(self.points, starts)] if len(points) else []
        self.low_size = [np.minimum.reduceat(self.size, starts)] if len(points) else []
        while self.high and len(self.high[-1]) > FANOUT:
            starts = np.arange(0, len(self.high[-1]), FANOUT)
            self.high.append(np.maximum.reduceat(self.high[-1], starts))
            self.low_size.append(np.minimum.reduceat(self.low_size[-1], starts))

    def search(self, point: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Points that may be similar, as positions in the array given, and the bounds of their similarity."""
        if not self.high:
            return np.zeros(0, int), np.zeros(0)
        n = int(point.sum())
        nodes = np.arange(len(self.high[-1]))
        for high, low in zip(reversed(self.high), reversed(self.low_size), strict=True):
            nodes = nodes[nodes < len(high)]
            bound = np.minimum(high[nodes], point).sum(1)
            nodes = nodes[bound >= least_overlap(n, low[nodes], percent)]
            nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        nodes = nodes[nodes < len(self.points)]
        bound = np.minimum(self.points[nodes], point).sum(1)
        keep = bound >= least_overlap(n, self.size[nodes], percent)
        nodes, bound = nodes[keep], bound[keep]
        return self.order[nodes], bound / (n + self.size[nodes] - bound)


def odd_bits(hashed: np.ndarray) -> bytes:
    """A set's parity vector: one bit for each group of a finer grouping, set where the count is odd.

    There are at least two groups for a member, up to ``MOST_BITS``; the groups of a shorter vector
    are unions of those of a longer one (``folded``)."""
    bits = min(max(LEAST_BITS, 1 << (2 * len(hashed) - 1).bit_length()), MOST_BITS)
    odd = np.bincount((hashed & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(vectors: list[bytes]) -> np.ndarray:
    """Parity vectors as rows of words, all brought to the length of the shortest."""
    width = min(map(len, vectors))
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(v, "<u8").reshape(-1, width // 8), 0) for v in vectors])


class Members:
    """Points, sizes and parity vectors of the sets of one search.

    Sets that differ in d members differ in at most d parities, so pairs beyond the difference that
    their sizes allow are no links; of unrelated sets hardly any pass."""

    def __init__(self, points: np.ndarray, odd: np.ndarray, percent: int) -> None:
        self.points, self.odd, self.percent = points, odd, percent
        self.size = points.sum(1)

    def distance(self, i: int | np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.odd[i] ^ self.odd[j]).sum(-1, dtype=np.int64)

    def allowed(self, i: int | np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.size[i] + self.size[j] - 2 * least_overlap(self.size[i], self.size[j], self.percent)

    def candidates(self, left: np.ndarray, right: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i of left, j of right, distance by parities a member) of the pairs of different names that may be links."""
        tree = RTree(self.points[right])
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in left.tolist():
            j = right[tree.search(self.points[i], self.percent)[0]]
            j = j[names[j] != names[i]]
            far = self.distance(i, j)
            keep = far <= self.allowed(i, j)
            if keep.any():
                j = j[keep]
                out.append((np.full(len(j), i), j, far[keep] / (self.size[i] + self.size[j])))
        if not out:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        a, b, far = zip(*out, strict=True)
        return np.concatenate(a), np.concatenate(b), np.concatenate(far)


def forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray, nodes: int) -> np.ndarray:
    """Positions of the edges of a least spanning forest: each component takes its least edge, until none is left."""
    order = np.lexsort((b, a, weight))
    a, b = a[order], b[order]
    live, name, taken = np.arange(len(a)), np.arange(nodes), []
    while len(live):
        x, y = name[a[live]], name[b[live]]
        apart = x != y
        live, x, y = live[apart], x[apart], y[apart]
        ends = np.concatenate([x, y])
        least = np.full(nodes, len(a))
        np.minimum.at(least, ends, np.concatenate([live, live]))
        picked = np.unique(least[np.unique(ends)])
        for e in picked.tolist():
            p, q = name[a[e]], name[b[e]]
            name[name == max(p, q)] = min(p, q)
        taken.append(picked)
    return order[np.concatenate(taken)] if taken else np.zeros(0, int)
