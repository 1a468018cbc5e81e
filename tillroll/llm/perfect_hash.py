"""Minimal perfect hashes in shards, with the keys stored to verify every hit.

A shard places its keys level by level: those that are alone at their place of a level's bit array
stay there, the others go to the next level, of half as many bits at most.  A key's slot is the number of set bits
before its own.  Keys that no level separates (equal 64-bit hashes) get the slots behind and are
compared as they are.  ``Shards`` joins many shards into flat arrays, so that a lookup of many keys is
one pass of numpy per level, whatever the number of shards.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tillroll.llm.texthash import mix, prefix_sums, run_hash, text_buffers

U = np.uint64
LEVELS = 24
_SALTS = mix(np.arange(1, LEVELS + 1, dtype=U))


def hashes(keys: pa.Array) -> np.ndarray:
    """64-bit hashes of strings or byte strings; equal up to the case of A-Z."""
    data, offsets = text_buffers(keys)
    return run_hash(prefix_sums(data), offsets[:-1], offsets[1:])


def build(hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of the bit arrays, bits of each level, order): ``order[slot]`` is the key of each slot."""
    sizes, words, order = np.zeros(LEVELS, np.int64), [], []
    left = np.arange(len(hashed))
    for level in range(LEVELS):
        if not len(left):
            break
        bits = -(-2 * len(left) // 64) * 64
        place = (mix(hashed[left] ^ _SALTS[level]) % U(bits)).astype(np.int64)
        alone = np.bincount(place, minlength=bits)[place] == 1
        row = np.zeros(bits, np.uint8)
        row[place[alone]] = 1
        words.append(np.packbits(row, bitorder="little").view("<u8"))
        sizes[level] = bits
        order.append(left[alone][np.argsort(place[alone])])
        left = left[~alone]
    return np.concatenate([*words, np.zeros(0, U)]).astype("<u8"), sizes, np.concatenate([*order, left]).astype(np.int64)


class Shards:
    """Shards given by (words, sizes, keys in slot order); numbered as they come."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> None:
        self.words = np.concatenate([p[0] for p in parts] + [np.zeros(1, "<u8")])
        starts = np.cumsum([0] + [64 * len(p[0]) for p in parts])[:-1]
        self.sizes = np.stack([p[1] for p in parts])
        self.base = starts[:, None] + np.cumsum(self.sizes, axis=1) - self.sizes
        set_before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])
        self.set_before = set_before[:-1]
        self.bits_at = set_before[starts // 64]                    # set bits before each shard
        n = np.array([len(p[2]) for p in parts])
        self.first = np.cumsum(n) - n                              # place of its first key among all keys
        self.keys = pa.chunked_array([p[2] for p in parts]).combine_chunks()
        self.rest: dict[tuple[int, bytes], int] = {}
        ends = np.append(self.bits_at[1:], self.set_before[-1])
        for s, (words, _, keys) in enumerate(parts):
            for slot in range(int(ends[s] - self.bits_at[s]), len(keys)):
                self.rest[s, keys[slot].as_py()] = slot

    def slots(self, shard: np.ndarray, hashed: np.ndarray, keys: pa.Array) -> np.ndarray:
        """The slot of each key in its shard, -1 if the key stored there is another."""
        at = np.full(len(hashed), -1, np.int64)
        open_ = np.arange(len(hashed))
        for level in range(LEVELS):
            size = self.sizes[shard[open_], level]
            open_ = open_[size > 0]
            if not len(open_):
                break
            size = size[size > 0]
            place = self.base[shard[open_], level] + (mix(hashed[open_] ^ _SALTS[level]) % size.astype(U)).astype(np.int64)
            word, bit = self.words[place >> 6], (place & 63).astype(U)
            hit = (word >> bit) & U(1) == 1
            below = np.bitwise_count(word[hit] & ((U(1) << bit[hit]) - U(1))).astype(np.int64)
            at[open_[hit]] = self.set_before[place[hit] >> 6] + below - self.bits_at[shard[open_[hit]]]
            open_ = open_[~hit]
        found = np.flatnonzero(at >= 0)
        if len(found):
            stored = self.keys.take(pa.array(self.first[shard[found]] + at[found]))
            same = pc.equal(stored, keys.take(pa.array(found))).to_numpy(zero_copy_only=False)
            at[found[~same]] = -1
        if self.rest:
            for i in np.flatnonzero(at < 0).tolist():
                at[i] = self.rest.get((int(shard[i]), keys[i].as_py()), -1)
        return at
