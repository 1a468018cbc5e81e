"""Best-fit packing by bin completion.

Documents become runs of token ids (an end id after each); a run longer than the capacity is cut,
from its end, into full pieces, so only its first piece may be shorter.  Pieces below the capacity
are packed by bin completion: take the largest length left, search the fillings around it by branch
and bound, and repeat that pattern as often as the counts allow.  The incumbent starts as the best-fit
filling; a branch is pruned when all that could still be added wastes no less, and a filling is
dominated, so not tried, when one piece at hand is as long as two of its pieces.  A search stops with
its incumbent after ``NODES`` nodes.  The whole plan is held against best-fit decreasing, the first
incumbent, and the one of fewer sequences is taken, so the result is never the worse of the two.

The search sees only how many pieces there are of each length - at most ``capacity - 1`` numbers,
whatever the input - and gives patterns over lengths.  Spark counts the lengths, and then deals
every piece its place: pieces of one length are ranked over hash buckets (a prefix sum over bucket
counts plus a rank inside the bucket), so a length that a third of all pieces share is never
gathered in one task.  The ids are made once; what is shuffled is one small row per piece.

Defined cases: a null or empty text is one piece, the end id alone; repeated rows are packed as
often as they occur; an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tillroll.llm import tokens
from tillroll.llm.scratch import store, tasks

CAPACITY, END_ID = 2048, 0
#: Fillings tried for one pattern before the best so far is taken.
NODES = 2000


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder().encode_to_numpy
        end = np.array([END_ID], "<u4")
        for batch in batches:
            owner, rows = [], []
            for i, text in enumerate(batch.column("text")):
                ids = np.concatenate([encode(text.as_py(), allowed_special="all").astype("<u4"), end])
                at, stop = 0, len(ids) % capacity or min(capacity, len(ids))
                while at < len(ids):
                    own = ids[at:stop]
                    owner.append(i)
                    rows.append((0 if not at else rows[-1][0] + 1, at, len(own), zlib.crc32(own.tobytes()), own))
                    at, stop = stop, stop + capacity
            piece, start, length, crc, own = zip(*rows, strict=True) if rows else ((),) * 5
            out = {"doc_id": batch.column("doc_id").take(pa.array(owner, pa.int64())), "piece": pa.array(piece, pa.int32()),
                   "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            if keep_ids:
                out["ids"] = pa.array([x.tolist() for x in own], pa.list_(pa.int32()))
            yield pa.record_batch(out)

    return source.mapInArrow(cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids)


def _filling(room: int, sizes: list[int], left: dict[int, int]) -> list[int]:
    """The pieces that fill ``room`` best, by branch and bound over undominated fillings; sizes ascend."""
    volume = list(accumulate(size * left[size] for size in sizes))
    best: list[int] = []
    best_waste, nodes = room, 0
    at = bisect_right(sizes, room)
    while at:  # best fit: the largest that fits, again and again
        size = sizes[at - 1]
        if k := min(best_waste // size, left[size]):
            best += [size] * k
            best_waste -= size * k
        at = bisect_right(sizes, best_waste, hi=at - 1)

    def grow(rest: int, stop: int, chosen: list[int], used: dict[int, int]) -> bool:
        nonlocal best, best_waste, nodes
        if rest < best_waste:
            best, best_waste = list(chosen), rest
        for i in range(bisect_right(sizes, rest, hi=stop) - 1, -1, -1):
            if not best_waste or nodes > NODES:
                return True
            # this size and the smaller ones together; the sums shrink with i
            if rest - volume[i] >= best_waste:
                break
            size = sizes[i]
            if used.get(size, 0) >= left[size] or any(left.get(c + size, 0) > used.get(c + size, 0) for c in chosen):
                continue
            nodes += 1
            chosen.append(size)
            used[size] = used.get(size, 0) + 1
            grow(rest - size, i + 1, chosen, used)
            chosen.pop()
            used[size] -= 1
        return best_waste == 0

    grow(room, len(sizes), [], {})
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """The plan of best-fit decreasing, found for all pieces of a length at once.

    A sequence that a piece fits best stays the best for the next of that length, so each sequence
    of a kind takes as many as it has room for, and at most one of them is left half done."""
    kinds: list[tuple[int, int, dict[int, int], int]] = []  # (room, number, pattern, times) by room
    number = 0
    for size in sorted(counts, reverse=True):
        n, changed = counts[size], []
        at = bisect_left(kinds, (size, -1))
        while n:
            room, _, pattern, times = kinds.pop(at) if at < len(kinds) else (capacity, 0, {}, n)
            each = room // size
            full = min(times, n // each)
            rest = 0 if full == times else n - full * each
            for k, many in ((each, full), (rest, 1 if rest else 0)):
                if many:
                    number += 1
                    changed.append((room - k * size, number, {**pattern, size: k}, many))
            n -= full * each + rest
            if pattern and (spare := times - full - (1 if rest else 0)):
                number += 1
                changed.append((room, number, pattern, spare))
        for kind in changed:
            insort(kinds, kind)
    return [(pattern, times) for _, _, pattern, times in kinds]


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pieces of each length, times) in order: what each sequence holds, and how many such there are."""
    counts = {size: n for size, n in counts.items() if n}
    left = dict(counts)
    sizes, out = sorted(left), []
    while sizes:
        top = sizes[-1]
        left[top] -= 1
        chosen = [top, *_filling(capacity - top, sizes, left)]
        left[top] += 1
        pattern = {size: chosen.count(size) for size in chosen}
        times = min(left[size] // k for size, k in pattern.items())
        for size, k in pattern.items():
            left[size] -= k * times
        sizes = [size for size in sizes if left[size]]
        out.append((pattern, times))
    return min(out, best_fit(counts, capacity), key=lambda plan: sum(times for _, times in plan))


def slots(plan: list[tuple[dict[int, int], int]], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, per sequence, offset) of every run of places."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, times in plan:
        offset = 0
        for size, k in pattern.items():
            rank = used.get(size, 0)
            out.append((size, rank, rank + k * times, sequence, k, offset))
            used[size] = rank + k * times
            offset += size * k
        sequence += times
    return [*out, (capacity, 0, 1 << 62, sequence, 1, 0)]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         keep_ids: bool = False) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    spark = docs.sparkSession
    cut = pieces(docs, id_col, text_col, capacity, keep_ids)
    cut = store(cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(tasks(spark)))), "pieces")
    by_bucket = cut.groupBy("bucket", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    by_bucket = store(by_bucket.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "lengths")
    counts = {r.length: r.n for r in by_bucket.groupBy("length").agg(F.sum("n").alias("n")).filter(F.col("length") < capacity).collect()}
    # one row for each run of places: bounded by the lengths there are and the pieces in a pattern
    places = spark.createDataFrame(slots(patterns(counts, capacity), capacity),
                                   "length long, from_rank long, to_rank long, first long, per long, place long")
    own = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (cut.withColumn("own_rank", F.row_number().over(own) - 1)
              .join(by_bucket.select("bucket", "length", "before").hint("merge"), ["bucket", "length"])  # grows with the buckets: not to be broadcast
              .withColumn("rank", F.col("before") + F.col("own_rank")))
    at = F.col("rank") - F.col("from_rank")
    out = (ranked.join(F.broadcast(places.withColumnRenamed("length", "size")),
                       (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")))
           .withColumn("sequence_id", F.col("first") + F.floor(at / F.col("per")).cast("long"))
           .withColumn("offset", F.col("place") + at % F.col("per") * F.col("length")))
    return out.select(F.col("doc_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * keep_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
