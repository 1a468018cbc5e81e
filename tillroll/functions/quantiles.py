"""Exact percentiles (linear interpolation) by successive narrowing.

``percentile`` / ``percentile_cont`` merge every distinct value into one final
task, and a global window sorts everything in one partition.  Here instead:

1. distinct values with their counts (``groupBy``; partial aggregation, so a
   value repeated a billion times is one row), written once;
2. every wanted rank lies in an interval of values, at first the whole line.
   ``percentile_approx`` over the distinct values of an interval (a sketch of
   fixed size per task) cuts it into slices of about equally many values, so an
   outlier takes no slice of its own;
3. the rows below and inside each slice are counted exactly, the slice that
   holds the rank becomes its interval, and it is cut again until it has at
   most ``BOUND`` distinct values;
4. a running count over those few values gives the values at the two ranks around
   each position, and ``lo + (hi - lo) * (pos - floor(pos))`` with
   ``pos = (n - 1) * p`` — the same arithmetic as common SQL engines.

Each round divides the distinct values by about ``SLICES``; what it brings back
is a row per slice.  A billion values take three rounds.
"""
from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillroll.sources.io import scratch_path

#: Slices of an interval, distinct values that a last interval may have, accuracy of the cuts.
SLICES, BOUND, ACCURACY = 64, 4096, 10_000


class Interval(NamedTuple):
    """Values ``low`` <= v <= ``high``, of which ``before`` rows lie below."""
    low: float
    high: float
    before: int
    values: int

    def holds(self, v: Column) -> Column:
        return v.between(self.low, self.high)


def _cut(counts: DataFrame, interval: Interval, ranks: list[int]) -> dict[int, Interval]:
    """For each rank in ``interval`` the slice of it that holds the rank."""
    inside = counts.filter(interval.holds(F.col("_v")))
    shares = [i / SLICES for i in range(1, SLICES)]
    edges = sorted(set(inside.agg(F.percentile_approx("_v", shares, ACCURACY)).first()[0]))
    number = F.size(F.filter(F.lit(edges), lambda e: e < F.col("_v")))
    slices = inside.groupBy(number.alias("s")).agg(
        F.min("_v").alias("low"), F.max("_v").alias("high"), F.sum("_c").alias("rows"), F.count(F.lit(1)).alias("n")).orderBy("s").collect()
    out, before = {}, interval.before
    for s in slices:
        out.update({r: Interval(s.low, s.high, before, s.n) for r in ranks if before <= r < before + s.rows})
        before += s.rows
    return out


def narrowed(counts: DataFrame, ranks: list[int], whole: Interval, bound: int = BOUND) -> dict[int, Interval]:
    """For each rank an interval of at most ``bound`` distinct values that holds it."""
    found = dict.fromkeys(ranks, whole)
    while wide := {i for i in found.values() if i.values > bound}:
        for interval in wide:
            found |= _cut(counts, interval, [r for r, i in found.items() if i == interval])
    return found


def exact_percentiles(df: DataFrame, col: str, ps: list[float], names: list[str] | None = None,
                      bound: int = BOUND) -> DataFrame:
    """One-row DataFrame with the exact ``ps`` percentiles of ``df[col]`` (nulls and NaN
    ignored; null if there is no value); columns ``names`` (default ``p0, p1, ...``)."""
    spark = df.sparkSession
    names = names or [f"p{i}" for i in range(len(ps))]
    values = df.select(F.col(col).cast("double").alias("_v")).filter("_v IS NOT NULL AND NOT isnan(_v)")
    path = scratch_path(spark, "value_counts")
    values.groupBy("_v").agg(F.count(F.lit(1)).alias("_c")).write.parquet(path)
    counts = spark.read.schema("_v double, _c bigint").parquet(path)
    all_ = counts.agg(F.sum("_c").alias("rows"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.count(F.lit(1)).alias("n")).first()
    if not all_.n:
        return spark.range(1).select(*[F.lit(None).cast("double").alias(name) for name in names])
    at = [(all_.rows - 1) * p for p in ps]
    ranks = sorted({r for x in at for r in (math.floor(x), math.ceil(x))})
    found = narrowed(counts, ranks, Interval(all_.low, all_.high, 0, all_.n), bound)
    running = W.partitionBy("_low").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    few = [counts.filter(i.holds(F.col("_v"))).withColumns({"_low": F.lit(i.low), "_before": F.lit(i.before)}) for i in set(found.values())]
    part = few[0]
    for other in few[1:]:
        part = part.unionByName(other)
    part = part.withColumn("_end", F.col("_before") + F.sum("_c").over(running))      # ranks [_end - _c, _end)

    def value(rank: int) -> Column:
        own = (F.col("_low") == found[rank].low) & (F.col("_end") - F.col("_c") <= rank) & (rank < F.col("_end"))
        return F.max(F.when(own, F.col("_v")))

    return part.agg(*[(value(math.floor(x)) + (value(math.ceil(x)) - value(math.floor(x))) * F.lit(x - math.floor(x))).alias(name)
                      for x, name in zip(at, names, strict=True)])
