"""Day prefix sums: every base metric summed from the first day up to each day, stored once.

The total of any range is the difference of two rows, so a report over many ranges (36 selectors, custom
ranges) reads two rows a range and joins them by equality; its work depends neither on the length of the
ranges nor on the fact.  The table has a row per calendar day, gaps filled, and one day before the first,
so that every end of a range, clamped to the days there are, is a row.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillroll.functions import metrics as MX
from tillroll.functions.periods import as_date
from tillroll.operators import compare as C


def prefix_sums(days: DataFrame, bases: list[str]) -> DataFrame:
    """(date, bases) with running sums, of rows with a date and base metrics; rows without a date count nowhere.

    Rows are summed to days first, so the one ordered window sees a row per calendar day."""
    sums = days.filter(F.col("date").isNotNull()).groupBy("date").agg(*[F.sum(b).alias(b) for b in bases])
    calendar = sums.agg(F.min("date").alias("low"), F.max("date").alias("high")).select(
        F.explode(F.sequence(F.date_sub("low", 1), F.col("high"))).alias("date"))
    so_far = W.orderBy("date").rowsBetween(W.unboundedPreceding, W.currentRow)
    return calendar.join(sums, "date", "left").select("date", *[
        F.sum(F.coalesce(F.col(b), F.lit(0))).over(so_far).alias(b) for b in bases])


def range_totals(prefix: DataFrame, ranges: list[tuple], metrics: list[str], keys: list[str],
                 bounds: tuple[dt.date, dt.date] | None = None) -> DataFrame:
    """(keys, metrics) of every range; ``ranges`` has the values of ``keys``, then the first and the last day.

    Every range has its row: one without rows, outside the data or turned round sums to 0.  ``bounds`` are
    the first and last day of the prefix table (read from it if not given)."""
    spark = prefix.sparkSession
    low, high = bounds or tuple(prefix.agg(F.min("date"), F.max("date")).first())
    marks: list[tuple] = []
    for *names, start, end in ranges:
        start, end = as_date(start), as_date(end)
        if low is not None and start <= end:
            marks += [(*names, sign, min(max(day, low), high)) for sign, day in ((1, end), (-1, start - dt.timedelta(1)))]
    label = ", ".join(f"{k} string" for k in keys)
    bases = MX.inputs_for(metrics)
    ends = spark.createDataFrame(marks, f"{label}, sign int, date date")
    rows = prefix.filter(F.col("date").isin({m[-1] for m in marks})) if marks else prefix.limit(0)
    signed = rows.join(F.broadcast(ends), "date").select(  # two rows a range: the list of ranges bounds it
        *keys, *[F.when(F.col("sign") > 0, F.col(b)).otherwise(-F.col(b)).alias(b) for b in bases])
    every = spark.createDataFrame([tuple(r[:-2]) for r in ranges], label)
    return (signed.unionByName(every, allowMissingColumns=True).groupBy(*keys).agg(*C.sums(bases))
            .select(*keys, *C.metric_cols(metrics)))
