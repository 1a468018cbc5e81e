"""Exact percentiles: equal to numpy whatever the distribution, and never a large ranking task."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.functions import quantiles as Q

PS = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]


def numpy_says(values):
    return [float(x) for x in np.quantile(np.array(values, float), PS)]


@pytest.mark.parametrize("name,values", [
    ("outlier", [*np.random.default_rng(1).random(30_000).tolist(), 1e12]),
    ("exponents", (10.0 ** np.random.default_rng(2).uniform(-300, 300, 20_000)).tolist()),
    ("ties", [1.0] * 20_000 + [2.0] * 5 + [-7.5, 0.0, -0.0]),
    ("one", [3.25]),
    ("infinite", [float("-inf"), 1.0, 2.0, 4.0, 5.0, 6.0, 9.0, 11.0, 12.0, 13.0, 14.0, 20.0]),
])
def test_percentiles_equal_numpy(spark, name, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double").repartition(6)
    got = list(Q.exact_percentiles(df, "v", PS, bound=500).first())
    if name == "infinite":
        got, want = got[1:], numpy_says(values)[1:]
    else:
        want = numpy_says(values)
    assert got == pytest.approx(want, rel=1e-12, abs=0)


def test_no_ranking_task_above_a_hundredth(spark):
    """A million values and one far outlier: what is ranked stays below the bound."""
    df = spark.range(1_000_000).select((F.rand(3) * 1e6).alias("v")).unionByName(spark.createDataFrame([(1e12,)], "v double"))
    values = np.array([r.v for r in df.collect()])
    assert list(Q.exact_percentiles(df, "v", [0.5, 0.9]).first()) == pytest.approx(np.quantile(values, [0.5, 0.9]).tolist(), rel=1e-15)
    counts = df.groupBy(F.col("v").alias("_v")).agg(F.count(F.lit(1)).alias("_c")).cache()
    ranks = [500_000, 900_000]
    found = Q.narrowed(counts, ranks, Q.Interval(float(values.min()), 1e12, 0, len(values)))
    order = np.sort(values)
    for rank, interval in found.items():
        assert interval.values <= Q.BOUND < len(values) / 100
        assert interval.low <= order[rank] <= interval.high
        assert interval.before == (values < interval.low).sum()
    counts.unpersist()
