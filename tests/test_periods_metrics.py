"""Period maths and the metric formula compiler."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillroll import model as M
from tillroll.functions import metrics as MX
from tillroll.functions import periods as P

REF = dt.date(1998, 3, 3)  # a Tuesday
d = dt.date


@pytest.mark.parametrize("name,expected", [
    ("Yesterday", (d(1998, 3, 3), d(1998, 3, 3))),
    ("Week to Date", (d(1998, 3, 2), d(1998, 3, 3))),
    ("Last Week", (d(1998, 2, 23), d(1998, 3, 1))),
    ("Last 7 Days", (d(1998, 2, 25), d(1998, 3, 3))),
    ("Month to Date", (d(1998, 3, 1), d(1998, 3, 3))),
    ("Last Month", (d(1998, 2, 1), d(1998, 2, 28))),
    ("Quarter to Date", (d(1998, 1, 1), d(1998, 3, 3))),
    ("Last Quarter", (d(1997, 10, 1), d(1997, 12, 31))),
    ("Year to Date", (d(1998, 1, 1), d(1998, 3, 3))),
    ("Last Year", (d(1997, 1, 1), d(1997, 12, 31))),
    ("Last 30 Days", (d(1998, 2, 2), d(1998, 3, 3))),
    ("Last 90 Days", (d(1997, 12, 4), d(1998, 3, 3))),
    ("Something else", (d(1998, 3, 1), d(1998, 3, 3))),
])
def test_resolve_period(name, expected):
    assert P.resolve_period(name, REF) == expected


def test_ly_prior_clamp_window():
    cur = P.resolve_period("Last 30 Days", REF)
    ly = P.ly_range(*cur)
    assert ly == (d(1997, 2, 3), d(1997, 3, 4))
    assert ly[0].weekday() == cur[0].weekday()
    assert P.prior_period(*cur) == (d(1998, 1, 3), d(1998, 2, 1))
    assert P.clamp_range((d(1990, 1, 1), d(2010, 1, 1)), d(1995, 1, 1), d(2001, 8, 1)) == (
        d(1995, 1, 1), d(2001, 8, 1))
    assert P.spark_window(d(1998, 3, 1), d(1998, 3, 3)) == (d(1998, 2, 2), d(1998, 3, 3), "D")
    assert P.spark_window(d(1998, 1, 1), d(1998, 2, 14))[2] == "D"
    assert P.spark_window(d(1998, 1, 1), d(1998, 6, 1))[2] == "W"
    assert P.spark_window(d(1997, 1, 1), d(1998, 6, 1))[2] == "M"
    assert len(P.period_rows(REF)) == 36


def test_formula_inputs_and_rejects():
    assert sorted(MX.formula_inputs("contribution_margin")) == ["gross_profit", "revenue", "spend"]
    assert MX.formula_inputs("orders") == ["orders"]
    with pytest.raises(KeyError):
        MX.metric_column("nope", F.col)


def test_all_formulas_against_python(spark):
    rows = [
        {b: float(i + 1) * (j + 2) for j, b in enumerate(M.BASE_METRICS)} for i in range(3)]
    rows.append({b: 0.0 for b in M.BASE_METRICS})  # every denominator zero
    df = spark.createDataFrame(rows)
    out = df.select(*[MX.metric_column(m, F.col).alias(m) for m in M.DERIVED_METRICS]).collect()
    for r_in, r_out in zip(rows, out):
        for m, (formula, _, _) in M.DERIVED_METRICS.items():
            try:
                with_nan = eval(formula, {"__builtins__": {}}, r_in)  # test oracle only
            except ZeroDivisionError:
                with_nan = None
            assert r_out[m] == with_nan, m


def test_pct_change_and_favourability(spark):
    df = spark.createDataFrame([(110.0, 100.0), (1.0, 0.0), (None, 5.0), (90.0, 100.0)],
                               "a double, b double")
    got = [r[0] for r in df.select(MX.pct_change(F.col("a"), F.col("b"))).collect()]
    assert got[1:3] == [None, None]
    assert abs(got[0] - 10.0) < 1e-9 and abs(got[3] + 10.0) < 1e-9
    z = spark.createDataFrame([(0.0,), (-1.0,), (None,)], "d double")
    assert [r[0] for r in z.select(MX.is_good("spend", F.col("d"))).collect()] == [False, True, None]
    assert [r[0] for r in z.select(MX.is_good("revenue", F.col("d"))).collect()] == [True, False, None]
    u = spark.createDataFrame([(0.5, 0.25)], "a double, b double")
    assert u.select(MX.delta_in_units("ctr", F.col("a"), F.col("b"))).first()[0] == 25.0
    assert u.select(MX.delta_in_units("aov", F.col("a"), F.col("b"))).first()[0] == 0.25
