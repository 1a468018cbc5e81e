"""Roll-ups and prefix sums answer as the fact does."""
import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tillroll import model as M
from tillroll.functions import periods as P
from tillroll.operators import compare as C
from tillroll.operators.lanes import metric_type
from tillroll.plans import lattice as LT
from tillroll.plans.ecommerce import period_totals
from tillroll.plans.prefix_sums import prefix_sums, range_totals
from tillroll.workspace import Workspace

from .conftest import SF_SMALL

RNG = (dt.date(1998, 2, 2), dt.date(1998, 3, 3))
EIGHT = LT.ROLLUPS["explorer"]


@pytest.fixture(scope="module")
def ws(spark):
    return Workspace(spark, SF_SMALL)


def by_key(df, keys):
    return {tuple(r[k] for k in keys): tuple(r) for r in df.collect()}


@pytest.mark.parametrize("dims", [[d] for d in EIGHT] + [list(EIGHT), ["geo_market", "device"], ["marketing_campaign"], ["date", "source"]])
def test_any_dimensions_and_all_metrics_equal_the_fact(ws, dims):
    got = by_key(ws.lattice.aggregate(dims, M.ALL_METRICS, RNG), dims)
    want = by_key(C.aggregate(C.apply_filters(ws.fact, *RNG), dims, M.ALL_METRICS), dims)
    assert want and got == want


def test_the_smallest_rollup_that_answers_is_chosen(ws):
    rows = {n: ws.lattice.rollup(n).count() for n in LT.ROLLUPS}
    for k in (0, 1, 2):
        for dims in itertools.combinations(EIGHT, k):
            name = ws.lattice.choose(list(dims))[0]
            able = [n for n in LT.ROLLUPS if set(dims) <= set(LT.ROLLUPS[n])]
            assert rows[name] == min(rows[n] for n in able)
    assert ws.lattice.choose(["geo_country"])[0] == "fact"
    assert ws.lattice.choose(["device"], {"geo_market": ["DE"], "no_such_column": ["x"], "source": []})[0] == "explorer"
    assert rows["day"] < rows["explorer"] <= ws.fact.count()


def test_filters_are_answered_from_a_rollup(ws):
    filters = {"geo_region": ["EU", "UK"], "no_such_column": ["x"]}
    got = by_key(ws.lattice.aggregate(["device"], ["visits", "spend", "roas"], RNG, filters), ["device"])
    assert got == by_key(C.aggregate(C.apply_filters(ws.fact, *RNG, filters), ["device"], ["visits", "spend", "roas"]), ["device"])


def test_lazy_workspace_answers_too(spark):
    lazy = Workspace(spark, SF_SMALL, materialize=False)
    assert lazy.lattice.choose([])[0] == "day"


def test_any_range_is_the_difference_of_two_rows(ws):
    r = random.Random(4)
    low, high = ws.fact.agg(F.min("date"), F.max("date")).first()
    days = [low + dt.timedelta(r.randrange(-40, (high - low).days + 40)) for _ in range(24)]
    ranges = [(str(i), a, b) for i, (a, b) in enumerate(zip(days[::2], days[1::2], strict=True))]
    ranges += [("first", low, low), ("last", high, high), ("all", low, high), ("before", low - dt.timedelta(9), low - dt.timedelta(1))]
    got = by_key(range_totals(ws.prefix_sums, ranges, M.ALL_METRICS, ["label"]), ["label"])
    for label, a, b in ranges:
        assert got[label,][1:] == tuple(C.totals(C.apply_filters(ws.fact, a, b), M.ALL_METRICS).first()), (label, a, b)


def test_prefix_table_has_every_day_and_ends_of_periods_meet_by_equality(ws):
    low, high, n = ws.prefix_sums.agg(F.min("date"), F.max("date"), F.count("*")).first()
    assert n == (high - low).days + 1
    plan = period_totals(ws.prefix_sums, RNG[1], ["revenue"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_gaps_nulls_and_an_empty_fact(spark):
    schema = f"date date, orders {metric_type('orders')}, revenue double"
    rows = [(dt.date(2020, 1, 1), 2, None), (dt.date(2020, 1, 1), None, None), (dt.date(2020, 1, 9), 3, None), (None, 50, 1.0)]
    table = prefix_sums(spark.createDataFrame(rows, schema), ["orders", "revenue"])
    assert [x.orders for x in table.orderBy("date").collect()] == [0] + [2] * 8 + [5]
    ranges = [("gap", dt.date(2020, 1, 2), dt.date(2020, 1, 8)), ("all", dt.date(2019, 1, 1), dt.date(2021, 1, 1))]
    assert {x.label: (x.orders, x.aov) for x in range_totals(table, ranges, ["orders", "aov"], ["label"]).collect()} == {"gap": (0, None), "all": (5, 0.0)}
    empty = prefix_sums(spark.createDataFrame([], schema), ["orders", "revenue"])
    assert {x.label: x.orders for x in range_totals(empty, ranges, ["orders"], ["label"]).collect()} == {"gap": 0, "all": 0}
    assert len(range_totals(empty, P.period_rows(RNG[1]), ["orders"], ["period", "side"]).collect()) == 36
