"""Shuffles of the model build: lines move narrow and once, and the same rows come out."""
import datetime as dt
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tillroll.operators import facts as FX
from tillroll.plans import registry_reports as RR
from tillroll.sources.fixtures import DriverFeeds
from tillroll.sources.io import scan_parquet, write_parquet


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange hashpartitioning", plan))


def lines(spark):
    def row(day, product, title, units):
        return (dt.datetime(1998, *day), product, title, "Moto", "PROMO", "b", units, *[Decimal(units)] * 4)
    return spark.createDataFrame(
        [row((2, 3), "1", "a", 2), row((2, 3), "1", "b", 3), row((2, 3), "1", "a", 2), row((3, 4), "2", "c", 5), row((3, 4), None, "c", 5)],
        "created_at timestamp, product_id string, product_title string, category_l1 string, category string, style string, quantity bigint, "
        + ", ".join(f"{c} decimal(18,2)" for c in ("net_sales", "gross_sales", "discounts", "cogs")))


def sides(spark):
    day = dt.date(1998, 2, 3)
    items = spark.createDataFrame([(day, "1", 10, 1), (day, "1", 20, 2), (None, "1", 5, 5)], "date date, product_id string, item_views long, item_add_to_carts long")
    stock = spark.createDataFrame([(day, "1", 7), (None, None, 9)], "date date, product_id string, on_hand long")
    back = spark.createDataFrame([(day, "1", "return", 1, Decimal(4)), (day, "1", "exchange", 9, Decimal(9))],
                                 "date date, product_id string, kind string, quantity long, value decimal(18,2)")
    return items, stock, back


@pytest.mark.parametrize("parts", [{}, {199802: 3, 199803: 2}])
def test_dealt_product_fact_has_the_same_rows(spark, parts):
    plain = FX.product_fact(lines(spark), *sides(spark))
    with FX.dealt_joins(spark):
        dealt = FX.product_fact(lines(spark), *sides(spark), parts=parts)
        found = sorted(dealt.collect(), key=str)
    assert dealt.columns == plain.columns and found == sorted(plain.collect(), key=str) and len(found) == 3


def test_product_fact_moves_each_input_once(spark):
    with FX.dealt_joins(spark):
        dealt = FX.product_fact(lines(spark).hint("merge"), *[s.hint("merge") for s in sides(spark)], parts={})
        assert exchanges(dealt) == 4


def test_month_parts_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(FX, "PART_ROWS", 2)
    assert FX.month_parts(lines(spark), "created_at") == {199802: 2}


def test_stored_lines_hold_no_derived_column(spark):
    held = {}

    def store(name, build):
        held[name] = build()
        return held[name]
    feeds = DriverFeeds(spark, SF_SMALL, store)
    feeds.line_items()
    assert not {"net_sales", "cogs", "discounts", "sku", "product_id", "country", "warehouse"} & set(held["lines_base"].columns)


def test_order_pages_move_the_lines_once(spark):
    li = spark.createDataFrame([(1, Decimal(i), Decimal(0), Decimal(i), dt.datetime(1998, 1, 1), 5, "GB") for i in range(9)] + [
        (2, Decimal(3), Decimal(1), Decimal(2), dt.datetime(1998, 1, 2), 6, None)] * 2,
        "order_id long, gross_sales decimal(18,2), discounts decimal(18,2), net_sales decimal(18,2), created_at timestamp, customer_id long, country string")
    pages = RR.order_pages(li, page_items=4)
    assert exchanges(pages) == 1
    found = pages.select("id", "page", F.size("line_items").alias("n"), "total_price").collect()
    assert sum(r.n for r in found if r.id == 1) == 9 and {r.page for r in found if r.id == 1} <= {0, 1, 2} and len(found) > 2
    assert [(r.page, r.n, r.total_price) for r in found if r.id == 2] == [(0, 1, "4.00")]


def test_uneven_write_keeps_rows_and_folders(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "v int, m string")
    write_parquet(df, str(tmp_path / "d"), "m", even=False)
    assert sorted(map(tuple, scan_parquet(spark, str(tmp_path / "d")).collect())) == [(1, "a"), (2, "b"), (3, "a")]
