"""Cases that an oracle with the engine's own choices cannot see."""
import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.functions.quantiles import exact_percentiles
from tillroll.plans import ecommerce as E
from tillroll.plans.registry_reports import order_pages
from tillroll.sources import io as IO


@pytest.mark.parametrize("reuse,adaptive", [("true", "true"), ("false", "true"), ("false", "false")])
def test_percentiles_do_not_depend_on_the_plan(spark, reuse, adaptive):
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        df = spark.range(400_000).select((F.rand(7) * 1e6).alias("v"))
        vals = np.array([r.v for r in df.collect()])
        got = exact_percentiles(df, "v", [0.5, 0.9]).first()
        assert np.allclose(list(got), np.quantile(vals, [0.5, 0.9]), rtol=0, atol=1e-6)
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_percentiles_of_one_value_and_of_none(spark):
    assert list(exact_percentiles(spark.createDataFrame([(3.0,), (3.0,)], "v double"), "v", [0.5, 0.9]).first()) == [3.0, 3.0]
    assert list(exact_percentiles(spark.createDataFrame([], "v double"), "v", [0.5]).first()) == [None]


def test_a_day_of_both_ranges_counts_on_both_sides(spark):
    day = dt.date(1999, 1, 1)
    fact = spark.createDataFrame([(day + dt.timedelta(days=i), 1.0) for i in range(731)], "date date, revenue double")
    rows = E.trend_ty_ly(fact, "Year to Date", "W", "revenue", dt.date(2000, 12, 31)).collect()
    assert all(r.ly == 7.0 for r in rows[1:-1])
    assert rows[-1].ly == 7.0


def test_histogram_bins_floor_below_zero(spark, monkeypatch):
    from tillroll.plans import orders as O
    values = spark.createDataFrame([(-0.5,), (-0.1,), (7.0,)], "value double")
    monkeypatch.setattr(O, "per_order", lambda *a: values)
    bins = {(r.bin_start, r.bin_width) for r in O.order_value_histogram(None, None).collect()}
    width = next(iter(bins))[1]
    assert {b for b, _ in bins} == {round(math.floor(v / width + 1e-9) * width, 2) for v in (-0.5, -0.1, 7.0)}


PAYLOAD = {"customer": {"id": 4}, "shipping_address": {"country_code": "GB"}}


def _land(tmp, rows):
    (tmp / "a.json").write_text("\n".join(json.dumps({**PAYLOAD, **r}) for r in rows))
    return str(tmp)


def test_a_page_sent_again_replaces_the_earlier_one(spark, tmp_path):
    page = {"id": 1, "created_at": "1998-01-01T00:00:00", "total_shipping_price_set": {"shop_money": {"amount": "3.00"}}}
    path = _land(tmp_path, [
        {**page, "line_items": [{"price": "10.00", "quantity": 1}], "updated_at": "1998-01-01T00:00:00"},
        {**page, "line_items": [{"price": "10.00", "quantity": 1}], "updated_at": "1998-01-01T00:00:00"},
        {**page, "line_items": [{"price": "12.00", "quantity": 1}], "updated_at": "1998-01-02T00:00:00"},
        {**page, "page": 1, "line_items": [{"price": "5.00", "quantity": 2}], "updated_at": "1998-01-01T00:00:00"}])
    r = IO.merge_payload_pages(IO.flatten_payload(IO.read_payload(spark, path))).collect()
    assert [(x.order_id, float(x.gross_sales), float(x.shipping)) for x in r] == [(1, 22.0, 3.0)]


def test_a_huge_order_is_paged_and_comes_back_whole(spark, tmp_path):
    lines = spark.range(20_000).select(
        (F.col("id") % 2 * F.col("id") % 7).alias("order_id"),
        F.lit(dt.datetime(1998, 1, 1)).alias("created_at"), F.lit(4).cast("bigint").alias("customer_id"),
        F.lit("GB").alias("country"), (F.col("id") % 9_000 / 100).cast("decimal(18,2)").alias("gross_sales"),
        F.lit(0).cast("decimal(18,2)").alias("discounts"),
        (F.col("id") % 9_000 / 100).cast("decimal(18,2)").alias("net_sales"))
    pages = order_pages(lines, page_items=100)
    assert pages.agg(F.max(F.size("line_items"))).first()[0] < 200
    path = str(tmp_path / "p")
    pages.write.json(path)
    got = IO.merge_payload_pages(IO.flatten_payload(IO.read_payload(spark, path)))
    want = lines.groupBy("order_id").agg(F.sum("gross_sales").cast("decimal(18,2)").alias("gross_sales"))
    assert sorted(map(tuple, got.select("order_id", "gross_sales").collect())) == sorted(map(tuple, want.collect()))


def test_a_restarted_stream_goes_on_and_the_lane_appends(spark, tmp_path):
    from tillroll.streaming.order_landing import orders_stream, sales_lane_stream, start_orders_sink
    land, out = tmp_path / "land", str(tmp_path / "out")
    land.mkdir()
    for batch in (0, 1):
        rows = [{"id": 2 * batch + i, "created_at": f"1998-01-0{1 + batch}T00:00:00",
                 "line_items": [{"price": "1.00", "quantity": 1}]} for i in (0, 1)]
        (land / f"{batch}.json").write_text("\n".join(json.dumps(r) for r in rows))
        start_orders_sink(orders_stream(spark, str(land)), out).awaitTermination(120)
    assert spark.read.parquet(out).count() == 4
    lane = sales_lane_stream(orders_stream(spark, str(land)))
    q = (lane.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "lane"))
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert q.exception() is None


def test_targets_are_replaced_not_added(spark, tmp_path):
    path = str(tmp_path / "t")
    for value in ("1.10", "2.20"):
        raw = spark.createDataFrame([("1998-01-01", value, "x")], "date string, target_revenue string, note string")
        rows = IO.replace_targets(raw, path).collect()
    assert [tuple(map(str, r)) for r in rows] == [("1998-01-01", "2.20")]
    with pytest.raises(ValueError):
        IO.replace_targets(spark.createDataFrame([("a",)], "x string"), path)


def test_an_empty_fact_is_stored_and_read(spark, tmp_path):
    from tillroll.workspace import write_by_month
    empty = spark.createDataFrame([], "date date, v int")
    write_by_month(empty, str(tmp_path / "f"), ["date"])
    assert spark.read.schema("date date, v int, stored_month int").parquet(str(tmp_path / "f")).count() == 0
