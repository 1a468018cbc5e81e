"""Comparison engine and report edge cases on hand-made frames."""
import datetime as dt
from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from tillroll import model as M
from tillroll.functions.quantiles import exact_percentiles
from tillroll.operators import compare as C
from tillroll.operators import facts as FX
from tillroll.operators import lanes as L
from tillroll.plans import ecommerce as E

d = dt.date
CUR = (d(1998, 2, 2), d(1998, 3, 3))
LY = (d(1997, 2, 3), d(1997, 3, 4))


def fact_rows(spark, rows):
    """rows: (date, dims dict, metrics dict) -> frame with the full fact schema."""
    base = spark.createDataFrame([(r[0],) for r in rows], "date date")
    parts = []
    for i, (day, dims, mets) in enumerate(rows):
        one = spark.createDataFrame([(day,)], "date date")
        parts.append(L._assemble(one, {"date": F.col("date"), **dims},
                                 {k: F.lit(v) for k, v in mets.items()}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    del base
    return out


def test_totals_empty_is_zero(spark):
    f = fact_rows(spark, [(d(1998, 2, 10), {"source": "shopify"}, {"revenue": Decimal("10.00")})])
    t = C.totals(C.apply_filters(f, d(2000, 1, 1), d(2000, 1, 2)), ["revenue", "spend", "aov",
                                                                     "contribution"]).first()
    assert (t.revenue, t.spend, t.aov, t.contribution) == (0.0, 0.0, None, 0.0)


def test_filters_ignore_unknown_and_empty(spark):
    f = fact_rows(spark, [(d(1998, 2, 10), {"geo_region": "EU"}, {"orders": 1}),
                          (d(1998, 2, 10), {"geo_region": "US"}, {"orders": 2})])
    out = C.apply_filters(f, *CUR, {"geo_region": ["EU"], "nope": ["x"], "device": []})
    assert out.count() == 1


def test_dimension_table_semantics(spark):
    f = fact_rows(spark, [
        (d(1998, 2, 10), {"geo_market": "UK"}, {"revenue": Decimal("100.00"), "orders": 2}),
        (d(1997, 2, 10), {"geo_market": "UK"}, {"revenue": Decimal("50.00"), "orders": 1}),
        (d(1998, 2, 11), {"geo_market": "US"}, {"revenue": Decimal("30.00"), "orders": 1}),
        (d(1997, 2, 11), {"geo_market": "FR"}, {"revenue": Decimal("99.00"), "orders": 1}),
    ])
    t = {r.label: r for r in E.dimension_table(f, "geo_market", ["revenue", "aov"], CUR, LY).collect()}
    assert set(t) == {"UK", "US", "Total"}          # FR only in the comparison: dropped
    assert t["UK"].revenue_pct == 100.0
    assert t["US"].revenue_cmp is None               # absent in comparison -> null, not 0
    assert t["Total"].revenue == 130.0 and t["Total"].revenue_cmp == 149.0


def test_channel_table_total_not_sum_of_subtotals(spark):
    f = fact_rows(spark, [
        (d(1998, 2, 10), {"marketing_channel_group": "Paid", "marketing_channel": "Paid Search"},
         {"revenue": Decimal("10.00")}),
        (d(1998, 2, 10), {"marketing_channel_group": "Unpaid", "marketing_channel": "Email"},
         {"revenue": Decimal("5.00")}),
        (d(1998, 2, 10), {"source": "shopify"}, {"revenue": Decimal("100.00")}),
    ])
    rows = {r.label: r for r in E.channel_table(f, ["revenue"], CUR, LY).collect()}
    assert rows["Paid total"].revenue == 10.0 and rows["Unpaid total"].revenue == 5.0
    assert rows["Total"].revenue == 115.0
    assert "(n/a)" not in rows


def test_kpi_rows_targets(spark):
    f = fact_rows(spark, [(d(1998, 2, 10), {}, {"orders": 10, "visits": 1000,
                                                 "revenue": Decimal("500.00")})])
    targets = spark.createDataFrame([(d(1998, 2, 10), 20.0, 0.0)],
                                    "date date, target_orders double, target_visits double")
    r = {x.metric: x for x in C.kpi_rows(f, ["orders", "visits", "conversion_rate", "aov", "spend"],
                                         CUR, LY, targets).collect()}
    assert r["orders"].target == 20.0 and r["orders"].vtarg_pct == -50.0
    assert r["visits"].target == 0.0 and r["visits"].vtarg_pct is None   # target 0 -> no %
    assert r["conversion_rate"].target is None                         # implied 20/0
    assert r["aov"].target is None                                     # revenue untargeted
    assert r["spend"].target is None                                   # no column
    assert r["orders"].cmp == 0.0 and r["orders"].delta_pct is None
    none = {x.metric: x for x in C.kpi_rows(f, ["orders"], CUR, None, None).collect()}
    assert none["orders"].cmp is None and none["orders"].target is None


def test_target_rows_direct_and_implied(spark):
    t = spark.createDataFrame([(d(1998, 2, 10), 10.0, 100.0, 40.0)],
                              "date date, target_orders double, target_revenue double, target_visits double")
    r = {x.metric: x.target for x in C.target_rows(t, CUR, ["orders", "aov", "conversion_rate",
                                                            "roas", "clicks"]).collect()}
    assert r == {"orders": 10.0, "aov": 10.0, "conversion_rate": 0.25, "roas": None, "clicks": None}
    empty = {x.metric: x.target for x in C.target_rows(t, (d(2000, 1, 1), d(2000, 1, 2)),
                                                      ["orders"]).collect()}
    assert empty == {"orders": 0.0}


def test_trend_ty_ly_drops_open_week_and_aligns_by_position(spark):
    rows = [(d(1998, 1, 1) + dt.timedelta(days=i), {}, {"revenue": Decimal("1.00")}) for i in range(62)]
    rows += [(d(1997, 1, 2) + dt.timedelta(days=i), {}, {"revenue": Decimal("2.00")}) for i in range(62)]
    f = fact_rows(spark, rows)
    out = E.trend_ty_ly(f, "Year to Date", "W", "revenue", d(1998, 3, 3)).collect()
    assert out[-1].period == d(1998, 2, 23)              # week of 1998-03-02 is open
    assert [r.pos for r in out] == list(range(1, len(out) + 1))
    assert all(r.ly is not None for r in out)


def test_product_fact_fanout(spark):
    lines = spark.createDataFrame([
        (1, dt.datetime(1998, 2, 10), "p1", "Title A", "Moto", "cat", "s", 1, Decimal("10.00"),
         Decimal("0.00"), Decimal("10.00"), Decimal("4.50")),
        (2, dt.datetime(1998, 2, 10), "p1", "Title B", "Moto", "cat", "s", 2, Decimal("20.00"),
         Decimal("0.00"), Decimal("20.00"), Decimal("9.00"))],
        "order_id long, created_at timestamp, product_id string, product_title string, "
        "category_l1 string, category string, style string, quantity long, gross_sales decimal(18,2), "
        "discounts decimal(18,2), net_sales decimal(18,2), cogs decimal(18,2)")
    items = spark.createDataFrame([(d(1998, 2, 10), "p1", 7, 3)],
                                  "date date, product_id string, item_views long, item_add_to_carts long")
    pf = FX.product_fact(lines, items).orderBy("product_title").collect()
    assert [r.product_views for r in pf] == [7, 7]      # joined measures repeat per title
    assert [float(r.gross_profit) for r in pf] == [5.5, 11.0]


def test_exact_percentiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    vals = np.round(rng.gamma(2.0, 30.0, 3001), 2)
    vals[:1000] = 7.0                                    # one hot value
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    got = exact_percentiles(df, "v", [0.5, 0.9, 0.0, 1.0]).first()
    exp = np.quantile(vals, [0.5, 0.9, 0.0, 1.0])
    assert np.allclose(list(got), exp, rtol=0, atol=1e-9)


def test_orders_from_lines_rollup(spark):
    lines = spark.createDataFrame([
        (1, dt.datetime(1998, 1, 2), 7, "GB", Decimal("10.00"), Decimal("1.00"), Decimal("9.00"), Decimal("4.50")),
        (1, dt.datetime(1998, 1, 1), 8, "FR", Decimal("5.00"), Decimal("0.00"), Decimal("5.00"), Decimal("2.25"))],
        "order_id long, created_at timestamp, customer_id long, country string, gross_sales decimal(18,2), "
        "discounts decimal(18,2), net_sales decimal(18,2), cogs decimal(18,2)")
    o = FX.orders_from_lines(lines).first()
    assert (o.customer_id, o.country, float(o.net_sales), float(o.total_price), o.currency) == (
        8, "FR", 14.0, 14.0, "GBP")


def test_metric_lanes_fill_only_their_columns(spark):
    g = spark.createDataFrame([(d(1998, 2, 2), "google / cpc", "x", "mobile", "GB", 10, 8, 5, 3)],
                              "d date, source_medium string, campaign string, device string, country string, "
                              "sessions long, engaged_sessions long, sessions_with_atc long, sessions_with_checkout long")
    g = g.withColumn("event_date", F.date_format("d", "yyyyMMdd"))
    lane = L.map_traffic(g).first()
    assert lane.visits == 10 and lane.revenue is None and lane.marketing_channel == "Paid Search"
    assert lane.paid_ad_platform == "Google" and lane.date == d(1998, 2, 2)
    assert list(L.map_traffic(g).columns) == M.DIMENSIONS + list(M.BASE_METRICS)


def test_stacked_fact_absent_and_empty_feeds(spark):
    """An absent feed contributes nothing; an empty feed contributes no rows; schema is fixed."""
    tiktok = spark.createDataFrame(
        [(d(1998, 2, 2), "TOFU_x", "GB", Decimal("5.00"), 100, 3, 1, Decimal("9.00"))],
        "date date, campaign_name string, country string, spend decimal(18,2), impressions long, "
        "clicks long, conversions_7d long, conversion_value_7d decimal(18,2)")
    empty_meta = spark.createDataFrame([], "date date, campaign_name string, country string, "
                                           "spend decimal(18,2), impressions long, clicks long")
    f = L.stacked_fact({"orders": None, "traffic": None, "meta": empty_meta, "tiktok": tiktok})
    rows = f.collect()
    assert f.columns == M.DIMENSIONS + list(M.BASE_METRICS)
    assert len(rows) == 1 and rows[0].source == "tiktok" and rows[0].paid_campaign_type == "ToFu"
    assert rows[0].device == "(n/a)" and rows[0].marketing_campaign == "TOFU"
    t = C.totals(f, ["spend", "revenue", "platform_roas"]).first()
    assert (t.spend, t.revenue, t.platform_roas) == (5.0, 0.0, 1.8)
