"""Query registrations (one per operator / report of the inventory)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll import model as M
from tillroll.catalog import CUR, HEADLINE, LY, REF, query
from tillroll.functions import dims as D
from tillroll.operators import compare as C
from tillroll.operators import lanes as L
from tillroll.plans import ecommerce as E


def out(df: DataFrame) -> DataFrame:
    """Results carry doubles, never decimals (money is summed exactly before), and no storage column."""
    cols = [F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType)
            else F.col(f.name) for f in df.schema.fields if f.name != C.STORED_MONTH]
    return df.select(*cols)


# ── dimension rules over the feeds ──────────────────────────────────────
@query("dim_norm")
def q_dim_norm(ws):
    t = ws.feed("traffic")
    return t.groupBy("source_medium").agg(F.count(F.lit(1)).alias("rows")).select(
        "source_medium", D.norm("source_medium").alias("normalised"), "rows")


@query("dim_source_medium")
def q_dim_source_medium(ws):
    t = ws.feed("traffic")
    s, m = D.source_medium("source_medium")
    return t.groupBy("source_medium").agg(F.count(F.lit(1)).alias("rows")).select(
        "source_medium", s.alias("src"), m.alias("medium"), "rows")


@query("dim_channel")
def q_dim_channel(ws):
    t = ws.feed("traffic")
    return (t.groupBy("source_medium").agg(F.sum("sessions").alias("sessions"))
            .transform(D.with_channel)
            .select("source_medium", "marketing_channel", "marketing_channel_group", "sessions"))


@query("dim_platform")
def q_dim_platform(ws):
    t = ws.feed("traffic")
    return (t.groupBy("source_medium").agg(F.sum("sessions").alias("sessions"))
            .transform(D.with_channel).select("source_medium", "paid_ad_platform", "sessions"))


@query("dim_geo")
def q_dim_geo(ws):
    li = ws.feed("line_items")
    return (li.groupBy("country").agg(F.count(F.lit(1)).alias("lines"))
            .transform(D.with_geo).select("country", "geo_region", "geo_market", "geo_country", "lines"))


@query("dim_campaign")
def q_dim_campaign(ws):
    parts = []
    for feed, channel, typed, prefixed in (("meta", "Paid Social", False, True),
                                           ("google", "Paid Search", True, False),
                                           ("microsoft", "Paid Search", True, False),
                                           ("tiktok", "Paid Social", False, True)):
        df = ws.feed(feed)
        name = F.coalesce(F.col("campaign_name"), F.lit(""))
        ptype = F.col("campaign_type") if typed else F.lit(None).cast("string")
        parts.append(df.groupBy("campaign_name", ptype.alias("campaign_type")).agg(
            F.count(F.lit(1)).alias("rows")).select(
            F.lit(feed).alias("feed"), "campaign_name", "campaign_type",
            (D.campaign_prefix(name) if prefixed else name).alias("marketing_campaign"),
            D.campaign_type(name, channel, F.col("campaign_type")).alias("paid_campaign_type"),
            "rows"))
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


@query("dim_device")
def q_dim_device(ws):
    t = ws.feed("traffic")
    return (t.groupBy("device").agg(F.sum("sessions").alias("sessions"))
            .select("device", D.device("device").alias("device_label"), "sessions"))


# ── lanes and the stacked fact ──────────────────────────────────────────
@query("map_orders")
def q_map_orders(ws):
    return out(L.map_orders(ws.feed("orders")))


@query("map_traffic")
def q_map_traffic(ws):
    return out(L.map_traffic(ws.feed("traffic")))


@query("map_meta")
def q_map_meta(ws):
    return out(L.map_meta(ws.feed("meta")))


@query("map_google")
def q_map_google(ws):
    return out(L.map_google(ws.feed("google")))


@query("map_microsoft")
def q_map_microsoft(ws):
    return out(L.map_microsoft(ws.feed("microsoft")))


@query("map_tiktok")
def q_map_tiktok(ws):
    return out(L.map_tiktok(ws.feed("tiktok")))


@query("fact_stacked")
def q_fact_stacked(ws):
    return out(ws.fact).orderBy("date", "source")


@query("fact_row_counts")
def q_fact_row_counts(ws):
    return L.fact_row_counts(ws.fact)


@query("date_bounds")
def q_date_bounds(ws):
    rows, low, high = ws.from_footers(["fact"], "date")["fact"]
    return ws.spark.createDataFrame([(low, high, rows)], "min_date date, max_date date, rows bigint")


# ── query API ───────────────────────────────────────────────────────────
@query("totals")
def q_totals(ws):
    return C.totals(C.apply_filters(ws.fact, *CUR), M.ALL_METRICS)


@query("derived_metrics")
def q_derived_metrics(ws):
    return C.aggregate(C.apply_filters(ws.fact, *CUR), ["source"], list(M.DERIVED_METRICS))


@query("breakdown")
def q_breakdown(ws):
    return C.breakdown(C.apply_filters(ws.fact, *CUR), "geo_market", HEADLINE)


@query("aggregate_multi")
def q_aggregate_multi(ws):
    return C.aggregate(C.apply_filters(ws.fact, *CUR), ["marketing_channel", "device"],
                       ["revenue", "orders", "spend", "roas"])


FILTERS = {"geo_region": ["EU", "UK"], "marketing_channel_group": ["Paid"],
           "no_such_column": ["x"]}


@query("filter_range_inlist")
def q_filter_range_inlist(ws):
    return C.aggregate(C.apply_filters(ws.fact, *CUR, FILTERS), ["source", "geo_region"],
                       ["spend", "clicks", "impressions", "ctr", "cpc"])


@query("filter_options")
def q_filter_options(ws):
    """Every dimension's values from one scan of the fact, and the categories."""
    dims = ["marketing_channel_group", "marketing_channel", "paid_ad_platform",
            "paid_campaign_type", "geo_region", "geo_market", "device"]
    pair = lambda d: F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value"))
    values = ws.fact.select(F.inline(F.array(*[pair(d) for d in dims]))).filter(F.col("value") != M.NA)
    cat = ws.product_fact.select(F.inline(F.array(pair("category")))).filter(F.col("value").isNotNull())
    return values.unionByName(cat).distinct().orderBy("dimension", "value")


@query("trend_day")
def q_trend_day(ws):
    return C.trend(C.apply_filters(ws.fact, *CUR), "revenue", "D")


@query("trend_week")
def q_trend_week(ws):
    return C.trend(C.apply_filters(ws.fact, *CUR), "contribution", "W")


@query("trend_month")
def q_trend_month(ws):
    start = (REF.replace(month=1, day=1).replace(year=REF.year - 1))
    return C.trend(C.apply_filters(ws.fact, start, REF), "conversion_rate", "M")


@query("kpi_comparison")
def q_kpi_comparison(ws):
    return C.kpi_rows(ws.fact, M.ALL_METRICS, CUR, LY, ws.targets)


@query("kpi_summary")
def q_kpi_summary(ws):
    return E.kpi_summary(ws.fact, CUR, LY, ws.targets)


@query("dim_table_market")
def q_dim_table_market(ws):
    return E.dimension_table(ws.fact, "geo_market", M.KPI_GROUPS["Overview Metrics"], CUR, LY)


@query("dim_table_device")
def q_dim_table_device(ws):
    return E.dimension_table(ws.fact, "device", M.KPI_GROUPS["Funnel Metrics"], CUR, LY)


@query("channel_table")
def q_channel_table(ws):
    return E.channel_table(ws.fact, M.KPI_GROUPS["Overview Metrics"], CUR, LY)
