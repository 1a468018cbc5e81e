"""Lane mappers and the stacked fact.

Each source fills only its own lane of base metrics; the others are typed
nulls.  Lanes are narrow ``select``s (no shuffle) except the shop lane, which
aggregates orders to day x country.  The fact is a ``unionByName`` of the
lanes, so Catalyst prunes columns and pushes date filters into every lane's
scan when a report reads only part of it.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll import model as M
from tillroll.functions import dims as D

MONEY = "decimal(18,2)"
CURRENCY_METRICS = [m for m, (_, fmt, _) in M.BASE_METRICS.items() if fmt == "currency"]


def metric_type(metric: str) -> str:
    return MONEY if metric in CURRENCY_METRICS else "bigint"


FACT_COLUMNS = M.DIMENSIONS + list(M.BASE_METRICS)


def _assemble(df: DataFrame, dims: dict[str, Column | str], metrics: dict[str, Column]) -> DataFrame:
    """Project a lane onto the full fact schema, nulls for metrics it does not own."""
    cols = []
    for d in M.DIMENSIONS:
        v = dims.get(d, M.NA)
        c = F.lit(v) if isinstance(v, str) else v
        cols.append((c.cast("date") if d == "date" else c.cast("string")).alias(d))
    for m in M.BASE_METRICS:
        c = metrics.get(m)
        cols.append((c if c is not None else F.lit(None)).cast(metric_type(m)).alias(m))
    return df.select(*cols)


def map_orders(orders: DataFrame) -> DataFrame:
    """Shop orders -> sales lane at day x country (a null country is kept as a group)."""
    g = orders.groupBy(F.to_date("created_at").alias("date"), "country").agg(
        F.count("order_id").alias("orders"),         # an order is one row of the feed
        F.sum("net_sales").alias("revenue"),
        F.sum("gross_sales").alias("gross_sales"),
        F.sum("discounts").alias("discounts"),
        F.sum("cogs").alias("cogs"))
    return _assemble(D.with_geo(g), {"date": F.col("date"), "source": "shopify", **D.geo_refs()}, {
        "orders": F.col("orders"),
        "revenue": F.round("revenue", 2),
        "gross_sales": F.round("gross_sales", 2),
        "discounts": F.round("discounts", 2),
        "cogs": F.round("cogs", 2),
        "gross_profit": F.round(F.col("revenue") - F.col("cogs"), 2),
    })


def map_traffic(traffic: DataFrame) -> DataFrame:
    """Web analytics -> traffic lane, one fact row per feed row."""
    t = D.with_channel(D.with_geo(traffic))
    channel, platform = F.col("marketing_channel"), F.col("paid_ad_platform")
    camp_raw = F.coalesce(F.col("campaign"), F.lit(""))
    return _assemble(t, {
        "date": D.compact_date("event_date"),
        "source": "ga4",
        "marketing_channel": channel,
        "marketing_channel_group": F.col("marketing_channel_group"),
        "marketing_campaign": F.when(platform == "Meta", D.campaign_prefix(camp_raw)).otherwise(camp_raw),
        "paid_ad_platform": platform,
        "paid_campaign_type": D.campaign_type(camp_raw, channel),
        **D.geo_refs(),
        "device": D.device("device"),
    }, {
        "visits": F.col("sessions"),
        "engaged_visits": F.col("engaged_sessions"),
        "add_to_carts": F.col("sessions_with_atc"),
        "checkouts": F.col("sessions_with_checkout"),
    })


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None)


def _ad_lane(df: DataFrame, source: str, channel: str, platform: str, prefix_campaign: bool,
             metrics: dict[str, Column], type_col: str | None = None) -> DataFrame:
    name = F.coalesce(F.col("campaign_name"), F.lit(""))
    ptype = _optional(df, type_col) if type_col else None
    return _assemble(D.with_geo(df), {
        "date": F.col("date"),
        "source": source,
        "marketing_channel": channel,
        "marketing_channel_group": M.PAID_LABEL,
        "marketing_campaign": D.campaign_prefix(name) if prefix_campaign else name,
        "paid_ad_platform": platform,
        "paid_campaign_type": D.campaign_type(name, channel, ptype),
        **D.geo_refs(),
    }, {"spend": F.col("spend"), "impressions": F.col("impressions"),
        "clicks": F.col("clicks"), **metrics})


def map_meta(df: DataFrame) -> DataFrame:
    """Meta ads -> platform lane; optional reach / 1d / 7d / 28d columns."""
    return _ad_lane(df, "meta", "Paid Social", "Meta", True, {
        "link_clicks": _optional(df, "link_clicks"),
        "reach": _optional(df, "reach"),
        "platform_conversions_1d": _optional(df, "purchase_1d"),
        "platform_conversions_7d": _optional(df, "purchase_7d"),
        "platform_conversions_28d": _optional(df, "purchase_28d"),
        "platform_conversion_value_1d": _optional(df, "purchase_value_1d"),
        "platform_conversion_value_7d": _optional(df, "purchase_value_7d"),
        "platform_conversion_value_28d": _optional(df, "purchase_value_28d"),
    })


def map_search_ads(df: DataFrame, source: str, platform: str) -> DataFrame:
    """Google / Microsoft ads -> platform lane; conversions in the 7d columns."""
    return _ad_lane(df, source, "Paid Search", platform, False, {
        "platform_conversions_7d": F.col("conversions"),
        "platform_conversion_value_7d": F.col("conversions_value"),
    }, type_col="campaign_type")


def map_google(df: DataFrame) -> DataFrame:
    return map_search_ads(df, "google_ads", "Google")


def map_microsoft(df: DataFrame) -> DataFrame:
    return map_search_ads(df, "microsoft", "Microsoft")


def map_tiktok(df: DataFrame) -> DataFrame:
    return _ad_lane(df, "tiktok", "Paid Social", "Tiktok", True, {
        "platform_conversions_7d": F.col("conversions_7d"),
        "platform_conversion_value_7d": F.col("conversion_value_7d"),
    })


LANE_MAPPERS = [("orders", map_orders), ("traffic", map_traffic), ("meta", map_meta),
                ("google", map_google), ("microsoft", map_microsoft), ("tiktok", map_tiktok)]


def stacked_fact(feeds: dict[str, DataFrame | None]) -> DataFrame:
    """UNION ALL of the six lanes; an absent feed contributes nothing.

    Dimension nulls become the '(n/a)' sentinel."""
    lanes = [mapper(feeds[name]) for name, mapper in LANE_MAPPERS if feeds.get(name) is not None]
    fact = reduce(lambda a, b: a.unionByName(b), lanes)
    return fact.fillna(M.NA, subset=[d for d in M.DIMENSIONS if d != "date"])


def fact_row_counts(fact: DataFrame) -> DataFrame:
    """Build report: rows per source."""
    return fact.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
