"""Mergeable customer state: what customer reports need of the order history, stored once.

Per customer and month ordered in, the days with their number of orders and exact revenue: at most 31
entries, so no row grows with a busy customer.  States merge by summing days, so new orders are added
without the history: ``merged`` of the stored state and the state of the new orders equals the
state of all orders.

``customer_kpis`` answers any range from it: whole months and parts of months alike, without the orders.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.compare import in_range, month_number
from tillroll.plans.common import dsum

MONEY = "decimal(38,2)"
DAYS = "map<int,struct<orders:bigint,revenue:decimal(38,2)>>"


def _month_rows(days: DataFrame) -> DataFrame:
    """(customer_id, month, days) of one row per (customer_id, date, orders, revenue)."""
    entry = F.struct(F.dayofmonth("date").alias("key"), F.struct(F.col("orders"), F.col("revenue").cast(MONEY).alias("revenue")).alias("value"))
    return days.groupBy("customer_id", month_number(F.col("date")).alias("month")).agg(
        F.map_from_entries(F.sort_array(F.collect_list(entry))).cast(DAYS).alias("days"))


def customer_state(orders: DataFrame) -> DataFrame:
    """(customer_id, month, days) of orders (customer_id, created_at, net_sales); a null customer is one group.

    Orders are summed to days first (partial aggregation), so a customer with a third of all orders is a few rows."""
    days = orders.filter(F.col("created_at").isNotNull()).groupBy("customer_id", F.to_date("created_at").alias("date")).agg(
        F.count(F.lit(1)).alias("orders"), F.coalesce(F.sum("net_sales"), F.lit(0)).cast(MONEY).alias("revenue"))
    return _month_rows(days)


def exploded(state: DataFrame) -> DataFrame:
    """(customer_id, date, orders, revenue) of a state."""
    day = F.make_date((F.col("month") / 100).cast("int"), F.col("month") % 100, F.col("day"))
    return state.select("customer_id", "month", F.explode("days").alias("day", "v")).select(
        "customer_id", day.alias("date"), "v.orders", "v.revenue")


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """The state of the orders of both."""
    days = exploded(a).unionByName(exploded(b)).groupBy("customer_id", "date").agg(
        F.sum("orders").alias("orders"), F.sum("revenue").cast(MONEY).alias("revenue"))
    return _month_rows(days)


def _in_days(rng) -> tuple:
    """Orders and revenue of a month row inside ``rng``."""
    lo, hi = F.lit(rng[0]).cast("date"), F.lit(rng[1]).cast("date")
    first, last = month_number(lo), month_number(hi)
    # a month inside the range counts every day; the months at its ends only some
    low = F.when(F.col("month") == first, F.dayofmonth(lo)).otherwise(1)
    high = F.when(F.col("month") == last, F.dayofmonth(hi)).otherwise(31)
    inside = F.col("month").between(first, last)
    days = F.when(inside, F.map_filter("days", lambda d, v: d.between(low, high))).otherwise(F.map_from_entries(F.array().cast("array<struct<key:int,value:struct<orders:bigint,revenue:decimal(38,2)>>>")))
    values = F.map_values(days)
    return (F.aggregate(values, F.lit(0).cast("bigint"), lambda s, v: s + v["orders"]),
            F.aggregate(values, F.lit(0).cast(MONEY), lambda s, v: (s + v["revenue"]).cast(MONEY)))


def per_customer(state: DataFrame, cur, cmp) -> DataFrame:
    """(customer_id, first, n_cur, n_cmp, rev_cur, rev_cmp, ltv): one pass over the state."""
    values = F.map_values("days")
    lowest = F.array_min(F.map_keys("days"))
    (n_cur, r_cur), (n_cmp, r_cmp) = _in_days(cur), _in_days(cmp)
    rows = state.select("customer_id", F.make_date((F.col("month") / 100).cast("int"), F.col("month") % 100, lowest).alias("first"),
                        n_cur.alias("n_cur"), r_cur.alias("rev_cur"), n_cmp.alias("n_cmp"), r_cmp.alias("rev_cmp"),
                        F.aggregate(values, F.lit(0).cast(MONEY), lambda s, v: (s + v["revenue"]).cast(MONEY)).alias("ltv"))
    return rows.groupBy("customer_id").agg(F.min("first").alias("first"), *[F.sum(c).alias(c) for c in ("n_cur", "n_cmp", "rev_cur", "rev_cmp", "ltv")])


def spends(fact: DataFrame, cur, cmp, filters=None) -> DataFrame:
    """One row (spend, spend_cmp): both ranges from one scan."""
    from tillroll.operators.compare import dim_filter, in_days
    return in_days(dim_filter(fact, filters), cur, cmp).agg(
        dsum("spend", in_range(cur)).alias("spend"), dsum("spend", in_range(cmp)).alias("spend_cmp"))
