"""Customers and retention: customer KPIs, new vs returning, cohorts, email.

The customer's first order over all history is a ``groupBy(customer_id)``
aggregate (partial aggregation on the map side), never a window over one
customer's rows, so a hot customer cannot overload a task.  Cohort
membership is the bounded set of months a customer ordered in.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillroll.functions.dims import month_diff, period_start
from tillroll.functions.metrics import pct_change
from tillroll.operators.compare import in_days, in_range
from tillroll.plans.common import dsum, long_rows, ratio
from tillroll.plans.customer_state import per_customer, spends


def _orders(orders: DataFrame) -> DataFrame:
    return orders.withColumn("date", F.to_date("created_at"))


def customer_kpis(state: DataFrame, fact: DataFrame, cur, cmp, filters=None) -> DataFrame:
    """Customers, new customers, repeat rate, orders per customer, AOV, average
    lifetime revenue, blended CAC (spend / new) and LTV:CAC, with comparison.

    ``state`` is the stored customer state (``customer_state``): any range is answered
    without the order history; spend of both ranges comes from one scan of the fact."""
    per = per_customer(state, cur, cmp)
    known = F.col("customer_id").isNotNull()
    first_in = lambda rng: F.col("first").between(F.lit(rng[0]), F.lit(rng[1]))
    g = per.agg(
        F.count(F.when(known & (F.col("n_cur") > 0), 1)).alias("custs"),
        F.count(F.when(known & (F.col("n_cur") > 0) & first_in(cur), 1)).alias("new"),
        F.sum("n_cur").alias("orders"), dsum("rev_cur").alias("revenue"),
        F.count(F.when(known & (F.col("n_cmp") > 0), 1)).alias("custs_cmp"),
        F.count(F.when(known & (F.col("n_cmp") > 0) & first_in(cmp), 1)).alias("new_cmp"),
        F.sum("n_cmp").alias("orders_cmp"), dsum("rev_cmp").alias("revenue_cmp"),
        F.try_divide(F.sum(F.when(known, F.col("ltv"))).cast("double"),
                     F.count(F.when(known, 1)).cast("double")).alias("ltv"))
    g = (g.unionByName(spends(fact, cur, cmp, filters), allowMissingColumns=True)      # two rows of one value each
         .agg(*[F.max(c).alias(c) for c in [*g.columns, "spend", "spend_cmp"]]))
    has = F.col("orders_cmp") > 0
    cac = ratio("spend", "new")
    cac_cmp = F.when(has, ratio("spend_cmp", "new_cmp"))
    repeat = ratio(F.col("custs") - F.col("new"), "custs")
    return long_rows(g, [
        ("customers", F.col("custs"), F.when(has, F.col("custs_cmp"))),
        ("new_customers", F.col("new"), F.when(has, F.col("new_cmp"))),
        ("repeat_rate", repeat, F.when(has, ratio(F.col("custs_cmp") - F.col("new_cmp"), "custs_cmp"))),
        ("orders_per_customer", ratio("orders", "custs"), F.when(has, ratio("orders_cmp", "custs_cmp"))),
        ("aov", ratio("revenue", "orders"), F.when(has, ratio("revenue_cmp", "orders_cmp"))),
        ("avg_ltv", F.col("ltv"), None),
        ("cac", cac, cac_cmp),
        ("ltv_cac", F.try_divide(F.col("ltv"), cac), None),
    ])


def new_vs_returning(orders: DataFrame, cur) -> DataFrame:
    """Weekly net sales of the period's orders split by new / returning customer.

    Orders are first reduced to (customer, week) — at most one row per week a
    customer ordered in — so the per-customer window that finds the first order
    sees a calendar-bounded number of rows however hot the customer is."""
    o = _orders(orders)
    cc = in_range(cur)
    cw = o.groupBy("customer_id", period_start("date", "W").alias("week")).agg(
        F.min("date").alias("first_in_week"), F.count(F.when(cc, 1)).alias("n_cur"),
        F.sum(F.when(cc, F.col("net_sales"))).alias("net_cur"))
    first = F.when(F.col("customer_id").isNotNull(),
                   F.min("first_in_week").over(W.partitionBy("customer_id")))
    cw = cw.withColumn("first", first).filter(F.col("n_cur") > 0)
    is_new = F.col("first").between(F.lit(cur[0]), F.lit(cur[1]))
    cw = cw.withColumn("cohort", F.when(is_new, "new").otherwise("returning"))
    return (cw.groupBy("week").pivot("cohort", ["new", "returning"]).agg(dsum("net_cur"))
            .fillna(0.0))


def _cohort_counts(orders: DataFrame) -> DataFrame:
    """(cohort month, months since) -> distinct customers, and the cohort size."""
    o = _orders(orders).filter(F.col("customer_id").isNotNull())
    month = period_start("date", "M")
    per = (o.groupBy("customer_id").agg(F.min(month).alias("cohort"),
                                        F.collect_set(month).alias("months")))
    ex = per.select("customer_id", "cohort", F.explode("months").alias("month"))
    g = ex.groupBy("cohort", month_diff(F.col("month"), F.col("cohort")).alias("months_since")) \
        .agg(F.count(F.lit(1)).alias("customers"))
    size = F.max(F.when(F.col("months_since") == 0, F.col("customers"))).over(W.partitionBy("cohort"))
    return g.withColumn("cohort_size", size)


def cohort_retention(orders: DataFrame, last_n: int = 12) -> DataFrame:
    """Share (%) of each monthly cohort ordering N months later; last ``last_n`` cohorts."""
    g = _cohort_counts(orders)
    # the last_n-th latest cohort month, as a scalar subquery
    cutoff = (g.select("cohort").distinct().orderBy(F.col("cohort").desc()).limit(last_n)
              .select(F.min("cohort")).scalar())
    g = g.filter(F.col("cohort") >= cutoff)
    return g.select("cohort", "months_since", "customers", "cohort_size",
                    F.round(F.col("customers") / F.col("cohort_size") * 100.0, 0).alias("pct"))


def cohort_matrix(orders: DataFrame, last_n: int = 12) -> DataFrame:
    """The cells (cohort, months_since, pct) of the retention matrix, every month of the last cohorts."""
    return cohort_retention(orders, last_n).select("cohort", "months_since", "pct")


def email_performance(email: DataFrame, cur, cmp) -> DataFrame:
    """Email sends by (type, name) with revenue per recipient, plus a Total row
    carrying revenue change vs the comparison range."""
    cc, pc = in_range(cur), in_range(cmp)
    e = in_days(email, cur, cmp)
    g = e.rollup("type", "name").agg(
        F.grouping_id().alias("_gid"), F.count(F.when(cc, 1)).alias("n_cur"),
        F.count(F.when(pc, 1)).alias("n_cmp"),
        dsum("recipients", cc).alias("recipients"), dsum("orders", cc).alias("orders"),
        dsum("revenue", cc).alias("revenue"), dsum("revenue", pc).alias("revenue_cmp"))
    g = g.filter((F.col("n_cur") > 0) & F.col("_gid").isin(0, 3))
    total = F.col("_gid") == 3
    # one row per send name: a table for reading, so one window may order it
    pos = F.row_number().over(W.orderBy(total, F.col("revenue").desc(), "type", "name"))
    return g.select(
        pos.alias("pos"),
        F.when(total, F.lit("Total")).otherwise(F.col("type")).alias("type"),
        F.when(total, F.lit("")).otherwise(F.col("name")).alias("name"),
        F.col("recipients").cast("bigint").alias("recipients"),
        F.col("orders").cast("bigint").alias("orders"), "revenue",
        ratio("revenue", "recipients").alias("rev_per_recipient"),
        F.when(total, pct_change(F.col("revenue"), F.when(F.col("n_cmp") > 0, F.col("revenue_cmp"))))
        .alias("revenue_vs_cmp")).orderBy("pos")
