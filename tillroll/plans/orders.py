"""Order insight (distribution of order values) and the order bank."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.quantiles import exact_percentiles
from tillroll.operators.compare import dim_filter, in_days, in_range
from tillroll.plans.common import dsum, long_rows, ratio


def _lines(li: DataFrame, filters, *ranges) -> DataFrame:
    return dim_filter(in_days(li.withColumn("date", F.to_date("created_at")), *ranges), filters)


def per_order(li: DataFrame, rng, filters=None) -> DataFrame:
    """Line items of the range -> (order_id, value, items)."""
    return _lines(li, filters, rng).groupBy("order_id").agg(
        F.sum("net_sales").alias("value"), F.sum("quantity").alias("items"))


def order_insight(li: DataFrame, cur, cmp, filters=None) -> DataFrame:
    """Orders, AOV, median and P90 order value (linear interpolation), items per
    order, single-item share and units, with comparison where defined.

    One roll-up per order serves both ranges and the percentiles."""
    sides = {"": in_range(cur), "_c": in_range(cmp)}
    o = _lines(li, filters, cur, cmp).groupBy("order_id").agg(*[
        F.sum(F.when(cond, F.col(c))).alias(name + sfx) for sfx, cond in sides.items()
        for c, name in (("net_sales", "value"), ("quantity", "items"))])

    def stats(sfx):
        n, value, items = F.count(f"items{sfx}"), F.sum(f"value{sfx}"), F.sum(f"items{sfx}")
        return [n.alias(f"n{sfx}"), ratio(value, n).alias(f"aov{sfx}"), ratio(items, n).alias(f"items{sfx}"),
                F.avg(F.when(F.col(f"items{sfx}") == 1, 1.0).when(F.col(f"items{sfx}").isNotNull(), 0.0))
                .alias(f"single{sfx}"),
                dsum(f"items{sfx}").alias(f"units{sfx}")]

    q = exact_percentiles(o.filter(F.col("value").isNotNull()), "value", [0.5, 0.9], names=["median", "p90"])
    g = (o.agg(*stats(""), *stats("_c")).unionByName(q, allowMissingColumns=True)
         .agg(*[F.max(c).alias(c) for c in ["n", "aov", "items", "single", "units", "n_c",
                                             "aov_c", "items_c", "units_c", "median", "p90"]]))
    has = F.col("n_c") > 0
    return long_rows(g, [
        ("orders", F.col("n"), F.when(has, F.col("n_c"))),
        ("aov", F.col("aov"), F.when(has, F.col("aov_c"))),
        ("median_order", F.col("median"), None),
        ("p90_order", F.col("p90"), None),
        ("avg_items", F.col("items"), F.when(has, F.col("items_c"))),
        ("single_item_share", F.col("single"), None),
        ("units", F.col("units"), F.when(has, F.col("units_c"))),
    ])


def order_value_histogram(li: DataFrame, cur, filters=None, max_bins: int = 40) -> DataFrame:
    """Orders per value bin; the bin width is the smallest 1/2/5 x 10^k (in
    money units) giving at most ``max_bins`` bins over the value span.  The span
    is a scalar subquery, so the plan is one job with no driver round trip."""
    o = per_order(li, cur, filters).withColumn("cents", (F.col("value") * 100).cast("bigint"))
    o = o.withColumn("_span", o.select((F.max("cents") - F.min("cents")).alias("s")).scalar())
    power = F.floor(F.log10(F.greatest(F.col("_span") / F.lit(max_bins), F.lit(1.0)))).cast("int")
    steps = F.array(*[(F.pow(F.lit(10.0), power + e) * m).cast("bigint") for e in (0, 1) for m in (1, 2, 5)])
    o = o.withColumn("step", F.get(F.filter(steps, lambda s: F.col("_span") <= s * max_bins), 0))
    b = F.col("cents") - F.pmod(F.col("cents"), F.col("step"))      # floor, below zero too
    return (o.groupBy((b / 100.0).alias("bin_start"), (F.col("step") / 100.0).alias("bin_width"))
            .agg(F.count(F.lit(1)).alias("orders")).orderBy("bin_start"))


def revenue_by_category(li: DataFrame, cur, filters=None) -> DataFrame:
    return (_lines(li, filters, cur).groupBy("category").agg(dsum("net_sales").alias("revenue"))
            .orderBy(F.desc("revenue"), "category"))


def top_products(li: DataFrame, cur, filters=None, k: int = 10) -> DataFrame:
    return (_lines(li, filters, cur).groupBy("product_title").agg(dsum("net_sales").alias("revenue"))
            .orderBy(F.desc("revenue"), "product_title").limit(k))


# ── order bank ───────────────────────────────────────────────────────────
def _snapshot(ob: DataFrame) -> DataFrame:
    latest = ob.select(F.max("date")).scalar()
    return ob.filter(F.col("date") == latest)


def orderbank_snapshot(ob: DataFrame) -> DataFrame:
    """Open value / orders / items at the latest snapshot date."""
    s = _snapshot(ob)
    return s.agg(F.max("date").alias("date"), dsum("open_value").alias("open_value"),
                 F.sum("open_orders").cast("bigint").alias("open_orders"),
                 F.sum("open_items").cast("bigint").alias("open_items"))


def orderbank_by(ob: DataFrame, dim: str) -> DataFrame:
    return _snapshot(ob).groupBy(dim).agg(dsum("open_value").alias("open_value"))


def orderbank_trend(ob: DataFrame) -> DataFrame:
    return ob.groupBy("date").agg(dsum("open_value").alias("open_value")).orderBy("date")
