"""Product / merchandising report: sales and margin, funnel, stock, returns.

Per-product figures come from one aggregate of the product fact over the
current *and* comparison ranges (conditional sums), so every tab is a single
scan and one shuffle by product.  Top-k lists use a unique tiebreak key and
compile to ``TakeOrderedAndProject``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.periods import as_date
from tillroll.operators.compare import dim_filter, in_days, in_range
from tillroll.plans.common import dsum, exact_avg, long_rows, ratio

SUMS = {"units": "units", "revenue": "revenue", "gross_sales": "gross_sales",
        "discounts": "discounts", "gross_profit": "gross_profit", "views": "product_views",
        "atc": "product_add_to_carts", "returned": "returned_units", "refund": "refund_amount"}
KEYS = ["product_id", "product_title", "category"]


def _frame(fp: DataFrame, cur, cmp, filters) -> DataFrame:
    for c in SUMS.values():
        if c not in fp.columns:
            fp = fp.withColumn(c, F.lit(0))
    if "on_hand" not in fp.columns:
        fp = fp.withColumn("on_hand", F.lit(0))
    return in_days(dim_filter(fp, filters), cur, cmp)


def product_agg(fp: DataFrame, cur, cmp=None, filters=None) -> DataFrame:
    """Per product: sums for the current (and comparison) range, and the last
    non-null on-hand stock by date; absent values are 0.

    ``n_cur`` / ``n_cmp`` count the product's fact rows in each range."""
    f = _frame(fp, cur, cmp, filters)
    cc, pc = in_range(cur), in_range(cmp)
    aggs = [F.count(F.when(cc, 1)).alias("n_cur"), F.count(F.when(pc, 1)).alias("n_cmp")]
    for out, col in SUMS.items():
        aggs.append(dsum(col, cc).alias(out))
        aggs.append(dsum(col, pc).alias(f"{out}_cmp"))
    for side, cond in (("", cc), ("_cmp", pc)):
        last = F.max_by("on_hand", F.when(cond & F.col("on_hand").isNotNull(), F.col("date")))
        aggs.append(F.coalesce(last, F.lit(0)).cast("double").alias(f"on_hand{side}"))
    return f.groupBy(*KEYS).agg(*aggs)


def _cur_only(agg: DataFrame) -> DataFrame:
    cols = ["product_id", "product_title", "category"] + list(SUMS) + ["on_hand"]
    return agg.filter(F.col("n_cur") > 0).select(*cols)


def product_table(fp, cur, filters=None) -> DataFrame:
    return _cur_only(product_agg(fp, cur, None, filters))


def product_kpis(fp, cur, cmp, filters=None) -> DataFrame:
    """Revenue, units, ASP, gross margin and discount rate, with comparison."""
    f = _frame(fp, cur, cmp, filters)
    cc, pc = in_range(cur), in_range(cmp)
    g = f.agg(F.count(F.when(pc, 1)).alias("n_cmp"),
              *[dsum(SUMS[k], cc).alias(k) for k in ("revenue", "units", "gross_sales",
                                                     "discounts", "gross_profit")],
              *[dsum(SUMS[k], pc).alias(f"{k}_cmp") for k in ("revenue", "gross_sales",
                                                              "discounts", "gross_profit")])
    has = F.col("n_cmp") > 0
    return long_rows(g, [
        ("revenue", F.col("revenue"), F.when(has, F.col("revenue_cmp"))),
        ("units", F.col("units"), None),
        ("asp", ratio("revenue", "units"), None),
        ("gross_margin", ratio("gross_profit", "revenue"),
         F.when(has, ratio("gross_profit_cmp", "revenue_cmp"))),
        ("discount_pct", ratio("discounts", "gross_sales"),
         F.when(has, ratio("discounts_cmp", "gross_sales_cmp"))),
    ])


def category_table(fp, cur, cmp, filters=None) -> DataFrame:
    """Per category plus Total: revenue, units, ASP, discount %, GM %, GM and
    revenue / GM % change vs the comparison (null for a category absent there)."""
    f = _frame(fp, cur, cmp, filters)
    cc, pc = in_range(cur), in_range(cmp)
    g = f.rollup("category").agg(
        F.grouping_id().alias("_gid"), F.count(F.when(cc, 1)).alias("n_cur"),
        F.count(F.when(pc, 1)).alias("n_cmp"),
        *[dsum(SUMS[k], cc).alias(k) for k in ("revenue", "units", "gross_sales", "discounts",
                                               "gross_profit")],
        dsum("revenue", pc).alias("revenue_cmp"), dsum("gross_profit", pc).alias("gross_profit_cmp"))
    g = g.filter(F.col("n_cur") > 0)
    has = F.col("n_cmp") > 0
    gm = ratio("gross_profit", "revenue")
    from tillroll.functions.metrics import pct_change
    return g.select(
        F.when(F.col("_gid") == 1, F.lit("Total")).otherwise(F.col("category")).alias("category"),
        F.col("revenue"), F.col("units").cast("bigint").alias("units"),
        ratio("revenue", "units").alias("asp"), ratio("discounts", "gross_sales").alias("disc_pct"),
        gm.alias("gm_pct"), F.col("gross_profit").alias("gm"),
        pct_change(F.col("revenue"), F.when(has, F.col("revenue_cmp"))).alias("revenue_vs_cmp"),
        pct_change(gm, F.when(has, ratio("gross_profit_cmp", "revenue_cmp"))).alias("gm_pct_vs_cmp"))


def funnel_top(fp, cur, cmp, filters=None, k: int = 20) -> DataFrame:
    """Top ``k`` products by views (tiebreak product_id) with ATC % and
    conversion %, conversion change vs comparison, plus a Total over all."""
    from tillroll.functions.metrics import pct_change
    agg = product_agg(fp, cur, cmp, filters)
    conv, conv_cmp = ratio("units", "views"), F.when(F.col("n_cmp") > 0, ratio("units_cmp", "views_cmp"))
    rows = (agg.filter(F.col("n_cur") > 0)
            .select("product_id", "product_title", "views", "atc", "units",
                    ratio("atc", "views").alias("atc_rate"), conv.alias("conv_rate"),
                    pct_change(conv, conv_cmp).alias("conv_vs_cmp"))
            .orderBy(F.col("views").desc(), F.col("product_id")).limit(k))
    tot = agg.agg(dsum("views", F.col("n_cur") > 0).alias("views"),
                  dsum("atc", F.col("n_cur") > 0).alias("atc"),
                  dsum("units", F.col("n_cur") > 0).alias("units"),
                  dsum("views_cmp", F.col("n_cmp") > 0).alias("views_cmp"),
                  dsum("units_cmp", F.col("n_cmp") > 0).alias("units_cmp"),
                  F.count(F.when(F.col("n_cmp") > 0, 1)).alias("n_cmp"))
    tconv = ratio("units", "views")
    total = tot.select(F.lit(None).cast("string").alias("product_id"),
                       F.lit("Total").alias("product_title"), "views", "atc", "units",
                       ratio("atc", "views").alias("atc_rate"), tconv.alias("conv_rate"),
                       pct_change(tconv, F.when(F.col("n_cmp") > 0, ratio("units_cmp", "views_cmp")))
                       .alias("conv_vs_cmp"))
    return rows.unionByName(total)


def _weeks(cur) -> float:
    return max(1.0, ((as_date(cur[1]) - as_date(cur[0])).days + 1) / 7)


def stock_health(fp, cur, cmp, filters=None) -> DataFrame:
    """Availability (share of products with stock), average weeks of cover and
    out-of-stock count; availability compared with the comparison range."""
    agg = product_agg(fp, cur, cmp, filters)
    weeks = _weeks(cur)
    cover = F.try_divide(F.col("on_hand"), F.try_divide(F.col("units"), F.lit(weeks)))
    cur_p, cmp_p = F.col("n_cur") > 0, F.col("n_cmp") > 0
    g = agg.agg(
        F.avg(F.when(cur_p, F.when(F.col("on_hand") > 0, 1.0).otherwise(0.0))).alias("availability"),
        F.avg(F.when(cmp_p, F.when(F.col("on_hand_cmp") > 0, 1.0).otherwise(0.0))).alias("availability_cmp"),
        exact_avg(cover, cur_p).alias("avg_weeks_cover"),
        F.count(F.when(cur_p & (F.col("on_hand") <= 0), 1)).alias("out_of_stock"))
    return long_rows(g, [("availability", F.col("availability"), F.col("availability_cmp")),
                         ("avg_weeks_cover", F.col("avg_weeks_cover"), None),
                         ("out_of_stock", F.col("out_of_stock"), None)])


def low_stock(fp, cur, filters=None, k: int = 20, max_cover: float = 3.0) -> DataFrame:
    """Products with <= 3 weeks cover or no stock, lowest cover first (nulls
    last, tiebreak product_id), ``k`` rows, plus Total on-hand over all products."""
    t = product_table(fp, cur, filters)
    cover = F.try_divide(F.col("on_hand"), F.try_divide(F.col("units"), F.lit(_weeks(cur))))
    t = t.withColumn("weeks_cover", cover)
    rows = (t.filter((F.col("weeks_cover") <= max_cover) | (F.col("on_hand") <= 0))
            .select("product_id", "product_title", "category", "on_hand", "weeks_cover")
            .orderBy(F.col("weeks_cover").asc_nulls_last(), F.col("product_id")).limit(k))
    total = t.agg(F.sum("on_hand").alias("on_hand")).select(
        F.lit(None).cast("string").alias("product_id"), F.lit("Total").alias("product_title"),
        F.lit("").alias("category"), "on_hand", F.lit(None).cast("double").alias("weeks_cover"))
    return rows.unionByName(total)


def return_rates(fp, cur, cmp, filters=None) -> DataFrame:
    f = _frame(fp, cur, cmp, filters)
    cc, pc = in_range(cur), in_range(cmp)
    g = f.agg(F.count(F.when(pc, 1)).alias("n_cmp"),
              dsum("units", cc).alias("u"), dsum("returned_units", cc).alias("r"),
              dsum("revenue", cc).alias("rev"), dsum("refund_amount", cc).alias("ref"),
              dsum("units", pc).alias("u_cmp"), dsum("returned_units", pc).alias("r_cmp"))
    return long_rows(g, [
        ("return_rate_items", ratio("r", "u"), F.when(F.col("n_cmp") > 0, ratio("r_cmp", "u_cmp"))),
        ("return_rate_value", ratio("ref", "rev"), None),
        ("refunds", F.col("ref"), None)])


def worst_returners(fp, cur, filters=None, k: int = 15) -> DataFrame:
    t = product_table(fp, cur, filters).withColumn("return_rate", ratio("returned", "units"))
    rows = (t.filter(F.col("returned") > 0)
            .select("product_id", "product_title", "category", "units", "returned", "return_rate")
            .orderBy(F.col("return_rate").desc_nulls_last(), F.col("product_id")).limit(k))
    total = t.agg(F.sum("units").alias("units"), F.sum("returned").alias("returned")).select(
        F.lit(None).cast("string").alias("product_id"), F.lit("Total").alias("product_title"),
        F.lit("").alias("category"), "units", "returned", ratio("returned", "units").alias("return_rate"))
    return rows.unionByName(total)


def return_reasons(returns: DataFrame, cur, filters=None) -> DataFrame:
    """Count of return events (all kinds) by reason in the range."""
    r = dim_filter(in_days(returns, cur), filters)
    return r.groupBy("reason").agg(F.count(F.lit(1)).alias("returns")).orderBy(F.desc("returns"))
