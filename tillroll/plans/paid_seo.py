"""Paid media and SEO reports."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll import model as M
from tillroll.functions.metrics import pct_change
from tillroll.operators.compare import compare_frame, in_days, in_range
from tillroll.plans.common import dsum, exact_avg, long_rows, ratio



def _paid():
    return F.col("paid_ad_platform") != M.NA


def paid_kpis(fact: DataFrame, cur, cmp, filters=None) -> DataFrame:
    """Paid spend, blended MER (all revenue / paid spend), blended CAC (spend /
    all orders) and platform ROAS, each with comparison.  Paid rows are rows
    with an ad platform."""
    f = compare_frame(fact, cur, cmp, filters)
    cc, pc = in_range(cur), in_range(cmp)
    g = f.agg(
        F.count(F.when(pc, 1)).alias("n_cmp"), F.count(F.when(pc & _paid(), 1)).alias("n_cmp_paid"),
        dsum("revenue", cc).alias("rev"), dsum("orders", cc).alias("orders"),
        dsum("spend", cc & _paid()).alias("spend"),
        dsum("platform_conversion_value_7d", cc & _paid()).alias("conv_val"),
        dsum("revenue", pc).alias("rev_cmp"), dsum("orders", pc).alias("orders_cmp"),
        dsum("spend", pc & _paid()).alias("spend_cmp"),
        dsum("platform_conversion_value_7d", pc & _paid()).alias("conv_val_cmp"))
    paid_cmp = F.col("n_cmp_paid") > 0
    any_cmp = F.col("n_cmp") > 0
    spend_cmp = F.when(paid_cmp, F.col("spend_cmp"))
    return long_rows(g, [
        ("spend", F.col("spend"), spend_cmp),
        ("blended_mer", ratio("rev", "spend"), F.when(any_cmp, F.try_divide(F.col("rev_cmp"), spend_cmp))),
        ("blended_cac", ratio("spend", "orders"), F.when(any_cmp, F.try_divide(spend_cmp, F.col("orders_cmp")))),
        ("platform_roas", ratio("conv_val", "spend"), F.try_divide(F.when(paid_cmp, F.col("conv_val_cmp")), spend_cmp)),
    ])


def platform_table(fact: DataFrame, cur, cmp, filters=None) -> DataFrame:
    """Per ad platform plus Total: spend, 7-day conversions, ROAS, CTR, CPC, CPA
    and spend / ROAS change vs comparison (null for a platform absent there)."""
    f = compare_frame(fact, cur, cmp, filters).filter(_paid())
    cc, pc = in_range(cur), in_range(cmp)
    g = f.rollup("paid_ad_platform").agg(
        F.grouping_id().alias("_gid"), F.count(F.when(cc, 1)).alias("n_cur"),
        F.count(F.when(pc, 1)).alias("n_cmp"),
        dsum("spend", cc).alias("spend"), dsum("impressions", cc).alias("impressions"),
        dsum("clicks", cc).alias("clicks"), dsum("platform_conversions_7d", cc).alias("conv"),
        dsum("platform_conversion_value_7d", cc).alias("conv_val"),
        dsum("spend", pc).alias("spend_cmp"),
        dsum("platform_conversion_value_7d", pc).alias("conv_val_cmp"))
    g = g.filter(F.col("n_cur") > 0)
    has = F.col("n_cmp") > 0
    roas = ratio("conv_val", "spend")
    return g.select(
        F.when(F.col("_gid") == 1, F.lit("Total")).otherwise(F.col("paid_ad_platform")).alias("platform"),
        "spend", F.col("conv").alias("conversions"), roas.alias("roas"),
        ratio("clicks", "impressions").alias("ctr"), ratio("spend", "clicks").alias("cpc"),
        ratio("spend", "conv").alias("cpa"),
        pct_change(F.col("spend"), F.when(has, F.col("spend_cmp"))).alias("spend_vs_cmp"),
        pct_change(roas, F.when(has, ratio("conv_val_cmp", "spend_cmp"))).alias("roas_vs_cmp"))


def roas_extremes(fact: DataFrame, cur, filters=None) -> DataFrame:
    """Lowest and highest platform ROAS = value / max(spend, 1) (tiebreak platform)."""
    f = compare_frame(fact, cur, None, filters).filter(_paid())
    g = f.groupBy("paid_ad_platform").agg(
        dsum("platform_conversion_value_7d").alias("v"), dsum("spend").alias("s"))
    g = g.select("paid_ad_platform", (F.col("v") / F.greatest(F.col("s"), F.lit(1.0))).alias("roas"))
    key = F.struct("roas", "paid_ad_platform")
    r = g.agg(F.min_by("paid_ad_platform", key).alias("lo_p"), F.min("roas").alias("lo"),
              F.max_by("paid_ad_platform", key).alias("hi_p"), F.max("roas").alias("hi"))
    return r.select(F.inline(F.array(
        F.struct(F.lit("lowest").alias("extreme"), F.col("lo_p").alias("platform"), F.col("lo").alias("roas")),
        F.struct(F.lit("highest").alias("extreme"), F.col("hi_p").alias("platform"), F.col("hi").alias("roas")))))


# ── SEO ──────────────────────────────────────────────────────────────────
def _pos_mean(cond=None):
    """Row mean of position, summed exactly as decimal(18,6)."""
    p = F.col("position").cast("decimal(18,6)")
    if cond is not None:
        p = F.when(cond, p)
    return F.try_divide(F.sum(p).cast("double"), F.count(p).cast("double"))


def seo_kpis(seo: DataFrame, cur, cmp) -> DataFrame:
    cc, pc = in_range(cur), in_range(cmp)
    s = in_days(seo, cur, cmp)
    g = s.agg(F.count(F.when(pc, 1)).alias("n_cmp"),
              dsum("clicks", cc).alias("clicks"), dsum("impressions", cc).alias("impr"),
              _pos_mean(cc).alias("pos"), dsum("clicks", pc).alias("clicks_cmp"),
              dsum("impressions", pc).alias("impr_cmp"), _pos_mean(pc).alias("pos_cmp"))
    has = F.col("n_cmp") > 0
    return long_rows(g, [
        ("clicks", F.col("clicks"), F.when(has, F.col("clicks_cmp"))),
        ("impressions", F.col("impr"), F.when(has, F.col("impr_cmp"))),
        ("avg_position", F.col("pos"), F.when(has, F.col("pos_cmp"))),
        ("ctr", ratio("clicks", "impr"), None)])


def seo_branded(seo: DataFrame, cur) -> DataFrame:
    from tillroll.functions.dims import branded_label
    s = in_days(seo, cur)
    return s.groupBy(branded_label("branded").alias("branded")).agg(
        F.sum("clicks").cast("bigint").alias("clicks"))


def seo_top_queries(seo: DataFrame, cur, cmp, k: int = 15) -> DataFrame:
    """Top ``k`` queries by clicks (tiebreak query) with mean position and
    click change vs comparison; Total position is the mean of query means."""
    cc, pc = in_range(cur), in_range(cmp)
    s = in_days(seo, cur, cmp)
    q = s.groupBy("query").agg(
        F.count(F.when(cc, 1)).alias("n_cur"), F.count(F.when(pc, 1)).alias("n_cmp"),
        dsum("clicks", cc).alias("clicks"), dsum("impressions", cc).alias("impressions"),
        _pos_mean(cc).alias("position"), dsum("clicks", pc).alias("clicks_cmp"))
    q = q.filter(F.col("n_cur") > 0)
    top = (q.select("query", "clicks", "impressions", "position",
                    pct_change(F.col("clicks"), F.when(F.col("n_cmp") > 0, F.col("clicks_cmp")))
                    .alias("clicks_vs_cmp"))
           .orderBy(F.col("clicks").desc(), F.col("query")).limit(k))
    # total clicks change compares with every comparison-range row
    cmp_total = s.select(dsum("clicks", pc).alias("c"), F.count(F.when(pc, 1)).alias("n")) \
        .select(F.when(F.col("n") > 0, F.col("c"))).scalar()
    total = q.agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"),
                  exact_avg("position").alias("position")).select(
        F.lit("Total").alias("query"), "clicks", "impressions", "position",
        pct_change(F.col("clicks"), cmp_total).alias("clicks_vs_cmp"))
    return top.unionByName(total)
