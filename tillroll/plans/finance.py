"""Profitability, forecast/pacing, exec digest, benchmarks and data trust."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll import model as M
from tillroll.functions import metrics as MX
from tillroll.functions import periods as P
from tillroll.operators import compare as C
from tillroll.plans.common import dsum

WATERFALL = ["Gross Sales", "Less: Discounts", "Less: Cancellations", "Less: Returns",
             "Net Revenue", "Less: COGS", "Gross Profit", "Less: Marketing", "Contribution (CM2)"]


def finance_waterfall(fact: DataFrame, returns: DataFrame, cur, filters=None) -> DataFrame:
    """Nine-step waterfall from gross sales to contribution.

    Net revenue = revenue - cancellations - returns (returns feed by kind, not
    subject to report filters).  Fact and returns rows are unioned and reduced by
    one global aggregate (no join)."""
    f = C.apply_filters(fact, *cur, filters).select(
        "gross_sales", "discounts", "revenue", "cogs", "spend")
    r = C.in_days(returns, cur).select(
        F.when(F.col("kind") == "cancellation", F.col("value")).alias("_canc"),
        F.when(F.col("kind") == "return", F.col("value")).alias("_ret"))
    g = f.unionByName(r, allowMissingColumns=True).agg(
        *[dsum(c).alias(c) for c in ["gross_sales", "discounts", "revenue", "cogs", "spend",
                                     "_canc", "_ret"]])
    net = F.col("revenue") - F.col("_canc") - F.col("_ret")
    gp = net - F.col("cogs")
    contribution = gp - F.col("spend")
    amounts = [F.col("gross_sales"), -F.col("discounts"), -F.col("_canc"), -F.col("_ret"), net,
               -F.col("cogs"), gp, -F.col("spend"), contribution]
    return g.select(F.inline(F.array(*[
        F.struct(F.lit(i + 1).alias("step"), F.lit(label).alias("line"), amt.alias("amount"))
        for i, (label, amt) in enumerate(zip(WATERFALL, amounts))])))


def perf_vs_budget(fact: DataFrame, targets: DataFrame, cur, filters=None,
                   metrics=M.BUDGET_METRICS) -> DataFrame:
    """Actual vs budget (target) and vs last year (always the 364-day shift)."""
    rows = C.kpi_rows(fact, list(metrics), cur, P.ly_range(*cur), targets, filters)
    return rows.select("metric", F.col("value").alias("actual"), F.col("target").alias("budget"),
                       F.col("vtarg_pct").alias("v_budget"), F.col("cmp").alias("ly"),
                       F.col("delta_pct").alias("v_ly"))


def run_rate(fact: DataFrame, targets: DataFrame, ref, filters=None,
             metrics=M.RUN_RATE_METRICS) -> DataFrame:
    """Month-to-date actual / elapsed days x days in month, vs the full-month target."""
    ref = P.as_date(ref)
    month_start, dim = ref.replace(day=1), P.days_in_month(ref)
    month_end = ref.replace(day=dim)
    mtd = C.kpi_rows(fact, list(metrics), (month_start, ref), None, None, filters).select("metric", "value")
    tgt = C.target_rows(targets, (month_start, month_end), list(metrics))
    proj = F.col("value") / F.lit(float(ref.day)) * F.lit(float(dim))
    return mtd.join(tgt, "metric", "left").select(
        "metric", F.col("value").alias("mtd_actual"), proj.alias("projected"),
        F.col("target").alias("month_budget"),
        F.when(F.col("target") != 0, MX.pct_change(proj, F.col("target"))).alias("projected_vs_budget"))


def top_movers(fact, targets, cur, cmp, filters=None, k: int = 4) -> DataFrame:
    """Metrics ranked by absolute % change (top ``k``) with a good/bad flag."""
    rows = C.favourability(C.kpi_rows(fact, M.MOVER_METRICS, cur, cmp, targets, filters))
    order = F.array_position(F.array(*[F.lit(m) for m in M.MOVER_METRICS]), F.col("metric"))
    return (rows.filter(F.col("delta_pct").isNotNull())
            .orderBy(F.abs("delta_pct").desc(), order).limit(k)
            .select("metric", "value", "delta_pct", "good"))


def biggest_move(fact, targets, cur, cmp, filters=None) -> DataFrame:
    """The single metric with the largest absolute % change (first listed wins ties)."""
    rows = C.kpi_rows(fact, M.BIGGEST_MOVE_METRICS, cur, cmp, targets, filters)
    order = F.array_position(F.array(*[F.lit(m) for m in M.BIGGEST_MOVE_METRICS]), F.col("metric"))
    return (rows.filter(F.col("delta_pct").isNotNull())
            .orderBy(F.abs("delta_pct").desc(), order).limit(1).select("metric", "delta_pct"))


def benchmarks(fact, cur, filters=None) -> DataFrame:
    """Gap % to fixed benchmarks, sign-flipped for reverse-polarity metrics."""
    t = C.totals(C.apply_filters(fact, *cur, filters), list(M.BENCHMARKS))
    structs = []
    for m, b in M.BENCHMARKS.items():
        gap = MX.pct_change(F.col(m), F.lit(float(b)))
        if M.metric_polarity(m) == "reverse":
            gap = -gap
        structs.append(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("actual"),
                                F.lit(float(b)).alias("benchmark"), gap.alias("gap_pct")))
    return t.select(F.inline(F.array(*structs)))


def data_trust(fact: DataFrame) -> DataFrame:
    """Freshness and coverage: last data day, fact rows in total and per source."""
    g = fact.rollup("source").agg(F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("rows"),
                                  F.max("date").alias("data_through"))
    return g.select(F.when(F.col("_gid") == 1, F.lit("(all)")).otherwise(F.col("source")).alias("source"),
                    "rows", "data_through")
