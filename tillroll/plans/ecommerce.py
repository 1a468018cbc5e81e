"""eCommerce report: KPIs vs comparison and target, trends, dimension tables."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillroll import model as M
from tillroll.functions import metrics as MX
from tillroll.functions import periods as P
from tillroll.functions.dims import period_start
from tillroll.operators import compare as C
from tillroll.plans.prefix_sums import range_totals


def _labelled(g: DataFrame, label_expr, metrics: list[str], extra, blocks: list) -> DataFrame:
    """Rows with their position ``pos``: by ``blocks``, then the first metric descending, then label.

    A table has a row per value of a rule-made dimension, so one window may order it."""
    t = g.select(label_expr, *extra, *C.comparison_cols(metrics, F.col("_n_cmp") > 0),
                 *[b.alias(f"_block{i}") for i, b in enumerate(blocks)])
    keys = [F.col(f"_block{i}") for i in range(len(blocks))]
    pos = F.row_number().over(W.orderBy(*keys, F.col(metrics[0]).desc_nulls_last(), "label"))
    return t.withColumn("pos", pos).drop(*[f"_block{i}" for i in range(len(blocks))]).orderBy("pos")


def dimension_table(fact: DataFrame, dim: str, metrics: list[str], cur, cmp,
                    filters: dict | None = None) -> DataFrame:
    """One-level breakdown with comparison columns and a grand Total row.

    Keys seen only in the comparison range are dropped; a key without
    comparison rows gets a null comparison (not 0)."""
    g = C.comparison_table(fact, [dim], metrics, cur, cmp, filters).filter(F.col("_n_cur") > 0)
    label = F.when(F.col("_gid") == 1, F.lit("Total")).otherwise(F.col(dim)).alias("label")
    kind = F.when(F.col("_gid") == 1, F.lit("total")).otherwise(F.lit("row")).alias("kind")
    return _labelled(g, label, metrics, [kind], [F.col("_gid")])


def channel_table(fact: DataFrame, metrics: list[str], cur, cmp,
                  filters: dict | None = None) -> DataFrame:
    """Channels under Paid / Unpaid with a subtotal per group and a grand Total.

    Rows outside both groups (the shop lane's '(n/a)') count only in the Total."""
    grp, ch = "marketing_channel_group", "marketing_channel"
    g = C.comparison_table(fact, [grp, ch], metrics, cur, cmp, filters)
    groups = [M.PAID_LABEL, M.UNPAID_LABEL]
    g = g.filter((F.col("_n_cur") > 0) & ((F.col("_gid") == 3) | F.col(grp).isin(groups)))
    gid = F.col("_gid")
    label = (F.when(gid == 0, F.col(ch)).when(gid == 1, F.concat(F.col(grp), F.lit(" total")))
             .otherwise(F.lit("Total"))).alias("label")
    kind = (F.when(gid == 0, "row").when(gid == 1, "subtotal").otherwise("total")).alias("kind")
    group = F.when(gid == 3, F.lit(None).cast("string")).otherwise(F.col(grp)).alias("channel_group")
    section = F.when(gid == 3, 2).when(F.col(grp) == M.PAID_LABEL, 0).otherwise(1)
    return _labelled(g, label, metrics, [kind, group], [section, gid])


def kpi_summary(fact: DataFrame, cur, cmp, targets=None, filters=None,
                groups=("Overview Metrics", "Funnel Metrics")) -> DataFrame:
    metrics = [m for g in groups for m in M.KPI_GROUPS[g]]
    return C.kpi_rows(fact, metrics, cur, cmp, targets, filters)


def period_totals(prefix: DataFrame, ref, metrics: list[str]) -> DataFrame:
    """Every quick selector (current, last year, prior) from a table of day prefix sums: two rows a range."""
    return range_totals(prefix, P.period_rows(ref), metrics, ["period", "side"])


def sparkline(fact: DataFrame, metric: str, start, end, filters=None) -> DataFrame:
    """Metric series over the auto-widened window at D/W/M granularity."""
    s, e, freq = P.spark_window(start, end)
    return C.trend(C.apply_filters(fact, s, e, filters), metric, freq)


def trend_ty_ly(fact: DataFrame, period_name: str, freq: str, metric: str, ref,
                filters=None) -> DataFrame:
    """This-year vs last-year series aligned by position (bucket number).

    A still-open final week is dropped from the weekly TY series; LY is cut or
    null-padded to the TY length.  Both sides come from one scan."""
    return trends_ty_ly(fact, {period_name: (period_name, freq)}, metric, ref, filters).drop("preset").orderBy("pos")


def trends_ty_ly(fact: DataFrame, presets: dict[str, tuple[str, str]], metric: str, ref,
                 filters=None) -> DataFrame:
    """``trend_ty_ly`` of every preset (name -> period, frequency) from one scan of the fact.

    Days are summed first (bounded by the calendar); each then counts in every
    bucket it belongs to: a day of both ranges of a preset (they overlap when the period is
    longer than the shift) counts in both."""
    bases = MX.inputs_for([metric])
    ranges, tags = [], []
    for preset, (period_name, freq) in presets.items():
        period = P.resolve_period(period_name, ref)
        bucket = period_start("date", freq)
        for side, rng in (("TY", period), ("LY", P.ly_range(*period))):
            inside = C.in_range(rng)
            if side == "TY" and freq == "W":        # not the last week if it has fewer than 7 days up to the end
                inside &= F.datediff(F.lit(rng[1]), bucket) + 1 >= 7
            ranges.append(rng)
            tags.append(F.when(inside, F.struct(F.lit(preset).alias("preset"), F.lit(side).alias("side"), bucket.alias("period"))))
    days = C.in_days(C.dim_filter(fact, filters), *ranges).groupBy("date").agg(*[F.sum(b).alias(b) for b in bases])
    f = days.select(F.explode(F.array_compact(F.array(*tags))).alias("tag"), *bases).select("tag.*", *bases)
    g = f.groupBy("preset", "side", "period").agg(*C.sums(bases)).select(
        "preset", "side", "period", *C.metric_cols([metric]))
    g = g.withColumn("pos", F.row_number().over(W.partitionBy("preset", "side").orderBy("period")))
    # both sides of a position meet in one aggregate; positions without TY go
    at = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    return (g.groupBy("preset", "pos").agg(at("TY", "period").alias("period"), at("TY", metric).alias("ty"),
                                           at("LY", metric).alias("ly")).filter(F.col("period").isNotNull()))
