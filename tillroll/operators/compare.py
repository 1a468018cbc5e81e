"""Comparison engine: filters, base sums and current-vs-comparison aggregation.

Every report that compares a period with last year / the prior period reads
the fact *once*: rows of both ranges are kept by one filter, and each base
metric is summed twice under ``CASE WHEN`` (conditional aggregation).  Totals
and subtotals come from ``rollup`` (GROUPING SETS) in the same aggregate, so a
table with a Total row is one shuffle, with map-side partial aggregation that
keeps hot keys cheap.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll import model as M
from tillroll.functions import metrics as MX
from tillroll.functions.periods import Range, as_date


def _bound(v) -> Column:
    return v if isinstance(v, Column) else F.lit(as_date(v))


STORED_MONTH = "stored_month"    # partition column of stored facts: year * 100 + month


def month_number(day) -> Column:
    return F.year(day) * 100 + F.month(day)


def in_range(rng: Range | None, date_col: str = "date") -> Column:
    """Inclusive date range; ends are dates/ISO strings or Columns (e.g. scalar subqueries)."""
    if rng is None:
        return F.lit(False)
    return F.col(date_col).between(_bound(rng[0]), _bound(rng[1]))


def in_days(df: DataFrame, *ranges: Range | None, date_col: str = "date") -> DataFrame:
    """Rows of any of the ranges (None is no range); prunes month folders of a stored table."""
    keep = F.lit(False)
    for rng in ranges:
        if rng is None:
            continue
        cond = in_range(rng, date_col)
        if STORED_MONTH in df.columns:
            cond = cond & F.col(STORED_MONTH).between(*[
                month_number(b) if isinstance(b, Column) else F.lit(as_date(b).year * 100 + as_date(b).month)
                for b in rng])
        keep = keep | cond
    return df.filter(keep)


def dim_filter(df: DataFrame, filters: dict | None) -> DataFrame:
    """IN-list per dimension, ANDed; an empty list or a column the frame lacks is ignored."""
    for dim, values in (filters or {}).items():
        if values and dim in df.columns:
            df = df.filter(F.col(dim).isin(list(values)))
    return df


def apply_filters(df: DataFrame, start, end, filters: dict | None = None,
                  date_col: str = "date") -> DataFrame:
    """Inclusive date range plus dimension IN-lists."""
    return dim_filter(in_days(df, (start, end), date_col=date_col), filters)


def sums(bases: list[str], cond: Column | None = None, suffix: str = "") -> list[Column]:
    return [MX.base_sum(b, cond, col=b).alias(f"{b}{suffix}") for b in bases]


def metric_cols(metrics: list[str], suffix: str = "", out_suffix: str | None = None) -> list[Column]:
    """Metric columns computed from already-aggregated base sums ``{base}{suffix}``."""
    osfx = suffix if out_suffix is None else out_suffix
    return [MX.metric_column(m, lambda b: F.col(f"{b}{suffix}")).alias(f"{m}{osfx}")
            for m in metrics]


def totals(df: DataFrame, metrics: list[str]) -> DataFrame:
    """One row: each metric over the global base sums (empty input -> 0 sums)."""
    bases = MX.inputs_for(metrics)
    return df.agg(*sums(bases)).select(*metric_cols(metrics))


def aggregate(df: DataFrame, dims: list[str], metrics: list[str]) -> DataFrame:
    """Group by several dimensions; metrics evaluated over group sums; ordered by the keys."""
    bases = MX.inputs_for(metrics)
    return df.groupBy(*dims).agg(*sums(bases)).select(*dims, *metric_cols(metrics)).orderBy(*dims)


def breakdown(df: DataFrame, dim: str, metrics: list[str]) -> DataFrame:
    """One-dimension breakdown sorted by the first metric, descending."""
    out = aggregate(df, [dim], metrics)
    return out.orderBy(F.col(metrics[0]).desc_nulls_last(), F.col(dim)) if metrics else out


def trend(df: DataFrame, metric: str, freq: str = "D", date_col: str = "date") -> DataFrame:
    """Metric per D/W/M bucket; only buckets that have rows, ascending."""
    from tillroll.functions.dims import period_start
    bases = MX.inputs_for([metric])
    return (df.groupBy(period_start(date_col, freq).alias("period")).agg(*sums(bases))
            .select("period", *metric_cols([metric])).orderBy("period"))


# ── current vs comparison ──────────────────────────────────────────────
def compare_frame(fact: DataFrame, cur: Range, cmp: Range | None,
                  filters: dict | None = None) -> DataFrame:
    """Fact rows of the current or comparison range (one scan serves both)."""
    return dim_filter(in_days(fact, cur, cmp), filters)


def side_aggs(bases: list[str], cur: Range, cmp: Range | None) -> list[Column]:
    aggs = [F.count(F.when(in_range(cur), 1)).alias("_n_cur"),
            F.count(F.when(in_range(cmp), 1)).alias("_n_cmp")]
    aggs += sums(bases, in_range(cur), "_cur")
    aggs += sums(bases, in_range(cmp), "_cmp") if cmp is not None else \
        [F.lit(0.0).alias(f"{b}_cmp") for b in bases]
    return aggs


def comparison_cols(metrics: list[str], cmp_present: Column) -> list[Column]:
    """value / cmp / delta (own unit) / pct for each metric; cmp null when absent."""
    out = []
    for m in metrics:
        cur = MX.metric_column(m, lambda b: F.col(f"{b}_cur"))
        cmpv = F.when(cmp_present, MX.metric_column(m, lambda b: F.col(f"{b}_cmp")))
        out += [cur.alias(m), cmpv.alias(f"{m}_cmp"),
                MX.delta_in_units(m, cur, cmpv).alias(f"{m}_delta"),
                MX.pct_change(cur, cmpv).alias(f"{m}_pct")]
    return out


def comparison_table(fact: DataFrame, dims: list[str], metrics: list[str], cur: Range,
                     cmp: Range | None, filters: dict | None = None) -> DataFrame:
    """Rollup over ``dims`` with current and comparison values in one aggregate.

    Output keeps the grouping id ``_gid`` and row counts for callers that label
    subtotal/total rows."""
    bases = MX.inputs_for(metrics)
    f = compare_frame(fact, cur, cmp, filters)
    return f.rollup(*dims).agg(F.grouping_id().alias("_gid"), *side_aggs(bases, cur, cmp))


# ── targets ────────────────────────────────────────────────────────────
def target_columns_for(targets: DataFrame | None) -> dict[str, str]:
    """metric -> targets column, for columns actually present (first match wins)."""
    out: dict[str, str] = {}
    if targets is None:
        return out
    for tc, metric in M.TARGET_COLUMNS.items():
        if tc in targets.columns and metric not in out:
            out[metric] = tc
    return out


def target_metric(metric: str, available: dict[str, str], resolve) -> Column:
    """Direct target if the metric has a column; else its formula over base targets
    (implied target); null if any input is untargeted."""
    null = F.lit(None).cast("double")
    if metric in available:
        return resolve(metric)
    if metric not in M.DERIVED_METRICS:
        return null
    needs = MX.formula_inputs(metric)
    if not all(b in available for b in needs):
        return null
    return MX.metric_column(metric, resolve)


def target_rows(targets: DataFrame | None, rng: Range, metrics: list[str]) -> DataFrame | None:
    """(metric, target) over a date range: direct column sums (0 for an empty
    range, null without a column) or implied targets for derived metrics."""
    available = target_columns_for(targets)
    needed = sorted({b for m in metrics for b in MX.formula_inputs(m)} & set(available))
    g = targets.filter(in_range(rng)).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[MX.base_sum(b, col=available[b]).alias(f"_t_{b}") for b in needed])
    rows = [F.struct(F.lit(m).alias("metric"),
                     target_metric(m, available, lambda b: F.col(f"_t_{b}")).cast("double")
                     .alias("target")) for m in metrics]
    return g.select(F.inline(F.array(*rows)))


def kpi_rows(fact: DataFrame, metrics: list[str], cur: Range, cmp: Range | None,
             targets: DataFrame | None = None, filters: dict | None = None) -> DataFrame:
    """Per metric: value, comparison, delta %, target and vs-target % in one job.

    Fact rows (both ranges) and target rows (current range) are unioned and
    reduced by a single global aggregate with conditional sums — no join."""
    bases = MX.inputs_for(metrics)
    available = target_columns_for(targets)
    needed_targets = sorted({b for m in metrics for b in MX.formula_inputs(m)} & set(available))
    f = compare_frame(fact, cur, cmp, filters).select("date", *bases)
    if needed_targets:
        t = targets.filter(in_range(cur)).select(
            "date", *[F.col(available[b]).alias(f"_t_{b}") for b in needed_targets])
        f = f.unionByName(t, allowMissingColumns=True)
    aggs = side_aggs(bases, cur, cmp)
    aggs += [MX.base_sum(b, col=f"_t_{b}").alias(f"_t_{b}") for b in needed_targets]
    g = f.agg(*aggs)
    rows = []
    for m in metrics:
        value = MX.metric_column(m, lambda b: F.col(f"{b}_cur"))
        cmpv = F.when(F.lit(cmp is not None), MX.metric_column(m, lambda b: F.col(f"{b}_cmp")))
        tgt = (target_metric(m, available, lambda b: F.col(f"_t_{b}"))
               if targets is not None else F.lit(None).cast("double"))
        rows.append(F.struct(
            F.lit(m).alias("metric"), value.cast("double").alias("value"),
            cmpv.cast("double").alias("cmp"), MX.pct_change(value, cmpv).alias("delta_pct"),
            tgt.cast("double").alias("target"),
            F.when(tgt != 0, MX.pct_change(value, tgt)).alias("vtarg_pct")))
    return g.select(F.inline(F.array(*rows)))


def favourability(rows: DataFrame, delta_col: str = "delta_pct") -> DataFrame:
    """Add ``good``: change >= 0 is good, inverted for reverse-polarity metrics."""
    return rows.withColumn("good", MX.is_good(F.col("metric"), F.col(delta_col)))


def ref_date(fact: DataFrame) -> dt.date:
    """Last data day (the default 'today' of every period)."""
    return fact.agg(F.max("date")).first()[0]
