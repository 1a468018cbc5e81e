"""Small helpers shared by the report plans."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions import metrics as MX


def ratio(a, b) -> Column:
    """a / b as double, null when b is 0 or null."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.try_divide(a.cast("double"), b.cast("double"))


def dsum(c, cond: Column | None = None) -> Column:
    """Exact SUM (decimal or integer input) returned as double; empty -> 0."""
    c = F.col(c) if isinstance(c, str) else c
    if cond is not None:
        c = F.when(cond, c)
    return F.coalesce(F.sum(c), F.lit(0)).cast("double")


def long_rows(agg_row: DataFrame, specs: list[tuple[str, Column, Column | None]]) -> DataFrame:
    """One aggregated row -> rows (metric, value, cmp, delta_pct).

    ``specs`` are (name, current value, comparison value or None)."""
    null = F.lit(None).cast("double")
    structs = []
    for name, cur, cmp in specs:
        cur = cur.cast("double")
        cmpv = cmp.cast("double") if cmp is not None else null
        structs.append(F.struct(F.lit(name).alias("metric"), cur.alias("value"),
                                cmpv.alias("cmp"), MX.pct_change(cur, cmpv).alias("delta_pct")))
    return agg_row.select(F.inline(F.array(*structs)))


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def exact_avg(c, cond: Column | None = None) -> Column:
    """Mean of a double column, summed as decimal(38,9) so the result does not
    depend on the order rows are added (partitioning, retries)."""
    c = F.col(c) if isinstance(c, str) else c
    d = c.cast("decimal(38,9)")
    if cond is not None:
        d = F.when(cond, d)
    return F.try_divide(F.sum(d).cast("double"), F.count(d).cast("double"))
