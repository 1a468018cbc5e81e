"""Order roll-up, product fact and pass-through facts.

The product fact pre-aggregates every side feed to (date, product_id) before
its left joins, so each join is key-unique on the right.  Lines hardly share
their day and product, so they are dealt over tasks as they are, once, and all
aggregates and joins stay where their rows are.
"""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators.compare import month_number

MONEY = "decimal(18,2)"
PRODUCT_KEYS = ["date", "product_id", "product_title", "category_l1", "category", "style"]


#: the columns that rows are dealt over tasks by: the month of their day, and one of the month's parts by product
DEALT = ["dealt_month", "dealt_part"]
#: rows of a month that make another part of it
PART_ROWS = 500_000


#: lines are joined, rolled up and dealt in portions of so many rows, in this many portions at most: the shuffles of one
#: portion alone take disk at a time
PORTION_ROWS = 10_000_000
PORTIONS = 8
NO_MONTH = -1


class Portion(NamedTuple):
    """Rows of some months; of ``of`` parts by product the one numbered ``part``."""
    months: list[int]
    of: int = 1
    part: int = 0


def month_rows(days: DataFrame, day: str) -> dict[int, int]:
    """month -> rows; rows without a day count under ``NO_MONTH``."""
    found = days.groupBy(F.coalesce(month_number(F.col(day)), F.lit(NO_MONTH)).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    return {r.m: r.n for r in found.collect()}


def parts_of(rows: dict[int, int]) -> dict[int, int]:
    return {m: -(-n // PART_ROWS) for m, n in rows.items() if m != NO_MONTH and n > PART_ROWS}


def month_parts(days: DataFrame, day: str) -> dict[int, int]:
    """month -> number of parts, of the months with more than one part's rows."""
    return parts_of(month_rows(days, day))


def portion_count(rows: int) -> int:
    return max(1, min(PORTIONS, -(-rows // PORTION_ROWS)))


def month_portions(rows: dict[int, int]) -> list[Portion]:
    """All months in groups of about a portion's rows; a month of more rows is cut by product. One portion has no bounds."""
    total = sum(rows.values())
    size = -(-total // portion_count(total))
    if size == total:
        return [Portion(sorted(rows))]
    out, group, held = [], [], 0
    for m in sorted(rows):
        if rows[m] > size:
            n = -(-rows[m] // size)
            out += [Portion([m], n, i) for i in range(n)]
            continue
        if held + rows[m] > size:
            out.append(Portion(group))
            group, held = [], 0
        group, held = [*group, m], held + rows[m]
    return out + [Portion(group)] * bool(group)


def within(portion: Portion, month: Column, product: Column) -> Column:
    """Whether a row is in ``portion``; of a stored ``month`` other folders are not read."""
    found = F.coalesce(month, F.lit(NO_MONTH)).isin(portion.months)
    return found if portion.of == 1 else found & (F.pmod(F.hash(product), F.lit(portion.of)) == portion.part)


def key_portions(df: DataFrame, key: str, n: int) -> list[DataFrame]:
    """``df`` in ``n`` portions, all rows of a key in one."""
    if n == 1:
        return [df]
    return [df.filter(F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(n)) == i) for i in range(n)]


def dealt(df: DataFrame, day: Column, product: Column, parts: dict[int, int]) -> DataFrame:
    """``df`` with each part of a month in one task; a day's rows of a product are in one part."""
    month = month_number(day)
    many = [F.lit(x) for pair in parts.items() for x in pair]
    n = F.coalesce(F.create_map(*many)[month], F.lit(1)) if many else F.lit(1)
    return df.withColumns({DEALT[0]: month, DEALT[1]: F.pmod(F.xxhash64(product), n).cast("int")}).repartition(*DEALT)


@contextmanager
def dealt_joins(spark: SparkSession) -> Iterator[None]:
    """Inside, a join leaves rows where they are dealt by some of its keys."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def orders_from_lines(lines: DataFrame, shipping=0, currency: str = "GBP") -> DataFrame:
    """Line items -> one row per order.

    Customer and country come from the order's earliest line (``min_by``, so the
    pick is deterministic); money is summed exactly in decimal."""
    g = lines.groupBy("order_id").agg(
        F.min("created_at").alias("created_at"),
        F.min_by("customer_id", "created_at").alias("customer_id"),
        F.min_by("country", "created_at").alias("country"),
        F.sum("gross_sales").cast(MONEY).alias("gross_sales"),
        F.sum("discounts").cast(MONEY).alias("discounts"),
        F.sum("net_sales").cast(MONEY).alias("net_sales"),
        F.sum("cogs").cast(MONEY).alias("cogs"))
    ship = F.lit(shipping).cast(MONEY)
    return g.select("order_id", "created_at", "customer_id", "country", "gross_sales",
                    "discounts", "net_sales", "cogs", ship.alias("shipping"),
                    F.round(F.col("net_sales") + ship, 2).cast(MONEY).alias("total_price"),
                    F.lit(currency).alias("currency"))


def product_fact(lines: DataFrame, items: DataFrame | None = None,
                 inventory: DataFrame | None = None, returns: DataFrame | None = None,
                 parts: dict[int, int] | None = None) -> DataFrame:
    """Date x product fact: sales and margin, plus funnel, stock and returns.

    Line items with a null grouping key are dropped.  Side feeds join on
    (date, product_id) while the base is finer (title/category/style), so a
    product with two titles on one day repeats its joined measures.

    With ``parts`` (of ``month_parts``) rows are dealt by month and part, so that the fact can be written
    by month as it is; inputs that have the columns ``DEALT`` are dealt already."""
    at = DEALT if parts is not None else []

    def placed(df: DataFrame) -> DataFrame:
        return df if not at or set(at) <= set(df.columns) else dealt(df, F.col("date"), F.col("product_id"), parts)

    keys = [k for k in PRODUCT_KEYS if k == "date" or k in lines.columns]
    l = lines.withColumn("date", F.to_date("created_at"))
    l = l.filter(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    base = (placed(l) if at else l.repartition("date", "product_id")).groupBy(*at, *keys).agg(
        F.sum("quantity").alias("units"),
        F.sum("net_sales").cast(MONEY).alias("revenue"),
        F.sum("gross_sales").cast(MONEY).alias("gross_sales"),
        F.sum("discounts").cast(MONEY).alias("discounts"),
        F.sum("cogs").cast(MONEY).alias("cogs"),
    ).withColumn("gross_profit", F.round(F.col("revenue") - F.col("cogs"), 2).cast(MONEY))
    jk = [*at, "date", "product_id"]
    if items is not None:
        it = placed(items).groupBy(*jk).agg(F.sum("item_views").alias("product_views"),
                                    F.sum("item_add_to_carts").alias("product_add_to_carts"))
        base = base.join(it, jk, "left")
    if inventory is not None:
        unit_value = (F.col("stock_value_per_unit") if "stock_value_per_unit" in inventory.columns
                      else F.lit(0).cast(MONEY))
        aggs = [F.sum("on_hand").alias("on_hand"),
                F.sum(F.col("on_hand") * unit_value).cast(MONEY).alias("stock_value")]
        if "in_transit" in inventory.columns:
            aggs.append(F.sum("in_transit").alias("in_transit"))
        base = base.join(placed(inventory).groupBy(*jk).agg(*aggs), jk, "left")
    if returns is not None and "kind" in returns.columns:
        rt = (placed(returns.filter(F.col("kind") == "return")).groupBy(*jk)
              .agg(F.sum("quantity").alias("returned_units"),
                   F.sum("value").cast(MONEY).alias("refund_amount")))
        base = base.join(rt, jk, "left")
    return base.drop(*at)


def email_fact(email: DataFrame) -> DataFrame:
    return email.select(F.col("date").cast("date"), "name", "type", "recipients", "opens",
                        "clicks", "orders", F.col("revenue").cast(MONEY))


def seo_fact(seo: DataFrame) -> DataFrame:
    return seo.select(F.col("date").cast("date"), "query", "branded", "clicks", "impressions",
                      F.col("position").cast("double"))


def orderbank_fact(ob: DataFrame) -> DataFrame:
    return ob.select(F.col("date").cast("date"), "category_l1", "warehouse", "open_orders",
                     "open_items", F.col("open_value").cast(MONEY))
