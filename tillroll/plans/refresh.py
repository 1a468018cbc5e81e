"""Incremental model build: only the months whose feeds changed are made anew.

Every fact is a versioned dataset with a folder per month.  Its version carries a digest (rows, and a
sum of row hashes) of each month of each feed that it was made from.  ``refresh`` computes the digests of
the feeds as they are now, one aggregate per feed that returns a row per month, and compares: months
that were added, altered or lost are built from those months of the feeds alone and replace their
folders; all other folders belong to the new version as they are.  A fact is month-local: lanes
aggregate inside a day, and the product fact joins its side feeds by day.

Each fact is replaced at once by its manifest, digests included, so a refresh that fails part way
goes on where it was when it is run again.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions import dims as D
from tillroll.operators import facts as FX
from tillroll.operators import lanes as L
from tillroll.operators.compare import STORED_MONTH, month_number
from tillroll.sources.versioned import Versioned

Feeds = dict[str, DataFrame]
#: fact -> the feeds it is made from, how, and the order of its rows inside a month (the first names the day)
FACTS: dict[str, tuple[list[str], Callable[[Feeds], DataFrame], tuple[str, ...]]] = {
    "fact": ([name for name, _ in L.LANE_MAPPERS], L.stacked_fact, ("date", "source")),
    "fact_product": (["line_items", "traffic_items", "inventory", "returns"],
                     lambda f: FX.product_fact(*[f[n] for n in ("line_items", "traffic_items", "inventory", "returns")],
                                               parts=FX.month_parts(f["line_items"], "created_at")), ("date", "product_id")),
    "fact_email": (["email"], lambda f: FX.email_fact(f["email"]), ("date", "name")),
    "fact_seo": (["seo"], lambda f: FX.seo_fact(f["seo"]), ("date", "query")),
    "fact_orderbank": (["orderbank"], lambda f: FX.orderbank_fact(f["orderbank"]), ("date", "warehouse")),
}
#: facts whose rows come dealt by month: their files need no evening out
BY_MONTH = ("fact_product",)
NO_MONTH = "__HIVE_DEFAULT_PARTITION__"


def feed_day(feed: DataFrame) -> Column:
    """The day that a feed's rows belong to."""
    if "event_date" in feed.columns:
        return D.compact_date("event_date")
    return F.to_date("created_at") if "created_at" in feed.columns else F.col("date").cast("date")


def month_digests(feed: DataFrame) -> dict[str, list[str]]:
    """month -> [rows, sum of the rows' hashes], whatever their order."""
    values = [c for c in sorted(feed.columns) if c != STORED_MONTH]
    found = feed.groupBy(month_number(feed_day(feed)).alias("m")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*values).cast("decimal(38,0)")).alias("h"))
    return {str(r.m) if r.m is not None else NO_MONTH: [str(r.n), str(r.h)] for r in found.collect()}


def in_months(feed: DataFrame, months: set[str]) -> DataFrame:
    """The feed's rows of ``months``; folders of other months of a stored feed are not read."""
    known = [int(m) for m in months if m != NO_MONTH]
    number = F.col(STORED_MONTH) if STORED_MONTH in feed.columns else month_number(feed_day(feed))
    return feed.filter(number.isin(known) | (number.isNull() & F.lit(NO_MONTH in months)))


def in_portions(feeds: Feeds, rows: dict[str, list[str]]) -> list[Feeds]:
    """Feeds of days and products, in portions by month where the lines (digests ``rows``) are many."""
    portions = FX.month_portions({FX.NO_MONTH if m == NO_MONTH else int(m): int(n) for m, (n, _) in rows.items()})

    def some(feed: DataFrame, portion: FX.Portion) -> DataFrame:
        month = F.col(STORED_MONTH) if STORED_MONTH in feed.columns else month_number(feed_day(feed))
        return feed.filter(FX.within(portion, month, F.col("product_id")))
    return [{n: some(f, p) for n, f in feeds.items()} for p in portions] if len(portions) > 1 else [feeds]


def refresh(spark: SparkSession, feeds: Feeds, root: str) -> dict[str, list[str]]:
    """Bring the facts under ``root`` up to date with ``feeds``; the months rewritten of each fact."""
    used = sorted({name for names, _, _ in FACTS.values() for name in names})
    digests = {name: month_digests(feeds[name]) for name in used}
    done = {}
    for fact, (names, build, order) in FACTS.items():
        stored = Versioned(spark, f"{root.rstrip('/')}/{fact}")
        now = {name: digests[name] for name in names}
        was = (stored.manifest() or {"properties": {}})["properties"].get("digests")
        every = {m for d in (now, was or {}) for months in d.values() for m in months}
        changed = {m for m in every if was is None or any(now[n].get(m) != was.get(n, {}).get(m) for n in names)}
        done[fact] = sorted(changed)
        if was is not None and not changed:
            continue
        some = {name: in_months(feeds[name], changed) if was is not None else feeds[name] for name in names}
        even = fact not in BY_MONTH
        portions = [some] if even else in_portions(some, {m: d for m, d in now["line_items"].items() if m in changed})
        rows = [build(p).drop(STORED_MONTH).withColumn(STORED_MONTH, month_number(F.col(order[0]))) for p in portions]
        with FX.dealt_joins(spark):
            if was is None:
                stored.overwrite(rows, STORED_MONTH, {"digests": now}, order, even)
            else:
                stored.replace(rows, sorted(changed), {"digests": now}, order, even)
    return done


def read_fact(spark: SparkSession, root: str, fact: str) -> DataFrame:
    return Versioned(spark, f"{root.rstrip('/')}/{fact}").read()
