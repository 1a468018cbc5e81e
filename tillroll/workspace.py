"""A workspace: the feeds of one data folder and the facts built from them.

The model-build step (joins of the raw tables, the order roll-up, the six
lanes of the stacked fact, the product, email, SEO and order-bank facts) runs
once per session and input version.  Its output is written as parquet under the
session's ``spark.checkpoint.dir`` (a shared folder on a cluster) and every
report reads it back.  That cuts lineage — a lost executor recomputes from the
written table, not from the raw joins — and lets many reports share one build.

Facts and line items have one layout at every size: a folder per month
(``stored_month``), rows inside by day and source, files evened out by AQE's
``rebalance`` so that a hot month is split over tasks (the product fact is dealt
by month and part before it is aggregated; the tasks that join the lines write
them, each its file of a month).  Date filters then prune folders, and row
groups inside them.  Intermediate tables that are read whole (shifted events,
traffic, ads) are written as they come.  Of the lines the source columns alone
are stored; derived ones are made when they are read.
"""
from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll import model as M
from tillroll.operators import facts as FX
from tillroll.operators import lanes as L
from tillroll.operators.compare import STORED_MONTH, month_number
from tillroll.plans import lattice as LT
from tillroll.plans.customer_state import customer_state
from tillroll.plans.prefix_sums import prefix_sums
from tillroll.session import stored_writes
from tillroll.sources.fixtures import REF_DATE, DriverFeeds
from tillroll.sources.io import path_exists, scratch_path

_BUILT: dict[tuple, tuple[str, T.StructType]] = {}
_LOCK = threading.RLock()
INPUT_TABLES = ["customer", "part", "orders", "lineitem", "events"]
# stored table -> the columns its rows are ordered by inside a month; the first names the day
STORED_BY_MONTH = {"lines_base": ["created_at"], "orders": ["created_at"],
                   "fact": ["date", "source"], "fact_product": ["date", "product_id"],
                   "fact_email": ["date"], "fact_seo": ["date"], "fact_orderbank": ["date"]}


# written by the tasks that made them: the product fact's hold few months each, and the lines of an order stay side by side
DEALT_BY_MONTH = ("lines_base", "fact_product")


# feeds that are written as they land, so that their readers share one derivation; others are stored under other names
LANDED = ["inventory", "returns", "traffic_items", "meta", "google", "microsoft", "tiktok", "email", "seo", "orderbank", "targets"]
# landed feeds whose rows each come from the lines of one day and product
BY_PORTIONS = ("inventory", "traffic_items")
FOOTER_TABLES = {"orders": "orders", "line_items": "lines_base", "traffic": "traffic"}
FACT_PROPERTIES = {"fact": "fact", "fact_product": "product_fact", "fact_email": "email_fact", "fact_seo": "seo_fact",
                   "fact_orderbank": "orderbank"}
# small tables by day: files and row groups follow the days
BY_DAY = ("rollup_", "prefix_sums")
FOOTERS = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"}


@contextmanager
def footers_only(spark: SparkSession) -> Iterator[None]:
    """Inside, parquet scans push counts, minima and maxima down to the footers."""
    before = {k: spark.conf.get(k, None) for k in FOOTERS}
    try:
        for k, v in FOOTERS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _bounds(df: DataFrame, day: str | None, name: str = "") -> DataFrame:
    days = [F.min(day), F.max(day)] if day else [F.lit(None).cast("date")] * 2
    return df.agg(F.count(F.lit(1)).alias("rows"), *[d.alias(n) for d, n in zip(days, ("low", "high"), strict=True)]).select(
        F.lit(name).alias("name"), "rows", "low", "high")


def _fingerprint(spark: SparkSession, sf_dir: str) -> tuple:
    """(size, mtime) of every input table, through the path's Hadoop FileSystem."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    out = []
    for t in INPUT_TABLES:
        p = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        fs = p.getFileSystem(conf)
        if fs.exists(p):
            s = fs.getContentSummary(p)
            out.append((t, int(s.getLength()), int(fs.getFileStatus(p).getModificationTime())))
    return tuple(out)


def write_by_month(df: DataFrame, path: str, order: list[str], dealt: bool = False, mode: str = "overwrite") -> None:
    """Write ``df`` with a folder per month of its day column, rows in order inside; ``dealt``: rows stay in their tasks."""
    rows = df.withColumn(STORED_MONTH, month_number(F.col(order[0])))
    ((rows if dealt else rows.hint("rebalance", STORED_MONTH)).sortWithinPartitions(STORED_MONTH, *order)
     .write.mode(mode).partitionBy(STORED_MONTH).parquet(path))


class Workspace:
    def __init__(self, spark: SparkSession, sf_dir: str, materialize: bool = True):
        """``materialize=False`` keeps every report one lazy plan from the raw tables."""
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.materialize = materialize
        self._inputs = _fingerprint(spark, self.sf_dir) if materialize else ()
        self.feeds = DriverFeeds(spark, self.sf_dir, store=self._store if materialize else None)
        self.ref = REF_DATE
        self._facts: dict[str, DataFrame] = {}
        self._lattice: LT.Lattice | None = None

    # ── model build ──────────────────────────────────────────────────────
    def _key(self, name: str) -> tuple:
        return self.spark.sparkContext.applicationId, self.sf_dir, name, self._inputs

    def _store(self, name: str, build) -> DataFrame:
        """Build ``name`` once per (application, inputs) and read it back from parquet.

        ``build`` gives the table, or a list of its portions, which are built and written one after the other."""
        key = self._key(name)
        order = STORED_BY_MONTH.get(name)
        with _LOCK:
            path, schema = _BUILT.get(key, (None, None))
            if path is None or not path_exists(self.spark, path):
                path = scratch_path(self.spark, name)
                made = build()
                portions = [made] if isinstance(made, DataFrame) else made
                schema = T.StructType([T.StructField(f.name, f.dataType) for f in portions[0].schema.fields])
                for i, df in enumerate(portions):
                    mode = "append" if i else "overwrite"
                    with stored_writes(self.spark), FX.dealt_joins(self.spark) if order else nullcontext():
                        if order:
                            write_by_month(df, path, order, name in DEALT_BY_MONTH, mode)
                            continue
                        if name.startswith(BY_DAY):
                            df = df.repartitionByRange("date").sortWithinPartitions("date")
                        df.write.mode(mode).parquet(path)
                if order:
                    schema = schema.add(STORED_MONTH, T.IntegerType())
                _BUILT[key] = path, schema
        # the declared schema makes an empty table (no file) legal
        return self.spark.read.schema(schema).parquet(path)

    def _memo(self, key, build):
        if key not in self._facts:
            self._facts[key] = self._store(key, build) if self.materialize else build()
        return self._facts[key]

    def build_all(self) -> None:
        """Run the model build (all stored tables) eagerly."""
        for name in LANDED:
            self.feed(name)
        self.fact, self.product_fact, self.orders  # noqa: B018
        self.email_fact, self.seo_fact, self.orderbank, self.customer_state  # noqa: B018
        for name in LT.ROLLUPS:
            self.lattice.rollup(name)
        self.prefix_sums  # noqa: B018

    # ── feeds and facts ──────────────────────────────────────────────────
    def feed(self, name: str) -> DataFrame:
        if name == "orders":
            return self.orders
        if name in LANDED:
            make = getattr(self.feeds, name)
            return self._memo(f"feed_{name}", lambda: self._by_portions(make) if name in BY_PORTIONS and self.materialize else make())
        return getattr(self.feeds, name)()

    def _by_portions(self, make: Callable[..., DataFrame]) -> DataFrame | list[DataFrame]:
        """What ``make`` derives from the lines of a day and product, in portions where the lines are many."""
        def some(portion: FX.Portion) -> DataFrame:
            return make(lambda df, day, product: df.filter(FX.within(portion, F.col(STORED_MONTH), product)))
        portions = FX.month_portions(FX.month_rows(self.feeds.lines_raw(), "created_at"))
        return [some(p) for p in portions] if len(portions) > 1 else make()

    def from_footers(self, names: list[str], day: str | None = None) -> dict[str, tuple]:
        """(rows, first day, last day) of stored tables; parquet footers answer, no data page is read.

        ``names`` are facts or feeds; ``day`` names the column of days, if these are asked for."""
        def frame(name: str) -> DataFrame:
            return getattr(self, FACT_PROPERTIES[name]) if name in FACT_PROPERTIES else self.feed(name)

        if not self.materialize:
            return {n: tuple(_bounds(frame(n), day).first())[1:] for n in names}
        keys = {n: self._key(FOOTER_TABLES.get(n, n if n in FACT_PROPERTIES else f"feed_{n}")) for n in names}
        # facts first: they take the largest shuffles, while least is stored
        for n, key in sorted(keys.items(), key=lambda k: k[0] not in FACT_PROPERTIES):
            if key not in _BUILT or not path_exists(self.spark, _BUILT[key][0]):
                frame(n)
        stored = {n: _BUILT[key] for n, key in keys.items()}
        with footers_only(self.spark):
            parts = [_bounds(self.spark.read.option("recursiveFileLookup", "true").schema(schema).parquet(path), day, n) for n, (path, schema) in stored.items()]
            return {r[0]: tuple(r)[1:] for r in reduce(DataFrame.unionByName, parts).collect()}

    @property
    def fact(self) -> DataFrame:
        return self._memo("fact", lambda: L.stacked_fact(
            {name: self.feed(name) for name, _ in L.LANE_MAPPERS}))

    @property
    def product_fact(self) -> DataFrame:
        def build() -> DataFrame:
            f = self.feeds
            if not self.materialize:
                return FX.product_fact(f.line_items(), f.traffic_items(), f.inventory(), f.returns())
            rows = FX.month_rows(f.lines_raw(), "created_at")
            parts, portions = FX.parts_of(rows), FX.month_portions(rows)

            def some(portion: FX.Portion | None) -> DataFrame:
                def deal(df: DataFrame, day: Column, product: Column) -> DataFrame:
                    lines = df if portion is None else df.filter(FX.within(portion, F.col(STORED_MONTH), product))
                    return FX.dealt(lines, day, product, parts)
                returns = f.returns()
                if portion is not None:
                    returns = returns.filter(FX.within(portion, month_number(F.col("date")), F.col("product_id")))
                # the feeds of lines are dealt before they aggregate: stored ones would have to be dealt again
                return FX.product_fact(f.line_items(deal), f.traffic_items(deal), f.inventory(deal), returns, parts)
            return [some(p) for p in portions] if len(portions) > 1 else some(None)
        return self._memo("fact_product", build)

    @property
    def orders(self) -> DataFrame:
        def build() -> DataFrame | list[DataFrame]:
            lines = self.feeds.line_items()
            n = FX.portion_count(lines.count() // 4) if self.materialize else 1  # narrow, and every portion reads all lines
            made = [FX.orders_from_lines(p) for p in FX.key_portions(lines, "order_id", n)]
            return made if n > 1 else made[0]
        return self._memo("orders", build)

    @property
    def customer_state(self) -> DataFrame:
        return self._memo("customer_state", lambda: customer_state(self.orders))

    @property
    def lattice(self) -> LT.Lattice:
        """Roll-ups of the stacked fact, each stored when it is first asked for."""
        def store(name: str, build) -> tuple[DataFrame, int]:
            table = self._memo(f"rollup_{name}", build)
            if not self.materialize:
                return table, len(LT.ROLLUPS[name])  # nothing is written to count: fewer dimensions count as smaller
            with footers_only(self.spark):
                path, schema = _BUILT[self._key(f"rollup_{name}")]
                return table, self.spark.read.schema(schema).parquet(path).agg(F.count(F.lit(1))).first()[0]

        if self._lattice is None:
            self._lattice = LT.Lattice(lambda: self.fact, store)
        return self._lattice

    @property
    def prefix_sums(self) -> DataFrame:
        """Running sums of every base metric by day, from the roll-up by day."""
        return self._memo("prefix_sums", lambda: prefix_sums(self.lattice.rollup("day"), list(M.BASE_METRICS)))

    @property
    def email_fact(self) -> DataFrame:
        return self._memo("fact_email", lambda: FX.email_fact(self.feed("email")))

    @property
    def seo_fact(self) -> DataFrame:
        return self._memo("fact_seo", lambda: FX.seo_fact(self.feed("seo")))

    @property
    def orderbank(self) -> DataFrame:
        return self._memo("fact_orderbank", lambda: FX.orderbank_fact(self.feed("orderbank")))

    @property
    def targets(self) -> DataFrame:
        return self.feed("targets")

    @property
    def line_items(self) -> DataFrame:
        return self.feed("line_items")

    @property
    def returns(self) -> DataFrame:
        return self.feed("returns")
