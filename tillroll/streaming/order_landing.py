"""Order payloads landed as JSON files, ingested with Structured Streaming.

The batch reporting model refreshes shop orders by pulling a recent window of
order payloads and rebuilding.  Here the same flattening runs as a stream
over a landing folder:

* ``pages_stream`` — each delivery of a payload page as a flat row;
* ``start_orders_upsert`` — keyed upsert: of every (order, page) the latest delivery is kept
  in a versioned dataset by month, and the day x country sales lane of the
  months that changed is made anew.  A page that is sent again with a later
  ``updated_at`` replaces the earlier one however late it comes, so the stored
  orders are those of a batch over the same files;
* ``orders_stream`` — deliveries without exact repeats (same order, page and
  ``updated_at``) inside the watermark, for append-only sinks;
* ``sales_lane_stream`` — the day x country sales lane of a stream without
  corrections, maintained incrementally (event-time watermark on ``created_at``);
* ``start_orders_sink`` — exactly-once parquet file sink with a checkpoint
  beside its output folder; its folder is a log of deliveries, to be read through ``latest_pages``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tillroll.operators.compare import month_number
from tillroll.sources.io import PAYLOAD_SCHEMA, flatten_payload, latest_pages, merge_payload_pages
from tillroll.sources.versioned import Versioned

MONEY = "decimal(18,2)"


def pages_stream(spark: SparkSession, landing_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Every delivered payload page in ``landing_dir`` as a flat row."""
    reader = spark.readStream.schema(PAYLOAD_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return flatten_payload(reader.json(landing_dir))


def orders_stream(spark: SparkSession, landing_dir: str, watermark: str = "2 days",
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming flat pages from JSON payload files in ``landing_dir``, exact repeats dropped."""
    return (pages_stream(spark, landing_dir, max_files_per_trigger).withWatermark("created_at", watermark)
            .dropDuplicatesWithinWatermark(["order_id", "page", "updated_at"]))


PAGE_MONTH = "page_month"
KEYS = ["order_id", "page"]


def upsert_pages(stored: Versioned, deliveries: DataFrame, batch: int | None = None) -> list:
    """Merge deliveries into the stored pages by latest ``updated_at``; the months rewritten.

    Only months that new deliveries fall into, or whose pages moved to another month, are
    read whole and written; of the others the key columns alone are probed.  ``batch`` is
    kept in the version's properties, so a batch that is run again after a failure changes nothing."""
    spark = deliveries.sparkSession
    now = stored.manifest()
    if now and batch is not None and now["properties"].get("batch", -1) >= batch:
        return []
    new = latest_pages(deliveries.dropna(subset=["order_id"])).withColumn(PAGE_MONTH, month_number(F.col("created_at"))).persist()
    try:
        if now is None:
            stored.overwrite(new, PAGE_MONTH, {"batch": batch} if batch is not None else {})
            return [r[0] for r in new.select(PAGE_MONTH).distinct().collect()]
        old = stored.read()
        months = {r[0] for r in new.select(PAGE_MONTH).distinct().collect()}
        moved = old.filter(~F.col(PAGE_MONTH).isin(*months) | F.col(PAGE_MONTH).isNull()).join(new.select(*KEYS), KEYS, "left_semi")
        months |= {r[0] for r in moved.select(PAGE_MONTH).distinct().collect()}
        if not months:
            return []
        here = F.col(PAGE_MONTH).isin(*[m for m in months if m is not None]) | (F.col(PAGE_MONTH).isNull() & F.lit(None in months))
        every = old.filter(here).unionByName(new)
        merged = latest_pages(every.drop(PAGE_MONTH)).withColumn(PAGE_MONTH, month_number(F.col("created_at")))
        names = ["__HIVE_DEFAULT_PARTITION__" if m is None else m for m in months]
        stored.replace(merged, names, {"batch": batch} if batch is not None else {})
        return sorted(months, key=lambda m: (m is None, m))
    finally:
        new.unpersist()


def sales_lane(orders: DataFrame) -> DataFrame:
    """Day x country sums of whole orders."""
    return orders.groupBy(F.to_date("created_at").alias("date"), "country").agg(
        F.count(F.lit(1)).alias("orders"), *[F.sum(c).cast(MONEY).alias(n) for c, n in (
            ("net_sales", "revenue"), ("gross_sales", "gross_sales"), ("discounts", "discounts"), ("cogs", "cogs"))])


def current_orders(spark: SparkSession, path: str) -> DataFrame:
    """The orders of the stored pages: one row per order, as a batch over all files gives."""
    return merge_payload_pages(Versioned(spark, path).read().drop(PAGE_MONTH))


def start_orders_upsert(pages: DataFrame, path: str, lane_path: str | None = None, checkpoint: str | None = None,
                        available_now: bool = True) -> StreamingQuery:
    """Keep the latest delivery of every page at ``path``, and the sales lane of its months at ``lane_path``.

    A page's order is in its month, so a month's lane needs that month's pages only."""
    def merge(deliveries: DataFrame, batch: int) -> None:
        spark = deliveries.sparkSession
        stored = Versioned(spark, path)
        upsert_pages(stored, deliveries, batch)
        if lane_path is None or not stored.exists():
            return
        # months whose folders are not those that the lane was made from: also after a failure between the two writes
        lane, found = Versioned(spark, lane_path), stored.manifest()["folders"]
        made_from = set((lane.manifest() or {"properties": {}})["properties"].get("folders", []))
        changed = sorted({f.split("=")[-1] for f in set(found) ^ made_from})
        if not changed:
            return
        part = F.coalesce(F.col(PAGE_MONTH).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
        pages_ = stored.read().filter(part.isin(*changed)).drop(PAGE_MONTH)
        rows = sales_lane(merge_payload_pages(pages_)).withColumn(PAGE_MONTH, month_number(F.col("date")))
        (lane.replace(rows, changed, {"folders": found}) if lane.exists() else lane.overwrite(rows, PAGE_MONTH, {"folders": found}))

    checkpoint = checkpoint or path.rstrip("/") + "_checkpoint"
    w = pages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def sales_lane_stream(orders: DataFrame) -> DataFrame:
    """Incremental day x country sums of a (deduplicated) order stream; a day's state goes with the watermark."""
    day = F.window("created_at", "1 day")
    return (orders.groupBy(day.alias("day"), "country")
            .agg(F.count(F.when(F.col("page") == 0, 1)).alias("orders"),
                 F.sum("net_sales").cast(MONEY).alias("revenue"),
                 F.sum("gross_sales").cast(MONEY).alias("gross_sales"),
                 F.sum("discounts").cast(MONEY).alias("discounts"),
                 F.sum("cogs").cast(MONEY).alias("cogs"))
            .select(F.to_date("day.start").alias("date"), "country", "orders", "revenue", "gross_sales", "discounts", "cogs"))


def start_orders_sink(orders: DataFrame, out_dir: str, checkpoint: str | None = None,
                      available_now: bool = True) -> StreamingQuery:
    """Append flat orders to parquet, exactly once (file sink + checkpoint).

    The checkpoint belongs to the output folder, so a restarted query goes on where it was."""
    checkpoint = checkpoint or out_dir.rstrip("/") + "_checkpoint"
    w = (orders.writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
