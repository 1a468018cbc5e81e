"""Scans and sinks: parquet / CSV / nested JSON order payloads.

Paths are plain Hadoop URIs (local, HDFS, ``s3a://``); there is no client
code of our own.  Scratch output goes under the session's
``spark.checkpoint.dir`` — on a cluster a shared folder, never node-local.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll import model as M
from tillroll.sources.versioned import Versioned

MONEY = T.DecimalType(18, 2)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Dataset existence probe: one question to the path's FileSystem, nothing is listed or read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def scan_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet scan where an absent dataset is a legal, empty result; of a dataset that
    ``write_parquet`` made, the newest version.

    With a declared schema the result is total: same columns either way."""
    versioned = Versioned(spark, path)
    if versioned.exists():
        return versioned.read() if schema is None else versioned.read().to(schema)
    if path_exists(spark, path):
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.parquet(path)
    if schema is None:
        raise FileNotFoundError(path)
    return spark.createDataFrame([], schema)


def load_dated(df: DataFrame) -> DataFrame:
    """Normalise ``date`` to a date and ``created_at`` to a timestamp when present."""
    if "date" in df.columns:
        df = df.withColumn("date", F.to_date("date"))
    if "created_at" in df.columns:
        df = df.withColumn("created_at", F.col("created_at").cast("timestamp"))
    return df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    from tillroll.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def write_parquet(df: DataFrame, path: str, partition_by: str | None = None, even: bool = True) -> int:
    """Full-overwrite parquet sink, optionally partitioned (e.g. by month): a new version
    takes the place of the old one when it is complete.

    ``even=False`` writes rows where they are, for rows that come by ``partition_by`` already."""
    return Versioned(df.sparkSession, path).overwrite(df, partition_by, even=even)


def with_month(df: DataFrame, date_col: str = "date") -> DataFrame:
    return df.withColumn("month", F.date_format(date_col, "yyyy-MM"))


# ── nested order payloads ────────────────────────────────────────────────
PAYLOAD_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("customer", T.StructType([T.StructField("id", T.LongType())])),
    T.StructField("source_name", T.StringType()),
    T.StructField("shipping_address", T.StructType([T.StructField("country_code", T.StringType())])),
    T.StructField("line_items", T.ArrayType(T.StructType([
        T.StructField("price", T.StringType()), T.StructField("quantity", T.IntegerType())]))),
    T.StructField("total_discounts", T.StringType()),
    T.StructField("total_shipping_price_set", T.StructType([T.StructField("shop_money", T.StructType([
        T.StructField("amount", T.StringType())]))])),
    T.StructField("total_price", T.StringType()),
    T.StructField("currency", T.StringType()),
    # an order of many lines comes in pages; a page sent again carries a later updated_at
    T.StructField("page", T.IntegerType()),
    T.StructField("updated_at", T.StringType()),
])


def _money_text(c: Column) -> Column:
    return F.coalesce(c.try_cast(MONEY), F.lit(0).cast(MONEY))


def flatten_payload(raw: DataFrame) -> DataFrame:
    """Nested order payload -> one flat order row (pure column expressions).

    gross = sum(price x quantity) over line items (array fold); discounts
    default 0; net = gross - discounts; cogs = 45% of gross; nullable customer;
    channel defaults to 'unknown'; currency to 'GBP'."""
    items = F.coalesce(F.col("line_items"), F.array().cast(PAYLOAD_SCHEMA["line_items"].dataType))
    gross = F.aggregate(items, F.lit(0).cast(T.DecimalType(38, 2)),
                        lambda acc, x: (acc + _money_text(x["price"]) * x["quantity"]).cast(T.DecimalType(38, 2)))
    disc = _money_text(F.col("total_discounts"))
    return raw.select(
        F.col("id").alias("order_id"),
        F.col("created_at").cast("timestamp").alias("created_at"),
        F.col("customer.id").alias("customer_id"),
        F.coalesce(F.col("source_name"), F.lit("unknown")).alias("channel"),
        F.col("shipping_address.country_code").alias("country"),
        F.round(gross, 2).cast(MONEY).alias("gross_sales"),
        F.round(disc, 2).cast(MONEY).alias("discounts"),
        F.round(gross - disc, 2).cast(MONEY).alias("net_sales"),
        F.round(gross * F.lit(0.45).cast("decimal(3,2)"), 2).cast(MONEY).alias("cogs"),
        _money_text(F.col("total_shipping_price_set.shop_money.amount")).alias("shipping"),
        _money_text(F.col("total_price")).alias("total_price"),
        F.coalesce(F.col("currency"), F.lit("GBP")).alias("currency"),
        F.coalesce(F.col("page"), F.lit(0)).alias("page"),
        F.col("updated_at").cast("timestamp").alias("updated_at"))


def latest_pages(flat: DataFrame) -> DataFrame:
    """Of a page delivered several times the latest delivery (equal times: the larger row)."""
    rest = [c for c in flat.columns if c not in ("order_id", "page", "updated_at")]
    return (flat.groupBy("order_id", "page").agg(F.max(F.struct("updated_at", *rest)).alias("r"))
            .select("order_id", "page", "r.*").select(*flat.columns))


def merge_payload_pages(flat: DataFrame) -> DataFrame:
    """Orders whose line items arrive over several payload pages -> one row per
    order, from each page's latest delivery.  Discounts and totals are amounts of the
    page; shipping is the order's and stands on every page.
    Money is re-derived from the merged gross (exact decimal sums), so a
    split order gives the same row as one whole payload.  Partial aggregation
    keeps an order with very many pages cheap."""
    g = latest_pages(flat).groupBy("order_id").agg(
        F.min("created_at").alias("created_at"),
        F.min_by("customer_id", "created_at").alias("customer_id"),
        F.min_by("channel", "created_at").alias("channel"),
        F.min_by("country", "created_at").alias("country"),
        F.sum("gross_sales").alias("gross"), F.sum("discounts").alias("disc"),
        F.max("shipping").cast(MONEY).alias("shipping"),
        F.sum("total_price").cast(MONEY).alias("total_price"),
        F.min("currency").alias("currency"))
    return g.select(
        "order_id", "created_at", "customer_id", "channel", "country",
        F.col("gross").cast(MONEY).alias("gross_sales"), F.col("disc").cast(MONEY).alias("discounts"),
        F.round(F.col("gross") - F.col("disc"), 2).cast(MONEY).alias("net_sales"),
        F.round(F.col("gross") * F.lit(0.45).cast("decimal(3,2)"), 2).cast(MONEY).alias("cogs"),
        "shipping", "total_price", "currency")


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON order payloads (one object per line) with a declared schema."""
    return spark.read.schema(PAYLOAD_SCHEMA).json(path)


def recent_window(orders: DataFrame, now, days: int = 120) -> DataFrame:
    """Extraction window: orders created at or after ``now - days``."""
    return orders.filter(F.col("created_at") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS"))


# ── targets ingest ───────────────────────────────────────────────────────
def read_targets(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    if fmt == "csv":
        return spark.read.option("header", True).option("inferSchema", False).csv(path)
    return spark.read.parquet(path)


def validate_targets(df: DataFrame) -> tuple[bool, list[str]]:
    """Needs a ``date`` column and at least one known target column (schema only)."""
    matched = [c for c in df.columns if c in M.TARGET_COLUMNS]
    return ("date" in df.columns and bool(matched)), matched


def check_targets(raw: DataFrame) -> DataFrame:
    """``raw`` with typed target columns beside it: ``typed`` (a struct) and ``reasons``.

    A row is good if its date can be read and each target cell is empty or a number that the
    column can hold; ``reasons`` names what is wrong with any other row."""
    matched = [c for c in raw.columns if c in M.TARGET_COLUMNS]
    cells = {c: F.trim(F.col(c).cast("string")) for c in ["date", *matched]}
    date = F.coalesce(F.to_date(F.try_to_timestamp(cells["date"])), F.col("date").try_cast("date"))
    typed = {"date": date, **{c: cells[c].try_cast(MONEY) for c in matched}}
    reasons = [F.when(date.isNull(), F.concat(F.lit("date: "), F.coalesce(cells["date"], F.lit("missing"))))]
    reasons += [F.when(typed[c].isNull() & (F.coalesce(cells[c], F.lit("")) != ""), F.concat(F.lit(f"{c}: "), cells[c])) for c in matched]
    return raw.withColumns({"typed": F.struct(*[v.alias(c) for c, v in typed.items()]),
                            "reasons": F.array_compact(F.array(*reasons))})


def split_targets(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed good rows, and rejected rows: the row as JSON, as it came, and the reason."""
    checked = check_targets(raw)
    row = F.to_json(F.struct(*[F.col(c) for c in raw.columns]), {"ignoreNullFields": "false"})
    return (checked.filter(F.size("reasons") == 0).select("typed.*"),
            checked.filter(F.size("reasons") > 0).select(row.alias("row"), F.array_join("reasons", "; ").alias("reason")))


def replace_targets(raw: DataFrame, path: str, rejects: str | None = None) -> DataFrame:
    """Good rows take the place of the stored targets, as one new version; returns the stored ones.

    Rejected rows go to the dataset ``rejects`` (default: beside the targets), whose version
    carries the number of the targets' version in its properties.  They are written first: targets
    never stand without their rejects."""
    ok, matched = validate_targets(raw)
    if not ok:
        raise ValueError("targets need a date column and a known target column")
    spark = raw.sparkSession
    good, bad = split_targets(raw)
    targets, side = Versioned(spark, path), Versioned(spark, rejects or path.rstrip("/") + "_rejects")
    number = (targets.manifest() or {"version": 0})["version"] + 1
    side.overwrite(bad, properties={"targets_version": number})
    targets.overwrite(good)
    return targets.read()


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(row, reason) of the rows that the last upload of the targets at ``path`` left out."""
    return Versioned(spark, path.rstrip("/") + "_rejects").read()


def export_csv(df: DataFrame, path: str) -> None:
    """Write an aggregate as CSV with display column names."""
    df.withColumnsRenamed({c: M.nice(c) for c in df.columns}).write.mode("overwrite") \
        .option("header", True).csv(path)
