"""Query registrations: reports, facts, sources and sinks."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll import model as M
from tillroll.catalog import CUR, LY, REF, query
from tillroll.functions import metrics as MX
from tillroll.functions import periods as P
from tillroll.operators import compare as C
from tillroll.plans import customers as CU
from tillroll.plans import ecommerce as E
from tillroll.plans import finance as FI
from tillroll.plans import orders as OR
from tillroll.plans import paid_seo as PS
from tillroll.plans import lattice as LT
from tillroll.plans import product as PR
from tillroll.plans.common import union_all
from tillroll.plans.prefix_sums import range_totals
from tillroll.plans.registry import out
from tillroll.plans import refresh as RF
from tillroll.sources import io as IO

SUMMARY = M.KPI_GROUPS["Overview Metrics"] + M.KPI_GROUPS["Funnel Metrics"]


# ── periods, KPIs, targets, trends ─────────────────────────────────────
@query("period_totals")
def q_period_totals(ws):
    return E.period_totals(ws.prefix_sums, REF, ["revenue", "orders", "visits", "conversion_rate"])


# ranges as a user may pick them: inside, across the first and the last day, one day, outside, turned round
RANGES = [("inside", dt.date(1997, 11, 5), dt.date(1998, 2, 14)), ("from before", dt.date(1980, 1, 1), dt.date(1996, 7, 4)),
          ("to after", dt.date(1998, 1, 20), dt.date(2031, 5, 6)), ("one day", dt.date(1998, 3, 3), dt.date(1998, 3, 3)),
          ("before all", dt.date(1970, 1, 1), dt.date(1971, 1, 1)), ("after all", dt.date(2040, 1, 1), dt.date(2041, 1, 1)),
          ("turned round", dt.date(1998, 3, 3), dt.date(1998, 2, 1)), ("everything", dt.date(1900, 1, 1), dt.date(2100, 1, 1))]


@query("range_totals")
def q_range_totals(ws):
    """Every metric over custom ranges, two rows of the prefix sums each."""
    return range_totals(ws.prefix_sums, RANGES, M.ALL_METRICS, ["label"])


EXPLORER_DIMS = list(LT.ROLLUPS["explorer"])
EXPLORED = [["geo_market"], ["marketing_channel_group", "device"], ["source", "geo_region"], EXPLORER_DIMS]


@query("explorer_lattice")
def q_explorer_lattice(ws):
    """All metrics by sets of dimensions, each from the smallest roll-up that has them."""
    parts = []
    for dims in EXPLORED:
        table = ws.lattice.choose(dims)[1]
        bases = list(M.BASE_METRICS)
        sums = C.apply_filters(table, *CUR).groupBy(*dims).agg(*C.sums(bases))
        parts.append(sums.select(F.lit("+".join(dims)).alias("dims"), F.concat_ws("|", *dims).alias("key"), *C.metric_cols(M.ALL_METRICS)))
    return union_all(parts)


CUSTOM = (dt.date(1998, 1, 20), dt.date(2003, 12, 31))


@query("kpi_custom_range")
def q_kpi_custom_range(ws):
    """Custom range clamped into the data bounds (scalar subqueries), no comparison."""
    lo, hi = (ws.fact.select(f("date")).scalar() for f in (F.min, F.max))
    start, end = (F.greatest(lo, F.least(hi, F.lit(d))) for d in CUSTOM)
    return C.kpi_rows(ws.fact, SUMMARY, (start, end), None, ws.targets)


@query("kpi_paid")
def q_kpi_paid(ws):
    return E.kpi_summary(ws.fact, CUR, LY, ws.targets, groups=["Paid Metrics"])


@query("kpi_favourability")
def q_kpi_favourability(ws):
    rows = C.favourability(C.kpi_rows(ws.fact, SUMMARY, CUR, LY, ws.targets))
    return C.favourability(rows.withColumnRenamed("good", "good_vs_cmp"), "vtarg_pct") \
        .withColumnRenamed("good", "good_vs_target")


@query("kpi_delta_units")
def q_kpi_delta_units(ws):
    """Change in each metric's own unit: percentage points for percent metrics."""
    rows = C.kpi_rows(ws.fact, SUMMARY + ["spend", "roas"], CUR, LY)
    return rows.select("metric", "value", "cmp",
                       MX.delta_in_units(F.col("metric"), F.col("value"), F.col("cmp")).alias("delta_units"))


@query("sparkline")
def q_sparkline(ws):
    start, end = P.resolve_period("Last 7 Days", REF)
    return E.sparkline(ws.fact, "revenue", start, end)


@query("target_direct")
def q_target_direct(ws):
    return C.target_rows(ws.targets, CUR, list(M.BASE_METRICS))


@query("target_implied")
def q_target_implied(ws):
    return C.target_rows(ws.targets, CUR, list(M.DERIVED_METRICS))


@query("trend_ty_ly")
def q_trend_ty_ly(ws):
    name, freq = M.TREND_PRESETS["Year to Date (Weekly)"]
    return E.trend_ty_ly(ws.fact, name, freq, "revenue", REF)


@query("trend_presets")
def q_trend_presets(ws):
    """Every this-year / last-year preset, from one scan."""
    return E.trends_ty_ly(ws.fact, M.TREND_PRESETS, "revenue", REF)


# ── profitability / forecast / digest ───────────────────────────────────
@query("finance_waterfall")
def q_finance_waterfall(ws):
    return FI.finance_waterfall(ws.fact, ws.returns, CUR)


@query("perf_vs_budget")
def q_perf_vs_budget(ws):
    return FI.perf_vs_budget(ws.fact, ws.targets, CUR)


@query("run_rate")
def q_run_rate(ws):
    return FI.run_rate(ws.fact, ws.targets, REF)


@query("top_movers")
def q_top_movers(ws):
    return FI.top_movers(ws.fact, ws.targets, CUR, LY)


@query("biggest_move")
def q_biggest_move(ws):
    return FI.biggest_move(ws.fact, ws.targets, CUR, LY)


@query("benchmarks")
def q_benchmarks(ws):
    return FI.benchmarks(ws.fact, CUR)


@query("data_trust")
def q_data_trust(ws):
    return FI.data_trust(ws.fact)


@query("roas_extremes")
def q_roas_extremes(ws):
    return PS.roas_extremes(ws.fact, CUR)


# ── customers ─────────────────────────────────────────────────────────
@query("customer_kpis")
def q_customer_kpis(ws):
    return CU.customer_kpis(ws.customer_state, ws.fact, CUR, LY)


@query("new_vs_returning")
def q_new_vs_returning(ws):
    return CU.new_vs_returning(ws.orders, CUR)


@query("cohort_retention")
def q_cohort_retention(ws):
    return CU.cohort_retention(ws.orders)


@query("cohort_matrix")
def q_cohort_matrix(ws):
    return CU.cohort_matrix(ws.orders)


@query("email_performance")
def q_email_performance(ws):
    return CU.email_performance(ws.email_fact, CUR, LY)


# ── product ───────────────────────────────────────────────────────────
@query("product_agg")
def q_product_agg(ws):
    return PR.product_table(ws.product_fact, CUR)


@query("product_kpis")
def q_product_kpis(ws):
    return PR.product_kpis(ws.product_fact, CUR, LY)


@query("category_table")
def q_category_table(ws):
    return PR.category_table(ws.product_fact, CUR, LY)


@query("product_funnel_top20")
def q_product_funnel_top20(ws):
    return PR.funnel_top(ws.product_fact, CUR, LY)


@query("stock_health")
def q_stock_health(ws):
    return PR.stock_health(ws.product_fact, CUR, LY)


@query("low_stock_top20")
def q_low_stock_top20(ws):
    return PR.low_stock(ws.product_fact, CUR)


@query("return_rates")
def q_return_rates(ws):
    return PR.return_rates(ws.product_fact, CUR, LY)


@query("worst_returns_top15")
def q_worst_returns_top15(ws):
    return PR.worst_returners(ws.product_fact, CUR)


@query("return_reasons")
def q_return_reasons(ws):
    return PR.return_reasons(ws.returns, CUR)


# ── paid / seo ───────────────────────────────────────────────────────
@query("paid_kpis")
def q_paid_kpis(ws):
    return PS.paid_kpis(ws.fact, CUR, LY)


@query("paid_platform_table")
def q_paid_platform_table(ws):
    return PS.platform_table(ws.fact, CUR, LY)


@query("seo_kpis")
def q_seo_kpis(ws):
    return PS.seo_kpis(ws.seo_fact, CUR, LY)


@query("seo_branded")
def q_seo_branded(ws):
    return PS.seo_branded(ws.seo_fact, CUR)


@query("seo_top_queries")
def q_seo_top_queries(ws):
    return PS.seo_top_queries(ws.seo_fact, CUR, LY)


# ── orders / order bank ───────────────────────────────────────────────
@query("order_insight")
def q_order_insight(ws):
    return OR.order_insight(ws.line_items, CUR, LY)


@query("order_value_histogram")
def q_order_value_histogram(ws):
    return OR.order_value_histogram(ws.line_items, CUR)


@query("revenue_by_category")
def q_revenue_by_category(ws):
    return OR.revenue_by_category(ws.line_items, CUR)


@query("top_products")
def q_top_products(ws):
    return OR.top_products(ws.line_items, CUR)


@query("orderbank_snapshot")
def q_orderbank_snapshot(ws):
    return OR.orderbank_snapshot(ws.orderbank)


@query("orderbank_by_category")
def q_orderbank_by_category(ws):
    return OR.orderbank_by(ws.orderbank, "category_l1")


@query("orderbank_by_warehouse")
def q_orderbank_by_warehouse(ws):
    return OR.orderbank_by(ws.orderbank, "warehouse")


@query("orderbank_trend")
def q_orderbank_trend(ws):
    return OR.orderbank_trend(ws.orderbank)


# ── facts ─────────────────────────────────────────────────────────────
@query("fact_product")
def q_fact_product(ws):
    return out(ws.product_fact)


@query("fact_email")
def q_fact_email(ws):
    return out(ws.email_fact)


@query("fact_seo")
def q_fact_seo(ws):
    return out(ws.seo_fact)


@query("fact_orderbank")
def q_fact_orderbank(ws):
    return out(ws.orderbank)


@query("orders_from_lines")
def q_orders_from_lines(ws):
    return out(ws.orders)


# ── sources and sinks ─────────────────────────────────────────────────
ORDERS_SCHEMA = T.StructType([
    T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
    T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType()),
    T.StructField("o_orderdate", T.TimestampType())])


@query("scan_parquet")
def q_scan_parquet(ws):
    """Declared-schema dated load; an absent dataset contributes an empty frame."""
    spark = ws.spark
    present = IO.scan_parquet(spark, f"{ws.sf_dir}/orders.parquet", ORDERS_SCHEMA)
    absent = IO.scan_parquet(spark, f"{ws.sf_dir}/no_such_feed.parquet", ORDERS_SCHEMA)
    df = IO.load_dated(present.unionByName(absent).withColumn("date", F.col("o_orderdate")))
    return df.groupBy(F.year("date").alias("year"), "o_orderstatus").agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


PROBED = ["customer", "part", "orders", "lineitem", "events", "no_such_feed"]


@query("source_probe")
def q_source_probe(ws):
    """Existence probe of the raw datasets, with the rows of those that are there."""
    def one(name):
        path = f"{ws.sf_dir}/{name}.parquet"
        there = IO.path_exists(ws.spark, path)
        rows = IO.scan_parquet(ws.spark, path, None if there else T.StructType([]))
        return rows.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("dataset"), F.lit(there).alias("present"), "rows")
    return union_all([one(n) for n in PROBED])


@query("feed_presence")
def q_feed_presence(ws):
    """Which feeds and facts hold any row, from the footers of the stored tables."""
    rows = ws.from_footers(M.FEED_NAMES + M.FACT_NAMES)
    return ws.spark.createDataFrame([(n, "fact" if n in M.FACT_NAMES else "feed", rows[n][0] > 0) for n in M.FEED_NAMES + M.FACT_NAMES],
                                    "name string, kind string, present boolean")


@query("sink_roundtrip")
def q_sink_roundtrip(ws):
    """Write the product fact partitioned by month, read it back, aggregate."""
    spark = ws.spark
    path = IO.scratch_path(spark, "fact_product")
    IO.write_parquet(IO.with_month(ws.product_fact), path, "month", even=False)  # the stored fact comes by month
    back = IO.scan_parquet(spark, path)
    return back.groupBy(F.col("month").cast("string").alias("month")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("revenue").cast("double").alias("revenue"),
        F.sum("units").alias("units"))


@query("incremental_build")
def q_incremental_build(ws):
    """The facts built without the reference day, then refreshed with it: rows of each fact's months, and which the
    refresh rewrote."""
    spark, root = ws.spark, IO.scratch_path(ws.spark, "facts")
    feeds = {n: ws.feed(n) for names, _, _ in RF.FACTS.values() for n in names}
    RF.refresh(spark, {n: f.filter(RF.feed_day(f) != F.lit(REF)) for n, f in feeds.items()}, root)
    done = RF.refresh(spark, feeds, root)
    return union_all([RF.read_fact(spark, root, fact).groupBy(F.col(C.STORED_MONTH).alias("month")).agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(fact).alias("fact"), "month", "rows", F.coalesce(F.col("month").cast("string").isin(done[fact]), F.lit(False)).alias("rewritten")) for fact in RF.FACTS])


@query("source_coverage")
def q_source_coverage(ws):
    """Row count and presence of every feed and every fact, from the footers of the stored tables."""
    names = M.FEED_NAMES + ["orderbank", "fact", "fact_product", "fact_email", "fact_seo"]
    found = ws.from_footers(names)
    return ws.spark.createDataFrame([(n, found[n][0], found[n][0] > 0) for n in names], "feed string, rows bigint, present boolean")


PAGE_ITEMS = 1000


def order_pages(li, page_items: int = PAGE_ITEMS):
    """Line items -> nested order payloads of about ``page_items`` items.

    Lines of one price become one item with their number as quantity.  An order with
    more items than a page holds is spread by a hash of the price over as many pages
    as it needs, so no payload array grows with a huge order.

    Lines hardly repeat a price inside an order, so an order's lines go to one task as they are and every
    step stays there; none of the steps holds an order in memory."""
    items = li.repartition("order_id").groupBy("order_id", "gross_sales").agg(
        F.count(F.lit(1)).cast("int").alias("quantity"), F.sum("discounts").alias("disc"),
        F.sum("net_sales").alias("net"), F.min("created_at").alias("created_at"),
        F.min_by("customer_id", "created_at").alias("cid"), F.min_by("country", "created_at").alias("cc"))
    items = items.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("order_id")))
    pages = F.when((F.col("n") > page_items) & F.col("order_id").isNotNull(), F.ceil(F.col("n") / page_items))
    page = F.coalesce(F.pmod(F.xxhash64("gross_sales"), pages), F.lit(0)).cast("int")
    p = items.groupBy("order_id", page.alias("page")).agg(
        F.min("created_at").alias("created_at"), F.min_by("cid", "created_at").alias("cid"),
        F.min_by("cc", "created_at").alias("cc"),
        F.collect_list(F.struct(F.col("gross_sales").cast("string").alias("price"), "quantity"))
        .alias("line_items"),
        F.sum("disc").alias("disc"), F.sum("net").alias("net"))
    stamp = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")
    return p.select(F.col("order_id").alias("id"), stamp.alias("created_at"),
                    F.struct(F.col("cid").alias("id")).alias("customer"),
                    F.struct(F.col("cc").alias("country_code")).alias("shipping_address"),
                    "line_items", F.col("disc").cast("string").alias("total_discounts"),
                    F.struct(F.struct(F.lit("0.00").alias("amount")).alias("shop_money"))
                    .alias("total_shipping_price_set"),
                    F.col("net").cast("string").alias("total_price"), "page", stamp.alias("updated_at"))


def _payload(ws):
    """Orders as nested JSON payloads, landed under the scratch folder."""
    path = IO.scratch_path(ws.spark, "order_payload")
    order_pages(ws.line_items).write.mode("overwrite").json(path)
    return path


@query("orders_from_json")
def q_orders_from_json(ws):
    pages = IO.flatten_payload(IO.read_payload(ws.spark, _payload(ws)))
    flat = IO.merge_payload_pages(pages)
    return out(flat.withColumn("created_at", F.to_date("created_at")).withColumnRenamed(
        "created_at", "order_date"))


@query("orders_upsert_stream")
def q_orders_upsert_stream(ws):
    """The payloads as a stream of two deliveries of every page: a draft without its discount, then, later, the page
    as it stands; the draft of every seventh order comes last.  The stored orders are the corrected ones."""
    from tillroll.streaming.order_landing import current_orders, pages_stream, start_orders_upsert
    spark = ws.spark
    drawn = IO.scratch_path(spark, "pages")
    order_pages(ws.line_items).write.parquet(drawn)  # four deliveries are made from the pages
    pages = spark.read.parquet(drawn)
    late = F.col("id") % 7 == 0
    draft = pages.withColumn("total_discounts", F.lit("0.00"))
    final = pages.withColumn("updated_at", F.date_format(F.col("created_at").cast("timestamp") + F.expr("INTERVAL 40 DAYS"), "yyyy-MM-dd'T'HH:mm:ss"))
    land, path = IO.scratch_path(spark, "landing"), IO.scratch_path(spark, "order_pages")
    for first, last in ((draft, final), (final, draft)):
        first.filter(~late).unionByName(last.filter(late)).write.mode("append").json(land, compression="gzip")
        start_orders_upsert(pages_stream(spark, land), path).awaitTermination()
    return out(current_orders(spark, path).withColumn("created_at", F.to_date("created_at")).withColumnRenamed(
        "created_at", "order_date"))


@query("orders_recent_window")
def q_orders_recent_window(ws):
    o = IO.recent_window(ws.orders, dt.datetime.combine(REF, dt.time()), 120)
    return o.agg(F.count(F.lit(1)).alias("orders"), F.sum("net_sales").cast("double").alias("net_sales"),
                 F.min(F.to_date("created_at")).alias("first_day"),
                 F.max(F.to_date("created_at")).alias("last_day"))


@query("targets_ingest")
def q_targets_ingest(ws):
    """Targets through CSV: validate columns, type them, replace the dataset, summarise it."""
    spark = ws.spark
    path = IO.scratch_path(spark, "targets_csv")
    ws.targets.write.mode("overwrite").option("header", True).csv(path)
    raw = IO.read_targets(spark, path, "csv")
    ok, matched = IO.validate_targets(raw)
    t = IO.replace_targets(raw, IO.scratch_path(spark, "targets"))
    return t.agg(F.lit(ok).alias("valid"), F.lit(",".join(sorted(matched))).alias("matched"),
                 F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_day"),
                 F.max("date").alias("last_day"),
                 F.sum("target_revenue").cast("double").alias("target_revenue"),
                 F.sum("target_orders").cast("double").alias("target_orders"))


EXPORT_METRICS = ["revenue", "orders", "spend", "roas"]


@query("export_csv")
def q_export_csv(ws):
    """Data-table aggregate exported as CSV with display names and read back."""
    spark = ws.spark
    agg = C.aggregate(C.apply_filters(ws.fact, *CUR), ["marketing_channel"], EXPORT_METRICS)
    path = IO.scratch_path(spark, "export_csv")
    IO.export_csv(agg, path)
    schema = T.StructType([T.StructField(M.nice(f.name), f.dataType) for f in agg.schema.fields])
    return spark.read.option("header", True).schema(schema).csv(path)
