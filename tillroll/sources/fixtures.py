"""Adapters: the driver's TPC-H-like tables -> the commerce feeds.

Each feed is a deterministic projection of the given tables (see FIXTURES.md
section 2), written as DataFrame transformations so that its size, and the
work of every report built on it, grows with the input tables.  Money is cast
to ``decimal`` before any arithmetic so sums are exact.

Small fixed lookups (25 countries, 25 source/medium strings, ...) are literal
arrays indexed by a key expression: no join, no shuffle.
"""
from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators.compare import STORED_MONTH
from tillroll.operators.facts import DEALT, key_portions, portion_count

MONEY = "decimal(18,2)"

# ---------------------------------------------------------------------------
# FIXED VALUES of the test adapters (FIXTURES.md section 2)
# ---------------------------------------------------------------------------
COUNTRIES = ["GB", "United States", "us", " DE ", "France", "IE", "Australia", "CA", "IT",
             "Spain", "NO", "Poland", "JP", "Brazil", "USA", "United Kingdom", "UK",
             "Germany", "FR", "XK", "NZ", "IN", "", "Vatican City", None]
#: traffic strings by the channel whose rule each must meet (first match wins), some of them at the
#: edge of two rules: a subdomain, a paid medium at a source without category, a display medium at a
#: video source, a string without or with a second slash
TRAFFIC_BY_CHANNEL = {
    "Direct": ["direct / none", "(direct) / (not set)"],
    "Paid Search": ["bing / ppc", "google.co.uk / cpc", "ecosia / paidsearch"],
    "Paid Shopping": ["ebay / cpc", "shopping.example / ppc"],
    "Paid Social": ["pinterest / paid", "reddit / cpc", "m.facebook.com / paid_social",
                    "instagram.com / paid_social", "fb / paid_social", "tiktok.com / paid_social"],
    "Paid Video": ["dailymotion / cpv", "twitch / cpm"],
    "Display": ["outdoorclub / interstitial", "trailmap / cpm"],
    "Paid Other": ["microsoft / cpc", "slopeweekly / retargeting"],
    "Organic Shopping": ["ebay.de / referral"],
    "Organic Social": ["reddit / link", "bikeforum / sm", "www.pinterest.com / referral"],
    "Organic Video": ["twitch / referral", "campervlog / video"],
    "Organic Search": ["qwant / referral", "metasearch / organic", "search.brave / web"],
    "Email": ["spring-letter / e-mail", "klaviyo / flow"],
    "Affiliates": ["dealfinder / affiliates"],
    "Referral": ["slopeguide.example / link", "partnershop / app"],
    "SMS": ["textline / sms", "sms / reminder"],
    "Unassigned": ["(unknown)", "qr-code / flyer / window"],
}
SOURCE_MEDIUMS = [text for texts in TRAFFIC_BY_CHANNEL.values() for text in texts]
DEVICES = ["mobile", "Desktop", "tablet", "smarttv"]
SOCIAL_CAMPAIGNS = ["Harbour_tofu_video", "Harbour_bofu_basket", "Lantern_mofu_stories",
                    "Lantern"]
#: (name, platform type) by the campaign type that the rules must give
SEARCH_CAMPAIGNS_BY_TYPE = {
    "Other": [("Clearance shelf", "DISPLAY"), ("Winter demand", "DEMAND_GEN"), ("untyped trial", None)],
    "Search": [("helmets near me", "search"), ("base layers, long tail", "SEARCH")],
    "Brand": [("Branded waterproofs", "PERFORMANCE_MAX"), ("rival brandnames", None)],
    "PMAX": [("Gloves, all regions", "Performance_Max")],
}
SEARCH_CAMPAIGNS = [name for group in SEARCH_CAMPAIGNS_BY_TYPE.values() for name, _ in group]
SEARCH_CAMPAIGN_TYPES = [kind for group in SEARCH_CAMPAIGNS_BY_TYPE.values() for _, kind in group]
WAREHOUSES = ["UK", "EU", "US"]
EMAIL_SENDS = [("campaign", "Monday picks"), ("flow", "Size guide"), ("flow", "Birthday"),
               ("campaign", "Autumn lookbook"), ("flow", "Loyalty tier reached"),
               ("flow", "Restocked item")]
SEO_QUERIES = ["tillroll", "tillroll boots", "tillroll sale", "waterproof jacket",
               "ski gloves", "motorcycle helmet", "thermal base layer", "snow goggles",
               "riding boots", "winter coat mens", "heated gloves", "rain trousers",
               "neck warmer"]
SEO_BRANDED = 3
RETURN_REASONS = ["zip broke", "colour differs", "ordered two sizes", "gift not wanted",
                  "parcel damaged", "stitching loose", "no reason given"]
EVENT_SHIFT_A = 9464      # days: 2024-01-01 -> 1998-02-02 (whole weeks)
EVENT_SHIFT_B = 9828      # days: 364 more, copy B, which has no error events
REF_DATE = "1998-03-03"   # last day of copy A; the reports' "today" in tests
TARGET_CONSTANTS = {"target_spend": 50, "target_visits": 600, "target_engaged_visits": 400,
                    "target_add_to_carts": 80, "target_checkouts": 40}
# ---------------------------------------------------------------------------


#: (rows, their day, their product) -> the rows dealt over tasks, with the columns ``DEALT``
Deal = Callable[[DataFrame, Column, Column], DataFrame]


def dealt_columns(df: DataFrame) -> list[str]:
    return [c for c in DEALT if c in df.columns]


def pick(values: list, index: Column) -> Column:
    """values[index] for a 0-based integer index column (null when out of range)."""
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), index.cast("int"))


def money(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(MONEY)


def dec_round(c: Column) -> Column:
    return F.round(c, 2).cast(MONEY)


class DriverFeeds:
    """Lazily builds every feed from the parquet tables in ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str, store=None):
        """``store(name, build)`` may persist the expensive shared inputs
        (the line-item join and the shifted events); default: lazy plans."""
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}
        self._store = store

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _memo(self, key, build, stored: bool = False):
        if key not in self._cache:
            self._cache[key] = (self._store(key, build) if stored and self._store is not None
                                else build())
        return self._cache[key]

    # ── shop ──────────────────────────────────────────────────────────────
    def lines_raw(self) -> DataFrame:
        """The joined line items with source columns alone, as the joins leave them: what is stored of the lines.

        Customers meet the orders, not the lines, and orders come last: where the joins sort, an order's
        lines end up side by side.  Where they are stored, many lines are joined in portions by order."""
        def build():
            li = self.table("lineitem").select(
                "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("quantity"),
                money("l_extendedprice").alias("gross_sales"), F.col("l_discount").cast("decimal(4,2)").alias("l_discount"),
                "l_returnflag", "l_linestatus", "l_shipdate")
            o = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate",
                                            "o_orderstatus")
            c = self.table("customer").select("c_custkey", "c_nationkey")
            p = self.table("part").select("p_partkey", "p_name", "p_type", "p_brand",
                                          "p_size", "p_retailprice")
            n = portion_count(li.count()) if self._store is not None else 1
            joined = [join(*lo, c, p) for lo in zip(key_portions(li, "l_orderkey", n), key_portions(o, "o_orderkey", n), strict=True)]
            return joined[0] if n == 1 else joined

        def join(li, o, c, p):
            j = (li.join(p, F.col("l_partkey") == p.p_partkey)
                 .join(o.join(c, F.col("o_custkey") == c.c_custkey), li.l_orderkey == o.o_orderkey))
            return j.select(
                F.col("l_orderkey").alias("order_id"),
                F.col("o_orderdate").alias("created_at"),
                F.col("o_custkey").alias("customer_id"),
                "c_nationkey", "p_name", "p_type", "p_brand", "p_size", "quantity", "gross_sales", "l_discount",
                "l_suppkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus",
                "l_shipdate", "o_orderstatus", "p_retailprice",
            )
        return self._memo("lines_base", build, stored=True)

    def lines_base(self, deal: Deal | None = None) -> DataFrame:
        """Line items with the helper columns other adapters need.

        ``deal`` may distribute the narrow stored rows over tasks before columns are derived from them;
        columns of ``DEALT`` that it adds stay."""
        b = self.lines_raw() if deal is None else deal(self.lines_raw(), F.to_date("created_at"), F.col("l_partkey").cast("string"))
        gross = F.col("gross_sales")
        discounts = dec_round(gross * F.col("l_discount"))
        return b.select(
            "order_id", "created_at", "customer_id",
            pick(COUNTRIES, F.col("c_nationkey")).alias("country"),
            F.col("l_partkey").cast("string").alias("product_id"),
            F.col("p_name").alias("product_title"),
            F.when(F.col("p_type").isin("ECONOMY", "STANDARD"), "Moto")
             .when(F.col("p_type") == "PROMO", "Snow").otherwise("Other").alias("category_l1"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("style"),
            F.col("p_size").cast("string").alias("size"),
            F.concat_ws("-", F.col("l_partkey").cast("string"),
                        F.col("p_size").cast("string")).alias("sku"),
            "quantity", "gross_sales",
            discounts.alias("discounts"),
            (gross - discounts).cast(MONEY).alias("net_sales"),
            dec_round(gross * F.lit(Decimal("0.45"))).alias("cogs"),
            pick(WAREHOUSES, F.col("l_suppkey") % 3).alias("warehouse"),
            "l_suppkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus",
            "l_shipdate", "o_orderstatus", "p_retailprice", *dealt_columns(b), *[c for c in [STORED_MONTH] if c in b.columns],
        )

    LINE_ITEM_COLUMNS = ["order_id", "created_at", "customer_id", "country", "product_id",
                         "product_title", "category_l1", "category", "style", "size", "sku",
                         "quantity", "gross_sales", "discounts", "net_sales", "cogs"]

    def line_items(self, deal: Deal | None = None) -> DataFrame:
        b = self.lines_base(deal)
        return b.select(*self.LINE_ITEM_COLUMNS, *dealt_columns(b), *[c for c in [STORED_MONTH] if c in b.columns])

    def orders(self) -> DataFrame:
        from tillroll.operators.facts import orders_from_lines
        return self._memo("orders", lambda: orders_from_lines(self.line_items()))

    def returns(self) -> DataFrame:
        b = self.lines_base().filter(F.col("l_returnflag").isin("A", "R"))
        kind = (F.when(F.col("l_returnflag") == "R", "return")
                .when(F.col("l_linestatus") == "F", "cancellation").otherwise("exchange"))
        return b.select(
            F.concat(F.lit("R"), F.col("order_id").cast("string"), F.lit("-"),
                     F.col("l_linenumber").cast("string")).alias("return_id"),
            "order_id", F.to_date("l_shipdate").alias("date"), "product_id", "category",
            "country", kind.alias("kind"), "quantity", F.col("net_sales").alias("value"),
            pick(RETURN_REASONS, F.col("l_suppkey") % 7).alias("reason"))

    def inventory(self, deal: Deal | None = None) -> DataFrame:
        b = self.lines_base(deal)
        return b.select(
            *dealt_columns(b),
            F.to_date("created_at").alias("date"), "product_id", "warehouse",
            ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 120).cast("bigint").alias("on_hand"),
            ((F.col("l_suppkey") % 3) * 50).cast("bigint").alias("in_transit"),
            dec_round(money("p_retailprice") * F.lit(Decimal("0.45"))).alias("stock_value_per_unit"),
        ).distinct()

    def traffic_items(self, deal: Deal | None = None) -> DataFrame:
        """Item traffic of each day; orders still in progress ('P') have none yet, so some
        products of the product fact meet no row of this feed."""
        b = self.lines_base(deal).filter(F.col("o_orderstatus") != "P")
        return (b.groupBy(*dealt_columns(b), F.to_date("created_at").alias("date"), "product_id",
                          "product_title", "category")
                .agg((F.sum("quantity") * 20).alias("item_views"),
                     (F.sum("quantity") * 3).alias("item_add_to_carts"),
                     F.sum("quantity").alias("item_purchases")))

    def orderbank(self) -> DataFrame:
        b = self.lines_base().filter(F.col("o_orderstatus") == "O")
        return (b.groupBy(F.to_date(F.date_trunc("week", "created_at")).alias("date"),
                          "category_l1", "warehouse")
                .agg(F.countDistinct("order_id").alias("open_orders"),
                     F.sum("quantity").alias("open_items"),
                     F.sum("net_sales").cast(MONEY).alias("open_value")))

    def targets(self) -> DataFrame:
        o = self.table("orders")
        g = o.groupBy(F.to_date("o_orderdate").alias("date")).agg(
            (F.count(F.lit(1)) + 1).alias("target_orders"),
            dec_round(F.sum(money("o_totalprice")) * F.lit(Decimal("0.9"))).alias("target_revenue"))
        cols = [F.col("date"), F.col("target_orders"), F.col("target_revenue"),
                dec_round(F.col("target_revenue") * F.lit(Decimal("0.4"))).alias("target_gross_profit")]
        for name, v in TARGET_CONSTANTS.items():
            cols.append((F.lit(v).cast(MONEY) if name == "target_spend"
                         else F.lit(v).cast("bigint")).alias(name))
        return g.select(*cols)

    # ── events-derived feeds ──────────────────────────────────────────────
    def ev(self) -> DataFrame:
        """Events shifted into the orders' calendar: all of them (copy A), and 364 days earlier
        those that are no errors (copy B, the year to compare with)."""
        def build():
            e = self.table("events").select(
                "event_id", "ts", "user_id", "event_type", "value",
                F.get_json_object("props", "$.k").cast("int").alias("k"))
            day = F.to_date("ts")
            a = e.withColumn("date", F.date_sub(day, EVENT_SHIFT_A))
            b = e.filter(F.col("event_type") != "error").withColumn("date", F.date_sub(day, EVENT_SHIFT_B))
            return a.unionByName(b)
        return self._memo("ev", build, stored=True)

    @staticmethod
    def _n(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    @staticmethod
    def _v(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, money("value"))), F.lit(0).cast(MONEY)).cast(MONEY)

    def traffic(self) -> DataFrame:
        return self._memo("traffic", self._traffic, stored=True)

    def _traffic(self) -> DataFrame:
        e = self.ev()
        et = F.col("event_type")
        g = e.groupBy("date", "k", (F.col("user_id") % 100).alias("u")).agg(
            (F.count(F.lit(1)) * 10).alias("sessions"),
            (self._n(et != "error") * 8).alias("engaged_sessions"),
            (self._n(et.isin("click", "purchase")) * 5).alias("sessions_with_atc"),
            (self._n(et == "purchase") * 3).alias("sessions_with_checkout"),
            self._n(et == "purchase").alias("purchases"),
            self._v(et == "purchase").alias("purchase_revenue"))
        return g.select(
            F.date_format("date", "yyyyMMdd").alias("event_date"),
            pick(SOURCE_MEDIUMS, F.col("k") % len(SOURCE_MEDIUMS)).alias("source_medium"),
            pick(SOCIAL_CAMPAIGNS, F.floor(F.col("k") / 25)).alias("campaign"),
            pick(DEVICES, F.col("u") % 4).alias("device"),
            pick(COUNTRIES, F.col("u") % 25).alias("country"),
            "sessions", "engaged_sessions", "sessions_with_atc", "sessions_with_checkout",
            "purchases", "purchase_revenue")

    def ads(self) -> DataFrame:
        """All four ad platforms aggregated in one pass (day x platform x campaign x country)."""
        def build():
            e = self.ev()
            et = F.col("event_type")
            purchase = et == "purchase"
            g = e.groupBy("date", (F.col("k") % 4).alias("platform"),
                          (F.floor(F.col("k") / 4) % len(SEARCH_CAMPAIGNS)).alias("ci"),
                          (F.col("user_id") % 25).alias("ui")).agg(
                F.sum(money("value")).cast(MONEY).alias("spend"),
                (F.count(F.lit(1)) * 100).alias("impressions"),
                (F.count(F.lit(1)) * 3).alias("clicks"),
                self._n(purchase).alias("conv"),
                (self._v(purchase) * 2).cast(MONEY).alias("conv_value"),
                self._n(purchase & (F.col("k") < 50)).alias("conv_1d"),
                (self._v(purchase & (F.col("k") < 50)) * 2).cast(MONEY).alias("conv_value_1d"),
                (self._n(purchase) + self._n(et == "signup")).alias("conv_28d"),
                (self._v(purchase) * 2 + self._v(et == "signup")).cast(MONEY).alias("conv_value_28d"),
                (self._n(et == "click") * 2).alias("link_clicks"),
                (F.count(F.lit(1)) * 60).alias("reach"))
            return g.withColumn("country", pick(COUNTRIES, F.col("ui")))
        return self._memo("ads", build, stored=True)

    def _ads(self, platform: int) -> DataFrame:
        # every platform filters the same aggregate, so the shuffle is planned once and reused
        return self.ads().filter(F.col("platform") == platform)

    def meta(self) -> DataFrame:
        g = self._ads(0)
        return g.select("date", pick(SOCIAL_CAMPAIGNS, F.col("ci") % 4).alias("campaign_name"),
                        "country", "spend", "impressions", "clicks", "link_clicks", "reach",
                        F.col("conv_1d").alias("purchase_1d"), F.col("conv").alias("purchase_7d"),
                        F.col("conv_28d").alias("purchase_28d"),
                        F.col("conv_value_1d").alias("purchase_value_1d"),
                        F.col("conv_value").alias("purchase_value_7d"),
                        F.col("conv_value_28d").alias("purchase_value_28d"))

    def _search_ads(self, platform: int) -> DataFrame:
        g = self._ads(platform)
        return g.select("date", pick(SEARCH_CAMPAIGNS, F.col("ci")).alias("campaign_name"),
                        pick(SEARCH_CAMPAIGN_TYPES, F.col("ci")).alias("campaign_type"),
                        "country", "spend", "impressions", "clicks",
                        F.col("conv").alias("conversions"),
                        F.col("conv_value").alias("conversions_value"))

    def google(self) -> DataFrame:
        return self._search_ads(1)

    def microsoft(self) -> DataFrame:
        return self._search_ads(2)

    def tiktok(self) -> DataFrame:
        g = self._ads(3)
        return g.select("date", pick(SOCIAL_CAMPAIGNS, F.col("ci") % 4).alias("campaign_name"),
                        "country", "spend", "impressions", "clicks",
                        F.col("conv").alias("conversions_7d"),
                        F.col("conv_value").alias("conversion_value_7d"))

    def email(self) -> DataFrame:
        e = self.ev()
        et = F.col("event_type")
        g = e.groupBy("date", (F.col("k") % 6).alias("si")).agg(
            (F.count(F.lit(1)) * 40).alias("recipients"),
            (F.count(F.lit(1)) * 12).alias("opens"),
            self._n(et == "click").alias("clicks"),
            self._n(et == "purchase").alias("orders"),
            self._v(et == "purchase").alias("revenue"))
        return g.select("date", pick([n for _, n in EMAIL_SENDS], F.col("si")).alias("name"),
                        pick([t for t, _ in EMAIL_SENDS], F.col("si")).alias("type"),
                        "recipients", "opens", "clicks", "orders", "revenue")

    def seo(self) -> DataFrame:
        e = self.ev()
        g = e.groupBy("date", (F.col("k") % 13).alias("qi")).agg(
            (F.count(F.lit(1)) * 25).alias("impressions"),
            (self._n(F.col("event_type") == "click") * 2).alias("clicks"),
            F.sum(money("value")).alias("sv"), F.count(F.lit(1)).alias("n"))
        return g.select("date", pick(SEO_QUERIES, F.col("qi")).alias("query"),
                        (F.col("qi") < SEO_BRANDED).alias("branded"), "clicks", "impressions",
                        F.round(F.col("sv").cast("double") / F.col("n"), 6).alias("position"))

    def feeds(self) -> dict[str, DataFrame]:
        """All feeds by name (lazy DataFrames)."""
        return {"orders": self.orders(), "line_items": self.line_items(),
                "inventory": self.inventory(), "returns": self.returns(),
                "traffic": self.traffic(), "traffic_items": self.traffic_items(),
                "meta": self.meta(), "google": self.google(), "microsoft": self.microsoft(),
                "tiktok": self.tiktok(), "email": self.email(), "seo": self.seo(),
                "orderbank": self.orderbank(), "targets": self.targets()}
