"""Dimension rules: every channel branch, platforms, geo, campaigns, device, dates."""
import datetime as dt
import random
import re

from pyspark.sql import functions as F

from tillroll import model as M
from tillroll.functions import dims as D
from tillroll.sources.fixtures import SEARCH_CAMPAIGNS_BY_TYPE, SOURCE_MEDIUMS, TRAFFIC_BY_CHANNEL

def _eval(spark, values, fn, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_channel_every_branch(spark):
    got = _eval(spark, SOURCE_MEDIUMS, D.channel)
    assert got == [channel for channel, texts in TRAFFIC_BY_CHANNEL.items() for _ in texts]
    assert set(got) >= {"Direct", "Paid Search", "Paid Shopping", "Paid Social", "Paid Video",
                        "Display", "Paid Other", "Organic Shopping", "Organic Social",
                        "Organic Video", "Organic Search", "Email", "Affiliates", "Referral",
                        "SMS", "Unassigned"}


def test_search_campaigns_of_every_type(spark):
    cases = [(name, kind, want) for want, group in SEARCH_CAMPAIGNS_BY_TYPE.items() for name, kind in group]
    df = spark.createDataFrame(cases, "name string, kind string, want string")
    assert [r.got for r in df.select(D.campaign_type(F.col("name"), "Paid Search", F.col("kind")).alias("got")).collect()] == [c[2] for c in cases]


def test_fixture_strings_meet_every_platform_rule(spark):
    pairs = [tuple(part.strip() for part in text.split("/", 1)) for text in SOURCE_MEDIUMS if text.count("/") == 1]
    assert all(any(word in s and m in mediums for s, m in pairs) for word, mediums, _ in M.PLATFORM_RULES)
    assert set(_eval(spark, SOURCE_MEDIUMS, D.platform)) == {p for _, _, p in M.PLATFORM_RULES} | {M.PLATFORM_FALLBACK}


def test_channel_staged_equals_expression(spark):
    df = spark.createDataFrame([(v,) for v in SOURCE_MEDIUMS + [None, "  Google / CPC\t"]],
                               "source_medium string")
    staged = [r["marketing_channel"] for r in D.with_channel(df).collect()]
    inline = _eval(spark, SOURCE_MEDIUMS + [None, "  Google / CPC\t"], D.channel)
    assert staged == inline
    assert inline[-2:] == ["Unassigned", "Paid Search"]


def test_channel_group(spark):
    got = _eval(spark, ["Paid Search", "Display", "Cross-network", "Email", None], D.channel_group)
    assert got == ["Paid", "Paid", "Paid", "Unpaid", "Unpaid"]


def test_source_medium_split(spark):
    df = spark.createDataFrame([("a / b / c",), ("foo",), (None,), ("\tX /  Y ",)], "v string")
    s, m = D.source_medium("v")
    assert [tuple(r) for r in df.select(s, m).collect()] == [
        ("a", "b / c"), ("foo", ""), ("", ""), ("x", "y")]


def test_norm_strips_all_whitespace(spark):
    assert _eval(spark, ["\t A \n", None, "MiXeD"], D.norm) == ["a", "", "mixed"]


def _category_rule(s, cat):
    return any(s == m or s.startswith(m + ".") or ("." + m) in s for m in M.SOURCE_CATEGORIES[cat])


def test_category_regex_matches_rule():
    rnd = random.Random(3)
    members = [m for ms in M.SOURCE_CATEGORIES.values() for m in ms]
    pieces = members + ["", ".", "x", "com", "www", "news", "t", "co", "shop"]
    samples = {"".join(rnd.choice(pieces) + rnd.choice(["", ".", " ", "-"]) for _ in range(rnd.randint(1, 3)))
               for _ in range(3000)}
    for cat in M.SOURCE_CATEGORIES:
        rx = D.category_regex(cat).replace(r"\Q", "").replace(r"\E", "")
        # re-quote members for Python's engine
        alts = "|".join(re.escape(m) for m in M.SOURCE_CATEGORIES[cat])
        py = re.compile(rf"^(?:{alts})(?:\.|$)|\.(?:{alts})")
        assert rx  # Java pattern built
        for s in samples:
            assert bool(py.search(s)) == _category_rule(s, cat), (cat, s)


def test_category_regex_in_spark(spark):
    vals = ["google", "google.com", "www.google", "googleads", "x", "x.com", "box", "t.co",
            "t.com", "google shopping", "shopping.example"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    for cat in M.SOURCE_CATEGORIES:
        got = [r[0] for r in df.select(F.col("v").rlike(D.category_regex(cat))).collect()]
        assert got == [_category_rule(v, cat) for v in vals], cat


def test_platform_rules(spark):
    got = _eval(spark, ["bing / cpc", "microsoft / ppc", "google / ppc", "facebook / paid_social",
                        "fb / paid_social", "instagram / paid_social", "tiktok / paid_social",
                        "google / organic", "tiktok / cpc", None], D.platform)
    assert got == ["Microsoft", "Microsoft", "Google", "Meta", "Meta", "Meta", "Tiktok",
                   "(n/a)", "(n/a)", "(n/a)"]


def test_geo(spark):
    vals = ["GB", "United States", "us", " DE ", "France", "IE", "Australia", "CA", "IT", "Spain",
            "NO", "JP", "", None, "Vatican City", "XK"]
    df = spark.createDataFrame([(v,) for v in vals], "country string")
    got = [(r.geo_region, r.geo_market, r.geo_country) for r in D.with_geo(df).collect()]
    assert got == [
        ("UK", "UK", "United Kingdom"), ("US", "US", "United States"), ("US", "US", "United States"),
        ("EU", "DE", "Germany"), ("EU", "FR", "France"), ("EU", "ROE", "IE"),
        ("ROW", "AU", "Australia"), ("ROW", "CA", "Canada"), ("EU", "IT", "Italy"),
        ("EU", "ES", "Spain"), ("EU", "ROE", "NO"), ("ROW", "ROW", "JP"), ("ROW", "ROW", ""),
        ("ROW", "ROW", ""), ("EU", "ROE", "Vatican City"), ("EU", "ROE", "XK")]
    single = df.select(D.geo_region("country"), D.geo_market("country"), D.country_name("country"))
    assert [tuple(r) for r in single.collect()] == got


def test_campaign_prefix_and_type(spark):
    df = spark.createDataFrame(
        [("TOFU_Prospecting", "Paid Social", None), ("MOFU_x", "Paid Social", None),
         ("plain", "Paid Social", None), ("Brand_Search", "Paid Search", "SEARCH"),
         ("PMax_All", "Paid Search", "performance_max"), ("Generic", "Paid Search", "SEARCH"),
         ("Shop", "Paid Search", None), (None, "Email", None)],
        "name string, ch string, t string")
    got = [tuple(r) for r in df.select(D.campaign_prefix("name"),
                                       D.campaign_type(F.col("name"), F.col("ch"), F.col("t"))).collect()]
    assert got == [("TOFU", "ToFu"), ("MOFU", "BoFu"), ("plain", "Other"), ("Brand", "Brand"),
                   ("PMax", "PMAX"), ("Generic", "Search"), ("Shop", "Other"), ("", "(n/a)")]


def test_device(spark):
    assert _eval(spark, ["Desktop", " mobile", "TABLET", "smarttv", None], D.device) == [
        "Desktop", "Mobile", "Tablet", "Other", "Other"]


def test_compact_date_and_periods(spark):
    df = spark.createDataFrame([("19980302",), ("1998-03-02",), ("junk",)], "v string")
    assert [r[0] for r in df.select(D.compact_date("v")).collect()] == [
        dt.date(1998, 3, 2), dt.date(1998, 3, 2), None]
    d = spark.createDataFrame([(dt.date(1998, 1, 1),), (dt.date(1997, 12, 31),)], "d date")
    assert [tuple(r) for r in d.select(D.period_start("d", "W"), D.period_start("d", "M")).collect()] == [
        (dt.date(1997, 12, 29), dt.date(1998, 1, 1)), (dt.date(1997, 12, 29), dt.date(1997, 12, 1))]
    m = spark.createDataFrame([(dt.date(1998, 2, 1), dt.date(1997, 11, 30))], "a date, b date")
    assert m.select(D.month_diff("a", "b")).first()[0] == 3
