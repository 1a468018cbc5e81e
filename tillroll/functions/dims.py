"""Dimension derivation as pure Spark ``Column`` expressions.

Every rule of the semantic model (source/medium split, channel grouping, ad
platform, campaign naming, geography, device) is compiled once on the driver
into a ``CASE WHEN`` tree over built-in functions, so it runs inside
whole-stage codegen with no Python worker.  Rule lists come from
:mod:`tillroll.model`.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillroll import model as M

_WS = " \t\n\r\f\v"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _any(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def norm(c) -> Column:
    """null -> '', strip surrounding whitespace, lower-case."""
    return F.lower(F.btrim(F.coalesce(_c(c).cast("string"), F.lit("")), F.lit(_WS)))


def source_medium(c) -> tuple[Column, Column]:
    """Split a 'source / medium' string at the first '/', both sides trimmed.

    Without a slash the medium is ''."""
    parts = F.split(norm(c), "/", 2)
    src = F.btrim(F.get(parts, 0), F.lit(_WS))
    med = F.coalesce(F.btrim(F.get(parts, 1), F.lit(_WS)), F.lit(""))
    return src, med


# ── geography ────────────────────────────────────────────────────────────
def _named_market(n: Column) -> Column:
    """Normalised country identifier -> market code, null when unknown."""
    expr = None
    for market, idents in M.GEO_MARKETS.items():
        cond = n.isin([i.strip().lower() for i in idents])
        expr = F.when(cond, F.lit(market)) if expr is None else expr.when(cond, F.lit(market))
    return expr


def _is_europe(n: Column) -> Column:
    return n.isin([i.strip().lower() for i in M.EUROPE_COUNTRIES])


# one rule each, from the normalised identifier and its market
def _region(n: Column, m: Column) -> Column:
    return (F.when(m == "US", "US").when(m == "UK", "UK")
            .when(m.isin(M.EU_MARKETS), "EU").when(m.isin(M.ROW_MARKETS), "ROW")
            .when(_is_europe(n), "EU").otherwise("ROW"))


def _market(region: Column, m: Column) -> Column:
    return (F.when(region.isin("US", "UK"), region)
            .when(region == "EU", F.when(m.isin(M.EU_MARKETS), m).otherwise("ROE"))
            .otherwise(F.when(m.isin(M.ROW_MARKETS), m).otherwise("ROW")))


def _country(m: Column, raw: Column) -> Column:
    canonical = None
    for market, idents in M.GEO_MARKETS.items():
        canonical = (F.when(m == market, F.lit(idents[0])) if canonical is None
                     else canonical.when(m == market, F.lit(idents[0])))
    return F.coalesce(canonical, raw.cast("string"), F.lit(""))


def geo_region(c) -> Column:
    n = norm(c)
    return _region(n, _named_market(n))


def geo_market(c) -> Column:
    return _market(geo_region(c), _named_market(norm(c)))


def country_name(c) -> Column:
    """Canonical country name when the identifier is known, else the raw value."""
    return _country(_named_market(norm(c)), _c(c))


def geo_columns(c) -> dict[str, Column]:
    """Self-contained geo expressions (each re-derives the market)."""
    return {"geo_region": geo_region(c), "geo_market": geo_market(c),
            "geo_country": country_name(c)}


def with_geo(df, country: str = "country"):
    """Add ``geo_region/geo_market/geo_country`` in stages.

    The normalised identifier and the market are computed once as helper
    columns, keeping the generated code small (one CASE tree per stage)."""
    df = df.withColumn("_geo_n", norm(country))
    df = df.withColumn("_geo_m", _named_market(F.col("_geo_n")))
    df = df.withColumn("_geo_r", _region(F.col("_geo_n"), F.col("_geo_m")))
    return df.withColumns({
        "geo_region": F.col("_geo_r"),
        "geo_market": _market(F.col("_geo_r"), F.col("_geo_m")),
        "geo_country": _country(F.col("_geo_m"), F.col(country)),
    }).drop("_geo_n", "_geo_m", "_geo_r")


def geo_refs() -> dict[str, Column]:
    """References to the columns added by :func:`with_geo`."""
    return {n: F.col(n) for n in ("geo_region", "geo_market", "geo_country")}


# ── marketing channel ───────────────────────────────────────────────────
def category_regex(category: str) -> str:
    """One Java regex for "s = m, or s starts with m + '.', or s contains '.' + m"
    over every member m of a source category (members quoted literally)."""
    alts = "|".join(r"\Q" + m.strip().lower() + r"\E" for m in M.SOURCE_CATEGORIES[category])
    return rf"^(?:{alts})(?:\.|$)|\.(?:{alts})"


def _source_in_category(s: Column, category: str) -> Column:
    return s.rlike(category_regex(category))


def is_paid_medium(med: Column) -> Column:
    return med.rlike(M.PAID_MEDIUM_REGEX)


def channel_from_parts(s: Column, m: Column) -> Column:
    """Ordered first-match channel rules over normalised source and medium."""
    search = _source_in_category(s, "search")
    social = _source_in_category(s, "social")
    shopping = _source_in_category(s, "shopping")
    video = _source_in_category(s, "video")
    paid = is_paid_medium(m)
    return (
        F.when(s.isin(M.DIRECT_SOURCES) & m.isin(M.DIRECT_MEDIUMS), "Direct")
        .when(search & paid, "Paid Search")
        .when(shopping & paid, "Paid Shopping")
        .when(social & paid, "Paid Social")
        .when(video & paid, "Paid Video")
        .when(m.isin(M.DISPLAY_MEDIUMS), "Display")
        .when(paid, "Paid Other")
        .when(shopping, "Organic Shopping")
        .when(social | m.isin(M.SOCIAL_MEDIUMS), "Organic Social")
        .when(video | (m == "video"), "Organic Video")
        .when(search | (m == "organic"), "Organic Search")
        .when(m.isin(M.EMAIL_MEDIUMS) | _any([s.contains(w) for w in M.EMAIL_SOURCE_WORDS]),
              "Email")
        .when(m.isin(M.AFFILIATE_MEDIUMS), "Affiliates")
        .when(m.isin(M.REFERRAL_MEDIUMS), "Referral")
        .when((s == "sms") | (m == "sms"), "SMS")
        .otherwise(M.CHANNEL_FALLBACK)
    )


def channel(source_medium_col) -> Column:
    """Self-contained channel expression; prefer :func:`with_channel` on a frame."""
    s, m = source_medium(source_medium_col)
    return channel_from_parts(s, m)


def with_channel(df, sm_col: str = "source_medium"):
    """Add ``marketing_channel``, ``marketing_channel_group`` and
    ``paid_ad_platform``, parsing source/medium once into helper columns."""
    s, m = source_medium(sm_col)
    df = df.withColumns({"_sm_s": s, "_sm_m": m})
    ch = channel_from_parts(F.col("_sm_s"), F.col("_sm_m"))
    df = df.withColumns({"marketing_channel": ch,
                         "paid_ad_platform": platform_from_parts(F.col("_sm_s"), F.col("_sm_m"))})
    return df.withColumn("marketing_channel_group", channel_group("marketing_channel")) \
        .drop("_sm_s", "_sm_m")


def channel_group(channel_col) -> Column:
    return F.when(_c(channel_col).isin(M.PAID_CHANNELS), M.PAID_LABEL).otherwise(M.UNPAID_LABEL)


def platform_from_parts(s: Column, m: Column) -> Column:
    expr = None
    for contains, mediums, platform in M.PLATFORM_RULES:
        cond = s.contains(contains.strip().lower()) & m.isin([x.strip().lower() for x in mediums])
        expr = F.when(cond, platform) if expr is None else expr.when(cond, platform)
    return expr.otherwise(M.PLATFORM_FALLBACK)


def platform(source_medium_col) -> Column:
    s, m = source_medium(source_medium_col)
    return platform_from_parts(s, m)


# ── campaigns ────────────────────────────────────────────────────────────
def campaign_prefix(c) -> Column:
    """Text before the first '_' (whole string when there is none); null -> ''."""
    return F.substring_index(F.coalesce(_c(c).cast("string"), F.lit("")), "_", 1)


def campaign_type(name, channel_col, platform_type=None) -> Column:
    """Campaign type; ``channel_col`` is a Column or a literal channel label."""
    n = norm(name)
    ch = F.lit(channel_col) if isinstance(channel_col, str) else channel_col
    gt = F.upper(F.coalesce(_c(platform_type).cast("string"), F.lit(""))) \
        if platform_type is not None else F.lit("")
    search_branch = (F.when(n.contains(M.BRAND_KEYWORD), "Brand")
                     .when(gt.isin(M.PMAX_TYPES), "PMAX")
                     .when(gt.isin(M.SEARCH_TYPES), "Search")
                     .otherwise(M.PAID_SEARCH_OTHER))
    social_branch = (F.when(n.contains(M.TOFU_KEYWORD), "ToFu")
                     .when(_any([n.contains(k) for k in M.BOFU_KEYWORDS]), "BoFu")
                     .otherwise(M.PAID_SOCIAL_OTHER))
    if isinstance(channel_col, str):      # literal channel: pick the branch on the driver
        return {"Paid Search": search_branch, "Paid Social": social_branch}.get(
            channel_col, F.lit(M.NA))
    return (F.when(ch == "Paid Search", search_branch)
            .when(ch == "Paid Social", social_branch)
            .otherwise(M.NA))


def device(c) -> Column:
    n = norm(c)
    expr = None
    for k, v in M.DEVICE_MAP.items():
        expr = F.when(n == k, v) if expr is None else expr.when(n == k, v)
    return expr.otherwise(M.DEVICE_FALLBACK)


# ── dates ────────────────────────────────────────────────────────────────
def compact_date(c) -> Column:
    """'YYYYMMDD' -> date; any other text is parsed as an ISO date (null if not)."""
    s = _c(c).cast("string")
    return F.when(F.length(s) == 8, F.try_to_date(s, "yyyyMMdd")).otherwise(F.try_to_date(s))


def period_start(date_col, freq: str) -> Column:
    """Bucket a day to its period start: D (day), W (Monday), M (month)."""
    d = _c(date_col)
    if freq == "D":
        return d.cast("date")
    if freq == "W":
        return F.to_date(F.date_trunc("week", d))
    if freq == "M":
        return F.to_date(F.date_trunc("month", d))
    raise ValueError(f"unknown frequency {freq!r}")


def month_diff(later, earlier) -> Column:
    """(y2 - y1) * 12 + (m2 - m1) between two dates."""
    a, b = _c(later), _c(earlier)
    return (F.year(a) - F.year(b)) * 12 + (F.month(a) - F.month(b))


def branded_label(c) -> Column:
    return F.when(_c(c), "Branded").otherwise("Non-branded")
