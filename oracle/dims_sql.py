"""Dimension rules written as plain SQL text (DuckDB dialect) for the oracle.

An independent restatement of the rules in ``tillroll.functions.dims``: same
fixed values (imported from the model), separate expression code.
"""
from __future__ import annotations

from tillroll import model as M

WS = "(' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))"


def q(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def inlist(vals) -> str:
    return "(" + ", ".join(q(v) for v in vals) + ")"


def norm(x: str) -> str:
    return f"lower(trim(coalesce(CAST({x} AS VARCHAR), ''), {WS}))"


def split_sm(x: str) -> tuple[str, str]:
    n = norm(x)
    src = (f"trim(CASE WHEN strpos({n}, '/') > 0 THEN substr({n}, 1, strpos({n}, '/') - 1) "
           f"ELSE {n} END, {WS})")
    med = f"(CASE WHEN strpos({n}, '/') > 0 THEN trim(substr({n}, strpos({n}, '/') + 1), {WS}) ELSE '' END)"
    return src, med


def _cat(s: str, cat: str) -> str:
    parts = [f"({s} = {q(m)} OR starts_with({s}, {q(m + '.')}) OR contains({s}, {q('.' + m)}))"
             for m in M.SOURCE_CATEGORIES[cat]]
    return "(" + " OR ".join(parts) + ")"


def channel(s: str, m: str) -> str:
    paid = f"regexp_full_match({m}, {q(M.PAID_MEDIUM_REGEX)})"
    se, so, sh, vi = (_cat(s, c) for c in ("search", "social", "shopping", "video"))
    return f"""(CASE
  WHEN {s} IN {inlist(M.DIRECT_SOURCES)} AND {m} IN {inlist(M.DIRECT_MEDIUMS)} THEN 'Direct'
  WHEN {se} AND {paid} THEN 'Paid Search'
  WHEN {sh} AND {paid} THEN 'Paid Shopping'
  WHEN {so} AND {paid} THEN 'Paid Social'
  WHEN {vi} AND {paid} THEN 'Paid Video'
  WHEN {m} IN {inlist(M.DISPLAY_MEDIUMS)} THEN 'Display'
  WHEN {paid} THEN 'Paid Other'
  WHEN {sh} THEN 'Organic Shopping'
  WHEN {so} OR {m} IN {inlist(M.SOCIAL_MEDIUMS)} THEN 'Organic Social'
  WHEN {vi} OR {m} = 'video' THEN 'Organic Video'
  WHEN {se} OR {m} = 'organic' THEN 'Organic Search'
  WHEN {m} IN {inlist(M.EMAIL_MEDIUMS)} OR contains({s}, 'email') OR contains({s}, 'klaviyo') THEN 'Email'
  WHEN {m} IN {inlist(M.AFFILIATE_MEDIUMS)} THEN 'Affiliates'
  WHEN {m} IN {inlist(M.REFERRAL_MEDIUMS)} THEN 'Referral'
  WHEN {s} = 'sms' OR {m} = 'sms' THEN 'SMS'
  ELSE {q(M.CHANNEL_FALLBACK)} END)"""


def channel_group(ch: str) -> str:
    return f"(CASE WHEN {ch} IN {inlist(M.PAID_CHANNELS)} THEN 'Paid' ELSE 'Unpaid' END)"


def platform(s: str, m: str) -> str:
    whens = " ".join(f"WHEN contains({s}, {q(c)}) AND {m} IN {inlist(meds)} THEN {q(p)}"
                     for c, meds, p in M.PLATFORM_RULES)
    return f"(CASE {whens} ELSE {q(M.PLATFORM_FALLBACK)} END)"


def prefix(x: str) -> str:
    v = f"coalesce(CAST({x} AS VARCHAR), '')"
    return f"(CASE WHEN strpos({v}, '_') > 0 THEN substr({v}, 1, strpos({v}, '_') - 1) ELSE {v} END)"


def campaign_type(name: str, ch: str, ptype: str | None = None) -> str:
    n = norm(name)
    gt = f"upper(coalesce(CAST({ptype} AS VARCHAR), ''))" if ptype else "''"
    return f"""(CASE WHEN {ch} = 'Paid Search' THEN
    (CASE WHEN contains({n}, 'brand') THEN 'Brand' WHEN {gt} IN {inlist(M.PMAX_TYPES)} THEN 'PMAX'
          WHEN {gt} IN {inlist(M.SEARCH_TYPES)} THEN 'Search' ELSE 'Other' END)
  WHEN {ch} = 'Paid Social' THEN
    (CASE WHEN contains({n}, 'tofu') THEN 'ToFu' WHEN contains({n}, 'mofu') OR contains({n}, 'bofu') THEN 'BoFu'
          ELSE 'Other' END)
  ELSE '(n/a)' END)"""


def device(x: str) -> str:
    n = norm(x)
    whens = " ".join(f"WHEN {n} = {q(k)} THEN {q(v)}" for k, v in M.DEVICE_MAP.items())
    return f"(CASE {whens} ELSE {q(M.DEVICE_FALLBACK)} END)"


def market_of(x: str) -> str:
    n = norm(x)
    whens = " ".join(f"WHEN {n} IN {inlist([i.lower() for i in ids])} THEN {q(mk)}"
                     for mk, ids in M.GEO_MARKETS.items())
    return f"(CASE {whens} ELSE NULL END)"


def geo_region(x: str) -> str:
    mk = market_of(x)
    eu = inlist([c.lower() for c in M.EUROPE_COUNTRIES])
    return (f"(CASE WHEN {mk} = 'US' THEN 'US' WHEN {mk} = 'UK' THEN 'UK' "
            f"WHEN {mk} IN ('FR','DE','IT','ES') THEN 'EU' WHEN {mk} IN ('CA','AU') THEN 'ROW' "
            f"WHEN {norm(x)} IN {eu} THEN 'EU' ELSE 'ROW' END)")


def geo_market(x: str) -> str:
    mk, rg = market_of(x), geo_region(x)
    return (f"(CASE WHEN {rg} = 'US' THEN 'US' WHEN {rg} = 'UK' THEN 'UK' "
            f"WHEN {rg} = 'EU' THEN (CASE WHEN {mk} IN ('FR','DE','IT','ES') THEN {mk} ELSE 'ROE' END) "
            f"ELSE (CASE WHEN {mk} IN ('CA','AU') THEN {mk} ELSE 'ROW' END) END)")


def country_name(x: str) -> str:
    mk = market_of(x)
    whens = " ".join(f"WHEN {mk} = {q(k)} THEN {q(ids[0])}" for k, ids in M.GEO_MARKETS.items())
    return f"coalesce((CASE {whens} ELSE NULL END), CAST({x} AS VARCHAR), '')"


def geo_cols(x: str) -> str:
    return (f"{geo_region(x)} AS geo_region, {geo_market(x)} AS geo_market, "
            f"{country_name(x)} AS geo_country")


# derived metric formulas with explicit zero guards, over a column naming function
FORMULAS = {
    "aov": "{revenue} / nullif({orders}, 0)",
    "gross_margin_pct": "{gross_profit} / nullif({revenue}, 0)",
    "discount_rate": "{discounts} / nullif({gross_sales}, 0)",
    "conversion_rate": "{orders} / nullif({visits}, 0)",
    "engagement_rate": "{engaged_visits} / nullif({visits}, 0)",
    "add_to_cart_rate": "{add_to_carts} / nullif({visits}, 0)",
    "checkout_rate": "{checkouts} / nullif({visits}, 0)",
    "checkout_completion_rate": "{orders} / nullif({checkouts}, 0)",
    "cart_abandonment_rate": "1.0 - {orders} / nullif({add_to_carts}, 0)",
    "roas": "{revenue} / nullif({spend}, 0)",
    "cost_per_order": "{spend} / nullif({orders}, 0)",
    "cost_per_visit": "{spend} / nullif({visits}, 0)",
    "cost_per_add_to_cart": "{spend} / nullif({add_to_carts}, 0)",
    "cost_per_checkout": "{spend} / nullif({checkouts}, 0)",
    "platform_roas": "{platform_conversion_value_7d} / nullif({spend}, 0)",
    "contribution": "{gross_profit} - {spend}",
    "contribution_margin": "({gross_profit} - {spend}) / nullif({revenue}, 0)",
    "mer": "{revenue} / nullif({spend}, 0)",
    "breakeven_roas": "{revenue} / nullif({gross_profit}, 0)",
    "ctr": "{clicks} / nullif({impressions}, 0)",
    "cpc": "{spend} / nullif({clicks}, 0)",
    "cpm": "1000.0 * {spend} / nullif({impressions}, 0)",
}


class _Cols(dict):
    def __init__(self, fn):
        super().__init__()
        self.fn = fn

    def __missing__(self, key):
        return self.fn(key)


def metric(m: str, col=lambda b: b) -> str:
    """SQL for metric m over base-sum columns named by ``col``."""
    if m in M.BASE_METRICS:
        return col(m)
    return "(" + FORMULAS[m].format_map(_Cols(lambda b: f"CAST({col(b)} AS DOUBLE)")) + ")"


def base_sum(b: str, cond: str | None = None, col: str | None = None) -> str:
    c = col or b
    inner = f"CASE WHEN {cond} THEN {c} END" if cond else c
    return f"CAST(coalesce(sum({inner}), 0) AS DOUBLE)"


def pct(cur: str, cmp: str) -> str:
    return f"(({cur}) / nullif({cmp}, 0) - 1.0) * 100.0"
