"""Oracle CTEs: the driver tables -> feeds, facts (DuckDB SQL).

``with_ctes(body, *names)`` prefixes a query with the CTEs it needs (and their
dependencies) in dependency order.
"""
from __future__ import annotations

from oracle import dims_sql as S
from tillroll.sources import fixtures as FXT

M2 = "DECIMAL(18,2)"


def _list(vals) -> str:
    return "[" + ", ".join("NULL" if v is None else S.q(v) for v in vals) + "]"


def pick(vals, idx: str) -> str:
    return f"({_list(vals)})[({idx}) + 1]"


REF = FXT.REF_DATE

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], sql: str):
    CTES[name] = (deps, sql)


cte("lines_base", [], f"""
SELECT l.l_orderkey AS order_id, o.o_orderdate AS created_at, o.o_custkey AS customer_id,
  {pick(FXT.COUNTRIES, 'c.c_nationkey')} AS country,
  CAST(l.l_partkey AS VARCHAR) AS product_id, p.p_name AS product_title,
  CASE WHEN p.p_type IN ('ECONOMY','STANDARD') THEN 'Moto' WHEN p.p_type = 'PROMO' THEN 'Snow' ELSE 'Other' END AS category_l1,
  p.p_type AS category, p.p_brand AS style, CAST(p.p_size AS VARCHAR) AS size,
  CAST(l.l_quantity AS BIGINT) AS quantity,
  CAST(l.l_extendedprice AS {M2}) AS gross_sales,
  CAST(round(CAST(l.l_extendedprice AS {M2}) * CAST(l.l_discount AS DECIMAL(4,2)), 2) AS {M2}) AS discounts,
  CAST(CAST(l.l_extendedprice AS {M2}) - CAST(round(CAST(l.l_extendedprice AS {M2}) * CAST(l.l_discount AS DECIMAL(4,2)), 2) AS {M2}) AS {M2}) AS net_sales,
  CAST(round(CAST(l.l_extendedprice AS {M2}) * 0.45, 2) AS {M2}) AS cogs,
  {pick(FXT.WAREHOUSES, 'l.l_suppkey % 3')} AS warehouse,
  l.l_suppkey, l.l_partkey, l.l_linenumber, l.l_returnflag, l.l_linestatus, l.l_shipdate,
  o.o_orderstatus, p.p_retailprice
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN part p ON l.l_partkey = p.p_partkey""")

cte("line_items", ["lines_base"], """
SELECT order_id, created_at, customer_id, country, product_id, product_title, category_l1,
  category, style, size, quantity, gross_sales, discounts, net_sales, cogs FROM lines_base""")

cte("shop_orders", ["line_items"], f"""
SELECT order_id, min(created_at) AS created_at, min_by(customer_id, created_at) AS customer_id,
  min_by(country, created_at) AS country,
  CAST(sum(gross_sales) AS {M2}) AS gross_sales, CAST(sum(discounts) AS {M2}) AS discounts,
  CAST(sum(net_sales) AS {M2}) AS net_sales, CAST(sum(cogs) AS {M2}) AS cogs,
  CAST(0 AS {M2}) AS shipping, CAST(round(sum(net_sales), 2) AS {M2}) AS total_price,
  'GBP' AS currency
FROM line_items GROUP BY order_id""")

cte("shop_returns", ["lines_base"], f"""
SELECT 'R' || CAST(order_id AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS return_id,
  order_id, CAST(l_shipdate AS DATE) AS date, product_id, category, country,
  CASE WHEN l_returnflag = 'R' THEN 'return' WHEN l_linestatus = 'F' THEN 'cancellation' ELSE 'exchange' END AS kind,
  quantity, net_sales AS value, {pick(FXT.RETURN_REASONS, 'l_suppkey % 7')} AS reason
FROM lines_base WHERE l_returnflag IN ('A', 'R')""")

cte("inventory", ["lines_base"], f"""
SELECT DISTINCT CAST(created_at AS DATE) AS date, product_id, warehouse,
  CAST((l_partkey * 7 + l_suppkey) % 120 AS BIGINT) AS on_hand,
  CAST((l_suppkey % 3) * 50 AS BIGINT) AS in_transit,
  CAST(round(CAST(p_retailprice AS {M2}) * 0.45, 2) AS {M2}) AS stock_value_per_unit
FROM lines_base""")

cte("traffic_items", ["lines_base"], """
SELECT CAST(created_at AS DATE) AS date, product_id, product_title, category,
  sum(quantity) * 20 AS item_views, sum(quantity) * 3 AS item_add_to_carts,
  sum(quantity) AS item_purchases
FROM lines_base WHERE o_orderstatus <> 'P' GROUP BY ALL""")

cte("orderbank", ["lines_base"], f"""
SELECT CAST(date_trunc('week', created_at) AS DATE) AS date, category_l1, warehouse,
  count(DISTINCT order_id) AS open_orders, sum(quantity) AS open_items,
  CAST(sum(net_sales) AS {M2}) AS open_value
FROM lines_base WHERE o_orderstatus = 'O' GROUP BY ALL""")

cte("targets", [], f"""
SELECT CAST(o_orderdate AS DATE) AS date, count(*) + 1 AS target_orders,
  CAST(round(sum(CAST(o_totalprice AS {M2})) * 0.9, 2) AS {M2}) AS target_revenue,
  CAST(round(CAST(round(sum(CAST(o_totalprice AS {M2})) * 0.9, 2) AS {M2}) * 0.4, 2) AS {M2}) AS target_gross_profit,
  CAST(50 AS {M2}) AS target_spend, CAST(600 AS BIGINT) AS target_visits,
  CAST(400 AS BIGINT) AS target_engaged_visits, CAST(80 AS BIGINT) AS target_add_to_carts,
  CAST(40 AS BIGINT) AS target_checkouts
FROM orders GROUP BY 1""")

cte("ev", [], f"""
SELECT event_id, user_id, event_type, value, k, d - {FXT.EVENT_SHIFT_A} AS date FROM
  (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(ts AS DATE) AS d FROM events)
UNION ALL
SELECT event_id, user_id, event_type, value, k, d - {FXT.EVENT_SHIFT_B} AS date FROM
  (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(ts AS DATE) AS d FROM events)
WHERE event_type <> 'error'""")


def _n(cond):
    return f"count(CASE WHEN {cond} THEN 1 END)"


def _v(cond):
    return f"CAST(coalesce(sum(CASE WHEN {cond} THEN CAST(value AS {M2}) END), 0) AS {M2})"


cte("traffic", ["ev"], f"""
SELECT strftime(date, '%Y%m%d') AS event_date,
  {pick(FXT.SOURCE_MEDIUMS, f'k % {len(FXT.SOURCE_MEDIUMS)}')} AS source_medium,
  {pick(FXT.SOCIAL_CAMPAIGNS, 'k // 25')} AS campaign,
  {pick(FXT.DEVICES, 'u % 4')} AS device,
  {pick(FXT.COUNTRIES, 'u % 25')} AS country,
  sessions, engaged_sessions, sessions_with_atc, sessions_with_checkout, purchases, purchase_revenue
FROM (SELECT date, k, user_id % 100 AS u, count(*) * 10 AS sessions,
        {_n("event_type <> 'error'")} * 8 AS engaged_sessions,
        {_n("event_type IN ('click','purchase')")} * 5 AS sessions_with_atc,
        {_n("event_type = 'purchase'")} * 3 AS sessions_with_checkout,
        {_n("event_type = 'purchase'")} AS purchases,
        {_v("event_type = 'purchase'")} AS purchase_revenue
      FROM ev GROUP BY date, k, user_id % 100)""")

cte("ads", ["ev"], f"""
SELECT date, k % 4 AS platform, (k // 4) % {len(FXT.SEARCH_CAMPAIGNS)} AS ci, {pick(FXT.COUNTRIES, 'user_id % 25')} AS country,
  CAST(sum(CAST(value AS {M2})) AS {M2}) AS spend, count(*) * 100 AS impressions, count(*) * 3 AS clicks,
  {_n("event_type = 'purchase'")} AS conv,
  CAST({_v("event_type = 'purchase'")} * 2 AS {M2}) AS conv_value,
  {_n("event_type = 'purchase' AND k < 50")} AS conv_1d,
  CAST({_v("event_type = 'purchase' AND k < 50")} * 2 AS {M2}) AS conv_value_1d,
  {_n("event_type = 'purchase'")} + {_n("event_type = 'signup'")} AS conv_28d,
  CAST({_v("event_type = 'purchase'")} * 2 + {_v("event_type = 'signup'")} AS {M2}) AS conv_value_28d,
  {_n("event_type = 'click'")} * 2 AS link_clicks, count(*) * 60 AS reach
FROM ev GROUP BY date, k % 4, (k // 4) % {len(FXT.SEARCH_CAMPAIGNS)}, user_id % 25""")

cte("meta", ["ads"], f"""
SELECT date, {pick(FXT.SOCIAL_CAMPAIGNS, 'ci % 4')} AS campaign_name, country, spend, impressions, clicks,
  link_clicks, reach, conv_1d AS purchase_1d, conv AS purchase_7d, conv_28d AS purchase_28d,
  conv_value_1d AS purchase_value_1d, conv_value AS purchase_value_7d, conv_value_28d AS purchase_value_28d
FROM ads WHERE platform = 0""")

for _name, _p in (("google", 1), ("microsoft", 2)):
    cte(_name, ["ads"], f"""
SELECT date, {pick(FXT.SEARCH_CAMPAIGNS, 'ci')} AS campaign_name,
  {pick(FXT.SEARCH_CAMPAIGN_TYPES, 'ci')} AS campaign_type, country, spend, impressions, clicks,
  conv AS conversions, conv_value AS conversions_value
FROM ads WHERE platform = {_p}""")

cte("tiktok", ["ads"], f"""
SELECT date, {pick(FXT.SOCIAL_CAMPAIGNS, 'ci % 4')} AS campaign_name, country, spend, impressions, clicks,
  conv AS conversions_7d, conv_value AS conversion_value_7d
FROM ads WHERE platform = 3""")

cte("email", ["ev"], f"""
SELECT date, {pick([n for _, n in FXT.EMAIL_SENDS], 'si')} AS name,
  {pick([t for t, _ in FXT.EMAIL_SENDS], 'si')} AS type, recipients, opens, clicks, orders, revenue
FROM (SELECT date, k % 6 AS si, count(*) * 40 AS recipients, count(*) * 12 AS opens,
        {_n("event_type = 'click'")} AS clicks, {_n("event_type = 'purchase'")} AS orders,
        {_v("event_type = 'purchase'")} AS revenue
      FROM ev GROUP BY date, k % 6)""")

cte("seo", ["ev"], f"""
SELECT date, {pick(FXT.SEO_QUERIES, 'qi')} AS query, qi < {FXT.SEO_BRANDED} AS branded, clicks, impressions,
  round(CAST(sv AS DOUBLE) / n, 6) AS position
FROM (SELECT date, k % 13 AS qi, count(*) * 25 AS impressions, {_n("event_type = 'click'")} * 2 AS clicks,
        sum(CAST(value AS {M2})) AS sv, count(*) AS n
      FROM ev GROUP BY date, k % 13)""")

# ── stacked fact ───────────────────────────────────────────────────────
_METRICS = ["orders", "revenue", "gross_sales", "discounts", "cogs", "gross_profit", "visits",
            "engaged_visits", "add_to_carts", "checkouts", "spend", "impressions", "clicks",
            "link_clicks", "reach", "platform_conversions_1d", "platform_conversions_7d",
            "platform_conversions_28d", "platform_conversion_value_1d",
            "platform_conversion_value_7d", "platform_conversion_value_28d"]
_MONEY = {"revenue", "gross_sales", "discounts", "cogs", "gross_profit", "spend",
          "platform_conversion_value_1d", "platform_conversion_value_7d",
          "platform_conversion_value_28d"}


def _lane(select_dims: str, metrics: dict[str, str], frm: str) -> str:
    ms = ", ".join(
        f"CAST({metrics.get(m, 'NULL')} AS {M2 if m in _MONEY else 'BIGINT'}) AS {m}" for m in _METRICS)
    return f"SELECT {select_dims}, {ms} FROM {frm}"


def _dims(date, source, group, channel, campaign, platform, ctype, country, device):
    return (f"CAST({date} AS DATE) AS date, {source} AS source, {group} AS marketing_channel_group, "
            f"{channel} AS marketing_channel, {campaign} AS marketing_campaign, "
            f"{platform} AS paid_ad_platform, {ctype} AS paid_campaign_type, {S.geo_cols(country)}, "
            f"{device} AS device")


NA = "'(n/a)'"
_shop = _lane(_dims("date", "'shopify'", NA, NA, NA, NA, NA, "country", NA),
              {"orders": "orders", "revenue": "round(revenue, 2)", "gross_sales": "round(gross_sales, 2)",
               "discounts": "round(discounts, 2)", "cogs": "round(cogs, 2)",
               "gross_profit": "round(revenue - cogs, 2)"},
              "(SELECT CAST(created_at AS DATE) AS date, country, count(DISTINCT order_id) AS orders, "
              "sum(net_sales) AS revenue, sum(gross_sales) AS gross_sales, sum(discounts) AS discounts, "
              "sum(cogs) AS cogs FROM shop_orders GROUP BY 1, 2)")
_SRC, _MED = S.split_sm("source_medium")
_ga4 = _lane(_dims("CASE WHEN length(event_date) = 8 THEN strptime(event_date, '%Y%m%d') ELSE try_cast(event_date AS DATE) END",
                   "'ga4'", S.channel_group("ch"), "ch",
                   "CASE WHEN pf = 'Meta' THEN " + S.prefix("camp") + " ELSE camp END",
                   "pf", S.campaign_type("camp", "ch"), "country", S.device("device")),
             {"visits": "sessions", "engaged_visits": "engaged_sessions",
              "add_to_carts": "sessions_with_atc", "checkouts": "sessions_with_checkout"},
             f"(SELECT *, {S.channel('s', 'm')} AS ch, {S.platform('s', 'm')} AS pf FROM "
             f"(SELECT *, {_SRC} AS s, {_MED} AS m, coalesce(campaign, '') AS camp FROM traffic))")


def _ad(source, channel, platform, prefix, frm, metrics, ptype=None):
    name = "coalesce(campaign_name, '')"
    camp = S.prefix(name) if prefix else name
    return _lane(_dims("date", S.q(source), "'Paid'", S.q(channel), camp, S.q(platform),
                       S.campaign_type(name, S.q(channel), ptype), "country", NA),
                 {"spend": "spend", "impressions": "impressions", "clicks": "clicks", **metrics}, frm)


_meta = _ad("meta", "Paid Social", "Meta", True, "meta", {
    "link_clicks": "link_clicks", "reach": "reach", "platform_conversions_1d": "purchase_1d",
    "platform_conversions_7d": "purchase_7d", "platform_conversions_28d": "purchase_28d",
    "platform_conversion_value_1d": "purchase_value_1d",
    "platform_conversion_value_7d": "purchase_value_7d",
    "platform_conversion_value_28d": "purchase_value_28d"})
_search = {"platform_conversions_7d": "conversions", "platform_conversion_value_7d": "conversions_value"}
_google = _ad("google_ads", "Paid Search", "Google", False, "google", _search, "campaign_type")
_ms = _ad("microsoft", "Paid Search", "Microsoft", False, "microsoft", _search, "campaign_type")
_tt = _ad("tiktok", "Paid Social", "Tiktok", True, "tiktok", {
    "platform_conversions_7d": "conversions_7d", "platform_conversion_value_7d": "conversion_value_7d"})

cte("fact", ["shop_orders", "traffic", "meta", "google", "microsoft", "tiktok"],
    "\nUNION ALL\n".join([_shop, _ga4, _meta, _google, _ms, _tt]))

cte("fact_product", ["line_items", "traffic_items", "inventory", "shop_returns"], f"""
SELECT b.*, it.product_views, it.product_add_to_carts, iv.on_hand, iv.stock_value, iv.in_transit,
  rt.returned_units, rt.refund_amount
FROM (SELECT CAST(created_at AS DATE) AS date, product_id, product_title, category_l1, category, style,
        sum(quantity) AS units, CAST(sum(net_sales) AS {M2}) AS revenue,
        CAST(sum(gross_sales) AS {M2}) AS gross_sales, CAST(sum(discounts) AS {M2}) AS discounts,
        CAST(sum(cogs) AS {M2}) AS cogs, CAST(round(sum(net_sales) - sum(cogs), 2) AS {M2}) AS gross_profit
      FROM line_items
      WHERE created_at IS NOT NULL AND product_id IS NOT NULL AND product_title IS NOT NULL
        AND category_l1 IS NOT NULL AND category IS NOT NULL AND style IS NOT NULL
      GROUP BY 1, 2, 3, 4, 5, 6) b
LEFT JOIN (SELECT date, product_id, sum(item_views) AS product_views,
             sum(item_add_to_carts) AS product_add_to_carts FROM traffic_items GROUP BY 1, 2) it
  ON b.date = it.date AND b.product_id = it.product_id
LEFT JOIN (SELECT date, product_id, sum(on_hand) AS on_hand,
             CAST(sum(on_hand * stock_value_per_unit) AS {M2}) AS stock_value,
             sum(in_transit) AS in_transit FROM inventory GROUP BY 1, 2) iv
  ON b.date = iv.date AND b.product_id = iv.product_id
LEFT JOIN (SELECT date, product_id, sum(quantity) AS returned_units,
             CAST(sum(value) AS {M2}) AS refund_amount FROM shop_returns WHERE kind = 'return'
           GROUP BY 1, 2) rt
  ON b.date = rt.date AND b.product_id = rt.product_id""")


def with_ctes(body: str, *names: str, local: tuple = ()) -> str:
    """``local`` is a sequence of (name, sql) CTEs appended after the shared ones."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    items = [(n, CTES[n][1]) for n in order] + list(local)
    if not items:
        return body
    parts = ",\n".join(f"{n} AS ({sql}\n)" for n, sql in items)
    return f"WITH {parts}\n{body}"
