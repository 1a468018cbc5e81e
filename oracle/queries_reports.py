"""Oracle SQL (DuckDB) for the report, fact and source/sink queries."""
from __future__ import annotations

import datetime as dt

from oracle import dims_sql as S
from oracle.feeds_sql import with_ctes
from oracle.queries import BASES, SQL, agg_sql, between, kpi_query, kpi_sql, reg, trend_sql
from tillroll import model as M
from tillroll.catalog import CUR, LY, REF
from tillroll.functions import periods as P


SUMMARY = M.KPI_GROUPS["Overview Metrics"] + M.KPI_GROUPS["Funnel Metrics"]
REVERSE = S.inlist([m for m in M.ALL_METRICS if M.metric_polarity(m) == "reverse"])
PCT_METRICS = S.inlist([m for m in M.ALL_METRICS if M.metric_format(m) == "percent"])


def D(d) -> str:
    return f"DATE '{d}'"


def dsum(c, cond=None) -> str:
    inner = f"CASE WHEN {cond} THEN {c} END" if cond else c
    return f"CAST(coalesce(sum({inner}), 0) AS DOUBLE)"


def ratio(a, b) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def exact_avg(c, cond=None) -> str:
    d = f"CAST({c} AS DECIMAL(38,9))"
    if cond:
        d = f"CASE WHEN {cond} THEN {d} END"
    return f"(CAST(sum({d}) AS DOUBLE) / nullif(CAST(count({d}) AS DOUBLE), 0))"


def long_rows(frm: str, specs) -> str:
    parts = []
    for name, cur, cmp in specs:
        c = cmp if cmp is not None else "NULL"
        parts.append(f"SELECT '{name}' AS metric, CAST({cur} AS DOUBLE) AS value, "
                     f"CAST({c} AS DOUBLE) AS cmp, {S.pct(f'CAST({cur} AS DOUBLE)', f'CAST({c} AS DOUBLE)')} "
                     f"AS delta_pct FROM {frm}")
    return "\nUNION ALL\n".join(parts)


def kpi(metrics, cur, cmp, with_cmp=True, extra_ctes=("targets",)):
    body, local = kpi_sql(metrics, cur, cmp, "TRUE", with_cmp)
    return body, local


def kpi_wrapped(select: str, metrics, cur, cmp, with_cmp=True, tail: str = "") -> str:
    body, local = kpi_sql(metrics, cur, cmp, "TRUE", with_cmp)
    return with_ctes(f"SELECT {select} FROM ({body}) x {tail}", "fact", "targets", local=local)


CUR_C, CMP_C = between(CUR), between(LY)

# ── periods, KPIs, targets, trends ─────────────────────────────────────
# the selectors stated in SQL, from the reference day alone
_R = D(REF)
_unit = lambda u, at=_R: f"CAST(date_trunc('{u}', {at}) AS DATE)"
PERIOD_SQL = {"Yesterday": (_R, _R)}
for _n in (7, 30, 90):
    PERIOD_SQL[f"Last {_n} Days"] = (f"({_R} - {_n - 1})", _R)
for _u in ("week", "month", "quarter", "year"):
    PERIOD_SQL[f"{_u.title()} to Date"] = (_unit(_u), _R)
    PERIOD_SQL[f"Last {_u.title()}"] = (_unit(_u, f"{_unit(_u)} - 1"), f"({_unit(_u)} - 1)")
_prow = ", ".join(
    f"('{n}', 'current', {a}, {b}), ('{n}', 'last_year', {a} - 364, {b} - 364), "
    f"('{n}', 'prior', {a} - CAST(1 + ({b} - {a}) AS INTEGER), {a} - 1)" for n, (a, b) in PERIOD_SQL.items())
_pm = ["revenue", "orders", "visits", "conversion_rate"]
reg("period_totals", f"""SELECT period, side, {', '.join(f'{S.metric(m)} AS {m}' for m in _pm)} FROM
 (SELECT p.period, p.side, {', '.join(f'{S.base_sum("f." + b)} AS {b}' for b in BASES)}
  FROM (VALUES {_prow}) p(period, side, s, e) LEFT JOIN fact f ON f.date BETWEEN p.s AND p.e
  GROUP BY p.period, p.side)""", "fact")

# custom ranges, stated as dates
_ranges = ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in [
    ("inside", "1997-11-05", "1998-02-14"), ("from before", "1980-01-01", "1996-07-04"), ("to after", "1998-01-20", "2031-05-06"),
    ("one day", "1998-03-03", "1998-03-03"), ("before all", "1970-01-01", "1971-01-01"), ("after all", "2040-01-01", "2041-01-01"),
    ("turned round", "1998-03-03", "1998-02-01"), ("everything", "1900-01-01", "2100-01-01")])
reg("range_totals", f"""SELECT label, {', '.join(f'{S.metric(m)} AS {m}' for m in M.ALL_METRICS)} FROM
 (SELECT r.label, {', '.join(f'{S.base_sum("f." + b)} AS {b}' for b in BASES)}
  FROM (VALUES {_ranges}) r(label, s, e) LEFT JOIN fact f ON f.date BETWEEN r.s AND r.e
  GROUP BY r.label)""", "fact")

_explored = [["geo_market"], ["marketing_channel_group", "device"], ["source", "geo_region"],
             ["source", "marketing_channel_group", "marketing_channel", "paid_ad_platform", "paid_campaign_type",
              "geo_region", "geo_market", "device"]]
reg("explorer_lattice", "\nUNION ALL\n".join(
    f"SELECT '{'+'.join(d)}' AS dims, concat_ws('|', {', '.join(d)}) AS key, {', '.join(M.ALL_METRICS)} FROM "
    f"({agg_sql(d, M.ALL_METRICS, 'fact', between(CUR))})" for d in _explored), "fact")

_lo = "(SELECT min(date) FROM fact)"
_hi = "(SELECT max(date) FROM fact)"
_custom = (f"greatest({_lo}, least({_hi}, DATE '1998-01-20'))",
           f"greatest({_lo}, least({_hi}, DATE '2003-12-31'))")


def _between_expr(r):
    return f"date BETWEEN {r[0]} AND {r[1]}"


def _kpi_custom():
    import oracle.queries as Q
    orig = Q.between
    Q.between = lambda r, col="date": _between_expr(r) if isinstance(r[0], str) and r[0].startswith("greatest") else orig(r, col)
    try:
        body, local = kpi_sql(SUMMARY, _custom, None, "TRUE", False)
    finally:
        Q.between = orig
    return with_ctes(body, "fact", "targets", local=local)


SQL["kpi_custom_range"] = _kpi_custom()


def _good(col):
    return (f"CASE WHEN {col} IS NULL THEN NULL WHEN metric IN {REVERSE} THEN NOT ({col} >= 0) "
            f"ELSE {col} >= 0 END")


SQL["kpi_favourability"] = kpi_wrapped(
    f"*, {_good('delta_pct')} AS good_vs_cmp, {_good('vtarg_pct')} AS good_vs_target", SUMMARY, CUR, LY)

_du_body, _du_local = kpi_sql(SUMMARY + ["spend", "roas"], CUR, LY, "TRUE", True)
SQL["kpi_delta_units"] = with_ctes(
    f"SELECT metric, value, cmp, CASE WHEN metric IN {PCT_METRICS} THEN (value - cmp) * 100.0 "
    f"ELSE value - cmp END AS delta_units FROM ({_du_body}) x", "fact", "targets", local=_du_local)

# a week is shorter than ten days: the trailing thirty, by day
reg("sparkline", trend_sql("revenue", "D", f"date BETWEEN {_R} - 29 AND {_R}"), "fact")


def _tcol(b):
    for tc, m in M.TARGET_COLUMNS.items():
        if m == b:
            return tc
    return None


_tg = ("tg", "SELECT " + ", ".join(f"CAST(coalesce(sum({tc}), 0) AS DOUBLE) AS t_{m}"
                                   for tc, m in M.TARGET_COLUMNS.items())
       + f" FROM targets WHERE {CUR_C}")
SQL["target_direct"] = with_ctes("\nUNION ALL\n".join(
    f"SELECT '{b}' AS metric, CAST({('t_' + b) if _tcol(b) else 'NULL'} AS DOUBLE) AS target FROM tg"
    for b in BASES), "targets", local=(_tg,))


def _implied(m):
    ins = [b for b in BASES if "{" + b + "}" in S.FORMULAS[m]]
    return S.metric(m, lambda b: f"t_{b}") if all(_tcol(b) for b in ins) else "NULL"


SQL["target_implied"] = with_ctes("\nUNION ALL\n".join(
    f"SELECT '{m}' AS metric, CAST({_implied(m)} AS DOUBLE) AS target FROM tg"
    for m in M.DERIVED_METRICS), "targets", local=(_tg,))



def ty_ly(period: str, unit: str, more: str = "") -> str:
    lo, hi = PERIOD_SQL[period]
    bucket = f"CAST(date_trunc('{unit}', date) AS DATE)"

    def side(shift):
        return (f"SELECT {bucket} AS period, {dsum('revenue')} AS v FROM fact "
                f"WHERE date BETWEEN {lo} - {shift} AND {hi} - {shift} GROUP BY 1")
    whole = f"WHERE {hi} - period + 1 >= 7" if unit == "week" else ""
    ranked = "CAST(row_number() OVER (ORDER BY period) AS INTEGER) AS pos"
    return (f"SELECT ty.pos, ty.period, ty.v AS ty, ly.v AS ly{more} FROM "
            f"(SELECT period, v, {ranked} FROM ({side(0)}) {whole}) ty LEFT JOIN "
            f"(SELECT v, {ranked} FROM ({side(364)})) ly ON ty.pos = ly.pos")


reg("trend_ty_ly", ty_ly("Year to Date", "week"), "fact")
reg("trend_presets", "\nUNION ALL\n".join(
    ty_ly(p, {"Weekly": "week", "Daily": "day"}[f], f", '{p} ({f})' AS preset") for p, f in [
        ("Year to Date", "Weekly"), ("Last Quarter", "Weekly"), ("Last 90 Days", "Weekly"),
        ("Month to Date", "Daily"), ("Last 30 Days", "Daily"), ("Last Month", "Daily"),
        ("Last Week", "Daily"), ("Last 7 Days", "Daily")]), "fact")

# ── profitability / forecast / digest ───────────────────────────────────
_wf = [("Gross Sales", "gross_sales"), ("Less: Discounts", "-discounts"),
       ("Less: Cancellations", "-canc"), ("Less: Returns", "-ret"),
       ("Net Revenue", "(revenue - canc - ret)"), ("Less: COGS", "-cogs"),
       ("Gross Profit", "((revenue - canc - ret) - cogs)"), ("Less: Marketing", "-spend"),
       ("Contribution (CM2)", "(((revenue - canc - ret) - cogs) - spend)")]
SQL["finance_waterfall"] = with_ctes("\nUNION ALL\n".join(
    f"SELECT {i + 1} AS step, '{label}' AS line, {expr} AS amount FROM fa, ra"
    for i, (label, expr) in enumerate(_wf)), "fact", "shop_returns", local=(
    ("fa", "SELECT " + ", ".join(f"{dsum(c)} AS {c}" for c in
                                 ["gross_sales", "discounts", "revenue", "cogs", "spend"])
     + f" FROM fact WHERE {CUR_C}"),
    ("ra", f"SELECT {dsum('value', "kind = 'cancellation'")} AS canc, {dsum('value', "kind = 'return'")} AS ret "
           f"FROM shop_returns WHERE {CUR_C}")))

SQL["perf_vs_budget"] = kpi_wrapped(
    "metric, value AS actual, target AS budget, vtarg_pct AS v_budget, cmp AS ly, delta_pct AS v_ly",
    M.BUDGET_METRICS, CUR, P.ly_range(*CUR))

_ms = REF.replace(day=1)
_me = REF.replace(day=P.days_in_month(REF))
_rr_body, _rr_local = kpi_sql(M.RUN_RATE_METRICS, (_ms, REF), None, "TRUE", False)
_rr_t = ("tgm", "SELECT " + ", ".join(f"CAST(coalesce(sum({tc}), 0) AS DOUBLE) AS t_{m}"
                                      for tc, m in M.TARGET_COLUMNS.items())
         + f" FROM targets WHERE {between((_ms, _me))}")
_tm = " ".join(f"WHEN '{m}' THEN {'t_' + m if _tcol(m) else 'NULL'}" for m in M.RUN_RATE_METRICS)
SQL["run_rate"] = with_ctes(f"""
SELECT metric, value AS mtd_actual, value / {float(REF.day)!r} * {float(P.days_in_month(REF))!r} AS projected,
  t AS month_budget,
  CASE WHEN t <> 0 THEN {S.pct(f'value / {float(REF.day)!r} * {float(P.days_in_month(REF))!r}', 't')} END AS projected_vs_budget
FROM (SELECT x.metric, x.value, CAST(CASE x.metric {_tm} END AS DOUBLE) AS t FROM ({_rr_body}) x, tgm)""",
    "fact", "targets", local=_rr_local + (_rr_t,))

_order = lambda ms: "CASE metric " + " ".join(f"WHEN '{m}' THEN {i + 1}" for i, m in enumerate(ms)) + " END"
SQL["top_movers"] = kpi_wrapped(
    f"metric, value, delta_pct, {_good('delta_pct')} AS good", M.MOVER_METRICS, CUR, LY,
    tail=f"WHERE delta_pct IS NOT NULL ORDER BY abs(delta_pct) DESC, {_order(M.MOVER_METRICS)} LIMIT 4")
SQL["biggest_move"] = kpi_wrapped(
    "metric, delta_pct", M.BIGGEST_MOVE_METRICS, CUR, LY,
    tail=f"WHERE delta_pct IS NOT NULL ORDER BY abs(delta_pct) DESC, {_order(M.BIGGEST_MOVE_METRICS)} LIMIT 1")

_bm = []
for _m, _b in M.BENCHMARKS.items():
    _gap = S.pct(_m, repr(float(_b)) + "::DOUBLE")
    if M.metric_polarity(_m) == "reverse":
        _gap = f"-({_gap})"
    _bm.append(f"SELECT '{_m}' AS metric, CAST({_m} AS DOUBLE) AS actual, {float(_b)!r}::DOUBLE AS benchmark, "
               f"{_gap} AS gap_pct FROM bt")
SQL["benchmarks"] = with_ctes("\nUNION ALL\n".join(_bm), "fact", local=(
    ("bt", agg_sql([], list(M.BENCHMARKS), "fact", CUR_C)),))

reg("data_trust", """SELECT CASE WHEN GROUPING_ID(source) = 1 THEN '(all)' ELSE source END AS source,
  count(*) AS rows, max(date) AS data_through FROM fact GROUP BY ROLLUP (source)""", "fact")

_paid = "paid_ad_platform <> '(n/a)'"
SQL["roas_extremes"] = with_ctes(f"""
SELECT 'lowest' AS extreme, platform, roas FROM
  (SELECT paid_ad_platform AS platform, roas FROM g ORDER BY roas ASC, paid_ad_platform ASC LIMIT 1)
UNION ALL
SELECT 'highest' AS extreme, platform, roas FROM
  (SELECT paid_ad_platform AS platform, roas FROM g ORDER BY roas DESC, paid_ad_platform DESC LIMIT 1)""", "fact",
    local=(("g", f"""SELECT paid_ad_platform, {dsum('platform_conversion_value_7d')} / greatest({dsum('spend')}, 1.0) AS roas
           FROM fact WHERE {CUR_C} AND {_paid} GROUP BY 1"""),))

# ── customers ─────────────────────────────────────────────────────────
_od = "CAST(created_at AS DATE)"
_oc, _op = between(CUR, _od), between(LY, _od)
_k = "customer_id IS NOT NULL"
SQL["customer_kpis"] = with_ctes(long_rows("g", [
    ("customers", "custs", "CASE WHEN orders_cmp > 0 THEN custs_cmp END"),
    ("new_customers", "new", "CASE WHEN orders_cmp > 0 THEN new_cmp END"),
    ("repeat_rate", ratio("custs - new", "custs"), f"CASE WHEN orders_cmp > 0 THEN {ratio('custs_cmp - new_cmp', 'custs_cmp')} END"),
    ("orders_per_customer", ratio("orders", "custs"), f"CASE WHEN orders_cmp > 0 THEN {ratio('orders_cmp', 'custs_cmp')} END"),
    ("aov", ratio("revenue", "orders"), f"CASE WHEN orders_cmp > 0 THEN {ratio('revenue_cmp', 'orders_cmp')} END"),
    ("avg_ltv", "ltv", None),
    ("cac", ratio("spend", "new"), f"CASE WHEN orders_cmp > 0 THEN {ratio('spend_cmp', 'new_cmp')} END"),
    ("ltv_cac", f"ltv / nullif({ratio('spend', 'new')}, 0)", None)]),
    "shop_orders", "fact", local=(
        ("per", f"""SELECT customer_id, min({_od}) AS first, count(CASE WHEN {_oc} THEN 1 END) AS n_cur,
  count(CASE WHEN {_op} THEN 1 END) AS n_cmp, sum(CASE WHEN {_oc} THEN net_sales END) AS rev_cur,
  sum(CASE WHEN {_op} THEN net_sales END) AS rev_cmp, sum(net_sales) AS ltv FROM shop_orders GROUP BY customer_id"""),
        ("g", f"""SELECT count(CASE WHEN {_k} AND n_cur > 0 THEN 1 END) AS custs,
  count(CASE WHEN {_k} AND n_cur > 0 AND first BETWEEN {D(CUR[0])} AND {D(CUR[1])} THEN 1 END) AS new,
  sum(n_cur) AS orders, {dsum('rev_cur')} AS revenue,
  count(CASE WHEN {_k} AND n_cmp > 0 THEN 1 END) AS custs_cmp,
  count(CASE WHEN {_k} AND n_cmp > 0 AND first BETWEEN {D(LY[0])} AND {D(LY[1])} THEN 1 END) AS new_cmp,
  sum(n_cmp) AS orders_cmp, {dsum('rev_cmp')} AS revenue_cmp,
  CAST(sum(CASE WHEN {_k} THEN ltv END) AS DOUBLE) / nullif(CAST(count(CASE WHEN {_k} THEN 1 END) AS DOUBLE), 0) AS ltv,
  (SELECT {dsum('spend')} FROM fact WHERE {CUR_C}) AS spend,
  (SELECT {dsum('spend')} FROM fact WHERE {CMP_C}) AS spend_cmp
FROM per""")))

SQL["new_vs_returning"] = with_ctes(f"""
SELECT week, {dsum('net_cur', "cohort = 'new'")} AS new, {dsum('net_cur', "cohort = 'returning'")} AS returning
FROM (SELECT *, CASE WHEN first BETWEEN {D(CUR[0])} AND {D(CUR[1])} THEN 'new' ELSE 'returning' END AS cohort
      FROM (SELECT *, CASE WHEN customer_id IS NOT NULL THEN min(first_in_week) OVER (PARTITION BY customer_id) END AS first
            FROM (SELECT customer_id, CAST(date_trunc('week', d) AS DATE) AS week, min(d) AS first_in_week,
                    count(CASE WHEN d BETWEEN {D(CUR[0])} AND {D(CUR[1])} THEN 1 END) AS n_cur,
                    sum(CASE WHEN d BETWEEN {D(CUR[0])} AND {D(CUR[1])} THEN net_sales END) AS net_cur
                  FROM (SELECT *, {_od} AS d FROM shop_orders) GROUP BY 1, 2))
      WHERE n_cur > 0)
GROUP BY week""", "shop_orders")

_cohort_ctes = (
    ("om", "SELECT DISTINCT customer_id, CAST(date_trunc('month', created_at) AS DATE) AS month "
           "FROM shop_orders WHERE customer_id IS NOT NULL"),
    ("cm", "SELECT customer_id, min(month) AS cohort FROM om GROUP BY 1"),
    ("cg", "SELECT cm.cohort, CAST((year(om.month) - year(cm.cohort)) * 12 + (month(om.month) - month(cm.cohort)) AS INTEGER) "
           "AS months_since, count(*) AS customers FROM om JOIN cm USING (customer_id) GROUP BY 1, 2"),
    ("sz", "SELECT cohort, customers AS cohort_size FROM cg WHERE months_since = 0"),
    ("ret", "SELECT cg.cohort, cg.months_since, cg.customers, sz.cohort_size, "
            "round(cg.customers / sz.cohort_size * 100.0, 0) AS pct FROM cg JOIN sz USING (cohort) "
            "WHERE cg.cohort >= (SELECT min(cohort) FROM (SELECT DISTINCT cohort FROM cg ORDER BY cohort DESC LIMIT 12))"),
)
SQL["cohort_retention"] = with_ctes("SELECT * FROM ret", "shop_orders", local=_cohort_ctes)
SQL["cohort_matrix"] = with_ctes(
    "SELECT cohort, months_since, pct FROM ret", "shop_orders", local=_cohort_ctes)

reg("email_performance", f"""
SELECT CASE WHEN gid = 3 THEN 'Total' ELSE type END AS type, CASE WHEN gid = 3 THEN '' ELSE name END AS name,
  CAST(recipients AS BIGINT) AS recipients, CAST(orders AS BIGINT) AS orders, revenue,
  {ratio('revenue', 'recipients')} AS rev_per_recipient,
  CAST(row_number() OVER (ORDER BY gid, revenue DESC, type, name) AS INTEGER) AS pos,
  CASE WHEN gid = 3 THEN {S.pct('revenue', 'CASE WHEN n_cmp > 0 THEN revenue_cmp END')} END AS revenue_vs_cmp
FROM (SELECT type, name, GROUPING_ID(type, name) AS gid, count(CASE WHEN {CUR_C} THEN 1 END) AS n_cur,
        count(CASE WHEN {CMP_C} THEN 1 END) AS n_cmp, {dsum('recipients', CUR_C)} AS recipients,
        {dsum('orders', CUR_C)} AS orders, {dsum('revenue', CUR_C)} AS revenue,
        {dsum('revenue', CMP_C)} AS revenue_cmp
      FROM email WHERE {CUR_C} OR {CMP_C} GROUP BY ROLLUP (type, name))
WHERE n_cur > 0 AND gid IN (0, 3)""", "email")

# ── product ───────────────────────────────────────────────────────────
_PS = {"units": "units", "revenue": "revenue", "gross_sales": "gross_sales", "discounts": "discounts",
       "gross_profit": "gross_profit", "views": "product_views", "atc": "product_add_to_carts",
       "returned": "returned_units", "refund": "refund_amount"}


def _pa(cur, cmp):
    cc = between(cur)
    pc = between(cmp) if cmp else "FALSE"
    cols = [f"count(CASE WHEN {cc} THEN 1 END) AS n_cur", f"count(CASE WHEN {pc} THEN 1 END) AS n_cmp"]
    for o, c in _PS.items():
        cols += [f"{dsum(c, cc)} AS {o}", f"{dsum(c, pc)} AS {o}_cmp"]
    for side, cond in (("", cc), ("_cmp", pc)):
        cols.append(f"CAST(coalesce(arg_max(on_hand, date) FILTER (WHERE {cond} AND on_hand IS NOT NULL), 0) AS DOUBLE) AS on_hand{side}")
    keep = f"{cc} OR {pc}"
    return f"SELECT product_id, product_title, category, {', '.join(cols)} FROM fact_product WHERE {keep} GROUP BY 1, 2, 3"


_pt = ("pt", f"SELECT product_id, product_title, category, {', '.join(_PS)}, on_hand FROM ({_pa(CUR, None)}) WHERE n_cur > 0")
SQL["product_agg"] = with_ctes("SELECT * FROM pt", "fact_product", local=(_pt,))

SQL["product_kpis"] = with_ctes(long_rows("g", [
    ("revenue", "revenue", "CASE WHEN n_cmp > 0 THEN revenue_cmp END"),
    ("units", "units", None), ("asp", ratio("revenue", "units"), None),
    ("gross_margin", ratio("gross_profit", "revenue"), f"CASE WHEN n_cmp > 0 THEN {ratio('gross_profit_cmp', 'revenue_cmp')} END"),
    ("discount_pct", ratio("discounts", "gross_sales"), f"CASE WHEN n_cmp > 0 THEN {ratio('discounts_cmp', 'gross_sales_cmp')} END")]),
    "fact_product", local=(("g", "SELECT count(CASE WHEN " + CMP_C + " THEN 1 END) AS n_cmp, "
                            + ", ".join(f"{dsum(c, CUR_C)} AS {c}" for c in ["revenue", "units", "gross_sales", "discounts", "gross_profit"])
                            + ", " + ", ".join(f"{dsum(c, CMP_C)} AS {c}_cmp" for c in ["revenue", "gross_sales", "discounts", "gross_profit"])
                            + f" FROM fact_product WHERE {CUR_C} OR {CMP_C}"),))

reg("category_table", f"""
SELECT CASE WHEN gid = 1 THEN 'Total' ELSE category END AS category, revenue, CAST(units AS BIGINT) AS units,
  {ratio('revenue', 'units')} AS asp, {ratio('discounts', 'gross_sales')} AS disc_pct,
  {ratio('gross_profit', 'revenue')} AS gm_pct, gross_profit AS gm,
  {S.pct('revenue', 'CASE WHEN n_cmp > 0 THEN revenue_cmp END')} AS revenue_vs_cmp,
  {S.pct(ratio('gross_profit', 'revenue'), f"CASE WHEN n_cmp > 0 THEN {ratio('gross_profit_cmp', 'revenue_cmp')} END")} AS gm_pct_vs_cmp
FROM (SELECT category, GROUPING_ID(category) AS gid, count(CASE WHEN {CUR_C} THEN 1 END) AS n_cur,
        count(CASE WHEN {CMP_C} THEN 1 END) AS n_cmp,
        {', '.join(f'{dsum(c, CUR_C)} AS {c}' for c in ['revenue', 'units', 'gross_sales', 'discounts', 'gross_profit'])},
        {dsum('revenue', CMP_C)} AS revenue_cmp, {dsum('gross_profit', CMP_C)} AS gross_profit_cmp
      FROM fact_product WHERE {CUR_C} OR {CMP_C} GROUP BY ROLLUP (category))
WHERE n_cur > 0""", "fact_product")

_conv_cmp = f"CASE WHEN n_cmp > 0 THEN {ratio('units_cmp', 'views_cmp')} END"
SQL["product_funnel_top20"] = with_ctes(f"""
SELECT * FROM (SELECT product_id, product_title, views, atc, units, {ratio('atc', 'views')} AS atc_rate,
  {ratio('units', 'views')} AS conv_rate, {S.pct(ratio('units', 'views'), _conv_cmp)} AS conv_vs_cmp
  FROM pa WHERE n_cur > 0 ORDER BY views DESC, product_id LIMIT 20)
UNION ALL
SELECT NULL, 'Total', views, atc, units, {ratio('atc', 'views')}, {ratio('units', 'views')},
  {S.pct(ratio('units', 'views'), _conv_cmp)}
FROM (SELECT {dsum('views', 'n_cur > 0')} AS views, {dsum('atc', 'n_cur > 0')} AS atc,
        {dsum('units', 'n_cur > 0')} AS units, {dsum('views_cmp', 'n_cmp > 0')} AS views_cmp,
        {dsum('units_cmp', 'n_cmp > 0')} AS units_cmp, count(CASE WHEN n_cmp > 0 THEN 1 END) AS n_cmp FROM pa)""",
    "fact_product", local=(("pa", _pa(CUR, LY)),))

_weeks = max(1.0, ((CUR[1] - CUR[0]).days + 1) / 7)
_cover = f"(on_hand / nullif(units / {_weeks!r}::DOUBLE, 0))"
SQL["stock_health"] = with_ctes(long_rows("g", [
    ("availability", "availability", "availability_cmp"), ("avg_weeks_cover", "awc", None),
    ("out_of_stock", "oos", None)]), "fact_product", local=(
    ("pa", _pa(CUR, LY)),
    ("g", f"""SELECT avg(CASE WHEN n_cur > 0 THEN (CASE WHEN on_hand > 0 THEN 1.0 ELSE 0.0 END) END) AS availability,
  avg(CASE WHEN n_cmp > 0 THEN (CASE WHEN on_hand_cmp > 0 THEN 1.0 ELSE 0.0 END) END) AS availability_cmp,
  {exact_avg(_cover, 'n_cur > 0')} AS awc, count(CASE WHEN n_cur > 0 AND on_hand <= 0 THEN 1 END) AS oos FROM pa""")))

SQL["low_stock_top20"] = with_ctes(f"""
SELECT * FROM (SELECT product_id, product_title, category, on_hand, wc AS weeks_cover FROM
  (SELECT *, {_cover} AS wc FROM pt) WHERE wc <= 3.0 OR on_hand <= 0
  ORDER BY wc ASC NULLS LAST, product_id LIMIT 20)
UNION ALL
SELECT NULL, 'Total', '', sum(on_hand), NULL FROM pt""", "fact_product", local=(_pt,))

SQL["return_rates"] = with_ctes(long_rows("g", [
    ("return_rate_items", ratio("r", "u"), f"CASE WHEN n_cmp > 0 THEN {ratio('r_cmp', 'u_cmp')} END"),
    ("return_rate_value", ratio("ref", "rev"), None), ("refunds", "ref", None)]), "fact_product", local=(
    ("g", f"""SELECT count(CASE WHEN {CMP_C} THEN 1 END) AS n_cmp, {dsum('units', CUR_C)} AS u,
  {dsum('returned_units', CUR_C)} AS r, {dsum('revenue', CUR_C)} AS rev, {dsum('refund_amount', CUR_C)} AS ref,
  {dsum('units', CMP_C)} AS u_cmp, {dsum('returned_units', CMP_C)} AS r_cmp
  FROM fact_product WHERE {CUR_C} OR {CMP_C}"""),))

SQL["worst_returns_top15"] = with_ctes(f"""
SELECT * FROM (SELECT product_id, product_title, category, units, returned, {ratio('returned', 'units')} AS return_rate
  FROM pt WHERE returned > 0 ORDER BY return_rate DESC NULLS LAST, product_id LIMIT 15)
UNION ALL
SELECT NULL, 'Total', '', sum(units), sum(returned), {ratio('sum(returned)', 'sum(units)')} FROM pt""",
    "fact_product", local=(_pt,))

reg("return_reasons", f"SELECT reason, count(*) AS returns FROM shop_returns WHERE {CUR_C} GROUP BY reason",
    "shop_returns")

# ── paid / seo ───────────────────────────────────────────────────────
SQL["paid_kpis"] = with_ctes(long_rows("g", [
    ("spend", "spend", "sc"),
    ("blended_mer", ratio("rev", "spend"), "CASE WHEN n_cmp > 0 THEN rev_cmp / nullif(sc, 0) END"),
    ("blended_cac", ratio("spend", "orders"), "CASE WHEN n_cmp > 0 THEN sc / nullif(orders_cmp, 0) END"),
    ("platform_roas", ratio("conv_val", "spend"), "(CASE WHEN n_cmp_paid > 0 THEN conv_val_cmp END) / nullif(sc, 0)")]),
    "fact", local=(("g", f"""SELECT *, CASE WHEN n_cmp_paid > 0 THEN spend_cmp END AS sc FROM (
  SELECT count(CASE WHEN {CMP_C} THEN 1 END) AS n_cmp, count(CASE WHEN {CMP_C} AND {_paid} THEN 1 END) AS n_cmp_paid,
  {dsum('revenue', CUR_C)} AS rev, {dsum('orders', CUR_C)} AS orders,
  {dsum('spend', f'{CUR_C} AND {_paid}')} AS spend, {dsum('platform_conversion_value_7d', f'{CUR_C} AND {_paid}')} AS conv_val,
  {dsum('revenue', CMP_C)} AS rev_cmp, {dsum('orders', CMP_C)} AS orders_cmp,
  {dsum('spend', f'{CMP_C} AND {_paid}')} AS spend_cmp,
  {dsum('platform_conversion_value_7d', f'{CMP_C} AND {_paid}')} AS conv_val_cmp
  FROM fact WHERE {CUR_C} OR {CMP_C})"""),))

reg("paid_platform_table", f"""
SELECT CASE WHEN gid = 1 THEN 'Total' ELSE paid_ad_platform END AS platform, spend, conv AS conversions,
  {ratio('conv_val', 'spend')} AS roas, {ratio('clicks', 'impressions')} AS ctr, {ratio('spend', 'clicks')} AS cpc,
  {ratio('spend', 'conv')} AS cpa, {S.pct('spend', 'CASE WHEN n_cmp > 0 THEN spend_cmp END')} AS spend_vs_cmp,
  {S.pct(ratio('conv_val', 'spend'), f"CASE WHEN n_cmp > 0 THEN {ratio('conv_val_cmp', 'spend_cmp')} END")} AS roas_vs_cmp
FROM (SELECT paid_ad_platform, GROUPING_ID(paid_ad_platform) AS gid, count(CASE WHEN {CUR_C} THEN 1 END) AS n_cur,
        count(CASE WHEN {CMP_C} THEN 1 END) AS n_cmp, {dsum('spend', CUR_C)} AS spend,
        {dsum('impressions', CUR_C)} AS impressions, {dsum('clicks', CUR_C)} AS clicks,
        {dsum('platform_conversions_7d', CUR_C)} AS conv, {dsum('platform_conversion_value_7d', CUR_C)} AS conv_val,
        {dsum('spend', CMP_C)} AS spend_cmp, {dsum('platform_conversion_value_7d', CMP_C)} AS conv_val_cmp
      FROM fact WHERE ({CUR_C} OR {CMP_C}) AND {_paid} GROUP BY ROLLUP (paid_ad_platform))
WHERE n_cur > 0""", "fact")


def _pos(cond):
    d = f"CASE WHEN {cond} THEN CAST(position AS DECIMAL(18,6)) END"
    return f"(CAST(sum({d}) AS DOUBLE) / nullif(CAST(count({d}) AS DOUBLE), 0))"


SQL["seo_kpis"] = with_ctes(long_rows("g", [
    ("clicks", "clicks", "CASE WHEN n_cmp > 0 THEN clicks_cmp END"),
    ("impressions", "impr", "CASE WHEN n_cmp > 0 THEN impr_cmp END"),
    ("avg_position", "pos", "CASE WHEN n_cmp > 0 THEN pos_cmp END"),
    ("ctr", ratio("clicks", "impr"), None)]), "seo", local=(
    ("g", f"""SELECT count(CASE WHEN {CMP_C} THEN 1 END) AS n_cmp, {dsum('clicks', CUR_C)} AS clicks,
  {dsum('impressions', CUR_C)} AS impr, {_pos(CUR_C)} AS pos, {dsum('clicks', CMP_C)} AS clicks_cmp,
  {dsum('impressions', CMP_C)} AS impr_cmp, {_pos(CMP_C)} AS pos_cmp FROM seo WHERE {CUR_C} OR {CMP_C}"""),))

reg("seo_branded", f"""SELECT CASE WHEN branded THEN 'Branded' ELSE 'Non-branded' END AS branded,
  CAST(sum(clicks) AS BIGINT) AS clicks FROM seo WHERE {CUR_C} GROUP BY 1""", "seo")

SQL["seo_top_queries"] = with_ctes(f"""
SELECT * FROM (SELECT query, clicks, impressions, position,
  {S.pct('clicks', 'CASE WHEN n_cmp > 0 THEN clicks_cmp END')} AS clicks_vs_cmp
  FROM q ORDER BY clicks DESC, query LIMIT 15)
UNION ALL
SELECT 'Total', sum(clicks), sum(impressions), {exact_avg('position')},
  {S.pct('sum(clicks)', f"(SELECT CASE WHEN count(CASE WHEN {CMP_C} THEN 1 END) > 0 THEN {dsum('clicks', CMP_C)} END FROM seo WHERE {CUR_C} OR {CMP_C})")}
FROM q""", "seo", local=(("q", f"""SELECT * FROM (SELECT query, count(CASE WHEN {CUR_C} THEN 1 END) AS n_cur,
  count(CASE WHEN {CMP_C} THEN 1 END) AS n_cmp, {dsum('clicks', CUR_C)} AS clicks,
  {dsum('impressions', CUR_C)} AS impressions, {_pos(CUR_C)} AS position, {dsum('clicks', CMP_C)} AS clicks_cmp
  FROM seo WHERE {CUR_C} OR {CMP_C} GROUP BY query) WHERE n_cur > 0"""),))

# ── orders / order bank ───────────────────────────────────────────────
_li_c = between(CUR, _od)
_li_p = between(LY, _od)


def _q(p, i):
    pos = f"(CAST((SELECT count(*) FROM o) - 1 AS DOUBLE) * CAST({p!r} AS DOUBLE))"
    lo = f"max(CASE WHEN r = floor({pos}) THEN v END)"
    hi = f"max(CASE WHEN r = ceil({pos}) THEN v END)"
    return f"({lo} + ({hi} - {lo}) * ({pos} - floor({pos}))) AS q{i}"


def _stats(t, sfx):
    return (f"SELECT count(*) AS n{sfx}, {ratio('sum(value)', 'count(*)')} AS aov{sfx}, "
            f"{ratio('sum(items)', 'count(*)')} AS items{sfx}, "
            f"avg(CASE WHEN items = 1 THEN 1.0 ELSE 0.0 END) AS single{sfx}, {dsum('items')} AS units{sfx} FROM {t}")


SQL["order_insight"] = with_ctes(long_rows("s, sc, qq", [
    ("orders", "n", "CASE WHEN n_c > 0 THEN n_c END"), ("aov", "aov", "CASE WHEN n_c > 0 THEN aov_c END"),
    ("median_order", "q0", None), ("p90_order", "q1", None),
    ("avg_items", "items", "CASE WHEN n_c > 0 THEN items_c END"), ("single_item_share", "single", None),
    ("units", "units", "CASE WHEN n_c > 0 THEN units_c END")]), "line_items", local=(
    ("o", f"SELECT order_id, sum(net_sales) AS value, sum(quantity) AS items FROM line_items WHERE {_li_c} GROUP BY 1"),
    ("oc", f"SELECT order_id, sum(net_sales) AS value, sum(quantity) AS items FROM line_items WHERE {_li_p} GROUP BY 1"),
    ("s", _stats("o", "")), ("sc", _stats("oc", "_c")),
    ("qq", f"SELECT {_q(0.5, 0)}, {_q(0.9, 1)} FROM (SELECT CAST(value AS DOUBLE) AS v, "
           f"row_number() OVER (ORDER BY CAST(value AS DOUBLE)) - 1 AS r FROM o)")))

_steps = "[" + ", ".join(str(s) for s in [m * 10 ** e for e in range(17) for m in (1, 2, 5)]) + "]"
SQL["order_value_histogram"] = with_ctes("""
SELECT CAST(floor(CAST(cents AS DECIMAL(30,4)) / step) * step AS BIGINT) / 100.0 AS bin_start, step / 100.0 AS bin_width, count(*) AS orders
FROM oc, st GROUP BY 1, 2""", "line_items", local=(
    ("oc", f"SELECT order_id, CAST(sum(net_sales) * 100 AS BIGINT) AS cents FROM line_items WHERE {_li_c} GROUP BY 1"),
    ("st", f"SELECT min(s) AS step FROM (SELECT unnest({_steps}) AS s) "
           f"WHERE (SELECT max(cents) - min(cents) FROM oc) <= s * 40")))

reg("revenue_by_category", f"SELECT category, {dsum('net_sales')} AS revenue FROM line_items WHERE {_li_c} GROUP BY 1",
    "line_items")
reg("top_products", f"""SELECT product_title, {dsum('net_sales')} AS revenue FROM line_items WHERE {_li_c}
GROUP BY 1 ORDER BY revenue DESC, product_title LIMIT 10""", "line_items")

_snap = "(SELECT * FROM orderbank WHERE date = (SELECT max(date) FROM orderbank))"
reg("orderbank_snapshot", f"""SELECT max(date) AS date, {dsum('open_value')} AS open_value,
  CAST(sum(open_orders) AS BIGINT) AS open_orders, CAST(sum(open_items) AS BIGINT) AS open_items FROM {_snap}""",
    "orderbank")
reg("orderbank_by_category", f"SELECT category_l1, {dsum('open_value')} AS open_value FROM {_snap} GROUP BY 1",
    "orderbank")
reg("orderbank_by_warehouse", f"SELECT warehouse, {dsum('open_value')} AS open_value FROM {_snap} GROUP BY 1",
    "orderbank")
reg("orderbank_trend", f"SELECT date, {dsum('open_value')} AS open_value FROM orderbank GROUP BY 1", "orderbank")

# ── facts ─────────────────────────────────────────────────────────────
reg("fact_product", """SELECT date, product_id, product_title, category_l1, category, style,
  CAST(units AS BIGINT) AS units, CAST(revenue AS DOUBLE) AS revenue, CAST(gross_sales AS DOUBLE) AS gross_sales,
  CAST(discounts AS DOUBLE) AS discounts, CAST(cogs AS DOUBLE) AS cogs, CAST(gross_profit AS DOUBLE) AS gross_profit,
  CAST(product_views AS BIGINT) AS product_views, CAST(product_add_to_carts AS BIGINT) AS product_add_to_carts,
  CAST(on_hand AS BIGINT) AS on_hand, CAST(stock_value AS DOUBLE) AS stock_value,
  CAST(in_transit AS BIGINT) AS in_transit, CAST(returned_units AS BIGINT) AS returned_units,
  CAST(refund_amount AS DOUBLE) AS refund_amount FROM fact_product""", "fact_product")
reg("fact_email", """SELECT date, name, type, recipients, opens, clicks, orders, CAST(revenue AS DOUBLE) AS revenue
FROM email""", "email")
reg("fact_seo", "SELECT date, query, branded, clicks, impressions, position FROM seo", "seo")
reg("fact_orderbank", """SELECT date, category_l1, warehouse, open_orders, CAST(open_items AS BIGINT) AS open_items,
  CAST(open_value AS DOUBLE) AS open_value FROM orderbank""", "orderbank")
reg("orders_from_lines", """SELECT order_id, created_at, customer_id, country, CAST(gross_sales AS DOUBLE) AS gross_sales,
  CAST(discounts AS DOUBLE) AS discounts, CAST(net_sales AS DOUBLE) AS net_sales, CAST(cogs AS DOUBLE) AS cogs,
  CAST(shipping AS DOUBLE) AS shipping, CAST(total_price AS DOUBLE) AS total_price, currency FROM shop_orders""",
    "shop_orders")

# ── sources and sinks ─────────────────────────────────────────────────
reg("scan_parquet", """SELECT CAST(year(CAST(o_orderdate AS DATE)) AS INTEGER) AS year, o_orderstatus,
  count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1, 2""")
reg("sink_roundtrip", """SELECT strftime(date, '%Y-%m') AS month, count(*) AS rows, CAST(sum(revenue) AS DOUBLE) AS revenue,
  CAST(sum(units) AS BIGINT) AS units FROM fact_product GROUP BY 1""", "fact_product")
_feeds = [("orders", "shop_orders"), ("line_items", "line_items"), ("inventory", "inventory"),
          ("returns", "shop_returns"), ("traffic", "traffic"), ("traffic_items", "traffic_items"),
          ("meta", "meta"), ("google", "google"), ("microsoft", "microsoft"), ("tiktok", "tiktok"),
          ("email", "email"), ("seo", "seo"), ("orderbank", "orderbank"), ("targets", "targets"),
          ("fact", "fact"), ("fact_product", "fact_product"), ("fact_email", "email"), ("fact_seo", "seo")]
reg("source_coverage", "\nUNION ALL\n".join(
    f"SELECT '{n}' AS feed, count(*) AS rows, count(*) > 0 AS present FROM {c}" for n, c in _feeds),
    *[c for _, c in _feeds])
_kinds = {"fact": "fact", "fact_product": "fact", "fact_email": "fact", "fact_seo": "fact"}
reg("feed_presence", "\nUNION ALL\n".join(
    f"SELECT '{n}' AS name, '{_kinds.get(n, 'feed')}' AS kind, EXISTS (SELECT 1 FROM {c}) AS present"
    for n, c in _feeds if n != "orderbank"), *[c for _, c in _feeds])
reg("source_probe", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS dataset, true AS present, count(*) AS rows FROM {t}"
    for t in ("customer", "part", "orders", "lineitem", "events"))
    + "\nUNION ALL\nSELECT 'no_such_feed', false, 0")
reg("orders_from_json", """SELECT order_id, CAST(min(created_at) AS DATE) AS order_date,
  min_by(customer_id, created_at) AS customer_id, 'unknown' AS channel, min_by(country, created_at) AS country,
  CAST(sum(gross_sales) AS DOUBLE) AS gross_sales, CAST(sum(discounts) AS DOUBLE) AS discounts,
  CAST(sum(gross_sales) - sum(discounts) AS DOUBLE) AS net_sales,
  CAST(round(sum(gross_sales) * 0.45, 2) AS DOUBLE) AS cogs, CAST(0 AS DOUBLE) AS shipping,
  CAST(sum(net_sales) AS DOUBLE) AS total_price, 'GBP' AS currency FROM line_items GROUP BY order_id""", "line_items")
_month = "CAST(year(date) * 100 + month(date) AS INT)"
_feeds_of = {"fact": [("shop_orders", "CAST(created_at AS DATE)"), ("ev", "date")], "fact_product": [("line_items", "CAST(created_at AS DATE)"), ("shop_returns", "date")],
             "fact_email": [("email", "date")], "fact_seo": [("seo", "date")], "fact_orderbank": [("orderbank", "date")]}
reg("incremental_build", " UNION ALL ".join(
    f"""SELECT '{f}' AS fact, month, count(*) AS rows,
  coalesce(month = {REF.year * 100 + REF.month} AND ({' OR '.join(f'EXISTS (SELECT 1 FROM {t} WHERE {d} = {D(REF)})' for t, d in feeds)}), false) AS rewritten
FROM (SELECT {_month} AS month FROM {'orderbank' if f == 'fact_orderbank' else {'fact_email': 'email', 'fact_seo': 'seo'}.get(f, f)}) GROUP BY month"""
    for f, feeds in _feeds_of.items()), "fact", "fact_product", "email", "seo", "orderbank", "ev", "shop_orders", "shop_returns", "line_items")
SQL["orders_upsert_stream"] = SQL["orders_from_json"]
reg("orders_recent_window", f"""SELECT count(*) AS orders, CAST(sum(net_sales) AS DOUBLE) AS net_sales,
  min(CAST(created_at AS DATE)) AS first_day, max(CAST(created_at AS DATE)) AS last_day FROM shop_orders
WHERE created_at >= TIMESTAMP '{REF} 00:00:00' - INTERVAL 120 DAY""", "shop_orders")
_matched = ",".join(sorted(M.TARGET_COLUMNS))
reg("targets_ingest", f"""SELECT true AS valid, '{_matched}' AS matched, count(*) AS rows, min(date) AS first_day,
  max(date) AS last_day, CAST(sum(target_revenue) AS DOUBLE) AS target_revenue,
  CAST(sum(target_orders) AS DOUBLE) AS target_orders FROM targets""", "targets")
SQL["kpi_paid"] = kpi_query(["spend", "roas", "cost_per_visit", "cost_per_add_to_cart", "cost_per_checkout",
                             "cost_per_order"], CUR, LY)
_ex = ["revenue", "orders", "spend", "roas"]
reg("export_csv", "SELECT marketing_channel AS \"Marketing Channel\", "
    + ", ".join(f'{m} AS "{M.nice(m)}"' for m in _ex)
    + f" FROM ({agg_sql(['marketing_channel'], _ex, 'fact', CUR_C)})", "fact")

del dt
