"""Oracle SQL (DuckDB) for every registered query, keyed by query name."""
from __future__ import annotations

from oracle import dims_sql as S
from oracle.feeds_sql import with_ctes
from tillroll import model as M
from tillroll.catalog import CUR, HEADLINE, LY, REF

SQL: dict[str, str] = {}
BASES = list(M.BASE_METRICS)


def reg(name: str, body: str, *ctes: str):
    SQL[name] = with_ctes(body, *ctes)


def between(r, col="date") -> str:
    return f"{col} BETWEEN DATE '{r[0]}' AND DATE '{r[1]}'"


def agg_sql(dims: list[str], metrics: list[str], frm: str, where: str = "TRUE") -> str:
    dl = ", ".join(dims)
    sums = ", ".join(f"{S.base_sum(b)} AS {b}" for b in BASES)
    ms = ", ".join(f"{S.metric(m)} AS {m}" for m in metrics)
    if dims:
        return (f"SELECT {dl}, {ms} FROM (SELECT {dl}, {sums} FROM {frm} WHERE {where} "
                f"GROUP BY {dl})")
    return f"SELECT {ms} FROM (SELECT {sums} FROM {frm} WHERE {where})"


def fact_out(frm: str = "fact", where: str = "TRUE") -> str:
    cols = [f"CAST({m} AS DOUBLE) AS {m}" if M.BASE_METRICS[m][1] == "currency" else m
            for m in BASES]
    return f"SELECT {', '.join(M.DIMENSIONS)}, {', '.join(cols)} FROM {frm} WHERE {where}"


# ── dimension rules over the feeds ──────────────────────────────────────
_s, _m = S.split_sm("source_medium")
reg("dim_norm", f"""SELECT source_medium, {S.norm('source_medium')} AS normalised, count(*) AS rows
FROM traffic GROUP BY source_medium""", "traffic")
reg("dim_source_medium", f"""SELECT source_medium, {_s} AS src, {_m} AS medium, count(*) AS rows
FROM traffic GROUP BY source_medium""", "traffic")
reg("dim_channel", f"""SELECT source_medium, ch AS marketing_channel, {S.channel_group('ch')} AS marketing_channel_group,
  sessions FROM (SELECT source_medium, {S.channel('s', 'm')} AS ch, sessions FROM
  (SELECT source_medium, {_s} AS s, {_m} AS m, CAST(sum(sessions) AS BIGINT) AS sessions
   FROM traffic GROUP BY source_medium))""", "traffic")
reg("dim_platform", f"""SELECT source_medium, {S.platform('s', 'm')} AS paid_ad_platform, sessions FROM
  (SELECT source_medium, {_s} AS s, {_m} AS m, CAST(sum(sessions) AS BIGINT) AS sessions
   FROM traffic GROUP BY source_medium)""", "traffic")
reg("dim_geo", f"""SELECT country, {S.geo_cols('country')}, lines FROM
  (SELECT country, count(*) AS lines FROM line_items GROUP BY country)""", "line_items")

_camp_parts = []
for _feed, _ch, _typed, _pre in (("meta", "Paid Social", False, True),
                                 ("google", "Paid Search", True, False),
                                 ("microsoft", "Paid Search", True, False),
                                 ("tiktok", "Paid Social", False, True)):
    _name = "coalesce(campaign_name, '')"
    _ty = "campaign_type" if _typed else "CAST(NULL AS VARCHAR)"
    _camp_parts.append(
        f"SELECT '{_feed}' AS feed, campaign_name, campaign_type, "
        f"{S.prefix(_name) if _pre else _name} AS marketing_campaign, "
        f"{S.campaign_type(_name, S.q(_ch), 'campaign_type')} AS paid_campaign_type, rows "
        f"FROM (SELECT campaign_name, {_ty} AS campaign_type, count(*) AS rows FROM {_feed} GROUP BY 1, 2)")
reg("dim_campaign", "\nUNION ALL\n".join(_camp_parts), "meta", "google", "microsoft", "tiktok")
reg("dim_device", f"""SELECT device, {S.device('device')} AS device_label, sessions FROM
  (SELECT device, CAST(sum(sessions) AS BIGINT) AS sessions FROM traffic GROUP BY device)""", "traffic")

# ── lanes and the stacked fact ──────────────────────────────────────────
for _q, _src in (("map_orders", "shopify"), ("map_traffic", "ga4"), ("map_meta", "meta"),
                 ("map_google", "google_ads"), ("map_microsoft", "microsoft"),
                 ("map_tiktok", "tiktok")):
    reg(_q, fact_out("fact", f"source = '{_src}'"), "fact")
reg("fact_stacked", fact_out(), "fact")
reg("fact_row_counts", "SELECT source, count(*) AS rows FROM fact GROUP BY source", "fact")
reg("date_bounds", "SELECT min(date) AS min_date, max(date) AS max_date, count(*) AS rows FROM fact",
    "fact")

# ── query API ───────────────────────────────────────────────────────────
reg("totals", agg_sql([], M.ALL_METRICS, "fact", between(CUR)), "fact")
reg("derived_metrics", agg_sql(["source"], list(M.DERIVED_METRICS), "fact", between(CUR)), "fact")
reg("breakdown", agg_sql(["geo_market"], HEADLINE, "fact", between(CUR)), "fact")
reg("aggregate_multi", agg_sql(["marketing_channel", "device"], ["revenue", "orders", "spend", "roas"],
                               "fact", between(CUR)), "fact")
reg("filter_range_inlist", agg_sql(
    ["source", "geo_region"], ["spend", "clicks", "impressions", "ctr", "cpc"], "fact",
    between(CUR) + " AND geo_region IN ('EU', 'UK') AND marketing_channel_group IN ('Paid')"), "fact")

_fo_dims = ["marketing_channel_group", "marketing_channel", "paid_ad_platform",
            "paid_campaign_type", "geo_region", "geo_market", "device"]
reg("filter_options", "\nUNION ALL\n".join(
    [f"SELECT DISTINCT '{d}' AS dimension, {d} AS value FROM fact WHERE {d} IS NOT NULL AND {d} <> '(n/a)'"
     for d in _fo_dims]
    + ["SELECT DISTINCT 'category' AS dimension, category AS value FROM fact_product WHERE category IS NOT NULL"]),
    "fact", "fact_product")


def trend_sql(metric: str, freq: str, where: str, frm: str = "fact") -> str:
    bucket = {"D": "date", "W": "CAST(date_trunc('week', date) AS DATE)",
              "M": "CAST(date_trunc('month', date) AS DATE)"}[freq]
    sums = ", ".join(f"{S.base_sum(b)} AS {b}" for b in BASES)
    return (f"SELECT period, {S.metric(metric)} AS {metric} FROM "
            f"(SELECT {bucket} AS period, {sums} FROM {frm} WHERE {where} GROUP BY 1)")


reg("trend_day", trend_sql("revenue", "D", between(CUR)), "fact")
reg("trend_week", trend_sql("contribution", "W", between(CUR)), "fact")
reg("trend_month", trend_sql("conversion_rate", "M",
                             between((REF.replace(year=REF.year - 1, month=1, day=1), REF))), "fact")


# ── KPI rows: value, comparison, target ────────────────────────────────
def _tcol(b):
    for tc, m in M.TARGET_COLUMNS.items():
        if m == b:
            return tc
    return None


def kpi_sql(metrics: list[str], cur, cmp, where_extra: str = "TRUE", with_cmp: bool = True) -> str:
    cur_c, cmp_c = between(cur), between(cmp) if cmp else "FALSE"
    sums = [f"{S.base_sum(b, cur_c)} AS {b}_cur" for b in BASES]
    sums += [f"{S.base_sum(b, cmp_c)} AS {b}_cmp" for b in BASES]
    tsums = [f"CAST(coalesce(sum({tc}), 0) AS DOUBLE) AS t_{m}" for tc, m in M.TARGET_COLUMNS.items()]
    parts = []
    for m in metrics:
        v = S.metric(m, lambda b: f"{b}_cur")
        c = S.metric(m, lambda b: f"{b}_cmp") if with_cmp else "CAST(NULL AS DOUBLE)"
        if m in M.BASE_METRICS:
            t = f"t_{m}" if _tcol(m) else "CAST(NULL AS DOUBLE)"
        else:
            ins = [b for b in BASES if "{" + b + "}" in S.FORMULAS[m]]
            t = S.metric(m, lambda b: f"t_{b}") if all(_tcol(b) for b in ins) else "CAST(NULL AS DOUBLE)"
        parts.append(
            f"SELECT '{m}' AS metric, CAST({v} AS DOUBLE) AS value, CAST({c} AS DOUBLE) AS cmp, "
            f"{S.pct(v, c)} AS delta_pct, CAST({t} AS DOUBLE) AS target, "
            f"CASE WHEN ({t}) <> 0 THEN {S.pct(v, t)} END AS vtarg_pct FROM k, tg")
    local = (("k", f"SELECT {', '.join(sums)} FROM fact WHERE ({cur_c} OR {cmp_c}) AND {where_extra}"),
             ("tg", f"SELECT {', '.join(tsums)} FROM targets WHERE {cur_c}"))
    return "\nUNION ALL\n".join(parts), local


def kpi_query(metrics, cur, cmp, where_extra="TRUE", with_cmp=True) -> str:
    body, local = kpi_sql(metrics, cur, cmp, where_extra, with_cmp)
    return with_ctes(body, "fact", "targets", local=local)


SQL["kpi_comparison"] = kpi_query(M.ALL_METRICS, CUR, LY)
SQL["kpi_summary"] = kpi_query(M.KPI_GROUPS["Overview Metrics"] + M.KPI_GROUPS["Funnel Metrics"], CUR, LY)


def comparison_select(metrics: list[str]) -> str:
    cols = []
    for m in metrics:
        v = S.metric(m, lambda b: f"{b}_cur")
        c = f"CASE WHEN n_cmp > 0 THEN {S.metric(m, lambda b: f'{b}_cmp')} END"
        d = f"(({v}) - ({c}))" + (" * 100.0" if M.metric_format(m) == "percent" else "")
        cols += [f"{v} AS {m}", f"{c} AS {m}_cmp", f"{d} AS {m}_delta", f"{S.pct(v, c)} AS {m}_pct"]
    return ", ".join(cols)


def rollup_sql(dims: list[str], cur, cmp, where_extra="TRUE") -> str:
    cur_c, cmp_c = between(cur), between(cmp)
    sums = [f"{S.base_sum(b, cur_c)} AS {b}_cur" for b in BASES]
    sums += [f"{S.base_sum(b, cmp_c)} AS {b}_cmp" for b in BASES]
    dl = ", ".join(dims)
    return (f"SELECT {dl}, GROUPING_ID({dl}) AS gid, count(CASE WHEN {cur_c} THEN 1 END) AS n_cur, "
            f"count(CASE WHEN {cmp_c} THEN 1 END) AS n_cmp, {', '.join(sums)} FROM fact "
            f"WHERE ({cur_c} OR {cmp_c}) AND {where_extra} GROUP BY ROLLUP ({dl})")


def dim_table_sql(dim: str, metrics: list[str]) -> str:
    return with_ctes(
        f"SELECT CASE WHEN gid = 1 THEN 'Total' ELSE {dim} END AS label, "
        f"CASE WHEN gid = 1 THEN 'total' ELSE 'row' END AS kind, {comparison_select(metrics)}, "
        f"CAST(row_number() OVER (ORDER BY gid = 1, {S.metric(metrics[0], lambda b: f'{b}_cur')} DESC NULLS LAST, {dim}) "
        f"AS INTEGER) AS pos FROM ({rollup_sql([dim], CUR, LY)}) WHERE n_cur > 0", "fact")


SQL["dim_table_market"] = dim_table_sql("geo_market", M.KPI_GROUPS["Overview Metrics"])
SQL["dim_table_device"] = dim_table_sql("device", M.KPI_GROUPS["Funnel Metrics"])
SQL["channel_table"] = with_ctes(
    f"""SELECT CASE WHEN gid = 0 THEN marketing_channel WHEN gid = 1 THEN marketing_channel_group || ' total'
  ELSE 'Total' END AS label,
  CASE WHEN gid = 0 THEN 'row' WHEN gid = 1 THEN 'subtotal' ELSE 'total' END AS kind,
  CASE WHEN gid = 3 THEN NULL ELSE marketing_channel_group END AS channel_group,
  {comparison_select(M.KPI_GROUPS['Overview Metrics'])},
  CAST(row_number() OVER (ORDER BY list_position(['Paid', 'Unpaid'], CASE WHEN gid < 3 THEN marketing_channel_group END)
    NULLS LAST, gid, revenue_cur DESC NULLS LAST, marketing_channel) AS INTEGER) AS pos
FROM ({rollup_sql(['marketing_channel_group', 'marketing_channel'], CUR, LY)})
WHERE n_cur > 0 AND (gid = 3 OR marketing_channel_group IN ('Paid', 'Unpaid'))""", "fact")


from oracle import queries_reports  # noqa: E402,F401  (registers the rest)
