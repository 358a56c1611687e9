"""Remaining operators: smaller rules, statement bundles, outputs and the streaming ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold import model as M
from tallyfold.functions import columns as K
from tallyfold.operators import bundles as BU
from tallyfold.operators import facts as X
from tallyfold.operators import filings as FL
from tallyfold.operators import known as KN
from tallyfold.operators import reconcile as RC
from tallyfold.operators import series as S
from tallyfold.operators import ttm as T
from tallyfold.operators.ordered import newest_per
from tallyfold.plans import jobs
from tallyfold.plans import mapping as MP
from tallyfold.plans import oracle_base as O
from tallyfold.plans.filing_queries import EV_SQL, HOLD_SQL, TX_SQL, events, form4, holdings
from tallyfold.plans.ingest_queries import (
    COMPANY, EXTRACT, FAST, FILINGS_SQL, FLOW, MAPPED, filing_facts, filings)
from tallyfold.plans.reconcile_queries import CUR_SQL, curated
from tallyfold.plans import series_queries as SQ
from tallyfold.plans.series_queries import has, lst, ttm_sql
from tallyfold.sources import clustered as CL
from tallyfold.sources import readers as RD
from tallyfold.sources.store import CompanyState, Ledger, MetricStore
from tallyfold.streaming import ingest as IN

c = F.col
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


# ------------------------------------------------------------ ingest rules

@query("p2_company_units", f"""with {O.facts()} select concept, unit, count(*) as n, count(*) filter (unit = 'USD') as kept from facts group by all""")
def p2(spark, d):
    ok = X.map_concepts(MP.facts(spark, d)).withColumn("ok", X.company_unit_ok())
    return ok.groupBy("concept", "unit").agg(F.count("*").alias("n"), F.count_if("ok").alias("kept"))


@query("p3_filing_units", f"""with {O.facts()}, u as (select *, case when concept = 'us-gaap:Assets' then 'USD_per_shares' else 'iso4217-' || unit end as unit_ref from facts)
select concept, unit_ref, count(*) as n, count(*) filter (unit_ref = 'iso4217-USD') as kept from u group by all""")
def p3(spark, d):
    u = X.map_concepts(MP.facts(spark, d)).withColumn("unit_ref", F.when(
        c("concept") == "us-gaap:Assets", "USD_per_shares").otherwise(F.concat(F.lit("iso4217-"), "unit")))
    return u.withColumn("ok", X.filing_unit_ok()).groupBy("concept", "unit_ref").agg(
        F.count("*").alias("n"), F.count_if("ok").alias("kept"))


@query("p6_annual_flows", f"with {COMPANY} select ticker, metric_type, period_end, value from stored where period_type = 'annual' and {FLOW}")
def p6(spark, d):
    flows = MP.facts(spark, d).where(c("concept").isin([*MP.FACT_FLOWS.values(), MP.FACT_ALIAS[1]]))
    rows = X.merged_company_rows(flows)
    return rows.where((c("period_type") == M.ANNUAL) & c("metric_type").isin(M.FLOW_METRICS)).select("ticker", "metric_type", "period_end", "value")


@query("p7_period_labels", f"""with {O.metrics(['revenue'])} select distinct period_type, period_end, period,
  period_end as parsed from metrics""")
def p7(spark, d):
    m = MP.metrics(spark, d, ["revenue"])
    return m.select("period_type", "period_end", "period", K.label_day(c("period")).alias("parsed")).distinct()


@query("p8_lenient_dates", """select o_orderstatus, case when o_orderstatus = 'O' then null else cast(o_orderdate as date) end as day, count(*) as n
from orders group by all""")
def p8(spark, d):
    text = F.when(c("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy/MM/dd")).when(
        c("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format("o_orderdate", " yyyy-MM-dd HH:mm"))
    return MP.table(spark, d, "orders").groupBy("o_orderstatus", K.iso_day(text).alias("day")).agg(F.count("*").alias("n"))


DEFAULTS = ", ".join(f"({i + 1}, '{t}')" for i, t in enumerate(IN.DEFAULT_SCOPE))


@query("p11_form_and_ticker_scope", f"""with {FILINGS_SQL}, d(k, t) as (values {DEFAULTS}),
f as (select coalesce(t, 'C' || cast(cast(cik as bigint) as varchar)) as ticker, accession_number, form_type from filings left join d on k = cast(cik as bigint)
  where form_type in ({lst(M.TARGET_FORMS)}))
select 'ALL' as mode, * from f union all select 'unset', * from f where ticker in ({lst(IN.DEFAULT_SCOPE)})
union all select 'list', * from f where ticker in ('C11', 'C12', 'C13', 'AAPL')""")
def p11(spark, d):
    rows = filings(spark, d).drop("ticker").withColumnRenamed("form_type", "form")
    ref = MP.table(spark, d, "customer").select(c("c_custkey").alias("cik"), F.coalesce(
        F.get(F.array(*[F.lit(t) for t in IN.DEFAULT_SCOPE]), c("c_custkey").cast("int") - 1), F.concat(F.lit("C"), "c_custkey")).alias("ticker"))
    modes = {"ALL": " all ", "unset": None, "list": "c11, C12,C13 ,aapl,,"}
    parts = [IN.in_scope(rows, ref, IN.ticker_scope(v)).select(F.lit(k).alias("mode"), "ticker", "accession_number", c("form").alias("form_type")) for k, v in modes.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("s5_share_classes", f"""with {FILINGS_SQL}, ref as (select c_custkey, unnest(['A' || c_custkey, 'B' || c_custkey]) as tk from customer where c_acctbal > 0)
select accession_number, tk as ticker, max(tk) over (partition by accession_number) as one from filings join ref on cast(cik as bigint) = c_custkey""")
def s5c(spark, d):
    """Every ticker of a company in the slow path, one in the fast path."""
    ref = MP.table(spark, d, "customer").where("c_acctbal > 0").select(
        c("c_custkey").alias("cik"), F.explode(F.array(F.concat(F.lit("A"), "c_custkey"), F.concat(F.lit("B"), "c_custkey"))).alias("ticker"))
    rows = filings(spark, d).drop("ticker").select("cik", "accession_number")
    one = RD.with_ticker(rows, ref, one=True).select("accession_number", c("ticker").alias("one"))
    return RD.with_ticker(rows, ref).join(one, "accession_number").select("accession_number", "ticker", "one")


@query("p13_open_date_ranges", f"""with {FILINGS_SQL} select form_type, count(*) filter (filing_date >= date '1998-01-01') as since,
  count(*) filter (filing_date <= date '1998-01-01') as until, count(*) as all_ from filings group by 1""")
def p13(spark, d):
    day = c("filing_date")
    return filings(spark, d).groupBy("form_type").agg(
        F.count_if(K.date_range(day, "1998-01-01", " None ")).alias("since"), F.count_if(K.date_range(day, "", "1998-01-01")).alias("until"),
        F.count_if(K.date_range(day, None, "null")).alias("all_"))


@query("d4_flows_by_label", f"""with {MAPPED} select ticker, metric_type, alias_rank, fiscal_period, period_end, max(numeric_value) as value from mapped
where {FLOW} and fiscal_period in ('FY', 'Q1', 'Q2', 'Q3') group by all""")
def d4(spark, d):
    flows = MP.facts(spark, d).where(c("concept").isin([*MP.FACT_FLOWS.values(), MP.FACT_ALIAS[1]])).drop("period_start")
    rows = X.candidate_rows(X.map_concepts(flows).where(X.company_unit_ok()))
    return rows.select("ticker", "metric_type", "alias_rank", c("label").alias("fiscal_period"), "period_end", "value")


@query("d6_backfilled_rows", f"""with {EXTRACT} select ticker, metric_type, period_type, period_end, value, source from done where source like '%-derived'""")
def d6(spark, d):
    rows = X.extract_companies(MP.facts(spark, d))
    return rows.where(c("source").endswith("-derived")).select("ticker", "metric_type", "period_type", "period_end", "value", "source")


@query("a1_largest_per_period", f"""with {O.facts()} select ticker, concept, fiscal_period, period_end, max(numeric_value) as value, min(fiscal_year) as fiscal_year
from facts where unit = 'USD' group by all""")
def a1(spark, d):
    return MP.facts(spark, d).where("unit = 'USD'").groupBy("ticker", "concept", "fiscal_period", "period_end").agg(
        F.max("numeric_value").alias("value"), F.min("fiscal_year").alias("fiscal_year"))


@query("a2_keep_first", f"""with {O.facts()} select ticker, fiscal_period, period_end, concept, numeric_value from (select *, row_number() over (
  partition by ticker, fiscal_period, period_end order by fiscal_year, concept, numeric_value, unit, period_start) as n from facts) where n = 1""")
def a2(spark, d):
    f = MP.facts(spark, d).select("ticker", "fiscal_period", "period_end", "fiscal_year", "concept", "numeric_value", "unit", "period_start")
    ordered = f.withColumns({"k1": c("concept"), "k2": c("numeric_value")})
    return X.keep_first(ordered, ["fiscal_year", "k1", "k2", "unit", "period_start"], ["ticker", "fiscal_period", "period_end"])


@query("u1_priority_union", f"""with {O.metrics(["revenue"])}, a as (select * from metrics where source = '10-Q' and period_end < date '1998-01-01'),
u as (select ticker, metric_type, period_type, period_end, value, 0 as p from a union all
      select ticker, metric_type, period_type, period_end, value * 2, 1 from metrics)
select ticker, metric_type, period_type, period_end, value from (select *, row_number() over (partition by ticker, metric_type, period_type, period_end order by p) as n from u) where n = 1""")
def u1(spark, d):
    m = MP.metrics(spark, d, ["revenue"]).select(*M.PK, "value", "source")
    first = m.where((c("source") == "10-Q") & (c("period_end") < F.lit("1998-01-01").cast("date")))
    return X.merge_priority(first.drop("source"), m.drop("source").withColumn("value", c("value") * 2))


# ------------------------------------------------------------ views

def _long(part: str, sql: str, names: list[str], period: str = "cast(period_end as varchar)") -> str:
    """Columns ``names`` of a query as rows of a bundle."""
    cols = ", ".join(names)
    return f"select ticker, '{part}' as part, {period} as period, name, value from (unpivot (select ticker, {'period_end, ' if 'period_end' in period else ''}{cols} from ({sql})) on {cols} into name name value value)"


def _series_sql(part: str, names: list[str], period_type: str) -> str:
    return f"""select ticker, '{part}' as part, cast(period_end as varchar) as period, metric_type as name, value from (
  with {O.metrics(has(names))} select * from metrics where period_type = '{period_type}') where value is not null"""


def _ttm_rows(names: list[str]) -> str:
    return _long("ttm", f"with {O.metrics()}, {ttm_sql()} select * from ttm", [n for n in has(names) if n in T.OUTPUT], "'TTM'")


def _ratio_rows(part: str, key: str, period: str = "cast(period_end as varchar)") -> str:
    return f"select ticker, '{part}' as part, {period} as period, ratio_name as name, value from ({SQ.ORACLES[key]}) where value is not null"


def _all(*parts: str) -> str:
    return " union all ".join(f"select * from ({p})" for p in parts)


def _growth_rows(names: list[str], period_type: str) -> str:
    return _long("growth", SQ._growth_sql(has(names), period_type, 4 if period_type == "quarterly" else 1), has(names))


BUNDLE_SQL = {
    "income": _all(_series_sql("series", M.INCOME_METRICS, "annual"), _ttm_rows(M.INCOME_METRICS)),
    "balance": _all(_series_sql("series", M.BALANCE_METRICS, "annual"), _ttm_rows(M.BALANCE_METRICS)),
    "cashflow": _all(_long("series", SQ.CF_SQL.replace("@type", "annual") + " select * from cf", SQ.CF), _ttm_rows(M.CASHFLOW_METRICS)),
    "growth": _all(_growth_rows(M.GROWTH_METRICS, "annual"), _series_sql("margins", M.GROWTH_METRICS, "annual"), _series_sql("earnings_quality", BU.EARNINGS_QUALITY, "annual")),
    "kpi": _all(f"select ticker, 'summary' as part, cast(period_end as varchar) as period, metric_type as name, value from ({SQ.ORACLES['w1_latest_values']}) where value is not null",
                _growth_rows(M.KEY_METRICS, "annual"), _ttm_rows(M.KEY_METRICS)),
    "ratios": _all(_ratio_rows("latest", "w9_latest_ratios"), _ratio_rows("series", "d10_ratios_annual"), _ratio_rows("ttm", "d11_ttm_ratios", "'TTM'")),
    "health": _all(_ratio_rows("latest", "w9_latest_ratios"), _ratio_rows("ttm", "d11_ttm_ratios", "'TTM'"), _growth_rows(["revenue"], "annual")),
}
for _name, _rows in BU.BUNDLES.items():
    query(f"d21_{_name}_bundle", BUNDLE_SQL[_name])(lambda spark, d, rows=_rows: rows(MP.metrics(spark, d)))

Q_NAMES = ["revenue", "net_income", "interest_expense"]


@query("j14_quarterly_and_ttm", _all(
    f"""select ticker, 'quarter' as part, cast(period_end as varchar) as period, metric_type as name, value from (with {O.metrics(Q_NAMES)}
  select * from metrics where period_type = 'quarterly' qualify row_number() over (partition by ticker, metric_type order by period_end desc) <= 8)""",
    _long("margin", SQ.ORACLES["d15_quarterly_margins"], ["gross_margin", "operating_margin", "net_margin"]), _ttm_rows(Q_NAMES)))
def j14q(spark, d):
    return BU.quarterly_and_ttm(MP.metrics(spark, d), Q_NAMES)


@query("j14_events_with_cash_flow", f"""with ev as (select 'S' || substr(ticker, 2) as ticker, accession_number, filing_date, item_code from (with {EV_SQL} select * from ev)),
flows as (select ticker, period_end, operating_cash_flow as o, free_cash_flow as f from ({SQ.CF_SQL.replace('@type', 'annual')} select * from cf)),
top as (select ticker, max(period_end) as latest_period, arg_max(f, period_end) as latest_free_cash_flow from flows group by ticker)
select ev.ticker, ev.filing_date, ev.accession_number, ev.item_code, k.period_end as known_period, k.o as known_operating_cash_flow,
  k.f as known_free_cash_flow, latest_period, latest_free_cash_flow
from ev asof left join flows k on ev.ticker = k.ticker and ev.filing_date >= k.period_end left join top on top.ticker = ev.ticker""")
def j14e(spark, d):
    ev = events(spark, d).withColumn("ticker", F.concat(F.lit("S"), F.substring("ticker", 2, 20)))
    return BU.events_with_cash_flow(ev, MP.metrics(spark, d, SQ.CF))


@query("j5_recent_periods", f"""with {O.metrics(["revenue", "interest_expense"])}, r as (select ticker, period_end from (select *, row_number() over (
  partition by ticker order by period_end desc) as n from (select distinct ticker, period_end from metrics where period_type = 'quarterly')) where n <= 4)
select ticker, metric_type, period_end, value from metrics semi join r using (ticker, period_end) where period_type = 'quarterly'""")
def j5(spark, d):
    m = MP.metrics(spark, d, ["revenue", "interest_expense"], ("quarterly",))
    recent = newest_per(m.select("ticker", "period_end").distinct(), ["ticker"], [c("period_end").desc()], 4)
    return m.join(recent, ["ticker", "period_end"], "left_semi").select("ticker", "metric_type", "period_end", "value")


@query("d9_null_safe_division", f"""with {O.metrics(["cash", "total_current_liabilities"])},
w as (select ticker, period_end, {O.pick(["cash", "total_current_liabilities"])} from metrics where period_type = 'quarterly' group by all)
select ticker, period_end, cash / nullif(total_current_liabilities, 0) as ratio from w""")
def d9(spark, d):
    names = ["cash", "total_current_liabilities"]
    w = S.pivot_metrics(MP.metrics(spark, d, names, ("quarterly",)), names, "quarterly")
    return w.select("ticker", "period_end", K.div(c("cash"), c("total_current_liabilities")).alias("ratio"))


@query("p22_display_formats", f"""with {O.metrics(["revenue", "common_shares_outstanding"])} select metric_type,
  case metric_type when 'common_shares_outstanding' then 'count' else 'millions' end as display_format, count(*) as n from metrics group by all""")
def p22(spark, d):
    return MP.metrics(spark, d, ["revenue", "common_shares_outstanding"]).groupBy("metric_type").agg(F.count("*").alias("n")).withColumn(
        "display_format", K.display_format(c("metric_type")))


def _cut(x, unit, digits, suffix):
    return f"printf('%.{digits}f', {x} / {unit}) || '{suffix}'"


@query("fmt_money", f"""with {O.metrics(["revenue", "net_income"])}, v as (select ticker, metric_type, period_end, value, abs(value) as a,
  case when value < 0 then '-' else '' end as s from metrics where period_type = 'annual')
select ticker, metric_type, period_end, case when a >= 1e9 then s || '$' || {_cut('a', '1e9', 2, 'B')} when a >= 1e6 then s || '$' || {_cut('a', '1e6', 2, 'M')}
  else s || '$' || format('{{:,}}', cast(round_even(a, 0) as bigint)) end as money, printf('%.2f', value / 7) || '%' as pct from v""")
def fmt(spark, d):
    m = S.timeseries(MP.metrics(spark, d, ["revenue", "net_income"]), ["revenue", "net_income"])
    return m.select("ticker", "metric_type", "period_end", K.money(c("value")).alias("money"), K.percent(c("value") / 7).alias("pct"))


@query("p23_clean_numbers", """select event_type, count(*) as n, count(case when value > 5 then value end) as kept from events group by 1""")
def p23(spark, d):
    bad = F.when(c("value") <= 3, F.lit(float("nan"))).when(c("value") <= 5, F.lit(float("-inf"))).otherwise(c("value"))
    return MP.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(K.clean(bad)).alias("kept"))


@query("p24_manager_names", """select case when s_acctbal < 0 then 'BRK-B' else s_name end as manager, count(*) as n from supplier group by 1""")
def p24(spark, d):
    name = F.when(c("s_acctbal") < 0, " Berkshire Hathaway Inc. ").otherwise(F.concat(F.lit(" "), "s_name"))
    return MP.table(spark, d, "supplier").groupBy(K.manager_key(name).alias("manager")).agg(F.count("*").alias("n"))


@query("p19_trade_significance", f"""with {TX_SQL} select case when coalesce(abs(value), 0) < 100000 then 'Normal' when abs(value) < 1000000 then 'Notable'
  else 'Very notable' end as classification, count(*) as n from tr group by 1""")
def p19(spark, d):
    tr = FL.form4_trades(form4(spark, d), None, None)
    return tr.groupBy(K.trade_significance(c("value")).alias("classification")).agg(F.count("*").alias("n"))


@query("p21_item_titles", f"""with {EV_SQL} select item_code, case item_code {' '.join(f"when '{k}' then '{v.replace(chr(39), chr(39) * 2)}'" for k, v in M.EIGHTK_ITEM_TITLES.items())} end as title,
  count(*) as n from ev group by all""")
def p21(spark, d):
    return events(spark, d).groupBy("item_code").agg(F.count("*").alias("n")).withColumn("title", K.item_title(c("item_code")))


@query("p18_accession_lookup", f"""with {FILINGS_SQL} select accession_number, form_type from filings
where accession_number in (select lpad(cast(l_orderkey as varchar), 10, '0') from lineitem where l_linenumber = 7)""")
def p18(spark, d):
    f = filings(spark, d).select(F.concat_ws("-", F.substring("accession_number", 1, 4), F.substring("accession_number", 5, 6)).alias("accession_number"), "form_type")
    asked = MP.lines(spark, d).where("l_linenumber = 7").select(F.lpad(c("l_orderkey").cast("string"), 10, "0").alias("__k")).distinct()
    hit = f.join(asked, K.accession_key(c("accession_number")) == c("__k"), "left_semi")
    return hit.select(K.accession_key(c("accession_number")).alias("accession_number"), "form_type")


@query("l4_top_holdings", f"""with {HOLD_SQL} select accession_number, cusip, value from (select *, row_number() over (partition by accession_number order by value desc, cusip) as n
  from hold where value >= 3000000) where n <= 5""")
def l4(spark, d):
    return FL.holdings_rows(holdings(spark, d), 3_000_000, 5).select("accession_number", "cusip", "value")


# ------------------------------------------------------------ outputs

FORMATS = ["pct", "days", "dollar", "x"]
VALUE_SQL = """v as (select o_orderkey as k, case when o_orderkey % 11 = 0 then null else (cast(round(o_totalprice * 100) as bigint) * case o_orderkey % 5
   when 0 then -1 when 1 then 10 when 2 then 3000 when 3 then 40000000 else 1 end) * 1.0000000123::double / 61.0::double end as value, ['pct', 'days', 'dollar', 'x'][o_orderkey % 4 + 1] as fmt from orders),
u as (select *, abs(value) as a, case when value < 0 then '-' else '' end as s from v)"""


def _values(spark, d):
    k = c("o_orderkey")
    scale = F.when(k % 5 == 0, -1).when(k % 5 == 1, 10).when(k % 5 == 2, 3000).when(k % 5 == 3, 40000000).otherwise(1)
    value = F.when(k % 11 != 0, (F.round(c("o_totalprice") * 100).cast("long") * scale).cast("double") * F.lit(1.0000000123) / 61.0)
    return MP.table(spark, d, "orders").select(k.alias("k"), value.alias("value"), F.get(F.array(*[F.lit(x) for x in FORMATS]), (k % 4).cast("int")).alias("fmt"))


SHORT = """case when value is null then 'N/A' when a >= 1e12 then s || '$' || printf('%.2f', a / 1e12) || 'T' when a >= 1e9 then s || '$' || printf('%.2f', a / 1e9) || 'B'
  when a >= 1e6 then s || '$' || printf('%.1f', a / 1e6) || 'M' when a >= 1e3 then s || '$' || printf('%.1f', a / 1e3) || 'K' else s || '$' || printf('%.2f', a) end"""


@query("fmt_short", f"""with {VALUE_SQL}, r as (select k, fmt, value / 1e6 as value, a / 1e6 as a, s from u),
ra as (select k, case when value is null then 'N/A' when fmt = 'pct' then printf('%.2f', value * 100) || '%' when fmt = 'days' then printf('%.1f', value) || ' days'
    when fmt = 'dollar' then {SHORT} else printf('%.2f', value) || 'x' end as ratio from r)
select k, {SHORT} as currency, case when value is null then 'N/A' when a >= 1e9 then printf('%.2f', value / 1e9) || 'B'
  when a >= 1e6 then printf('%.1f', value / 1e6) || 'M' when a >= 1e3 then printf('%.1f', value / 1e3) || 'K' else printf('%.0f', value) end as count, ratio from u join ra using (k)""")
def fmt_short(spark, d):
    v = _values(spark, d)
    return v.select("k", K.currency_short(c("value")).alias("currency"), K.count_short(c("value")).alias("count"), K.ratio_text(c("value") / F.lit(1e6), c("fmt")).alias("ratio"))


@query("fmt_ticker_tokens", """select o_orderkey as k, 'C' || chr(65 + cast(o_orderkey % 26 as integer)) || ',AB' as tokens, '2024-0' || (o_orderkey % 9 + 1) || '-11' as day from orders""")
def fmt_tokens(spark, d):
    two = F.concat(F.lit("C"), F.char((c("o_orderkey") % 26 + 65).cast("long")))
    text = F.concat(F.substring("o_orderpriority", 1, 1), F.lit(" and "), two, F.lit(" beats SEC filings, TTM of AB on 2024-0"), (c("o_orderkey") % 9 + 1).cast("string"), F.lit("-11"))
    return MP.table(spark, d, "orders").select(c("o_orderkey").alias("k"), F.array_join(K.ticker_tokens(text), ",").alias("tokens"), K.first_iso_date(text).alias("day"))


@query("s15_json_records", f"""with {O.metrics(["revenue"])} select ticker, period_end, true as ok from metrics where period_type = 'annual'""")
def s15(spark, d):
    m = S.timeseries(MP.metrics(spark, d, ["revenue"]), ["revenue"])
    rec = RD.records(m).select(F.from_json("record", m.schema).alias("r"), c("record").startswith('{"ticker"').alias("ok"))
    return rec.select("r.ticker", "r.period_end", "ok")


@query("s16_fixture_rows", f"""with {CUR_SQL} select ticker, metric_type, period_type, period_end, value, source,
  case when metric_type = 'eps_diluted' then 0.02 else 1.0 end as tolerance_pct from cur""")
def s16(spark, d):
    """The fixture, written in order and read back."""
    folder = f"{jobs.work_folder(spark)}/fixture"
    rows = curated(spark, d)
    RC.write_fixture(rows, folder)
    return spark.read.schema(rows.schema).json(folder).select("ticker", "metric_type", "period_type", "period_end", "value", "source", "tolerance_pct")


# ------------------------------------------------------------ stores and streams

@query("s13_empty_store", f"""with {O.metrics(["revenue"])}, q as (select ticker, metric_type, period_end, value from metrics where period_type = 'quarterly')
select true as empty_before, false as empty_after, * from q""")
def s13(spark, d):
    """An empty store reads as no rows; what is written to it is read back."""
    store = MetricStore(spark, jobs.work_folder(spark))
    before = store.is_empty()
    store.upsert(MP.metrics(spark, d, ["revenue"], ("quarterly",)))
    return store.read().select(F.lit(before).alias("empty_before"), F.lit(store.is_empty()).alias("empty_after"), "ticker", "metric_type", "period_end", "value")


@query("s10_targeted_rerun", f"""with {EXTRACT}, w as (select ticker, metric_type, period_type, period_end, value from done where ticker <> 'S3')
select 'row' as kind, ticker, metric_type, period_type, period_end, value from w
union all select 'deleted', ticker, '', '', null, count(*) from done where ticker in ('S2', 'S3') group by ticker
union all select 'written', t, '', '', null, (select count(*) from w where ticker = t) from (values ('S2'), ('S3')) v(t)""")
def s10(spark, d):
    """Two companies are extracted again from facts that no longer hold one of them."""
    base = jobs.work_folder(spark)
    store, state = MetricStore(spark, f"{base}/store"), CompanyState(spark, f"{base}/state")
    facts = MP.facts(spark, d)
    jobs.refresh_companies(store, state, facts)
    counts = jobs.rerun_companies(store, state, facts.where(c("ticker") != "S3"), ["s2", "S3"])
    blank = [F.lit("").alias("metric_type"), F.lit("").alias("period_type"), F.lit(None).cast("date").alias("period_end")]
    rows = store.read().select(F.lit("row").alias("kind"), "ticker", "metric_type", "period_type", "period_end", "value")
    for kind in ("deleted", "written"):
        rows = rows.unionByName(counts.select(F.lit(kind).alias("kind"), "ticker", *blank, c(f"{kind}_rows").cast("double").alias("value")))
    return rows


@query("s8_store_roundtrip", f"""with {O.metrics(["revenue", "capex"])} select ticker, metric_type, period_type, period_end,
  case when metric_type = 'capex' then value * 3 else value end as value from metrics
  where ticker not in ('S1', 'S2') or period_type = 'annual'""")
def s8r(spark, d):
    """Upsert, overwrite part, delete two companies, write back their annual rows."""
    store = MetricStore(spark, jobs.work_folder(spark))
    m = MP.metrics(spark, d, ["revenue", "capex"])
    tripled = m.where("metric_type = 'capex'").withColumn("value", c("value") * 3)
    store.upsert(m)
    store.upsert(tripled)
    store.delete_tickers(["s1", "S2 "])
    back = m.where("period_type = 'annual'").withColumn("value", F.when(c("metric_type") == "capex", c("value") * 3).otherwise(c("value")))
    store.upsert(back.where(c("ticker").isin("S1", "S2")))
    return store.read().select(*M.PK, "value")


STREAM_SQL = f"""{FAST}, dd as (select *, row_number() over (partition by ticker, metric_type, period_type, period_end
   order by cast(split_part(accession, '-', 2) as integer) desc, accession desc) as n from done)"""


def _landed(spark, d, folder):
    """Land filing facts as files, as a collector would."""
    rows = filing_facts(spark, d).withColumn("filing_date", F.format_string("%d-06-30", "fiscal_year"))
    rows.select(*[f.name for f in M.FILING_FACTS_SCHEMA]).write.parquet(folder)


def _reference(spark, d):
    return MP.table(spark, d, "supplier").select(c("s_suppkey").alias("cik"), F.concat(F.lit("S"), "s_suppkey").alias("ticker"))


@query("r1_stream_ingest", f"with {STREAM_SQL} select ticker, metric_type, period_type, period_end, value, accession from dd where n = 1")
def r1(spark, d):
    """Filing facts as a file stream into the store; the newest filing wins a key."""
    base = jobs.work_folder(spark)
    _landed(spark, d, f"{base}/landing")
    job = IN.FilingIngest(MetricStore(spark, f"{base}/store"), Ledger(spark, f"{base}/ledger"), _reference(spark, d))
    job.start(IN.filing_fact_stream(spark, f"{base}/landing"), f"{base}/checkpoint").awaitTermination()
    return job.store.read().select("ticker", "metric_type", "period_type", "period_end", "value", "accession")


@query("r4_batch_backfill", f"with {STREAM_SQL} select ticker, metric_type, period_type, period_end, value, accession from dd where n = 1")
def r4(spark, d):
    """The same step on a static read, run twice: the ledger makes the second run empty."""
    base = jobs.work_folder(spark)
    _landed(spark, d, f"{base}/landing")
    job = IN.FilingIngest(MetricStore(spark, f"{base}/store"), Ledger(spark, f"{base}/ledger"), _reference(spark, d))
    facts = RD.filing_facts(spark, f"{base}/landing")
    job.run_batch(facts)
    job.run_batch(facts)
    return job.store.read().select("ticker", "metric_type", "period_type", "period_end", "value", "accession")


R3_SQL = f"""{FAST}, years as (select *, cast(split_part(accession, '-', 2) as integer) as y from done),
landed as (select ticker, metric_type, period_type, period_end, value, accession, y, 1 as b from years where y % 2 = 0
  union all select ticker, metric_type, period_type, period_end, value, accession || 'A', y, 2 from years where y % 4 = 0
  union all select ticker, metric_type, period_type, period_end, value, accession, y, 3 from years where y % 2 = 1)"""


@query("r3_late_amendments", f"""with {R3_SQL} select ticker, metric_type, period_type, period_end, value, accession from (
  select *, row_number() over (partition by ticker, metric_type, period_type, period_end order by b desc, y desc, accession desc) as n from landed) where n = 1""")
def r3(spark, d):
    """Even years first, then amendments, then the odd years late and through a stream with a checkpoint of its own."""
    base = jobs.work_folder(spark)
    rows = filing_facts(spark, d).withColumn("filing_date", F.format_string("%d-06-30", "fiscal_year"))
    rows = rows.select(*[f.name for f in M.FILING_FACTS_SCHEMA])
    amended = rows.withColumns({"accession": F.concat("accession", F.lit("A")), "filing_date": F.format_string("%d-09-30", "fiscal_year")})
    job = IN.FilingIngest(MetricStore(spark, f"{base}/store"), Ledger(spark, f"{base}/ledger"), _reference(spark, d))
    parts = [(rows.where("fiscal_year % 2 = 0"), "a"), (amended.where("fiscal_year % 4 = 0"), "a"), (rows.where("fiscal_year % 2 = 1"), "b")]
    for part, checkpoint in parts:
        part.write.mode("append").parquet(f"{base}/landing")
        job.start(IN.filing_fact_stream(spark, f"{base}/landing"), f"{base}/checkpoint-{checkpoint}").awaitTermination()
    return job.store.read().select("ticker", "metric_type", "period_type", "period_end", "value", "accession")


@query("r2_stream_unique_filings", "select lpad(cast(o_orderkey as varchar), 10, '0') as accession_number, o_orderpriority as form_type from orders")
def r2(spark, d):
    """Orders as a stream of filings, each offered twice, against the ledger."""
    schema = MP.table(spark, d, "orders").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(d)
    twice = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        F.lpad(c("o_orderkey").cast("string"), 10, "0").alias("accession_number"), F.concat(F.lit("C"), "o_custkey").alias("ticker"),
        c("o_orderpriority").alias("form_type"), c("o_orderdate").cast("date").cast("string").alias("filed_date"))
    base = jobs.work_folder(spark)
    ledger = Ledger(spark, f"{base}/ledger")
    IN.mark_unique(ledger, twice, f"{base}/checkpoint").awaitTermination()
    return ledger.read().select("accession_number", "form_type")


# ---------------------------------------------------------------- two times

# A value is known from June 30 of its filing's year; the next year's filing repeats it, restated.
REPORTED = f"""{FAST}, rep as (select ticker, metric_type, period_type, period_end, value, accession,
   make_date(cast(split_part(accession, '-', 2) as integer), 6, 30) as filed from done)"""
KNOWN_DAYS = ("1997-12-31", "1998-12-31")
KNOWN_COLS = ["revenue", "net_income", "cost_of_revenue", "operating_expenses", "total_assets", "long_term_debt"]


def reported(spark, d):
    rows = X.extract_filings(filing_facts(spark, d))
    return rows.withColumn("filed", F.make_date(F.substring_index("accession", "-", -1).cast("int"), F.lit(6), F.lit(30)))


def _known_sql(day: str) -> str:
    return f"""(with metrics as (select * from (select *, row_number() over (partition by ticker, metric_type, period_type, period_end
   order by filed desc, accession desc) as newest from rep where filed <= date '{day}') where newest = 1), {ttm_sql('1997-12-31')}
select ticker, date '{day}' as known_on, {", ".join(KNOWN_COLS)} from ttm)"""


@query("w6_as_known", f"""with {REPORTED} select ticker, {", ".join(KNOWN_COLS)} from {_known_sql(KNOWN_DAYS[1])}""")
def w6k(spark, d):
    """TTM at the end of 1997, as it was known a year later."""
    return KN.ttm_as_known(reported(spark, d), KNOWN_DAYS[1], as_of="1997-12-31").select("ticker", *KNOWN_COLS)


@query("w6_known_at_points", f"""with {REPORTED} {" union all ".join("select * from " + _known_sql(x) for x in KNOWN_DAYS)}""")
def w6kp(spark, d):
    """TTM at the end of 1997 for every ticker, as it was known then and after the next year's filing restated it."""
    rows = reported(spark, d)
    days = F.explode(F.array(*[F.lit(x).cast("date") for x in KNOWN_DAYS]))
    points = MP.table(spark, d, "supplier").select(
        F.concat(F.lit("S"), "s_suppkey").alias("ticker"), F.lit("1997-12-31").cast("date").alias("as_of"), days.alias("known_on"))
    return KN.ttm_known_at(KN.versions(rows), points).select("ticker", "known_on", *KNOWN_COLS)


@query("w6_restatements", f"""with {REPORTED}, v as (select *, lag(value) over (partition by ticker, metric_type, period_type, period_end order by filed, accession) as before
   from rep) select ticker, metric_type, period_type, period_end, filed as known_from, before, value,
   case when before <> 0 then round(value / before - 1, 9) end as change from v where before is not null and before <> value""")
def w6r(spark, d):
    """Every value that a later filing replaced."""
    return KN.restatements(KN.versions(reported(spark, d))).withColumn("change", F.round("change", 9))


@query("s8_by_ticker", f"""with {O.metrics()}, {ttm_sql()} select ticker, revenue, net_income, interest_expense, free_cash_flow, total_assets, common_shares_outstanding from ttm""")
def s8t(spark, d):
    """TTM of all tickers on the table laid out by ticker: one shuffle to write it, none to answer."""
    table = CL.write_by_ticker(MP.metrics(spark, d), jobs.work_folder(spark))
    return T.ttm_wide(table).select(
        "ticker", "revenue", "net_income", "interest_expense", "free_cash_flow", "total_assets", "common_shares_outstanding")
