"""Queries over raw facts, filings and stored batches, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold import model as M
from tallyfold.functions import columns as K
from tallyfold.operators import facts as X
from tallyfold.operators import ratio_ops as RO
from tallyfold.operators import ttm as T
from tallyfold.plans import jobs
from tallyfold.plans import mapping as MP
from tallyfold.plans import oracle_base as O
from tallyfold.plans.series_queries import lst, ttm_sql
from tallyfold.sources import readers as RD
from tallyfold.sources import store as ST

c = F.col
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


CONCEPTS = "concepts(concept, metric_type, alias_rank) as (values " + ", ".join(
    f"('{M.TAG_PREFIX}{t}', '{m}', {i})" for m, tags in M.CONCEPT_ALIASES.items() for i, t in enumerate(tags)) + ")"
BUCKET = "case " + " ".join(
    f"when date_diff('day', period_start, period_end) between {lo} and {hi} then '{n}'" for n, lo, hi in M.DURATION_BUCKETS
) + " end"
FLOW = f"metric_type in ({lst(M.FLOW_METRICS)})"


def sign_sql(metric: str, value: str) -> str:
    return f"""case when {metric} in ({lst(M.NEGATIVE_MAGNITUDE)}) then -abs({value})
      when {metric} in ({lst(M.SIGN_FLIP)}) then -{value}
      when {metric} in ({lst(M.POSITIVE_MAGNITUDE)}) then abs({value}) else {value} end + 0.0::double"""


MAPPED = f"""{O.facts()}, {CONCEPTS},
mapped as (select f.*, metric_type, alias_rank, {BUCKET} as bucket from facts f join concepts using (concept) where unit = 'USD')"""

# every step below is keyed by company, filing (k) and concept
DECOMPOSE = """
ann as (select ticker, k, metric_type, alias_rank, period_end, max(numeric_value) as v, min(fiscal_year) as fy from mapped
  where {flow} and bucket = 'annual' and (fiscal_period = 'FY' or {per_filing}) group by all),
pts as (
  select ticker, k, metric_type, alias_rank, fiscal_year as fy, case when bucket = 'quarter' then 'q1' else bucket end as p, period_end, numeric_value as v
  from mapped where {flow} and ((bucket = 'quarter' and fiscal_period = 'Q1') or bucket in ('ytd_6m', 'ytd_9m'))
  union all {annual_points}),
top as (select ticker, k, metric_type, alias_rank, fy,
    {tops}
  from (select *, row_number() over (partition by ticker, k, metric_type, alias_rank, fy, p order by period_end desc, v desc) as n from pts
        where fy is not null) where n = 1 group by all),
cand as (
  select ticker, k, metric_type, alias_rank, 'annual' as period_type, period_end, v, 'FY' as label, 0 as kind, 0 as fy from ann where not {per_filing}
  union all
  select ticker, k, metric_type, alias_rank, case when fiscal_period = 'FY' then 'annual' else 'quarterly' end, period_end, max(numeric_value),
         fiscal_period, case when fiscal_period = 'FY' then 0 else 1 end, 0
  from mapped where (not {flow}) or bucket = 'quarter' and (fiscal_period <> 'FY' or {per_filing}) or (bucket = 'annual' and {per_filing}) group by all
  union all select ticker, k, metric_type, alias_rank, 'quarterly', d_ytd_6m, v_ytd_6m - v_q1, 'Q2', 2, fy from top where v_ytd_6m - v_q1 is not null
  union all select ticker, k, metric_type, alias_rank, 'quarterly', d_ytd_9m, v_ytd_9m - v_ytd_6m, 'Q3', 2, fy from top where v_ytd_9m - v_ytd_6m is not null
  union all select ticker, k, metric_type, alias_rank, 'quarterly', d_annual, v_annual - v_ytd_9m, 'Q4', 2, fy from top where v_annual - v_ytd_9m is not null),
picked as (select * from (select *, row_number() over (partition by ticker, k, metric_type, period_type, period_end
    order by alias_rank, kind, fy, label) as n from cand) where n = 1)"""
TOPS = ", ".join(
    f"max(case when p = '{p}' then v end) as v_{p}, max(case when p = '{p}' then period_end end) as d_{p}"
    for p in ("q1", "ytd_6m", "ytd_9m", "annual"))
COMPANY = MAPPED.replace("select f.*,", "select f.*, '' as k,") + "," + DECOMPOSE.format(
    flow=FLOW, per_filing="false", tops=TOPS,
    annual_points="select ticker, k, metric_type, alias_rank, fy, 'annual', period_end, v from ann") + f""",
stored as (select ticker, metric_type, period_type, period_end, {sign_sql('metric_type', 'v')} as value,
   case when period_type = 'annual' or (label = 'Q4' and kind > 0 and {FLOW}) then '10-K' else '10-Q' end as source from picked)"""


def _sql_backfill(src: str, extra: str = "") -> str:
    """Completed periods of a stored relation; ``extra`` is a further key column."""
    e = f", {extra}" if extra else ""
    return f"""
wide as (select ticker, period_type, period_end{e},
   case when min(source) = max(source) then min(source) end as src, {O.pick(X.BACKFILL_INPUTS)} from {src} group by all),
gpw as (select *, coalesce(gross_profit, case when revenue <> 0 and abs(cost_of_revenue / revenue) between 0.2 and 0.95
   then revenue + cost_of_revenue end) as gp,
   coalesce(src || '-derived', case when period_type = 'annual' then '10-K-derived' else '10-Q-derived' end) as dsrc from wide),
done as (select ticker, metric_type, period_type, period_end, value, source{e} from {src}
   union all select ticker, 'gross_profit', period_type, period_end, gp, dsrc{e} from gpw where gross_profit is null and gp is not null
   union all select ticker, 'operating_expenses', period_type, period_end, -abs(operating_income - gp) + 0.0::double, dsrc{e} from gpw
     where operating_expenses is null and operating_income - gp <= 0)"""


DEBT_SQL = f"""
dparts as (select ticker, fiscal_period, period_end,
   max(case when concept = 'us-gaap:LongTermDebtNoncurrent' then numeric_value end) as non,
   max(case when concept in ('us-gaap:LongTermDebt', 'us-gaap:LongTermDebtAndCapitalLeaseObligations') then numeric_value end) as tot,
   max(case when concept in ('us-gaap:LongTermDebtCurrent', 'us-gaap:LongTermDebtAndCapitalLeaseObligationsCurrent') then numeric_value end) as cur
   from facts where unit = 'USD' group by all),
debt as (select ticker, 'long_term_debt' as metric_type, case when fiscal_period = 'FY' then 'annual' else 'quarterly' end as period_type,
   period_end, coalesce(non, case when tot >= cur then tot - cur end, tot) as value,
   case when fiscal_period = 'FY' then '10-K' else '10-Q' end as source from dparts),
over_ as (select s.* from stored s where metric_type <> 'long_term_debt' or not exists (
     select 1 from debt d where d.value is not null and d.ticker = s.ticker and d.period_type = s.period_type and d.period_end = s.period_end)
   union all select ticker, metric_type, period_type, period_end, value, source from debt where value is not null)"""
EXTRACT = COMPANY + "," + DEBT_SQL + "," + _sql_backfill("over_")


@query("p1_concept_map", f"""with {MAPPED} select metric_type, alias_rank, concept, count(*) as n, count(distinct ticker) as tickers
from mapped group by all""")
def p1(spark, d):
    return X.map_concepts(MP.facts(spark, d)).where(X.company_unit_ok()).groupBy(
        "metric_type", "alias_rank", "concept").agg(F.count("*").alias("n"), F.count_distinct("ticker").alias("tickers"))


@query("p5_duration_buckets", f"""with {O.facts()} select concept, coalesce({BUCKET}, 'none') as bucket, fiscal_period, count(*) as n
from facts group by all""")
def p5(spark, d):
    b = F.coalesce(K.duration_bucket(c("period_start"), c("period_end")), F.lit("none"))
    return MP.facts(spark, d).groupBy("concept", b.alias("bucket"), "fiscal_period").agg(F.count("*").alias("n"))


@query("d1_flow_decomposition", f"""with {COMPANY} select * from stored where {FLOW}""")
def d1(spark, d):
    flow_tags = [*MP.FACT_FLOWS.values(), MP.FACT_ALIAS[1]]
    rows = X.merged_company_rows(MP.facts(spark, d).where(c("concept").isin(flow_tags)))
    return rows.where(c("metric_type").isin(M.FLOW_METRICS)).select(
        "ticker", "metric_type", "period_type", "period_end", "value", "source")


@query("d3_stock_snapshots", f"""with {COMPANY} select * from stored where not {FLOW}""")
def d3(spark, d):
    rows = X.merged_company_rows(MP.facts(spark, d).where(c("concept").isin(list(MP.FACT_STOCKS.values()))))
    return rows.where(~c("metric_type").isin(M.FLOW_METRICS) & ~c("metric_type").startswith(X.DEBT)).select(
        "ticker", "metric_type", "period_type", "period_end", "value", "source")


@query("d7_canonical_debt", f"""with {O.facts()}, stored as (select null as ticker, null as metric_type, null as period_type,
  null::date as period_end, null::double as value, null as source), {DEBT_SQL}
select ticker, period_type, period_end, value from debt where value is not null""")
def d7(spark, d):
    debt = MP.facts(spark, d).where(c("concept").contains("LongTermDebt"))
    return X.extract_companies(debt).where(c("metric_type") == "long_term_debt").select(
        "ticker", "period_type", "period_end", "value")


@query("s2_slow_path", f"""with {EXTRACT} select ticker, metric_type, period_type, period_end, value, source from done""")
def s2(spark, d):
    return X.extract_companies(MP.facts(spark, d)).select(
        "ticker", "metric_type", "period_type", "period_end", "value", "source")


# A second, standardised source: quarterly values it covers win, the rest is filled.
STD_NAMES = ["revenue", "inventory"]
STD_SQL = f"""std_cells as (select l_suppkey, yr, qn, {", ".join(MP.sum_sql(n) + f" as {n}" for n in STD_NAMES)} from lines
    where l_linestatus = 'F' group by l_suppkey, yr, qn),
std as (select 'S' || l_suppkey as ticker, metric_type, 'quarterly' as period_type, last_day(make_date(yr, qn * 3, 1)) as period_end,
   cast(v as double) / cast(10000 as double) as value from (unpivot std_cells on {', '.join(STD_NAMES)} into name metric_type value v)
   where metric_type = 'revenue' or qn < 4)"""


def standardized(spark, d):
    sums = [F.expr(MP.sum_sql(n)).alias(n) for n in STD_NAMES]
    cells = MP.lines(spark, d).where("l_linestatus = 'F'").groupBy("l_suppkey", "yr", "qn").agg(*sums)
    long = cells.unpivot(["l_suppkey", "yr", "qn"], STD_NAMES, "concept", "v").where(c("v").isNotNull())
    start = F.make_date(c("yr"), c("qn") * 3 - 2, F.lit(1))
    label = F.when((c("concept") == "inventory") & (c("qn") == 4), "none").otherwise(F.concat(F.lit("Q"), c("qn")))
    return long.select(
        F.concat(F.lit("S"), c("l_suppkey")).alias("ticker"), c("l_suppkey").cast("string").alias("cik"), "concept",
        (c("v").cast("double") / F.lit(10000.0)).alias("numeric_value"), label.alias("fiscal_period"),
        c("yr").cast("int").alias("fiscal_year"), start.alias("period_start"),
        F.last_day(F.make_date(c("yr"), c("qn") * 3, F.lit(1))).alias("period_end"))


@query("j3_strategy_merge", f"""with {COMPANY}, {STD_SQL},
m as (select ticker, metric_type, period_type, period_end, value, 0 as p from std
  union all select ticker, metric_type, period_type, period_end, value, 1 from stored)
select ticker, metric_type, period_type, period_end, value from (
  select *, row_number() over (partition by ticker, metric_type, period_type, period_end order by p) as n from m) where n = 1""")
def j3(spark, d):
    rows = X.merged_company_rows(MP.facts(spark, d), standardized(spark, d))
    return rows.where(~c("metric_type").startswith(X.DEBT)).select(
        "ticker", "metric_type", "period_type", "period_end", "value")


@query("a9_coverage", f"""with {EXTRACT} select ticker, metric_type, period_type, count(*) as periods,
  min(period_end) as first_period, max(period_end) as last_period from done group by all""")
def a9(spark, d):
    return X.coverage(X.extract_companies(MP.facts(spark, d)))


@query("a10_missing_metrics", f"""with {EXTRACT}, e(metric_type) as (values {', '.join(f"('{m}')" for m in M.EXPECTED_METRICS)}),
t as (select distinct ticker from done)
select ticker, e.metric_type from t cross join e where not exists (
  select 1 from done where done.ticker = t.ticker and done.metric_type = e.metric_type)""")
def a10(spark, d):
    return X.missing_metrics(X.extract_companies(MP.facts(spark, d)))


# ------------------------------------------------------------ fast path
# One filing per company and fiscal year. Facts in a foreign unit stand in for
# dimensioned rows; total assets only exist with a dimension.

FILING_SQL = """ffacts as (select *, ticker || '-' || fiscal_year as accession,
  case when fiscal_year >= 1999 then '10-K/A' else '10-Q' end as form, 'iso4217-USD' as unit_ref,
  unit = 'EUR' or concept = 'us-gaap:Assets' as is_dimensioned from facts)"""


def filing_facts(spark, d):
    return MP.facts(spark, d).select(
        "*", F.concat_ws("-", "ticker", "fiscal_year").alias("accession"),
        F.when(c("fiscal_year") >= 1999, "10-K/A").otherwise("10-Q").alias("form"),
        F.lit("iso4217-USD").alias("unit_ref"),
        ((c("unit") == "EUR") | (c("concept") == "us-gaap:Assets")).alias("is_dimensioned"),
    ).drop("unit")


FAST = f"""{O.facts()}, {FILING_SQL}, {CONCEPTS},
dimless as (select f.*, bool_or(not is_dimensioned) over (partition by accession, concept) as has_total from ffacts f),
mapped as (select f.*, accession as k, metric_type, alias_rank, {BUCKET} as bucket from dimless f join concepts using (concept)
  where not has_total or not is_dimensioned),""" + DECOMPOSE.format(
    flow=FLOW, per_filing="true", tops=TOPS,
    annual_points="select ticker, k, metric_type, alias_rank, fiscal_year, 'annual', period_end, numeric_value from mapped "
                  f"where {FLOW} and bucket = 'annual'") + f""",
stored as (select ticker, k as accession, metric_type, period_type, period_end, {sign_sql('metric_type', 'v')} as value,
   case when cast(split_part(k, '-', 2) as int) >= 1999 then '10-K' else '10-Q' end as source from picked),
{_sql_backfill("stored", "accession")}"""


@query("p4_consolidated_only", f"""with {O.facts()}, {FILING_SQL},
d as (select *, bool_or(not is_dimensioned) over (partition by accession, concept) as has_total from ffacts)
select accession, concept, count(*) as n, max(numeric_value) as top from d where not has_total or not is_dimensioned group by all""")
def p4(spark, d):
    return X.consolidated_only(filing_facts(spark, d)).groupBy("accession", "concept").agg(
        F.count("*").alias("n"), F.max("numeric_value").alias("top"))


@query("d2_fast_path", f"""with {FAST} select ticker, accession, metric_type, period_type, period_end, value, source from done""")
def d2(spark, d):
    return X.extract_filings(filing_facts(spark, d)).select(
        "ticker", "accession", "metric_type", "period_type", "period_end", "value", "source")


# ------------------------------------------------------------ filings, ledger, store

FILINGS_SQL = """filings as (select cast(o_custkey as varchar) as cik, 'C' || o_custkey as ticker,
  lpad(cast(o_orderkey as varchar), 10, '0') as accession_number,
  case o_orderpriority when '1-URGENT' then '8-K' when '2-HIGH' then '10-Q' when '3-MEDIUM' then '10-K/A'
    when '4-NOT SPECIFIED' then '10-Q/A' else '10-K' end as form_type,
  cast(o_orderdate as date) as filing_date, o_orderstatus as status from orders)"""


def filings(spark, d):
    form = K.lookup(c("o_orderpriority"), {"1-URGENT": "8-K", "2-HIGH": "10-Q", "3-MEDIUM": "10-K/A", "4-NOT SPECIFIED": "10-Q/A", "5-LOW": "10-K"})
    return MP.table(spark, d, "orders").select(
        c("o_custkey").cast("string").alias("cik"), F.concat(F.lit("C"), c("o_custkey")).alias("ticker"),
        F.lpad(c("o_orderkey").cast("string"), 10, "0").alias("accession_number"), form.alias("form_type"),
        c("o_orderdate").cast("date").alias("filing_date"), c("o_orderstatus").alias("status"))


def ledger(spark, d):
    return filings(spark, d).where(c("status") == "F").select(
        "accession_number", "ticker", "form_type", c("filing_date").cast("string").alias("filed_date"))


@query("s4_filing_index", f"""with {FILINGS_SQL} select ticker, accession_number, form_type, filing_date from filings
where form_type in ('10-K', '10-K/A') and filing_date between date '1996-03-01' and date '1999-06-30'
order by filing_date desc, accession_number desc limit 200""")
def s4(spark, d):
    return RD.filing_index(filings(spark, d), form="10-K", start="1996-03-01", end="1999-06-30", limit=200).select(
        "ticker", "accession_number", "form_type", "filing_date")


@query("j1_known_ciks", f"""with {FILINGS_SQL}, ref as (select c_custkey, 'N' || c_nationkey || '-' || c_custkey as tk from customer where c_acctbal > 0)
select accession_number, tk as ticker, form_type from filings join ref on cast(cik as bigint) = c_custkey
where form_type in ({lst(M.TARGET_FORMS)})""")
def j1(spark, d):
    ref = MP.table(spark, d, "customer").where("c_acctbal > 0").select(
        c("c_custkey").alias("cik"), F.concat(F.lit("N"), c("c_nationkey"), F.lit("-"), c("c_custkey")).alias("ticker"))
    scoped = filings(spark, d).drop("ticker").where(c("form_type").isin(M.TARGET_FORMS))
    return RD.with_ticker(scoped, ref).select("accession_number", "ticker", "form_type")


@query("j2_new_filings", f"""with {FILINGS_SQL}, led as (select accession_number from filings where status = 'F')
select accession_number, ticker, form_type, filing_date from filings f where not exists (
  select 1 from led where led.accession_number = f.accession_number)""")
def j2(spark, d):
    f = filings(spark, d)
    return ST.new_accessions(f.unionByName(f.where("status = 'P'")), ledger(spark, d)).select(
        "accession_number", "ticker", "form_type", "filing_date")


@query("s11_ledger_merge", f"""with {FILINGS_SQL}
select accession_number, ticker, form_type, filing_date from filings where status in ('F', 'P')""")
def s11(spark, d):
    """Insert or ignore: what is in the ledger already stays as it is."""
    rows = filings(spark, d).withColumnRenamed("filing_date", "filed_date").withColumn("filed_date", c("filed_date").cast("string"))
    book = ST.Ledger(spark, jobs.work_folder(spark))
    book.mark(rows.where("status = 'F'"))
    again = rows.where("status = 'F'").withColumn("form_type", F.lit("changed"))
    book.mark(again.unionByName(rows.where("status = 'P'")))
    return book.read().select("accession_number", "ticker", "form_type", c("filed_date").cast("date").alias("filing_date"))


UPSERT = ["revenue", "net_income", "capex"]
LOG_SQL = f"""{O.metrics(UPSERT)},
log as (select ticker, metric_type, period_type, period_end, value, 1 as batch from metrics
  union all select ticker, metric_type, period_type, period_end, value * 2, 2 from metrics where source = '10-K'
  union all select ticker, metric_type, period_type, period_end, value * 4, 3 from metrics where metric_type = 'capex')"""


def upsert_log(spark, d):
    m = MP.metrics(spark, d, UPSERT).select("ticker", "metric_type", "period_type", "period_end", "value", "source")
    parts = [m.withColumn("batch", F.lit(1)),
             m.where("source = '10-K'").withColumns({"value": c("value") * 2, "batch": F.lit(2)}),
             m.where("metric_type = 'capex'").withColumns({"value": c("value") * 4, "batch": F.lit(3)})]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).drop("source")


@query("s8_latest_wins", f"""with {LOG_SQL} select ticker, metric_type, period_type, period_end, value, batch from (
  select *, row_number() over (partition by ticker, metric_type, period_type, period_end order by batch desc) as n from log) where n = 1""")
def s8(spark, d):
    return ST.newest_per_key(upsert_log(spark, d), M.PK, ["batch"])


@query("s9_delete_companies", f"""with {O.metrics(["revenue"])} select ticker, period_type, period_end, value from metrics
where ticker not in ('S1', 'S3')""")
def s9(spark, d):
    return ST.without_tickers(MP.metrics(spark, d, ["revenue"]), [" s1", "S3", "s3 ", ""]).select(
        "ticker", "period_type", "period_end", "value")


@query("s12_company_state", f"""with {FILINGS_SQL}, s as (select ticker, min(cik) as cik, bool_or(status = 'P') as again, bool_or(status = 'F') as first,
  ticker in (select ticker from filings where cik = '1') as gone from filings group by ticker)
select ticker, cik, case when again then 'fast_path' else 'slow_path' end as extraction_type from s where (first or again) and not gone""")
def s12(spark, d):
    """Two rounds of updates, the newer one wins; one company is deleted."""
    rows = filings(spark, d)
    state = ST.CompanyState(spark, jobs.work_folder(spark))
    state.update(rows.where("status = 'F'"), "slow_path")
    state.update(rows.where("status = 'P'"), "fast_path")
    state.delete(["c1"])
    return state.read().select("ticker", "cik", "extraction_type")


RAW_SIGNS = ["capex", "cash", "income_tax_expense", "revenue", "dividends_paid"]


def _unsigned(spark, d):
    # stored by an older writer: outflows positive, one balance negative
    m = MP.metrics(spark, d, RAW_SIGNS)
    return m.withColumn("value", F.when(c("metric_type").isin("cash", "capex"), -c("value")).otherwise(c("value")))


@query("s14_sign_report", f"""with {O.metrics(RAW_SIGNS)},
u as (select metric_type, case when metric_type in ('cash', 'capex') then -value else value end as v from metrics)
select case metric_type when 'capex' then 'negative_magnitude' when 'cash' then 'positive_magnitude' else 'sign_flip' end as rule,
  metric_type, count(*) as rows_changed from u where metric_type in ('capex', 'cash') and v <> 0 or metric_type = 'income_tax_expense' and v <> 0 group by all""")
def s14(spark, d):
    return ST.sign_report(_unsigned(spark, d))


@query("p9_signs_fixed", f"""with {O.metrics(RAW_SIGNS)}
select ticker, metric_type, period_type, period_end, case when metric_type = 'income_tax_expense' then 0.0::double - value else value end + 0.0::double as value
from metrics""")
def p9(spark, d):
    return ST.with_fixed_signs(_unsigned(spark, d)).select("ticker", "metric_type", "period_type", "period_end", "value")


# ------------------------------------------------------------ flagship

FLAG_SQL = EXTRACT + """,
q as (select *, row_number() over (partition by ticker, metric_type order by period_end desc) as rn,
        max(period_end) over (partition by ticker) as tq from done where period_type = 'quarterly'),
g as (select ticker, metric_type, max(tq) as tq, max(period_end) as newest,
        max(case when rn = 1 then value end) + max(case when rn = 2 then value end)
        + max(case when rn = 3 then value end) + max(case when rn = 4 then value end) as s
      from q where rn <= 4 and metric_type in ('revenue', 'net_income') group by all),
w as (select ticker, max(case when metric_type = 'revenue' and date_diff('day', newest, tq) <= 130 then s end) as revenue,
        max(case when metric_type = 'net_income' and date_diff('day', newest, tq) <= 130 then s end) as net_income from g group by ticker)
select ticker, net_income / nullif(revenue, 0) as net_profit_margin from w where net_income / nullif(revenue, 0) is not null
order by net_profit_margin desc, ticker limit 20"""


@query("flagship_ttm_net_margin", f"with {FLAG_SQL}")
def flagship(spark, d):
    """Raw facts, decomposition, signs, merge, TTM with staleness, derived metrics, ratio, top 20."""
    rows = X.extract_companies(MP.facts(spark, d))
    return RO.top_ttm_ratio(T.ttm_wide(rows, names=["revenue", "net_income"]), "net_profit_margin", 20)
