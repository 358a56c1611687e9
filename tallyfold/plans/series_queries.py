"""Queries over the metric table, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold import model as M
from tallyfold.functions import ratios as R
from tallyfold.operators import ratio_ops as RO
from tallyfold.operators import series as S
from tallyfold.operators import ttm as T
from tallyfold.plans import mapping as MP
from tallyfold.plans import oracle_base as O

c = F.col
Q, A = M.QUARTERLY, M.ANNUAL
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def has(names):
    return [n for n in names if n in MP.MEASURES]


def lst(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


# ------------------------------------------------------------ SQL building blocks

_FALL = M.TTM_ANNUAL_FALLBACK


def ttm_sql(cut: str = "") -> str:
    """CTEs ``ttm0`` (stored metrics) and ``ttm`` (with derived metrics) on top of ``metrics``."""
    flows, stocks = has(M.FLOW_METRICS), has(M.STOCK_METRICS)
    where = f"and period_end <= date '{cut}'" if cut else ""
    flow_cols = ", ".join(
        f"max(case when metric_type = '{n}' and n4 = 4 and date_diff('day', newest, tq) <= 130 then s4 end) as {n}"
        for n in flows)
    stock_cols = ", ".join(f"max(case when metric_type = '{n}' then v1 end) as q_{n}" for n in stocks)
    fall = ", ".join(
        f"max(case when metric_type = '{n}' then value end) as a_{n}, "
        f"max(case when metric_type = '{n}' then period_end end) as d_{n}" for n in _FALL)
    picks = []
    for n in stocks:
        if n == "common_shares_outstanding":
            picks.append(f"coalesce(q_{n}, case when sq is null or date_diff('day', d_{n}, sq) <= 400 then a_{n} end) as {n}")
        elif n in _FALL:
            picks.append(f"coalesce(q_{n}, a_{n}) as {n}")
        else:
            picks.append(f"q_{n} as {n}")
    return f"""
tq0 as (
  select *, row_number() over (partition by ticker, metric_type order by period_end desc) as rn,
         max(period_end) over (partition by ticker) as tq
  from metrics where period_type = 'quarterly' {where}),
tq1 as (
  select ticker, metric_type, max(tq) as tq, max(period_end) as newest, count(*) as n4,
         max(case when rn = 1 then value end) as v1,
         max(case when rn = 1 then value end) + max(case when rn = 2 then value end)
           + max(case when rn = 3 then value end) + max(case when rn = 4 then value end) as s4
  from tq0 where rn <= 4 group by ticker, metric_type),
tq2 as (
  select ticker, {flow_cols}, {stock_cols},
         max(case when metric_type not in ({lst(M.FLOW_METRICS)}) then newest end) as sq
  from tq1 group by ticker),
ta as (
  select ticker, {fall} from (
    select *, row_number() over (partition by ticker, metric_type order by period_end desc) as rn
    from metrics where period_type = 'annual' and metric_type in ({lst(_FALL)}) {where}) where rn = 1
  group by ticker),
ttm0 as (
  select coalesce(tq2.ticker, ta.ticker) as ticker, {", ".join(flows)}, {", ".join(picks)}
  from tq2 full join ta on tq2.ticker = ta.ticker),
ttm as ({derived_sql("ttm0")})"""


def derived_sql(src: str, opex: bool = True, ar: bool = True) -> str:
    """Derived metrics over a wide relation; some inputs are not fetched on the period path."""
    oi = "coalesce(operating_income, gp + operating_expenses)" if opex else "operating_income"
    rec = "coalesce(accounts_receivable, 0) + " if ar else ""
    rec_ok = "accounts_receivable is not null or " if ar else ""
    skip = "gross_profit, ebitda, free_cash_flow, short_term_debt, operating_income"
    return f"""
  select * exclude (gp, {skip}),
    coalesce(ebitda, operating_income - depreciation_and_amortization,
             net_income - income_tax_expense - interest_expense - depreciation_and_amortization) as ebitda,
    coalesce(operating_cash_flow + capex, free_cash_flow) as free_cash_flow,
    gp as gross_profit, {oi} as operating_income,
    coalesce(short_term_debt, case when commercial_paper is not null or long_term_debt_current is not null
      then coalesce(commercial_paper, 0) + coalesce(long_term_debt_current, 0) end) as short_term_debt,
    case when {rec_ok} nontrade_receivables is not null
      then {rec} coalesce(nontrade_receivables, 0) end as total_receivables
  from (select *, coalesce(gross_profit,
          case when revenue <> 0 and abs(cost_of_revenue / revenue) between 0.2 and 0.95
               then revenue + cost_of_revenue end) as gp from {src})"""


RATIO_SQL = {
    "gross_profit_margin": "gross_profit / nullif(revenue, 0)",
    "operating_profit_margin": "operating_income / nullif(revenue, 0)",
    "pretax_profit_margin": "(net_income - income_tax_expense) / nullif(revenue, 0)",
    "net_profit_margin": "net_income / nullif(revenue, 0)",
    "ebitda_margin": "ebitda / nullif(revenue, 0)",
    "effective_tax_rate": "(-income_tax_expense) / nullif(net_income - income_tax_expense, 0)",
    "research_and_development_to_revenue": "abs(research_and_development) / nullif(revenue, 0)",
    "return_on_assets": "net_income / nullif(total_assets, 0)",
    "return_on_equity": "net_income / nullif(stockholders_equity, 0)",
    "return_on_capital_employed": "operating_income / nullif(total_assets - total_current_liabilities, 0)",
    "income_quality": "operating_cash_flow / nullif(net_income, 0)",
    "current_ratio": "total_current_assets / nullif(total_current_liabilities, 0)",
    "cash_ratio": "cash / nullif(total_current_liabilities, 0)",
    "financial_leverage_ratio": "total_assets / nullif(stockholders_equity, 0)",
    "asset_turnover": "revenue / nullif(total_assets, 0)",
    "payables_turnover": "abs(cost_of_revenue) / nullif(accounts_payable, 0)",
    "operating_cash_flow_ratio": "operating_cash_flow / nullif(total_current_liabilities, 0)",
    "operating_cash_flow_sales_ratio": "operating_cash_flow / nullif(revenue, 0)",
    "free_cash_flow_to_operating_cash_flow_ratio": "free_cash_flow / nullif(operating_cash_flow, 0)",
    "capital_expenditure_coverage_ratio": "operating_cash_flow / nullif(abs(capex), 0)",
    "dividend_payout_ratio": "abs(dividends_paid) / nullif(net_income, 0)",
    "dividend_paid_and_capex_coverage_ratio":
        "operating_cash_flow / nullif(abs(coalesce(dividends_paid, 0)) + abs(coalesce(capex, 0)), 0)",
    "interest_coverage_ratio": "operating_income / nullif(abs(interest_expense), 0)",
    "revenue_per_share": "revenue / nullif(common_shares_outstanding, 0)",
    "net_income_per_share": "net_income / nullif(common_shares_outstanding, 0)",
    "cash_per_share": "(cash + coalesce(short_term_investments, 0)) / nullif(common_shares_outstanding, 0)",
    "book_value_per_share": "stockholders_equity / nullif(common_shares_outstanding, 0)",
    "operating_cash_flow_per_share": "operating_cash_flow / nullif(common_shares_outstanding, 0)",
    "free_cash_flow_per_share": "free_cash_flow / nullif(common_shares_outstanding, 0)",
    "working_capital": "total_current_assets - total_current_liabilities",
    "net_debt": "case when long_term_debt is not null or short_term_debt is not null then "
                "coalesce(long_term_debt, 0) + coalesce(short_term_debt, 0) - coalesce(cash, 0) end",
}


def ratio_cols(names=None) -> str:
    return ", ".join(f"{RATIO_SQL[n]} as {n}" for n in (names or R.NAMES))


def base_sql(period_type: str) -> str:
    """CTE ``base``: wide rows with split-adjusted shares (annual) and derived metrics."""
    need = has(R.required_metrics())
    wide = f"""pw as (select ticker, period_end, {O.pick(need)} from metrics
      where period_type = '{period_type}' and metric_type in ({lst(need)}) group by ticker, period_end)"""
    if period_type == A:
        s = "common_shares_outstanding"
        wide += f""",
    sp as (select ticker, period_end, case when jump >= 3 then round_even(jump, 0) else 1 end as f from (
        select ticker, period_end, {s} / lag({s}) over (partition by ticker order by period_end) as jump
        from pw where {s} > 0)),
    adj as (select ticker, period_end, coalesce(product(f) over (
        partition by ticker order by period_end rows between 1 following and unbounded following), 1) as k from sp),
    pa as (select pw.* replace (case when {s} > 0 then {s} * adj.k else {s} end as {s})
        from pw left join adj using (ticker, period_end))"""
        src = "pa"
    else:
        src = "pw"
    return f"{wide},\nbase as ({derived_sql(src, opex=False, ar=False)})"


METRICS_SQL = O.metrics()
WITH = f"with {METRICS_SQL}"

# ------------------------------------------------------------ series


@query("s1_metric_scan", f"""with {O.metrics(["revenue", "net_income"])}
select ticker, metric_type, value, period_end from metrics where period_type = 'quarterly'""")
def s1(spark, d):
    return S.timeseries(MP.metrics(spark, d, ["revenue", "net_income"], (Q,)), ["revenue", "net_income"], Q)


@query("a11_tickers", f"{WITH} select distinct ticker from metrics order by ticker")
def a11(spark, d):
    return S.all_tickers(MP.metrics(spark, d))


@query("a11_table_stats", f"""{WITH} select count(*) as row_count, count(distinct ticker) as ticker_count,
  count(distinct metric_type) as metric_count, min(period_end) as first_period, max(period_end) as last_period
  from metrics""")
def a11_stats(spark, d):
    return S.table_stats(MP.metrics(spark, d))


@query("a12_pivot_income", f"""with {O.metrics(M.INCOME_METRICS)}
select ticker, period_end, {O.pick(has(M.INCOME_METRICS))} from metrics where period_type = 'annual'
group by ticker, period_end""")
def a12(spark, d):
    return S.pivot_metrics(MP.metrics(spark, d, M.INCOME_METRICS), has(M.INCOME_METRICS), A)


@query("a12_pivot_balance", f"""with {O.metrics(M.BALANCE_METRICS)}
select ticker, period_end, {O.pick(has(M.BALANCE_METRICS))} from metrics where period_type = 'quarterly'
group by ticker, period_end""")
def a12b(spark, d):
    return S.pivot_metrics(MP.metrics(spark, d, M.BALANCE_METRICS, (Q,)), has(M.BALANCE_METRICS), Q)


@query("a13_melt", f"""with {O.metrics(["revenue", "ebitda"])}
select ticker, period_end, metric_type, value from metrics where period_type = 'quarterly'""")
def a13(spark, d):
    names = ["revenue", "ebitda"]
    return S.melt(S.pivot_metrics(MP.metrics(spark, d, names, (Q,)), names, Q), names, ["ticker", "period_end"])


@query("w1_latest_values", f"""{WITH} select ticker, metric_type, value, period_end from (
  select *, row_number() over (partition by ticker, metric_type order by period_end desc) as rn
  from metrics where period_type = 'annual') where rn = 1""")
def w1(spark, d):
    return S.latest_values(MP.metrics(spark, d), A)


@query("w2_top_companies", f"""with {O.metrics(["revenue"])} select ticker, value, period_end from (
  select *, row_number() over (partition by ticker order by period_end desc) as rn
  from metrics where period_type = 'annual') where rn = 1 order by value desc, ticker limit 20""")
def w2(spark, d):
    return S.top_companies(MP.metrics(spark, d, ["revenue"]), "revenue", A, 20)


def _growth_sql(names, period_type, step):
    cols = ", ".join(
        f"({n} / nullif(lag({n}, {step}) over w, 0) - 1) * 100 as {n}" for n in names)
    some = " or ".join(
        f"(a.{n} is not null and b.{n} is not null and not (a.{n} = 0 and b.{n} = 0))" for n in names)
    return f"""with {O.metrics(names)},
p as (select ticker, period_end, {O.pick(names)},
        row_number() over (partition by ticker order by period_end) as rn
      from metrics where period_type = '{period_type}' group by ticker, period_end)
select a.ticker, a.period_end, {", ".join(f"(a.{n} / nullif(b.{n}, 0) - 1) * 100 as {n}" for n in names)}
from p a join p b on a.ticker = b.ticker and a.rn = b.rn + {step} where {some}"""


@query("w7_growth_annual", _growth_sql(M.GROWTH_METRICS, A, 1))
def w7a(spark, d):
    return S.growth_rates(MP.metrics(spark, d, M.GROWTH_METRICS), M.GROWTH_METRICS, A)


@query("w7_growth_quarterly", _growth_sql(["interest_expense", "ebitda"], Q, 4))
def w7q(spark, d):
    names = ["interest_expense", "ebitda"]
    return S.growth_rates(MP.metrics(spark, d, names, (Q,)), names, Q)


@query("w10_newest_rows", f"""with {O.metrics(["revenue", "interest_expense"])}
select ticker, metric_type, value, period_end, rn as rank from (
  select *, row_number() over (partition by ticker, metric_type order by period_end desc) as rn
  from metrics where period_type = 'quarterly') where rn <= 3""")
def w10(spark, d):
    names = ["revenue", "interest_expense"]
    return S.newest_rows(MP.metrics(spark, d, names, (Q,)), names, 3, Q)


@query("j12_company_profile", f"""{WITH}, l as (
  select * from (select *, row_number() over (partition by ticker, metric_type order by period_end desc) as rn
  from metrics where period_type = 'annual') where rn = 1),
 g as (select ticker, count(*) as n_metrics, max(period_end) as last_period,
         max(case when metric_type = 'revenue' then value end) as revenue from l group by ticker)
select 'S' || s_suppkey as ticker, s_name as name, n_name as state, n_metrics, last_period, revenue
from supplier join nation on s_nationkey = n_nationkey left join g on g.ticker = 'S' || s_suppkey""")
def j12(spark, d):
    companies = MP.table(spark, d, "supplier").join(
        MP.table(spark, d, "nation"), c("s_nationkey") == c("n_nationkey")
    ).select(F.concat(F.lit("S"), c("s_suppkey").cast("string")).alias("ticker"),
             c("s_name").alias("name"), c("n_name").alias("state"))
    p = S.company_profiles(MP.metrics(spark, d), companies)
    return p.select("ticker", "name", "state", F.when(c("latest_metrics").isNotNull(), F.size("latest_metrics")).cast("long").alias("n_metrics"),
                    "last_period", c("latest_metrics")["revenue"].alias("revenue"))


# ------------------------------------------------------------ cash flow

CF = has(M.CASHFLOW_METRICS)
CF_SQL = f"""with {O.metrics(CF)},
cf as (select * replace (coalesce(operating_cash_flow + capex, free_cash_flow) as free_cash_flow) from (
  select ticker, period_end, {O.pick(CF)} from metrics where period_type = '@type' group by ticker, period_end))"""


@query("d13_cashflow_pivot", CF_SQL.replace('@type', Q) + f" select ticker, period_end, {', '.join(CF)} from cf")
def d13(spark, d):
    return S.cashflow_pivot(MP.metrics(spark, d, CF, (Q,)), Q).select("ticker", "period_end", *CF)


@query("d13_cashflow_series", CF_SQL.replace('@type', A) + f"""
select ticker, period_end, metric_type, value from (unpivot cf on {', '.join(CF)} into name metric_type value value)""")
def d13s(spark, d):
    return S.cashflow_timeseries(MP.metrics(spark, d, CF), A)


@query("d16_fcf_ranking", CF_SQL.replace('@type', A) + """
select ticker, period_end, free_cash_flow, row_number() over (order by free_cash_flow desc, ticker) as rank
from (select *, row_number() over (partition by ticker order by period_end desc) as rn from cf
      where free_cash_flow is not null) where rn = 1""")
def d16(spark, d):
    return S.fcf_ranking(MP.metrics(spark, d, CF))


@query("d17_fcf_vs_capex", CF_SQL.replace('@type', A) + """,
f as (select ticker, max(period_end) as fd, arg_max(free_cash_flow, period_end) as f from cf where free_cash_flow is not null group by ticker),
k as (select ticker, abs(arg_max(capex, period_end)) as k from cf where capex is not null group by ticker)
select ticker, fd as period_end, f as free_cash_flow, k as capex, f - k as difference,
       f / nullif(k, 0) * 100 as coverage_pct from f join k using (ticker)""")
def d17(spark, d):
    return S.fcf_versus_capex(MP.metrics(spark, d, CF))


# ------------------------------------------------------------ TTM

@query("w3_ttm_flows", f"""{WITH}, {ttm_sql()} select ticker, {', '.join(n for n in has(M.FLOW_METRICS)
    if n not in ('ebitda', 'free_cash_flow', 'gross_profit', 'operating_income'))} from ttm0""")
def w3(spark, d):
    cols = [n for n in has(M.FLOW_METRICS) if n not in ("ebitda", "free_cash_flow", "gross_profit", "operating_income")]
    return T.ttm_wide(MP.metrics(spark, d)).select("ticker", *cols)


@query("w4_ttm_stocks", f"{WITH}, {ttm_sql()} select ticker, {', '.join(has(M.STOCK_METRICS))} from ttm0")
def w4(spark, d):
    raw = T.ttm_raw(MP.metrics(spark, d), ["ticker"])
    return raw.select("ticker", *has(M.STOCK_METRICS))


@query("w5_ttm_annual_fallback", f"""{WITH}, {ttm_sql('1996-02-15')}
select ticker, {', '.join(_FALL)} from ttm0""")
def w5(spark, d):
    raw = T.ttm_raw(MP.metrics(spark, d).where(c("period_end") <= F.lit("1996-02-15").cast("date")), ["ticker"])
    return raw.select("ticker", *_FALL)


D8_COLS = ["ebitda", "free_cash_flow", "gross_profit", "operating_income", "short_term_debt", "total_receivables"]


@query("d8_ttm_derived", f"{WITH}, {ttm_sql()} select ticker, {', '.join(D8_COLS)} from ttm")
def d8(spark, d):
    return T.ttm_wide(MP.metrics(spark, d)).select("ticker", *D8_COLS)


@query("w6_ttm_as_of", f"""{WITH}, {ttm_sql('1999-08-15')}
select ticker, revenue, net_income, interest_expense, free_cash_flow, total_assets, common_shares_outstanding from ttm""")
def w6(spark, d):
    return T.ttm_wide(MP.metrics(spark, d), as_of="1999-08-15").select(
        "ticker", "revenue", "net_income", "interest_expense", "free_cash_flow", "total_assets",
        "common_shares_outstanding")


@query("w6_ttm_many_dates", f"""with {O.metrics(["revenue", "interest_expense"])},
dates as (select distinct ticker, last_day(make_date(year(period_end), 6, 1)) as as_of from metrics),
k as (select m.*, as_of, max(m.period_end) over (partition by m.ticker, as_of) as tq,
        row_number() over (partition by m.ticker, as_of, metric_type order by m.period_end desc) as rn
      from metrics m join dates on m.ticker = dates.ticker and m.period_end <= as_of where period_type = 'quarterly'),
g as (select ticker, as_of, metric_type, max(tq) as tq, max(period_end) as newest, count(*) as n,
        max(case when rn = 1 then value end) + max(case when rn = 2 then value end)
        + max(case when rn = 3 then value end) + max(case when rn = 4 then value end) as s
      from k where rn <= 4 group by all)
select ticker, as_of,
  max(case when metric_type = 'revenue' and date_diff('day', newest, tq) <= 130 then s end) as revenue,
  max(case when metric_type = 'interest_expense' and date_diff('day', newest, tq) <= 130 then s end) as interest_expense
from g group by ticker, as_of""")
def w6m(spark, d):
    m = MP.metrics(spark, d, ["revenue", "interest_expense"])
    dates = m.select("ticker", F.last_day(F.make_date(F.year("period_end"), F.lit(6), F.lit(1))).alias("as_of"))
    return T.ttm_wide_at(m, dates).select("ticker", "as_of", "revenue", "interest_expense")


DETAIL = ["revenue", "interest_expense", "gross_profit"]


def _detail_sql(n):
    qs = ", ".join(f"max(case when rn = {i} then value end) as q{i}" for i in range(1, n + 1))
    ls = ", ".join(f"max(case when rn = {i} then period end) as q{i}_label" for i in range(1, n + 1))
    names = ", ".join(f"q{i}" for i in range(1, n + 1)) + ", " + ", ".join(f"q{i}_label" for i in range(1, n + 1))
    return f"""{WITH}, {ttm_sql()},
w as (select * from (select ticker, period_end, min(period) as period,
        row_number() over (partition by ticker order by period_end desc) as rn
      from metrics where period_type = 'quarterly' and metric_type in ({lst(DETAIL)}) group by ticker, period_end)
      where rn <= {n}),
ask as (select * from (values {', '.join(f"('{x}', {i + 1})" for i, x in enumerate(DETAIL))}) t(metric_type, position)),
grid as (select w.ticker, ask.metric_type, position, rn, w.period_end, w.period, value from w cross join ask
  left join metrics m on m.ticker = w.ticker and m.period_end = w.period_end and m.metric_type = ask.metric_type
    and m.period_type = 'quarterly'),
rows_ as (select ticker, metric_type, max(position) as position, {qs}, {ls},
    max(period_end) as window_end from grid group by ticker, metric_type),
newest as (select ticker, metric_type, max(period_end) as metric_end from metrics
  where period_type = 'quarterly' group by ticker, metric_type),
tl as (select ticker, metric_type, ttm from (unpivot (select ticker, {', '.join(DETAIL)} from ttm)
   on {', '.join(DETAIL)} into name metric_type value ttm))
select ticker, metric_type, position, case when metric_end = window_end then ttm end as ttm, {names}
from rows_ left join newest using (ticker, metric_type) left join tl using (ticker, metric_type)"""


@query("d14_quarterly_detail", _detail_sql(4))
def d14(spark, d):
    m = MP.metrics(spark, d)
    return S.quarterly_detail(m, DETAIL, T.ttm_long(T.ttm_wide(m)), 4)


# ------------------------------------------------------------ ratios

@query("d10_ratios_annual", f"""{WITH}, {base_sql(A)}
select ticker, period_end, 'annual' as period_type, ratio_name, value from (
  unpivot (select ticker, period_end, {ratio_cols()} from base) on {', '.join(R.NAMES)} into name ratio_name value value)""")
def d10(spark, d):
    return RO.ratios_long(MP.metrics(spark, d), A).drop("period")


@query("d11_ratios_wide_quarterly", f"{WITH}, {base_sql(Q)} select ticker, period_end, {ratio_cols()} from base")
def d11(spark, d):
    return RO.ratios_wide(MP.metrics(spark, d, R.required_metrics(), (Q,)), Q).drop("period")


@query("w8_split_adjusted_shares", f"""with {O.metrics(R.required_metrics())}, {base_sql(A)}
select ticker, period_end, common_shares_outstanding from base where common_shares_outstanding is not null""")
def w8(spark, d):
    names = ["common_shares_outstanding"]
    wide = S.pivot_metrics(MP.metrics(spark, d, names), names, A)
    return RO.split_adjusted(wide).select("ticker", "period_end", *names)


@query("w9_latest_ratios", f"""{WITH}, {base_sql(A)},
r as (select * from (unpivot (select ticker, period_end, {ratio_cols()} from base) on {', '.join(R.NAMES)}
      into name ratio_name value value))
select ticker, period_end, ratio_name, value from (
  select *, max(period_end) over (partition by ticker) as last_end from r) where period_end = last_end""")
def w9(spark, d):
    return RO.latest_ratios(MP.metrics(spark, d), A)


@query("d11_ttm_ratios", f"""{WITH}, {ttm_sql()}
select ticker, ratio_name, value from (unpivot (select ticker, {ratio_cols()} from ttm) on {', '.join(R.NAMES)}
  into name ratio_name value value)""")
def d11t(spark, d):
    return RO.ttm_ratios(T.ttm_wide(MP.metrics(spark, d)))


@query("d11_ttm_ratios_as_of", f"""{WITH}, {ttm_sql('1998-12-31')}
select ticker, ratio_name, value from (unpivot (select ticker, {ratio_cols()} from ttm) on {', '.join(R.NAMES)}
  into name ratio_name value value)""")
def d11a(spark, d):
    return RO.ttm_ratios(T.ttm_wide(MP.metrics(spark, d), as_of="1998-12-31"))


D12_SQL = "with reg(ratio_name, category, display_format) as (values " + ", ".join(
    f"('{r.name}', '{r.category}', '{r.display_format}')" for r in R.REGISTRY) + ")"


@query("d12_ratio_coverage", D12_SQL + f""", {METRICS_SQL}, {base_sql(A)},
r as (select * from (unpivot (select ticker, period_end, {ratio_cols()} from base) on {', '.join(R.NAMES)}
      into name ratio_name value value))
select category, display_format, ratio_name, count(value) as n, count(distinct ticker) as tickers
from reg left join r using (ratio_name) group by all""")
def d12(spark, d):
    found = RO.ratios_long(MP.metrics(spark, d), A).groupBy("ratio_name").agg(
        F.count("value").alias("n"), F.count_distinct("ticker").alias("tickers"))
    return R.registry_table(spark).join(found, "ratio_name", "left").select(
        "category", "display_format", "ratio_name",
        F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("tickers", F.lit(0)).alias("tickers"))


# ------------------------------------------------------------ margins and views

@query("d15_quarterly_margins", f"""with {O.metrics(M.GROWTH_METRICS)},
p as (select ticker, period_end, {O.pick(M.GROWTH_METRICS)} from metrics where period_type = 'quarterly' group by ticker, period_end)
select ticker, period_end, revenue, gross_profit, gross_profit / revenue as gross_margin, operating_income,
  operating_income / revenue as operating_margin, net_income, net_income / revenue as net_margin
from p where revenue <> 0""")
def d15(spark, d):
    return S.quarterly_margins(MP.metrics(spark, d, M.GROWTH_METRICS, (Q,)))


NM = """nm as (select *, net_income / revenue as net_margin from (
  select ticker, period_end, max(case when metric_type = 'revenue' then value end) as revenue,
    max(case when metric_type = 'net_income' then value end) as net_income,
    row_number() over (partition by ticker order by period_end desc) as rn
  from metrics where period_type = 'quarterly' and metric_type in ('revenue', 'net_income') group by ticker, period_end
  having max(case when metric_type = 'revenue' then value end) is not null)
  where rn <= 8 and revenue <> 0 and net_income is not null)"""


@query("w13_bull_bear", f"""{WITH}, {ttm_sql()}, {NM},
b as (select * from (select *, row_number() over (partition by ticker order by net_margin desc, period_end desc) as k from nm) where k = 1),
w as (select * from (select *, row_number() over (partition by ticker order by net_margin, period_end) as k from nm) where k = 1)
select b.ticker, b.period_end as bull_period_end, b.net_margin as bull_net_margin,
  case when free_cash_flow < 0 then 'ttm_free_cash_flow' else 'weakest_quarter' end as bear_kind,
  case when free_cash_flow < 0 then free_cash_flow else w.net_margin end as bear_value,
  case when free_cash_flow < 0 then null else w.period_end end as bear_period_end
from b join w on b.ticker = w.ticker left join ttm on ttm.ticker = b.ticker""")
def w13(spark, d):
    m = MP.metrics(spark, d)
    return S.bull_bear(m, T.ttm_wide(m))


@query("w14_margin_trend", f"""with {O.metrics(["revenue", "net_income"])}, {NM}
select ticker, count(*) as quarters, min(period_end) as oldest_period_end, arg_min(net_margin, period_end) as oldest_net_margin,
  max(period_end) as newest_period_end, arg_max(net_margin, period_end) as newest_net_margin,
  case when arg_max(net_margin, period_end) > arg_min(net_margin, period_end) then 'improving overall'
       else 'not improving overall' end as direction
from nm group by ticker""")
def w14(spark, d):
    return S.margin_trend(MP.metrics(spark, d, ["revenue", "net_income"], (Q,)))


@query("w14_growth_and_margin", f"""with {O.metrics(["revenue", "net_income"])},
p as (select ticker, period_end, {O.pick(["revenue", "net_income"])},
   row_number() over (partition by ticker order by period_end) as rn
   from metrics where period_type = 'annual' group by ticker, period_end),
s as (select a.ticker, 'revenue_growth_pct' as series, a.period_end, (a.revenue / nullif(b.revenue, 0) - 1) * 100 as value
      from p a join p b on a.ticker = b.ticker and a.rn = b.rn + 1
      union all select ticker, 'net_margin_pct', period_end, net_income / nullif(revenue, 0) * 100 from p),
l as (select *, row_number() over (partition by ticker, series order by period_end desc) as k from s where value is not null)
select ticker, series, count(*) as periods, min(period_end) as first_period_end, arg_min(value, period_end) as first_value,
  max(period_end) as last_period_end, arg_max(value, period_end) as last_value
from l where k <= 4 group by ticker, series having count(*) >= 2""")
def w14b(spark, d):
    return S.annual_growth_and_margin(MP.metrics(spark, d, ["revenue", "net_income"], (Q, A)))


H = RO.HEALTH_INPUTS


def _score(x, lo, hi):
    return f"case when {x} is null then 0.0::double else (greatest({lo}, least({hi}, {x})) - {lo}) / ({hi} - {lo})::double * 100 end"


@query("d18_health_scores", f"""{WITH}, {ttm_sql()}, {base_sql(A)},
r as (select * from (unpivot (select ticker, period_end, {ratio_cols()} from base) on {', '.join(R.NAMES)}
      into name ratio_name value value)),
l as (select * from (select *, max(period_end) over (partition by ticker) as e from r) where period_end = e),
w as (select ticker, {', '.join(f"max(case when ratio_name = '{n}' then value end) as {n}" for n in H)} from l group by ticker),
t as (select ticker, {RATIO_SQL['interest_coverage_ratio']} as tc from ttm),
s as (select w.ticker, {_score('current_ratio', '0.0::double', '3.0::double')} as current_ratio,
  greatest(0.0::double, 100 - ({_score('financial_leverage_ratio', '0.0::double', '10.0::double')})) as financial_leverage_ratio,
  {_score('coalesce(interest_coverage_ratio, tc)', '0.0::double', '20.0::double')} as interest_coverage_ratio,
  {_score('gross_profit_margin', '0.0::double', '1.0::double')} as gross_profit_margin,
  {_score('return_on_equity', '0.0::double', '0.4::double')} as return_on_equity,
  {_score('free_cash_flow_to_operating_cash_flow_ratio', '0.0::double', '1.0::double')} as free_cash_flow_to_operating_cash_flow_ratio
  from w left join t on w.ticker = t.ticker)
select ticker, ratio_name, score, case when score >= 60 then 'green' when score >= 30 then 'amber' else 'red' end as light
from (unpivot s on {', '.join(H)} into name ratio_name value score)""")
def d18(spark, d):
    m = MP.metrics(spark, d)
    return RO.health_scores(RO.latest_ratios(m), RO.ttm_ratios_wide(T.ttm_wide(m)))


KEY = has(M.KEY_METRICS)


@query("d19_kpi_cards", f"""{WITH}, {ttm_sql()},
l as (select ticker, metric_type, arg_max(value, period_end) as latest from metrics
      where period_type = 'annual' and metric_type in ({lst(KEY)}) group by all),
t as (select ticker, metric_type, ttm from (unpivot (select ticker, {', '.join(KEY)} from ttm) on {', '.join(KEY)} into name metric_type value ttm)),
p as (select ticker, period_end, {O.pick(KEY)}, row_number() over (partition by ticker order by period_end) as rn
      from metrics where period_type = 'annual' and metric_type in ({lst(KEY)}) group by ticker, period_end),
g0 as (select a.ticker, a.period_end, {", ".join(f"(a.{n} / nullif(b.{n}, 0) - 1) * 100 as {n}" for n in KEY)}
       from p a join p b on a.ticker = b.ticker and a.rn = b.rn + 1
       where {" or ".join(f"(a.{n} is not null and b.{n} is not null and not (a.{n} = 0 and b.{n} = 0))" for n in KEY)}),
g as (select ticker, metric_type, gp from (unpivot (select {', '.join(KEY)}, ticker from (
   select *, row_number() over (partition by ticker order by period_end desc) as k from g0) where k = 1)
   on {', '.join(KEY)} into name metric_type value gp))
select ticker, metric_type, coalesce(ttm, latest) as value, gp / 100 as change
from l full join t using (ticker, metric_type) left join g using (ticker, metric_type)""")
def d19(spark, d):
    m = MP.metrics(spark, d)
    return S.kpi_cards(m.where(c("metric_type") != "eps_diluted"), T.ttm_long(T.ttm_wide(m)))


@query("d20_statement_table", f"""{WITH}, {ttm_sql()},
p as (select ticker, period_end, row_number() over (partition by ticker order by period_end desc) as rn
  from (select distinct ticker, period_end from metrics where period_type = 'annual' and metric_type in ({lst(CF)}))),
m2 as (select m.ticker, metric_type, rn, value from metrics m join p on m.ticker = p.ticker and m.period_end = p.period_end
  where period_type = 'annual' and metric_type in ({lst(CF)})),
v as (select ticker, metric_type, {", ".join(f"max(case when rn = {i} then value end) as p{i}" for i in range(1, 5))}
  from m2 where rn <= 4 group by all),
grid as (select distinct p.ticker, x.metric_type from p cross join (values {', '.join(f"('{n}')" for n in CF)}) x(metric_type)),
t as (select ticker, metric_type, ttm from (unpivot (select ticker, {', '.join(CF)} from ttm) on {', '.join(CF)} into name metric_type value ttm))
select ticker, metric_type, 'millions' as display_format, ttm, p1, p2, p3, p4
from grid left join v using (ticker, metric_type) left join t using (ticker, metric_type)""")
def d20(spark, d):
    m = MP.metrics(spark, d)
    return S.statement_table(m, CF, T.ttm_long(T.ttm_wide(m)), A, 4)


@query("x1_metric_history", f"""with {O.metrics(["revenue", "ebitda"])}
select ticker, metric_type, period, period_end, value,
  round((value / nullif(lag(value, 4) over w, 0) - 1) * 100, 2) as yoy_growth_pct,
  round((value / nullif(lag(value, 1) over w, 0) - 1) * 100, 2) as qoq_growth_pct
from metrics where period_type = 'quarterly' window w as (partition by ticker, metric_type order by period_end)""")
def x1(spark, d):
    names = ["revenue", "ebitda"]
    return S.metric_history(MP.metrics(spark, d, names, (Q,)), names)


@query("x2_margin_compression", f"""with {O.metrics(R.required_metrics())}, {base_sql(Q)},
m as (select ticker, period_end, gross_profit / nullif(revenue, 0) as margin from base
      where gross_profit / nullif(revenue, 0) is not null)
select ticker, period_end from (select *, (margin + coalesce(lag(margin, 1) over w, 0) + coalesce(lag(margin, 2) over w, 0)
   + coalesce(lag(margin, 3) over w, 0)) / least(4, row_number() over w) as a from m
   window w as (partition by ticker order by period_end)) where margin < a * 0.95""")
def x2(spark, d):
    rows = RO.ratios_long(MP.metrics(spark, d, R.required_metrics(), (Q,)), Q, ["gross_profit_margin"])
    return S.margin_compression(rows).select("ticker", "period_end")


@query("x3_peer_ranking", f"""with {O.metrics(["revenue"])},
g as (select ticker, period_end, value as latest_value, value / nullif(first_value(value) over (
   partition by ticker order by period_end rows between 3 preceding and current row), 0) - 1 as growth,
   row_number() over (partition by ticker order by period_end desc) as rn from metrics where period_type = 'quarterly')
select ticker, period_end, latest_value, growth, row_number() over (order by growth desc nulls last, ticker) as rank
from g where rn = 1""")
def x3(spark, d):
    return S.peer_growth_ranking(MP.metrics(spark, d, ["revenue"], (Q,)))


@query("x4_macro_series", """select indicator_id, date, value from (
 select event_type as indicator_id, cast(ts as date) as date, cast(sum(cast(round(value * 100) as bigint)) as double) / cast(100 as double) as value
 from events where event_type = 'purchase' group by all) order by date desc limit 20""")
def x4(spark, d):
    macro = MP.table(spark, d, "events").groupBy(
        c("event_type").alias("indicator_id"), c("ts").cast("date").alias("date")
    ).agg((F.sum(F.round(c("value") * 100).cast("long")).cast("double") / F.lit(100.0)).alias("value"))
    return S.macro_recent(macro, "purchase", 20)
