"""Queries that reconcile two sources, check quality, look up companies and follow relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold import model as M
from tallyfold.functions import columns as K
from tallyfold.functions import ratios as R
from tallyfold.operators import quality as Q
from tallyfold.operators import ratio_ops as RO
from tallyfold.operators import reconcile as RC
from tallyfold.operators import relations as RL
from tallyfold.operators import search as SE
from tallyfold.operators import series as S
from tallyfold.plans import mapping as MP
from tallyfold.plans import oracle_base as O
from tallyfold.plans.series_queries import RATIO_SQL, base_sql, lst
from tallyfold.sources import readers as RD

c = F.col
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


# ------------------------------------------------------------ source one: bulk statement data
# Values of a supplier's quarter in total and per return flag (segments); the
# segment of flag A belongs to a co-registrant. Suppliers with a negative
# balance have no ticker.

TAGS = {
    "net_income": ("NetIncomeLoss", "1"), "gross_profit": ("GrossProfit", "1"), "operating_income": ("OperatingIncomeLoss", "1"),
    "total_assets": ("Assets", "0"), "total_liabilities": ("Liabilities", "0"), "stockholders_equity": ("StockholdersEquity", "0"),
    "long_term_debt": ("LongTermDebt", "0"), "long_term_debt_current": ("LongTermDebtCurrent", "0"),
    "commercial_paper": ("CommercialPaper", "0"), "short_term_debt": ("DebtCurrent", "0"),
}
NAMES = list(TAGS)
SUMS = ", ".join(f"{MP.sum_sql(n)} as {n}" for n in NAMES)
METRIC_OF = {t: m for m, tags in M.DERA_TAGS.items() for t in tags}


def dera_raw(spark, d):
    """num.txt as text columns, with unreadable values and dates among them."""
    base = MP.lines(spark, d).groupBy("l_suppkey", "yr", "qn", "l_returnflag").agg(*[F.expr(MP.sum_sql(n)).alias(n) for n in NAMES])
    total = base.groupBy("l_suppkey", "yr", "qn").agg(*[F.sum(n).alias(n) for n in NAMES]).withColumn("l_returnflag", F.lit(None).cast("string"))
    long = base.unionByName(total).unpivot(["l_suppkey", "yr", "qn", "l_returnflag"], NAMES, "m", "v").where(c("v").isNotNull())
    day = F.date_format(F.last_day(F.make_date(c("yr"), c("qn") * 3, F.lit(1))), "yyyyMMdd")
    rows = long.select(
        F.concat_ws("-", "l_suppkey", "yr", "qn").alias("adsh"), K.lookup(c("m"), {n: t for n, (t, _) in TAGS.items()}).alias("tag"),
        F.when(c("l_returnflag") == "A", "CO").otherwise("").alias("coreg"), day.alias("ddate"),
        K.lookup(c("m"), {n: q for n, (_, q) in TAGS.items()}).alias("qtrs"),
        (c("v").cast("double") / F.lit(10000.0)).cast("string").alias("value"))
    junk = rows.where("coreg = 'CO'")
    return rows.unionByName(junk.withColumns({"coreg": F.lit(""), "value": F.lit("n/a")})).unionByName(
        junk.withColumns({"coreg": F.lit(""), "ddate": F.lit("20001399")}))


def dera_sub(spark, d):
    return MP.lines(spark, d).select("l_suppkey", "yr", "qn").distinct().select(
        F.concat_ws("-", "l_suppkey", "yr", "qn").alias("adsh"), c("l_suppkey").cast("long").alias("cik"),
        F.when(c("qn") == 4, "10-K").otherwise("10-Q").alias("form"),
        F.when(c("qn") == 4, "FY").otherwise(F.concat(F.lit("Q"), "qn")).alias("fp"))


def ticker_ref(spark, d):
    return MP.table(spark, d, "supplier").where("s_acctbal >= 0").select(
        c("s_suppkey").alias("cik"), F.concat(F.lit("S"), "s_suppkey").alias("ticker"))


NUM_SQL = f"""{O.LINES},
seg as (select l_suppkey, yr, qn, l_returnflag, {SUMS} from lines group by all),
tot as (select l_suppkey, yr, qn, cast(null as varchar) as l_returnflag, {", ".join(f"sum({n}) as {n}" for n in NAMES)} from seg group by all),
both_ as (select l_suppkey, yr, qn, l_returnflag, {", ".join(f"cast({n} as double) / cast(10000 as double) as {n}" for n in NAMES)} from (
   select * from seg union all by name select * from tot)),
num as (select l_suppkey, yr, qn, coalesce(l_returnflag, '') as flag, m, v, last_day(make_date(yr, qn * 3, 1)) as period_end
  from (unpivot both_ on {', '.join(NAMES)} into name m value v))"""
CAND_SQL = f"""{NUM_SQL},
cand as (select 'S' || l_suppkey as ticker, case m when 'long_term_debt' then '__long_term_debt_total' when 'long_term_debt_current' then '__long_term_debt_current'
   when 'commercial_paper' then '__commercial_paper' when 'short_term_debt' then '__debt_current' else m end as metric_type,
   case when qn = 4 and m not in ('net_income', 'gross_profit', 'operating_income') then 'annual' else 'quarterly' end as period_type, period_end, v as value
  from num join supplier on s_suppkey = l_suppkey where s_acctbal >= 0 and flag <> 'A')"""
POINTS_SQL = f"""{CAND_SQL},
res as (select ticker, metric_type, period_type, period_end, max_by(value, (abs(value), value)) as value from cand group by all),
w as (select ticker, period_type, period_end, {O.pick(NAMES[:6] + ['__long_term_debt_total', '__long_term_debt_current', '__commercial_paper', '__debt_current'])} from res group by all),
oi as (select cand.ticker, cand.period_type, cand.period_end, min(value) as oi from cand join w using (ticker, period_type, period_end)
  where metric_type = 'operating_income' and value > net_income and value < gross_profit group by all),
f as (select ticker, period_type, period_end, net_income, gross_profit, coalesce(oi, operating_income) as operating_income, total_assets, total_liabilities,
   case when stockholders_equity is not null and abs(total_assets - total_liabilities - stockholders_equity) > 1 then total_assets - total_liabilities else stockholders_equity end as stockholders_equity,
   case when coalesce(__long_term_debt_current, __debt_current) is null then __long_term_debt_total
        when __long_term_debt_total - coalesce(__long_term_debt_current, __debt_current) >= 0 then __long_term_debt_total - coalesce(__long_term_debt_current, __debt_current) end as long_term_debt,
   coalesce(__debt_current, case when __commercial_paper is not null or __long_term_debt_current is not null then coalesce(__commercial_paper, 0) + coalesce(__long_term_debt_current, 0) end) as short_term_debt
  from w left join oi using (ticker, period_type, period_end)),
points as (select ticker, metric_type, period_type, period_end, value from (unpivot f on net_income, gross_profit, operating_income, total_assets, total_liabilities,
   stockholders_equity, long_term_debt, short_term_debt into name metric_type value value))"""


@query("s6_bulk_rows_typed", f"""with {NUM_SQL} select m, count(*) as n, count(distinct l_suppkey) as companies,
  cast(sum(cast(v as decimal(38,6))) as double) as total from num group by m""")
def s6(spark, d):
    name = {t: n for n, (t, _) in TAGS.items()}
    rows = RD.dera_num_typed(dera_raw(spark, d))
    return rows.groupBy(K.lookup(c("tag"), name).alias("m")).agg(
        F.count("*").alias("n"), F.count_distinct(F.split("adsh", "-")[0]).alias("companies"),
        F.sum(c("value").cast("decimal(38,6)")).cast("double").alias("total"))


def candidates(spark, d):
    return RC.dera_candidates(RD.dera_num_typed(dera_raw(spark, d)), dera_sub(spark, d), ticker_ref(spark, d))


@query("j11_statement_candidates", f"with {CAND_SQL} select ticker, metric_type, period_type, period_end, value from cand")
def j11(spark, d):
    return candidates(spark, d)


@query("a3_resolved_candidates", f"""with {CAND_SQL} select ticker, metric_type, period_type, period_end, max_by(value, (abs(value), value)) as value
from cand group by all""")
def a3(spark, d):
    return RC.resolve_candidates(candidates(spark, d))


def points(spark, d):
    return RC.dera_points(candidates(spark, d))


@query("a4_repaired_points", f"with {POINTS_SQL} select * from points")
def a4(spark, d):
    return points(spark, d)


# ------------------------------------------------------------ source two: vendor statements
# The same company values, dated up to nine days earlier, one percent off for
# some companies, and without the debt metrics.

V_FIELDS = {"net_income": "netIncome", "total_assets": "totalAssets", "stockholders_equity": "totalStockholdersEquity",
            "gross_profit": "grossProfit", "capex": "capitalExpenditure", "common_shares_outstanding": "unknownField"}


def statements(spark, d):
    names = list(V_FIELDS)
    long = MP.cells(spark, d, names).unpivot(["l_suppkey", "yr", "qn"], names, "m", "v").where(c("v").isNotNull())
    day = F.date_sub(F.last_day(F.make_date(c("yr"), c("qn") * 3, F.lit(1))), (c("l_suppkey") % 10).cast("int"))
    off = F.when(c("l_suppkey") % 7 == 0, c("v") * 2).otherwise(c("v"))
    size = F.when(c("m") == "capex", -off).otherwise(off)
    return long.select(F.concat(F.lit("S"), "l_suppkey").alias("symbol"), day.alias("period_end"),
                       K.lookup(c("m"), V_FIELDS).alias("field"), (size.cast("double") / F.lit(10000.0)).alias("value"))


VENDOR_SQL = f"""vcells as (select l_suppkey, yr, qn, {", ".join(f"{MP.sum_sql(n)} as {n}" for n in V_FIELDS if n != 'common_shares_outstanding')} from lines group by all),
vendor as (select 'S' || l_suppkey as ticker, m as metric_type, 'quarterly' as period_type,
   last_day(make_date(yr, qn * 3, 1)) - cast(l_suppkey % 10 as integer) as period_end,
   cast(case when l_suppkey % 7 = 0 then v * 2 else v end as double) / cast(10000 as double) as value
  from (unpivot vcells on {', '.join(n for n in V_FIELDS if n != 'common_shares_outstanding')} into name m value v))"""


@query("s7_vendor_points", f"with {O.LINES}, {VENDOR_SQL} select * from vendor")
def s7(spark, d):
    return RC.vendor_points(statements(spark, d), "quarterly")


BOTH_SQL = f"{POINTS_SQL}, {VENDOR_SQL}"
PAIR_SQL = f"""{BOTH_SQL},
pairs as (select * from (select p.ticker, p.metric_type, p.period_type, p.period_end as l_period_end, p.value as l_value, v.period_end as r_period_end, v.value as r_value,
   abs(date_diff('day', p.period_end, v.period_end)) as days,
   row_number() over (partition by p.ticker, p.metric_type, p.period_type, p.period_end order by abs(date_diff('day', p.period_end, v.period_end)), v.period_end) as n
  from points p join vendor v on p.ticker = v.ticker and p.metric_type = v.metric_type and p.period_type = v.period_type
   and abs(date_diff('day', p.period_end, v.period_end)) <= 7) where n = 1),
agree as (select *, case when l_value <> 0 then abs(l_value - r_value) / abs(l_value) * 100 < 1 else r_value = 0 end as ok from pairs)"""


def vendor(spark, d):
    return RC.vendor_points(statements(spark, d), "quarterly")


@query("j7_matches_within_days", f"""with {PAIR_SQL} select ticker, metric_type, period_type, l_period_end, l_value, r_period_end, r_value, days from pairs""")
def j7(spark, d):
    return RC.source_matches(points(spark, d), vendor(spark, d))


@query("a7_cross_reference", f"""with {PAIR_SQL} select metric_type, period_type, count(*) as pairs, count(*) filter (ok) as matches,
  count(*) filter (not ok) as discrepancies from agree group by all""")
def a7(spark, d):
    return RC.cross_reference_counts(points(spark, d), vendor(spark, d))


MERGE_SQL = f"""{PAIR_SQL},
merged as (select p.ticker, p.metric_type, p.period_type, p.period_end, p.value, case when pairs.ticker is not null then 'both' else 'dera' end as source
   from points p left join pairs on p.ticker = pairs.ticker and p.metric_type = pairs.metric_type and p.period_type = pairs.period_type and p.period_end = l_period_end
  union all select ticker, metric_type, period_type, period_end, value, 'fmp' from vendor v where not exists (
    select 1 from pairs q where q.ticker = v.ticker and q.metric_type = v.metric_type and q.period_type = v.period_type and q.r_period_end = v.period_end)
   and not exists (select 1 from points p where p.ticker = v.ticker and p.metric_type = v.metric_type and p.period_type = v.period_type and p.period_end = v.period_end))"""


@query("j8_merged_sources", f"with {MERGE_SQL} select * from merged")
def j8(spark, d):
    return RC.merge_sources(points(spark, d), vendor(spark, d))


def _curation(spark, d):
    """Prefer the vendor where a company shipped nothing of flag A in the quarter; exclude capex of 1999."""
    quiet = MP.lines(spark, d).groupBy("l_suppkey", "yr", "qn").agg(F.count_if(c("l_returnflag") == "A").alias("n")).where("n <= 4")
    pref = quiet.select(F.concat(F.lit("S"), "l_suppkey").alias("ticker"), F.lit("net_income").alias("metric_type"),
                        F.lit("quarterly").alias("period_type"), F.last_day(F.make_date(c("yr"), c("qn") * 3, F.lit(1))).alias("period_end"))
    rules = MP.table(spark, d, "supplier").where("s_acctbal < 1000").select(
        F.concat(F.lit("S"), "s_suppkey").alias("ticker"), F.lit("total_assets").alias("metric_type"), F.lit("quarterly").alias("period_type"))
    left_out = MP.table(spark, d, "supplier").where("s_nationkey = 3").select(
        F.concat(F.lit("S"), "s_suppkey").alias("ticker"), F.lit("revenue").alias("metric_type"), F.lit("annual").alias("period_type"),
        F.lit("1997-12-31").cast("date").alias("period_end"))
    return pref, rules, left_out


def curated(spark, d):
    pref, rules, left_out = _curation(spark, d)
    merged = RC.merge_sources(points(spark, d), vendor(spark, d), keep_right=True)
    return RC.with_tolerance(RC.apply_curation(merged, pref, left_out, rules))


CUR_SQL = f"""{MERGE_SQL},
pref as (select 'S' || l_suppkey as ticker, last_day(make_date(yr, qn * 3, 1)) as period_end from lines group by l_suppkey, yr, qn
   having count(*) filter (l_returnflag = 'A') <= 4),
cur as (select m.ticker, m.metric_type, m.period_type, m.period_end, coalesce(v.value, m.value) as value,
    case when v.value is not null then 'fmp' else m.source end as source
   from merged m left join pref on m.metric_type = 'net_income' and m.period_type = 'quarterly' and pref.ticker = m.ticker and pref.period_end = m.period_end
   left join vendor v on pref.ticker = v.ticker and v.metric_type = m.metric_type and v.period_type = m.period_type and v.period_end = m.period_end
   where not (m.metric_type = 'revenue' and m.period_type = 'annual' and m.period_end = date '1997-12-31' and m.ticker in (select 'S' || s_suppkey from supplier where s_nationkey = 3))
   and not (m.metric_type = 'total_assets' and m.period_type = 'quarterly' and m.ticker in (select 'S' || s_suppkey from supplier where s_acctbal < 1000)))"""


@query("p28_curated_points", f"""with {CUR_SQL} select *, case when metric_type = 'eps_diluted' then 0.02 else 1.0 end as tolerance_pct from cur""")
def p28(spark, d):
    return curated(spark, d)


@query("a8_fiscal_year_totals", f"""with {O.metrics(M.GOLDEN_FLOW_METRICS)} select ticker, metric_type, period_end, value from metrics
where period_type = 'annual'""")
def a8(spark, d):
    return RC.fiscal_year_totals(MP.metrics(spark, d, M.GOLDEN_FLOW_METRICS))


EXPECTED = ["revenue", "capex", "net_income"]


@query("a24_expected_values", f"""with {O.metrics(EXPECTED)}, q as (select * from metrics where period_type = 'quarterly'),
e as (select ticker, metric_type, period_type, period_end - cast(cast(ticker[2:] as integer) % 10 as integer) as period_end,
  case when cast(ticker[2:] as integer) % 7 = 0 then value * 1.02 else value end as value from q),
k as (select e.*, q.value as actual, q.period_end as actual_end, row_number() over (partition by e.ticker, e.metric_type, e.period_end
   order by abs(date_diff('day', e.period_end, q.period_end)), q.period_end) as n
  from e left join q on e.ticker = q.ticker and e.metric_type = q.metric_type and abs(date_diff('day', e.period_end, q.period_end)) <= 7)
select ticker, metric_type, period_type, period_end, value as expected, actual, actual_end,
  coalesce(case when value <> 0 then abs(actual - value) / abs(value) * 100 <= 1 else actual = 0 end, false) as passes from k where n = 1""")
def a24(spark, d):
    m = MP.metrics(spark, d, EXPECTED, ("quarterly",))
    no = F.substring("ticker", 2, 20).cast("int")
    expected = m.select("ticker", "metric_type", "period_type", F.date_sub("period_end", no % 10).alias("period_end"),
                        F.when(no % 7 == 0, c("value") * 1.02).otherwise(c("value")).alias("value"), F.lit(1.0).alias("tolerance_pct"))
    return RC.check_expected(m, expected)


@query("a24_expected_ratios", f"""with {O.metrics(R.required_metrics())}, {base_sql('annual')},
r as (select ticker, period_end, {RATIO_SQL['net_profit_margin']} as v from base)
select ticker, 'net_profit_margin' as ratio_name, period_end - 3 as period_end, v * 1.04 as expected, v as actual,
  case when v * 1.04 = 0 then abs(v) < 0.001 else abs(v - v * 1.04) / abs(v * 1.04) * 100 <= 5 end as passes from r where v is not null""")
def a24r(spark, d):
    r = RO.ratios_long(MP.metrics(spark, d, R.required_metrics()), "annual", ["net_profit_margin"])
    expected = r.select("ticker", "ratio_name", F.date_sub("period_end", 3).alias("period_end"), (c("value") * 1.04).alias("value"), F.lit(5.0).alias("tolerance_pct"))
    return RC.check_ratios(r, expected)


# ------------------------------------------------------------ quality

@query("a23_quarters_vs_year", f"""with {O.metrics(["operating_income", "interest_expense"])},
g as (select ticker, metric_type, year(period_end) as yr, cast(sum(cast(case when period_type = 'quarterly' then value end as decimal(38,6))) as double) as quarter_sum,
  count(*) filter (period_type = 'quarterly') as quarters, max(case when period_type = 'annual' then value end) as annual_value from metrics group by all)
select * from g where quarters = 4 and abs(quarter_sum - annual_value) > -1""")
def a23(spark, d):
    return Q.quarters_off_total(MP.metrics(spark, d, ["operating_income", "interest_expense"]), ["operating_income", "interest_expense"], -1.0)


@query("a23_balance_breaks", f"""with {O.metrics(["total_assets", "total_liabilities", "retained_earnings"])},
w as (select ticker, period_end, {O.pick(["total_assets", "total_liabilities", "retained_earnings"])} from metrics where period_type = 'annual' group by all)
select ticker, period_end, total_assets, total_liabilities, retained_earnings as stockholders_equity,
  abs(total_assets - (total_liabilities + retained_earnings)) / nullif(total_assets, 0) * 100 as diff_pct from w
where abs(total_assets - (total_liabilities + retained_earnings)) / nullif(total_assets, 0) * 100 >= 10""")
def a23b(spark, d):
    m = MP.metrics(spark, d, ["total_assets", "total_liabilities", "retained_earnings"])
    renamed = m.withColumn("metric_type", F.when(c("metric_type") == "retained_earnings", "stockholders_equity").otherwise(c("metric_type")))
    return Q.balance_breaks(renamed)


@query("a23_income_order", f"""with {O.metrics(["net_income", "operating_income", "gross_profit"])},
w as (select ticker, period_end, {O.pick(["net_income", "operating_income", "gross_profit"])} from metrics where period_type = 'annual' group by all)
select * from w where gross_profit is not null and operating_income is not null and net_income is not null
  and not (net_income < operating_income and operating_income < gross_profit)""")
def a23i(spark, d):
    return Q.income_order_breaks(MP.metrics(spark, d, ["net_income", "operating_income", "gross_profit"]))


@query("a23_core_gaps", f"""with {O.metrics(["revenue", "interest_expense", "ebitda"])}, k as (select distinct ticker || '-' || year(period_end) as ticker, metric_type, period_type from metrics),
t as (select distinct ticker from k), want(missing) as (values ('revenue'), ('interest_expense'), ('ebitda'), ('annual'), ('quarterly'))
select ticker, missing from t cross join want where not exists (select 1 from k m where m.ticker = t.ticker and (metric_type = missing or period_type = missing))""")
def a23c(spark, d):
    """Every company's every year on its own, so that core metrics are really missing."""
    core = ["revenue", "interest_expense", "ebitda"]
    yearly = F.concat(c("ticker"), F.lit("-"), F.year("period_end").cast("string"))
    return Q.core_metric_gaps(MP.metrics(spark, d, core).withColumn("ticker", yearly), core)


@query("a23_label_breaks", f"""with {O.metrics(['revenue'])} select ticker, period_type, period_end, case period_type when 'annual' then 'Quarter' else 'Q' end || substr(period, 1, 0) as lead
from metrics where month(period_end) in (6, 12) and year(period_end) % 2 = 0""")
def a23l(spark, d):
    """Labels of every second year's June and December rows are broken; all others pass."""
    m = MP.metrics(spark, d, ["revenue"])
    broken = F.when(c("period_type") == "annual", F.regexp_replace("period", "^Twelve Months", "Quarter")).otherwise(F.regexp_replace("period", "^Quarter", "Q"))
    hit = F.month("period_end").isin(6, 12) & (F.year("period_end") % 2 == 0)
    rows = Q.label_breaks(m.withColumn("period", F.when(hit, broken).otherwise(c("period"))))
    return rows.select("ticker", "period_type", "period_end", F.split_part("period", F.lit(" "), F.lit(1)).alias("lead"))


# ------------------------------------------------------------ lookup

@query("p15_search_prefix", f"""with {O.metrics()} select distinct ticker from metrics where ticker like 'S1%' order by ticker limit 20""")
def p15(spark, d):
    return SE.search_companies(MP.metrics(spark, d), " s1 ", 20)


REQ_SQL = """req as (select distinct trim(r) as requested, trim(regexp_replace(regexp_replace(upper(r), '\\s+', '', 'g'), '[./]+', '-', 'g'), '-') as word from (
  select ' s' || s_suppkey || ' ' as r from supplier union all select 's.' || s_nationkey from supplier union all
  select n_name from nation union all select 'Customer#00000' || s_suppkey from supplier)),
tick as (select distinct replace(upper(c_name), '#', '-') as ticker from customer union select 'S' || s_suppkey from supplier where s_acctbal > 0)"""


def requests(spark, d):
    s, n = MP.table(spark, d, "supplier"), MP.table(spark, d, "nation")
    return (
        s.select(F.concat(F.lit(" s"), "s_suppkey", F.lit(" ")).alias("requested"))
        .unionByName(s.select(F.concat(F.lit("s."), "s_nationkey").alias("requested")))
        .unionByName(n.select(c("n_name").alias("requested")))
        .unionByName(s.select(F.concat(F.lit("Customer#00000"), "s_suppkey").alias("requested"))))


def ticker_universe(spark, d):
    return MP.table(spark, d, "customer").select(F.replace(F.upper("c_name"), F.lit("#"), F.lit("-")).alias("ticker")).union(
        MP.table(spark, d, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("S"), "s_suppkey"))).distinct()


@query("p16_ticker_keys", f"with {REQ_SQL} select requested, word from req")
def p16(spark, d):
    return requests(spark, d).select(F.trim("requested").alias("requested")).distinct().withColumn("word", K.ticker_key(c("requested")))


CLOSE = """select word, ticker, 1 - levenshtein(word, ticker) / greatest(length(word), length(ticker)) as score from {words}, {names}
  where word <> '' and 1 - levenshtein(word, ticker) / greatest(length(word), length(ticker)) >= 0.6 - 1e-9"""


@query("p17_resolve_tickers", f"""with {REQ_SQL},
m as (select requested, word, count(t.ticker) as n, min(t.ticker) as one, bool_or(t.ticker = word) as exact,
  array_to_string(list_sort(list(t.ticker) filter (t.ticker is not null))[1:5], ',') as prefixed from req left join tick t on starts_with(t.ticker, word) group by all),
s as ({CLOSE.format(words="(select distinct word from m where n = 0)", names="tick")}),
k as (select word, string_agg(ticker, ',' order by score desc, ticker desc) as close from (
  select *, row_number() over (partition by word order by score desc, ticker desc) as rn from s) where rn <= 5 group by word)
select requested, case when exact then word when n = 1 then one else word end as resolved, coalesce(exact, false) as exact,
  case when exact then word when n > 0 then prefixed else coalesce(close, '') end as candidates from m left join k using (word)""")
def p17(spark, d):
    return SE.resolve_tickers(requests(spark, d), ticker_universe(spark, d)).select(
        "requested", "resolved", "exact", F.concat_ws(",", "candidates").alias("candidates"))


@query("p17_close_matches", f"""with w as (select upper(n_name) as word from nation),
t as (select 'NATION-' || s_nationkey as ticker from supplier union select upper(replace(p_brand, '#', '')) from part union select upper(substr(n_name, 1, 5)) || 'E' from nation),
s as ({CLOSE.format(words="w", names="t")})
select word, ticker, score, rank from (select *, row_number() over (partition by word order by score desc, ticker desc) as rank from s) where rank <= 5""")
def p17c(spark, d):
    words = MP.table(spark, d, "nation").select(F.upper("n_name").alias("word"))
    names = MP.table(spark, d, "supplier").select(F.concat(F.lit("NATION-"), "s_nationkey").alias("ticker")).unionByName(
        MP.table(spark, d, "part").select(F.upper(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("ticker"))).unionByName(
        MP.table(spark, d, "nation").select(F.concat(F.upper(F.substring("n_name", 1, 5)), F.lit("E")).alias("ticker")))
    return SE.close_matches(words, names.distinct())


@query("x10_resolve_entities", """with m as (select c_custkey, case when c_acctbal > 5000 then lpad(cast(c_custkey as varchar), 10, '0') end as cik,
   's' || c_nationkey as symbol, upper(c_name) || '!' as name from customer),
co as (select s_suppkey as cik, 'S' || s_suppkey as ticker, 'customer #' || lpad(cast(s_suppkey as varchar), 9, '0') as name from supplier)
select m.cik, symbol, m.name, coalesce(a.ticker, b.ticker, k.ticker) as resolved,
  case when a.ticker is not null then 'cik' when b.ticker is not null then 'ticker' when k.ticker is not null then 'name' else 'none' end as resolved_by
from m left join co a on cast(m.cik as bigint) = a.cik left join co b on upper(symbol) = b.ticker
left join co k on regexp_replace(lower(m.name), '[^a-z0-9]', '', 'g') = regexp_replace(lower(k.name), '[^a-z0-9]', '', 'g')""")
def x10(spark, d):
    m = MP.table(spark, d, "customer").select(
        F.when(c("c_acctbal") > 5000, F.lpad(c("c_custkey").cast("string"), 10, "0")).alias("cik"),
        F.concat(F.lit("s"), "c_nationkey").alias("symbol"), F.concat(F.upper("c_name"), F.lit("!")).alias("name"))
    co = MP.table(spark, d, "supplier").select(
        c("s_suppkey").cast("string").alias("cik"), F.concat(F.lit("S"), "s_suppkey").alias("ticker"),
        F.concat(F.lit("customer #"), F.lpad(c("s_suppkey").cast("string"), 9, "0")).alias("name"))
    return SE.resolve_entities(m, co)


FUZZY_SQL = """d as (select doc_id, coalesce(left(text, 24), '') as t from documents),
m as (select doc_id, t[1:4] || 'x' || t[6:9] || t[11:] as name from d),
co as (select nm, min(ticker) as ticker from (select regexp_replace(lower(t), '[^a-z0-9]', '', 'g') as nm, 'D' || doc_id as ticker from d) where nm <> '' group by nm),
w as (select *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') as nm from m),
near as (select distinct w.nm, co.nm as other, ticker, levenshtein(w.nm, co.nm) as edits from (select distinct nm from w where nm <> '') w, co
  where levenshtein(w.nm, co.nm) <= floor(greatest(length(w.nm), length(co.nm)) * 0.2 + 1e-9)),
best as (select nm, min_by(ticker, (edits, other, ticker)) as ticker, min(edits) as edits from near group by nm)"""


@query("x10_fuzzy", f"""with {FUZZY_SQL} select doc_id, w.name, best.ticker as resolved,
  case when best.edits = 0 then 'name' when best.ticker is not null then 'fuzzy' else 'none' end as resolved_by from w left join best on w.nm = best.nm""")
def x10f(spark, d):
    """Names with one character changed and one left out, among the names of all documents."""
    docs = MP.table(spark, d, "documents").select("doc_id", F.coalesce(F.substring("text", 1, 24), F.lit("")).alias("t"))
    none = F.lit(None).cast("string")
    mentions = docs.select("doc_id", none.alias("cik"), none.alias("symbol"),
                           F.concat(F.substring("t", 1, 4), F.lit("x"), F.substring("t", 6, 4), F.substring("t", 11, 24)).alias("name"))
    companies = docs.select(none.alias("cik"), F.concat(F.lit("D"), "doc_id").alias("ticker"), c("t").alias("name"))
    return SE.resolve_entities(mentions, companies, cutoff=0.8).select("doc_id", "name", "resolved", "resolved_by")


# ------------------------------------------------------------ relations
# Supplier nations deliver to customer nations; volume gives the confidence.

EDGE_SQL = f"""{O.LINES},
edges as (select s_nationkey as src, c_nationkey as dst, cast(cast(sum(cents) % 30 as integer) + 70 as double) / cast(100 as double) as confidence,
  min(ship_day) as valid_from, max(ship_day) as last_confirmed, case when count(*) filter (l_returnflag = 'R') > 10 then max(ship_day) end as valid_to
  from lines join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by all)"""


def edges(spark, d):
    o = MP.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    cu = MP.table(spark, d, "customer").select("c_custkey", c("c_nationkey").alias("dst"))
    su = MP.table(spark, d, "supplier").select("s_suppkey", c("s_nationkey").alias("src"))
    rows = MP.lines(spark, d).join(o, c("l_orderkey") == c("o_orderkey")).join(cu, c("o_custkey") == c("c_custkey")).join(su, c("l_suppkey") == c("s_suppkey"))
    return rows.groupBy("src", "dst").agg(
        ((F.sum("cents") % 30 + 70).cast("double") / F.lit(100.0)).alias("confidence"), F.min("ship_day").alias("valid_from"),
        F.max("ship_day").alias("last_confirmed"), F.when(F.count_if(c("l_returnflag") == "R") > 10, F.max("ship_day")).alias("valid_to"))


@query("x6_valid_edges", f"with {EDGE_SQL} select src, dst, confidence from edges where valid_from <= date '1999-01-01' and (valid_to is null or valid_to > date '1999-01-01')")
def x6(spark, d):
    return RL.valid_at(edges(spark, d), "1999-01-01").select("src", "dst", "confidence")


@query("x7_ripple", f"""with {EDGE_SQL}, u as (select src, dst, confidence from edges where confidence > 0.75),
h1 as (select src as start, dst as node, max(1.0::double * confidence * 0.9) as best, count(*) as paths from u group by all),
h2 as (select start, dst as node, max(best * confidence * 0.9) as best, sum(paths) as paths from h1 join u on node = src group by all),
h3 as (select start, dst as node, max(best * confidence * 0.9) as best, sum(paths) as paths from h2 join u on node = src group by all)
select start, node, hops, best as confidence, cast(paths as bigint) as paths, case when best < 0.7 then 'speculative' else 'reliable' end as assessment
from (select *, 1 as hops from h1 union all select *, 2 from h2 union all select *, 3 from h3)""")
def x7(spark, d):
    return RL.ripple(edges(spark, d), MP.table(spark, d, "nation").select(c("n_nationkey").alias("node")), 3, 0.75)


@query("x9_staleness", f"""with {EDGE_SQL} select src, dst, confidence * case when date_diff('day', last_confirmed, date '2002-01-01') < 90 then 1.0
  when date_diff('day', last_confirmed, date '2002-01-01') <= 365 then 0.9 when date_diff('day', last_confirmed, date '2002-01-01') <= 730 then 0.7 else 0.5 end as effective
from edges""")
def x9(spark, d):
    return edges(spark, d).select("src", "dst", (c("confidence") * RL.staleness_factor(c("last_confirmed"), F.lit("2002-01-01").cast("date"))).alias("effective"))


# A part sold in one order by several suppliers stands for a director: board seats are suppliers and parts.
SEATS_SQL = f"""{O.LINES},
seats as (select 'S' || l_suppkey as ticker, 'P' || l_partkey as person, case when max(l_quantity) >= 49 then 'Chairman' else 'Director' end as role,
  case when bool_or(l_returnflag = 'A') then ['Audit'] else [] end as committees
  from lines where tp <= 4 group by l_suppkey, l_partkey),
sizes as (select person, count(*) as n from seats group by person having count(*) > 1)"""


def seats(spark, d):
    rows = MP.lines(spark, d).where(c("tp") <= 4).groupBy("l_suppkey", "l_partkey").agg(
        F.when(F.max("l_quantity") >= 49, "Chairman").otherwise("Director").alias("role"),
        F.when(F.bool_or(c("l_returnflag") == "A"), F.array(F.lit("Audit"))).otherwise(F.array().cast("array<string>")).alias("committees"))
    return rows.select(F.concat(F.lit("S"), "l_suppkey").alias("ticker"), F.concat(F.lit("P"), "l_partkey").alias("person"), "role", "committees")


HEAVY = 12


@query("x8_interlocks", f"""with {SEATS_SQL} select a.ticker as company_a, b.ticker as company_b, a.person, a.role as role_at_a, b.role as role_at_b,
  case when len(a.committees) > 0 and len(b.committees) > 0 then 'Financial oversight interlock'
    when contains(a.role, 'Chairman') or contains(b.role, 'Chairman') then 'Executive-level interlock' else 'Board-level connection' end as significance
from seats a join seats b on a.person = b.person and a.ticker < b.ticker join sizes on sizes.person = a.person where n <= {HEAVY}""")
def x8(spark, d):
    return RL.interlocks(seats(spark, d), HEAVY)[0]


@query("x8_interlock_classes", f"""with {SEATS_SQL} select person, ticker, role, len(committees) as committees, n as companies
from seats join sizes using (person) where n > {HEAVY}""")
def x8c(spark, d):
    return RL.interlocks(seats(spark, d), HEAVY)[1].withColumn("committees", F.size("committees"))
