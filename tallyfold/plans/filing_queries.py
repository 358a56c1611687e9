"""Queries over structured filings, with their SQL counterparts.

Form 4: an order is a filing, its line items are the transactions, the order
priority is the insider. 8-K: an event is a filing. 13D/G and DEF 14A: orders
of a customer. 13F: a supplier's quarter is a filing, its parts are holdings.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyfold.functions import columns as K
from tallyfold.operators import filing_summaries as FS
from tallyfold.operators import filings as FL
from tallyfold.plans import mapping as MP
from tallyfold.plans.ingest_queries import FILINGS_SQL, filings
from tallyfold.plans.oracle_base import LINES

c = F.col
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


# ------------------------------------------------------------ Form 4

CODE_OF = {"R": "S", "A": "F", "N": "Q"}
TX_SQL = f"""{LINES},
tx as (select 'S' || l_suppkey as ticker, lpad(cast(l_orderkey as varchar), 10, '0') || '-' || l_suppkey as accession_number,
  cast(o_orderdate as date) as filing_date, ship_day as tx_date, o_orderpriority as insider_name, o_orderstatus as position,
  'Sale' as primary_activity, case l_returnflag when 'R' then 'S' when 'A' then 'F' else 'Q' end as transaction_code,
  case when l_linestatus = 'F' then 'D' else 'A' end as acquired_disposed,
  l_quantity as shares, case when tp > 0 then cast(cents as double) / cast(100 as double) end as price
  from lines join orders on l_orderkey = o_orderkey),
tr as (select *, shares * price as value, case when acquired_disposed = 'D' then shares * price end as proceeds,
  case transaction_code when 'S' then 'Open Market Sale' when 'F' then 'Tax Withholding' else 'Other (Q)' end as code_description from tx),
sales as (select *, coalesce(case when proceeds <> 0 then proceeds end, value, 0) as amount, coalesce(tx_date, filing_date) as day from tr
  where acquired_disposed = 'D' and transaction_code in ('S', 'F') and (value is null or abs(value) >= 20000))"""


def form4(spark, d):
    tx = F.struct(
        c("ship_day").alias("Date"), F.lit("Common").alias("Security"), c("l_quantity").alias("Shares"),
        F.lit(None).cast("double").alias("Remaining"),
        F.when(c("tp") > 0, c("cents").cast("double") / F.lit(100.0)).alias("Price"),
        F.when(c("l_linestatus") == "F", "D").otherwise("A").alias("AcquiredDisposed"),
        F.when(c("l_linenumber") == 1, "D").otherwise("I").alias("DirectIndirect"),
        F.lit(None).cast("string").alias("NatureOfOwnership"), K.lookup(c("l_returnflag"), CODE_OF).alias("Code"),
        F.lit("").alias("TransactionType"))
    orders = MP.table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    rows = MP.lines(spark, d).join(orders, c("l_orderkey") == c("o_orderkey"))
    return rows.groupBy("l_orderkey", "l_suppkey", "o_orderdate", "o_orderpriority", "o_orderstatus").agg(
        F.collect_list(tx).alias("transactions")
    ).select(
        F.concat(F.lit("S"), "l_suppkey").alias("ticker"),
        F.concat(F.lpad(c("l_orderkey").cast("string"), 10, "0"), F.lit("-"), "l_suppkey").alias("accession_number"),
        c("o_orderdate").cast("date").alias("filing_date"), c("o_orderpriority").alias("insider_name"),
        c("o_orderstatus").alias("position"), F.lit("Sale").alias("primary_activity"), "transactions")


def sales(spark, d):
    return FL.form4_trades(form4(spark, d), ["s", " F "], "d", 20000)


SIG = "case when abs(coalesce({0}, 0)) < 100000 then 'Normal' when abs({0}) < 1000000 then 'Notable' else 'Very notable' end"


@query("f1_form4_trades", f"""with {TX_SQL} select ticker, accession_number, filing_date, tx_date, insider_name, transaction_code,
  code_description, acquired_disposed, shares, price, value, proceeds, transaction_code = 'F' as is_tax_withholding,
  {SIG.format('value')} as classification from tr""")
def f1(spark, d):
    return FL.form4_trades(form4(spark, d), None, None).select(
        "ticker", "accession_number", "filing_date", "tx_date", "insider_name", "transaction_code", "code_description",
        "acquired_disposed", "shares", "price", "value", "proceeds", "is_tax_withholding", "classification")


@query("p26_trade_filters", f"""with {TX_SQL} select ticker, accession_number, tx_date, transaction_code, value from sales""")
def p26(spark, d):
    return sales(spark, d).select("ticker", "accession_number", "tx_date", "transaction_code", "value")


@query("l3_top_trades", f"""with {TX_SQL} select ticker, amount from (select *, row_number() over (
  partition by ticker order by amount desc, day desc, accession_number desc) as n from sales) where n <= 20""")
def l3(spark, d):
    return FL.top_trades(sales(spark, d), 20).select("ticker", FL.trade_amount().alias("amount"))


def _sales_summary(by: str, first: str) -> str:
    return f"""with {TX_SQL},
k as (select ticker, {by}, transaction_code as tc, max((amount, day)) as seen from sales group by ticker, {by}, tc),
codes as (select ticker, {by}, string_agg(tc, ',' order by seen desc, tc) as transaction_codes from k group by all),
g as (select ticker, {by}, count(*) as transaction_count, min(tx_date) as first_tx_date, max(tx_date) as last_tx_date,
   max(filing_date) as latest_filing_date, max((day, accession_number))[2] as latest_accession_number,
   cast(sum(cast(shares as decimal(38,6))) as double) as total_shares, cast(sum(cast(amount as decimal(38,6))) as double) as total_proceeds,
   max(amount) as max_trade_value from sales group by ticker, {by})
select g.*, transaction_codes, total_proceeds / nullif(total_shares, 0) as average_price, {SIG.format('total_proceeds')} as classification
from g join codes using (ticker, {by})"""


def _flat(df):
    return df.withColumn("transaction_codes", F.concat_ws(",", "transaction_codes"))


for _group, _by in FS.TRADE_GROUPS.items():
    query(f"a14_sales_by_{_group}", _sales_summary(", ".join(_by), _by[0]))(
        lambda spark, d, g=_group: _flat(FS.insider_sales(sales(spark, d), g)))


@query("a14_sale_accessions", f"""with {TX_SQL} select ticker, transaction_code, code_description, accession_number,
  max(day) as latest_day, count(*) as trades from sales group by all""")
def a14a(spark, d):
    return FS.insider_sale_accessions(sales(spark, d), "transaction_code")


# ------------------------------------------------------------ 8-K

ITEM_OF = {"click": "Item 7.01", "view": "Item 8 . 01", "purchase": "Item 2.02", "signup": "Item 5.02 Departure of an officer", "error": "Other"}
EV_SQL = """ev as (select 'U' || user_id as ticker, lpad(cast(event_id as varchar), 10, '0') as accession_number,
  case when value > 60 then '8-K/A' else '8-K' end as form_type, cast(ts as date) as filing_date,
  cast(ts as date) - cast(round(value * 100) as integer) % 3 as date_of_report, event_type as content_type, value > 20 as has_press_release,
  i.item, i.code as item_code, coalesce('Item ' || i.code, i.item) as item_label, i.tx as summary, coalesce(length(i.tx), 0) + case when i.item = 'Item 9.01' then 2 else 0 end as text_length
  from events, lateral (select unnest([
    {'item': case event_type when 'click' then 'Item 7.01' when 'view' then 'Item 8 . 01' when 'purchase' then 'Item 2.02'
             when 'signup' then 'Item 5.02 Departure of an officer' else 'Other' end,
     'code': case event_type when 'click' then '7.01' when 'view' then '8.01' when 'purchase' then '2.02' when 'signup' then '5.02' end,
     'tx': event_type || ' ' || props},
    {'item': case when value > 10 then 'Item 9.01' end, 'code': '9.01', 'tx': 'Item 9.01 Exhibits. ' || props}]) as i)
  where i.item is not null)"""


def eightk(spark, d):
    main = F.struct(K.lookup(c("event_type"), ITEM_OF).alias("item"), F.concat_ws(" ", "event_type", "props").alias("text"))
    extra = F.struct(F.when(c("value") > 10, "Item 9.01").alias("item"), F.concat(F.lit("Item 9.01   Exhibits. "), c("props")).alias("text"))
    day = c("ts").cast("date")
    return MP.table(spark, d, "events").select(
        F.concat(F.lit("U"), "user_id").alias("ticker"), F.lpad(c("event_id").cast("string"), 10, "0").alias("accession_number"),
        F.when(c("value") > 60, "8-K/A").otherwise("8-K").alias("form_type"), day.alias("filing_date"),
        F.date_sub(day, (F.round(c("value") * 100).cast("int") % 3)).alias("date_of_report"),
        c("event_type").alias("content_type"), (c("value") > 20).alias("has_press_release"),
        F.filter(F.array(main, extra), lambda i: i["item"].isNotNull()).alias("items"))


def events(spark, d, codes=None):
    return FL.material_events(eightk(spark, d), codes)


EV_COLS = ["ticker", "accession_number", "form_type", "filing_date", "date_of_report", "item", "item_code", "item_label",
           "content_type", "summary", "text_length", "has_press_release"]


@query("f2_material_events", f"with {EV_SQL} select {', '.join(EV_COLS)} from ev")
def f2(spark, d):
    return events(spark, d).select(*EV_COLS)


@query("f2_events_of_items", f"with {EV_SQL} select ticker, accession_number, item_code from ev where item_code in ('5.02', '9.01')")
def f2c(spark, d):
    return events(spark, d, ["Item 5.02", "9.01"]).select("ticker", "accession_number", "item_code")


def _event_summary(by: str) -> str:
    return f"""with {EV_SQL},
types as (select ticker, {by}, string_agg(t, ',' order by seen desc, t) as content_types from (
   select ticker, {by}, content_type as t, max((filing_date, date_of_report, accession_number)) as seen from ev group by ticker, {by}, t) group by all),
samp as (select ticker, {by}, string_agg(summary, '|' order by n) as sample_summaries from (
   select *, row_number() over (partition by ticker, {by} order by seen desc, summary) as n from (
     select ticker, {by}, summary, max((filing_date, date_of_report, accession_number)) as seen from ev group by all)) where n <= 3 group by all),
g as (select ticker, {by}, count(*) as event_count, max(filing_date) as latest_filing_date, max(date_of_report) as latest_date_of_report,
   bool_or(has_press_release) as has_press_release from ev group by all)
select g.*, content_types, sample_summaries from g
join types on g.ticker = types.ticker and {' and '.join(f'g.{b} is not distinct from types.{b}' for b in by.split(', '))}
join samp on g.ticker = samp.ticker and {' and '.join(f'g.{b} is not distinct from samp.{b}' for b in by.split(', '))}"""


def _flat_events(df):
    return df.withColumns({"content_types": F.concat_ws(",", "content_types"), "sample_summaries": F.concat_ws("|", "sample_summaries")})


for _group, _by in FS.EVENT_GROUPS.items():
    query(f"a15_events_by_{_group}", _event_summary(", ".join(_by)))(
        lambda spark, d, g=_group: _flat_events(FS.material_event_summary(events(spark, d), g)))


@query("a15_event_accessions", f"""with {EV_SQL} select ticker, item_code, item_label, accession_number, max(filing_date) as filing_date,
  max(date_of_report) as date_of_report from ev group by all""")
def a15a(spark, d):
    return FS.event_accessions(events(spark, d))


@query("a20_event_coverage", f"""with {EV_SQL} select ticker, count(*) as returned_events, min(filing_date) as earliest_filing_date,
  max(filing_date) as latest_filing_date from ev group by ticker""")
def a20(spark, d):
    return FS.event_coverage(events(spark, d))


@query("a21_event_digest", f"""with {EV_SQL},
days as (select ticker, item_code, string_agg(cast(filing_date as varchar), ',' order by filing_date desc) as recent_dates from (
   select *, row_number() over (partition by ticker, item_code order by filing_date desc) as n from (select distinct ticker, item_code, filing_date from ev))
   where n <= 3 group by all),
types as (select ticker, item_code, string_agg(distinct content_type, ',' order by content_type) as content_types from ev group by all),
ex as (select ticker, item_code, string_agg(summary, '|' order by n) as examples from (
   select *, row_number() over (partition by ticker, item_code order by seen desc, summary) as n from (
     select ticker, item_code, summary, max((filing_date, date_of_report, accession_number)) as seen from ev group by all)) where n <= 2 group by all),
g as (select ticker, item_code, count(*) as row_count, min(filing_date) as earliest, max(filing_date) as latest,
   min(year(filing_date)) as first_year, max(year(filing_date)) as last_year,
   case when item_code = '9.01' then 'Exhibits' when item_code is null then 'Other' else 'Item ' || item_code end as title from ev group by all)
select g.*, recent_dates, content_types, examples from g
join days on g.ticker = days.ticker and g.item_code is not distinct from days.item_code
join types on g.ticker = types.ticker and g.item_code is not distinct from types.item_code
join ex on g.ticker = ex.ticker and g.item_code is not distinct from ex.item_code""")
def a21(spark, d):
    g = FS.event_digest(events(spark, d))
    return g.withColumns({"recent_dates": F.concat_ws(",", "recent_dates"), "content_types": F.concat_ws(",", "content_types"),
                          "examples": F.concat_ws("|", "examples")})


@query("a22_distinct_events", f"""with {EV_SQL}, e as (select *, coalesce(summary, '') as s from ev)
select 'summary' as variant, accession_number as place, item_code, s as summary from e group by all
union all select 'date', cast(filing_date as varchar), item_code, '' from e group by all""")
def a22(spark, d):
    rows = events(spark, d)
    one = FL.distinct_events(rows).select(F.lit("summary").alias("variant"), c("accession_number").alias("place"), "item_code", F.coalesce("summary", F.lit("")).alias("summary"))
    two = FL.distinct_events(rows, by_summary=False).select(F.lit("date").alias("variant"), c("filing_date").cast("string").alias("place"), "item_code", F.lit("").alias("summary"))
    return one.unionByName(two)


@query("t12_eightk_sections", f"""with {EV_SQL}, s as (select accession_number, item_code,
  case item_code when '5.02' then 'Item 5.02 Departure of an officer' when '7.01' then 'Item 7.01. Regulation FD Disclosure'
    when '8.01' then 'Item 8 . 01' when '2.02' then 'Item 2.02. Results of Operations and Financial Condition'
    else 'Item 9.01. Financial Statements and Exhibits' end as heading,
  case item_code when '5.02' then 'Departure of an officer' when '7.01' then 'Regulation FD Disclosure' when '8.01' then '01'
    when '2.02' then 'Results of Operations and Financial Condition' else 'Financial Statements and Exhibits' end as title,
  summary as preview from ev where item_code is not null) select * from s""")
def t12(spark, d):
    return FL.eightk_sections(events(spark, d)).drop("text_length")


# ------------------------------------------------------------ 13D / 13G

OWN_FORM = {"1-URGENT": "SC 13D", "2-HIGH": "SC 13D/A", "3-MEDIUM": "SCHEDULE 13G", "4-NOT SPECIFIED": "10-K", "5-LOW": "SC  13g/A"}
OWN_SQL = f"""{LINES},
own as (select 'C' || o_custkey as ticker, lpad(cast(o_orderkey as varchar), 10, '0') as accession_number,
  cast(o_orderdate as date) as filing_date, 'Issuer ' || o_orderstatus as issuer_name,
  case o_orderpriority when '1-URGENT' then 'SC 13D' when '2-HIGH' then 'SC 13D/A' when '3-MEDIUM' then 'SCHEDULE 13G' else 'SC  13g/A' end as form_type,
  o_totalprice as total_shares, o_orderpriority = '2-HIGH' as is_amendment, o_orderkey
  from orders where o_orderpriority <> '4-NOT SPECIFIED'),
per as (select l_orderkey, count(*) as n, string_agg(distinct 'S' || l_suppkey, ',' order by 'S' || l_suppkey) as names, sum(l_quantity + l_linenumber) as votes
  from lines group by all),
rep as (select own.*, coalesce(n, 0) as reporting_person_count, coalesce(names, '') as names, coalesce(votes, 0) as votes from own left join per on o_orderkey = l_orderkey)"""


def ownership(spark, d):
    person = F.struct(
        F.lit("").alias("cik"), F.concat(F.lit("S"), "l_suppkey").alias("name"), F.lit(None).cast("string").alias("citizenship"),
        F.lit("IN").alias("type_of_reporting_person"), c("l_quantity").alias("aggregate_amount"), c("l_quantity").alias("percent_of_class"),
        c("l_quantity").alias("sole_voting_power"), c("l_linenumber").cast("double").alias("shared_voting_power"),
        c("l_quantity").alias("sole_dispositive_power"), F.lit(None).cast("double").alias("shared_dispositive_power"),
        F.lit(None).cast("boolean").alias("is_aggregate_exclude_shares"), F.lit(None).cast("boolean").alias("no_cik"))
    persons = MP.lines(spark, d).groupBy("l_orderkey").agg(F.collect_list(person).alias("reporting_persons"))
    o = MP.table(spark, d, "orders").join(persons, c("o_orderkey") == c("l_orderkey"), "left")
    return o.select(
        F.concat(F.lit("C"), "o_custkey").alias("ticker"), F.lpad(c("o_orderkey").cast("string"), 10, "0").alias("accession_number"),
        c("o_orderdate").cast("date").alias("filing_date"), F.concat(F.lit("Issuer "), "o_orderstatus").alias("issuer_name"),
        K.lookup(c("o_orderpriority"), OWN_FORM).alias("form_type"), c("o_totalprice").alias("total_shares"),
        F.lit(None).cast("double").alias("total_percent"),
        F.when(c("o_orderpriority") == "2-HIGH", True).alias("is_amendment"), "reporting_persons",
        F.concat(F.lit(" Purpose:\n\n of  "), "o_orderstatus").alias("purpose_of_transaction"))


def _votes():
    return F.aggregate("reporting_persons", F.lit(0.0), lambda a, p: a + p["total_voting_power"])


@query("f3_ownership_reports", f"""with {OWN_SQL} select ticker, accession_number, filing_date, form_type, total_shares, is_amendment,
  reporting_person_count, names, votes, 'Purpose: of ' || right(issuer_name, 1) as purpose from rep""")
def f3(spark, d):
    r = FL.ownership_reports(ownership(spark, d))
    return r.select("ticker", "accession_number", "filing_date", "form_type", "total_shares", "is_amendment", "reporting_person_count",
                    F.concat_ws(",", F.sort_array("reporting_person_names")).alias("names"), _votes().alias("votes"),
                    c("purpose_of_transaction").alias("purpose"))


@query("p14_form_families", f"""with {OWN_SQL}, {FILINGS_SQL}
select 'SC 13D' as family, count(*) as n from own where form_type like 'SC 13D%' union all
select 'SC 13G', count(*) from own where form_type not like 'SC 13D%' union all
select split_part(form_type, '/', 1), count(*) from filings group by 1""")
def p14(spark, d):
    own = ownership(spark, d).select(K.ownership_form(c("form_type")).alias("family")).where(c("family").isNotNull())
    base = filings(spark, d).select(K.base_form(c("form_type")).alias("family"))
    return own.unionByName(base).groupBy("family").agg(F.count("*").alias("n"))


@query("a16_ownership_summary", f"""with {OWN_SQL},
t as (select *, row_number() over (partition by ticker order by filing_date desc, accession_number desc) as n from rep),
forms as (select ticker, string_agg(form_type, ',' order by seen desc, form_type) as form_types_present from (
  select ticker, form_type, max((filing_date, accession_number)) as seen from t group by all) group by ticker)
select t.ticker, max(case when n = 1 then issuer_name end) as issuer_name, max(case when n = 1 then accession_number end) as latest_accession_number,
  max(case when n = 1 then total_shares end) as latest_total_shares, max(case when n = 1 then names end) as latest_names,
  count(*) as filings_count, max(form_types_present) as form_types_present
from t join forms using (ticker) group by t.ticker""")
def a16(spark, d):
    s = FS.ownership_summary(FL.ownership_reports(ownership(spark, d)))
    return s.select("ticker", "issuer_name", "latest_accession_number", "latest_total_shares",
                    F.concat_ws(",", F.sort_array("latest_reporting_person_names")).alias("latest_names"), "filings_count",
                    F.concat_ws(",", "form_types_present").alias("form_types_present"))


@query("a16_ownership_history", f"""with {OWN_SQL} select ticker, accession_number, form_type, filing_date, total_shares from rep""")
def a16h(spark, d):
    rows = FS.ownership_history(FL.ownership_reports(ownership(spark, d)))
    return rows.select("ticker", "accession_number", "form_type", "filing_date", "total_shares")


@query("p25_primary_issuer", f"""with {OWN_SQL},
k as (select ticker, issuer_name, count(*) as n, max((filing_date, accession_number)) as seen from own group by all),
m as (select ticker, arg_max(issuer_name, (n, seen)) as issuer_name from k group by ticker)
select ticker, issuer_name, accession_number from own join m using (ticker, issuer_name)""")
def p25(spark, d):
    rows = FL.ownership_reports(ownership(spark, d))
    return FL.primary_issuer_rows(rows, ["ticker"]).select("ticker", "issuer_name", "accession_number")


# ------------------------------------------------------------ DEF 14A

PROXY_SQL = """p as (select 'C' || o_custkey as cik, cast(o_orderdate as date) as day, lpad(cast(o_orderkey as varchar), 10, '0') as acc,
  case when o_orderstatus = 'P' then 0 else o_totalprice end as comp, o_orderpriority as measure,
  cast(date_trunc('year', cast(o_orderdate as date)) as date) as fye from orders)"""


@query("a17_proxy_summary", f"""with {PROXY_SQL}, r as (select *, row_number() over (partition by cik order by fye desc, day desc, acc desc) as n from p)
select cik, count(*) as filings_count, max(case when n = 1 then acc end) as latest_accession_number,
  max(case when n = 1 then comp end) as latest_peo_total_comp,
  string_agg(distinct measure, ',' order by measure) as available_performance_measures,
  max(case when n = 1 then comp end) - max(case when n = 2 then comp end) as peo_total_comp_change,
  (max(case when n = 1 then comp end) - max(case when n = 2 then comp end)) / nullif(max(case when n = 2 then comp end), 0) * 100 as peo_total_comp_change_pct
from r group by cik""")
def a17(spark, d):
    s = FS.proxy_summary(proxies(spark, d))
    return s.select("cik", "filings_count", "latest_accession_number", "latest_peo_total_comp",
                    F.concat_ws(",", "available_performance_measures").alias("available_performance_measures"),
                    "peo_total_comp_change", "peo_total_comp_change_pct")


@query("a17_proxy_history", f"""with {PROXY_SQL} select cik, day as filing_date, fye as fiscal_year_end, acc as accession_number, comp as peo_total_comp from p""")
def a17h(spark, d):
    return FS.proxy_history(proxies(spark, d)).select("cik", "filing_date", "fiscal_year_end", "accession_number", "peo_total_comp")


def proxies(spark, d):
    day = c("o_orderdate").cast("date")
    raw = MP.table(spark, d, "orders").select(
        F.concat(F.lit("C"), "o_custkey").alias("cik"), F.lpad(c("o_orderkey").cast("string"), 10, "0").alias("accession_number"),
        F.lit("DEF 14A").alias("form_type"), day.alias("filing_date"), F.trunc(day, "year").alias("fiscal_year_end"),
        F.concat(F.lit("Chief "), "o_orderstatus").alias("peo_name"),
        F.when(c("o_orderstatus") == "P", F.lit(0.0)).otherwise(c("o_totalprice")).alias("peo_total_comp"),
        F.array("o_orderpriority").alias("performance_measures"), F.lit(None).cast("boolean").alias("has_xbrl"))
    return FL.proxy_records(raw)


@query("f4_proxy_records", """select 'C' || o_custkey as cik, lpad(cast(o_orderkey as varchar), 10, '0') as accession_number,
  case when o_orderstatus = 'P' then 0 else o_totalprice end as peo_total_comp, o_orderpriority as measures, false as has_xbrl from orders""")
def f4(spark, d):
    return proxies(spark, d).select("cik", "accession_number", "peo_total_comp",
                                    F.concat_ws(",", "performance_measures").alias("measures"), "has_xbrl")


@query("w11_newest_filings", f"""with {FILINGS_SQL} select cik, accession_number, filing_date from (select *, row_number() over (
  partition by cik order by filing_date desc, accession_number desc) as n from filings) where n <= 3""")
def w11(spark, d):
    return FL.newest_filings(filings(spark, d), 3).select("cik", "accession_number", "filing_date")


@query("j9_prior_comparable", f"""with {FILINGS_SQL}, b as (select *, split_part(form_type, '/', 1) as base_form from filings)
select cik, base_form, accession_number, lag(accession_number) over w as prior_accession, lag(filing_date) over w as prior_date
from b window w as (partition by cik, base_form order by filing_date, accession_number)""")
def j9(spark, d):
    r = FL.prior_comparable(filings(spark, d))
    return r.select("cik", "base_form", "accession_number", c("prior.accession_number").alias("prior_accession"),
                    c("prior.filing_date").alias("prior_date"))


# ------------------------------------------------------------ 13F

HOLD_SQL = f"""{LINES},
hold as (select 'M' || l_suppkey as manager_cik, 'M' || l_suppkey || '-' || yr || '-' || qn as accession_number,
   last_day(make_date(yr, qn * 3, 1)) as report_period, lpad(cast(l_partkey as varchar), 9, '0') as cusip,
   cast(sum(cents) as double) as value, sum(l_quantity) as shares from lines group by l_suppkey, yr, qn, l_partkey),
tot as (select accession_number, case when manager_cik like '%1' then 0 else sum(value) end as filed, sum(value) as total_value from hold group by accession_number, manager_cik)"""


def holdings(spark, d):
    """Flat holdings with their filing header; some managers file no total."""
    rows = MP.lines(spark, d).groupBy("l_suppkey", "yr", "qn", "l_partkey").agg(
        F.sum("cents").cast("double").alias("Value"), F.sum("l_quantity").alias("SharesPrnAmount"))
    totals = rows.groupBy("l_suppkey", "yr", "qn").agg(F.sum("Value").alias("t"), F.count("*").alias("total_holdings"))
    manager = F.concat(F.lit("M"), c("l_suppkey"))
    day = F.last_day(F.make_date(c("yr"), c("qn") * 3, F.lit(1)))
    none = F.lit(None).cast("string")
    return rows.join(totals, ["l_suppkey", "yr", "qn"]).select(
        F.concat_ws("-", manager, "yr", "qn").alias("accession_number"), F.lit("13F-HR").alias("form_type"), day.alias("filing_date"),
        day.alias("report_period"), manager.alias("manager_name"), manager.alias("manager_cik"),
        F.when(manager.endswith("1"), F.lit(0.0)).otherwise(c("t")).alias("total_value"), "total_holdings",
        F.concat(F.lit("Part "), "l_partkey").alias("Issuer"), F.lit("COM").alias("Class"),
        F.lpad(c("l_partkey").cast("string"), 9, "0").alias("Cusip"), none.alias("Ticker"), c("Value").cast("string").alias("Value"),
        "SharesPrnAmount", F.lit("SH").alias("Type"), none.alias("PutCall"), F.lit("x").alias("SoleVoting"),
        none.alias("SharedVoting"), none.alias("NonVoting"))


@query("f5_holdings", f"""with {HOLD_SQL} select accession_number, cusip, value, shares, value / nullif(filed, 0) * 100 as portfolio_weight_pct from (
  select hold.*, filed, row_number() over (partition by accession_number order by value desc, cusip) as n from hold join tot using (accession_number)
  where value >= 1000000) where n <= 12""")
def f5(spark, d):
    return FL.holdings_rows(holdings(spark, d), 1_000_000, 12).select("accession_number", "cusip", "value", "shares", "portfolio_weight_pct")


@query("a18_holdings_concentration", f"""with {HOLD_SQL},
r as (select *, row_number() over (partition by accession_number order by value desc, cusip) as n from hold)
select accession_number, any_value(total_value) as total_value, count(*) as distinct_securities,
  round(sum(case when n <= 5 then value else 0 end) / nullif(any_value(total_value), 0) * 100, 6) as top_5_concentration_pct,
  round(sum(case when n <= 10 then value else 0 end) / nullif(any_value(total_value), 0) * 100, 6) as top_10_concentration_pct,
  string_agg(case when n <= 3 then cusip end, ',' order by n) as top_cusips
from r join tot using (accession_number) group by accession_number""")
def a18(spark, d):
    s = FS.holdings_concentration(FL.holdings_rows(holdings(spark, d), limit=None), 3)
    return s.select("accession_number", "total_value", "distinct_securities", "top_5_concentration_pct", "top_10_concentration_pct",
                    F.concat_ws(",", F.transform("top_holdings", lambda x: x["cusip"])).alias("top_cusips"))


def thirteenf_filings(spark, d):
    return MP.lines(spark, d).select("l_suppkey", "yr", "qn").distinct().select(
        F.concat(F.lit("M"), "l_suppkey").alias("manager_cik"), F.concat_ws("-", F.concat(F.lit("M"), "l_suppkey"), "yr", "qn").alias("accession_number"),
        F.last_day(F.make_date(c("yr"), c("qn") * 3, F.lit(1))).alias("report_period"),
        F.last_day(F.make_date(c("yr"), c("qn") * 3, F.lit(1))).alias("filing_date"))


@query("w12_pick_13f", f"""with {HOLD_SQL} select manager_cik, accession_number, report_period from (select distinct manager_cik, accession_number, report_period,
  max(report_period) over (partition by manager_cik) as last_period from hold) where report_period = last_period""")
def w12(spark, d):
    return FL.pick_13f(thirteenf_filings(spark, d)).select("manager_cik", "accession_number", "report_period")


@query("x5_holdings_change", f"""with {HOLD_SQL}, days as (select report_period as day, lag(report_period) over (order by report_period) as before from (select distinct report_period from hold)),
k as (select manager_cik, cusip, day, before from hold join days on report_period = day where before is not null
  union select manager_cik, cusip, day, before from hold join days on report_period = before)
select k.manager_cik, k.cusip, k.day as report_period, b.shares as previous_shares, a.shares as current_shares,
  case when b.shares is null then 'new' when a.shares is null then 'sold_out' when a.shares > b.shares then 'increased'
       when a.shares < b.shares then 'decreased' else 'unchanged' end as change,
  (a.shares - b.shares) / nullif(b.shares, 0) * 100 as change_pct
from k left join hold a on a.manager_cik = k.manager_cik and a.cusip = k.cusip and a.report_period = k.day
left join hold b on b.manager_cik = k.manager_cik and b.cusip = k.cusip and b.report_period = k.before""")
def x5(spark, d):
    """All consecutive quarters: the earlier side carries the day of the next one."""
    h = FL.holdings_rows(holdings(spark, d), limit=None)
    days = h.select("report_period").distinct().select("report_period", F.lead("report_period").over(W.orderBy("report_period")).alias("next"))
    first = days.agg(F.min("report_period")).withColumnRenamed("min(report_period)", "first")
    now = h.join(first, c("report_period") > c("first")).drop("first")
    before = h.join(days, "report_period").where(c("next").isNotNull()).withColumn("report_period", c("next")).drop("next")
    return FL.holdings_change(now, before, ("manager_cik", "report_period", "cusip"))


@query("a19_provenance", f"""with {FILINGS_SQL} select count(*) as row_count, max(filing_date) as latest_filing_date,
  (select string_agg(a, ',' order by a desc) from (select distinct accession_number as a from filings order by a desc limit 10)) as accession_numbers,
  date_diff('day', max(filing_date), date '2002-01-01') as staleness_days from filings""")
def a19(spark, d):
    p = FS.provenance(filings(spark, d).withColumn("filing_date", c("filing_date").cast("string")), "2002-01-01")
    return p.select("row_count", "latest_filing_date", F.concat_ws(",", "accession_numbers").alias("accession_numbers"), "staleness_days")


@query("j14_sales_with_proxy", f"""with {TX_SQL}, s as (select insider_name, cast(sum(cast(amount as decimal(38,6))) as double) as total_proceeds, count(*) as n
  from sales group by 1), p as (select o_orderpriority as insider_name, max(cast(o_orderdate as date)) as latest_proxy from orders group by 1)
select insider_name, total_proceeds, n, latest_proxy from s left join p using (insider_name)""")
def j14(spark, d):
    t = sales(spark, d).withColumns({"position": F.lit(""), "primary_activity": F.lit("")})
    s = FS.insider_sales(t, "insider_name", None, keys=("insider_name",)).select("insider_name", "total_proceeds", c("transaction_count").alias("n"))
    p = proxies(spark, d).groupBy(c("performance_measures")[0].alias("insider_name")).agg(F.max("filing_date").alias("latest_proxy"))
    return s.join(p, "insider_name", "left")
