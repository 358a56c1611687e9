"""Views that read the driver's tables as company metrics, facts, filings and texts.

Every measure is an integer sum over line items, so any engine and any
partitioning gives the same value. Gaps, zero denominators and stale series
come from the data: a measure only counts line items that meet its condition,
and a quarter without such a line has no value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyfold import model as M
from tallyfold.functions.columns import period_label, signed

c = F.col

# metric -> (condition on a line item, integer amount in 1/10000 dollar).
# cents, dp and tp are price in cents, discount and tax in percent.
MEASURES = {
    "revenue": ("true", "cents * (100 - dp)"),
    "cost_of_revenue": ("l_returnflag <> 'A'", "cents * 60"),
    "gross_profit": ("dp = 0 and l_linenumber <= 3", "cents * 900"),
    "operating_expenses": ("l_linestatus = 'F'", "cents * 10"),
    "operating_income": ("tp >= 7", "cents * 110"),
    "income_tax_expense": ("l_linestatus = 'O'", "cents * tp"),
    "research_and_development": ("dp >= 8", "cents * 20"),
    "interest_expense": ("dp = 10 and tp >= 6", "cents * 60"),
    "depreciation_and_amortization": ("l_quantity >= 25", "cents * 5"),
    "net_income": ("true", "cents * (8 - dp)"),
    "operating_cash_flow": ("true", "cents * (15 - tp)"),
    "capex": ("l_linenumber <= 2", "cents * 18"),
    "investing_cash_flow": ("l_linenumber <= 3", "cents * -20"),
    "financing_cash_flow": ("true", "cents * (3 - tp)"),
    "dividends_paid": ("l_quantity >= 47", "cents * 14"),
    "free_cash_flow": ("l_linenumber = 7", "cents * 31"),
    "ebitda": ("l_quantity <= 2", "cents * 800"),
    "total_assets": ("true", "cents * 300"),
    "total_liabilities": ("true", "cents * (150 + tp * 10)"),
    "stockholders_equity": ("true", "cents * (150 - tp * 10)"),
    "cash": ("l_linestatus = 'F'", "cents * 20"),
    "total_current_assets": ("l_quantity >= 5", "cents * 90"),
    "total_current_liabilities": (
        "l_returnflag = 'N'", "case when l_linestatus = 'F' and l_quantity >= 30 then cents * 300 else 0 end"),
    "accounts_receivable": ("l_returnflag = 'R'", "cents * 15"),
    "nontrade_receivables": ("tp = 0", "cents * 3"),
    "accounts_payable": ("dp <= 1", "cents * 12"),
    "inventory": ("l_quantity <= 10", "cents * 25"),
    "goodwill": ("l_linenumber = 3", "cents * 8"),
    "intangible_assets": ("l_linenumber = 5", "cents * 9"),
    "retained_earnings": ("true", "cents * (8 - dp) * 5"),
    "long_term_debt": ("dp >= 3", "cents * 70"),
    "short_term_debt": ("dp = 2 and tp >= 4", "cents * 33"),
    "commercial_paper": ("dp = 1 and tp <= 3", "cents * 21"),
    "long_term_debt_current": ("dp = 4", "cents * 10"),
    "short_term_investments": ("tp = 8", "cents * 40"),
    "common_shares_outstanding": ("dp >= 9 and tp >= 7", "10000000"),
}
ALL_MEASURES = list(MEASURES)

LINE_SQL = """
  l_suppkey, l_orderkey, l_partkey, l_linenumber, l_quantity, l_returnflag, l_linestatus,
  cast(l_shipdate as date) as ship_day,
  year(l_shipdate) as yr, quarter(l_shipdate) as qn,
  cast(round(l_extendedprice * 100) as bigint) as cents,
  cast(round(l_discount * 100) as bigint) as dp,
  cast(round(l_tax * 100) as bigint) as tp
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _split(sql: str) -> list[str]:
    """Select-list items at nesting depth zero."""
    parts, depth, cur = [], 0, ""
    for ch in sql:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return [*parts, cur.strip()]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*_split(LINE_SQL))


def sum_sql(name: str) -> str:
    cond, amount = MEASURES[name]
    return f"sum(case when {cond} then {amount} end)"


def cells(spark: SparkSession, sf_dir: str, names: list[str] = ALL_MEASURES) -> DataFrame:
    """Integer sums per supplier and quarter."""
    sums = [F.expr(sum_sql(n)).alias(n) for n in names]
    return lines(spark, sf_dir).groupBy("l_suppkey", "yr", "qn").agg(*sums)


def _ticker() -> F.Column:
    return F.concat(F.lit("S"), c("l_suppkey").cast("string")).alias("ticker")


def _dollars(name: str):
    return (c(name).cast("double") / F.lit(10000.0)).alias(name)


def metrics(
    spark: SparkSession,
    sf_dir: str,
    names: list[str] = ALL_MEASURES,
    period_types: tuple[str, ...] = (M.QUARTERLY, M.ANNUAL),
) -> DataFrame:
    """The metric table: supplier as ticker, quarter and year ends as periods."""
    names = [n for n in names if n in MEASURES]
    per_quarter = cells(spark, sf_dir, names)
    parts = []
    if M.QUARTERLY in period_types:
        day = F.last_day(F.make_date(c("yr"), c("qn") * 3, F.lit(1)))
        parts.append(per_quarter.select(
            _ticker(), F.lit(M.QUARTERLY).alias("period_type"), day.alias("period_end"),
            *[_dollars(n) for n in names]))
    if M.ANNUAL in period_types:
        per_year = per_quarter.groupBy("l_suppkey", "yr").agg(*[F.sum(n).alias(n) for n in names])
        parts.append(per_year.select(
            _ticker(), F.lit(M.ANNUAL).alias("period_type"),
            F.make_date(c("yr"), F.lit(12), F.lit(31)).alias("period_end"), *[_dollars(n) for n in names]))
    wide = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    long = wide.unpivot(["ticker", "period_type", "period_end"], names, "metric_type", "raw").where(
        c("raw").isNotNull()
    )
    return long.select(
        "ticker",
        F.substring("ticker", 2, 20).alias("cik"),
        "metric_type",
        signed(c("metric_type"), c("raw")).alias("value"),
        F.lit("USD").alias("currency"),
        period_label(c("period_end"), c("period_type")).alias("period"),
        "period_type",
        "period_end",
        F.when(c("period_type") == M.ANNUAL, "10-K").otherwise("10-Q").alias("source"),
        F.lit(None).cast("string").alias("accession"),
    )


# ---------------------------------------------------------------- raw facts

FACT_FLOWS = {
    "revenue": "us-gaap:Revenues",
    "net_income": "us-gaap:NetIncomeLoss",
    "cost_of_revenue": "us-gaap:CostOfRevenue",
    "operating_income": "us-gaap:OperatingIncomeLoss",
    "gross_profit": "us-gaap:GrossProfit",
    "income_tax_expense": "us-gaap:IncomeTaxExpenseBenefit",
    "capex": "us-gaap:PaymentsToAcquirePropertyPlantAndEquipment",
}
# The second alias of revenue fills quarters the first does not report.
FACT_ALIAS = ("dividends_paid", "us-gaap:SalesRevenueNet")
FACT_STOCKS = {
    "total_assets": "us-gaap:Assets",
    "cash": "us-gaap:CashAndCashEquivalentsAtCarryingValue",
    "long_term_debt": "us-gaap:LongTermDebt",
    "inventory": "us-gaap:LongTermDebtNoncurrent",
    "long_term_debt_current": "us-gaap:LongTermDebtCurrent",
}


def facts(spark: SparkSession, sf_dir: str, dims: bool = False) -> DataFrame:
    """Company facts with year-to-date values, comparatives and wrong units.

    Each (supplier, year, quarter) reports flows from January 1 to the quarter
    end, and directly for the third quarter when the supplier shipped goods of
    the highest discount. The next year's filing repeats every value as a
    comparative under its own fiscal year, restated upwards by its tax.
    """
    flow_tags = {**FACT_FLOWS, FACT_ALIAS[0]: FACT_ALIAS[1]}
    names = [*flow_tags, *FACT_STOCKS]
    w = W.partitionBy("l_suppkey", "yr").orderBy("qn").rowsBetween(W.unboundedPreceding, 0)
    base = cells(spark, sf_dir, [*names, "interest_expense"])
    running = base.select(
        "l_suppkey", "yr", "qn", "interest_expense", *names,
        *[F.sum(n).over(w).alias(f"ytd_{n}") for n in flow_tags],
    )
    pe = F.last_day(F.make_date(c("yr"), c("qn") * 3, F.lit(1)))
    label = F.when(c("qn") == 4, "FY").otherwise(F.concat(F.lit("Q"), c("qn").cast("string")))
    jan = F.make_date(c("yr"), F.lit(1), F.lit(1))
    q_start = F.make_date(c("yr"), c("qn") * 3 - 2, F.lit(1))

    def fact(tag, value, start, ok):
        return F.when(ok, F.struct(F.lit(tag).alias("concept"), value.alias("cell"), start.alias("period_start")))

    rows = [fact(tag, c(f"ytd_{n}"), jan, c(n).isNotNull()) for n, tag in flow_tags.items()]
    rows += [
        fact(tag, c(n), q_start, c(n).isNotNull() & (c("qn") == 3) & c("interest_expense").isNotNull())
        for n, tag in flow_tags.items()
    ]
    rows += [fact(tag, c(n), F.lit(None).cast("date"), c(n).isNotNull()) for n, tag in FACT_STOCKS.items()]
    flat = running.select(
        "l_suppkey", "yr", label.alias("fiscal_period"), pe.alias("period_end"),
        F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull())),
    )
    copies = F.explode(F.array(
        F.struct(F.lit(0).alias("later"), F.lit("USD").alias("unit")),
        F.struct(F.lit(1).alias("later"), F.lit("USD").alias("unit")),
        F.struct(F.lit(0).alias("later"), F.lit("EUR").alias("unit")),
    ))
    return flat.select("*", copies.alias("k")).select(
        _ticker(),
        c("l_suppkey").cast("string").alias("cik"),
        "concept",
        ((c("cell") + F.when(c("k.unit") == "EUR", c("cell")).otherwise(c("k.later") * 10000)).cast("double")
         / F.lit(10000.0)).alias("numeric_value"),
        c("k.unit").alias("unit"),
        "fiscal_period",
        (c("yr") + c("k.later")).cast("int").alias("fiscal_year"),
        "period_start",
        "period_end",
    )
