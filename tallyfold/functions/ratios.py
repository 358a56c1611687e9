"""The ratio registry: every ratio is one column expression over a wide metric row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions.columns import div

c = F.col


@dataclass(frozen=True)
class Ratio:
    name: str
    category: str
    inputs: tuple[str, ...]
    build: Callable[[], Column]
    display_format: str


def _per(top: str, bottom: str) -> Callable[[], Column]:
    return lambda: div(c(top), c(bottom))


def _size_per(top: str, bottom: str) -> Callable[[], Column]:
    return lambda: div(F.abs(c(top)), c(bottom))


def _per_size(top: str, bottom: str) -> Callable[[], Column]:
    return lambda: div(c(top), F.abs(c(bottom)))


def _or0(name: str) -> Column:
    return F.coalesce(c(name), F.lit(0.0))


def _pretax() -> Column:
    # tax expense is stored negative, so income before tax is income minus it
    return c("net_income") - c("income_tax_expense")


def _payout_cover() -> Column:
    paid = F.abs(_or0("dividends_paid")) + F.abs(_or0("capex"))
    known = c("dividends_paid").isNotNull() | c("capex").isNotNull()
    return F.when(known, div(c("operating_cash_flow"), paid))


def _net_debt() -> Column:
    known = c("long_term_debt").isNotNull() | c("short_term_debt").isNotNull()
    return F.when(known, _or0("long_term_debt") + _or0("short_term_debt") - _or0("cash"))


def _group(category: str, *rows) -> list[Ratio]:
    return [Ratio(name, category, tuple(inputs.split()), build, fmt) for name, inputs, build, fmt in rows]


SHARES = "common_shares_outstanding"
REGISTRY: list[Ratio] = [
    *_group(
        "Profitability Margins",
        ("gross_profit_margin", "gross_profit revenue", _per("gross_profit", "revenue"), "pct"),
        ("operating_profit_margin", "operating_income revenue", _per("operating_income", "revenue"), "pct"),
        ("pretax_profit_margin", "net_income income_tax_expense revenue",
         lambda: div(_pretax(), c("revenue")), "pct"),
        ("net_profit_margin", "net_income revenue", _per("net_income", "revenue"), "pct"),
        ("ebitda_margin", "ebitda revenue", _per("ebitda", "revenue"), "pct"),
        ("effective_tax_rate", "income_tax_expense net_income",
         lambda: div(-c("income_tax_expense"), _pretax()), "pct"),
        ("research_and_development_to_revenue", "research_and_development revenue",
         _size_per("research_and_development", "revenue"), "pct"),
    ),
    *_group(
        "Returns",
        ("return_on_assets", "net_income total_assets", _per("net_income", "total_assets"), "pct"),
        ("return_on_equity", "net_income stockholders_equity", _per("net_income", "stockholders_equity"), "pct"),
        ("return_on_capital_employed", "operating_income total_assets total_current_liabilities",
         lambda: div(c("operating_income"), c("total_assets") - c("total_current_liabilities")), "pct"),
        ("income_quality", "operating_cash_flow net_income", _per("operating_cash_flow", "net_income"), "multiple"),
    ),
    *_group(
        "Liquidity",
        ("current_ratio", "total_current_assets total_current_liabilities",
         _per("total_current_assets", "total_current_liabilities"), "multiple"),
        ("cash_ratio", "cash total_current_liabilities", _per("cash", "total_current_liabilities"), "multiple"),
    ),
    *_group(
        "Leverage",
        ("financial_leverage_ratio", "total_assets stockholders_equity",
         _per("total_assets", "stockholders_equity"), "multiple"),
    ),
    *_group(
        "Efficiency",
        ("asset_turnover", "revenue total_assets", _per("revenue", "total_assets"), "multiple"),
        ("payables_turnover", "cost_of_revenue accounts_payable",
         _size_per("cost_of_revenue", "accounts_payable"), "multiple"),
    ),
    *_group(
        "Cash Flow",
        ("operating_cash_flow_ratio", "operating_cash_flow total_current_liabilities",
         _per("operating_cash_flow", "total_current_liabilities"), "multiple"),
        ("operating_cash_flow_sales_ratio", "operating_cash_flow revenue",
         _per("operating_cash_flow", "revenue"), "pct"),
        ("free_cash_flow_to_operating_cash_flow_ratio", "free_cash_flow operating_cash_flow",
         _per("free_cash_flow", "operating_cash_flow"), "pct"),
        ("capital_expenditure_coverage_ratio", "operating_cash_flow capex",
         _per_size("operating_cash_flow", "capex"), "multiple"),
        ("dividend_payout_ratio", "dividends_paid net_income", _size_per("dividends_paid", "net_income"), "pct"),
        ("dividend_paid_and_capex_coverage_ratio", "operating_cash_flow dividends_paid capex",
         _payout_cover, "multiple"),
        ("interest_coverage_ratio", "operating_income interest_expense",
         _per_size("operating_income", "interest_expense"), "multiple"),
    ),
    *_group(
        "Per Share",
        ("revenue_per_share", f"revenue {SHARES}", _per("revenue", SHARES), "dollar"),
        ("net_income_per_share", f"net_income {SHARES}", _per("net_income", SHARES), "dollar"),
        ("cash_per_share", f"cash {SHARES}",
         lambda: div(c("cash") + _or0("short_term_investments"), c(SHARES)), "dollar"),
        ("book_value_per_share", f"stockholders_equity {SHARES}", _per("stockholders_equity", SHARES), "dollar"),
        ("operating_cash_flow_per_share", f"operating_cash_flow {SHARES}",
         _per("operating_cash_flow", SHARES), "dollar"),
        ("free_cash_flow_per_share", f"free_cash_flow {SHARES}", _per("free_cash_flow", SHARES), "dollar"),
    ),
    *_group(
        "Other",
        ("working_capital", "total_current_assets total_current_liabilities",
         lambda: c("total_current_assets") - c("total_current_liabilities"), "dollar"),
        ("net_debt", "long_term_debt short_term_debt cash", _net_debt, "dollar"),
    ),
]
NAMES = [r.name for r in REGISTRY]


def pick(names: list[str] | None = None) -> list[Ratio]:
    return REGISTRY if names is None else [r for r in REGISTRY if r.name in names]


def required_metrics() -> list[str]:
    """Stored metrics that the annual and quarterly ratio path reads.

    ``operating_expenses`` and ``accounts_receivable`` are no ratio input, so
    operating income is not rebuilt from them on this path.
    """
    base = {i for r in REGISTRY for i in r.inputs}
    base |= {
        "depreciation_and_amortization", "income_tax_expense", "interest_expense",
        "net_income", "operating_income", "commercial_paper", "long_term_debt_current",
        "nontrade_receivables", "short_term_investments",
    }
    return sorted(base)


def ratio_columns(names: list[str] | None = None) -> list[Column]:
    return [r.build().alias(r.name) for r in pick(names)]


def registry_table(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, r.name, r.category, r.display_format) for i, r in enumerate(REGISTRY)]
    return spark.createDataFrame(rows, "position int, ratio_name string, category string, display_format string")
