"""Metrics derived from other metrics, as columns over one wide row per period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.columns import div
from tallyfold.model import COST_RATIO_RANGE

DERIVED_INPUTS = [
    "ebitda", "operating_income", "depreciation_and_amortization", "net_income",
    "income_tax_expense", "interest_expense", "operating_cash_flow", "capex",
    "free_cash_flow", "gross_profit", "revenue", "cost_of_revenue",
    "operating_expenses", "short_term_debt", "commercial_paper",
    "long_term_debt_current", "accounts_receivable", "nontrade_receivables",
]


def free_cash_flow(ocf: Column, capex: Column, stored: Column) -> Column:
    """Operating cash flow plus (negative) capex; the stored value if a part is missing."""
    return F.coalesce(ocf + capex, stored)


def plausible_gross_profit(revenue: Column, cost: Column) -> Column:
    """revenue + (negative) cost when the cost share looks like real cost of goods."""
    lo, hi = COST_RATIO_RANGE
    return F.when(F.abs(div(cost, revenue)).between(lo, hi), revenue + cost)


def sum_of_present(a: Column, b: Column) -> Column:
    """Sum that treats one missing side as zero; null when both are missing."""
    zero = F.lit(0.0)
    return F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, zero) + F.coalesce(b, zero))


def with_derived(wide: DataFrame) -> DataFrame:
    """Fill the derived metrics of a wide metric row.

    The order is part of the meaning: EBITDA reads operating income before it
    is itself derived, and derived operating income reads derived gross profit.
    """
    for name in DERIVED_INPUTS:
        if name not in wide.columns:
            wide = wide.withColumn(name, F.lit(None).cast("double"))
    c = {n: F.col(n) for n in DERIVED_INPUTS}
    wide = wide.withColumns({
        "ebitda": F.coalesce(
            c["ebitda"],
            c["operating_income"] - c["depreciation_and_amortization"],
            c["net_income"] - c["income_tax_expense"] - c["interest_expense"]
            - c["depreciation_and_amortization"],
        ),
        "free_cash_flow": free_cash_flow(c["operating_cash_flow"], c["capex"], c["free_cash_flow"]),
        "gross_profit": F.coalesce(
            c["gross_profit"], plausible_gross_profit(c["revenue"], c["cost_of_revenue"])
        ),
        "short_term_debt": F.coalesce(
            c["short_term_debt"], sum_of_present(c["commercial_paper"], c["long_term_debt_current"])
        ),
        "total_receivables": sum_of_present(c["accounts_receivable"], c["nontrade_receivables"]),
    })
    return wide.withColumn(
        "operating_income",
        F.coalesce(c["operating_income"], F.col("gross_profit") + c["operating_expenses"]),
    )
