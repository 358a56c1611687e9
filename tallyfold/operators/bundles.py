"""What the views of a company show together, for all companies at once.

Every bundle is one long table: ``ticker``, ``part``, ``period`` (a date, or TTM),
``name``, ``value``. A view filters it by ticker; nothing is assembled per company.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold import model as M
from tallyfold.operators import ratio_ops as RO
from tallyfold.operators import series as S
from tallyfold.operators import ttm as T

c = F.col
EARNINGS_QUALITY = ["net_income", "operating_cash_flow"]


def _part(rows: DataFrame, part: str, name: str, period: str | None = "period_end") -> DataFrame:
    day = c(period).cast("string") if period else F.lit("TTM")
    return rows.where(c("value").isNotNull()).select("ticker", F.lit(part).alias("part"), day.alias("period"), c(name).alias("name"), "value")


def _together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _series(metrics: DataFrame, names: list[str], period_type: str, part: str = "series") -> DataFrame:
    return _part(S.timeseries(metrics, names, period_type), part, "metric_type")


def _growth(metrics: DataFrame, names: list[str], period_type: str) -> DataFrame:
    return _part(S.melt(S.growth_rates(metrics, names, period_type), names, ["ticker", "period_end"]), "growth", "metric_type")


def _ttm(metrics: DataFrame, names: list[str]) -> DataFrame:
    return _part(T.ttm_long(T.ttm_wide(metrics), [n for n in names if n in T.OUTPUT]), "ttm", "metric_type", None)


def income(metrics: DataFrame, period_type: str = M.ANNUAL) -> DataFrame:
    return _together(_series(metrics, M.INCOME_METRICS, period_type), _ttm(metrics, M.INCOME_METRICS))


def balance(metrics: DataFrame, period_type: str = M.ANNUAL) -> DataFrame:
    return _together(_series(metrics, M.BALANCE_METRICS, period_type), _ttm(metrics, M.BALANCE_METRICS))


def cashflow(metrics: DataFrame, period_type: str = M.ANNUAL) -> DataFrame:
    rows = _part(S.cashflow_timeseries(metrics, period_type), "series", "metric_type")
    return _together(rows, _ttm(metrics, M.CASHFLOW_METRICS))


def growth(metrics: DataFrame, period_type: str = M.ANNUAL) -> DataFrame:
    """Growth, the metrics behind the margins, and net income beside operating cash flow."""
    return _together(_growth(metrics, M.GROWTH_METRICS, period_type), _series(metrics, M.GROWTH_METRICS, period_type, "margins"),
                     _series(metrics, EARNINGS_QUALITY, period_type, "earnings_quality"))


def kpi(metrics: DataFrame, period_type: str = M.ANNUAL) -> DataFrame:
    """Newest value of every metric, growth and TTM of the key metrics."""
    return _together(_part(S.latest_values(metrics, period_type), "summary", "metric_type"),
                     _growth(metrics, M.KEY_METRICS, period_type), _ttm(metrics, M.KEY_METRICS))


def _ttm_ratios(metrics: DataFrame) -> DataFrame:
    return _part(RO.ttm_ratios(T.ttm_wide(metrics)), "ttm", "ratio_name", None)


def ratios(metrics: DataFrame, period_type: str = M.ANNUAL) -> DataFrame:
    return _together(_part(RO.latest_ratios(metrics, period_type), "latest", "ratio_name"),
                     _part(RO.ratios_long(metrics, period_type), "series", "ratio_name"), _ttm_ratios(metrics))


def health(metrics: DataFrame, period_type: str = M.ANNUAL) -> DataFrame:
    return _together(_part(RO.latest_ratios(metrics, period_type), "latest", "ratio_name"), _ttm_ratios(metrics),
                     _growth(metrics, ["revenue"], M.ANNUAL))


BUNDLES = {"income": income, "balance": balance, "cashflow": cashflow, "growth": growth, "kpi": kpi, "ratios": ratios, "health": health}


# ---------------------------------------------------------------- composed answers


def quarterly_and_ttm(metrics: DataFrame, names: list[str], n: int = 8) -> DataFrame:
    """The newest ``n`` quarters of each metric, the margins of all quarters, and TTM values."""
    quarters = _part(S.newest_rows(metrics, names, n, M.QUARTERLY), "quarter", "metric_type")
    margins = S.quarterly_margins(metrics)
    shown = [x for x in margins.columns if x.endswith("margin")]
    return _together(quarters, _part(S.melt(margins, shown, ["ticker", "period_end"]), "margin", "metric_type"), _ttm(metrics, names))


def events_with_cash_flow(events: DataFrame, metrics: DataFrame) -> DataFrame:
    """Material events of a company beside its newest annual cash flow before each event, and the newest of all.

    ``events`` has ticker, filing_date, accession_number, item_code.
    """
    from pyspark.sql import Window as W

    flows = S.cashflow_pivot(metrics, M.ANNUAL).select("ticker", c("period_end").alias("day"), F.struct("period_end", "operating_cash_flow", "free_cash_flow").alias("flow"))
    marked = events.select("ticker", c("filing_date").alias("day"), "accession_number", "item_code", F.lit(None).cast(flows.schema["flow"].dataType).alias("flow"), F.lit(1).alias("kind"))
    both = marked.unionByName(flows.select("ticker", "day", F.lit(None).cast("string").alias("accession_number"), F.lit(None).cast("string").alias("item_code"), "flow", F.lit(0).alias("kind")))
    w = W.partitionBy("ticker")
    known = F.last("flow", ignorenulls=True).over(w.orderBy("day", "kind").rowsBetween(W.unboundedPreceding, 0))
    newest = F.max(F.when(c("kind") == 0, c("flow"))).over(w)
    return both.withColumns({"known": known, "newest": newest}).where(c("kind") == 1).select(
        "ticker", c("day").alias("filing_date"), "accession_number", "item_code",
        c("known.period_end").alias("known_period"), c("known.operating_cash_flow").alias("known_operating_cash_flow"), c("known.free_cash_flow").alias("known_free_cash_flow"),
        c("newest.period_end").alias("latest_period"), c("newest.free_cash_flow").alias("latest_free_cash_flow"))
