"""Data-quality checks: each returns the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold import model as M
from tallyfold.operators.series import pivot_metrics, widen

c = F.col


def quarters_off_total(metrics: DataFrame, names: list[str], tolerance: float = 0.01) -> DataFrame:
    """Calendar years whose four quarters do not add up to the annual value."""
    rows = metrics.where(c("metric_type").isin(names)).withColumn("yr", F.year("period_end"))
    quarterly, annual = c("period_type") == M.QUARTERLY, c("period_type") == M.ANNUAL
    g = rows.groupBy("ticker", "metric_type", "yr").agg(
        F.sum(F.when(quarterly, c("value")).cast("decimal(38,6)")).cast("double").alias("quarter_sum"),
        F.count_if(quarterly).alias("quarters"), F.max(F.when(annual, c("value"))).alias("annual_value"),
    )
    return g.where((c("quarters") == 4) & (F.abs(c("quarter_sum") - c("annual_value")) > tolerance))


def balance_breaks(metrics: DataFrame, tolerance_pct: float = 10.0) -> DataFrame:
    """Annual rows where assets differ from liabilities plus equity by the tolerance or more."""
    wide = pivot_metrics(metrics, ["total_assets", "total_liabilities", "stockholders_equity"], M.ANNUAL)
    gap = F.abs(c("total_assets") - (c("total_liabilities") + c("stockholders_equity")))
    return wide.withColumn("diff_pct", F.try_divide(gap, c("total_assets")) * 100).where(c("diff_pct") >= tolerance_pct)


def income_order_breaks(metrics: DataFrame, need_net_income: bool = True) -> DataFrame:
    """Annual rows that break net income < operating income < gross profit."""
    wide = pivot_metrics(metrics, ["net_income", "operating_income", "gross_profit"], M.ANNUAL)
    bad = ~(c("operating_income") < c("gross_profit"))
    if need_net_income:
        bad = bad | ~(c("net_income") < c("operating_income"))
    complete = c("operating_income").isNotNull() & c("gross_profit").isNotNull()
    if need_net_income:
        complete = complete & c("net_income").isNotNull()
    return wide.where(complete & bad)


def label_breaks(metrics: DataFrame) -> DataFrame:
    lead = F.when(c("period_type") == M.ANNUAL, "Twelve Months Ended ").when(c("period_type") == M.QUARTERLY, "Quarter Ended ")
    return metrics.where(~c("period").startswith(lead))


def core_metric_gaps(metrics: DataFrame, core: list[str] = M.CORE_METRICS) -> DataFrame:
    """Tickers without a core metric, or without annual or quarterly rows."""
    have = metrics.groupBy("ticker").agg(
        F.collect_set(F.when(c("metric_type").isin(core), c("metric_type"))).alias("m"),
        F.collect_set("period_type").alias("p"),
    )
    missing = F.concat(F.array_except(F.lit(core), c("m")), F.array_except(F.lit([M.ANNUAL, M.QUARTERLY]), c("p")))
    return have.select("ticker", F.explode(missing).alias("missing"))
