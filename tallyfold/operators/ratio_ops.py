"""Ratios over time, latest, trailing twelve months, and what builds on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyfold import model as M
from tallyfold.functions import ratios as R
from tallyfold.functions.columns import clamp_score, div
from tallyfold.functions.derived import with_derived
from tallyfold.operators.series import select_metrics, widen

c = F.col
SHARES = "common_shares_outstanding"


def split_adjusted(wide: DataFrame) -> DataFrame:
    """Put earlier share counts on the newest share basis.

    A jump to at least three times the previous positive count is a split; its
    rounded factor scales every earlier row. Scaling both neighbours leaves
    the ratio between them unchanged, so all factors can be read off the
    stored counts and multiplied.
    """
    w = W.partitionBy("ticker").orderBy("period_end")
    positive = F.when(c(SHARES) > 0, c(SHARES))
    before = F.last(positive, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    jump = div(positive, before)
    factor = F.when(jump >= 3.0, F.rint(jump)).otherwise(F.lit(1.0))
    later = F.product(c("__factor")).over(w.rowsBetween(1, W.unboundedFollowing))
    return (
        wide.withColumn("__factor", factor)
        .withColumn("__scale", F.coalesce(later, F.lit(1.0)))
        .withColumn(SHARES, F.when(c(SHARES) > 0, c(SHARES) * c("__scale")).otherwise(c(SHARES)))
        .drop("__factor", "__scale")
    )


def ratio_base(metrics: DataFrame, period_type: str = M.ANNUAL, tickers=None) -> DataFrame:
    """Wide metric rows, split-adjusted when annual, with derived metrics."""
    needed = R.required_metrics()
    rows = select_metrics(metrics, needed, period_type, tickers)
    wide = widen(rows, needed, ["ticker", "period_end"], [F.min("period").alias("period")])
    if period_type == M.ANNUAL:
        wide = split_adjusted(wide)
    return with_derived(wide)


def ratios_wide(metrics: DataFrame, period_type: str = M.ANNUAL, names=None, tickers=None) -> DataFrame:
    return ratio_base(metrics, period_type, tickers).select(
        "ticker", "period_end", "period", *R.ratio_columns(names)
    )


def ratios_long(metrics: DataFrame, period_type: str = M.ANNUAL, names=None, tickers=None) -> DataFrame:
    """(ticker, period_end, period, period_type, ratio_name, value) without missing ratios."""
    picked = [r.name for r in R.pick(names)]
    return (
        ratios_wide(metrics, period_type, names, tickers)
        .unpivot(["ticker", "period_end", "period"], picked, "ratio_name", "value")
        .where(c("value").isNotNull())
        .select("ticker", "period_end", "period", F.lit(period_type).alias("period_type"), "ratio_name", "value")
    )


def latest_ratios(metrics: DataFrame, period_type: str = M.ANNUAL, tickers=None) -> DataFrame:
    """Ratios of the newest period that has any; a ratio missing there is absent."""
    wide = ratios_wide(metrics, period_type, None, tickers)
    some = F.coalesce(*[c(n) for n in R.NAMES]).isNotNull()
    newest = wide.where(some).groupBy("ticker").agg(
        F.max(F.struct("period_end", *R.NAMES)).alias("n")
    )
    return (
        newest.select("ticker", "n.*")
        .unpivot(["ticker", "period_end"], R.NAMES, "ratio_name", "value")
        .where(c("value").isNotNull())
    )


def ttm_ratios_wide(ttm: DataFrame, names=None, keys=("ticker",)) -> DataFrame:
    return ttm.select(*keys, *R.ratio_columns(names))


def ttm_ratios(ttm: DataFrame, names=None, keys=("ticker",)) -> DataFrame:
    picked = [r.name for r in R.pick(names)]
    return (
        ttm_ratios_wide(ttm, names, keys)
        .unpivot(list(keys), picked, "ratio_name", "value")
        .where(c("value").isNotNull())
    )


def top_ttm_ratio(ttm: DataFrame, name: str, limit: int = 20) -> DataFrame:
    return (
        ttm_ratios_wide(ttm, [name]).where(c(name).isNotNull())
        .orderBy(c(name).desc(), c("ticker")).limit(limit)
    )


HEALTH_INPUTS = [
    "current_ratio", "financial_leverage_ratio", "interest_coverage_ratio",
    "gross_profit_margin", "return_on_equity",
    "free_cash_flow_to_operating_cash_flow_ratio",
]


def health_scores(latest: DataFrame, ttm: DataFrame) -> DataFrame:
    """0-100 scores of six ratios with a traffic light at 60 and 30.

    ``latest`` is long (ticker, ratio_name, value), ``ttm`` the wide TTM ratios.
    """
    wide = latest.groupBy("ticker").agg(
        *[F.max(F.when(c("ratio_name") == n, c("value"))).alias(n) for n in HEALTH_INPUTS]
    )
    cover = ttm.select("ticker", c("interest_coverage_ratio").alias("__ttm_cover"))
    scores = wide.join(cover, "ticker", "left").select(
        "ticker",
        clamp_score(c("current_ratio"), 0, 3).alias("current_ratio"),
        F.greatest(F.lit(0.0), 100 - clamp_score(c("financial_leverage_ratio"), 0, 10)).alias("financial_leverage_ratio"),
        clamp_score(F.coalesce("interest_coverage_ratio", "__ttm_cover"), 0, 20).alias("interest_coverage_ratio"),
        clamp_score(c("gross_profit_margin"), 0, 1).alias("gross_profit_margin"),
        clamp_score(c("return_on_equity"), 0, 0.4).alias("return_on_equity"),
        clamp_score(c("free_cash_flow_to_operating_cash_flow_ratio"), 0, 1).alias(
            "free_cash_flow_to_operating_cash_flow_ratio"),
    )
    return scores.unpivot(["ticker"], HEALTH_INPUTS, "ratio_name", "score").withColumn(
        "light", F.when(c("score") >= 60, "green").when(c("score") >= 30, "amber").otherwise("red")
    )
