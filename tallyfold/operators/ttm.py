"""Trailing-twelve-month metrics for every ticker at once, optionally as of a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyfold import model as M
from tallyfold.functions.derived import DERIVED_INPUTS, with_derived
from tallyfold.operators.series import melt

c = F.col
OTHER_FLOW, OTHER_STOCK = "__other_flow", "__other_stock"
NAMES = M.FLOW_METRICS + M.STOCK_METRICS
OUTPUT = list(dict.fromkeys(NAMES + DERIVED_INPUTS + ["total_receivables"]))


def _candidates(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Quarterly rows, and annual ones of the fallback metrics.

    Metrics nobody asked for only matter through the ticker's newest date, so
    they share one name per kind and shrink to four rows.
    """
    annual_ok = (c("period_type") == M.ANNUAL) & c("metric_type").isin(M.TTM_ANNUAL_FALLBACK)
    other = F.when(c("metric_type").isin(M.FLOW_METRICS), OTHER_FLOW).otherwise(OTHER_STOCK)
    name = F.when(c("metric_type").isin(names), c("metric_type")).otherwise(other)
    return metrics.where((c("period_type") == M.QUARTERLY) | annual_ok).withColumn("metric_type", name)


def _newest_four(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, metric and period type: newest value, its date, and the sum of the newest four.

    The sum adds four picked values, so it is null unless all four exist, and
    the order of addition is fixed.
    """
    by = [*keys, "metric_type", "period_type"]
    w = W.partitionBy(*by).orderBy(c("period_end").desc())
    ranked = rows.select(*by, "period_end", "value", F.row_number().over(w).alias("rn")).where(c("rn") <= 4)
    pick = [F.max(F.when(c("rn") == i, c("value"))) for i in range(1, 5)]
    return ranked.groupBy(*by).agg(
        F.max("period_end").alias("newest"),
        pick[0].alias("last_value"),
        (pick[0] + pick[1] + pick[2] + pick[3]).alias("sum4"),
    )


def ttm_raw(metrics: DataFrame, keys: list[str], names: list[str] = NAMES) -> DataFrame:
    """Wide TTM row per key before derived metrics."""
    return _wide_from(_newest_four(_candidates(metrics, names), keys), keys, names)


def _wide_from(four: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Wide TTM row per key from the newest value, date and sum of four of each metric."""
    quarterly, flow = c("period_type") == M.QUARTERLY, c("metric_type").isin([*M.FLOW_METRICS, OTHER_FLOW])

    def pick(name: str, period_type: str, field: str) -> Column:
        return F.max(F.when((c("metric_type") == name) & (c("period_type") == period_type), c(field)))

    flows = [n for n in names if n in M.FLOW_METRICS]
    stocks = [n for n in names if n not in M.FLOW_METRICS]
    per_key = four.groupBy(*keys).agg(
        F.max(F.when(quarterly, c("newest"))).alias("__newest"),
        F.max(F.when(quarterly & ~flow, c("newest"))).alias("__newest_stock"),
        *[pick(n, M.QUARTERLY, f).alias(f"__q_{n}_{f}") for n in flows for f in ("newest", "sum4")],
        *[pick(n, M.QUARTERLY, "last_value").alias(f"__q_{n}") for n in stocks],
        *[pick(n, M.ANNUAL, f).alias(f"__a_{n}_{f}") for n in stocks if n in M.TTM_ANNUAL_FALLBACK
          for f in ("newest", "last_value")],
    )

    def flow_value(n: str) -> Column:
        fresh = F.datediff(c("__newest"), c(f"__q_{n}_newest")) <= M.TTM_MAX_FLOW_STALENESS_DAYS
        return F.when(fresh, c(f"__q_{n}_sum4")).alias(n)

    def stock_value(n: str) -> Column:
        own = c(f"__q_{n}")
        if n not in M.TTM_ANNUAL_FALLBACK:
            return own.alias(n)
        spare = c(f"__a_{n}_last_value")
        if n == "common_shares_outstanding":
            age = F.datediff(c("__newest_stock"), c(f"__a_{n}_newest"))
            spare = F.when(age.isNull() | (age <= M.TTM_MAX_SHARE_STALENESS_DAYS), spare)
        return F.coalesce(own, spare).alias(n)

    return per_key.select(*keys, *[flow_value(n) for n in flows], *[stock_value(n) for n in stocks])


def ttm_wide(metrics: DataFrame, as_of: str | None = None, tickers: list[str] | None = None,
             names: list[str] = NAMES) -> DataFrame:
    """TTM metrics with derived ones, one row per ticker; only data up to ``as_of`` counts.

    ``names`` limits the stored metrics that are read; a derived metric needs
    its inputs among them.
    """
    if tickers is not None:
        metrics = metrics.where(c("ticker").isin(tickers))
    if as_of:
        metrics = metrics.where(c("period_end") <= F.lit(as_of).cast("date"))
    return with_derived(ttm_raw(metrics, ["ticker"], names))


def ttm_wide_at(metrics: DataFrame, dates: DataFrame, names: list[str] = NAMES) -> DataFrame:
    """TTM metrics for many (ticker, as_of) points in one job.

    Every stored row knows its sum of four; it holds from its date until the
    next row of the metric. Rows and asked dates are put in one order by day,
    and a date takes the last row before it, so each row is read once, however
    many dates follow it. Dates before a ticker's first row have no result.
    """
    by = ["ticker", "metric_type", "period_type"]
    w = W.partitionBy(*by).orderBy("period_end")
    four = c("value") + F.lag("value", 1).over(w) + F.lag("value", 2).over(w) + F.lag("value", 3).over(w)
    rows = _candidates(metrics, names).select(
        *by, c("period_end").alias("day"), F.lit(0).alias("asked"),
        F.struct(c("period_end").alias("newest"), c("value").alias("last_value"), four.alias("sum4")).alias("r"))
    quarterly = [(n, M.QUARTERLY) for n in [*names, OTHER_FLOW, OTHER_STOCK]]
    annual = [(n, M.ANNUAL) for n in [*M.TTM_ANNUAL_FALLBACK, OTHER_STOCK, OTHER_FLOW]]
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("metric_type"), F.lit(p).alias("period_type")) for n, p in dict.fromkeys(quarterly + annual)]))
    points = dates.select("ticker", "as_of").distinct().withColumn("x", wanted).select(
        "ticker", "x.*", c("as_of").alias("day"), F.lit(1).alias("asked"), F.lit(None).cast(rows.schema["r"].dataType).alias("r"))
    before = F.last("r", ignorenulls=True).over(W.partitionBy(*by).orderBy("day", "asked").rowsBetween(W.unboundedPreceding, 0))
    found = rows.unionByName(points).withColumn("r", before).where((c("asked") == 1) & c("r").isNotNull())
    known = found.select("ticker", c("day").alias("as_of"), "metric_type", "period_type", "r.newest", "r.last_value", "r.sum4")
    return with_derived(_wide_from(known, ["ticker", "as_of"], names))


def ttm_long(wide: DataFrame, names: list[str] | None = None, keys: list[str] = ("ticker",)) -> DataFrame:
    return melt(wide, list(names) if names is not None else OUTPUT, list(keys))
