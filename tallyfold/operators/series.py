"""Time series, pivots, growth, screens and statement views over the metric table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyfold import model as M
from tallyfold.functions.columns import display_format, div
from tallyfold.functions.derived import free_cash_flow
from tallyfold.session import numbered_once

c = F.col


def select_metrics(
    metrics: DataFrame,
    names: list[str] | None = None,
    period_type: str | None = None,
    tickers: list[str] | None = None,
) -> DataFrame:
    """Scan of the metric table; every argument is a predicate the scan can prune on."""
    if period_type:
        metrics = metrics.where(c("period_type") == period_type)
    if names is not None:
        metrics = metrics.where(c("metric_type").isin(list(names)))
    if tickers is not None:
        metrics = metrics.where(c("ticker").isin(list(tickers)))
    return metrics


def timeseries(metrics: DataFrame, names: list[str], period_type: str = M.ANNUAL, tickers=None) -> DataFrame:
    return select_metrics(metrics, names, period_type, tickers).select(
        "ticker", "metric_type", "value", "period_end"
    )


def widen(long: DataFrame, names: list[str], keys: list[str], extra: list[Column] = ()) -> DataFrame:
    """One column per metric, one row per key.

    A conditional max per name is one partial aggregate and one shuffle, where
    ``pivot`` would aggregate twice; the primary key makes both give the same.
    """
    picks = [F.max(F.when(c("metric_type") == n, c("value"))).alias(n) for n in names]
    return long.groupBy(*keys).agg(*picks, *extra)


def melt(wide: DataFrame, names: list[str], keys: list[str], name_col="metric_type") -> DataFrame:
    """Wide back to long without the missing cells."""
    return wide.unpivot(keys, names, name_col, "value").where(c("value").isNotNull())


def pivot_metrics(metrics: DataFrame, names: list[str], period_type: str = M.ANNUAL, tickers=None) -> DataFrame:
    return widen(select_metrics(metrics, names, period_type, tickers), names, ["ticker", "period_end"])


def all_tickers(metrics: DataFrame) -> DataFrame:
    return metrics.select("ticker").distinct().orderBy("ticker")


def table_stats(metrics: DataFrame) -> DataFrame:
    return metrics.agg(
        F.count("*").alias("row_count"),
        F.count_distinct("ticker").alias("ticker_count"),
        F.count_distinct("metric_type").alias("metric_count"),
        F.min("period_end").alias("first_period"),
        F.max("period_end").alias("last_period"),
    )


def latest_values(metrics: DataFrame, period_type: str = M.ANNUAL, tickers=None) -> DataFrame:
    """Newest value of every metric of every ticker."""
    newest = F.max(F.struct("period_end", "value"))
    return (
        select_metrics(metrics, None, period_type, tickers)
        .groupBy("ticker", "metric_type")
        .agg(newest.alias("n"))
        .select("ticker", "metric_type", c("n.value").alias("value"), c("n.period_end").alias("period_end"))
    )


def company_profiles(metrics: DataFrame, companies: DataFrame, period_type: str = M.ANNUAL) -> DataFrame:
    """Latest metrics as a map beside the company reference attributes."""
    latest = latest_values(metrics, period_type).groupBy("ticker").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric_type", "value")))).alias("latest_metrics"),
        F.max("period_end").alias("last_period"),
    )
    return companies.join(latest, "ticker", "left")


def top_companies(metrics: DataFrame, metric: str, period_type: str = M.ANNUAL, limit: int = 20) -> DataFrame:
    """Top companies by the latest value of one metric; ties by ticker."""
    return (
        select_metrics(metrics, [metric], period_type)
        .groupBy("ticker")
        .agg(F.max(F.struct("period_end", "value")).alias("n"))
        .select("ticker", c("n.value").alias("value"), c("n.period_end").alias("period_end"))
        .orderBy(c("value").desc(), c("ticker"))
        .limit(limit)
    )


def newest_rows(metrics: DataFrame, names: list[str], n: int, period_type: str = M.ANNUAL) -> DataFrame:
    """The n newest rows of each metric, numbered newest first."""
    w = W.partitionBy("ticker", "metric_type").orderBy(c("period_end").desc())
    return (
        timeseries(metrics, names, period_type)
        .withColumn("rank", F.row_number().over(w))
        .where(c("rank") <= n)
    )


def growth_of_wide(wide: DataFrame, names: list[str], step: int) -> DataFrame:
    """Percent change against the row ``step`` places earlier in the pivot."""
    w = W.partitionBy("ticker").orderBy("period_end")
    lagged = wide.select(
        "ticker", "period_end", *names, *[F.lag(n, step).over(w).alias(f"{n}__prev") for n in names]
    )

    def defined(n: str) -> Column:
        now, prev = c(n), c(f"{n}__prev")
        return now.isNotNull() & prev.isNotNull() & ~((now == 0) & (prev == 0))

    has_any = reduce(lambda a, b: a | b, [defined(n) for n in names])
    return lagged.where(has_any).select(
        "ticker", "period_end", *[((div(c(n), c(f"{n}__prev")) - 1) * 100).alias(n) for n in names]
    )


def growth_rates(metrics: DataFrame, names: list[str], period_type: str = M.ANNUAL, tickers=None) -> DataFrame:
    step = 4 if period_type == M.QUARTERLY else 1
    return growth_of_wide(pivot_metrics(metrics, names, period_type, tickers), names, step)


# ---------------------------------------------------------------- cash flow


def cashflow_pivot(metrics: DataFrame, period_type: str = M.ANNUAL, tickers=None) -> DataFrame:
    """Cash-flow pivot with free cash flow rebuilt as operating cash flow plus capex."""
    wide = pivot_metrics(metrics, M.CASHFLOW_METRICS, period_type, tickers)
    return wide.withColumn(
        "free_cash_flow", free_cash_flow(c("operating_cash_flow"), c("capex"), c("free_cash_flow"))
    )


def cashflow_timeseries(metrics: DataFrame, period_type: str = M.ANNUAL, tickers=None) -> DataFrame:
    return melt(cashflow_pivot(metrics, period_type, tickers), M.CASHFLOW_METRICS, ["ticker", "period_end"])


def fcf_ranking(metrics: DataFrame, tickers: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """All companies, or the top ``limit``, by their latest annual free cash flow.

    With a ticker list all of them are ranked, but only when every one has a value.
    """
    latest = (
        cashflow_pivot(metrics, M.ANNUAL, tickers)
        .where(c("free_cash_flow").isNotNull())
        .groupBy("ticker")
        .agg(F.max(F.struct("period_end", "free_cash_flow")).alias("n"))
        .select("ticker", c("n.period_end").alias("period_end"), c("n.free_cash_flow").alias("free_cash_flow"))
    )
    order = (c("free_cash_flow").desc(), c("ticker"))
    if tickers is None:
        return ranked(latest, *order) if limit is None else top_ranked(latest, limit, *order)
    size = len(set(tickers))
    named = top_ranked(latest, size, *order).withColumn("__found", F.count("*").over(W.partitionBy(F.lit(1))))
    return named.where(c("__found") == size).drop("__found")


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """All rows with their 1-based rank in a total order.

    Rows are dealt by ranges of the order and numbered inside their partition;
    the partitions' sizes, one row each, give the offsets. Only those meet in
    one task.
    """
    place = F.monotonically_increasing_id()
    rows = numbered_once(df.orderBy(*order).select("*", F.shiftright(place, 33).alias("__part"), place.bitwiseAND((1 << 33) - 1).alias("__at")))
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(W.orderBy("__part")) - c("__n")).alias("__before"))
    return rows.join(before, "__part").withColumn("rank", (c("__before") + c("__at") + 1).cast("int")).drop("__part", "__at", "__before")


def top_ranked(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first ``limit`` rows of a total order with their 1-based rank.

    The limit runs as a distributed top-k, so the ranking window only ever
    sees ``limit`` rows.
    """
    return df.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def fcf_versus_capex(metrics: DataFrame) -> DataFrame:
    """Latest annual free cash flow against latest annual capex."""
    series = melt(cashflow_pivot(metrics), ["free_cash_flow", "capex"], ["ticker", "period_end"])
    newest = series.groupBy("ticker").agg(
        *[
            F.max(F.when(c("metric_type") == n, F.struct("period_end", "value"))).alias(n)
            for n in ("free_cash_flow", "capex")
        ]
    )
    fcf, capex = c("free_cash_flow.value"), F.abs(c("capex.value"))
    return newest.where(c("free_cash_flow").isNotNull() & c("capex").isNotNull()).select(
        "ticker",
        c("free_cash_flow.period_end").alias("period_end"),
        fcf.alias("free_cash_flow"),
        capex.alias("capex"),
        (fcf - capex).alias("difference"),
        (div(fcf, capex) * 100.0).alias("coverage_pct"),
    )


# ---------------------------------------------------------------- margins


def margin_rows(wide: DataFrame) -> DataFrame:
    """Gross, operating and net margin of rows with revenue other than zero."""
    return wide.where(c("revenue").isNotNull() & (c("revenue") != 0)).select(
        "ticker",
        "period_end",
        "revenue",
        "gross_profit",
        div(c("gross_profit"), c("revenue")).alias("gross_margin"),
        "operating_income",
        div(c("operating_income"), c("revenue")).alias("operating_margin"),
        "net_income",
        div(c("net_income"), c("revenue")).alias("net_margin"),
    )


def quarterly_margins(metrics: DataFrame, tickers=None) -> DataFrame:
    return margin_rows(pivot_metrics(metrics, M.GROWTH_METRICS, M.QUARTERLY, tickers))


def _recent_net_margins(metrics: DataFrame, n: int) -> DataFrame:
    """Net margin of the n newest quarters that report revenue."""
    wide = pivot_metrics(metrics, ["revenue", "net_income"], M.QUARTERLY).where(c("revenue").isNotNull())
    w = W.partitionBy("ticker").orderBy(c("period_end").desc())
    return (
        wide.withColumn("rn", F.row_number().over(w))
        .where((c("rn") <= n) & (c("revenue") != 0) & c("net_income").isNotNull())
        .withColumn("net_margin", div(c("net_income"), c("revenue")))
    )


def bull_bear(metrics: DataFrame, ttm_wide: DataFrame, n: int = 8) -> DataFrame:
    """Strongest margin quarter, and the bear point: negative TTM cash flow or the weakest quarter."""
    point = F.struct("net_margin", "period_end")
    ends = _recent_net_margins(metrics, n).groupBy("ticker").agg(
        F.max(point).alias("best"), F.min(point).alias("worst")
    )
    fcf = ttm_wide.select("ticker", c("free_cash_flow").alias("ttm_free_cash_flow"))
    burning = c("ttm_free_cash_flow") < 0
    return ends.join(fcf, "ticker", "left").select(
        "ticker",
        c("best.period_end").alias("bull_period_end"),
        c("best.net_margin").alias("bull_net_margin"),
        F.when(burning, "ttm_free_cash_flow").otherwise("weakest_quarter").alias("bear_kind"),
        F.when(burning, c("ttm_free_cash_flow")).otherwise(c("worst.net_margin")).alias("bear_value"),
        F.when(burning, None).otherwise(c("worst.period_end")).alias("bear_period_end"),
    )


def margin_trend(metrics: DataFrame, n: int = 8) -> DataFrame:
    """Newest against oldest net margin in the window of the n newest quarters."""
    at = F.struct("period_end", "net_margin")
    return (
        _recent_net_margins(metrics, n)
        .groupBy("ticker")
        .agg(F.max(at).alias("newest"), F.min(at).alias("oldest"), F.count("*").alias("quarters"))
        .select(
            "ticker",
            "quarters",
            c("oldest.period_end").alias("oldest_period_end"),
            c("oldest.net_margin").alias("oldest_net_margin"),
            c("newest.period_end").alias("newest_period_end"),
            c("newest.net_margin").alias("newest_net_margin"),
            F.when(c("newest.net_margin") > c("oldest.net_margin"), "improving overall")
            .otherwise("not improving overall")
            .alias("direction"),
        )
    )


def annual_growth_and_margin(metrics: DataFrame, n: int = 4) -> DataFrame:
    """The last n annual revenue growth rates and net margins, with first and last of each."""
    wide = pivot_metrics(metrics, ["revenue", "net_income"], M.ANNUAL)
    growth = growth_rates(metrics, ["revenue"]).where(c("revenue").isNotNull()).select(
        "ticker", F.lit("revenue_growth_pct").alias("series"), "period_end", c("revenue").alias("value")
    )
    margin = wide.select(
        "ticker",
        F.lit("net_margin_pct").alias("series"),
        "period_end",
        (div(c("net_income"), c("revenue")) * 100.0).alias("value"),
    ).where(c("value").isNotNull())
    w = W.partitionBy("ticker", "series").orderBy(c("period_end").desc())
    last = growth.unionByName(margin).withColumn("rn", F.row_number().over(w)).where(c("rn") <= n)
    at = F.struct("period_end", "value")
    return (
        last.groupBy("ticker", "series")
        .agg(F.min(at).alias("a"), F.max(at).alias("b"), F.count("*").alias("periods"))
        .where(c("periods") >= 2)
        .select(
            "ticker", "series", "periods",
            c("a.period_end").alias("first_period_end"), c("a.value").alias("first_value"),
            c("b.period_end").alias("last_period_end"), c("b.value").alias("last_value"),
        )
    )


# ---------------------------------------------------------------- quarterly detail


def quarterly_detail(metrics: DataFrame, names: list[str], ttm_long: DataFrame, n: int = 8) -> DataFrame:
    """Per ticker and requested metric: TTM and the newest n quarters as q1..qn.

    The quarter window is that of the requested metrics together, so a stale
    metric shows nulls. TTM shows only for metrics that reach the newest
    visible quarter. ``ttm_long`` is (ticker, metric_type, value).
    """
    quarters = widen(
        select_metrics(metrics, names, M.QUARTERLY), names, ["ticker", "period_end"],
        [F.min("period").alias("period")],
    )
    w = W.partitionBy("ticker").orderBy(c("period_end").desc())
    window = quarters.withColumn("rn", F.row_number().over(w)).where(c("rn") <= n)
    cells = window.unpivot(["ticker", "rn", "period_end", "period"], names, "metric_type", "value")
    shown = cells.groupBy("ticker", "metric_type").agg(
        F.max("period_end").alias("window_end"),
        *[F.max(F.when(c("rn") == i, c("value"))).alias(f"q{i}") for i in range(1, n + 1)],
        *[F.max(F.when(c("rn") == i, c("period"))).alias(f"q{i}_label") for i in range(1, n + 1)],
        F.max(F.when(c("value").isNotNull(), c("period_end"))).alias("metric_end"),
    )
    ttm = ttm_long.where(c("metric_type").isin(names)).select("ticker", "metric_type", c("value").alias("__ttm"))
    order = F.array_position(F.lit(names), c("metric_type")).cast("int")
    return shown.join(ttm, ["ticker", "metric_type"], "left").select(
        "ticker",
        "metric_type",
        order.alias("position"),
        F.when(c("metric_end") == c("window_end"), c("__ttm")).alias("ttm"),
        *[f"q{i}" for i in range(1, n + 1)],
        *[f"q{i}_label" for i in range(1, n + 1)],
    )


# ---------------------------------------------------------------- statement views


def statement_table(
    metrics: DataFrame, names: list[str], ttm_long: DataFrame, period_type: str = M.ANNUAL, n: int = 8
) -> DataFrame:
    """Metrics as rows; TTM first, then the n newest periods of the ticker, newest first."""
    wide = pivot_metrics(metrics, names, period_type)
    w = W.partitionBy("ticker").orderBy(c("period_end").desc())
    recent = wide.withColumn("rn", F.row_number().over(w)).where(c("rn") <= n)
    cells = recent.unpivot(["ticker", "rn"], names, "metric_type", "value")
    table = cells.groupBy("ticker", "metric_type").agg(
        *[F.max(F.when(c("rn") == i, c("value"))).alias(f"p{i}") for i in range(1, n + 1)]
    )
    ttm = ttm_long.where(c("metric_type").isin(names)).select("ticker", "metric_type", c("value").alias("ttm"))
    return table.join(ttm, ["ticker", "metric_type"], "left").select(
        "ticker", "metric_type", display_format(c("metric_type")).alias("display_format"), "ttm",
        *[f"p{i}" for i in range(1, n + 1)],
    )


def kpi_cards(metrics: DataFrame, ttm_long: DataFrame, period_type: str = M.ANNUAL) -> DataFrame:
    """Key metrics: TTM or else the latest value, and the newest year-over-year change as a fraction."""
    names = M.KEY_METRICS
    latest = latest_values(metrics.where(c("metric_type").isin(names)), period_type)
    growth = growth_rates(metrics, names, period_type)
    w = W.partitionBy("ticker").orderBy(c("period_end").desc())
    newest_growth = (
        growth.withColumn("rn", F.row_number().over(w)).where(c("rn") == 1)
        .unpivot(["ticker"], names, "metric_type", "growth_pct")
    )
    ttm = ttm_long.where(c("metric_type").isin(names)).select("ticker", "metric_type", c("value").alias("ttm"))
    return (
        latest.select("ticker", "metric_type", c("value").alias("latest"))
        .join(ttm, ["ticker", "metric_type"], "full")
        .join(newest_growth, ["ticker", "metric_type"], "left")
        .select(
            "ticker", "metric_type",
            F.coalesce("ttm", "latest").alias("value"),
            (c("growth_pct") / 100).alias("change"),
        )
    )


# ---------------------------------------------------------------- history screens


def metric_history(metrics: DataFrame, names: list[str], n: int | None = None) -> DataFrame:
    """Quarterly values with quarter-over-quarter and year-over-year percent, rounded to 2."""
    w = W.partitionBy("ticker", "metric_type").orderBy("period_end")

    def change(k: int) -> Column:
        return F.round((div(c("value"), F.lag("value", k).over(w)) - 1) * 100, 2)

    rows = select_metrics(metrics, names, M.QUARTERLY).select(
        "ticker", "metric_type", "period", "period_end", "value",
        change(4).alias("yoy_growth_pct"), change(1).alias("qoq_growth_pct"),
    )
    if n is None:
        return rows
    newest = W.partitionBy("ticker", "metric_type").orderBy(c("period_end").desc())
    return rows.withColumn("rn", F.row_number().over(newest)).where(c("rn") <= n).drop("rn")


def margin_compression(ratio_rows: DataFrame, ratio: str = "gross_profit_margin", share: float = 0.95) -> DataFrame:
    """Quarters whose margin lies below ``share`` of the moving average of four quarters."""
    w = W.partitionBy("ticker").orderBy("period_end").rowsBetween(-3, 0)
    return (
        ratio_rows.where(c("ratio_name") == ratio)
        .select("ticker", "period_end", c("value").alias("margin"), F.avg("value").over(w).alias("margin_4q_avg"))
        .where(c("margin") < c("margin_4q_avg") * share)
    )


def peer_growth_ranking(metrics: DataFrame, metric: str = "revenue", limit: int | None = None) -> DataFrame:
    """All peers, or the top ``limit``, by the change of the newest quarter against three rows earlier."""
    w = W.partitionBy("ticker").orderBy("period_end")
    newest = W.partitionBy("ticker").orderBy(c("period_end").desc())
    start = F.first("value").over(w.rowsBetween(-3, 0))
    latest = (
        select_metrics(metrics, [metric], M.QUARTERLY)
        .select("ticker", "period_end", c("value").alias("latest_value"),
                (div(c("value"), start) - 1).alias("growth"), F.row_number().over(newest).alias("rn"))
        .where(c("rn") == 1)
        .drop("rn")
    )
    order = (c("growth").desc_nulls_last(), c("ticker"))
    return ranked(latest, *order) if limit is None else top_ranked(latest, limit, *order)


def macro_recent(macro: DataFrame, indicator: str, n: int = 60) -> DataFrame:
    return (
        macro.where(c("indicator_id") == indicator).select("indicator_id", "date", "value")
        .orderBy(c("date").desc()).limit(n)
    )
