"""Reconciliation of two independent sources within a date tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyfold import model as M
from tallyfold.functions.columns import lookup, signed

c = F.col
POINT = ["ticker", "metric_type", "period_type", "period_end"]
EPS_TOLERANCE, PCT_TOLERANCE, MAX_DAYS = 0.02, 1.0, 7


# ---------------------------------------------------------------- bulk statement data


def dera_candidates(num: DataFrame, sub: DataFrame, tickers: DataFrame) -> DataFrame:
    """Typed values of known tags joined with their filing and company.

    ``num`` and ``sub`` are the typed readers' rows. Co-registrant rows and
    two- or three-quarter spans are left out. ``tickers`` is (cik, ticker).
    """
    tag_metric = {t: m for m, tags in M.DERA_TAGS.items() for t in tags}
    rows = num.withColumn("metric_type", lookup(c("tag"), tag_metric)).where(
        c("metric_type").isNotNull() & (F.coalesce(c("coreg"), F.lit("")) == "") & c("qtrs").isin(0, 1, 4))
    filings = sub.where(c("form").isin(M.TARGET_FORMS)).join(
        tickers.select(c("cik").cast("long").alias("cik"), "ticker").distinct(), "cik").select("adsh", "ticker", "form", "fp")
    full_year = c("form").isin("10-K", "10-K/A") & (c("fp") == "FY")
    stock = c("metric_type").isin(M.GOLDEN_STOCK_METRICS + M.DERA_DEBT_PARTS)
    flow = c("metric_type").isin(M.GOLDEN_FLOW_METRICS)
    period_type = (
        F.when((c("qtrs") == 0) & stock, F.when(full_year, M.ANNUAL).otherwise(M.QUARTERLY))
        .when((c("qtrs") == 1) & flow, M.QUARTERLY)
        .when((c("qtrs") == 4) & flow & full_year, M.ANNUAL)
    )
    return rows.join(filings, "adsh").withColumn("period_type", period_type).where(
        c("period_type").isNotNull()).select(*POINT, "value")


def resolve_candidates(candidates: DataFrame) -> DataFrame:
    """One value per point: the largest in absolute size, then the larger one."""
    return candidates.groupBy(*POINT).agg(F.max_by("value", F.struct(F.abs("value"), "value")).alias("value"))


def dera_points(candidates: DataFrame) -> DataFrame:
    """Resolved points with repaired operating income and equity, and canonical debt.

    Operating income must lie strictly between net income and gross profit;
    the smallest candidate that does wins, since segment values add up to more
    than the consolidated one.
    """
    keys = ["ticker", "period_type", "period_end"]
    names = M.GOLDEN_FLOW_METRICS + M.GOLDEN_STOCK_METRICS + M.DERA_DEBT_PARTS
    size = F.struct(F.abs("value").alias("size"), "value")
    w = W.partitionBy(*keys)

    def resolved(name: str) -> Column:
        return F.max(F.when(c("metric_type") == name, size))

    # one shuffle, by period; candidates are made distinct before a period's are held together
    placed = candidates.select("ticker", "period_type", "period_end", "value", "metric_type").repartition(*keys)
    bounded = placed.distinct().withColumns({
        "lo": resolved("net_income").over(w)["value"], "hi": resolved("gross_profit").over(w)["value"]})
    inside = (c("metric_type") == "operating_income") & (c("value") > c("lo")) & (c("value") < c("hi"))
    wide = bounded.groupBy(*keys).agg(
        *[resolved(n)["value"].alias(n) for n in names], F.min(F.when(inside, c("value"))).alias("__oi"))
    identity = c("total_assets") - c("total_liabilities")
    cur, debt_cur = c("__long_term_debt_current"), c("__debt_current")
    cp, total = c("__commercial_paper"), c("__long_term_debt_total")
    part = F.coalesce(cur, debt_cur)
    net = total - part
    long_debt = F.coalesce(
        c("__long_term_debt_noncurrent"),
        F.when(part.isNotNull(), F.when(net >= 0, net)).otherwise(total),
    )
    short_debt = F.coalesce(
        c("short_term_debt"), debt_cur,
        F.when(cp.isNotNull() | cur.isNotNull(), F.coalesce(cp, F.lit(0.0)) + F.coalesce(cur, F.lit(0.0))),
    )
    fixed = wide.withColumns({
        "operating_income": F.coalesce("__oi", "operating_income"),
        "stockholders_equity": F.when(
            c("stockholders_equity").isNotNull() & (F.abs(identity - c("stockholders_equity")) > 1.0), identity
        ).otherwise(c("stockholders_equity")),
        "long_term_debt": long_debt, "short_term_debt": short_debt,
    })
    shown = M.GOLDEN_FLOW_METRICS + M.GOLDEN_STOCK_METRICS
    return fixed.unpivot(keys, shown, "metric_type", "value").where(c("value").isNotNull()).select(*POINT, "value")


# ---------------------------------------------------------------- vendor statements


def vendor_points(statements: DataFrame, period_type: str, metrics: list[str] | None = None) -> DataFrame:
    """Vendor statement rows (symbol, period_end, field, value) through the field map; capex as a size."""
    keep = metrics or (M.GOLDEN_FLOW_METRICS + M.GOLDEN_STOCK_METRICS)
    fields = {k: v for k, v in {**M.VENDOR_FIELDS, **M.VENDOR_TTM_FIELDS}.items() if v in keep}
    rows = statements.withColumn("metric_type", lookup(c("field"), fields)).where(
        c("metric_type").isNotNull() & c("value").isNotNull())
    value = F.when(c("metric_type") == "capex", F.abs("value")).otherwise(c("value"))
    return rows.select(
        c("symbol").alias("ticker"), "metric_type", F.lit(period_type).alias("period_type"), "period_end",
        value.alias("value"),
    ).groupBy(*POINT).agg(F.max("value").alias("value"))


# ---------------------------------------------------------------- matching


def _side_by_side(left: DataFrame, right: DataFrame, keys: list[str], left_cols: list[str], right_cols: list[str]) -> DataFrame:
    """Both inputs as one relation, each row with the closest right row before and after it.

    Rows of one key lie in one window, so each input is read once and no pairs
    are formed. ``right`` has one row per key and date.
    """
    l_type = left.select(F.struct(*left_cols).alias("x")).schema["x"].dataType
    r_type = right.select(F.struct(*right_cols).alias("x")).schema["x"].dataType
    a = left.select(*keys, c("period_end").alias("__day"), F.struct(*left_cols).alias("l"), F.lit(None).cast(r_type).alias("r"))
    b = right.select(*keys, c("period_end").alias("__day"), F.lit(None).cast(l_type).alias("l"), F.struct(*right_cols).alias("r"))
    both = a.unionByName(b)
    right_first = c("r").isNull().cast("int")
    up = W.partitionBy(*keys).orderBy(c("__day"), right_first).rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(*keys).orderBy(c("__day").desc(), right_first).rowsBetween(W.unboundedPreceding, 0)
    return both.select(
        "*", F.last("r", ignorenulls=True).over(up).alias("before"), F.last("r", ignorenulls=True).over(down).alias("after"))


def _nearest(max_days: int) -> Column:
    """The closer neighbour within the tolerance, the earlier one on a tie."""
    ahead, behind = F.datediff("after.period_end", "__day"), F.datediff("__day", "before.period_end")
    pick = F.when(behind.isNotNull() & (ahead.isNull() | (behind <= ahead)), c("before")).otherwise(c("after"))
    days = F.least(behind, ahead)
    return F.when(c("l").isNotNull() & (days <= max_days), pick)


def match_within(left: DataFrame, right: DataFrame, keys: list[str], max_days: int = MAX_DAYS,
                 left_cols=("period_end", "value"), right_cols=("period_end", "value")) -> DataFrame:
    """For every left row the nearest right row with the same keys at most ``max_days`` away.

    The nearer date wins, then the earlier one.
    """
    rows = _side_by_side(left, right, keys, list(left_cols), list(right_cols))
    hit = rows.withColumn("m", _nearest(max_days)).where(c("m").isNotNull())
    return hit.select(
        *keys, *[c(f"l.{x}").alias(f"l_{x}") for x in left_cols],
        F.abs(F.datediff("l.period_end", "m.period_end")).alias("days"), *[c(f"m.{x}").alias(f"r_{x}") for x in right_cols])


MATCH_KEYS = ["ticker", "metric_type", "period_type"]


def source_matches(left: DataFrame, right: DataFrame, max_days: int = MAX_DAYS) -> DataFrame:
    return match_within(left, right, MATCH_KEYS, max_days)


def values_agree(metric: Column, a: Column, b: Column) -> Column:
    """EPS within an absolute tolerance, other metrics below one percent, zero only with zero."""
    pct = F.abs(a - b) / F.abs(F.nullif(a, F.lit(0.0))) * 100
    return F.when(metric == "eps_diluted", F.abs(a - b) < EPS_TOLERANCE).when(
        a != 0, pct < PCT_TOLERANCE).otherwise(b == 0)


def cross_reference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Matched points of both sources with their agreement."""
    return source_matches(left, right).withColumn("agrees", values_agree(c("metric_type"), c("l_value"), c("r_value")))


def cross_reference_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    return cross_reference(left, right).groupBy("metric_type", "period_type").agg(
        F.count("*").alias("pairs"), F.count_if("agrees").alias("matches"), F.count_if(~c("agrees")).alias("discrepancies"))


def merge_sources(left: DataFrame, right: DataFrame, left_name="dera", right_name="fmp", keep_right: bool = False) -> DataFrame:
    """All points with provenance: the left value counts, "both" when a right point lies close by.

    A right point that no left point took, on a date without a left point,
    stands for itself. With ``keep_right`` the right value of the same date
    comes along as ``right_value``, for :func:`apply_curation`.
    """
    rows = _side_by_side(left, right, MATCH_KEYS, ["period_end", "value"], ["period_end", "value"])
    rows = rows.withColumn("m", _nearest(MAX_DAYS))
    # one entry per left point, one per right point, one per right point taken
    parts = F.array(
        F.struct(c("__day").alias("period_end"), c("l.value").alias("lv"), c("m").isNotNull().alias("both"),
                 c("r.value").alias("rv"), F.lit(False).alias("taken")),
        F.struct(c("m.period_end").alias("period_end"), F.lit(None).cast("double").alias("lv"), F.lit(False).alias("both"),
                 F.lit(None).cast("double").alias("rv"), F.lit(True).alias("taken")),
    )
    flat = rows.select(*MATCH_KEYS, F.inline(parts)).where(c("period_end").isNotNull())
    g = flat.groupBy(*POINT).agg(
        F.max("lv").alias("lv"), F.bool_or("both").alias("both"), F.max("rv").alias("rv"), F.bool_or("taken").alias("taken"))
    return g.where(c("lv").isNotNull() | ~c("taken")).select(
        *POINT, F.coalesce("lv", "rv").alias("value"),
        F.when(c("lv").isNull(), right_name).when(c("both"), "both").otherwise(left_name).alias("source"),
        *([c("rv").alias("right_value")] if keep_right else []))


def apply_curation(points: DataFrame, preferred: DataFrame | None = None,
                   excluded_points: DataFrame | None = None, excluded_rules: DataFrame | None = None,
                   right_name: str = "fmp") -> DataFrame:
    """Take the right value at preferred points, then drop excluded points and (ticker, metric, type) rules.

    ``points`` carries ``right_value`` where points are preferred.
    """
    if preferred is not None:
        chosen = preferred.select(*POINT).distinct().withColumn("__p", F.lit(True))
        taken = c("__p") & c("right_value").isNotNull()
        points = points.join(chosen, POINT, "left").withColumns({
            "source": F.when(taken, right_name).otherwise(c("source")),
            "value": F.when(taken, c("right_value")).otherwise(c("value"))}).drop("__p")
    points = points.drop("right_value")
    if excluded_points is not None:
        points = points.join(excluded_points.select(*POINT).distinct(), POINT, "left_anti")
    if excluded_rules is not None:
        points = points.join(excluded_rules.select(*MATCH_KEYS).distinct(), MATCH_KEYS, "left_anti")
    return points


def with_tolerance(points: DataFrame) -> DataFrame:
    """Fixture rows: percent tolerance, absolute for EPS."""
    return points.withColumn("tolerance_pct", F.when(c("metric_type") == "eps_diluted", EPS_TOLERANCE).otherwise(PCT_TOLERANCE))


def write_fixture(points: DataFrame, path: str) -> None:
    """The fixture rows as JSON lines (gzip), in the order of ticker, metric, type and date over all files."""
    order = ["ticker", "metric_type", "period_type", "period_end"]
    points.select(*order, *[x for x in points.columns if x not in order]).orderBy(*order).write.mode("overwrite").option("compression", "gzip").json(path)


def fiscal_year_totals(points: DataFrame) -> DataFrame:
    return points.where((c("period_type") == M.ANNUAL) & c("metric_type").isin(M.GOLDEN_FLOW_METRICS)).select(
        "ticker", "metric_type", "period_end", "value")


# ---------------------------------------------------------------- expected values


def check_expected(actual: DataFrame, expected: DataFrame, max_days: int = MAX_DAYS) -> DataFrame:
    """Expected points against stored metrics: matched, value, and whether within tolerance.

    Expected values are brought to the canonical sign first.
    """
    want = expected.select(*POINT, signed(c("metric_type"), c("value")).alias("value"), "tolerance_pct")
    found = match_within(want, actual, MATCH_KEYS, max_days, ("period_end", "value", "tolerance_pct"))
    a, e, tol = c("r_value"), c("l_value"), c("l_tolerance_pct")
    ok = F.when(c("metric_type") == "eps_diluted", F.abs(a - e) <= tol).when(
        e != 0, F.abs(a - e) / F.abs(e) * 100 <= tol).otherwise(a == 0)
    checked = found.select(
        *MATCH_KEYS, c("l_period_end").alias("period_end"), a.alias("actual"), c("r_period_end").alias("actual_end"), ok.alias("passes"))
    return want.join(checked, POINT, "left").select(
        *POINT, c("value").alias("expected"), "actual", "actual_end", F.coalesce("passes", F.lit(False)).alias("passes"))


def check_ratios(actual: DataFrame, expected: DataFrame, max_days: int = MAX_DAYS) -> DataFrame:
    """Expected ratios (ticker, ratio_name, period_end, value, tolerance_pct) against computed ones."""
    keys = ["ticker", "ratio_name"]
    found = match_within(expected, actual, keys, max_days, ("period_end", "value", "tolerance_pct"))
    a, e = c("r_value"), c("l_value")
    ok = F.when(e == 0, F.abs(a) < 0.001).otherwise(F.abs(a - e) / F.abs(F.nullif(e, F.lit(0.0))) * 100 <= c("l_tolerance_pct"))
    return found.select(*keys, c("l_period_end").alias("period_end"), e.alias("expected"), a.alias("actual"), ok.alias("passes"))
