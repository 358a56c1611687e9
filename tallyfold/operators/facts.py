"""From raw reported facts to discrete metric rows, for all companies in one pass.

The facts are scanned once. Every fact says which slots it competes for; one
partial aggregate keeps the best value per slot, a second one brings the
cumulative values of a fiscal year together and subtracts them, a third keeps
the preferred row per stored key, and a last one completes each period.
Each shuffle carries slots, never raw rows, so a company (or a concept) with a
large share of all facts is reduced before it is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyfold import model as M
from tallyfold.functions.columns import duration_bucket, flip_zero, period_label, signed
from tallyfold.functions.derived import plausible_gross_profit

c = F.col
LABELS = ["FY", "Q1", "Q2", "Q3", "Q4"]
ROW = ["ticker", "cik", "metric_type", "value", "currency", "period", "period_type", "period_end",
       "source", "accession"]
KEYS = ["ticker", "cik", "accession", "form", "strategy", "metric_type", "alias_rank"]
DEBT = "__ltd_"


CONCEPT_ROWS = [
    (M.TAG_PREFIX + tag, metric, rank)
    for metric, tags in M.CONCEPT_ALIASES.items()
    for rank, tag in enumerate(tags)
]


def concept_table(spark: SparkSession) -> DataFrame:
    """The fixed concept dictionary (55 rows), safe to broadcast at any scale."""
    return spark.createDataFrame(CONCEPT_ROWS, "concept string, metric_type string, alias_rank int")


def map_concepts(facts: DataFrame) -> DataFrame:
    """Keep facts of known concepts, with metric and alias rank."""
    return facts.join(F.broadcast(concept_table(facts.sparkSession)), "concept")


def company_unit_ok() -> Column:
    """Unit rule of company facts."""
    unit = F.lower("unit")
    return (
        F.when(c("metric_type").isin(M.EPS_METRICS), unit.contains("usd") & unit.contains("share"))
        .when(c("metric_type") == "common_shares_outstanding", unit.contains("share"))
        .otherwise(c("unit") == "USD")
    )


def filing_unit_ok() -> Column:
    """Unit rule of facts read from single filings; it differs from the company rule."""
    unit = F.lower("unit_ref")
    return (
        F.when(c("metric_type").isin(M.EPS_METRICS), unit.contains("shares") | unit.contains("pershare"))
        .when(c("metric_type") == "common_shares_outstanding", unit.contains("shares"))
        .otherwise(unit.contains("usd") & ~unit.contains("shares"))
    )


def consolidated_only(facts: DataFrame, keys: list[str] = ("accession", "concept")) -> DataFrame:
    """Drop dimensioned rows of a (filing, concept) that also has consolidated ones.

    The flag is aggregated per key and joined back, so a filing with very many
    segment rows is never gathered in one task.
    """
    keys = list(keys)
    has_total = facts.where(~c("is_dimensioned")).select(*keys).distinct().withColumn("__total", F.lit(True))
    flagged = facts.join(has_total, keys, "left")
    return flagged.where(c("__total").isNull() | ~c("is_dimensioned")).drop("__total")


def _is_flow() -> Column:
    return c("metric_type").isin(M.FLOW_METRICS)


# ---------------------------------------------------------------- slots


def _usable() -> Column:
    return c("period_end").isNotNull() & c("numeric_value").isNotNull() & ~F.isnan("numeric_value")


def _claims(per_filing: bool, has_start: bool) -> Column:
    """The slots one fact competes for: a stored row, a point of its fiscal year, a debt part.

    An array of (metric_type, alias_rank, role, slot_label, slot_year) whose
    entries have a null role where the fact claims no such slot.
    """
    label, year, bucket = c("fiscal_period"), c("fiscal_year"), c("bucket")
    flow = _is_flow() if has_start else F.lit(False)
    quarter, annual = bucket == "quarter", bucket == "annual"

    def claim(role: Column, slot_label: Column, slot_year: Column, metric=None) -> Column:
        return F.struct(
            (c("metric_type") if metric is None else metric).alias("metric_type"),
            (c("alias_rank") if metric is None else F.lit(0)).alias("alias_rank"),
            role.alias("role"), slot_label.alias("slot_label"), slot_year.cast("int").alias("slot_year"),
        )

    labels = LABELS if has_start or per_filing else LABELS[:4]
    as_labelled = ~flow & (label.isin(LABELS) & ~_is_flow() | label.isin(labels))
    if per_filing:
        stored = F.when(as_labelled | (flow & (quarter | annual) & label.isin(LABELS)), "direct")
        year_end = F.when(annual, "annual_point")
    else:
        stored = F.when(as_labelled | (flow & quarter & label.isin(LABELS[1:])), "direct").when(
            flow & annual & (label == "FY"), "annual")
        year_end = F.lit(None).cast("string")
    point = F.when(flow & year.isNotNull(), F.when(quarter & (label == "Q1"), "q1").when(
        bucket.isin("ytd_6m", "ytd_9m"), bucket).otherwise(year_end))
    none_text, none_year = F.lit(None).cast("string"), F.lit(None).cast("int")
    if per_filing:
        usable = _usable()
        stored, point = F.when(usable, stored), F.when(usable, point)
    claims = [
        claim(stored, F.when(stored == "direct", label), none_year),
        claim(point, none_text, year),
    ]
    if per_filing:
        claims.append(claim(F.when(~c("is_dimensioned"), "consolidated"), none_text, none_year))
    else:
        parts = {**{t: "total" for t in M.DEBT_TOTAL_TAGS}, **{t: "noncurrent" for t in M.DEBT_NONCURRENT_TAGS},
                 **{t: "current" for t in M.DEBT_CURRENT_TAGS}}
        part = F.coalesce(*[F.when(c("concept") == M.TAG_PREFIX + t, F.lit(g)) for t, g in parts.items()])
        is_part = part.isNotNull() & label.isin(LABELS)
        claims.append(claim(F.when(is_part, "direct"), label, none_year,
                            F.concat(F.lit(DEBT), part, F.lit("_"), label)))
    return F.array(*claims)


def _best_per_slot(facts: DataFrame, per_filing: bool) -> DataFrame:
    """First shuffle: the largest value of every slot and period end (a plain hash aggregate)."""
    has_start = "period_start" in facts.columns or "bucket" in facts.columns
    for name, kind in (("accession", "string"), ("form", "string"), ("strategy", "int"), ("fiscal_year", "int")):
        if name not in facts.columns:
            facts = facts.withColumn(name, F.lit(None).cast(kind))
    if "bucket" not in facts.columns:
        start = c("period_start") if has_start else F.lit(None).cast("date")
        facts = facts.withColumn("bucket", duration_bucket(start, c("period_end")))
    if "is_dimensioned" not in facts.columns:
        facts = facts.withColumn("is_dimensioned", F.lit(False))
    if not per_filing:
        facts = facts.where(_usable())
    claimed = facts.select(
        "ticker", "cik", "accession", "form", "strategy", "numeric_value", "period_end", "fiscal_year", "is_dimensioned",
        F.inline(_claims(per_filing, has_start)),
    ).where(c("role").isNotNull())
    keys = [*KEYS, "role", "slot_label", "slot_year", "period_end"]
    if not per_filing:
        return claimed.groupBy(*keys).agg(
            F.max("numeric_value").alias("value"), F.min("fiscal_year").alias("first_year"))
    best = claimed.groupBy(*keys).agg(
        F.max("numeric_value").alias("any_value"),
        F.max(F.when(~c("is_dimensioned"), c("numeric_value"))).alias("total_value"),
        F.min("fiscal_year").alias("first_year"),
    )
    return _consolidated(best)


def _consolidated(slots: DataFrame) -> DataFrame:
    """Dimensioned values only count where the filing's concept has no consolidated row at all.

    The window runs over slots, and its keys are those of the next step, so it
    adds no shuffle of its own.
    """
    has_total = F.max((c("role") == "consolidated").cast("int")).over(W.partitionBy(*KEYS)) == 1
    value = F.when(c("has_total"), c("total_value")).otherwise(c("any_value"))
    return (
        slots.withColumn("has_total", has_total).where(c("role") != "consolidated")
        .withColumn("value", value).where(c("value").isNotNull()).drop("any_value", "total_value", "has_total")
    )


def _with_derived_quarters(slots: DataFrame) -> DataFrame:
    """Second shuffle: per fiscal year, quarters from differences of cumulative values.

    A fiscal year takes its newest period end per length, so the comparatives
    of earlier years in the same filing lose. A derived quarter that a direct
    one already covers is dropped by the preference order of the next step
    (kind 1 before kind 2).
    """
    top = F.struct("period_end", "value")
    year = F.coalesce(c("slot_year"), F.when(c("role") == "annual", c("first_year")))
    fy = (c("role") == "annual") | (c("slot_label") == "FY")
    stored = F.when(c("role").isin("direct", "annual"), F.struct(
        F.when(fy, M.ANNUAL).otherwise(M.QUARTERLY).alias("period_type"),
        "period_end", "value", F.coalesce("slot_label", F.lit("FY")).alias("label"),
        F.when(fy, 0).otherwise(1).alias("kind"),
    ))
    grouped = slots.groupBy(*KEYS, year.alias("fiscal_year")).agg(
        F.collect_list(stored).alias("stored"),
        *[F.max(F.when(c("role") == r, top)).alias(r) for r in ("q1", "ytd_6m", "ytd_9m")],
        F.max(F.when(c("role").isin("annual", "annual_point"), top)).alias("annual"),
    )

    def step(label: str, later: str, earlier: str) -> Column:
        gap = c(f"{later}.value") - c(f"{earlier}.value")
        return F.when(c("fiscal_year").isNotNull() & gap.isNotNull(), F.struct(
            F.lit(M.QUARTERLY).alias("period_type"), c(f"{later}.period_end").alias("period_end"),
            gap.alias("value"), F.lit(label).alias("label"), F.lit(2).alias("kind"),
        ))

    steps = F.array(step("Q2", "ytd_6m", "q1"), step("Q3", "ytd_9m", "ytd_6m"), step("Q4", "annual", "ytd_9m"))
    rows = grouped.select(*KEYS, "fiscal_year", F.inline(F.concat("stored", steps)))
    return rows.where(c("period_end").isNotNull())


def candidate_rows(facts: DataFrame, per_filing: bool = False) -> DataFrame:
    """Unsigned metric values with the columns that decide between competing ones."""
    return _with_derived_quarters(_best_per_slot(facts, per_filing))


# ---------------------------------------------------------------- preference


def _preference() -> Column:
    """Competing rows in order: strategy, alias, annual/direct/derived, fiscal year, label.

    Packed into one number whose last bit tells a 10-K source, so that the
    choice stays a hash aggregate over plain numbers.
    """
    ten_k = (c("period_type") == M.ANNUAL) | ((c("label") == "Q4") & (c("kind") > 0) & c("flow_dated"))
    year = F.when(c("kind") == 2, F.coalesce(c("fiscal_year"), F.lit(0))).otherwise(F.lit(0))
    order = F.coalesce(c("strategy"), F.lit(2)).cast("long")
    for part, width in ((c("alias_rank"), 100), (c("kind"), 10), (year, 100000),
                        (F.array_position(F.lit(LABELS), c("label")), 10)):
        order = order * width + part
    return order * 2 + ten_k.cast("long")


def keep_preferred(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Third shuffle: one unsigned row per stored key; a ticker has one cik."""
    ranked = rows.withColumn("pref", _preference())
    return ranked.groupBy(*keys, "cik").agg(
        F.min_by("value", "pref").alias("value"), F.min("pref").alias("pref"),
    ).withColumn("ten_k", c("pref") % 2 == 1).drop("pref")


def merge_priority(*candidates: DataFrame, keys: list[str] = M.PK) -> DataFrame:
    """General form: rows of earlier inputs win, later ones only fill missing keys."""
    tagged = [df.withColumn("__p", F.lit(i)) for i, df in enumerate(candidates)]
    rows = tagged[0]
    for more in tagged[1:]:
        rows = rows.unionByName(more)
    return keep_first(rows, ["__p"], keys)


def keep_first(rows: DataFrame, order: list[str], keys: list[str] = M.PK) -> DataFrame:
    """One row per key, the first in an explicit order; combines before the shuffle."""
    rest = [x for x in rows.columns if x not in keys and x not in order]
    first = F.min(F.struct(*order, *rest)).alias("__first")
    return rows.groupBy(*keys).agg(first).select(*keys, *[c(f"__first.{x}").alias(x) for x in rest])


# ---------------------------------------------------------------- periods


def _value_of(name: str) -> Column:
    return F.max(F.when(c("metric_type") == name, c("value"))).alias(f"v_{name}")


def _single(col: str) -> Column:
    present = F.when(c(col) != "", c(col))
    return F.when(F.min(present) == F.max(present), F.min(present))


BACKFILL_INPUTS = ["gross_profit", "revenue", "cost_of_revenue", "operating_expenses", "operating_income"]


def complete_periods(rows: DataFrame, extra_keys: list[str] = (), debt_rule: bool = False) -> DataFrame:
    """Fourth shuffle: finish all rows of one company and period together.

    Applies canonical long-term debt (company path) and adds gross profit and
    operating expenses that follow from reported lines. A group holds at most
    one row per metric.
    """
    keys = ["ticker", "period_type", "period_end", *extra_keys]
    item = F.struct("metric_type", "value", "source")
    aggs = [
        F.collect_list(F.when(~c("metric_type").startswith(DEBT), item)).alias("items"),
        F.min("cik").alias("cik"), _single("source").alias("one_source"), *[_value_of(n) for n in BACKFILL_INPUTS],
    ]
    if "accession" not in extra_keys:
        aggs.append(_single("accession").alias("one_accession"))
    if debt_rule:
        aggs += [_value_of(f"{DEBT}{part}_{label}") for part in ("noncurrent", "total", "current") for label in LABELS]
    grouped = rows.groupBy(*keys).agg(*aggs)
    accession = c("accession") if "accession" in extra_keys else c("one_accession")

    items = c("items")
    if debt_rule:
        def canonical(label: str) -> Column:
            non, total, cur = (c(f"v_{DEBT}{p}_{label}") for p in ("noncurrent", "total", "current"))
            return F.coalesce(non, F.when(total >= cur, total - cur), total)

        debt = F.coalesce(*[canonical(label) for label in reversed(LABELS)])
        source = F.when(c("period_type") == M.ANNUAL, "10-K").otherwise("10-Q")
        replaced = F.array_append(
            F.filter(items, lambda i: i["metric_type"] != "long_term_debt"),
            F.struct(F.lit("long_term_debt").alias("metric_type"), F.abs(debt).alias("value"), source.alias("source")),
        )
        items = F.when(debt.isNull(), items).otherwise(replaced)

    gp = F.coalesce(c("v_gross_profit"), plausible_gross_profit(c("v_revenue"), c("v_cost_of_revenue")))
    opex = c("v_operating_income") - gp
    fallback = F.when(c("period_type") == M.ANNUAL, "10-K-derived").otherwise("10-Q-derived")
    derived_source = F.when(
        c("one_source").isNotNull() & ~c("one_source").endswith("-derived"),
        F.concat(c("one_source"), F.lit("-derived")),
    ).otherwise(fallback)

    def extra(name: str, ok: Column, value: Column) -> Column:
        return F.when(ok, F.struct(
            F.lit(name).alias("metric_type"), signed(F.lit(name), value).alias("value"), derived_source.alias("source")))

    extras = F.array(
        extra("gross_profit", c("v_gross_profit").isNull() & gp.isNotNull(), gp),
        extra("operating_expenses", c("v_operating_expenses").isNull() & (opex <= 0), opex),
    )
    return grouped.select(
        *keys, "cik", *([] if "accession" in extra_keys else [accession.alias("accession")]),
        F.explode(F.concat(items, extras)).alias("i"),
    ).where(c("i").isNotNull()).select(
        "ticker", "cik", c("i.metric_type").alias("metric_type"), flip_zero(c("i.value")).alias("value"),
        F.lit("USD").alias("currency"), period_label(c("period_end"), c("period_type")).alias("period"),
        "period_type", "period_end", c("i.source").alias("source"),
        # a derived row is tied to a filing only when the whole period comes from one
        "accession",
    )


# ---------------------------------------------------------------- paths


def _company_candidates(facts: DataFrame, strategy: int) -> DataFrame:
    mapped = map_concepts(facts)
    if "unit" in facts.columns:
        mapped = mapped.where(company_unit_ok())
    rows = candidate_rows(mapped.withColumn("strategy", F.lit(strategy)))
    return rows.withColumn("flow_dated", _is_flow() & F.lit("period_start" in facts.columns))


def _standardized_candidates(series: DataFrame) -> DataFrame:
    """Strategy 1: standardised series, concept = series name, through the same decomposition."""
    renamed = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in M.STANDARD_CONCEPTS.items() for x in kv]), c("concept")),
        c("concept"),
    )
    usable = [m for m in M.EXPECTED_METRICS if m not in M.RAW_ONLY_METRICS]
    named = series.withColumn("metric_type", renamed).where(c("metric_type").isin(usable)).withColumns(
        {"alias_rank": F.lit(0), "strategy": F.lit(1)})
    return candidate_rows(named).withColumn("flow_dated", _is_flow())


def _stored(rows: DataFrame, keys: list[str], source: Column, accession: Column) -> DataFrame:
    picked = keep_preferred(rows, keys)
    return picked.withColumns({
        "value": signed(c("metric_type"), c("value")), "source": source, "accession": accession,
    })


def merged_company_rows(facts: DataFrame, standardized: DataFrame | None = None) -> DataFrame:
    """Preferred row per stored key before period completion; strategy 1 wins over raw facts."""
    rows = _company_candidates(facts, 2)
    if standardized is not None:
        rows = _standardized_candidates(standardized).unionByName(rows)
    source = F.when(c("ten_k"), "10-K").otherwise("10-Q")
    return _stored(rows, M.PK, source, F.lit(None).cast("string"))


def extract_companies(facts: DataFrame, standardized: DataFrame | None = None) -> DataFrame:
    """The slow path: metric rows of every company from its full fact history."""
    return complete_periods(merged_company_rows(facts, standardized), debt_rule=True)


BUCKETS = [name for name, _, _ in M.DURATION_BUCKETS]


def _by_filing(mapped: DataFrame) -> DataFrame:
    """The mapped facts of a filing in one partition, as narrow rows.

    Concept, label, length of the period and dimension travel as one number beside the
    value; all else is equal in most neighbours and left out by the shuffle's compression.
    """
    has_accession = "accession" in mapped.columns
    for name in ("accession", "form"):
        if name not in mapped.columns:
            mapped = mapped.withColumn(name, F.lit(None).cast("string"))
    if "fiscal_year" not in mapped.columns:
        mapped = mapped.withColumn("fiscal_year", F.lit(None).cast("int"))
    has_start, has_dims = "period_start" in mapped.columns, "is_dimensioned" in mapped.columns
    bucket = duration_bucket(c("period_start"), c("period_end")) if has_start else F.lit(None).cast("string")
    dimension = F.coalesce(c("is_dimensioned").cast("int"), F.lit(2)) if has_dims else F.lit(0)
    at = F.create_map(*[F.lit(x) for i, (concept, _, _) in enumerate(CONCEPT_ROWS) for x in (concept, i)])
    code = at[c("concept")]
    for part, width in ((F.array_position(F.lit(LABELS), c("fiscal_period")), len(LABELS) + 1),
                        (F.array_position(F.lit(BUCKETS), bucket), len(BUCKETS) + 1), (dimension, 3)):
        code = code * width + F.coalesce(part, F.lit(0)).cast("int")
    rows = mapped.select("ticker", "cik", "accession", "form", "fiscal_year", "period_end", "numeric_value", code.alias("code"))
    rows = rows.repartition("accession" if has_accession else "ticker")

    n, names = c("code"), {}
    names["is_dimensioned"] = F.when(n % 3 < 2, n % 3 == 1)
    n = F.floor(n / 3).cast("int")
    if has_start:
        names["bucket"] = F.nullif(F.get(F.lit(["", *BUCKETS]), n % (len(BUCKETS) + 1)), F.lit(""))
    n = F.floor(n / (len(BUCKETS) + 1)).cast("int")
    names["fiscal_period"] = F.nullif(F.get(F.lit(["", *LABELS]), n % (len(LABELS) + 1)), F.lit(""))
    n = F.floor(n / (len(LABELS) + 1)).cast("int")
    names["metric_type"] = F.get(F.lit([m for _, m, _ in CONCEPT_ROWS]), n)
    names["alias_rank"] = F.get(F.lit([r for _, _, r in CONCEPT_ROWS]), n)
    return rows.withColumns(names).drop("code")


def extract_filings(facts: DataFrame, filings: DataFrame | None = None) -> DataFrame:
    """The fast path: metric rows per filing; facts carry ticker, cik, accession and form.

    One shuffle, by accession: the keys of all later steps hold it, so none of them
    moves a row again. A task has whole filings, the facts of a company (or a
    concept) are spread over those of its filings. ``filings`` names the accessions
    to extract, all others are left out after that shuffle.
    """
    mapped = _by_filing(map_concepts(facts).where(filing_unit_ok()))
    if filings is not None:
        mapped = mapped.join(filings.select("accession"), "accession", "left_semi")
    rows = candidate_rows(mapped, per_filing=True).withColumn("flow_dated", F.lit(False))
    source = F.when(c("form").isin("10-K", "10-K/A"), "10-K").otherwise("10-Q")
    stored = _stored(rows, [*M.PK, "accession", "form"], source, c("accession"))
    return complete_periods(stored, ["accession"])


def coverage(rows: DataFrame) -> DataFrame:
    """Periods per ticker, metric and period type."""
    return rows.groupBy("ticker", "metric_type", "period_type").agg(
        F.count("*").alias("periods"), F.min("period_end").alias("first_period"),
        F.max("period_end").alias("last_period"),
    )


def missing_metrics(rows: DataFrame, expected: list[str] = M.EXPECTED_METRICS) -> DataFrame:
    """Expected metrics a ticker has no row for."""
    known = F.when(c("metric_type").isin(expected), c("metric_type"))
    found = rows.groupBy("ticker").agg(F.collect_set(known).alias("found"))
    return found.select("ticker", F.explode(F.array_except(F.lit(expected), c("found"))).alias("metric_type"))
