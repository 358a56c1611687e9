"""Summaries of structured filing rows, for all companies at once.

Groups are reduced in two steps so that a hot insider, item or manager is
combined before it meets one task. Lists that grow with the data (accession
numbers) come as rows; arrays are only built from small vocabularies or from
at most n newest entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyfold.functions import columns as K
from tallyfold.operators.filings import event_title, trade_amount, trade_day
from tallyfold.operators.ordered import exact_sum, newest_per

c = F.col

TRADE_GROUPS = {
    "insider_name": ["insider_name", "position", "primary_activity"],
    "insider_name_and_code": ["insider_name", "position", "primary_activity", "transaction_code", "code_description"],
    "transaction_code": ["transaction_code", "code_description"],
}
EVENT_GROUPS = {"item_code": ["item_code", "item_label"], "content_type": ["content_type"]}


def _fields(table: dict, group_by: str) -> list[str]:
    if group_by not in table:
        raise ValueError(f"group_by must be one of {', '.join(table)}")
    return table[group_by]


def insider_sales(trades: DataFrame, group_by: str = "insider_name", limit: int | None = None, keys=("ticker",)) -> DataFrame:
    """Grouped insider sales: all groups, or the largest ``limit`` per company when asked for."""
    by = list(dict.fromkeys([*keys, *_fields(TRADE_GROUPS, group_by)]))
    amount, day = trade_amount(), trade_day()
    split = trades.withColumns({"__amount": amount, "__code": c("transaction_code")}).groupBy(*by, "__code").agg(
        F.count("*").alias("n"),
        F.min("tx_date").alias("first_tx"), F.max("tx_date").alias("last_tx"), F.max("filing_date").alias("last_filing"),
        F.max(F.struct(day.alias("d"), c("accession_number").alias("a"))).alias("latest"),
        exact_sum(F.coalesce("shares", F.lit(0.0))).alias("shares"), exact_sum(c("__amount")).alias("amount"),
        F.max("__amount").alias("top"), F.max(F.struct(c("__amount").alias("x"), day.alias("d"))).alias("seen"),
    )
    codes = F.array_sort(
        F.collect_list(F.when(c("__code") != "", F.struct(c("seen"), c("__code").alias("v")))),
        lambda a, b: F.when(a["seen"] > b["seen"], -1).when(a["seen"] < b["seen"], 1).otherwise(
            F.when(a["v"] < b["v"], -1).otherwise(1)))
    summary = split.groupBy(*by).agg(
        F.sum("n").alias("transaction_count"), F.transform(codes, lambda x: x["v"]).alias("transaction_codes"),
        F.min("first_tx").alias("first_tx_date"), F.max("last_tx").alias("last_tx_date"),
        F.max("last_filing").alias("latest_filing_date"), F.max("latest").alias("__latest"),
        exact_sum(c("shares")).alias("total_shares"), exact_sum(c("amount")).alias("total_proceeds"),
        F.max("top").alias("max_trade_value"),
    ).withColumns({
        "latest_accession_number": c("__latest.a"),
        "average_price": K.div(c("total_proceeds"), c("total_shares")),
        "classification": K.trade_significance(c("total_proceeds")),
    }).drop("__latest")
    if limit is None:
        return summary
    order = [c("total_proceeds").desc(), F.coalesce("last_tx_date", "latest_filing_date").desc_nulls_last(),
             *[c(x) for x in by if x not in keys]]
    return newest_per(summary, list(keys), order, limit)


def insider_sale_accessions(trades: DataFrame, group_by: str = "insider_name", keys=("ticker",)) -> DataFrame:
    """The filings behind each group, one row per distinct accession with its newest trade day."""
    by = list(dict.fromkeys([*keys, *_fields(TRADE_GROUPS, group_by)]))
    return trades.where(c("accession_number") != "").groupBy(*by, "accession_number").agg(
        F.max(trade_day()).alias("latest_day"), F.count("*").alias("trades"))


def _event_rank() -> Column:
    return F.struct("filing_date", "date_of_report", "accession_number")


def _grouped_events(events: DataFrame, by: list[str], values: dict[str, tuple[str, Column, int | None]], aggregates: list[Column]) -> DataFrame:
    """Groups of events with lists of their distinct values, from one scan.

    ``values`` maps a list's name to (column, order, n): the distinct non-empty
    values, best order first, all or the first n; all only for small
    vocabularies. Rows are first combined over everything a list may hold; what
    is left meets once by group.
    """
    fields = list(dict.fromkeys(v[0] for v in values.values()))
    ranks = {name: order for name, (_, order, _) in values.items()}
    fine = events.groupBy(*by, *fields).agg(*aggregates, *[F.max(order).alias(f"__r_{name}") for name, order in ranks.items()])
    fine = fine.repartition(*by)
    for name, (value, _, n) in values.items():
        present = c(value).isNotNull() & (c(value).cast("string") != "")
        best = F.max(f"__r_{name}").over(W.partitionBy(*by, value))
        fine = fine.withColumn(f"__b_{name}", F.when(present, best))
        if n is not None:
            place = F.dense_rank().over(W.partitionBy(*by).orderBy(c(f"__b_{name}").desc_nulls_last(), c(value)))
            fine = fine.withColumn(f"__p_{name}", F.when(present & (place <= n), True))
    lists = []
    for name, (value, _, n) in values.items():
        wanted = c(f"__b_{name}").isNotNull() if n is None else c(f"__p_{name}")
        pairs = F.collect_set(F.when(wanted, F.struct(c(f"__b_{name}").alias("r"), c(value).cast("string").alias("v"))))
        ordered = F.array_sort(pairs, lambda x, y: F.when(x["r"] > y["r"], -1).when(x["r"] < y["r"], 1).when(x["v"] < y["v"], -1).when(x["v"] > y["v"], 1).otherwise(0))
        lists.append(F.transform(ordered, lambda x: x["v"]).alias(name))
    return fine.groupBy(*by).agg(
        F.sum("event_count").alias("event_count"), F.min("earliest").alias("earliest"), F.max("latest").alias("latest"),
        F.max("latest_report").alias("latest_report"), F.bool_or("press").alias("press"),
        F.min("first_year").alias("first_year"), F.max("last_year").alias("last_year"), F.max("newest").alias("newest"), *lists)


def _event_aggregates() -> list[Column]:
    return [F.count("*").alias("event_count"), F.min("filing_date").alias("earliest"), F.max("filing_date").alias("latest"),
            F.max("date_of_report").alias("latest_report"), F.bool_or("has_press_release").alias("press"),
            F.min(F.year("filing_date")).alias("first_year"), F.max(F.year("filing_date")).alias("last_year"),
            F.max(F.struct(_event_rank().alias("r"), event_title().alias("title"))).alias("newest")]


def material_event_summary(events: DataFrame, group_by: str = "item_code", limit: int | None = None, keys=("ticker",)) -> DataFrame:
    """Grouped 8-K events: counts, latest dates, content types, up to three newest distinct samples.

    All groups, or the largest ``limit`` per company when asked for.
    """
    by = [*keys, *_fields(EVENT_GROUPS, group_by)]
    rows = events.withColumn("__type", c("content_type"))
    out = _grouped_events(rows, by, {"content_types": ("__type", _event_rank(), None), "sample_summaries": ("summary", _event_rank(), 3)}, _event_aggregates())
    out = out.select(*by, "event_count", c("latest").alias("latest_filing_date"), c("latest_report").alias("latest_date_of_report"),
                     c("press").alias("has_press_release"), "content_types", "sample_summaries")
    if limit is None:
        return out
    order = [c("event_count").desc(), c("latest_filing_date").desc_nulls_last(), *[c(x) for x in by if x not in keys]]
    return newest_per(out, list(keys), order, limit)


def event_accessions(events: DataFrame, group_by: str = "item_code", keys=("ticker",)) -> DataFrame:
    by = [*keys, *_fields(EVENT_GROUPS, group_by)]
    return events.where(c("accession_number") != "").groupBy(*by, "accession_number").agg(
        F.max("filing_date").alias("filing_date"), F.max("date_of_report").alias("date_of_report"))


def event_coverage(events: DataFrame, keys=("ticker",)) -> DataFrame:
    return events.groupBy(*keys).agg(
        F.count("*").alias("returned_events"), F.min("filing_date").alias("earliest_filing_date"),
        F.max("filing_date").alias("latest_filing_date"))


def event_digest(events: DataFrame, keys=("ticker",)) -> DataFrame:
    """Per item: rows, three newest distinct dates, content types, two newest distinct examples, years, title."""
    by = [*keys, "item_code"]
    rows = events.withColumns({"__day": c("filing_date").cast("string"), "__type": c("content_type")})
    values = {"recent_dates": ("__day", c("filing_date"), 3), "content_types": ("__type", F.lit(0), None), "examples": ("summary", _event_rank(), 2)}
    out = _grouped_events(rows, by, values, _event_aggregates())
    return out.select(*by, c("event_count").alias("row_count"), "earliest", "latest", "first_year", "last_year",
                      c("newest.title").alias("title"), "recent_dates", "content_types", "examples")


OWNERSHIP_HISTORY = ["accession_number", "form_type", "filing_date", "event_date", "total_shares", "total_percent",
                     "is_amendment", "amendment_number", "rule_designation", "is_passive_investor", "reporting_person_names"]
PROXY_HISTORY = ["filing_date", "fiscal_year_end", "accession_number", "peo_name", "peo_total_comp", "peo_actually_paid_comp",
                 "neo_avg_total_comp", "neo_avg_actually_paid_comp"]


def ownership_summary(reports: DataFrame, keys=("ticker",)) -> DataFrame:
    """Newest 13D/G report per company; counts and forms over all its reports.

    The history is :func:`ownership_history`, a row per report.
    """
    keys = list(keys)
    rank = F.struct("filing_date", "accession_number")
    head = ["issuer_name", "issuer_cik", "issuer_cusip", "security_title", "accession_number", "form_type",
            "filing_date", "event_date", "total_shares", "total_percent", "reporting_person_names", "reporting_persons",
            "purpose_of_transaction", "source_of_funds", "certification", "rule_designation", "is_passive_investor"]
    head = [x for x in head if x in reports.columns]
    # one row per company and form type leaves each task; form types are few
    by_form = reports.groupBy(*keys, "form_type").agg(
        F.count("*").alias("n"), F.max(rank).alias("seen"), F.max_by(F.struct(*[c(x).alias(f"h_{x}") for x in head]), rank).alias("l"))
    forms = F.array_sort(
        F.collect_list(F.when(c("form_type") != "", F.struct(c("seen"), c("form_type").alias("v")))),
        lambda a, b: F.when(a["seen"] > b["seen"], -1).when(a["seen"] < b["seen"], 1).when(a["v"] < b["v"], -1).otherwise(1))
    plain = {"issuer_name", "issuer_cik", "issuer_cusip", "security_title"}
    return by_form.groupBy(*keys).agg(
        F.max_by("l", "seen").alias("l"), F.sum("n").alias("filings_count"), F.transform(forms, lambda x: x["v"]).alias("form_types_present"),
    ).select(*keys, *[c(f"l.h_{x}").alias(x if x in plain else f"latest_{x}") for x in head], "filings_count", "form_types_present")


def ownership_history(reports: DataFrame, keys=("ticker",), newest: int | None = None) -> DataFrame:
    """A row per report; only the ``newest`` per company when asked for."""
    rows = reports.select(*keys, *[x for x in OWNERSHIP_HISTORY if x in reports.columns])
    return rows if newest is None else newest_per(rows, list(keys), [c("filing_date").desc(), c("accession_number").desc()], newest)


def proxy_summary(records: DataFrame, keys=("cik",)) -> DataFrame:
    """Newest DEF 14A per company and its change against the one before; counts and measures over all filings.

    Filings are ordered by fiscal year end, filing date and accession number.
    The history is :func:`proxy_history`, a row per filing.
    """
    keys = list(keys)
    order = ["fiscal_year_end", "filing_date", "accession_number"]
    body = [x for x in records.columns if x not in keys]
    pair = newest_per(records, keys, [c(x).desc_nulls_last() for x in order], 2)
    rank = [c(x).alias(f"__{i}") for i, x in enumerate(order)]
    g = pair.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*rank, F.struct(*body).alias("r"))), asc=False).alias("rows"))
    counts = records.groupBy(*keys).agg(F.count("*").alias("filings_count"))
    names = records.select(*keys, F.explode("performance_measures").alias("m")).distinct().groupBy(*keys).agg(
        F.array_sort(F.collect_list("m")).alias("available_performance_measures"))
    last, before = c("rows")[0]["r"], F.try_element_at(c("rows"), F.lit(2))["r"]
    now, prev = last["peo_total_comp"], before["peo_total_comp"]
    latest = {"accession_number", "form_type", "filing_date", "fiscal_year_end", "peo_name", "peo_total_comp",
              "peo_actually_paid_comp", "neo_avg_total_comp", "neo_avg_actually_paid_comp", "total_shareholder_return",
              "peer_group_tsr", "net_income", "company_selected_measure", "company_selected_measure_value"}
    return g.join(counts, keys).join(names, keys, "left").select(
        *keys, "filings_count",
        *[last[x].alias(f"latest_{x}" if x in latest else x) for x in body if x != "performance_measures"],
        F.coalesce("available_performance_measures", F.array().cast("array<string>")).alias("available_performance_measures"),
        (now - prev).alias("peo_total_comp_change"),
        (K.div(now - prev, prev) * 100.0).alias("peo_total_comp_change_pct"),
    )


def proxy_history(records: DataFrame, keys=("cik",)) -> DataFrame:
    """A row per filing with its pay figures."""
    return records.select(*keys, *[x for x in PROXY_HISTORY if x in records.columns])


def holdings_concentration(holdings: DataFrame, top_n: int = 10) -> DataFrame:
    """Per 13F filing: total, rows, share of the top 5 and top 10, and the top n holdings.

    Only the largest ``max(top_n, 10)`` rows of a filing are gathered.
    """
    key = "accession_number"
    head = ["manager_name", "manager_cik", "form_type", "filing_date", "report_period", "total_holdings"]
    head = [x for x in head if x in holdings.columns]
    size = max(top_n, 10)
    filled = F.coalesce("value", F.lit(0.0))
    # one pass: rows meet once by filing, ranked, and the largest go into the list
    ranked = holdings.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(filled.desc(), c("cusip"))))
    item = F.when(c("__n") <= size, F.struct((-filled).alias("neg"), "cusip", "issuer", filled.alias("value")))
    sums = ranked.groupBy(key).agg(
        *[F.min(x).alias(x) for x in head], F.max("total_value").alias("__filed"),
        F.sum(filled.cast("decimal(38,6)")).cast("double").alias("__summed"),
        F.count("*").alias("distinct_securities"), F.sort_array(F.collect_list(item)).alias("top"),
    )

    def share(n: int) -> Column:
        part = F.aggregate(F.slice("top", 1, n), F.lit(0.0), lambda a, x: a + x["value"])
        return F.round(K.div(part, c("total_value")) * 100.0, 6)

    total = F.when(c("__filed") != 0, c("__filed")).otherwise(c("__summed"))
    return sums.withColumn("total_value", total).select(
        key, *head, "total_value", "distinct_securities",
        share(5).alias("top_5_concentration_pct"), share(10).alias("top_10_concentration_pct"),
        F.transform(F.slice("top", 1, top_n), lambda x: F.struct(x["issuer"], x["cusip"], x["value"])).alias("top_holdings"),
    )


def provenance(rows: DataFrame, as_of: str | None = None) -> DataFrame:
    """One row about any result: size, freshness, newest accessions, sources, nulls, staleness in days."""
    cols = set(rows.columns)
    nulls = sum((F.count_if(c(x).isNull()) for x in rows.columns), F.lit(0).cast("long"))
    aggs = [F.count("*").alias("row_count"), nulls.alias("null_value_count")]
    for name in ("period_end", "filing_date"):
        day = F.max(K.iso_day(c(name))) if name in cols else F.lit(None).cast("date")
        aggs.append(day.alias(f"latest_{name}"))
    parts = [rows.agg(*aggs)]
    for name, options, n, ascending in (("accession_numbers", ("accession", "accession_number"), 10, False),
                                        ("sources", ("source",), 5, True)):
        present = [F.when(F.trim(x) != "", F.trim(x)) for x in options if x in cols]
        if not present:
            continue
        values = rows.select(F.coalesce(*present).alias("v")).where(c("v").isNotNull()).distinct()
        few = values.orderBy(c("v").asc() if ascending else c("v").desc()).limit(n)
        parts.append(few.agg(F.sort_array(F.collect_list("v"), asc=ascending).alias(name)))
    both = parts[0]
    for more in parts[1:]:
        both = both.unionByName(more, allowMissingColumns=True)  # one row per part
    one = both.agg(*[F.first(x, ignorenulls=True).alias(x) for x in both.columns])
    for name in ("accession_numbers", "sources"):
        empty = F.array().cast("array<string>")
        one = one.withColumn(name, F.coalesce(c(name), empty) if name in one.columns else empty)
    today = F.lit(as_of).cast("date") if as_of else F.current_date()
    return one.withColumn(
        "staleness_days", F.datediff(today, F.coalesce("latest_filing_date", "latest_period_end")))
