"""Structured filing rows: Form 4, 8-K, 13D/G, DEF 14A, 13F, and filing pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold import model as M
from tallyfold.functions import columns as K
from tallyfold.operators.ordered import newest_per, previous_row

c = F.col


def number(value: Column) -> Column:
    """Number of a text or number, null when it is none."""
    return K.clean(value.try_cast("double"))


# ---------------------------------------------------------------- Form 4


def form4_trades(
    filings: DataFrame, codes: list[str] | None = None, acquired_disposed: str | None = "D", min_value: float = 0.0,
    keep: list[str] = ("ticker",),
) -> DataFrame:
    """One row per non-derivative transaction.

    Input: accession_number, filing_date, insider_name, position,
    primary_activity and a ``transactions`` array per filing. A trade without
    a value passes the value filter.
    """
    rows = filings.select(
        *keep, "accession_number", "filing_date", "insider_name", "position", "primary_activity",
        F.inline("transactions"),
    )
    if acquired_disposed:
        rows = rows.where(F.upper("AcquiredDisposed") == acquired_disposed.upper())
    wanted = sorted({x.strip().upper() for x in codes or [] if x and x.strip()})
    if wanted:
        rows = rows.where(F.upper("Code").isin(wanted))
    code = F.coalesce(c("Code"), F.lit(""))
    side = F.coalesce(c("AcquiredDisposed"), F.lit(""))
    rows = rows.withColumns({"shares": number(c("Shares")), "price": number(c("Price"))}).withColumn(
        "value", c("shares") * c("price"))
    other = F.when(code == "", "Other").otherwise(F.concat(F.lit("Other ("), code, F.lit(")")))
    return rows.where(c("value").isNull() | (F.abs("value") >= min_value)).select(
        *keep, "accession_number", "filing_date", c("Date").alias("tx_date"), "insider_name", "position",
        code.alias("transaction_code"), F.coalesce(c("TransactionType"), F.lit("")).alias("transaction_type"),
        F.coalesce(K.lookup(code, M.FORM4_CODES), other).alias("code_description"),
        side.alias("acquired_disposed"), "shares", "price",
        F.when(side == "D", c("value")).alias("proceeds"), "value",
        number(c("Remaining")).alias("remaining_shares"), c("Security").alias("security"),
        F.coalesce(c("DirectIndirect") == "D", F.lit(False)).alias("is_direct"),
        c("NatureOfOwnership").alias("ownership_nature"), "primary_activity",
        K.trade_significance(c("value")).alias("classification"), (code == "F").alias("is_tax_withholding"),
    )


def trade_amount() -> Column:
    """Proceeds, else value, else zero."""
    return F.coalesce(F.when(c("proceeds") != 0, c("proceeds")), c("value"), F.lit(0.0))


def trade_day() -> Column:
    return F.coalesce("tx_date", "filing_date")


def top_trades(trades: DataFrame, limit: int | None = None, keys: list[str] = ("ticker",)) -> DataFrame:
    """The ``limit`` largest trades per company (or overall with no keys), all without one: amount, then day, then accession."""
    order = [trade_amount().desc(), trade_day().desc_nulls_last(), c("accession_number").desc()]
    if limit is None:
        return trades
    if not keys:
        return trades.orderBy(*order).limit(limit)
    return newest_per(trades, list(keys), order, limit)


# ---------------------------------------------------------------- 8-K


def material_events(filings: DataFrame, codes: list[str] | None = None, summary_chars: int = 2000, keep=("ticker",)) -> DataFrame:
    """One row per reported item; ``items`` is an array of (item, text)."""
    rows = filings.select(
        *keep, "accession_number", "form_type", "filing_date", "date_of_report", "content_type",
        F.coalesce("has_press_release", F.lit(False)).alias("has_press_release"),
        F.posexplode("items").alias("item_position", "__i"),
    ).select("*", "__i.*").drop("__i").withColumn("item_code", K.item_code(c("item")))
    if codes:
        wanted = [x for x in (_plain_code(v) for v in codes) if x]
        rows = rows.where(c("item_code").isin(wanted)) if wanted else rows
    return rows.select(
        *keep, "accession_number", "form_type", "filing_date", "date_of_report", "item", "item_code",
        F.coalesce(K.item_label(c("item_code")), c("item")).alias("item_label"), "content_type",
        K.excerpt(c("text"), summary_chars).alias("summary"),
        F.coalesce(F.length("text"), F.lit(0)).alias("text_length"), "has_press_release", "item_position",
    )


def _plain_code(value: str) -> str | None:
    digits = [p for p in value.replace(" ", "").lower().replace("item", "").split(".") if p]
    return ".".join(digits) if digits and all(p.isdigit() for p in digits) else None


def event_title() -> Column:
    """Short title of an 8-K row: from its summary, else its label."""
    lead = F.concat(F.lit("Item "), F.coalesce("item_code", F.lit("")))
    prefix = F.concat(lead, F.lit(" "))
    rest = F.trim(F.substr(c("summary"), F.length(prefix) + 1))
    from_summary = F.when(c("summary").startswith(prefix) & (rest != ""), F.trim(F.split_part(rest, F.lit("."), F.lit(1))))
    label = F.trim("item_label")
    return F.coalesce(from_summary, F.when((label != "") & (label != lead), label), lead)


def distinct_events(events: DataFrame, by_summary: bool = True) -> DataFrame:
    """Events without repeats: by (accession or date, item, summary), or by (date, item)."""
    if by_summary:
        where = F.coalesce(F.when(c("accession_number") != "", c("accession_number")), c("filing_date").cast("string"))
        keys = {"__a": where, "__s": F.coalesce("summary", F.lit(""))}
    else:
        keys = {"__a": c("filing_date").cast("string"), "__s": F.lit("")}
    cols = events.columns
    rest = [x for x in cols if x != "item_code"]
    first = F.min(F.struct(*rest)).alias("r")
    return events.withColumns(keys).groupBy("__a", "__s", "item_code").agg(first).select(
        *[c(x) if x == "item_code" else c(f"r.{x}").alias(x) for x in cols])


def eightk_sections(events: DataFrame) -> DataFrame:
    """Section list of 8-K filings from their item rows, for filings whose text has no item headings."""
    raw = F.trim(F.coalesce("item", F.lit("")))
    # Fixed value: the item heading that stands before a title.
    after = F.trim(F.regexp_extract(raw, r"(?i)^item\s+\d+(?:\.\d+)?[a-z]?\s*[.:-]?\s*(.*)", 1))
    title = F.coalesce(F.when(after != "", after), K.item_title(c("item_code")))
    plain = F.concat(F.lit("Item "), c("item_code"))
    heading = F.when(raw == "", plain).otherwise(raw)
    full = F.when(title.isNotNull() & (F.lower(heading) == F.lower(plain)), F.concat(plain, F.lit(". "), title)).otherwise(heading)
    rows = events.where(c("item_code").isNotNull() & (F.trim("item_code") != "")).select(
        "accession_number", "item_code", "item_position", full.alias("heading"), title.alias("title"), "text_length",
        F.when(F.trim("summary") != "", F.trim("summary")).alias("preview"))
    # the first reported row of a code counts
    first = F.min(F.struct("item_position", "heading", "title", "text_length", "preview")).alias("r")
    return rows.groupBy("accession_number", "item_code").agg(first).select("accession_number", "item_code", "r.*").drop("item_position")


# ---------------------------------------------------------------- 13D / 13G


def ownership_reports(filings: DataFrame, form: str | None = None, summary_chars: int = 2000) -> DataFrame:
    """Structured 13D/G reports with voting and dispositive totals per reporting person.

    ``form`` may be any spelling of 13D or 13G.
    """
    family = K.ownership_form(c("form_type"))
    rows = filings.where(family.isNotNull())
    if form is not None and ("13D" in form.upper() or "13G" in form.upper()):
        rows = rows.where(family == ("SC 13D" if "13D" in form.upper() else "SC 13G"))

    def person(p: Column) -> Column:
        def part(name):
            return F.coalesce(p[name].try_cast("double"), F.lit(0.0))
        sole, shared = part("sole_voting_power"), part("shared_voting_power")
        sole_d, shared_d = part("sole_dispositive_power"), part("shared_dispositive_power")
        return F.struct(
            F.when(p["cik"] != "", p["cik"]).alias("cik"), p["name"].alias("name"),
            p["citizenship"].alias("citizenship"), p["type_of_reporting_person"].alias("type_of_reporting_person"),
            p["aggregate_amount"].alias("aggregate_amount"), p["percent_of_class"].alias("percent_of_class"),
            sole.alias("sole_voting_power"), shared.alias("shared_voting_power"),
            (sole + shared).alias("total_voting_power"), sole_d.alias("sole_dispositive_power"),
            shared_d.alias("shared_dispositive_power"), (sole_d + shared_d).alias("total_dispositive_power"),
            F.coalesce(p["is_aggregate_exclude_shares"], F.lit(False)).alias("is_aggregate_exclude_shares"),
            F.coalesce(p["no_cik"], F.lit(False)).alias("no_cik"),
        )

    out = rows.withColumn("reporting_persons", F.transform(F.coalesce(c("reporting_persons"), F.array()), person))
    names = F.array_distinct(F.filter(F.transform("reporting_persons", lambda p: p["name"]), lambda n: n.isNotNull() & (n != "")))
    texts = {x: K.excerpt(c(x), summary_chars) for x in
             ("purpose_of_transaction", "source_of_funds", "ownership_transactions", "certification") if x in filings.columns}
    return out.withColumns({
        "reporting_person_count": F.size("reporting_persons"), "reporting_person_names": names,
        "total_shares": c("total_shares").try_cast("double"), "total_percent": c("total_percent").try_cast("double"),
        "is_amendment": F.coalesce("is_amendment", F.lit(False)), **texts,
    })


def primary_issuer_rows(rows: DataFrame, keys: list[str] = ("filer",)) -> DataFrame:
    """Rows of each filer's most frequent issuer (by normalised name; newest first on a tie).

    A filer whose rows carry no issuer name keeps all of them.
    """
    keys = list(keys)
    keyed = rows.withColumn("__issuer", K.alnum_key(c("issuer_name")))
    counts = keyed.where(c("__issuer").isNotNull()).groupBy(*keys, "__issuer").agg(
        F.count("*").alias("n"), F.max(F.struct("filing_date", "accession_number")).alias("seen"))
    main = counts.groupBy(*keys).agg(F.max_by("__issuer", F.struct("n", "seen")).alias("__main"))
    return keyed.join(main, keys, "left").where(
        c("__main").isNull() | (c("__issuer") == c("__main"))).drop("__issuer", "__main")


# ---------------------------------------------------------------- DEF 14A


def proxy_records(filings: DataFrame) -> DataFrame:
    """DEF 14A snapshots: numbers coerced, missing lists empty."""
    amounts = ["peo_total_comp", "peo_actually_paid_comp", "neo_avg_total_comp", "neo_avg_actually_paid_comp",
               "total_shareholder_return", "peer_group_tsr", "net_income", "company_selected_measure_value"]
    fixes = {a: number(c(a)) for a in amounts if a in filings.columns}
    fixes["performance_measures"] = F.coalesce(c("performance_measures"), F.array().cast("array<string>"))
    fixes["has_xbrl"] = F.coalesce(c("has_xbrl"), F.lit(False))
    return filings.withColumns(fixes)


# ---------------------------------------------------------------- 13F


def pick_13f(filings: DataFrame, report_period: str | None = None, keys: list[str] = ("manager_cik",)) -> DataFrame:
    """One filing per manager: newest (report period, filing date, accession), or the newest of a period."""
    if report_period is not None:
        filings = filings.where(c("report_period").cast("string") == report_period)
    key = F.struct("report_period", "filing_date", "accession_number")
    best = filings.groupBy(*keys).agg(F.max(key).alias("k")).select(*keys, c("k.accession_number").alias("accession_number"))
    return filings.join(best, [*keys, "accession_number"], "left_semi")


def holdings_rows(holdings: DataFrame, min_value: float = 0.0, limit: int | None = None) -> DataFrame:
    """Normalised holdings: numbers coerced, weight of the filing total; the largest ``limit`` per filing if asked for.

    A missing value counts as zero in the filter; ties go by CUSIP.
    """
    rows = holdings.withColumns({
        "value": number(c("Value")), "shares": number(c("SharesPrnAmount")),
        "sole_voting": number(c("SoleVoting")), "shared_voting": number(c("SharedVoting")),
        "non_voting": number(c("NonVoting")),
    }).where(F.coalesce("value", F.lit(0.0)) >= min_value)
    if limit is not None:
        rows = newest_per(rows, ["accession_number"], [c("value").desc_nulls_last(), c("Cusip")], limit)
    return rows.select(
        "accession_number", "form_type", "filing_date", "report_period", "manager_name", "manager_cik",
        "total_value", "total_holdings", c("Issuer").alias("issuer"), c("Class").alias("issuer_class"),
        c("Cusip").alias("cusip"), c("Ticker").alias("ticker"), "value", "shares",
        c("Type").alias("security_type"), c("PutCall").alias("put_call"),
        "sole_voting", "shared_voting", "non_voting",
        (K.div(c("value"), c("total_value")) * 100.0).alias("portfolio_weight_pct"),
    )


def holdings_change(current: DataFrame, previous: DataFrame, keys: list[str] = ("manager_cik", "cusip")) -> DataFrame:
    """Quarter-over-quarter position change: new, sold out, increased, decreased, unchanged."""
    a = current.groupBy(*keys).agg(F.sum("shares").alias("now"))
    b = previous.groupBy(*keys).agg(F.sum("shares").alias("before"))
    return a.join(b, list(keys), "full").select(
        *keys, c("before").alias("previous_shares"), c("now").alias("current_shares"),
        F.when(c("before").isNull(), "new").when(c("now").isNull(), "sold_out")
        .when(c("now") > c("before"), "increased").when(c("now") < c("before"), "decreased")
        .otherwise("unchanged").alias("change"),
        (K.div(c("now") - c("before"), c("before")) * 100.0).alias("change_pct"),
    )


# ---------------------------------------------------------------- filing pairs


def prior_comparable(filings: DataFrame, company: str = "cik") -> DataFrame:
    """Each filing with the latest earlier filing of the same company and base form."""
    rows = filings.withColumn("base_form", K.base_form(c("form_type"))).where(c("base_form").isNotNull())
    return previous_row(
        rows, [company, "base_form"], ["filing_date", "accession_number"], ["accession_number", "filing_date", "form_type"],
        F.year("filing_date"), "prior",
    )


def newest_filings(filings: DataFrame, n: int, keys: list[str] = ("cik",)) -> DataFrame:
    return newest_per(filings, list(keys), [c("filing_date").desc(), c("accession_number").desc()], n)
