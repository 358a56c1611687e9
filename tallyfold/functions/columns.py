"""Column builders shared by the operators: numbers, dates, keys, text, formats."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyfold import model as M

# ---------------------------------------------------------------- numbers


def clean(value: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def div(a: Column, b: Column) -> Column:
    """a / b, null when either is missing or the divisor is zero."""
    return F.try_divide(a, b)


def flip_zero(value: Column) -> Column:
    """-0.0 becomes 0.0 so that equal numbers also print equal."""
    return value + F.lit(0.0)


def signed(metric: Column, value: Column) -> Column:
    """Canonical sign of a metric value."""
    return flip_zero(
        F.when(metric.isin(M.NEGATIVE_MAGNITUDE), -F.abs(value))
        .when(metric.isin(M.SIGN_FLIP), -value)
        .when(metric.isin(M.POSITIVE_MAGNITUDE), F.abs(value))
        .otherwise(value)
    )


def clamp_score(value: Column, low: float, high: float) -> Column:
    """0-100 position of a value inside [low, high]; 0 when missing."""
    inside = F.greatest(F.lit(low), F.least(F.lit(high), value))
    return F.when(value.isNull(), F.lit(0.0)).otherwise((inside - low) / (high - low) * 100)


# ---------------------------------------------------------------- dates


def iso_day(text: Column) -> Column:
    """Lenient date: the day part of an ISO date or timestamp, null if invalid."""
    day = F.split(F.split(F.trim(text.cast("string")), "T")[0], " ")[0]
    return F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(day, "yyyy-MM-dd"))


def compact_day(text: Column) -> Column:
    """yyyymmdd text to a date, null if invalid."""
    day = F.trim(text)
    return F.when(day.rlike(r"^\d{8}$"), F.try_to_date(day, "yyyyMMdd"))


def duration_bucket(start: Column, end: Column) -> Column:
    """quarter, ytd_6m, ytd_9m, annual or null by the length in days."""
    days = F.datediff(end, start)
    cases = [F.when(days.between(lo, hi), F.lit(name)) for name, lo, hi in M.DURATION_BUCKETS]
    return F.coalesce(*cases)


def period_label(period_end: Column, period_type: Column) -> Column:
    lead = F.when(period_type == M.ANNUAL, "Twelve Months Ended ").otherwise("Quarter Ended ")
    return F.concat(lead, F.date_format(period_end, "MM/dd/yyyy"))


def label_day(label: Column) -> Column:
    """The date a period label ends on."""
    parts = F.regexp_extract(label, r"(\d{2}/\d{2}/\d{4})", 1)
    return F.when(parts != "", F.try_to_date(parts, "MM/dd/yyyy"))


def open_bound(value: str | None) -> str | None:
    """Date arguments: blanks and the words none/null mean an open end."""
    if value is None:
        return None
    text = str(value).strip()
    return None if text.lower() in ("", "none", "null") else text


def date_range(col: Column, start: str | None = None, end: str | None = None) -> Column:
    """Inclusive range predicate with optional ends."""
    start, end = open_bound(start), open_bound(end)
    pred = F.lit(True)
    if start:
        pred = pred & (col >= F.lit(start).cast("date"))
    if end:
        pred = pred & (col <= F.lit(end).cast("date"))
    return pred


# ---------------------------------------------------------------- keys and lookups


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Value of a small fixed dictionary."""
    literal_map = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.try_element_at(literal_map, key)


def ticker_key(text: Column) -> Column:
    """Canonical ticker: upper case, no spaces, dots and slashes as dashes."""
    bare = F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), r"\s+", "")
    return F.regexp_replace(F.regexp_replace(bare, "[./]+", "-"), "^-+|-+$", "")


# White space in the Unicode sense, spelled out: much faster than the regex flag for it.
WHITE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


# White space other than the space itself, one by one.
ODD_WHITE = [chr(x) for x in (*range(9, 14), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def squeeze(text: Column) -> Column:
    """Runs of white space become one space, ends trimmed.

    The regular expression is slow, so only texts go through it that hold two spaces in a row or other white space.
    """
    def squeezed(t: Column) -> Column:
        odd = t.contains("  ")
        for x in ODD_WHITE:
            odd = odd | t.contains(x)
        return F.trim(F.when(odd, F.regexp_replace(t, f"[{WHITE}]+", " ")).otherwise(t))

    return F.element_at(F.transform(F.array(text), squeezed), 1)


def alnum_key(text: Column) -> Column:
    """Lower-case letters and digits only; null when nothing is left."""
    key = F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "")
    return F.when(key != "", key)


def ownership_form(form: Column) -> Column:
    up = F.upper(form)
    return F.when(up.contains("13D"), "SC 13D").when(up.contains("13G"), "SC 13G")


def base_form(form: Column) -> Column:
    """Form type without its amendment suffix."""
    base = F.trim(F.regexp_replace(F.upper(squeeze(form)), "/A.*$", ""))
    return F.when(base != "", base)


def accession_key(accession: Column) -> Column:
    return F.regexp_replace(accession, "-", "")


def item_code(item: Column) -> Column:
    """'Item 5 . 02' to '5.02'; null without a number."""
    code = F.regexp_extract(F.regexp_replace(item, r"\s*\.\s*", "."), r"(\d+(?:\.\d+)?)", 1)
    return F.when(code != "", code)


def item_label(code: Column) -> Column:
    return F.when(code.isNotNull() & (code != ""), F.concat(F.lit("Item "), code))


def item_title(code: Column) -> Column:
    return lookup(code, M.EIGHTK_ITEM_TITLES)


def trade_significance(value: Column) -> Column:
    size = F.abs(F.coalesce(value, F.lit(0.0)))
    return (
        F.when(size < M.NOTABLE_TRADE, "Normal")
        .when(size < M.VERY_NOTABLE_TRADE, "Notable")
        .otherwise("Very notable")
    )


def manager_key(name: Column) -> Column:
    bare = F.trim(name)
    return F.coalesce(lookup(F.lower(bare), M.MANAGER_ALIASES), bare)


def display_format(metric: Column) -> Column:
    return F.coalesce(lookup(metric, M.METRIC_DISPLAY_FORMATS), F.lit(M.DEFAULT_DISPLAY_FORMAT))


def postal_line(*parts: Column) -> Column:
    """Address parts joined by commas, blanks left out."""
    kept = [F.when(F.trim(p) != "", F.trim(p)) for p in parts]
    joined = F.concat_ws(", ", *kept)
    return F.when(joined != "", joined)


# ---------------------------------------------------------------- text


def excerpt(text: Column, max_chars: int) -> Column:
    """White space collapsed, cut with an ellipsis when longer than max_chars."""
    flat = squeeze(text)
    cut = F.concat(F.rtrim(F.substring(flat, 1, max(max_chars - 3, 1))), F.lit("..."))
    return F.when(flat == "", None).when(F.length(flat) <= max_chars, flat).otherwise(cut)


def first_iso_date(text: Column) -> Column:
    found = F.regexp_extract(text, r"\b(20\d{2}-\d{2}-\d{2})\b", 1)
    return F.when(found != "", found)


# Capitalised words that are not tickers.
NOT_TICKERS = ["AND", "CEO", "CFO", "DEF", "FCF", "FORM", "GAAP", "ITEM", "NEO", "SEC", "TSR", "TTM"]


def ticker_tokens(text: Column) -> Column:
    """Upper-case words of up to five letters in first-seen order."""
    tokens = F.regexp_extract_all(text, F.lit(r"\b([A-Z]{1,5})\b"), F.lit(1))
    return F.filter(F.array_distinct(tokens), lambda t: ~t.isin(NOT_TICKERS))


# ---------------------------------------------------------------- display formats


def _fixed(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", value)


def money(value: Column) -> Column:
    """Dollar text in billions, millions or whole dollars."""
    size = F.abs(value)
    sign = F.when(value < 0, "-").otherwise("")
    return (
        F.when(value.isNull(), "N/A")
        .when(size >= 1e9, F.concat(sign, F.lit("$"), _fixed(size / 1e9, 2), F.lit("B")))
        .when(size >= 1e6, F.concat(sign, F.lit("$"), _fixed(size / 1e6, 2), F.lit("M")))
        .otherwise(F.concat(sign, F.lit("$"), F.format_number(F.rint(size), 0)))
    )


def percent(value: Column) -> Column:
    return F.when(value.isNull(), "N/A").otherwise(F.concat(_fixed(value, 2), F.lit("%")))


def compact_percent(value: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(_fixed(value, 2), "0+$", ""), r"\.$", "")
    return F.when(value.isNull(), "N/A").otherwise(F.concat(bare, F.lit("%")))


def currency_short(value: Column) -> Column:
    """Dollar text with T, B, M or K."""
    size = F.abs(value)
    sign = F.when(value < 0, "-").otherwise("")

    def scaled(unit: float, digits: int, suffix: str) -> Column:
        return F.concat(sign, F.lit("$"), _fixed(size / unit, digits), F.lit(suffix))

    return (
        F.when(value.isNull(), "N/A")
        .when(size >= 1e12, scaled(1e12, 2, "T"))
        .when(size >= 1e9, scaled(1e9, 2, "B"))
        .when(size >= 1e6, scaled(1e6, 1, "M"))
        .when(size >= 1e3, scaled(1e3, 1, "K"))
        .otherwise(F.concat(sign, F.lit("$"), _fixed(size, 2)))
    )


def count_short(value: Column) -> Column:
    size = F.abs(value)
    return (
        F.when(value.isNull(), "N/A")
        .when(size >= 1e9, F.concat(_fixed(value / 1e9, 2), F.lit("B")))
        .when(size >= 1e6, F.concat(_fixed(value / 1e6, 1), F.lit("M")))
        .when(size >= 1e3, F.concat(_fixed(value / 1e3, 1), F.lit("K")))
        .otherwise(_fixed(value, 0))
    )


def ratio_text(value: Column, fmt: Column) -> Column:
    return (
        F.when(value.isNull(), "N/A")
        .when(fmt == "pct", F.concat(_fixed(value * 100, 2), F.lit("%")))
        .when(fmt == "days", F.concat(_fixed(value, 1), F.lit(" days")))
        .when(fmt == "dollar", currency_short(value))
        .otherwise(F.concat(_fixed(value, 2), F.lit("x")))
    )


def metric_text(value: Column, fmt: Column) -> Column:
    sign = F.when(value < 0, "-").otherwise("")
    return (
        F.when(value.isNull(), "—")
        .when(fmt == "per_share", F.concat(sign, F.lit("$"), _fixed(F.abs(value), 2)))
        .when(fmt == "count", count_short(value))
        .when(fmt == "number", F.call_function("format_number", value, F.lit("#,##0.##")))
        .otherwise(F.concat(sign, F.format_number(F.abs(value) / 1e6, 0)))
    )
