"""Readers with declared schemas and writers for results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold import model as M
from tallyfold.functions.columns import accession_key, compact_day, date_range, iso_day

c = F.col

COMPANYFACTS_SCHEMA = """
cik string, entityName string,
facts map<string, map<string, struct<
  label: string,
  units: map<string, array<struct<
    start: string, end: string, val: double, accn: string, fy: int, fp: string, form: string, filed: string>>>>>>,
_corrupt_record string
"""


def companyfacts(spark: SparkSession, path: str, tickers: DataFrame | None = None) -> DataFrame:
    """Bulk company-facts JSON, one file per company, as fact rows.

    A file that does not parse is left out instead of failing the job;
    :func:`rejected_files` names those. ``tickers`` is (cik, ticker).
    """
    raw = (
        spark.read.schema(COMPANYFACTS_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
        .where(c("_corrupt_record").isNull())
    )
    points = (
        raw.select("cik", F.explode("facts").alias("taxonomy", "tags"))
        .select("cik", "taxonomy", F.explode("tags").alias("tag", "body"))
        .select("cik", F.concat_ws(":", "taxonomy", "tag").alias("concept"), F.explode("body.units").alias("unit", "p"))
        .select("cik", "concept", "unit", F.inline("p"))
    )
    rows = points.select(
        F.lpad("cik", 10, "0").alias("cik"), "concept", c("val").alias("numeric_value"), "unit",
        c("fp").alias("fiscal_period"), c("fy").alias("fiscal_year"),
        iso_day(c("start")).alias("period_start"), iso_day(c("end")).alias("period_end"),
        c("accn").alias("filing_accession"), "form",
    )
    return rows if tickers is None else with_ticker(rows, tickers)


def rejected_files(spark: SparkSession, path: str) -> DataFrame:
    """``file`` and ``size`` of each company-facts file that :func:`companyfacts` leaves out."""
    raw = spark.read.schema(COMPANYFACTS_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return raw.where(c("_corrupt_record").isNotNull()).select(
        F.input_file_name().alias("file"), F.octet_length("_corrupt_record").alias("size"))


def with_ticker(rows: DataFrame, tickers: DataFrame, one: bool = False) -> DataFrame:
    """Inner join with the CIK-to-ticker reference on the number, whatever the padding.

    Every ticker of a company gets its rows. With ``one`` a company has one
    ticker, the last of the reference by ``position`` if it has that column,
    else by name.
    """
    if one:
        last = F.max_by("ticker", F.struct("position", "ticker")) if "position" in tickers.columns else F.max("ticker")
        ref = tickers.groupBy(c("cik").cast("long").alias("__cik")).agg(last.alias("ticker"))
    else:
        ref = tickers.select(c("cik").cast("long").alias("__cik"), "ticker").distinct()
    return rows.withColumn("__cik", c("cik").cast("long")).join(ref, "__cik").drop("__cik")


def filing_facts(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return spark.read.schema(M.FILING_FACTS_SCHEMA).options(**options).format(fmt).load(path)


def filing_index(
    filings: DataFrame, tickers=None, form: str | None = None, start=None, end=None,
    include_amendments: bool = True, limit: int | None = None,
) -> DataFrame:
    """Filings of the scope, newest first by (filing_date, accession_number)."""
    if tickers is not None:
        filings = filings.where(c("ticker").isin(tickers))
    if form is not None:
        wanted = c("form_type") == form
        if include_amendments:
            wanted = wanted | (c("form_type") == f"{form}/A")
        filings = filings.where(wanted)
    if not include_amendments:
        filings = filings.where(~c("form_type").endswith("/A"))
    out = filings.where(date_range(c("filing_date"), start, end)).orderBy(
        c("filing_date").desc(), c("accession_number").desc())
    return out if limit is None else out.limit(limit)


def dera_num(spark: SparkSession, path: str) -> DataFrame:
    """num.txt: typed, rows with a bad number or date left out."""
    raw = spark.read.csv(path, sep="\t", header=True, mode="PERMISSIVE",
                         schema="adsh string, tag string, version string, coreg string, ddate string, qtrs string, "
                                "uom string, value string, footnote string", enforceSchema=False)
    return dera_num_typed(raw)


def dera_num_typed(raw: DataFrame) -> DataFrame:
    return raw.select(
        "adsh", "tag", "coreg", F.expr("try_cast(qtrs as int)").alias("qtrs"),
        compact_day(c("ddate")).alias("period_end"), F.expr("try_cast(value as double)").alias("value"),
    ).where(c("qtrs").isNotNull() & c("period_end").isNotNull() & c("value").isNotNull())


def dera_sub(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    return raw.select("adsh", F.expr("try_cast(cik as long)").alias("cik"), "form", "fp")


def vendor_statements(spark: SparkSession, path: str) -> DataFrame:
    """Vendor statement JSON (arrays of objects) as (symbol, date, period, field, value) rows.

    Objects are read as maps, since two of the fields differ by case only.
    """
    docs = spark.read.text(path, wholetext=True)
    items = docs.select(F.explode(F.from_json("value", "array<map<string,string>>")).alias("m"))
    return items.select(
        c("m")["symbol"].alias("symbol"), iso_day(c("m")["date"]).alias("period_end"),
        c("m")["period"].alias("period"), F.explode("m").alias("field", "text"),
    ).select("symbol", "period_end", "period", "field", F.expr("try_cast(text as double)").alias("value")).where(
        c("period_end").isNotNull() & c("value").isNotNull())


# ---------------------------------------------------------------- outputs


def records(df: DataFrame) -> DataFrame:
    """One JSON text per row, nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("record"))


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
