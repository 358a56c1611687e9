"""Metric store, filing ledger and company state as append-only Parquet logs.

A batch writes its own folder and may be written again with the same id, so a
retried task, job or streaming epoch leaves one copy. Deletes are rows too.
Readers take the newest row per key; nothing is updated in place, and no table
format with MERGE is needed.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold import model as M
from tallyfold.functions.columns import flip_zero

c = F.col
REQUIRED = ["ticker", "metric_type", "value", "period", "period_type", "period_end"]
DEFAULTS = {"cik": None, "currency": "USD", "source": None, "accession": None}


# ---------------------------------------------------------------- plain transforms


def ready_to_store(df: DataFrame) -> DataFrame:
    """Check required columns, fill optional ones, make period_end a date."""
    missing = [x for x in REQUIRED if x not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    for name, value in DEFAULTS.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value).cast("string"))
    names = [f.name for f in M.METRICS_SCHEMA if f.name != "ingested_at"]
    return df.withColumn("period_end", c("period_end").cast("date")).select(*names)


def by_period(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt out so that the metrics of a company's period stay together.

    A step keyed by ``keys`` adds no shuffle, and neighbours that differ in value and
    metric only, the last columns while they move, take a fraction of the bytes of rows
    dealt out one by one.
    """
    last = [x for x in ("source", "value", "metric_type") if x in rows.columns]
    moved = rows.select(*[x for x in rows.columns if x not in last], *last)
    return moved.repartition(*[k for k in keys if k != "metric_type"]).select(*rows.columns)


def newest_per_key(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last writer wins: the row with the largest order columns per key, combined before the shuffle."""
    rest = [x for x in log.columns if x not in keys and x not in order]
    top = F.max(F.struct(*order, *rest)).alias("__top")
    out = log.groupBy(*keys).agg(top)
    return out.select(*[c(x) if x in keys else c(f"__top.{x}").alias(x) for x in log.columns])


def ticker_list(tickers) -> list[str]:
    items = [tickers] if isinstance(tickers, str) else list(tickers)
    return sorted({t.strip().upper() for t in items if t and t.strip()})


def without_tickers(metrics: DataFrame, tickers) -> DataFrame:
    return metrics.where(~c("ticker").isin(ticker_list(tickers)))


def new_accessions(filings: DataFrame, ledger: DataFrame, key: str = "accession_number") -> DataFrame:
    """Filings not in the ledger, one row per accession (first by filing date and form)."""
    fresh = filings.join(ledger.select(c("accession_number").alias(key)).distinct(), key, "left_anti")
    rest = [x for x in filings.columns if x != key]
    return fresh.groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*")


def sign_rule(metric, value):
    """Name of the sign rule a stored value breaks, null when it obeys."""
    return (
        F.when(metric.isin(M.NEGATIVE_MAGNITUDE) & (value > 0), "negative_magnitude")
        .when(metric.isin(M.POSITIVE_MAGNITUDE) & (value < 0), "positive_magnitude")
        .when(metric.isin(M.SIGN_FLIP) & (value != 0), "sign_flip")
    )


def sign_report(metrics: DataFrame) -> DataFrame:
    """Rows that the sign migration would change, per rule and metric."""
    broken = metrics.select("metric_type", sign_rule(c("metric_type"), c("value")).alias("rule"))
    return broken.where(c("rule").isNotNull()).groupBy("rule", "metric_type").agg(F.count("*").alias("rows_changed"))


def with_fixed_signs(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("value", flip_zero(
        F.when(sign_rule(c("metric_type"), c("value")).isNotNull(), -c("value")).otherwise(c("value"))))


# ---------------------------------------------------------------- stored logs


class Log:
    """Append-only Parquet log with one folder per batch."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, partition_by: list[str] = (), compression: str = "snappy"):
        self.spark, self.path, self.partition_by, self.compression = spark, path.rstrip("/"), list(partition_by), compression
        self.schema = T.StructType(list(schema.fields) + [T.StructField("batch", T.StringType())])

        # an empty first batch makes the folder exist; kept as it is when there is one
        leaf = "".join(f"/{p}=none" for p in self.partition_by)
        data = T.StructType([f for f in schema if f.name not in self.partition_by])
        spark.createDataFrame([], data).write.mode("ignore").parquet(f"{self.path}/batch=0{leaf}")

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(f"{self.path}/batch=*")

    def append(self, df: DataFrame, batch: str | None = None) -> int:
        """Write one batch and return its row count, counted while writing."""
        batch = batch or f"t{time.time_ns():020d}"
        seen = Observation()
        names = [f.name for f in self.schema if f.name != "batch"]
        out = df.select(*names).observe(seen, F.count(F.lit(1)).alias("rows"))
        out.write.mode("overwrite").option("compression", self.compression).partitionBy(*self.partition_by).parquet(f"{self.path}/batch={batch}")
        return seen.get.get("rows", 0)


class MetricStore:
    """``financial_metrics`` with upsert, delete, sign migration and compaction."""

    MIGRATION = "normalize_financial_metric_signs_v1"

    def __init__(self, spark: SparkSession, path: str):
        fields = [T.StructField(f.name, f.dataType) for f in M.METRICS_SCHEMA]
        self.spark, self.path = spark, path.rstrip("/")
        self.rows = Log(spark, f"{self.path}/rows", T.StructType(fields), ["period_type"])
        self.deletes = Log(spark, f"{self.path}/deletes", T.StructType([
            T.StructField("ticker", T.StringType()), T.StructField("deleted_at", T.TimestampType())]))
        self.runs = Log(spark, f"{self.path}/maintenance", M.MAINTENANCE_SCHEMA)

    def read(self, known_at: str | None = None) -> DataFrame:
        """Current rows: newest per key, not older than a delete of the ticker.

        With ``known_at`` (a timestamp) the rows as the store held them then: later
        batches and deletes don't count. :meth:`compact_to` keeps one version,
        so a compacted store only knows times after its compaction.
        """
        rows, deletes = self.rows.read(), self.deletes.read()
        if known_at is not None:
            until = F.lit(known_at).cast("timestamp")
            rows, deletes = rows.where(c("ingested_at") <= until), deletes.where(c("deleted_at") <= until)
        current = newest_per_key(by_period(rows, M.PK), M.PK, ["ingested_at", "batch"])
        gone = deletes.groupBy("ticker").agg(F.max("deleted_at").alias("deleted_at"))
        alive = current.join(gone, "ticker", "left").where(
            c("deleted_at").isNull() | (c("ingested_at") > c("deleted_at")))
        return alive.select(*[f.name for f in M.METRICS_SCHEMA])

    def upsert(self, df: DataFrame, batch: str | None = None) -> int:
        return self.rows.append(ready_to_store(df).withColumn("ingested_at", F.current_timestamp()), batch)

    def delete_tickers(self, tickers) -> int:
        names = ticker_list(tickers)
        if not names:
            return 0
        count = self.read().where(c("ticker").isin(names)).count()
        rows = self.spark.createDataFrame([(t,) for t in names], "ticker string")
        self.deletes.append(rows.withColumn("deleted_at", F.current_timestamp()))
        return count

    def is_empty(self) -> bool:
        return self.read().isEmpty()

    def compact_to(self, path: str) -> "MetricStore":
        """Write the current rows as the single batch of a new store, clustered by ticker."""
        target = MetricStore(self.spark, path)
        target.rows.append(self.read().repartitionByRange("period_type", "ticker").sortWithinPartitions(
            "period_type", "ticker", "metric_type", "period_end"), "t0")
        return target

    def normalize_signs(self, dry_run: bool = False, allow_rerun: bool = False) -> dict:
        """One-time migration into canonical signs; logs its result and refuses a second run."""
        applied = not self.runs.read().where(c("name") == self.MIGRATION).isEmpty()
        rules = {"negative_magnitude": 0, "positive_magnitude": 0, "sign_flip": 0}
        if applied and not allow_rerun:
            if not dry_run:
                raise ValueError("sign normalisation has already been applied to this store")
            found = []
        else:
            found = sign_report(self.read()).orderBy("rule", "metric_type").collect()  # one row per metric at most
        for r in found:
            rules[r["rule"]] += r["rows_changed"]
        result = {
            "dry_run": dry_run, "already_applied": applied, "maintenance_name": self.MIGRATION,
            "rows_changed": sum(rules.values()), "by_rule": rules,
            "by_metric_type": [r.asDict() for r in found],
        }
        if dry_run:
            return result
        broken = self.read().where(sign_rule(c("metric_type"), c("value")).isNotNull())
        self.upsert(with_fixed_signs(broken))
        entry = self.spark.createDataFrame([(self.MIGRATION, json.dumps(result, sort_keys=True))], "name string, details_json string")
        self.runs.append(entry.withColumn("ran_at", F.current_timestamp()))
        return result


class Ledger:
    """Processed filings: insert-or-ignore by accession."""

    def __init__(self, spark: SparkSession, path: str):
        self.log = Log(spark, path, M.LEDGER_SCHEMA)

    def read(self) -> DataFrame:
        rows = self.log.read()
        first = F.min(F.struct("processed_at", "batch", "ticker", "form_type", "filed_date")).alias("r")
        return rows.groupBy("accession_number").agg(first).select(
            "accession_number", "r.ticker", "r.form_type", "r.filed_date", "r.processed_at")

    def compact_to(self, path: str) -> "Ledger":
        """Write the current entries as the single batch of a new ledger, clustered by accession."""
        target = Ledger(self.log.spark, path)
        target.log.append(self.read().repartitionByRange("accession_number").sortWithinPartitions("accession_number"), "t0")
        return target

    def mark(self, filings: DataFrame, batch: str | None = None) -> int:
        """Add filings (accession_number, ticker, form_type, filed_date) that are not in the ledger."""
        fresh = new_accessions(filings.select("accession_number", "ticker", "form_type", "filed_date"), self.read())
        return self.log.append(fresh.withColumn("processed_at", F.current_timestamp()), batch)

    def contains(self, accession: str) -> bool:
        return not self.log.read().where(c("accession_number") == accession).isEmpty()

    def count(self) -> int:
        return self.log.read().select("accession_number").distinct().count()


class CompanyState:
    """When each company was last extracted; newest entry wins, deletes are entries too."""

    def __init__(self, spark: SparkSession, path: str):
        fields = [T.StructField(f.name, f.dataType) for f in M.COMPANY_STATE_SCHEMA]
        self.spark = spark
        self.log = Log(spark, path, T.StructType(fields + [T.StructField("deleted", T.BooleanType())]))

    def read(self) -> DataFrame:
        newest = newest_per_key(self.log.read(), ["ticker"], ["last_extracted", "batch"])
        return newest.where(~c("deleted")).select("ticker", "cik", "last_extracted", "extraction_type")

    def compact_to(self, path: str) -> "CompanyState":
        """Write the current entries as the single batch of a new state."""
        target = CompanyState(self.spark, path)
        target.log.append(self.read().withColumn("deleted", F.lit(False)), "t0")
        return target

    def update(self, companies: DataFrame, extraction_type: str = "slow_path", batch: str | None = None) -> int:
        rows = companies.select("ticker", c("cik").cast("string").alias("cik")).distinct()
        return self.log.append(rows.withColumns({
            "last_extracted": F.current_timestamp(), "extraction_type": F.lit(extraction_type),
            "deleted": F.lit(False)}), batch)

    def delete(self, tickers) -> int:
        known = self.read().where(c("ticker").isin(ticker_list(tickers)))
        return self.log.append(known.withColumns({"last_extracted": F.current_timestamp(), "deleted": F.lit(True)}))

    def last_extracted(self, ticker: str):
        row = self.read().where(c("ticker") == ticker).select("last_extracted").first()
        return row[0] if row else None

    def count(self) -> int:
        return self.read().count()
