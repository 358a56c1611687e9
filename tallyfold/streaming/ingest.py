"""Incremental filing ingest as a file stream; the same batch step serves backfills."""

from __future__ import annotations

import threading
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold import model as M
from tallyfold.operators.facts import extract_filings
from tallyfold.sources.readers import with_ticker
from tallyfold.sources.store import Ledger, MetricStore, by_period, newest_per_key, ticker_list

c = F.col


# The tickers in scope where none are named.
DEFAULT_SCOPE = ["AAPL", "NVDA", "UNH", "WMT", "XOM", "MSFT", "AMZN", "GOOGL", "META", "TSLA"]


def ticker_scope(value: str | None) -> list[str] | None:
    """A scope setting: unset or empty is the default list, ``ALL`` is None (no limit), else a comma-separated list."""
    text = (value or "").strip()
    if not text:
        return list(DEFAULT_SCOPE)
    return None if text.upper() == "ALL" else ticker_list(text.split(","))


def in_scope(filings: DataFrame, tickers: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Filings of the target forms with a known ticker, one per company, optionally of a ticker list only.

    A filing with an unknown CIK is left out and thus stays unmarked, so it is
    retried once the reference is refreshed.
    """
    rows = with_ticker(filings.where(c("form").isin(M.TARGET_FORMS)), tickers, one=True)
    return rows if scope is None else rows.where(c("ticker").isin(ticker_list(scope)))


def newest_filing_rows(rows: DataFrame, filings: DataFrame) -> DataFrame:
    """Rows of several filings for the same key: the newest filing (date, accession) wins."""
    dates = filings.groupBy("accession").agg(F.max("filing_date").alias("filing_date"))
    dated = by_period(rows.join(dates, "accession"), M.PK)
    return newest_per_key(dated, M.PK, ["filing_date", "accession"]).drop("filing_date")


@dataclass
class FilingIngest:
    """Filing facts into the metric store, exactly once per accession.

    A batch first writes its metric rows and then its ledger entries, both
    under the batch id. A repeated batch overwrites its own folders, so a
    failure at any point is repaired by running it again.
    """

    store: MetricStore
    ledger: Ledger
    tickers: DataFrame
    scope: list[str] | None = None

    def run_batch(self, facts: DataFrame, batch: str | None = None) -> int:
        scoped = in_scope(facts, self.tickers, self.scope)
        seen = self.ledger.log.read()
        if batch is not None:
            # a repeated batch must not be hidden by its own first attempt
            seen = seen.where(c("batch") != batch)
        # a row per filing meets the ledger, and is kept; the facts are read again and shuffled by filing only
        offered = scoped.groupBy("accession").agg(
            F.min("ticker").alias("ticker"), F.min("form").alias("form_type"), F.max("filing_date").alias("filing_date"))
        fresh = offered.join(seen.select(c("accession_number").alias("accession")), "accession", "left_anti").persist()
        try:
            if fresh.isEmpty():
                scoped = scoped.where(F.lit(False))
            count = self.store.upsert(newest_filing_rows(extract_filings(scoped, fresh), fresh), batch)
            done = fresh.withColumnsRenamed({"accession": "accession_number", "filing_date": "filed_date"})
            self.ledger.log.append(done.withColumn("processed_at", F.current_timestamp()), batch)
        finally:
            fresh.unpersist()
        return count

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = True):
        """Run the batch step on every micro-batch of a stream of filing facts.

        The batch id holds the query's id, which its checkpoint keeps: a retried
        batch overwrites its own folders, and a stream with another checkpoint,
        whose epochs start at 0 again, never touches them.
        """
        started, name = threading.Event(), []

        def step(df: DataFrame, epoch: int) -> None:
            started.wait()
            self.run_batch(df, f"q{name[0]}-{epoch:012d}")

        writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        query = (writer.trigger(availableNow=True) if available_now else writer).start()
        name.append(query.id)
        started.set()
        return query


def filing_fact_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(M.FILING_FACTS_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def mark_unique(ledger: Ledger, stream: DataFrame, checkpoint: str):
    """Put each filing of a stream (accession_number, ticker, form_type, filed_date) into the ledger once, however late it comes.

    The ledger itself is the state, so none is held in memory and no row is
    ever too late.
    """
    started, name = threading.Event(), []

    def step(df: DataFrame, epoch: int) -> None:
        started.wait()
        ledger.mark(df, f"q{name[0]}-{epoch:012d}")

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    name.append(query.id)
    started.set()
    return query


def unique_filings(filings: DataFrame, time_col: str = "filed_at", delay: str = "30 days") -> DataFrame:
    """Stream of filings with each accession once within the watermark delay.

    For feeds whose lateness is bounded; :func:`mark_unique` has no bound.
    """
    return filings.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["accession_number"])


def drain_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available and append it to a Parquet folder."""
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
