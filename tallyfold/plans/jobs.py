"""Whole jobs over the stores: full refresh, targeted rerun, metric migration."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.operators.facts import extract_companies
from tallyfold.session import shared_folder
from tallyfold.sources.store import CompanyState, MetricStore, ticker_list

c = F.col


def refresh_companies(store: MetricStore, state: CompanyState, facts: DataFrame, standardized: DataFrame | None = None,
                      batch: str | None = None) -> int:
    """Extract all companies of ``facts`` into the store and note them as extracted."""
    count = store.upsert(extract_companies(facts, standardized), batch)
    state.update(facts.select("ticker", "cik").distinct(), batch=batch)
    return count


def rerun_companies(store: MetricStore, state: CompanyState, facts: DataFrame, tickers) -> DataFrame:
    """Delete and re-extract chosen companies; one row per ticker with the three counts.

    Rows the new extraction no longer yields are gone afterwards.
    """
    names = ticker_list(tickers)
    wanted = facts.sparkSession.createDataFrame([(t,) for t in names], "ticker string")

    def counts(df: DataFrame, name: str) -> DataFrame:
        # at most one row per requested ticker, fixed before the store changes
        found = df.where(c("ticker").isin(names)).groupBy("ticker").agg(F.count("*").alias(name)).collect()
        return df.sparkSession.createDataFrame([tuple(r) for r in found], f"ticker string, {name} long")

    deleted = counts(store.read(), "deleted_rows")
    deleted_state = counts(state.read(), "deleted_state_rows")
    store.delete_tickers(names)
    state.delete(names)
    refresh_companies(store, state, facts.where(c("ticker").isin(names)))
    written = counts(store.read(), "written_rows")
    out = wanted.join(deleted, "ticker", "left").join(deleted_state, "ticker", "left").join(written, "ticker", "left")
    return out.na.fill(0)


def work_folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/tallyfold-{uuid.uuid4().hex}"
