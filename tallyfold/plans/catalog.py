"""All registered queries."""

from __future__ import annotations

from tallyfold.plans import (
    filing_queries, ingest_queries, more_queries, reconcile_queries, series_queries, text_queries)

MODULES = [ingest_queries, series_queries, filing_queries, text_queries, reconcile_queries, more_queries]


def queries():
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracles():
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
