"""The metric table laid out by ticker, so that work per ticker needs no shuffle.

Rows are bucketed by the hash of their ticker and sorted inside a bucket. A scan of
the table is already partitioned as grouping, ranking and TTM by ticker want it, and a
list of tickers reads their buckets only. The table is external: its files lie in
the given folder with a note of the layout, and any session opens them again.

A ticker's rows are bounded by its metrics and periods, so buckets are as even as
tickers are many. A table is written once from current rows (a compaction); rows
without a ticker go to the bucket of null, repeated rows stay, and an empty table has one empty bucket.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold import model as M
from tallyfold.sources.store import ticker_list

c = F.col
ROWS_PER_BUCKET = 4_000_000
"""Some 100 MB of a bucket's file."""
ORDER = ["metric_type", "period_type", "period_end"]


def _name(path: str) -> str:
    return "metrics_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def write_by_ticker(metrics: DataFrame, path: str, buckets: int | None = None) -> DataFrame:
    """Write rows in one shuffle, a file per bucket, and return the table; ``buckets`` follows the number of rows unless given."""
    spark, path = metrics.sparkSession, path.rstrip("/")
    names = [f.name for f in M.METRICS_SCHEMA if f.name in metrics.columns]
    rows = metrics.select(*names)
    if buckets is None:
        buckets = max(1, -(-rows.count() // ROWS_PER_BUCKET))
    # the shuffle's hash is that of the buckets, so a task writes one bucket
    out = rows.repartition(buckets, "ticker").write.format("parquet").bucketBy(buckets, "ticker").sortBy(*ORDER)
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
    out.mode("overwrite").option("path", f"{path}/rows").saveAsTable(_name(path))
    layout = spark.createDataFrame([(buckets, rows.schema.simpleString()[len("struct<"):-1])], "buckets int, columns string")
    layout.coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")
    return spark.table(_name(path))


def read_by_ticker(spark: SparkSession, path: str, tickers=None) -> DataFrame:
    """The table of a folder, known to this session or not; only the buckets of ``tickers`` if given."""
    path = path.rstrip("/")
    if not spark.catalog.tableExists(_name(path)):
        layout = spark.read.parquet(f"{path}/layout").first()
        columns = ", ".join(x.replace(":", " ", 1) for x in layout["columns"].split(","))
        spark.sql(f"CREATE TABLE IF NOT EXISTS {_name(path)} ({columns}) USING parquet CLUSTERED BY (ticker) "
                  f"SORTED BY ({', '.join(ORDER)}) INTO {layout['buckets']} BUCKETS LOCATION '{path}/rows'")
    rows = spark.table(_name(path))
    return rows if tickers is None else rows.where(c("ticker").isin(ticker_list(tickers)))
