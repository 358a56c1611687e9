"""Small helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.session import cut_lineage, shared_folder

TEXT_BYTES = 16 << 20
"""Texts are handled in slices of about this many bytes inside a task; one longer text is a slice of its own."""


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` and the named further columns; all others go, so none can clash with an operator's own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's decimal text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def text_column(batch: pa.RecordBatch, text: str = "text") -> pa.Array:
    """The text column, or the field of that name of a batch's only struct."""
    return batch.column(text) if text in batch.schema.names else pc.struct_field(batch.column(0), text)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of each hold about ``limit`` bytes."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(text_column(batch, text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // limit
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(a, b - a)


def byte_views(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def map_texts(docs: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, limit: int = TEXT_BYTES) -> DataFrame:
    """Apply ``work`` to bounded slices of each partition."""

    def run(batches):
        for batch in slices(batches, limit=limit):
            yield work(batch)

    return docs.mapInArrow(run, schema)


def give_back() -> None:
    """Return memory that Arrow and the C library keep for later, so that an idle worker stays small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


_HELD: dict = {}


def held_by_worker(key, build: Callable):
    """``build()``, kept by this Python worker until it needs another one: at most one model is held at a time."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = build()
    return _HELD[key]


def release_held() -> None:
    """Let go of the model that this Python worker holds; for later steps that need none."""
    if _HELD:
        _HELD.clear()
        gc.collect()
    give_back()


def work_folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder that :func:`work_folder` named, once no DataFrame reads it any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files and checkpoints of DataFrames that nothing refers to any more.

    Its cleaner waits for the driver's garbage collection, which a small driver may not need for hours.
    A query that has just ended is still held by Spark's listeners for a moment, so one collection isn't enough.
    """
    gc.collect()
    for pause in (0.2, 0.8):
        time.sleep(pause)
        spark.sparkContext._jvm.System.gc()


def smallest_sample(docs: DataFrame, group: str, rows: int, seed: int = 7) -> DataFrame:
    """At most ``rows`` documents of each value of ``group``: those whose hashed id is smallest.

    The bound is a parameter of every operator that fits a model. Groups are
    counted first; as hashes are spread evenly, only ids below a share of twice
    ``rows`` (and at least 100 more) are then ranked, so no task ever sees a whole group. The last
    pass reads texts under the exact cut-off. The driver sees two numbers a group.
    """
    from pyspark.sql import Window

    keyed = docs.withColumn("__h", F.xxhash64(F.lit(seed), F.col("doc_id")))

    def below(limits: list[tuple]):
        rule = F.lit(None).cast("long")
        for value, limit in limits:
            rule = F.when(F.col(group) == F.lit(value), F.lit(limit)).otherwise(rule)
        return F.col("__h") <= rule

    counts = docs.groupBy(group).count().where(F.col(group).isNotNull()).collect()
    share = [(r[0], min((1 << 63) - 1, -(1 << 63) + ((2 * rows + 100) << 64) // r[1])) for r in counts]
    if not share:
        return docs.where("false")
    order = Window.partitionBy(group).orderBy("__h")
    cut = (keyed.select(group, "__h").where(below(share)).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= rows)
           .groupBy(group).agg(F.max("__h").alias("__cut")).collect())
    return keyed.where(below([(r[0], r[1]) for r in cut])).drop("__h")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected ``edges`` (``a``, ``b`` long): ``id`` and ``component``, its smallest id.

    Alternating star steps: every node links its larger neighbours, then its
    smaller ones, to the smallest it knows, until nothing changes. Rows are
    links between distinct nodes; a hub is a key of joins and of aggregates
    that combine before the shuffle, never a gathered list. Every round is
    written to the shared checkpoint folder.
    """

    def tidy(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()

    links = cut_lineage(tidy(edges.select("a", "b")))
    seen = state(links)
    while seen[0]:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = tidy(large)
        near = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(near, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(near.select("a", F.col("m").alias("b")))
        links = cut_lineage(tidy(small))
        del both, low, large, near, small
        free_shuffles(links.sparkSession)
        now = state(links)
        if now == seen:
            break
        seen = now
    mine = links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return mine.union(links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
