"""Order-sensitive helpers that stay spread out when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

c = F.col


def previous_row(df: DataFrame, keys: list[str], order: list[str], payload: list[str], bucket: Column, name: str) -> DataFrame:
    """Add the payload of the row before in (keys, order), as a struct column ``name``.

    ``bucket`` must not decrease along the order (a year of a date order, say).
    The window runs inside a bucket; the first row of a bucket takes the last
    row of the nearest earlier bucket from a small per-bucket aggregate. A
    company with a third of all rows is thus split by time.
    """
    w = W.partitionBy(*keys, "__b").orderBy(*order)
    rows = df.withColumn("__b", bucket).withColumn("__prev", F.lag(F.struct(*payload)).over(w))
    tails = df.withColumn("__b", bucket).groupBy(*keys, "__b").agg(F.max(F.struct(*order, F.struct(*payload).alias("p"))).alias("t"))
    before = tails.select(
        *[c(k).alias(f"__k_{k}") for k in keys], c("__b").alias("__kb"),
        F.lag("t.p").over(W.partitionBy(*keys).orderBy("__b")).alias("__tail"),
    ).where(c("__tail").isNotNull())
    same = [c(k).eqNullSafe(c(f"__k_{k}")) for k in keys] + [c("__b").eqNullSafe(c("__kb"))]
    joined = rows.join(before, same, "left")
    return joined.select(*df.columns, F.coalesce("__prev", "__tail").alias(name))


def newest_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows per key; a limit is applied before the shuffle by the engine."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(c("__rn") <= n).drop("__rn")


def ordered_distinct(df: DataFrame, keys: list[str], value: str, rank: Column, n: int | None, name: str) -> DataFrame:
    """Per key, the distinct non-empty values in descending order of their best rank.

    Values are made distinct before they are gathered. Without ``n`` use it
    only for small vocabularies such as codes; with ``n`` at most n values are
    kept per key before the list is built.
    """
    present = df.where(c(value).isNotNull() & (c(value).cast("string") != ""))
    best = present.groupBy(*keys, value).agg(F.max(rank).alias("__rank"))
    if n is not None:
        best = newest_per(best, keys, [c("__rank").desc(), c(value)], n)
    pairs = F.collect_list(F.struct(c("__rank"), c(value).alias("v")))
    descending = F.array_sort(
        pairs, lambda a, b: F.when(a["__rank"] > b["__rank"], -1).when(a["__rank"] < b["__rank"], 1)
        .when(a["v"] < b["v"], -1).when(a["v"] > b["v"], 1).otherwise(0))
    return best.groupBy(*keys).agg(F.transform(descending, lambda p: p["v"]).alias(name))


def exact_sum(value: Column) -> Column:
    """Sum of money that does not depend on the order of rows."""
    return F.sum(value.cast("decimal(38,6)")).cast("double")
