"""Values in two times: the period they are of, and the days on which they were known.

A reported row says that the value of a key (ticker, metric, period) became known
on a day. Later filings repeat it or restate it, so each key has versions, and a
version is known from its day until the next different one. Questions about the
past take the versions of that day: what a screen would have shown then, not
what later amendments made of it.

A row with a null value withdraws the key from its day on; a row without a day was
never known and is left out; of rows of one key and day the last in ``order``
counts, and rows that repeat the version before them change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyfold import model as M
from tallyfold.functions.derived import with_derived
from tallyfold.operators.ttm import NAMES, ttm_raw, ttm_wide
from tallyfold.sources.store import by_period, newest_per_key

c = F.col
ORDER = ("accession",)


def versions(reported: DataFrame, keys: list[str] = M.PK, known: str = "filed", order: list[str] = ORDER) -> DataFrame:
    """Keys, ``value``, the columns of ``order``, ``known_from`` and ``known_until`` (exclusive, null while it holds).

    One shuffle by company and period: the last of a day, the changes and their ends
    are found in one order. A key has as many rows as filings report its period.
    """
    w = W.partitionBy(*keys).orderBy("known_from", *order)
    rows = reported.where(c(known).isNotNull()).select(*keys, *order, "value", c(known).cast("date").alias("known_from"))
    rows = by_period(rows, keys)
    rows = rows.withColumn("__next", F.lead("known_from").over(w))
    daily = rows.where(c("__next").isNull() | (c("__next") != c("known_from"))).drop("__next")
    daily = daily.withColumns({"__n": F.row_number().over(w), "__before": F.lag("value").over(w)})
    changes = daily.where((c("__n") == 1) | ~c("value").eqNullSafe(c("__before"))).drop("__n", "__before")
    return changes.withColumn("known_until", F.lead("known_from").over(w)).where(c("value").isNotNull())


def _holds(day) -> F.Column:
    return (c("known_from") <= day) & (c("known_until").isNull() | (c("known_until") > day))


def as_known(history: DataFrame, day: str) -> DataFrame:
    """The versions that held on a day, one row per key at most."""
    return history.where(_holds(F.lit(day).cast("date")))


def known_on(reported: DataFrame, day: str, keys: list[str] = M.PK, known: str = "filed", order: list[str] = ORDER) -> DataFrame:
    """Values as they were known on one day, straight from reported rows: an aggregate that combines before its shuffle.

    ``accession`` is that of the last filing that reported the value; :func:`versions` names the first.
    """
    rows = reported.where(c(known).cast("date") <= F.lit(day).cast("date")).select(*keys, *order, "value", c(known).cast("date").alias("known"))
    return newest_per_key(rows, list(keys), ["known", *order]).where(c("value").isNotNull()).drop("known")


def restatements(history: DataFrame, keys: list[str] = M.PK) -> DataFrame:
    """Versions that replaced another one: keys, ``known_from``, ``before``, ``value`` and ``change`` (null from zero).

    A value that was withdrawn and came back is not a restatement.
    """
    w = W.partitionBy(*keys).orderBy("known_from")
    rows = history.withColumns({"before": F.lag("value").over(w), "__until": F.lag("known_until").over(w)})
    change = F.when(c("before") != 0, c("value") / c("before") - 1)
    return rows.where(c("__until") == c("known_from")).select(*keys, "known_from", "before", "value", change.alias("change"))


def ttm_as_known(reported: DataFrame, day: str, as_of: str | None = None, tickers: list[str] | None = None,
                 names: list[str] = NAMES, known: str = "filed") -> DataFrame:
    """TTM metrics as they were known on a day, one row per ticker; periods up to ``as_of``, or up to that day."""
    if tickers is not None:
        reported = reported.where(c("ticker").isin(tickers))
    return ttm_wide(known_on(reported, day, known=known), as_of or day, names=names)


def ttm_known_at(history: DataFrame, points: DataFrame, names: list[str] = NAMES) -> DataFrame:
    """TTM metrics for many points (ticker, as_of, known_on) from :func:`versions`, in one job.

    A point takes its ticker's versions that held on ``known_on``, of periods up to
    ``as_of``. Versions meet the points of their ticker only, and the four newest
    periods per point are cut by the engine's group limit in the same partitions.
    Points before the ticker's first row have no result.
    """
    keys = ["ticker", "as_of", "known_on"]
    rows = history.join(points.select(*keys).distinct(), "ticker").where(_holds(c("known_on")) & (c("period_end") <= c("as_of")))
    return with_derived(ttm_raw(rows, keys, names))
