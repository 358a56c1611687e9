"""Block changes of a section that respect the order of its blocks.

Equal blocks of both texts pair up by their number among equal ones. Of the pairs
of two texts a longest run that rises in both is in order; the other pairs are
moved, and what has no partner is added or removed. Only hashes of blocks are
shuffled to find pairs; a run is found per pair of filings, from as many rows
as a section has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyfold.functions.columns import squeeze
from tallyfold.operators.sections import extract_section
from tallyfold.session import stored

c = F.col
PARAGRAPHS, LINES = r"\n\s*\n", r"\n"


def section_blocks(filings: DataFrame, section_name: str, separator: str = PARAGRAPHS, text: str = "markdown") -> DataFrame:
    """``accession_number``, ``position`` (from 1), ``block`` and its ``digest``."""
    found = extract_section(filings, section_name, ("accession_number",), text)
    parts = F.filter(F.transform(F.split("content", separator), squeeze), lambda b: b != "")
    rows = found.select("accession_number", F.posexplode(parts).alias("at", "block"))
    return rows.select("accession_number", (c("at") + 1).alias("position"), F.unhex(F.sha2("block", 256)).alias("digest"), "block")


def numbered(blocks: DataFrame) -> DataFrame:
    """``nth``, the number of a block among its section's equal ones. Only digests move, once, by filing."""
    same = W.partitionBy("accession_number", "digest").orderBy("position")
    rows = blocks.select("accession_number", "digest", "position").repartition("accession_number")
    return rows.withColumn("nth", F.row_number().over(same))


def rising_run(values: Column) -> Column:
    """A longest strictly rising run of distinct numbers, in their order.

    Keeps, for every length, the run of that length that ends lowest; a number
    extends the longest of those that end below it.
    """
    none = F.array().cast("array<array<int>>")

    def step(runs: Column, x: Column) -> Column:
        shorter = F.size(F.filter(runs, lambda r: F.element_at(r, -1) < x))
        longer = F.concat(F.coalesce(F.get(runs, shorter - 1), F.array().cast("array<int>")), F.array(x))
        return F.concat(F.slice(runs, 1, shorter), F.array(longer), F.slice(runs, shorter + 2, F.size(runs)))

    return F.aggregate(values, none, step, lambda runs: F.coalesce(F.try_element_at(runs, F.lit(-1)), F.array().cast("array<int>")))


def block_changes(pairs: DataFrame, filings: DataFrame, section_name: str, separator: str = PARAGRAPHS, text: str = "markdown") -> DataFrame:
    """One row per block of a section in either of two filings (accession_number, previous_accession).

    ``change`` (equal, moved, added, removed), ``previous_position``,
    ``current_position``, ``block``. Pairs of which one filing lacks the section
    have none. Filings are parsed once: their blocks are stored in the shared folder, and
    all joins read them there. Where the pairs name less than half of the filings, only those are parsed.
    """
    key = ["accession_number", "previous_accession"]
    asked = pairs.select(F.explode(F.array(*key)).alias("accession_number")).distinct()
    # a semi join moves whole texts, which only pays where it leaves most of them out
    if 2 * asked.count() < filings.select("accession_number").count():
        filings = filings.join(asked, "accession_number", "left_semi")
    rows = stored(section_blocks(filings, section_name, separator, text))
    own = numbered(rows)
    present = rows.select("accession_number").distinct()
    whole = stored(pairs.select(*key).distinct().join(present, "accession_number", "left_semi").join(
        present.withColumnRenamed("accession_number", "previous_accession"), "previous_accession", "left_semi"))
    now = whole.join(own.withColumnRenamed("position", "current_position"), "accession_number")
    old = whole.join(own.withColumnsRenamed({"accession_number": "previous_accession", "position": "previous_position"}), "previous_accession")
    both = stored(now.join(old, [*key, "digest", "nth"], "full").select(*key, "current_position", "previous_position"))
    runs = both.where(c("current_position").isNotNull() & c("previous_position").isNotNull()).groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("previous_position", "current_position"))).alias("p"))
    kept = runs.select(*key, F.explode(rising_run(F.transform("p", lambda x: x["current_position"]))).alias("current_position"), F.lit(True).alias("in_order"))
    named = both.join(kept, [*key, "current_position"], "left").withColumn(
        "change", F.when(c("previous_position").isNull(), "added").when(c("current_position").isNull(), "removed").when(c("in_order"), "equal").otherwise("moved"))
    place = F.when(c("current_position").isNotNull(), F.struct(c("accession_number").alias("a"), c("current_position").alias("p"))).otherwise(
        F.struct(c("previous_accession").alias("a"), c("previous_position").alias("p")))
    texts = rows.select(F.struct(c("accession_number").alias("a"), c("position").alias("p")).alias("place"), "block")
    return named.withColumn("place", place).join(texts, "place").select(*key, "change", "previous_position", "current_position", "block")


def ordered_similarity(changes: DataFrame) -> DataFrame:
    """Per pair of filings: blocks by kind of change, and ``similarity_ratio``, twice the equal ones by all of both texts."""
    kinds = ("equal", "moved", "added", "removed")
    g = changes.groupBy("accession_number", "previous_accession").agg(*[F.count_if(c("change") == k).alias(k) for k in kinds])
    return g.withColumn("similarity_ratio", F.round(2 * c("equal") / (2 * (c("equal") + c("moved")) + c("added") + c("removed")), 6))
