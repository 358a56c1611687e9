"""Company relations with validity and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.session import cut_lineage

c = F.col
HOP_DECAY = 0.9


def staleness_factor(last_confirmed: Column, as_of: Column) -> Column:
    """1 up to 89 days, then 0.9, 0.7 from one year and 0.5 from two."""
    age = F.datediff(as_of, last_confirmed)
    return F.when(age < 90, 1.0).when(age <= 365, 0.9).when(age <= 730, 0.7).otherwise(0.5)


def valid_at(edges: DataFrame, day: str) -> DataFrame:
    d = F.lit(day).cast("date")
    return edges.where((c("valid_from") <= d) & (c("valid_to").isNull() | (c("valid_to") > d)))


def ripple(edges: DataFrame, starts: DataFrame, hops: int = 3, min_confidence: float = 0.0) -> DataFrame:
    """Nodes reached from each start in 1..hops steps along (src, dst, confidence).

    Each hop multiplies by the edge confidence and a decay. Paths that meet in
    a node are combined before the next hop (best confidence and path count),
    so the frontier never grows past one row per (start, node).
    """
    usable = edges.where(c("confidence") > min_confidence).select("src", "dst", "confidence")
    usable = cut_lineage(usable.groupBy("src", "dst").agg(F.max("confidence").alias("confidence")))
    front = starts.select(c("node").alias("start"), "node", F.lit(1.0).alias("best"), F.lit(1).cast("long").alias("paths")).distinct()
    found = None
    for hop in range(1, hops + 1):
        step = front.join(usable, front["node"] == usable["src"]).select(
            "start", c("dst").alias("node"), (c("best") * c("confidence") * HOP_DECAY).alias("best"), "paths")
        front = cut_lineage(step.groupBy("start", "node").agg(F.max("best").alias("best"), F.sum("paths").alias("paths")))
        level = front.withColumn("hops", F.lit(hop))
        found = level if found is None else found.unionByName(level)
    return found.select("start", "node", "hops", c("best").alias("confidence"), "paths",
                        F.when(c("best") < 0.7, "speculative").otherwise("reliable").alias("assessment"))


def interlocks(seats: DataFrame, heavy: int = 50) -> tuple[DataFrame, DataFrame]:
    """Companies that share a director, without ever pairing up a crowd.

    ``seats`` has ticker, person, role and committees. Persons with at most
    ``heavy`` companies give pairs (company_a < company_b), formed inside the
    person's own row; persons with more give class rows instead: person, company, its
    role and committees, and how many companies share the person. Any two companies of a
    class are linked, so no link is lost (:func:`same_class` rebuilds pairs that
    are asked for). The count comes first, so no list ever exceeds ``heavy``.
    """
    own = seats.groupBy("person", "ticker").agg(F.min("role").alias("role"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("committees")))).alias("committees"))
    sizes = own.groupBy("person").agg(F.count("*").alias("companies")).where(c("companies") > 1)
    shared = own.join(sizes, "person")
    listed = shared.where(c("companies") <= heavy).groupBy("person").agg(F.array_sort(F.collect_list(F.struct("ticker", "role", "committees"))).alias("s"))
    pairs = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    light = listed.select("person", F.explode(pairs).alias("p")).select(
        c("p.x.ticker").alias("company_a"), c("p.y.ticker").alias("company_b"), "person", c("p.x.role").alias("role_at_a"), c("p.y.role").alias("role_at_b"),
        interlock_kind(c("p.x"), c("p.y")).alias("significance"))
    return light, shared.where(c("companies") > heavy).select("person", "ticker", "role", "committees", "companies")


def interlock_kind(x: Column, y: Column) -> Column:
    """What an interlock may mean, from the roles and committees at both companies."""
    audit = F.array_contains(x["committees"], "Audit") & F.array_contains(y["committees"], "Audit")
    chair = x["role"].contains("Chairman") | y["role"].contains("Chairman")
    return F.when(audit, "Financial oversight interlock").when(chair, "Executive-level interlock").otherwise("Board-level connection")


def same_class(classes: DataFrame, asked: DataFrame) -> DataFrame:
    """The shared persons of the ``asked`` pairs (company_a, company_b), from class rows."""
    a = classes.select("person", c("ticker").alias("company_a"), F.struct("role", "committees").alias("x"))
    b = classes.select("person", c("ticker").alias("company_b"), F.struct("role", "committees").alias("y"))
    both = asked.select("company_a", "company_b").distinct().join(a, "company_a").join(b, ["person", "company_b"])
    return both.select("company_a", "company_b", "person", c("x.role").alias("role_at_a"), c("y.role").alias("role_at_b"), interlock_kind(c("x"), c("y")).alias("significance"))
