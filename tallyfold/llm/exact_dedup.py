"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A normalised text is cut where its own content says so, so a passage keeps its
cuts wherever it stands. Each chunk has a 64-bit digest. The chunks of all texts
are deduplicated once, by digest and content: a digest that stands for one
content only is a verified identifier; the few that stand for several are told
apart by their content. From then on only lists of identifiers move: texts are
equal when their ordered lists are.

Nulls: a null text is an empty one, a null ``doc_id`` takes part and is never
smaller than another. Rows that repeat a ``doc_id`` and its text are kept or
dropped alike. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import documents
from tallyfold.session import cut_lineage

CHUNK = r"(?s).{1024,8191}?[a-d][e-z] |.{1,8192}"
"""A chunk ends at the first two-letter word end of these classes after 1 024 characters, and at 8 192 at the latest."""


def normalised(text: Column) -> Column:
    """Every run of ASCII white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def chunks(text: Column, pattern: str = CHUNK) -> Column:
    """The chunks of a text in order; they join to the text again."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def unverified_digests(texts: DataFrame, digest=F.xxhash64) -> list[int]:
    """Digests that stand for more than one chunk content.

    Chunks are combined within each task before the shuffle, so a chunk that
    many documents share travels once a task. With 64 bits this list is empty
    below some billions of distinct chunks and has tens of entries at 10^12.
    """
    found = (texts.select(F.explode(chunks(F.col("t"))).alias("chunk")).select(digest(F.col("chunk")).alias("digest"), "chunk")
             .distinct().groupBy("digest").count().where("count > 1"))
    return [r[0] for r in found.select("digest").collect()]


def recipes(docs: DataFrame, digest=F.xxhash64) -> DataFrame:
    """``doc_id``, ``text_sha256`` and ``recipe``, the ordered list of verified chunk identifiers.

    An identifier is the digest and, only where the digest alone is not
    verified, the content itself.
    """
    texts = documents(docs).select("doc_id", normalised(F.col("text")).alias("t"))
    doubtful = unverified_digests(texts, digest)

    def identifier(chunk: Column) -> Column:
        own = digest(chunk)
        content = F.when(own.isin(doubtful), chunk) if doubtful else F.lit(None).cast("string")
        return F.struct(own.alias("digest"), content.alias("content"))

    return texts.select("doc_id", F.sha2(F.col("t"), 256).alias("text_sha256"), F.transform(chunks(F.col("t")), identifier).alias("recipe"))


def exact_groups(docs: DataFrame, digest=F.xxhash64) -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Recipes are checkpointed (some tens of bytes a document), so texts are read
    twice and shuffled once. A group of any size is counted before the shuffle
    and joined back, where large partitions are split.
    """
    lists = cut_lineage(recipes(docs, digest))
    groups = lists.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return lists.join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


ORACLE = r"""
with t as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as n from documents
), g as (
  select n, min(doc_id) as keep_id, count(*) as group_size from t group by n
)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, sha256(n) as text_sha256
from t join g using (n)
"""
