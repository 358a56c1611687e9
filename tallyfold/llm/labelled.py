"""Bounded samples of labelled documents, for the operators that fit a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import documents, smallest_sample

LONGEST = 32 << 10
"""Documents of more bytes than this aren't used for training; with the row bound it bounds what is collected."""


def training_rows(docs: DataFrame, labels: DataFrame, label: str, aside: Column, rows: int, longest: int = LONGEST) -> tuple[DataFrame, dict[int, int]]:
    """``doc_id``, ``text``, ``y`` of at most ``rows`` documents a label, and how many labels of each kind there are.

    Ids are chosen from the labels alone, so only their bounded number is
    broadcast to the scan of the texts. Labels other than 0 and 1 and rows set
    aside are left out; a document with both labels stands in both.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    own = own.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~aside).distinct()
    counts = {r[0]: r[1] for r in own.groupBy("y").count().collect()}
    chosen = smallest_sample(own, "y", rows)
    texts = documents(docs).where(F.octet_length("text") <= longest)
    return texts.join(F.broadcast(chosen), "doc_id"), counts
