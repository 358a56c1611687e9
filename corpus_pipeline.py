"""A corpus pipeline of five stages over ``documents``.

Every stage is a function of (spark, docs, sf_dir); its result is written as
Parquet below the shared folder and read again as the next stage's ``docs``. All but the
last return the columns of ``documents`` for the documents they keep. ``ORACLE_SQL``
is None: language ID, SimHash and BPE have no SQL form; ``tests/llm`` holds the
pipeline against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import byte_bpe, decontamination, exact_dedup, language_id, near_documents
from tallyfold.llm.common import work_folder

ORACLE_SQL = None


def _keep(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is among ``ids``; a null id may be, too."""
    chosen = ids.select(F.col("doc_id").alias("__keep"))
    return docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["__keep"]), "left_semi")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no known language: without a letter, or scored below one half."""
    return language_id.recognised(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest ``doc_id`` of equal texts."""
    return _keep(docs, exact_dedup.exact_groups(docs).where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the smallest ``doc_id``, of those linked by a five-word Jaccard similarity of 0.8 or more."""
    return near_documents.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a benchmark window."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, token counts and digests of ids and of the decoded bytes."""
    return byte_bpe.token_digests(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = work_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{n}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
