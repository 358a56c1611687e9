"""Near-duplicate documents by similarity, for stages that drop documents.

Two documents are linked if the exact Jaccard similarity of their distinct runs
of five words is at least 0.8; every link is confirmed so. Candidates meet in
MinHash bands (16 of 4 minima find a pair at 0.8 with a probability above
0.9997) and are compared there by the bit planes of :mod:`simhash`. At 0.8
fingerprints of distinct runs differ in about 10 of 64 bits, so no bucket of
equal parts of the bits could serve; ``RADIUS`` leaves room for five standard
deviations.

Documents connected by candidates then meet with their texts, each text once,
and a spanning forest of confirmed links is reported; many such documents are
split into blocks, by rows and by bytes, and pairs of blocks are compared apart
from each other. Runs are compared by their 64-bit hashes. Groups are the
connected components of confirmed links.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm import simhash
from tallyfold.llm.common import byte_views, components, documents, map_texts
from tallyfold.llm.paragraph_dedup import signatures
from tallyfold.session import cut_lineage

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 24
BLOCK_ROWS = 500
BLOCK_BYTES = 8 << 20


def node(docs: DataFrame) -> Column:
    """A document by its id, the null id last, and its text."""
    doc_id = docs["doc_id"].cast("long")
    return F.struct(doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0)).alias("id"), F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("digest"))


def run_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of a text's distinct runs of words."""
    own = simhash.shingles(text, size)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, own, repeat(simhash.SEED)), np.uint64, len(own)))


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``node``, ``bytes``, the fingerprint ``fp`` and the keys of the ``bands`` of every document."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = byte_views(batch.column("text"))
        sets = [run_hashes(x, size) for x in texts]
        fp = np.array([simhash.majority(x) for x in sets], np.uint64).view(np.int64)
        filled = [x if len(x) else np.zeros(1, np.uint64) for x in sets]
        keys = signatures(np.concatenate(filled), np.array([len(x) for x in filled]))
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.reshape(-1)))
        return pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(x) for x in texts], pa.int64()), pa.array(fp), bands], names=["node", "bytes", "fp", "bands"])

    own = documents(docs)
    return map_texts(own.select(node(own).alias("node"), "text"), work, "node struct<none: boolean, id: long, digest: long>, bytes long, fp long, bands array<bigint>", limit=4 << 20)


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have that Jaccard similarity; two empty ones have."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def confirmed_forest(sets: list[np.ndarray], similarity: float, radius: int) -> list[tuple[int, int]]:
    """A spanning forest (index pairs) of the pairs within the radius whose exact Jaccard is high enough."""
    values = np.array([simhash.majority(x) for x in sets], np.uint64)
    out: list[tuple[int, int]] = []
    left = np.arange(len(sets))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            sliced = simhash.planes(values[left] ^ values[at])
            near = np.flatnonzero(simhash.within(iter(sliced), sliced.shape[1], radius)[:len(left)])
            linked = near[[alike(sets[at], sets[x], similarity) for x in left[near].tolist()]] if len(near) else near
            found = left[linked].tolist()
            out.extend((at, x) for x in found)
            queue.extend(found)
            left = np.delete(left, linked)
    return out


def confirmed_links(placed: DataFrame, size: int, similarity: float, radius: int) -> DataFrame:
    """Links (``a``, ``b``: nodes) between the texts that share a ``component``, ``i`` and ``j``."""
    key = ["component", "i", "j"]
    flat = placed.select(*key, "node.none", "node.id", "node.digest", "text")
    ordered = flat.repartition(*key).sortWithinPartitions(*key)

    def solve(rows: list[tuple]) -> list[tuple]:
        nodes, sets = [x[0] for x in rows], [x[1] for x in rows]
        return [(*nodes[p], *nodes[q]) for p, q in confirmed_forest(sets, similarity, radius)]

    def run(frames):
        names = ["a_none", "a_id", "a_digest", "b_none", "b_id", "b_digest"]
        last, rows = None, []
        for frame in frames:
            out = []
            for *place, none, doc_id, digest, text in frame.itertuples(index=False):
                if place != last:
                    out += solve(rows)
                    last, rows = place, []
                rows.append(((none, doc_id, digest), run_hashes((text or "").encode(), size)))
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(solve(rows), columns=names)

    found = ordered.mapInPandas(run, "a_none boolean, a_id long, a_digest long, b_none boolean, b_id long, b_digest long")
    return found.select(*(F.struct(*(F.col(f"{x}_{n}").alias(n) for n in ("none", "id", "digest"))).alias(x) for x in "ab"))


def surplus(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``node`` of every document of a group but its smallest."""
    own = cut_lineage(sketches(docs, size))
    rows = own.select("fp", F.posexplode("bands").alias("t", "k")).distinct()
    candidates = components(simhash.bucket_pairs(rows, radius))
    label = F.coalesce("component", "fp").alias("component")
    members = own.join(candidates, own["fp"] == candidates["id"], "left").select("node", "bytes", label)
    sizes = members.groupBy("component").agg(F.count("*").alias("n"), F.sum("bytes").alias("total")).where("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / block_rows), F.ceil(F.col("total") / block_bytes), F.lit(1)).cast("int")
    wanted = members.join(sizes, "component").select("node", "component", blocks.alias("blocks")).distinct()
    texts = documents(docs)
    texts = texts.select(node(texts).alias("node"), "text")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = texts.join(wanted, "node").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "text")
    groups = components(confirmed_links(placed, size, similarity, radius))
    return groups.where("id <> component").select(F.col("id").alias("node")).distinct()


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` without the surplus documents of its groups."""
    gone = surplus(docs, **settings).select(F.col("node").alias("__node"))
    return docs.join(gone, node(docs) == gone["__node"], "left_anti")
