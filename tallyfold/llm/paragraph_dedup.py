"""Near-duplicate paragraphs by MinHash banding.

A paragraph is a line; its words are compared in lower case (A-Z), its features
are the distinct runs of five words. Equal paragraphs are one from the start;
a line of fewer than five words has no run and is compared in no other way. ``BANDS`` bands of ``ROWS`` minima find a pair
at a Jaccard similarity of 0.8 with a probability above 0.9997. Paragraphs that
collide in a band are joined with their texts, and the exact Jaccard decides.

A bucket reports a spanning forest of its links, never all pairs: what is
reached from a paragraph is compared with whatever is not reached yet. Buckets
beyond ``BLOCK_ROWS`` are split into pairs of blocks. Groups are the connected
components; the paragraph with the smallest (``doc_id``, number) stays.

Null and empty texts and lines without a word have no paragraphs. ``least`` is the
fewest words of a line that is compared at all: one in the query, so every
line; five, what the runs need, where it isn't given. Rows without a ``doc_id`` are left out. A row that repeats a ``doc_id``
and its text adds nothing.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import byte_views, components, documents, slices, work_folder

MIN_WORDS = 5
SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
BLOCK_ROWS = 1000
FEW = 16
"""So many sets of a bucket are intersected with each other without asking their parities."""


def paragraphs(text: bytes, least: int = MIN_WORDS) -> list[tuple[int, list[bytes]]]:
    """Number and words of each line that is long enough."""
    return [(i, w) for i, line in enumerate(text.lower().split(b"\n")) if len(line) >= 2 * least - 1 and len(w := line.split()) >= least]


def shingles(words: list[bytes], size: int = SHINGLE) -> list[bytes]:
    """Runs of ``size`` words; fewer words are one run."""
    if len(words) <= size:
        return [b" ".join(words)]
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def signatures(hashes: np.ndarray, count: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band keys of each set of hashes: ``rows`` minima under fixed random functions, hashed together with the band."""
    rng = np.random.default_rng(20)
    odd = rng.integers(1, 1 << 63, (bands, rows), dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 1 << 63, (bands, rows), dtype=np.uint64)
    starts = np.cumsum(count) - count
    out = np.empty((len(count), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(count), b + 1, np.uint64)
        for r in range(rows):
            x = hashes * odd[b, r] + add[b, r]
            low = np.minimum.reduceat(x ^ (x >> np.uint64(29)), starts)
            key = (key ^ low) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
        out[:, b] = key
    return out.view(np.int64)


def paragraph_rows(docs: DataFrame, least: int = MIN_WORDS, text: bool = False) -> DataFrame:
    """``doc_id``, ``par``, ``n_words``, 128 bits of content (``k1``, ``k2``), and ``bands`` or the ``text``."""

    def run(batches):
        for batch in slices(batches, limit=4 << 20):
            doc, par, n, k1, k2, out, sets = [], [], [], [], [], [], []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), byte_views(batch.column("text"))):
                for number, words in paragraphs(raw, least):
                    own = b" ".join(words)
                    doc.append(doc_id)
                    par.append(number)
                    n.append(len(words))
                    k1.append(xxhash.xxh64_intdigest(own, 1))
                    k2.append(xxhash.xxh64_intdigest(own, 2))
                    if text:
                        out.append(own)
                    else:
                        own = shingles(words) if len(words) >= SHINGLE else []
                        sets.append(np.fromiter(map(xxhash.xxh64_intdigest, own, repeat(3)), np.uint64, len(own)))
            if not doc:
                continue
            if text:
                last = pa.array(out, pa.binary()).cast(pa.string())
            else:
                count = np.array([len(x) for x in sets])
                keys = signatures(np.concatenate(sets), count[count > 0])
                # fewer than four distinct runs reach 0.8 only with the same runs, which one band finds
                width = np.where(count < 4, np.minimum(count, 1), BANDS)
                few = np.array([len(np.unique(x)) < 4 if 4 <= len(x) else False for x in sets])
                width[few] = 1
                keys = keys[np.arange(BANDS) < width[count > 0][:, None]]
                last = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(width)).astype(np.int32)), pa.array(keys))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(par, pa.int32()), pa.array(n, pa.int32()), pa.array(np.array(k1, np.uint64).view(np.int64)),
                 pa.array(np.array(k2, np.uint64).view(np.int64)), last], names=["doc_id", "par", "n_words", "k1", "k2", "text" if text else "bands"])

    return documents(docs).where("doc_id is not null").mapInArrow(run, "doc_id long, par int, n_words int, k1 long, k2 long, " + ("text string" if text else "bands array<bigint>"))


def parity(runs: frozenset) -> int:
    """Which of 64 bins hold an odd number of the runs."""
    out = 0
    for x in runs:
        out ^= 1 << (hash(x) & 63)
    return out


def bucket_forest(sets: list[frozenset], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """A spanning forest (index pairs) of the pairs whose exact Jaccard is high enough."""
    if len(sets) > FEW:
        return sketched_forest(sets, similarity)
    out: list[tuple[int, int]] = []
    left = list(range(len(sets)))
    while len(left) > 1:
        queue = [left.pop(0)]
        while queue and left:
            at = queue.pop()
            own, rest = sets[at], []
            for x in left:
                both = len(own & sets[x])
                if both >= similarity * (len(own) + len(sets[x]) - both):
                    out.append((at, x))
                    queue.append(x)
                else:
                    rest.append(x)
            left = rest
    return out


def sketched_forest(sets: list[frozenset], similarity: float) -> list[tuple[int, int]]:
    """The same for many sets: pairs whose parities differ in more bins than the similarity leaves runs to stand in one of them alone aren't intersected."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    bins = np.fromiter(map(parity, sets), np.uint64, len(sets))
    out: list[tuple[int, int]] = []
    left = np.arange(len(sets))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            own, linked = sets[at], []
            near = np.bitwise_count(bins[left] ^ bins[at]) * (1 + similarity) <= (size[left] + len(own)) * (1 - similarity) + 1e-6
            for i in np.flatnonzero(near).tolist():
                x = sets[left[i]]
                both = len(own & x)
                if both >= similarity * (len(own) + len(x) - both):
                    linked.append(i)
            found = left[linked].tolist()
            out.extend((at, x) for x in found)
            queue.extend(found)
            left = np.delete(left, linked)
    return out


def links(buckets: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Verified links (``a``, ``b``: nodes) between the paragraphs of each bucket.

    ``buckets`` has ``bucket``, ``k1``, ``k2`` and ``n``, the bucket's rows;
    ``texts`` has ``k1``, ``k2``, ``node`` and ``text``.
    """
    placed = in_blocks(buckets, ["k1", "k2"], block_rows)
    return block_links(placed.join(texts, ["k1", "k2"]).select("bucket", "i", "j", "node.doc_id", "node.par", "text"), similarity)


def in_blocks(members: DataFrame, key: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``members`` (``bucket``, its rows ``n``, and others) once for each pair of blocks ``i``, ``j`` of its bucket that takes it in."""
    mine = F.pmod(F.xxhash64(*key), F.col("blocks")).cast("int")
    placed = (members.withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int")).withColumn("mine", mine)
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    return placed.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).drop("blocks", "mine", "other", "n")


def block_links(full: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Verified links between the rows (``doc_id``, ``par``, ``text``) of each pair of blocks (``bucket``, ``i``, ``j``)."""
    ordered = full.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        sets = [frozenset(shingles(x.encode().split())) for x in frame["text"]]
        group = np.cumsum((frame[["bucket", "i", "j"]].diff() != 0).any(axis=1).to_numpy())
        cuts = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
        pairs = [(a + p, a + q) for a, b in zip(cuts, [*cuts[1:], len(frame)]) for p, q in bucket_forest(sets[a:b], similarity)]
        p, q = [x for x, _ in pairs], [x for _, x in pairs]
        doc, par = frame["doc_id"], frame["par"]
        return pd.DataFrame({"a_doc": doc.iloc[p].to_numpy(), "a_par": par.iloc[p].to_numpy(), "b_doc": doc.iloc[q].to_numpy(), "b_par": par.iloc[q].to_numpy()})

    def run(frames):
        rest = None
        for frame in frames:
            rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            key = rest[["bucket", "i", "j"]].to_numpy()
            open_from = int(np.flatnonzero((key != key[-1]).any(axis=1)).max(initial=-1)) + 1
            done, rest = rest.iloc[:open_from], rest.iloc[open_from:].reset_index(drop=True)
            if len(done):
                yield solve(done)
        if rest is not None and len(rest):
            yield solve(rest)

    found = ordered.mapInPandas(run, "a_doc long, a_par int, b_doc long, b_par int")
    return found.select(F.struct(F.col("a_doc").alias("doc_id"), F.col("a_par").alias("par")).alias("a"),
                        F.struct(F.col("b_doc").alias("doc_id"), F.col("b_par").alias("par")).alias("b"))


def near_paragraphs(docs: DataFrame, least: int = MIN_WORDS, similarity: float = SIMILARITY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per paragraph that has a near or exact duplicate.

    ``doc_id``, ``paragraph``, ``n_words``, ``keep_doc_id`` and ``keep_paragraph``
    of the one that stays, and ``removed``.
    """
    spark = docs.sparkSession
    folder = f"{work_folder(spark)}/paragraphs"
    paragraph_rows(docs, least).write.parquet(folder)
    rows = spark.read.parquet(folder)
    place = F.struct("doc_id", "par")
    distinct = rows.groupBy("k1", "k2").agg(F.first("bands").alias("bands"))
    # one shuffle: rows meet by bucket, and a bucket of one is dropped where it stands
    buckets = distinct.select(F.explode("bands").alias("bucket"), "k1", "k2").repartition("bucket")
    shared = buckets.withColumn("n", F.count("*").over(Window.partitionBy("bucket"))).where("n > 1")
    pairs_folder = f"{work_folder(spark)}/buckets"
    shared.write.parquet(pairs_folder)
    shared = spark.read.parquet(pairs_folder)
    wanted = shared.select("k1", "k2").distinct()
    texts = paragraph_rows(docs, least, text=True).join(wanted, ["k1", "k2"], "left_semi")
    texts = texts.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.min(place).alias("node"))
    found = components(links(shared, texts, similarity, block_rows))
    members = rows.groupBy("k1", "k2").agg(F.min(place).alias("node"), F.countDistinct("doc_id", "par").alias("copies"))
    members = members.join(found, members["node"] == found["id"], "left").where("copies > 1 or component is not null")
    members = members.select("k1", "k2", F.coalesce("component", "node").alias("keep"))
    return rows.select("doc_id", "par", "n_words", "k1", "k2").distinct().join(members, ["k1", "k2"]).select(
        "doc_id", F.col("par").alias("paragraph"), "n_words", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.par").alias("keep_paragraph"),
        (~place.eqNullSafe(F.col("keep"))).alias("removed"))
