"""Near-duplicate passages by MinHash banding over content-defined paragraphs.

A text is its words in lower case (A-Z), whatever lines they stand on. A paragraph
begins where the hash of ``GRAM`` words is the smallest of ``STARTS`` in a row, and
ends at the first place, ``SHORTEST`` words on or later, where it is the smallest of
``ENDS`` in a row; a text's own two ends count as such places. Where a paragraph ends
before the next begins, another one begins at that end, and the last ``SHORTEST`` words of
a text are one if no other reaches its end: every word of a text of ``SHORTEST`` words
or more stands in a paragraph. Cuts depend on the words nearby alone, so a passage
that stands in two texts is cut in the same way in both, wherever it begins: of 58
equal words at least one whole paragraph is equal.

Features are the distinct runs of five words. ``BANDS`` bands of ``ROWS`` minima find a
pair at a Jaccard similarity of 0.8 with a probability above 0.98 for one paragraph, and
passages have several. Equal paragraphs are one from the start; different ones that
collide in a band are joined with their texts and the exact Jaccard decides;
groups are the connected components. Before texts are fetched, sketches drop what no
text could confirm: the parity of a paragraph's runs in each of ``BINS`` bins differs in no
more bins than there are runs in one of two paragraphs alone, of which 0.8 allows a
ninth of both together (four at most). Touching paragraphs of a text that have a
duplicate in another document are one passage, and passages of at least ``least``
words are reported: as the ends of a repeat lie outside whole paragraphs, a
repeat of over 50 words mostly has 16 to 40 of them inside.

Equal paragraphs are one row before buckets are formed, and large buckets
are split into pairs of blocks; a bucket reports a spanning forest, never all
pairs. Buckets fall apart into the groups that sketches allow; the same group is compared
once, in however many bands it meets. Paragraphs of fewer than ``DISTINCT`` different runs of words (filler such as one
word many times) are no passages. Null, empty and shorter texts have none; rows
without a ``doc_id`` are left out; a row that repeats a ``doc_id`` and its text adds
nothing. Equal paragraphs are recognised by 64-bit hashes of their words.
"""

from __future__ import annotations

from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import byte_views, components, documents, free_shuffles, give_back, remove_folder, slices, work_folder
from tallyfold.llm.paragraph_dedup import SIMILARITY, block_links, in_blocks
from tallyfold.llm.suffix_dedup import range_hashes
from tallyfold.session import cut_lineage

GRAM, STARTS, ENDS, SHORTEST = 3, 32, 8, 16
SHINGLE = 5
DISTINCT = 10
LEAST = 16
BANDS, ROWS = 4, 2
BLOCK_ROWS = 4000
SIEVE = 1 << 20
BINS, COUNT = 27, 5
"""Bins of a sketch, above so many bits that hold the number of different runs."""
MOST = 22
"""A paragraph of more runs, which cuts don't make, is compared with its whole buckets."""
DIRECT = 2048
"""Different sketches of a bucket that are held against each other at once."""
CHUNK = 1 << 18
_MIX = np.uint64(0xD6E8FEB86659FD93)


class Slice:
    """The words of some texts in a row, apart from each other by a gap that no window reaches across."""

    def __init__(self, texts: list[bytes]):
        self.words = [x.split() for x in texts]
        self.size = np.fromiter(map(len, self.words), np.int64, len(texts))
        self.first = np.cumsum(self.size + STARTS) - self.size
        n = int(self.size.sum())
        at = np.arange(n) + np.repeat(self.first - (np.cumsum(self.size) - self.size), self.size)
        self.hashes = np.zeros(int(self.first[-1] + self.size[-1] + STARTS) if len(texts) else 0, np.uint64)
        self.hashes[at] = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(self.words)), np.uint64, n)
        self.room = np.zeros(len(self.hashes), np.int64)  # words up to the end of the text
        self.room[at] = np.repeat(self.first + self.size, self.size) - at

    def runs(self, size: int) -> np.ndarray:
        """A hash of the ``size`` words from each place."""
        out = np.zeros(len(self.hashes), np.uint64)
        for i in range(size):
            out[:len(out) - i] = out[:len(out) - i] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[i:]
        out ^= out >> np.uint64(31)
        out *= _MIX
        return out ^ (out >> np.uint64(32))

    def smallest(self, key: np.ndarray, width: int) -> np.ndarray:
        """Places whose key is the smallest of ``width`` in a row of the same text, the leftmost of equal ones."""
        low = np.where(self.room >= GRAM, (key & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(key), dtype=np.uint64), np.uint64(0xFFFFFFFFFFFFFFFF))
        span = 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[:len(low) - (width - span)], low[width - span:])
        low = low[low != np.uint64(0xFFFFFFFFFFFFFFFF)]
        chosen = np.zeros(len(key), bool)
        chosen[(low & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
        return chosen

    def paragraphs(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and end of each paragraph."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = self.runs(GRAM)
        begins, ends = self.smallest(key, STARTS), self.smallest(key, ENDS)
        full = self.size > 0
        begins[self.first[full]] = True
        ends[(self.first + self.size)[full]] = True
        start, last = np.flatnonzero(begins), np.flatnonzero(ends)
        start = start[self.room[start] >= SHORTEST]
        end = last[np.searchsorted(last, start + SHORTEST)]
        # words between an end and the next begin, or the text's end, get paragraphs of their own
        stop = start + self.room[start]
        until, at = np.minimum(np.append(start[1:], len(self.hashes)), stop), end
        parts = [(start, end)]
        while (open_ := at < until).any():
            until, stop = until[open_], stop[open_]
            more = np.minimum(at[open_], stop - SHORTEST)
            at = last[np.searchsorted(last, more + SHORTEST)]
            parts.append((more, at))
        start, end = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(start)
        return start[order], end[order]


def sketched_runs(runs: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many different runs each paragraph has, those that don't stand in it before, and the sketch of these."""
    count = end - SHINGLE + 1 - start
    bit = np.uint32(1 << COUNT) << ((runs >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.uint32)
    parity = np.bitwise_xor.reduceat(bit, np.stack([start, start + count], axis=1).reshape(-1))[::2] if len(start) else np.zeros(0, np.uint32)
    order = np.argsort(runs, kind="stable")
    before = np.full(len(runs), -1, np.int64)
    again = runs[order[1:]] == runs[order[:-1]]
    before[order[1:][again]] = order[:-1][again]
    near = np.append(0, np.cumsum(before >= np.arange(len(runs)) - STARTS * 4))
    some = np.flatnonzero(near[start + count] > near[start])
    if len(some):
        size = count[some]
        at = np.arange(int(size.sum())) + np.repeat(start[some] - (np.cumsum(size) - size), size)
        new = before[at] < np.repeat(start[some], size)
        count[some] = np.add.reduceat(new, np.cumsum(size) - size)
        parity[some] = np.bitwise_xor.reduceat(np.where(new, bit[at], np.uint32(0)), np.cumsum(size) - size)
    return count, parity | np.where(count > MOST, (1 << COUNT) - 1, count).astype(np.uint32)


def band_keys(runs: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Band keys of each paragraph: minima of its runs' hashes under fixed random functions, hashed with the band."""
    rng = np.random.default_rng(6)
    odd = rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
    ranges = np.stack([start, end - SHINGLE + 1], axis=1).reshape(-1)
    out = []
    for b in range(BANDS):
        key = np.full(len(start), b + 1, np.uint64)
        for r in range(ROWS):
            x = runs * odd[b, r]
            x ^= x >> np.uint64(29)
            low = np.minimum.reduceat(x, ranges)[::2]
            key = (key ^ low) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
        out.append(key.view(np.int64))
    return out


def paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key``, ``start``, ``end``, the content's hash ``k``, its ``sketch``, and the band keys ``b0``, ``b1`` and so on.

    Equal paragraphs have the same sketch and band keys; those of one slice give them once, the others have null.
    """
    keys = [f"b{i}" for i in range(BANDS)]

    def run(batches):
        for batch in slices(batches, limit=2 << 20):
            own = Slice([x.lower() for x in byte_views(batch.column("text"))])
            start, end = own.paragraphs()
            runs = own.runs(SHINGLE)
            count, sketch = sketched_runs(runs, start, end)
            good = count >= DISTINCT
            start, end, sketch = start[good], end[good], sketch[good]
            if not len(start):
                continue
            doc = np.searchsorted(own.first, start, "right") - 1
            k = range_hashes(own.hashes, start, end - start).view(np.int64)
            again = np.ones(len(k), bool)
            again[np.unique(k, return_index=True)[1]] = False
            at = pa.array(doc)
            columns = [batch.column("doc_id").take(at), batch.column("text_key").take(at), *(pa.array((x - own.first[doc]).astype(np.int32)) for x in (start, end)), pa.array(k),
                       *(pa.array(x, mask=again) for x in (sketch.view(np.int32), *band_keys(runs, start, end)))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "start", "end", "k", "sketch", *keys])
            give_back()

    own = documents(docs).where("doc_id is not null").withColumn("text_key", F.xxhash64("text"))
    return own.mapInArrow(run, "doc_id long, text_key long, start int, end int, k long, sketch int, " + ", ".join(f"{x} long" for x in keys))


def paragraph_texts(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """``k``, ``text`` and ``held`` of the paragraphs that each document's ``chosen`` names (``start``, ``end``, ``k``, ``held``)."""
    # at most SIEVE numbers, whatever the corpus: a coarse filter before the texts are shuffled
    sieve = lists.select(F.pmod(F.xxhash64("doc_id"), F.lit(SIEVE)).alias("sieve")).distinct()
    some = documents(docs).withColumn("sieve", F.pmod(F.xxhash64("doc_id"), F.lit(SIEVE))).join(F.broadcast(sieve), "sieve", "left_semi").drop("sieve")

    def run(batches):
        for batch in slices(batches, limit=2 << 20):
            chosen, text = batch.column("chosen"), []
            flat = chosen.flatten()
            places = zip(*(flat.field(x).to_pylist() for x in ("start", "end")))
            for raw, n in zip(byte_views(batch.column("text")), chosen.value_lengths().to_pylist()):
                words = raw.lower().split()
                text += [b" ".join(words[a:b]) for a, b in islice(places, n)]
            yield pa.RecordBatch.from_arrays([flat.field("k"), pa.array(text, pa.binary()).cast(pa.string()), flat.field("held")], names=["k", "text", "held"])

    some = some.withColumn("text_key", F.xxhash64("text"))
    return some.join(lists, ["doc_id", "text_key"]).select("text", "chosen").mapInArrow(run, "k long, text string, held array<struct<bucket: long, n: long>>")


def allowed(similarity: float = SIMILARITY) -> np.ndarray:
    """How many runs may stand in one of two paragraphs alone, by the number of both's different runs."""
    both = np.arange(2 << COUNT)
    return np.where(both <= 2 * MOST, both * (1 - similarity) / (1 + similarity) + 1e-9, 0).astype(np.uint8)


def joined(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``group``, for each place the first one of its group, once the places ``a`` and ``b`` are linked."""
    while True:
        low, high = np.minimum(group[a], group[b]), np.maximum(group[a], group[b])
        apart = low != high
        if not apart.any():
            return group
        a, b = a[apart], b[apart]
        np.minimum.at(group, high[apart], low[apart])
        while ((up := group[group]) != group).any():
            group = up


def near_sketches(rows: np.ndarray, part: np.ndarray, sketch: np.ndarray, limit: np.ndarray):
    """Pairs of ``rows`` of one ``part`` whose sketches allow a link; ``part`` is in order."""
    if not len(rows):
        return
    own, number = sketch[rows], np.uint32((1 << COUNT) - 1)
    start = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    end = np.repeat(np.append(start[1:], len(part)), np.diff(np.append(start, len(part))))
    at, step, a, b = np.arange(len(rows)), 0, [], []
    while len(at := at[at + (step := step + 1) < end[at]]):
        x, y = own[at], own[at + step]
        near = at[np.bitwise_count((x ^ y) >> np.uint32(COUNT)) <= limit[(x & number) + (y & number)]]
        a.append(rows[near])
        b.append(rows[near + step])
        if step % DIRECT == 0:
            yield np.concatenate(a), np.concatenate(b)
            a, b = [], []
    if a:
        yield np.concatenate(a), np.concatenate(b)


def sketch_groups(bucket: np.ndarray, sketch: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """The first place of each place's group: those of a bucket, in order of buckets, joined wherever sketches allow a link.

    Equal sketches are one. Buckets of more than ``DIRECT`` different ones are dealt by parts of the
    sketch, one more than bins may differ, so that any pair has a part in common.
    """
    if not len(bucket):
        return np.zeros(0, np.int64)
    order = np.lexsort((sketch, bucket))
    number = np.cumsum(np.append(False, bucket[1:] != bucket[:-1]))
    first = np.append(True, (number[order[1:]] != number[order[:-1]]) | (sketch[order[1:]] != sketch[order[:-1]]))
    group = joined(np.arange(len(bucket)), order[~first], order[np.flatnonzero(~first) - 1])
    start = np.searchsorted(number, number)
    whole = np.isin(number, number[sketch & np.uint32((1 << COUNT) - 1) > MOST])
    group = joined(group, np.flatnonzero(whole), start[whole])
    rows = order[first]
    hot = (np.bincount(number[rows]) > DIRECT)[number[rows]]
    for a, b in near_sketches(rows[~hot], number[rows[~hot]], sketch, limit):
        group = joined(group, a, b)
    rows, parts = rows[hot], int(limit.max()) + 1
    cuts = [BINS * i // parts for i in range(parts + 1)] if len(rows) else []
    for low, high in zip(cuts, cuts[1:]):
        part = number[rows] << BINS | (sketch[rows] >> np.uint32(COUNT + low) & np.uint32((1 << high - low) - 1)).astype(np.int64)
        turn = np.argsort(part, kind="stable")
        for a, b in near_sketches(rows[turn], part[turn], sketch, limit):
            group = joined(group, a, b)
    return group


def shared_buckets(dealt: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``bucket``, ``n`` and ``k`` of the groups of ``n`` different paragraphs, two or more, that share a bucket and may be near.

    ``dealt`` has ``bucket``, ``k`` and ``sketch``; buckets stay whole without the last. One shuffle of 20 bytes
    a row, and rows are sorted where they arrive. A group is named by what is in it, so that it is compared once in
    whatever bands it meets.
    """
    limit = allowed(similarity)
    if "sketch" not in dealt.columns:
        dealt = dealt.withColumn("sketch", F.lit(0))

    def solve(bucket: np.ndarray, k: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
        again = np.append(False, bucket[1:] == bucket[:-1])
        several = np.flatnonzero(again | np.append(again[1:], False))
        several = several[np.lexsort((k[several], bucket[several]))]
        bucket, k, sketch = bucket[several], k[several], sketch[several]
        new = np.append(True, (bucket[1:] != bucket[:-1]) | (k[1:] != k[:-1]))[:len(k)]
        bucket, k, sketch = bucket[new], k[new], sketch[new]
        group = sketch_groups(bucket, sketch.view(np.uint32), limit)
        n = np.bincount(group, minlength=len(k))[group]
        mixed = k.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _MIX
        name = np.zeros(len(k), np.uint64)
        np.add.at(name, group, mixed ^ (mixed >> np.uint64(32)))
        return pa.RecordBatch.from_arrays([pa.array(x[n > 1]) for x in (name[group].view(np.int64), n, k)], names=["bucket", "n", "k"])

    def run(batches):
        held, fresh = [], 0
        for batch in batches:
            held.append([batch.column(x).to_numpy() for x in ("bucket", "k", "sketch")])
            fresh += batch.num_rows
            if fresh < CHUNK:
                continue
            columns = [np.concatenate(x) for x in zip(*held)]
            done = np.searchsorted(columns[0], columns[0][-1])  # the last bucket may go on
            if done:
                yield solve(*(x[:done] for x in columns))
            left = done + np.unique(columns[1][done:], return_index=True)[1]
            held, fresh = [[x[left] for x in columns]], 0
        if held:
            yield solve(*(np.concatenate(x) for x in zip(*held)))

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket long, n long, k long")


def near_links(rows: DataFrame, docs: DataFrame, similarity: float = SIMILARITY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Confirmed links (``a``, ``b``: content hashes) between different paragraphs."""
    spark = docs.sparkSession
    keys = [f"b{i}" for i in range(BANDS)]
    dealt = rows.where("b0 is not null").select(F.explode(F.array(*keys)).alias("bucket"), "k", "sketch")
    folder = f"{work_folder(spark)}/members"
    shared_buckets(dealt, similarity).write.parquet(folder)
    free_shuffles(spark)
    held = spark.read.parquet(folder).groupBy("k").agg(F.collect_set(F.struct("bucket", "n")).alias("held"))
    place = F.struct("doc_id", "text_key", "start", "end").alias("place")
    places = rows.where("b0 is not null").select("k", place).join(held, "k").groupBy("k").agg(F.min("place").alias("place"), F.first("held").alias("held"))
    places = places.select("place.*", "k", "held")
    lists_folder, texts_folder = f"{work_folder(spark)}/lists", f"{work_folder(spark)}/texts"
    places.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "end", "k", "held")).alias("chosen")).write.parquet(lists_folder)
    del held, places
    remove_folder(spark, folder)
    free_shuffles(spark)  # those of paragraphs aren't needed beside those of whole texts
    paragraph_texts(docs, spark.read.parquet(lists_folder)).write.parquet(texts_folder)
    remove_folder(spark, lists_folder)
    free_shuffles(spark)  # nor the other way round
    members = spark.read.parquet(texts_folder).select("k", "text", F.explode("held").alias("x")).select("x.*", F.col("k").alias("doc_id"), F.lit(0).alias("par"), "text")
    links = cut_lineage(block_links(in_blocks(members, ["doc_id"], block_rows), similarity).select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b")))
    remove_folder(spark, texts_folder)
    return links


def near_passages(docs: DataFrame, least: int = LEAST, similarity: float = SIMILARITY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per passage of a document and document that its paragraphs are kept in.

    ``doc_id``, ``start``, ``end`` (word numbers, end excluded), ``n_words``,
    ``keep_doc_id``, ``keep_start`` (first place, by ``doc_id``, then position, of the
    groups its paragraphs belong to), and ``removed``, false in that document itself.
    """
    spark = docs.sparkSession
    folder = f"{work_folder(spark)}/paragraphs"
    paragraphs(docs).write.parquet(folder)
    rows = spark.read.parquet(folder)
    found = components(near_links(rows, docs, similarity, block_rows))
    # first and last document alone: numbers are aggregated by hash, places only for what is left
    classes = rows.groupBy("k").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    merged = classes.join(found, classes["k"] == found["id"], "left").where("component is not null or first < last")
    merged = cut_lineage(merged.select("k", F.coalesce("component", "k").alias("c"), "first", "last"))
    groups = merged.groupBy("c").agg(F.min("first").alias("keep_doc_id"), F.max("last").alias("last")).where("keep_doc_id < last")
    labelled = merged.select("k", "c").join(groups.drop("last"), "c")
    held = cut_lineage(rows.select("doc_id", "start", "end", "k").join(labelled, "k"))
    del classes, merged, groups, labelled
    free_shuffles(spark)
    firsts = held.where("doc_id = keep_doc_id").groupBy("c").agg(F.min("start").alias("keep_start"))
    placed = held.join(firsts, "c").select("doc_id", "start", "end", "k", F.struct(F.col("keep_doc_id").alias("doc_id"), F.col("keep_start").alias("start")).alias("keep"))
    # one shuffle for both: equal rows of a document meet where its passages are put together
    hits = placed.repartition("doc_id").distinct()
    along = Window.partitionBy("doc_id").orderBy("start", "end", "k")
    reached = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    opened = hits.withColumn("new", F.coalesce((F.col("start") > reached).cast("int"), F.lit(1)))
    numbered = opened.withColumn("passage", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    parts = numbered.groupBy("doc_id", "passage", F.col("keep.doc_id").alias("keep_doc_id")).agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("keep.start").alias("keep_start"))
    whole = Window.partitionBy("doc_id", "passage")
    size = F.max("end").over(whole) - F.min("start").over(whole)
    return parts.withColumn("size", size).where(F.col("size") >= least).select(
        "doc_id", "start", "end", (F.col("end") - F.col("start")).alias("n_words"), "keep_doc_id", "keep_start", (F.col("doc_id") != F.col("keep_doc_id")).alias("removed"))
