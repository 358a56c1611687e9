"""Repeated passages by sparse suffix arrays.

Words are runs without ASCII white space, exactly as written. Of every window of
``LENGTH`` words one position is chosen by content alone: where the hash of
``GRAM`` words is smallest. Equal windows choose the same place, so only suffixes
that start at chosen positions are kept, about one in twenty. A window either
reaches far right of the position or far left of it, so a suffix only meets those
with the same further words on that side, about thirty, and one that meets none
goes no further. They are sorted by what follows;
neighbours are compared for how far they agree to the right, then to the left,
and a window of ``LENGTH`` words that agrees is a repeat. The result is exact:
every window of ``LENGTH`` words that occurs at two places is found, and no other.

Suffixes that share these words form a block. A block beyond ``BLOCK_ROWS`` is a
repeated passage itself; its windows are grouped by 128-bit hashes, with counts
combined before the shuffle.

Null, empty and shorter texts have no windows, rows without a ``doc_id`` are left
out. Rows that repeat a ``doc_id`` and
its text are one document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import byte_views, documents, free_shuffles, give_back, slices, work_folder
from tallyfold.session import cut_lineage

LENGTH = 50
GRAM = 8
BLOCK_ROWS = 20_000
SIEVE = 1 << 20
RIGHT, LEFT = 1, 2
_ODD = 0x9E3779B97F4A7C15


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every word of a text."""
    words = text.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def minimisers(hashes: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chosen positions of a text's windows, the hash of the words that begin there, and how many words before
    it the last and the first of the windows begin that chose it."""
    n = len(hashes)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.zeros(n - gram + 1, np.uint64)
    for i in range(gram):
        key = key * np.uint64(_ODD) + hashes[i:n - gram + 1 + i]
    key ^= key >> np.uint64(31)
    key *= np.uint64(0xD6E8FEB86659FD93)
    key ^= key >> np.uint64(32)
    # smallest hash first, then the leftmost place
    low = (key & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(key), dtype=np.uint64)
    width, span = length - gram + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[:len(low) - (width - span)], low[width - span:])
    # the windows that chose a place follow each other
    at, first, count = np.unique((low & np.uint64(0xFFFFFFFF)).astype(np.int64), return_index=True, return_counts=True)
    return at, key[at], at - first - count + 1, at - first


def range_hashes(hashes: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` words from each start; the same words have the same one wherever they stand."""
    n = len(hashes)
    power = np.cumprod(np.append(np.uint64(1), np.full(n, _ODD, np.uint64)))
    back = np.cumprod(np.append(np.uint64(1), np.full(n, pow(_ODD, -1, 1 << 64), np.uint64)))
    total = np.append(np.uint64(0), np.cumsum(hashes * power[:n]))
    out = (total[start + size] - total[start]) * back[start]
    return (out ^ (out >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)


def anchors(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id``, ``text_key``, ``pos``, ``low``, ``high``, ``right``, ``left``: the chosen suffixes of each document.

    The windows that chose it begin ``high`` down to ``low`` words before it. Equal
    windows choose alike, so it answers for these alone.

    ``right`` is a hash of the words that every window with at most half of its
    reach left of the position has, ``left`` of those of all other windows; null
    where the text has no such window.
    """
    reach = length - gram
    half = reach // 2

    def run(batches):
        for batch in slices(batches, limit=4 << 20):
            at, count, sides, low, high = [], [], [], [], []
            for raw in byte_views(batch.column("text")):
                own = word_hashes(raw)
                p, _, least, most = minimisers(own, length, gram)
                fits = (p + length - half <= len(own)) & (least <= half), (p > half) & (most > half)
                low.append(least)
                high.append(most)
                side = np.zeros((2, len(p)), np.uint64)
                side[0, fits[0]] = range_hashes(own, p[fits[0]], length - half)
                side[1, fits[1]] = range_hashes(own, p[fits[1]] - half - 1, half + 1 + gram)
                at.append(p)
                count.append(len(p))
                sides.append((side, *fits))
            own = pa.array(np.repeat(np.arange(batch.num_rows), count))
            right, left = (pa.array(np.concatenate([x[0][i] for x in sides]).view(np.int64), mask=~np.concatenate([x[1 + i] for x in sides])) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(own), batch.column("text_key").take(own), *(pa.array(np.concatenate(x).astype(np.int32)) for x in (at, low, high)),
                 right, left], names=["doc_id", "text_key", "pos", "low", "high", "right", "left"])

    return docs.mapInArrow(run, "doc_id long, text_key long, pos int, low int, high int, right long, left long")


def contexts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The words around each of the documents' ``chosen`` positions.

    ``before`` holds the words left of the position and ``after`` those from it on,
    as far as the windows that chose it reach.
    """

    def run(batches):
        for batch in slices(batches, limit=2 << 20):
            rows = []
            for doc_id, raw, chosen in zip(batch.column("doc_id").to_pylist(), byte_views(batch.column("text")), batch.column("chosen").to_pylist()):
                words = raw.split()
                for x in chosen:
                    p, low, high = x["pos"], x["low"], x["high"]
                    rows.append((doc_id, p, low, high, x["kind"], x["key"], b" ".join(words[p - high:p]), b" ".join(words[p:p + length - low])))
            if rows:
                doc, pos, low, high, kind, key, before, after = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), *(pa.array(x, pa.int32()) for x in (pos, low, high, kind)), pa.array(key, pa.int64()),
                     pa.array(before, pa.binary()).cast(pa.string()), pa.array(after, pa.binary()).cast(pa.string())],
                    names=["doc_id", "pos", "low", "high", "kind", "key", "before", "after"])

    return docs.mapInArrow(run, "doc_id long, pos int, low int, high int, kind int, key long, before string, after string")


def _words(text: pa.Array, width: int, right: bool, of: pa.Array) -> np.ndarray:
    """Word numbers of each row, nearest to the position first; where a row has no word, a number no other row has.

    ``of`` numbers the words: their index in it.
    """
    parts = pc.split_pattern(text.cast(pa.large_string()), " ")
    size = pc.list_value_length(parts).to_numpy().astype(np.int64)
    number = pc.index_in(parts.flatten(), value_set=of).to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    if not right:
        at = size[row] - 1 - at
    good = at < width
    out = np.repeat(-1 - np.arange(len(size), dtype=np.int64)[:, None], width, axis=1)
    out[row[good], at[good]] = number[good]
    return out


def _same(a: np.ndarray) -> np.ndarray:
    """How many leading numbers each row shares with the one before it."""
    out = np.zeros(len(a), np.int64)
    if len(a) > 1:
        out[1:] = np.logical_and.accumulate(a[1:] == a[:-1], axis=1).sum(axis=1)
    return out


def block_repeats(table: pa.Table, length: int = LENGTH, gram: int = GRAM) -> pa.Table:
    """Repeated windows in complete blocks of suffixes, sorted by block and by what follows.

    A row for each suffix and each earliest place that some of its windows also
    stand at: the windows start ``high`` down to ``low`` words before the suffix.
    """
    reach = length - gram
    after, before = (table.column(x).combine_chunks().cast(pa.large_string()) for x in ("after", "before"))
    # the empty text has one empty word, which is none
    every = pc.unique(pa.concat_arrays([pc.split_pattern(x, " ").flatten() for x in (after, before)]))
    right, left = _words(after, length, True, every), _words(before, reach, False, every)
    empty = pc.equal(before, "").to_numpy(zero_copy_only=False)
    left[empty] = -1 - np.flatnonzero(empty)[:, None]
    block, kind, low, high = (table.column(x).to_numpy() for x in ("key", "kind", "low", "high"))
    agree = _same(right)
    agree[1:][(block[1:] != block[:-1]) | (kind[1:] != kind[:-1])] = 0
    doc, pos = table.column("doc_id").to_numpy(), table.column("pos").to_numpy().astype(np.int64)
    mixed = np.zeros(len(doc), np.uint64)
    parts = []
    for back in range(reach + 1):
        if back:
            mixed = mixed * np.uint64(_ODD) + left[:, back - 1].astype(np.uint64) + np.uint64(1)
        run = np.cumsum(agree < length - back)  # suffixes that agree in length - back words stand together
        mine = np.flatnonzero((kind == (RIGHT if back <= reach // 2 else LEFT)) & (low <= back) & (back <= high))
        order = mine[np.lexsort((pos[mine], doc[mine], mixed[mine], run[mine]))]
        if not len(order):
            continue
        run_, mixed_ = run[order], mixed[order]
        same = np.append(False, (run_[1:] == run_[:-1]) & (mixed_[1:] == mixed_[:-1]))
        if back:
            same[1:] &= (left[order[1:], :back] == left[order[:-1], :back]).all(axis=1)
        # the word numbers of missing words differ, so windows beyond a text's ends agree with nothing
        start = np.flatnonzero(~same)
        size = np.diff(np.append(start, len(order)))
        first = order[np.repeat(start, size)]
        several = np.repeat((np.maximum.reduceat(doc[order], start) != doc[order[start]]) | (np.maximum.reduceat(pos[order], start) != pos[order[start]]), size)
        mine, source = order[several], first[several]
        if len(mine):
            parts.append(pd.DataFrame({"row": mine, "back": back, "src_doc": doc[source], "shift": pos[source] - pos[mine]}))
    found = pd.concat(parts).groupby(["row", "src_doc", "shift"], as_index=False)["back"].agg(["min", "max"]) if parts else pd.DataFrame(
        {x: np.zeros(0, np.int64) for x in ("row", "src_doc", "shift", "min", "max")})
    row = found["row"].to_numpy()
    return pa.table({"doc_id": doc[row], "src_doc": found["src_doc"].to_numpy(), "shift": found["shift"].to_numpy(),
                     "start": pos[row] - found["max"].to_numpy(), "end": pos[row] - found["min"].to_numpy() + length})


def sorted_repeats(suffixes: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Repeats within the blocks, each sorted in one partition."""
    ordered = suffixes.repartition("kind", "key").sortWithinPartitions("kind", "key", "after")

    def run(batches):
        held: list[pa.RecordBatch] = []  # the rows of blocks that aren't complete yet
        for batch in slices(batches, "after", 3 << 20):
            block = np.stack([batch.column("kind").to_numpy(), batch.column("key").to_numpy()])
            open_from = int(np.flatnonzero((block != block[:, -1:]).any(axis=0)).max(initial=-1)) + 1
            if open_from or (held and (held[-1].column("kind")[-1].as_py(), held[-1].column("key")[-1].as_py()) != tuple(block[:, 0])):
                done = pa.Table.from_batches([*held, batch.slice(0, open_from)])
                held = []
                yield from block_repeats(done, length, gram).to_batches(max_chunksize=10_000)
                del done
                give_back()
            held.append(batch.slice(open_from))
        if held:
            yield from block_repeats(pa.Table.from_batches(held), length, gram).to_batches(max_chunksize=10_000)
            give_back()

    return ordered.mapInArrow(run, "doc_id long, src_doc long, shift long, start long, end long")


def hashed_repeats(suffixes: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The same repeats for blocks of any size: windows by hash, counted before the shuffle and joined back."""
    reach = length - gram

    def run(batches):
        for batch in slices(batches, "after", 1 << 20):
            doc, pos, h1, h2 = [], [], [], []
            for d, p, low, high, kind, before, after in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "pos", "low", "high", "kind", "before", "after"))):
                words = before.encode().split()
                base = len(words)
                words += after.encode().split()
                for back in range(low, min(high, reach // 2) + 1) if kind == RIGHT else range(max(low, reach // 2 + 1), high + 1):
                    window = words[base - back:base - back + length]
                    if len(window) == length:
                        own = b" ".join(window)
                        doc.append(d)
                        pos.append(p - back)
                        h1.append(xxhash.xxh64_intdigest(own, 1))
                        h2.append(xxhash.xxh64_intdigest(own, 2))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(pos, pa.int64()), pa.array(np.array(h1, np.uint64).view(np.int64)), pa.array(np.array(h2, np.uint64).view(np.int64))],
                names=["doc_id", "pos", "h1", "h2"])

    windows = suffixes.mapInArrow(run, "doc_id long, pos long, h1 long, h2 long").distinct()
    place = F.struct("doc_id", "pos")
    classes = windows.groupBy("h1", "h2").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi")
    return windows.join(classes, ["h1", "h2"]).select(
        "doc_id", F.col("lo.doc_id").alias("src_doc"), (F.col("lo.pos") - F.col("pos")).alias("shift"), F.col("pos").alias("start"), (F.col("pos") + length).alias("end"))


def recurring(own: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Anchors once for each side (``kind``, ``key``) whose words ``n`` anchors have, two or more; ``low`` and ``high`` are those of its windows."""
    half = (length - gram) // 2
    sides = F.array(F.struct(F.lit(RIGHT).alias("kind"), F.col("right").alias("key"), F.col("low"), F.least("high", F.lit(half)).alias("high")),
                    F.struct(F.lit(LEFT).alias("kind"), F.col("left").alias("key"), F.greatest("low", F.lit(half + 1)).alias("low"), F.col("high")))
    dealt = own.select("doc_id", "text_key", "pos", F.explode(sides).alias("x")).select("doc_id", "text_key", "pos", "x.*").where("key is not null")
    again = dealt.groupBy("kind", "key").agg(F.count("*").alias("n")).where("n > 1")
    return dealt.join(again, ["kind", "key"])


def repeated_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Passages of at least ``length`` words that stand at two places or more.

    One row per document, passage and first place: ``doc_id``, ``start`` and
    ``end`` (word numbers, end excluded), ``source_doc_id`` and ``source_start`` of
    the first place, and ``removed``, false where the row is the first place
    itself. Places are ordered by ``doc_id``, then position.
    """
    spark = docs.sparkSession
    texts = documents(docs).where((F.length("text") >= 2 * length - 1) & F.col("doc_id").isNotNull()).withColumn("text_key", F.xxhash64("text"))
    folder, chosen_folder = f"{work_folder(spark)}/anchors", f"{work_folder(spark)}/chosen"
    anchors(texts, length, gram).write.parquet(folder)
    recurring(spark.read.parquet(folder), length, gram).write.parquet(chosen_folder)
    free_shuffles(spark)  # those of the anchors aren't needed beside the texts
    chosen = spark.read.parquet(chosen_folder)

    def suffixes(chosen: DataFrame) -> DataFrame:
        """The words around the chosen anchors; texts without any stay where they are."""
        lists = cut_lineage(chosen.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("pos", "low", "high", "kind", "key"))).alias("chosen")))
        free_shuffles(spark)
        # at most SIEVE numbers, whatever the corpus: a coarse filter before the texts are shuffled
        sieve = lists.select(F.pmod(F.xxhash64("doc_id"), F.lit(SIEVE)).alias("sieve")).distinct()
        some = texts.withColumn("sieve", F.pmod(F.xxhash64("doc_id"), F.lit(SIEVE))).join(F.broadcast(sieve), "sieve", "left_semi").drop("sieve")
        return contexts(some.join(lists, ["doc_id", "text_key"]).select("doc_id", "text", "chosen"), length, gram)

    found = sorted_repeats(suffixes(chosen.where(F.col("n") <= block_rows)), length, gram)
    large = chosen.where(F.col("n") > block_rows)
    if not large.isEmpty():
        found = found.union(hashed_repeats(suffixes(large), length, gram))
    # overlapping or touching windows with the same source are one passage
    # rows are many but small and alike, so their number of partitions isn't left to their compressed size
    found = found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "src_doc", "shift")
    along = Window.partitionBy("doc_id", "src_doc", "shift").orderBy("start", "end")
    reached = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    opened = found.withColumn("new", F.coalesce((F.col("start") > reached).cast("int"), F.lit(1)))
    passage = opened.withColumn("passage", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    merged = passage.groupBy("doc_id", "src_doc", "shift", "passage").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.select("doc_id", "start", "end", F.col("src_doc").alias("source_doc_id"), (F.col("start") + F.col("shift")).alias("source_start"),
                         (~(F.col("doc_id").eqNullSafe(F.col("src_doc")) & (F.col("shift") == 0))).alias("removed"))
