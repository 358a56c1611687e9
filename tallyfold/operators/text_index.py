"""A positional index of texts: many phrases at once, without reading the texts.

A text is a row of words, the runs between white space, in lower case. The index
has segments, runs of texts as a task reads them, and in each a row per word with the
numbers of its texts and its places in them, delta-coded; :func:`postings` has a row
per word and text instead. A phrase is looked up in the vocabulary first: its first word
may be the end of a longer one, its last word the beginning, a single word may
stand anywhere inside; words between must be equal. All of these are equalities of
parts of words with the lengths that are asked for, so no phrase meets a word
it does not match. The lists of the matching words, shifted by their place in
the phrase, are intersected per text.

The hits are those of ``sections.search`` without a limit: case does not count, white
space matches any white space, and hits of a phrase do not overlap. A null or
empty text has no words; a phrase without words has no hits; repeated phrases
count once. A text is to be added once (the ledger tells which are new); a
retried batch overwrites itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions.columns import WHITE, squeeze
from tallyfold.operators.sections import pinned, with_sections
from tallyfold.session import cut_lineage
from tallyfold.sources.store import Log

c = F.col
BUCKETS = 256
BITS = 1 << 22
FEW = 10_000
KEYS = ("accession_number", "position")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"[^{WHITE}]+"), F.lit(0))


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("string")


def section_texts(filings: DataFrame, text: str = "markdown") -> DataFrame:
    """What a search looks at: ``accession_number``, ``position``, ``item_code`` and ``content`` of each section, the whole text where there are none."""
    rows = with_sections(filings, text)
    whole = F.array(F.struct(F.lit(0).alias("position"), F.lit(None).cast("string").alias("item_code"), c(text).alias("content")))
    own = F.transform("sections", lambda s: F.struct(s["position"].alias("position"), s["item_code"].alias("item_code"), s["content"].alias("content")))
    return rows.select("accession_number", F.inline(F.when(F.size("sections") > 0, own).otherwise(whole)))


def postings(texts: DataFrame, keys=KEYS, text: str = "content") -> DataFrame:
    """``term``, the keys and ``gaps``: the first place of the term in the text, then the distances from place to place.

    The words of a text stand in one partition, so they are grouped before the
    shuffle, which moves one list per word and text.
    """
    found = texts.select(*keys, F.posexplode(words(c(text))).alias("place", "term"))
    lists = pinned(found.groupBy("term", *keys).agg(F.array_sort(F.collect_list("place")).alias("places")), at=F.col("places"))
    gaps = F.transform("at", lambda p, i: F.when(i == 0, p).otherwise(p - F.get(c("at"), i - 1)))
    return lists.select("term", *keys, gaps.alias("gaps"))


SEGMENT_BYTES = 16 << 20
SEGMENT = T.StructType([
    T.StructField("segment", T.LongType()), T.StructField("term", T.StringType()), T.StructField("numbers", T.ArrayType(T.IntegerType())),
    T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("gaps", T.ArrayType(T.IntegerType())),
    T.StructField("accession_numbers", T.ArrayType(T.StringType())), T.StructField("positions", T.ArrayType(T.IntegerType())),
    T.StructField("item_codes", T.ArrayType(T.StringType()))])


def _segment(batch):
    """The rows of one segment: its texts in a row without a term, then a row per term with the lists of all its texts.

    A text has a number in its segment; ``numbers`` holds the distances from text to text,
    ``counts`` the places in each, ``gaps`` first place and distances for one text after the other.
    """
    import hashlib

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    keys = [batch.column(i) for i in range(3)]
    told = [f"{a}\x00{p}" for a, p in zip(keys[0].to_pylist(), keys[1].to_pylist())]
    name = int.from_bytes(hashlib.sha256("\x01".join(told).encode()).digest()[:8], "big", signed=True)
    texts = pc.fill_null(batch.column(3), "")
    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    terms, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    sizes = np.diff(lists.offsets.to_numpy(zero_copy_only=False))
    number = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    place = (np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
    # terms in order, so that equal beginnings stand together in the file
    by_name = pc.sort_indices(terms).to_numpy(zero_copy_only=False)
    rank = np.empty(len(by_name), dtype=np.int32)
    rank[by_name] = np.arange(len(by_name), dtype=np.int32)
    codes, terms = rank[codes], terms.take(pa.array(by_name))
    if len(terms) and terms[0].as_py() == "":  # a text without words
        kept = codes > 0
        codes, number, place, terms = codes[kept] - 1, number[kept], place[kept], terms.slice(1)
    order = np.argsort(codes, kind="stable")
    codes, number, place = codes[order], number[order], place[order]
    new_text = np.ones(len(codes), dtype=bool)
    new_text[1:] = (codes[1:] != codes[:-1]) | (number[1:] != number[:-1])
    gaps = place.copy()
    gaps[1:] -= np.where(new_text[1:], 0, place[:-1]).astype(np.int32)
    starts = np.flatnonzero(new_text)
    counts = np.diff(np.append(starts, len(codes))).astype(np.int32)
    list_codes, numbers = codes[starts], number[starts]
    new_term = np.ones(len(starts), dtype=bool)
    new_term[1:] = list_codes[1:] != list_codes[:-1]
    steps = numbers.copy()
    steps[1:] -= np.where(new_term[1:], 0, numbers[:-1]).astype(np.int32)
    edges = np.arange(len(terms) + 1)
    per_term = np.searchsorted(list_codes, edges).astype(np.int32)
    words_per_term = np.searchsorted(codes, edges).astype(np.int32)

    def lists_of(values, offsets):
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))

    n, kinds = len(terms), (pa.string(), pa.int32(), pa.string())
    none = [pa.nulls(n, pa.list_(k)) for k in kinds]
    schema = pa.schema([("segment", pa.int64()), ("term", pa.string()), *[(x, pa.list_(pa.int32())) for x in ("numbers", "counts", "gaps")],
                        *[(x, pa.list_(k)) for x, k in zip(("accession_numbers", "positions", "item_codes"), kinds)]])
    yield pa.RecordBatch.from_arrays(
        [pa.array([name], pa.int64()), pa.nulls(1, pa.string()), *[pa.nulls(1, pa.list_(pa.int32()))] * 3, *[pa.array([k.to_pylist()], pa.list_(t)) for k, t in zip(keys, kinds)]], schema=schema)
    rows = pa.RecordBatch.from_arrays([
        pa.array(np.full(n, name, dtype=np.int64)), terms.cast(pa.string()), lists_of(steps, per_term), lists_of(counts, per_term), lists_of(gaps, words_per_term), *none], schema=schema)
    for at in range(0, n, 20000):
        yield rows.slice(at, 20000)


def segments(texts: DataFrame, text: str = "content") -> DataFrame:
    """The packed index of section texts (``accession_number``, ``position``, ``item_code``, text): nothing is shuffled.

    A segment is a run of texts as a task reads them, of about 16 MB at most unless one text has more.
    Its name is a digest of its texts' keys, so a task run twice writes the same.
    """
    rows = texts.select("accession_number", "position", "item_code", squeeze(F.lower(text)).alias("words"))

    def run(batches):
        import pyarrow as pa

        held, size = [], 0
        for batch in batches:
            step = max(1, int(batch.num_rows * SEGMENT_BYTES / 4 / max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                held.append(part)
                size += part.nbytes
                if size >= SEGMENT_BYTES:
                    yield from _segment(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held, size = [], 0
        if held and sum(x.num_rows for x in held):
            yield from _segment(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return rows.mapInArrow(run, SEGMENT)


def maybe_of(packed: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows of a packed index whose term is among ``terms``, and few others.

    A set of ``BITS`` bits, one per hash, goes out to the tasks; the driver sees hashes below that number.
    """
    def at(term: str) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(BITS)).cast("int").alias("at")

    import numpy as np

    bits = np.zeros(BITS, dtype=bool)
    bits[terms.select(at("term")).distinct().toArrow()["at"].to_numpy()] = True
    small = np.packbits(bits).tobytes()
    names = ["term", "segment", "numbers", "counts", "gaps"]

    def run(batches):
        import pyarrow as pa

        held = np.unpackbits(np.frombuffer(small, dtype=np.uint8)).astype(bool)
        for batch in batches:
            kept = held[batch.column("at").to_numpy()]
            if kept.any():
                yield batch.select(names).filter(pa.array(kept))

    rows = packed.select(*names, at("term"))
    return rows.mapInArrow(run, T.StructType([rows.schema[x] for x in names]))


def unpacked(packed: DataFrame, more: list[str]) -> DataFrame:
    """A row per list of a packed index: the columns ``more``, ``segment``, ``number`` and ``gaps``."""
    own = packed.select(*more, "segment", "numbers", "counts", "gaps")
    schema = T.StructType([*own.select(*more, "segment").schema, T.StructField("number", T.IntegerType()), T.StructField("gaps", T.ArrayType(T.IntegerType()))])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            numbers, counts, gaps = (batch.column(x) for x in ("numbers", "counts", "gaps"))
            sizes = np.diff(numbers.offsets.to_numpy(zero_copy_only=False))
            row = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            steps = numbers.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(steps)])
            begin = np.cumsum(sizes) - sizes
            number = (sums[1:] - np.repeat(sums[begin], sizes)).astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum(counts.flatten().to_numpy(zero_copy_only=False))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), gaps.flatten())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(x).take(row) for x in [*more, "segment"]], pa.array(number), lists], names=[*more, "segment", "number", "gaps"])

    return own.mapInArrow(run, schema)


def places(gaps: Column) -> Column:
    """Delta-coded places as they were."""
    start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))
    # lists of one or two need no fold, and most are that short
    short = F.when(F.size(gaps) == 1, gaps).when(F.size(gaps) == 2, F.array(F.get(gaps, 0), F.get(gaps, 0) + F.get(gaps, 1)))
    full = F.aggregate(gaps, start, lambda a, g: F.struct((a["sum"] + g).alias("sum"), F.concat(a["out"], F.array(a["sum"] + g)).alias("out")))["out"]
    return F.coalesce(short, full)


def phrase_words(phrases: DataFrame, phrase: str = "phrase") -> DataFrame:
    """One row per word of each phrase: ``phrase``, ``n``, ``i``, ``word``, ``first``, ``last`` (its outer words) and ``kind``."""
    rows = phrases.select(c(phrase).alias("phrase")).distinct().withColumn("__w", words(c("phrase"))).where(F.size("__w") > 0)
    n, i = c("n"), c("i")
    kind = F.when(n == 1, "inside").when(i == 0, "end").when(i == n - 1, "start").otherwise("whole")
    rows = rows.select("phrase", F.size("__w").alias("n"), F.get("__w", 0).alias("first"), F.element_at("__w", -1).alias("last"),
                       F.posexplode("__w").alias("i", "word"))
    return rows.withColumn("kind", kind)


def matching_terms(vocabulary: DataFrame, asked: DataFrame) -> DataFrame:
    """The terms each phrase word matches, with ``times``, how often a single word stands in the term.

    The driver sees the distinct lengths of phrase words by kind, nothing else.
    """
    asked = cut_lineage(asked)
    if asked.count() <= FEW:  # by its count, as a checkpoint has no size that the engine knows
        asked = F.broadcast(asked)
    lengths: dict[str, list[int]] = {}
    for r in asked.select("kind", F.length("word").alias("n")).distinct().collect():
        lengths.setdefault(r["kind"], []).append(r["n"])

    def parts(kind: str, cut) -> Column:
        """The parts of a term that a word of this kind may equal, of the lengths asked for."""
        sizes = F.filter(F.array(*[F.lit(x) for x in sorted(lengths[kind])]), lambda n: n <= F.length("term"))
        return F.transform(sizes, lambda n: F.struct(F.lit(kind).alias("kind"), cut(n).alias("word")))

    ways = []
    if "end" in lengths:
        ways.append(parts("end", lambda n: F.right(c("term"), n)))
    if "start" in lengths:
        ways.append(parts("start", lambda n: F.left(c("term"), n)))
    if "whole" in lengths:
        ways.append(F.array(F.struct(F.lit("whole").alias("kind"), c("term").alias("word"))))
    if "inside" in lengths:
        sizes = F.filter(F.array(*[F.lit(x) for x in sorted(lengths["inside"])]), lambda n: n <= F.length("term"))
        ways.append(F.array_distinct(F.flatten(F.transform(sizes, lambda n: F.transform(
            F.sequence(F.lit(1), F.length("term") - n + 1),
            lambda s: F.struct(F.lit("inside").alias("kind"), F.substr(c("term"), s, n).alias("word")))))))
    if not ways:
        ways = [F.array().cast("array<struct<kind:string,word:string>>")]
    cut = vocabulary.select("term", F.inline(F.concat(*ways)))
    times = (F.length("term") - F.length(F.replace(c("term"), c("word"), F.lit("")))) / F.length("word")
    return cut.join(asked, ["kind", "word"]).select(
        "phrase", "n", "i", "term", F.when(c("n") == 1, times.cast("int")).otherwise(1).alias("times"),
        # another hit may begin in the word in which one ends
        ((c("i") == 0) & (F.length("term") >= F.length("first") + F.length("last"))).alias("room"))


def _apart(starts: Column, n: Column, room: Column) -> Column:
    """Hits from the left that do not overlap."""
    last = F.element_at
    free = lambda a, s: (F.size(a) == 0) | (s >= last(a, -1) + n) | ((s == last(a, -1) + n - 1) & F.array_contains(room, s))
    near = F.exists(F.sequence(F.lit(1), F.size(starts)), lambda k: F.get(starts, k) - F.get(starts, k - 1) < n)
    fold = F.aggregate(starts, F.array().cast("array<int>"), lambda a, s: F.when(free(a, s), F.concat(a, F.array(s))).otherwise(a))
    return F.when((F.size(starts) > 1) & F.coalesce(near, F.lit(False)), fold).otherwise(starts)


def phrase_hits(index: DataFrame, vocabulary: DataFrame, phrases: DataFrame, keys=KEYS, join_on=("term",)) -> DataFrame:
    """``phrase``, the keys, ``starts`` (places of the first words of the hits, in order) and ``hits``, for texts with a hit."""
    terms = matching_terms(vocabulary, phrase_words(phrases))
    if "bucket" in join_on:
        terms = terms.withColumn("bucket", bucket(c("term")))
    return _gathered(index.join(terms, list(join_on)), keys)


def _gathered(lists: DataFrame, keys) -> DataFrame:
    """Hits from the lists of matching terms; the lists of a text are brought together once."""
    own = lists.select("phrase", "n", "i", *keys, "times", "room", "gaps").repartition(*keys)
    own = own.select("phrase", "n", "i", *keys, "times", "room", places(c("gaps")).alias("p"))
    # one list per word of the phrase and text, of all the terms it matches
    flat = own.select("phrase", "n", "i", *keys, F.transform("p", lambda x: x - c("i")).alias("p"), "times",
                      F.when(c("room"), F.transform("p", lambda x: x - c("i"))).otherwise(F.array().cast("array<int>")).alias("room"))
    by_word = flat.groupBy("phrase", "n", *keys, "i").agg(
        F.flatten(F.collect_list("p")).alias("p"), F.flatten(F.collect_list("room")).alias("room"), F.sum(F.size("p") * c("times")).alias("times"))
    by_text = by_word.groupBy("phrase", "n", *keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda x: x["p"]).alias("lists"),
        F.flatten(F.collect_list("room")).alias("room"), F.sum("times").alias("times")).where(F.size("lists") == c("n"))
    common = F.aggregate(F.slice("lists", 2, F.greatest(c("n") - 1, F.lit(0))), F.get("lists", 0), lambda a, x: F.array_intersect(a, x))
    found = pinned(by_text, __s=F.array_sort(common))
    found = pinned(found, starts=_apart(c("__s"), c("n"), c("room"))).where(F.size("starts") > 0)
    hits = F.when(c("n") == 1, c("times")).otherwise(F.size("starts")).cast("long")
    return found.select("phrase", *keys, "starts", hits.alias("hits"))


class TextIndex:
    """Packed postings of filing sections in the shared folder, one folder per batch.

    A batch is written as it is read, segment by segment, without a shuffle. A search
    reads the vocabulary, then the lists of the terms that its phrases match.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.lists = Log(spark, f"{path.rstrip('/')}/lists", SEGMENT, compression="zstd")

    def add(self, filings: DataFrame, batch: str, text: str = "markdown") -> int:
        """Index a batch of filings; returns its number of rows, one per segment and one per segment and term."""
        return self.lists.append(segments(section_texts(filings, text)), batch)

    def vocabulary(self) -> DataFrame:
        """``term`` and ``texts``, the number of texts that hold it."""
        return self.lists.read().where(c("term").isNotNull()).groupBy("term").agg(F.sum(F.size("numbers")).alias("texts"))

    def texts(self) -> DataFrame:
        """``segment``, ``number``, ``accession_number``, ``position`` and ``item_code`` of each text."""
        told = F.arrays_zip(c("accession_numbers").alias("accession_number"), c("positions").alias("position"), c("item_codes").alias("item_code"))
        rows = self.lists.read().where(c("term").isNull()).select("segment", F.posexplode(told).alias("number", "t"))
        return rows.select("segment", "number", "t.accession_number", "t.position", "t.item_code")

    def search(self, phrases: DataFrame) -> DataFrame:
        """Hits of all phrases: ``phrase``, ``accession_number``, ``position``, ``item_code``, ``starts``, ``hits``.

        Rows of other terms are left out as they are read; packed rows meet the terms, and are unpacked then.
        """
        terms = cut_lineage(matching_terms(self.vocabulary(), phrase_words(phrases)))
        packed = maybe_of(self.lists.read().where(c("term").isNotNull()), terms)
        lists = unpacked(packed.join(terms, "term"), ["phrase", "n", "i", "times", "room"])
        hits = _gathered(lists, ("segment", "number"))
        return hits.join(self.texts(), ["segment", "number"]).select("phrase", "accession_number", "position", "item_code", "starts", "hits")
