"""Benchmark decontamination by Wu-Manber search over words.

Words are the letters of the search and windows of item words its patterns,
one set per window length. A shift table over blocks of two words tells how far
the window may move without missing a pattern; a block at a pattern's end leads
to the bucket of the patterns with that suffix, and direct comparison confirms.

The benchmark is split into blocks of bounded size, each searched in one pass
over all documents; with one block, the usual case, nothing is shuffled. Null
texts have no words, an item without words has no window, a null ``item_id``
counts as the empty one, repeated items as one id. An empty benchmark
contaminates nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import byte_views, slices, text_column

WINDOW = 10
BLOCK = 2
BENCHMARK_BYTES = 16 << 20
"""Most bytes of benchmark text that one broadcast block holds."""

_KEEP = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z in lower case."""
    return text.translate(_KEEP).split()


class WuManber:
    """Multi-pattern search for word tuples of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[int]], length: int):
        self.length, self.block = length, min(BLOCK, length)
        self.longest = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], list[int]]]] = {}
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                block = pattern[end - self.block:end]
                self.shift[block] = min(self.shift.get(block, self.longest), length - end)
            self.buckets.setdefault(pattern[-self.block:], []).append((pattern, items))

    def find(self, text: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """Start of each occurrence and the items of its pattern."""
        at, end, get, longest, block = self.length, len(text), self.shift.get, self.longest, self.block
        while at <= end:
            tail = tuple(text[at - block:at])
            step = get(tail, longest)
            if step:
                at += step
                continue
            start = at - self.length
            for pattern, items in self.buckets.get(tail, ()):
                if pattern[0] == text[start] and pattern == tuple(text[start:at]):
                    yield start, items
            at += 1


def searchers(items: list[tuple[str, bytes]], window: int = WINDOW) -> tuple[list[WuManber], list[str]]:
    """One searcher per window length, and the item ids its numbers stand for."""
    names = sorted({name for name, _ in items})
    number = {name: i for i, name in enumerate(names)}
    by_length: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
    for name, text in items:
        own = words(text)
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if size else 0):
            owners = by_length.setdefault(size, {}).setdefault(tuple(own[i:i + size]), [])
            if number[name] not in owners:
                owners.append(number[name])
    return [WuManber(p, n) for n, p in sorted(by_length.items())], names


def benchmark_blocks(benchmark: DataFrame, limit: int = BENCHMARK_BYTES) -> list[list[tuple[str, bytes]]]:
    """The benchmark in blocks of at most about ``limit`` bytes, each fetched by a query of its own."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    items = items.where(F.length("text") > 0)
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    count = -(-size // limit) or 1
    part = F.pmod(F.xxhash64("item", "text"), F.lit(count))
    blocks = [[(r[0], r[1].encode()) for r in items.where(part == i).collect()] for i in range(count)]
    return [b for b in blocks if b] or [[]]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BENCHMARK_BYTES, keep: str = "doc_id") -> DataFrame:
    """One row per document: ``keep``, ``n_words``, ``spans`` of hit words ([start, end), merged), ``items``.

    ``keep`` is the id, or ``row`` for a struct of all columns.
    """
    blocks = benchmark_blocks(benchmark, limit)
    parts = [_search(docs, block, window, keep) for block in blocks]
    if len(parts) == 1:
        return parts[0].drop("text_key")
    # one short row per document and block; rows with the same id and text count as often as they stand in the input
    all_parts = reduce(DataFrame.union, parts)
    both = all_parts.groupBy(keep, "n_words", "text_key").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        (F.count("*") / len(blocks)).cast("int").alias("copies"))

    def merge(batches):
        for batch in batches:
            spans = [merged([(x["start"], x["end"]) for x in row]) for row in batch.column("spans").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("spans"), "spans", pa.array(spans, _SPANS))

    schema = both.schema
    return both.mapInArrow(merge, schema).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copy", "copies", "text_key")


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _search(docs: DataFrame, block: list[tuple[str, bytes]], window: int, keep: str) -> DataFrame:
    from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

    texts = docs.select(F.struct(*docs.columns).alias("row")) if keep == "row" else docs.select(keep, F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(block)
    span = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])
    schema = StructType([texts.schema[keep], StructField("n_words", LongType()), StructField("spans", ArrayType(span)),
                         StructField("items", ArrayType(StringType())), StructField("text_key", BinaryType())])

    def run(batches):
        finders, names = searchers(shared.value, window)
        for batch in slices(batches):
            counts, spans, items, keys = [], [], [], []
            for raw in byte_views(text_column(batch)):
                own = words(raw)
                found, hit = [], set()
                for finder in finders:
                    for start, owners in finder.find(own):
                        found.append((start, start + finder.length))
                        hit.update(owners)
                counts.append(len(own))
                spans.append(merged(found))
                items.append(sorted(names[i] for i in hit))
                keys.append(hashlib.blake2b(raw, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(keep), pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string())),
                 pa.array(keys, pa.binary())], names=[keep, "n_words", "spans", "items", "text_key"])

    return texts.mapInArrow(run, schema)


def merged(found: list[tuple[int, int]]) -> list[dict]:
    """Overlapping or touching spans as one."""
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The digest of :func:`benchmark_hits` per document."""
    hits = benchmark_hits(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, window)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"]))
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any hit, with all their columns."""
    return benchmark_hits(docs, benchmark, window, keep="row").where(F.size("spans") == 0).select("row.*")


ORACLE = r"""
with d as (
  select doc_id, row_number() over () as rid,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), b as (
  select cast(item_id as varchar) as item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), p as (
  select distinct item, least(10, len(w)) as n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as pat
  from (select item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)
), sizes as (
  select distinct n from p
), s as (
  select rid, i, n, array_to_string(w[i:i + n - 1], ' ') as pat
  from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)
), h as (
  select s.rid, s.i, s.n, p.item from s join p on s.pat = p.pat and s.n = p.n
), c as (
  select rid, count(distinct x) as n_hit from (select rid, unnest(range(i, i + n)) as x from h) group by rid
), k as (
  select rid, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct rid, item from h) group by rid
)
select d.doc_id, len(d.w) as n_words, coalesce(c.n_hit, 0) as n_hit, coalesce(k.n_items, 0) as n_items,
  sha256(coalesce(k.items, '')) as items_sha256, coalesce(c.n_hit, 0) > 0 as contaminated
from d left join c using (rid) left join k using (rid)
"""
