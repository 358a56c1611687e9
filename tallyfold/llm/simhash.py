"""SimHash near-dedup with bit-sliced comparison.

Fingerprints that differ in at most ``radius`` of 64 bits agree in at least
``parts - radius`` of ``parts`` equal parts of the bits, so every link shows up
in a bucket of equal parts. Only distinct fingerprints enter. Inside a bucket
fingerprints are stored as vertical bit planes: one query is compared with all
of them at once, carry-save counters add up the differing bits plane by plane,
and a block is abandoned once all its distances exceed the radius.

A bucket reports a spanning forest of its links, never all pairs; a large
bucket is split into blocks, and pairs of blocks are compared apart from each
other. Groups are the connected components of all links.

A null text is an empty one, an empty text has fingerprint zero and links like
any other. Rows that repeat a ``doc_id`` each get a row.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import byte_views, components, documents, map_texts
from tallyfold.session import cut_lineage

BITS = 64
RADIUS = 2
PARTS = 4
SHINGLE = 3
SEED = 42
BLOCK_ROWS = 2048
"""Fingerprints of a bucket that are compared at once; larger buckets are split into pairs of such blocks."""


def shingles(text: bytes, size: int = SHINGLE) -> list[bytes]:
    """Runs of ``size`` words, repeats included; fewer words: the whole sequence; none: nothing."""
    own = text.lower().split()
    if len(own) <= size:
        return [b" ".join(own)] if own else []
    return list(map(b" ".join, zip(*(own[i:] for i in range(size)))))


def majority(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes."""
    total = np.zeros(BITS, dtype=np.int64)
    for a in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[a:a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is set if it is set in over half of the shingles' hashes."""
    own = shingles(text, size)
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, own, repeat(seed)), dtype=np.uint64, count=len(own)))


def fingerprints(docs: DataFrame, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed long."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(x, size, seed) for x in byte_views(batch.column("text"))], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "fp"])

    return map_texts(documents(docs), work, "doc_id long, fp long")


def planes(values: np.ndarray) -> np.ndarray:
    """Bit ``i`` of every value, packed into row ``i``: 64 rows of 64-bit words."""
    pad = -len(values) % 64
    bits = np.unpackbits(np.append(values, np.zeros(pad, np.uint64)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within(differing, words: int, radius: int) -> np.ndarray:
    """Lanes whose set bits over all planes number at most ``radius``.

    ``differing`` yields planes of ``words`` words. Counters are vertical too:
    ``level[k]`` has the lanes with more than ``k`` bits so far, and a plane
    carries through them from the top. Stops once every lane exceeds the radius.
    """
    level = [np.zeros(words, np.uint64) for _ in range(radius + 1)]
    for n, plane in enumerate(differing):
        for k in range(radius, 0, -1):
            level[k] |= level[k - 1] & plane
        level[0] |= plane
        if n % 8 == 7 and not np.any(~level[radius]):
            break
    return np.unpackbits((~level[radius]).view(np.uint8), bitorder="little").view(bool)


def forest(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest (index pairs) of the links among distinct fingerprints.

    Starting anywhere, a reached fingerprint is compared with all that are not
    reached yet; those within the radius are linked to it and reached.
    """
    out: list[tuple[int, int]] = []
    left = np.arange(len(values))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        sliced = planes(values[left])
        while queue and len(left):
            at = queue.pop()
            flip = [np.uint64(0xFFFFFFFFFFFFFFFF) if int(values[at]) >> i & 1 else np.uint64(0) for i in range(BITS)]
            near = within((sliced[i] ^ flip[i] for i in range(BITS)), sliced.shape[1], radius)[:len(left)]
            if near.any():
                found = left[near]
                out.extend((at, int(x)) for x in found)
                queue.extend(int(x) for x in found)
                left = left[~near]
                sliced = planes(values[left])
    return out


def linked_pairs(group: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within small groups: all their pairs are lanes of one bit-sliced comparison. ``group`` is sorted."""
    a, b = [], []
    lag = 1
    while True:
        at = np.flatnonzero(group[lag:] == group[:-lag])
        if not len(at):
            break
        a.append(at)
        b.append(at + lag)
        lag += 1
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y = np.concatenate(a), np.concatenate(b)
    sliced = planes(values[x] ^ values[y])
    near = within(iter(sliced), sliced.shape[1], radius)[:len(x)]
    return x[near], y[near]


def links(distinct: DataFrame, radius: int = RADIUS, parts: int = PARTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links (``a``, ``b``) between the distinct fingerprints ``fp`` that connect all within ``radius``."""
    width = BITS // parts
    mask = (1 << width) - 1
    keys = []
    for n, chosen in enumerate(combinations(range(parts), parts - radius)):
        bits = sum(mask << (i * width) for i in chosen)
        signed = bits - (1 << 64) if bits >= 1 << 63 else bits
        keys.append(F.struct(F.lit(n).cast("int").alias("t"), F.col("fp").bitwiseAND(F.lit(signed)).alias("k")))
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("x")).select("x.t", "x.k", "fp")
    return bucket_pairs(rows, radius, block_rows)


def bucket_pairs(rows: DataFrame, radius: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links (``a``, ``b``) that connect all fingerprints ``fp`` within ``radius`` of a bucket (``t``, ``k``)."""
    sizes = rows.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block_rows).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    shared = rows.join(sizes, ["t", "k"]).withColumn("blocks", blocks).withColumn("mine", mine)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = shared.withColumn("other", other).select(
        F.xxhash64("t", "k", F.least("mine", "other"), F.greatest("mine", "other")).alias("g"), "t", "k",
        F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp")
    ordered = placed.repartition("g").sortWithinPartitions("g", "t", "k", "i", "j")

    def compare(frames):
        rest = None
        for frame in frames:
            rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            last = rest[["t", "k", "i", "j"]].iloc[-1]
            open_from = len(rest)
            same = ((rest["t"] == last["t"]) & (rest["k"] == last["k"]) & (rest["i"] == last["i"]) & (rest["j"] == last["j"])).to_numpy()
            while open_from and same[open_from - 1]:
                open_from -= 1
            done, rest = rest.iloc[:open_from], rest.iloc[open_from:].reset_index(drop=True)
            if len(done):
                yield bucket_links(done, radius)
        if rest is not None and len(rest):
            yield bucket_links(rest, radius)

    return ordered.mapInPandas(compare, "a long, b long")


def bucket_links(frame: pd.DataFrame, radius: int, small: int = 16) -> pd.DataFrame:
    """Links of complete buckets."""
    key = frame[["t", "k", "i", "j"]].to_numpy()
    group = np.cumsum(np.any(np.diff(key, axis=0, prepend=key[:1]) != 0, axis=1))
    values = frame["fp"].to_numpy().view(np.uint64)
    size = np.bincount(group)[group]
    few = np.flatnonzero(size <= small)
    x, y = linked_pairs(group[few], values[few], radius)
    a, b = [values[few[x]]], [values[few[y]]]
    many = np.flatnonzero(size > small)
    if len(many):
        cuts = np.flatnonzero(np.diff(group[many], prepend=-1))
        for lo, hi in zip(cuts, [*cuts[1:], len(many)]):
            own = values[many[lo:hi]]
            for p, q in forest(own, radius):
                a.append(own[p:p + 1])
                b.append(own[q:q + 1])
    return pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})


def near_groups(docs: DataFrame, radius: int = RADIUS, parts: int = PARTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the smallest ``doc_id`` reachable over links."""
    own = cut_lineage(fingerprints(docs))
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    found = components(links(distinct.select("fp"), radius, parts, block_rows))
    ids = distinct.join(found, distinct["fp"] == found["id"]).select("fp", "first_id", "component")
    smallest = ids.groupBy("component").agg(F.min("first_id").alias("component_id"))
    merged = ids.join(smallest, "component").select("fp", "component_id")
    label = distinct.join(merged, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return own.join(label, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` as 16 hex digits, ``component_id``."""
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
