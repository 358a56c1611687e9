"""Language ID by prediction by partial matching.

Each language has a context tree over bytes up to ``order``: counts of the
bytes that followed every context. A byte costs -log2 of its share in the
longest context that has seen it; each longer context that has not costs an
escape (method C: as many escapes as distinct followers). A context a language
never met costs nothing. The statistics are frozen after training, so a text's
exact code length under a language is a sum over its bytes, and the language
with the shortest code wins.

The trees of all languages share their contexts as nodes, so one look-up a byte
yields its cost under every language. Training reads a bounded sample
(``rows`` documents a language); contexts beyond ``contexts`` are pruned, the
rarest first, and their texts back off to the next shorter one.

A text that is null or has no letter is ``und`` with score 0, as is every text
if nothing could be learned. Null ids take part. Ties go to the smaller name.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import byte_views, held_by_worker, held_out, slices, smallest_sample, text_column

ORDER = 3
SAMPLE_ROWS = 2000
"""Training documents a language, at most."""
CONTEXTS = 60_000
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")


def windows(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of all texts the ``order`` bytes before it as one number, and the byte. Zeros stand before a text."""
    pad = b"\0" * order
    data = np.frombuffer(pad + pad.join(texts), np.uint8)
    length = np.array([len(x) for x in texts], np.int64)
    # positions of the texts' bytes: each text has one pad before it
    at = np.arange(int(length.sum()), dtype=np.int64) + np.repeat(np.arange(1, len(texts) + 1) * order, length)
    context = np.zeros(len(data) + 1, np.int32)
    for k in range(order):
        context[k + 1:len(data) + 1] |= data[:len(data) - k].astype(np.int32) << np.int32(8 * k)
    return context[at], data[at]


def ngram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``lang``, ``gram`` (context and byte as one number), ``n`` over whole texts; combined in each task first."""

    def run(batches):
        for batch in slices(batches, limit=2 << 20):
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = byte_views(batch.column("text"))
            for lang in dict.fromkeys(langs.tolist()):
                context, byte = windows([texts[i] for i in np.flatnonzero(langs == lang)], order)
                gram, n = np.unique(context.astype(np.int64) << 8 | byte, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class ContextTrees:
    """Frozen statistics: code length of every byte after every kept context, under every language."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, order: int = ORDER, contexts: int = CONTEXTS):
        self.langs, self.order, width = langs, order, len(langs)
        symbols = np.unique(gram & 255)
        self.symbol = np.full(256, len(symbols), np.int32)  # the last column: bytes never seen
        self.symbol[symbols] = np.arange(len(symbols))
        self.width = len(symbols) + 1
        cost = np.full((1, self.width, width), 8.0, np.float32)  # a byte no context has seen: uniform
        node = np.zeros(1, np.int32)  # context number -> row of cost
        for k in range(order + 1):
            mask = (1 << (8 * (k + 1))) - 1
            key, at = np.unique(gram & mask, return_inverse=True)
            count = np.zeros((len(key), width))
            np.add.at(count, (at, lang), n)
            own, where = np.unique(key >> 8, return_inverse=True)
            total = np.zeros((len(own), width))
            kinds = np.zeros((len(own), width))
            np.add.at(total, where, count)
            np.add.at(kinds, where, count > 0)
            if k and len(own) > contexts:
                keep = np.zeros(len(own), bool)
                keep[np.argsort(-total.sum(axis=1), kind="stable")[:contexts]] = True
                chosen = keep[where]
                number = np.cumsum(keep) - 1
                key, count, where = key[chosen], count[chosen], number[where[chosen]]
                own, total, kinds = own[keep], total[keep], kinds[keep]
            parent = node[own & ((1 << (8 * (k - 1))) - 1)] if k else np.zeros(len(own), np.int32)
            room = total + kinds
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(room > 0, -np.log2(kinds / room), 0.0)
                direct = -np.log2(count / room[where])
            fresh = cost[parent]
            fresh += escape[:, None, :].astype(np.float32)
            rows, cols, width_at = where, self.symbol[key & 255], count > 0
            seen = fresh[rows, cols]
            fresh[rows, cols] = np.where(width_at, direct, seen)
            base = len(cost)
            cost = np.concatenate([cost, fresh])
            # a longer context that isn't kept goes where its end goes
            step = np.tile(node, 256) if k else np.zeros(1, np.int32)
            step[own] = base + np.arange(len(own), dtype=np.int32)
            node = step
        self.node, self.cost = node, np.ascontiguousarray(cost.reshape(-1, width))

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of every text (row) under every language (column)."""
        out = np.zeros((len(texts), len(self.langs)))
        length = np.array([len(x) for x in texts], np.int64)
        context, byte = windows(texts, self.order)
        row = self.node[context] * np.int32(self.width) + self.symbol[byte]
        full = np.flatnonzero(length)
        start = (np.cumsum(length) - length)[full]
        step = 1 << 20
        for a in range(0, len(row), step):  # bounded copies, also for one very long text
            b = min(a + step, len(row))
            lo = int(np.searchsorted(start, a, "right")) - 1
            hi = int(np.searchsorted(start, b, "left"))
            cuts = np.maximum(start[lo:hi], a) - a
            out[full[lo:hi]] += np.add.reduceat(self.cost[row[a:b]], cuts, axis=0, dtype=np.float64)
        return out


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, order: int = ORDER, contexts: int = CONTEXTS) -> tuple[list[str], list[np.ndarray]]:
    """Language names and the n-gram statistics of the training documents.

    Only texts with a language count that aren't held out. The driver gets
    distinct n-grams of the bounded sample, not of the corpus.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(4, 2)).select("doc_id", "text", "lang")
    found = ngram_counts(smallest_sample(known, "lang", rows), order).toArrow().combine_chunks()
    langs = sorted(set(found.column("lang").to_pylist()))
    number = {x: i for i, x in enumerate(langs)}
    lang = np.array([number[x] for x in found.column("lang").to_pylist()], np.int64)
    return langs, [lang, found.column("gram").to_numpy(), found.column("n").to_numpy()]


def identify(docs: DataFrame, keep: str = "doc_id", rows: int = SAMPLE_ROWS, order: int = ORDER, contexts: int = CONTEXTS) -> DataFrame:
    """``keep``, ``lang_pred``, ``score`` and ``bits`` a byte of every text.

    ``docs`` has ``doc_id``, ``text``, ``lang``; ``keep`` is the id, or ``row`` for
    a struct of all columns. The score is the share of the winner if each
    language is as likely as its code is short.
    """
    from pyspark.sql.types import DoubleType, StringType, StructType

    langs, stats = train(docs, rows, order, contexts)
    shared = docs.sparkSession.sparkContext.broadcast((langs, stats))
    name_of_model = uuid.uuid4().hex
    texts = docs.select(F.struct(*docs.columns).alias("row")) if keep == "row" else docs.select(keep, F.col("text").cast("string").alias("text"))
    schema = StructType([texts.schema[keep]]).add("lang_pred", StringType()).add("score", DoubleType()).add("bits", DoubleType())

    def run(batches):
        trees = None
        for batch in slices(batches, limit=2 << 20):
            raw = byte_views(text_column(batch))
            letter = np.array([bool(_LETTER.search(x.decode("utf-8", "replace"))) for x in raw], bool)
            if langs and trees is None:
                trees = held_by_worker(name_of_model, lambda: ContextTrees(shared.value[0], *shared.value[1], order, contexts))
            size = np.array([max(1, len(x)) for x in raw])
            if langs:
                bits = trees.code_lengths(raw)
                best = bits.argmin(axis=1)
                least = bits[np.arange(len(raw)), best]
                share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
            else:
                letter[:] = False
                best, least, share = np.zeros(len(raw), int), np.zeros(len(raw)), np.zeros(len(raw))
            name = [langs[i] if ok else UNKNOWN for i, ok in zip(best, letter)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(keep), pa.array(name, pa.string()), pa.array(np.where(letter, share, 0.0)), pa.array(least / size)],
                names=[keep, "lang_pred", "score", "bits"])

    return texts.mapInArrow(run, schema)


def languages(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score``."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    return identify(own).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


def recognised(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents of a known language, with all their columns."""
    found = identify(docs, keep="row")
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
