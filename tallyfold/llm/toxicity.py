"""Toxicity by a factorization machine over hashed terms.

The terms of a text are its distinct lower-case words and their first four and
five letters, hashed into ``2**BITS`` slots. Slots whose smoothed shares in the
two labels differ by less than a factor ``e`` are pruned. The machine adds a
weight for each term left and, through ``FACTORS`` latent factors a term, one
for every pair of terms of the text, in time linear in the terms.

Training reads a bounded sample (``rows`` documents a label), collected as slot
numbers, with AdaGrad steps in a fixed order, then fits a logistic curve to the
raw scores of sampled texts that were left out of the steps, weighted back to
the labels' shares. A text without terms scores as an empty one. With labels of
one kind or none, every score is the share of label 1, 0 without any.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import documents, held_out, map_texts
from tallyfold.llm.labelled import training_rows
from tallyfold.llm.quality import logistic, probability

ROWS = 3000
BITS = 20
FACTORS = 4
EPOCHS = 6
SMOOTHING = 8.0
THRESHOLD = 0.3


def word_slots(word: str, bits: int = BITS) -> list[int]:
    """Slots of a word's terms: itself and its beginnings, marked as such."""
    terms = [word] + [word[:n] + "*" for n in (4, 5)]
    return [xxhash.xxh32_intdigest(t.encode(), 17) >> (32 - bits) for t in terms]


def text_slots(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of every text in a row, ascending, and how many each has. Null has none."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    split = pc.split_pattern_regex(texts, r"[^\p{L}\p{N}]+")
    words = split.flatten().dictionary_encode()
    vocabulary = words.dictionary.to_pylist()
    slots = np.array([word_slots(w, bits) for w in vocabulary], np.int64).reshape(-1, 3)
    blank = np.array([w == "" for w in vocabulary], bool)
    own = words.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
    full = ~blank[own]
    keys = np.sort(((doc[full] << bits)[:, None] | slots[own[full]]).reshape(-1))
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    return keys & ((1 << bits) - 1), np.bincount(keys >> bits, minlength=len(texts))


def telling(slots: np.ndarray, count: np.ndarray, y: np.ndarray, bits: int = BITS, smoothing: float = SMOOTHING, least: float = 1.0) -> np.ndarray:
    """A row number for every slot worth keeping, -1 for the others."""
    of = np.repeat(y, count)
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    with1, with0 = (np.bincount(slots[of == k], minlength=1 << bits) for k in (1, 0))
    prior = smoothing * n1 / len(y), smoothing * n0 / len(y)
    ratio = np.log((with1 + prior[0]) / (n1 + smoothing)) - np.log((with0 + prior[1]) / (n0 + smoothing))
    keep = np.abs(ratio) >= least
    keep &= with1 + with0 > 0
    return np.where(keep, np.cumsum(keep) - 1, -1).astype(np.int32)


def kept(place: np.ndarray, slots: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the kept slots, and how many each text has."""
    rows = place[slots]
    good = rows >= 0
    return rows[good], np.bincount(np.repeat(np.arange(len(count)), count)[good], minlength=len(count))


class Machine:
    """Weights and factors; a text's terms are its non-zero inputs, all equal, with unit length."""

    def __init__(self, terms: int, factors: int = FACTORS, seed: int = 11):
        self.bias = 0.0
        self.weight = np.zeros(terms, np.float32)
        self.factor = (np.random.default_rng(seed).standard_normal((terms, factors)) * 0.01).astype(np.float32)

    def raw(self, slots: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self._parts(slots, count)[0]

    def _parts(self, slots: np.ndarray, count: np.ndarray):
        scale = 1 / np.sqrt(np.maximum(count, 1))
        some = np.flatnonzero(count)
        starts = (np.cumsum(count) - count)[some]
        total = np.zeros((len(count), self.factor.shape[1]))
        linear, square = np.zeros(len(count)), np.zeros(len(count))
        if len(some):
            v = self.factor[slots]
            total[some] = np.add.reduceat(v, starts, axis=0, dtype=np.float64)
            linear[some] = np.add.reduceat(self.weight[slots], starts, dtype=np.float64)
            square[some] = np.add.reduceat((v * v).sum(axis=1), starts, dtype=np.float64)
        return self.bias + scale * linear + 0.5 * scale ** 2 * ((total ** 2).sum(axis=1) - square), total, scale

    def fit(self, slots: np.ndarray, count: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, rate: float = 1.0, ridge: float = 1e-5, batch: int = 64, eps: float = 1e-2, seed: int = 5):
        """AdaGrad on the weighted logistic loss."""
        ends = np.cumsum(count)
        seen_w, seen_v, seen_b = np.full(len(self.weight), eps), np.full(self.factor.shape, eps), eps
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(count))
            for a in range(0, len(order), batch):
                docs = order[a:a + batch]
                own = np.concatenate([slots[ends[d] - count[d]:ends[d]] for d in docs])
                size = count[docs]
                raw, total, scale = self._parts(own, size)
                g = weight[docs] * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[docs]) / len(docs)
                at = np.repeat(np.arange(len(docs)), size)
                gw = g[at] * scale[at]
                gv = (g * scale ** 2)[at][:, None] * (total[at] - self.factor[own])
                by = np.argsort(own, kind="stable")
                cut = np.flatnonzero(np.diff(own[by], prepend=-1))
                slot = own[by][cut]
                if len(slot):
                    gw = np.add.reduceat(gw[by], cut) + ridge * self.weight[slot]
                    gv = np.add.reduceat(gv[by], cut, axis=0) + ridge * self.factor[slot]
                    seen_w[slot] += gw ** 2
                    seen_v[slot] += gv ** 2
                    self.weight[slot] -= rate * gw / np.sqrt(seen_w[slot])
                    self.factor[slot] -= rate * 0.2 * gv / np.sqrt(seen_v[slot])
                seen_b += g.sum() ** 2
                self.bias -= rate * g.sum() / np.sqrt(seen_b)


def slots_of(docs: DataFrame, *more: str) -> DataFrame:
    """``slots`` of every text, with the named columns."""
    fields = {f.name: f for f in docs.schema.fields}
    schema = ", ".join([f"{m} {fields[m].dataType.simpleString()}" for m in more] + ["slots array<int>"])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        slots, count = text_slots(batch.column("text"))
        offsets = pa.array(np.append(0, np.cumsum(count)).astype(np.int32))
        return pa.RecordBatch.from_arrays([*(batch.column(m) for m in more), pa.ListArray.from_arrays(offsets, pa.array(slots.astype(np.int32)))], names=[*more, "slots"])

    return map_texts(docs, work, schema)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = ROWS) -> dict:
    """Machine and curve. Every fourth text of the sample is left for the curve."""
    sample, counts = training_rows(docs, labels, label, held_out(4, 2), rows)
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.0
    found = slots_of(sample, "doc_id", "y").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    y = found.column("y").to_numpy().astype(float)
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return {"share": share}
    lists = found.column("slots").combine_chunks()
    flat, count = lists.flatten().to_numpy().astype(np.int64), pc.list_value_length(lists).to_numpy().astype(np.int64)
    weight = np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum()) * len(y)
    rank = np.empty(len(y), int)
    for k in (0, 1):
        rank[y == k] = np.arange((y == k).sum())
    aside = rank % 4 == 1
    pick = lambda m: (flat[np.repeat(m, count)], count[m])
    place = telling(*pick(~aside), y[~aside])
    machine = Machine(int(place.max()) + 1)
    machine.fit(*kept(place, *pick(~aside)), y[~aside], weight[~aside])
    curve = logistic(machine.raw(*kept(place, *pick(aside)))[:, None], y[aside], weight[aside], ridge=0.1)
    return {"share": share, "place": place, "bias": machine.bias, "weight": machine.weight, "factor": machine.factor, "curve": curve}


def score_texts(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id`` and ``score`` of every whole text. The model has a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = shared.value
        score = np.full(batch.num_rows, own["share"])
        if "curve" in own:
            machine = Machine.__new__(Machine)
            machine.bias, machine.weight, machine.factor = own["bias"], own["weight"], own["factor"]
            raw = machine.raw(*kept(own["place"], *text_slots(batch.column("text"))))
            score = probability(raw[:, None], own["curve"])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return map_texts(documents(docs), work, "doc_id long, score double", limit=8 << 20)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted``."""
    scored = score_texts(docs, train(docs, labels))
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
