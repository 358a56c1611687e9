"""Quality by compression: which of two dictionaries suits a text better.

A zstandard dictionary is built from labelled good texts and one from bad ones.
A text is compressed with each; the difference of the sizes, divided by the
text's length, becomes a probability by a logistic curve fitted to labelled
texts that the dictionaries have not seen, weighted back to the labels' shares.
The curve also sees how far the text compresses at all, with its length, since
a text that repeats itself is as small under either dictionary.

Training reads a bounded sample (``rows`` documents a label). An empty or null
text has difference 0. With labels of one kind or none, every score is that
label's share, one half without any.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import byte_views, documents, held_out, map_texts
from tallyfold.llm.labelled import training_rows

ROWS = 3000
DICTIONARY_BYTES = 112_640
LEVEL = 3
THRESHOLD = 0.3


def dictionary(texts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of the texts; too few or too small ones are taken as they are."""
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-size:]


def compressor(data: bytes, level: int = LEVEL) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_AUTO)
    if data:
        known.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=known) if data else zstandard.ZstdCompressor(level=level)


def features(texts: list[bytes], good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> np.ndarray:
    """Size with the bad dictionary less that with the good one, a byte of text; how often the text is as long as the smaller; its length (logs)."""
    size = np.array([(len(bad.compress(x)), len(good.compress(x)), len(x)) for x in texts], float).reshape(-1, 3)
    length = np.maximum(size[:, 2], 1)
    gain = np.log(length / size[:, :2].min(axis=1))
    return np.stack([(size[:, 0] - size[:, 1]) / length, gain, np.log(length)], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> list[float]:
    """Intercept and slopes of the weighted logistic curve, by Newton's steps."""
    middle, spread = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    design = np.concatenate([np.ones((len(x), 1)), (x - middle) / spread], axis=1)
    beta = np.zeros(design.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (y - p)) - ridge * beta
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(beta))
        step = np.clip(np.linalg.solve(curve, slope), -2, 2)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    slopes = beta[1:] / spread
    return [float(beta[0] - slopes @ middle), *slopes.tolist()]


def probability(x: np.ndarray, curve: list[float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(curve[0] + x @ np.array(curve[1:]), -30, 30)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = ROWS) -> dict:
    """Dictionaries and curve. Every second text of the sample builds the dictionaries, the others fit the curve."""
    sample, counts = training_rows(docs, labels, label, held_out(5, 0), rows)
    found = sorted((r["doc_id"], r["y"], r["text"].encode()) for r in sample.collect() if r["text"])
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    kinds = {k: [t for _, y, t in found if y == k] for k in (0, 1)}
    if min(len(kinds[0]), len(kinds[1])) < 2:
        return {"share": share}
    good, bad = (dictionary(kinds[k][::2]) for k in (1, 0))
    texts = kinds[1][1::2] + kinds[0][1::2]
    y = np.repeat([1.0, 0.0], [len(kinds[1][1::2]), len(kinds[0][1::2])])
    weight = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    curve = logistic(features(texts, compressor(good), compressor(bad)), y, weight)
    return {"share": share, "good": good, "bad": bad, "curve": curve}


def score_texts(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id``, ``difference`` and ``score`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = shared.value
        texts = byte_views(batch.column("text"))
        if "curve" in own:
            found = features(texts, compressor(own["good"]), compressor(own["bad"]))
            x, score = found[:, 0], probability(found, own["curve"])
        else:
            x, score = np.zeros(len(texts)), np.full(len(texts), own["share"])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x), pa.array(score)], names=["doc_id", "difference", "score"])

    return map_texts(documents(docs), work, "doc_id long, difference double, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted``."""
    scored = score_texts(docs, train(docs, labels))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
