"""Language ID, toxicity and quality: held-out accuracy, what a score may depend on, and odd input."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_data import SF
from tallyfold.llm import language_id, quality, toxicity
from tallyfold.llm.common import held_out

MID = "/root/testdata/sf0.01"
BIG = "/root/testdata/sf0.1"


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    rows = language_id.languages(docs).join(docs, "doc_id").where("held_out").select("lang", "lang_pred", "score").collect()
    assert len(rows) > 200 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def plain_code_length(text, counts, order):
    """Bits of a text by the definition: counts[k][context][byte], escapes by method C."""
    bits, data = 0.0, b"\0" * order + text
    for i in range(order, len(data)):
        for k in range(order, -1, -1):
            seen = counts[k].get(data[i - k:i])
            if not seen:
                continue
            room = sum(seen.values()) + len(seen)
            if data[i] in seen:
                bits -= math.log2(seen[data[i]] / room)
                break
            bits -= math.log2(len(seen) / room)
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact():
    corpora = {"x": [b"abracadabra abra", "déjà vu".encode()], "y": [b"the cat sat on the mat", b"that hat"]}
    order, grams, lang, n, langs = 3, [], [], [], sorted(corpora)
    counts = {}
    for j, name in enumerate(langs):
        context, byte = language_id.windows(corpora[name], order)
        key, m = np.unique(context.astype(np.int64) << 8 | byte, return_counts=True)
        grams.append(key)
        n.append(m)
        lang.append(np.full(len(key), j))
        counts[name] = [{} for _ in range(order + 1)]
        for text in corpora[name]:
            data = b"\0" * order + text
            for i in range(order, len(data)):
                for k in range(order + 1):
                    own = counts[name][k].setdefault(data[i - k:i], {})
                    own[data[i]] = own.get(data[i], 0) + 1
    trees = language_id.ContextTrees(langs, np.concatenate(lang), np.concatenate(grams), np.concatenate(n), order)
    texts = [b"abra cat", b"", "déjà the cadabra zzz \xff".encode("latin-1"), b"q" * 100, b"the mat"]
    got = trees.code_lengths(texts)
    want = [[plain_code_length(t, counts[name], order) for name in langs] for t in texts]
    assert np.allclose(got, want, rtol=1e-4)


def test_odd_documents_have_no_language(spark, odd_docs, no_docs):
    rows = {r.doc_id: r for r in language_id.languages(odd_docs).collect() if r.doc_id is not None}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (3, 4, 5, 10))
    assert rows[12].lang_pred in ("en", "fr") and rows[9].lang_pred in ("en", "fr")
    assert language_id.languages(odd_docs).count() == odd_docs.count()
    assert language_id.languages(no_docs).count() == 0
    nothing = language_id.languages(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in nothing)
    kept = language_id.recognised(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("doc_id in (3, 4, 5, 10)").count() == 0 and kept.where("doc_id = 1").count() == 1


@pytest.fixture(scope="module")
def big(spark):
    return spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")


def area(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())


@pytest.mark.parametrize("scores,label,least", [(toxicity.toxicity_scores, "toxic", 0.97), (quality.quality_scores, "quality", 0.95)])
def test_held_out_area(big, scores, label, least):
    docs, labels = big
    found = scores(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", F.col(label).alias("y")).toPandas()
    assert area(found["score"].to_numpy(), found["y"].to_numpy()) > least
    assert ((found["score"] >= 0.3) == (found["predicted"] == 1)).all() and found["score"].between(0, 1).all()
    assert (found["predicted"] == found["y"]).mean() > 0.9


@pytest.mark.parametrize("scores,label,modulus,remainder", [(toxicity.toxicity_scores, "toxic", 4, 2), (quality.quality_scores, "quality", 5, 0)])
def test_held_out_labels_are_never_used(spark, scores, label, modulus, remainder):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn(label, F.when(held_out(modulus, remainder), 1 - F.col(label)).otherwise(F.col(label)))
    other = docs.withColumns({"lang": F.lit("zz"), "source": F.lit("zz")})
    assert sorted(scores(docs, labels).collect()) == sorted(scores(other, turned).collect())


@pytest.mark.parametrize("scores", [toxicity.toxicity_scores, quality.quality_scores])
def test_odd_documents_and_labels(spark, odd_docs, no_docs, scores):
    rows = [(i, i % 2, i % 2) for i in range(1, 14)] + [(1, None, None), (None, 1, 1), (1, 0, 0), (1, 1, 1), (999, 1, 0), (2, 7, 7)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    found = scores(odd_docs, labels).collect()
    assert len(found) == odd_docs.count() and all(0 <= r.score <= 1 for r in found)
    same = {r.score for r in found if r.doc_id in (1, 2, 13)}
    assert len(same) == 1
    assert scores(no_docs, labels).count() == 0
    assert len({r.score for r in scores(odd_docs, labels.where("false")).collect()}) == 1


def test_pairs_of_terms_are_learned():
    """Two terms that are harmless alone: no sum of weights can tell, the machine can."""
    rng = np.random.default_rng(0)
    y, slots, count = [], [], []
    for _ in range(2000):
        a, b = rng.integers(0, 2, 2)
        own = [0 if a else 1, 2 if b else 3]
        y.append(float(a == b))
        slots += own
        count.append(2)
    machine = toxicity.Machine(4)
    machine.fit(np.array(slots), np.array(count), np.array(y), np.ones(len(y)), epochs=20)
    assert area(machine.raw(np.array(slots), np.array(count)), np.array(y)) > 0.99


def test_slots_are_distinct_terms():
    slots, count = toxicity.text_slots(pa.array(["Cat cat, CAT!", None, "", "été 12"]))
    assert count.tolist() == [len(set(toxicity.word_slots("cat"))), 0, 0, len(set(toxicity.word_slots("été") + toxicity.word_slots("12")))]
