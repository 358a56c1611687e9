"""Decontamination and the whole pipeline."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from compare import compare, duck
from llm_data import SF
from tallyfold.llm import decontamination, near_documents
from test_dedup import plain_components


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_hits(docs, items):
    out = []
    for doc_id, text in docs:
        own, hit, names = plain_words(text), set(), set()
        for name, item in items:
            w = plain_words(item)
            size = min(10, len(w))
            runs = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if size else set()
            for i in range(len(own) - size + 1 if size else 0):
                if tuple(own[i:i + size]) in runs:
                    hit.update(range(i, i + size))
                    names.add("" if name is None else str(name))
        out.append((doc_id, len(own), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_contamination_matches_sql(spark):
    assert compare(entry.queries()["op4_decontamination"](spark, SF), duck(SF), entry.oracle_sql()["op4_decontamination"]) is None


@pytest.mark.parametrize("limit", [100, 1 << 24])
def test_contamination_of_odd_tables(spark, odd_docs, limit):
    """Short items, ties, nulls and repeated items; in one block or in many."""
    items = [(10, "the cat sat on the mat and looked at the dog over there"), (9, "Cat"), (9, "cat"), (2, "le chien"), (None, "la table AVEC le chien"), (5, None), (6, ""), (7, "!!"),
             (11, "rain fell on the old house the cat sat on the mat and"), (100, "中文"), (12, "w1x1 " * 3)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    hits = decontamination.benchmark_hits(odd_docs.select("doc_id", "text"), benchmark, limit=limit)
    n_hit = F.aggregate("spans", F.lit(0), lambda n, x: n + (x["end"] - x["start"]))
    rows = hits.select("doc_id", "n_words", n_hit.alias("h"), F.size("items").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("s")).collect()
    got = sorted(((r.doc_id, r.n_words, r.h, r.n, r.s, r.h > 0) for r in rows), key=repr)
    assert got == plain_hits([(r.doc_id, r.text) for r in odd_docs.collect()], items)


def test_empty_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(odd_docs, none).where("contaminated or n_hit > 0").count() == 0
    assert decontamination.contamination(no_docs, none).count() == 0
    assert decontamination.clean(odd_docs, none).count() == odd_docs.count()


def test_stages_keep_the_columns(spark, odd_docs, tmp_path):
    odd_docs.limit(3).select(F.col("doc_id").alias("item_id"), F.lit("zz zz zz").alias("text")).write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (odd_docs, odd_docs.where("false")):
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
            assert stage(spark, docs, str(tmp_path)).count() <= docs.count()


def test_pipeline_matches_a_plain_version(spark):
    """Language ID keeps all lettered texts here; the other stages by their definitions."""
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    seen, kept = set(), []
    for i, t in docs:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t)
        if key not in seen:
            seen.add(key)
            kept.append((i, t))
    runs = {i: frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if (w := t.lower().split()) else frozenset() for i, t in kept}
    close = {(i, j) for i in runs for j in runs if min(len(runs[i]), len(runs[j])) >= 0.8 * max(len(runs[i]), len(runs[j]))
             and len(runs[i] & runs[j]) >= 0.8 * len(runs[i] | runs[j])}
    label = plain_components([(i, i) for i in runs], lambda a, b: (a, b) in close)
    kept = [(i, t) for i, t in kept if label[i] == i]
    dirty = {r[0] for r in plain_hits(kept, items) if r[5]}
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in kept if i not in dirty}
    got = {r.doc_id: r.decoded_sha256 for r in entry.queries()["pipeline"](spark, SF).collect()}
    assert got == want and len(want) > 50


@pytest.mark.parametrize("settings", [{}, {"block_rows": 4}, {"block_bytes": 2000}])
def test_near_stage_is_five_words_at_four_fifths(spark, settings):
    """Against brute force: pairs far beyond two differing bits, chains, groups split into blocks, short and empty texts."""
    rng = random.Random(5)
    words = lambda n: [f"{rng.choice('abcdefgh')}{rng.randint(0, 99)}" for _ in range(n)]
    base = [words(n) for n in (12, 60, 100, 300, 500)]
    docs = [(None, "a b"), (200, "A  b"), (201, ""), (202, None), (203, "one"), (None, " ".join(base[2])), (None, " ".join(words(40)))]
    for i in range(60):
        own = list(rng.choice(base))
        for at in rng.sample(range(len(own)), rng.choice([0, 1, 2, len(own) // 70, len(own) // 40, len(own) // 25])):
            own[at] = f"edit{rng.randint(0, 9)}"
        docs.append((i, " ".join(own)))
    sets = [frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else frozenset() for _, t in docs]
    order = sorted(range(len(docs)), key=lambda n: (docs[n][0] is None, docs[n][0] or 0))
    label = plain_components([(place, sets[n]) for place, n in enumerate(order)], lambda a, b: len(a & b) >= 0.8 * len(a | b))
    want = sorted((docs[n] for place, n in enumerate(order) if label[place] == place), key=repr)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = near_documents.one_of_each(frame, **settings) if settings else corpus_pipeline.drop_near_copies(spark, frame, SF)
    assert sorted(map(tuple, got.collect()), key=repr) == want and len(want) < 50
