"""The positional index against regular expressions and against the search over texts."""

import random
import re

from pyspark.sql import functions as F

from tallyfold.operators import sections as X
from tallyfold.operators import text_index as TI

PHRASES = ["a", "ab", "a b", "a a", "b a b", "AB  a", "ba", "aba b", "", "  ", "c", "ab\nab"]


def plain_count(phrase, text):
    tokens = [re.escape(x) for x in phrase.split()]
    return len(re.findall("(?i)" + r"\s+".join(tokens), text or "")) if tokens else 0


def random_texts(n=60, seed=3):
    r = random.Random(seed)
    rows = [(f"t{i}", 1, r.choice([" ", "", "\n"]) + "".join(r.choice(["a", "b", "A", "aba", " ", "  ", "\n", " "]) for _ in range(r.randint(0, 40)))) for i in range(n)]
    return [*rows, ("null", 1, None), ("empty", 1, ""), ("long", 1, "a b " * 3000)]


def test_hits_equal_regular_expressions(spark):
    rows = random_texts()
    texts = spark.createDataFrame(rows, "accession_number string, position int, content string")
    index = TI.postings(texts)
    phrases = spark.createDataFrame([(p,) for p in PHRASES + PHRASES[:2]], "phrase string")
    found = {(r.phrase, r.accession_number): r.hits for r in TI.phrase_hits(index, index.select("term").distinct(), phrases).collect()}
    want = {(p, a): plain_count(p, t) for p in PHRASES for a, _, t in rows}
    assert found == {k: v for k, v in want.items() if v}


def test_places_survive_coding(spark):
    texts = spark.createDataFrame([("x", 1, "b a a\tb  a"), ("y", 1, "a")], "accession_number string, position int, content string")
    found = {(r.term, r.accession_number): r.p for r in TI.postings(texts).select("*", TI.places(F.col("gaps")).alias("p")).collect()}
    assert found == {("a", "x"): [1, 2, 4], ("b", "x"): [0, 3], ("a", "y"): [0]}


def test_index_answers_like_search_and_batches_repeat(spark, tmp_path):
    body = "Item 1. Business\nWe make a risk factor.\nItem 7. Discussion\nRisk   factors\nand a riskfactor risk factor."
    filings = spark.createDataFrame([("1", body), ("2", "No heading, risk\nfactor"), ("3", None)], "accession_number string, markdown string")
    index = TI.TextIndex(spark, str(tmp_path / "index"))
    index.add(filings.where("accession_number = '1'"), "b1")
    index.add(filings.where("accession_number <> '1'"), "b2")
    index.add(filings.where("accession_number = '1'"), "b1")  # tried again
    for phrase in ("risk factor", "factor", "Risk"):
        want = X.search(filings, phrase).groupBy("accession_number", "item_code").count().collect()
        found = index.search(spark.createDataFrame([(phrase,)], "phrase string")).collect()
        assert sorted((r[0], r[1] or "", r[2]) for r in want) == sorted((r.accession_number, r.item_code or "", r.hits) for r in found)


def test_a_search_reads_no_texts_and_forms_no_pairs(spark):
    texts = spark.createDataFrame(random_texts(5), "accession_number string, position int, content string")
    index = TI.postings(texts)
    phrases = spark.createDataFrame([("a b",)], "phrase string")
    plan = TI.phrase_hits(index, index.select("term").distinct(), phrases)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_the_index_is_packed_without_a_shuffle_and_tells_places_apart(spark, tmp_path):
    texts = spark.createDataFrame([("x", 1, "7", "b a a\tb  A"), ("y", 1, "7", "a"), ("z", 2, None, None), ("z", 3, "1", "  ")],
                                  "accession_number string, position int, item_code string, content string").coalesce(1)
    packed = TI.segments(texts)
    assert "Exchange" not in packed._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    rows = packed.collect()
    assert {(r.term, tuple(r.numbers), tuple(r.counts), tuple(r.gaps)) for r in rows if r.term is not None} == {
        ("a", (0, 1), (3, 1), (1, 1, 2, 0)), ("b", (0,), (2,), (0, 3))}
    lists = TI.unpacked(packed.where("term is not null"), ["term"]).collect()
    assert {(r.term, r.number, tuple(r.gaps)) for r in lists} == {("a", 0, (1, 1, 2)), ("a", 1, (0,)), ("b", 0, (0, 3))}
    assert [r.accession_numbers for r in rows if r.term is None] == [["x", "y", "z", "z"]]
