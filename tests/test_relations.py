"""Ordered block changes, close names and interlocks against plain versions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import changes as CH
from tallyfold.operators import relations as RL
from tallyfold.operators import search as SE


def longest(values):
    best = [1] * len(values)
    for i, x in enumerate(values):
        best[i] = 1 + max((best[j] for j in range(i) if values[j] < x), default=0)
    return max(best, default=0)


def test_rising_run_is_longest(spark):
    rng = random.Random(4)
    rows = [(i, rng.sample(range(30), rng.randint(0, 18))) for i in range(120)]
    got = spark.createDataFrame(rows, "id int, v array<int>").select("id", CH.rising_run(F.col("v")).alias("r")).collect()
    for r in got:
        own = dict(rows)[r.id]
        assert len(r.r) == longest(own) and all(a < b for a, b in zip(r.r, r.r[1:]))
        at = [own.index(x) for x in r.r]
        assert at == sorted(at)


def test_block_changes_tell_moved_from_equal(spark):
    rng = random.Random(8)
    texts = {}
    for i in range(30):
        own = [rng.choice("ABCDEFGHIJ") * 2 for _ in range(rng.randint(0, 9))]
        texts[f"a{i}"] = own
    texts["p"], texts["q"] = ["one", "two", "three", "four"], ["two", "three", "one", "four"]
    filings = spark.createDataFrame([(k, "Item 7. Overview\n\n" + "\n\n".join(v)) for k, v in texts.items()] + [("none", "nothing here"), ("null", None)], "accession_number string, markdown string")
    pairs = [("q", "p"), ("p", "p"), ("a1", "none"), ("null", "a1"), ("a1", "missing"), *[(f"a{i}", f"a{i + 1}") for i in range(29)]]
    got = CH.block_changes(spark.createDataFrame(pairs, "accession_number string, previous_accession string"), filings, "7").collect()
    by = {}
    for r in got:
        by.setdefault((r.accession_number, r.previous_accession), []).append(r)
    assert set(by) == set(pairs[:2] + pairs[5:])
    moved = {(r.block, r.previous_position, r.current_position) for r in by["q", "p"] if r.change == "moved"}
    assert moved == {("one", 2, 4)}
    assert all(r.change == "equal" for r in by["p", "p"])
    for (new, old), rows in by.items():
        a, b = (["Item 7. Overview", *texts[x]] for x in (new, old))
        assert sorted(r.current_position for r in rows if r.current_position) == list(range(1, len(a) + 1))
        assert sorted(r.previous_position for r in rows if r.previous_position) == list(range(1, len(b) + 1))
        assert all((r.current_position is None or a[r.current_position - 1] == r.block) and (r.previous_position is None or b[r.previous_position - 1] == r.block) for r in rows)
        paired = sorted((r.previous_position, r.current_position, r.change) for r in rows if r.change in ("equal", "moved"))
        assert len(paired) == sum(min(a.count(x), b.count(x)) for x in set(a))
        equal = [j for _, j, k in paired if k == "equal"]
        assert equal == sorted(equal) and len(equal) == longest([j for _, j, _ in paired])


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("cutoff, q", [(0.8, 2), (0.7, 3), (0.6, 2), (0.9, 3)])
def test_close_names_match_brute_force(spark, cutoff, q):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcab ") for _ in range(rng.randint(1, 16))) for _ in range(40)]
    names = base + ["a", "ab", "aaaa", "aaaaaaaaaa", ""]
    words = [None, "", "aaaaaaaa", "b"]
    for x in base:
        own = list(x)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own)):][:1] = rng.choice(["", "z", "ab"])
            own.insert(rng.randrange(len(own) + 1), rng.choice("abz"))
        words.append("".join(own))
    left, right = ([(x,) for x in y] for y in (words, names))
    got = SE.close_names(spark.createDataFrame(left, "word string"), spark.createDataFrame(right, "name string"), cutoff, q)
    want = {(a, b, edits(a, b)) for a, b in itertools.product(set(words) - {None, ""}, set(names) - {""}) if edits(a, b) <= int(max(len(a), len(b)) * (1 - cutoff) + 1e-9)}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 10


def test_only_open_mentions_go_to_the_fuzzy_step(spark):
    companies = spark.createDataFrame([("1", "AAA", "Alpha Industries"), ("2", "BBB", "Beta Holdings"), ("3", "CCC", "Beta Holding")], "cik string, ticker string, name string")
    mentions = spark.createDataFrame([("1", None, "Beta Holdingz"), (None, "bbb", "Alpha Industrie"), (None, None, "alpha industries!"), (None, None, "Alfa Industries"),
                                      (None, None, "Beta Holdinx"), (None, None, None), (None, None, "something else")], "cik string, symbol string, name string")
    got = {r.name: (r.resolved, r.resolved_by) for r in SE.resolve_entities(mentions, companies, cutoff=0.8).collect()}
    assert got == {"Beta Holdingz": ("AAA", "cik"), "Alpha Industrie": ("BBB", "ticker"), "alpha industries!": ("AAA", "name"), "Alfa Industries": ("AAA", "fuzzy"),
                   "Beta Holdinx": ("CCC", "fuzzy"), None: (None, "none"), "something else": (None, "none")}
    plain = SE.resolve_entities(mentions, companies).collect()
    assert sorted(r.resolved_by for r in plain) == ["cik", "name", "none", "none", "none", "none", "ticker"]


def test_interlocks_lose_no_link(spark):
    rng = random.Random(1)
    rows = [(f"S{rng.randint(0, 40)}", f"P{int(rng.paretovariate(0.7)) % 60}", rng.choice(["Chairman of the board", "Director"]), rng.choice([[], ["Audit"], ["Pay", "Audit"]])) for _ in range(700)]
    seats = spark.createDataFrame(rows, "ticker string, person string, role string, committees array<string>")
    pairs, classes = RL.interlocks(seats, heavy=5)
    held = {}
    for t, p, *_ in rows:
        held.setdefault(p, set()).add(t)
    want = {(a, b, p) for p, own in held.items() for a in own for b in own if a < b}
    light = pairs.collect()
    crowds = {}
    for r in classes.collect():
        crowds.setdefault(r.person, set()).add(r.ticker)
        assert r.companies == len(held[r.person]) > 5
    rebuilt = {(a, b, p) for p, own in crowds.items() for a in own for b in own if a < b}
    assert {(r.company_a, r.company_b, r.person) for r in light} | rebuilt == want and len(light) + len(rebuilt) == len(want) and light and rebuilt
    asked = sorted({(a, b) for a, b, _ in rebuilt})[:20]
    again = RL.same_class(classes, spark.createDataFrame(asked, "company_a string, company_b string")).collect()
    assert {(r.company_a, r.company_b, r.person) for r in again} == {x for x in rebuilt if x[:2] in set(asked)}
    whole = {(r.company_a, r.company_b, r.person): r.significance for r in RL.interlocks(seats, heavy=100)[0].collect()}
    assert all(whole[r.company_a, r.company_b, r.person] == r.significance for r in [*light, *again])


def test_block_changes_parse_each_text_once(spark):
    """Later steps read stored blocks: the plan holds no regular expression of headings any more."""
    filings = spark.createDataFrame([(str(i), f"Item 7. Discussion\na\nb {i}") for i in range(4)], "accession_number string, markdown string")
    pairs = spark.createDataFrame([("1", "0")], "accession_number string, previous_accession string")
    out = CH.block_changes(pairs, filings, "7", separator=CH.LINES)
    assert "regexp" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.change, r.block) for r in out.collect()} == {("equal", "a"), ("equal", "Item 7. Discussion"), ("added", "b 1"), ("removed", "b 0")}


def test_close_names_proposes_few_pairs_where_all_share_common_runs(spark):
    """Texts of the same few runs of two characters: pieces tell them apart, rare runs did not."""
    rng = random.Random(4)
    names = sorted({"".join(rng.choice("abcd") for _ in range(24)) for _ in range(200)})
    left, right = (spark.createDataFrame([(x,) for x in names], f"{k} string") for k in ("word", "name"))
    a, b = SE._pieces(left, "word", 0.8, "__a", "__b", False), SE._pieces(right, "name", 0.8, "__b", "__a", True)
    assert a.join(b, ["__a", "__b", "__key"]).select("word", "name").distinct().count() < len(names) ** 2 / 4
    assert {(r.word, r.edits) for r in SE.close_names(left, right).collect()} >= {(x, 0) for x in names}
