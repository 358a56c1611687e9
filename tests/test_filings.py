"""Structured filings, texts, lookup and streaming on small fixtures."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyfold import model as M
from tallyfold.operators import filing_summaries as FS
from tallyfold.operators import filings as FL
from tallyfold.operators import relations as RL
from tallyfold.operators import search as SE
from tallyfold.operators import sections as X
from tallyfold.operators.ordered import previous_row
from tallyfold.sources import readers as RD
from tallyfold.sources.store import Ledger, MetricStore
from tallyfold.streaming import ingest as IN

D = dt.date
TX = ("array<struct<Date: date, Security: string, Shares: double, Remaining: double, Price: double, AcquiredDisposed: string, "
      "DirectIndirect: string, NatureOfOwnership: string, Code: string, TransactionType: string>>")
FORM4 = f"ticker string, accession_number string, filing_date date, insider_name string, position string, primary_activity string, transactions {TX}"


def form4(spark):
    def tx(day, shares, price, side, code):
        return (day, "Common", shares, 1.0, price, side, "D", None, code, "")
    return spark.createDataFrame([
        ("T", "A1", D(2025, 1, 5), "Ann", "CEO", "Sale", [tx(D(2025, 1, 2), 5000.0, 210.0, "D", "S"), tx(D(2025, 1, 3), 1000.0, 205.0, "D", "F")]),
        ("T", "A2", D(2025, 2, 5), "Ann", "CEO", "Sale", [tx(D(2025, 2, 2), 10.0, None, "D", "S"), tx(D(2025, 2, 3), 9.0, 5.0, "A", "P")]),
        ("T", "A3", D(2025, 2, 6), "Bob", "CFO", "Sale", [tx(D(2025, 2, 4), 1.0, 50.0, "D", "W")]),
    ], FORM4)


def test_form4_rows(spark):
    rows = {(r.accession_number, r.transaction_code): r for r in FL.form4_trades(form4(spark), None, None).collect()}
    assert len(rows) == 5
    s, p, w = rows["A1", "S"], rows["A2", "P"], rows["A3", "W"]
    assert (s.value, s.proceeds, s.classification, s.code_description) == (1_050_000, 1_050_000, "Very notable", "Open Market Sale")
    assert (p.value, p.proceeds) == (45.0, None) and w.code_description == "Other (W)"
    assert rows["A1", "F"].is_tax_withholding


def test_trade_filter_lets_missing_values_pass(spark):
    got = {(r.accession_number, r.transaction_code) for r in FL.form4_trades(form4(spark), ["s", "f"], "d", 300_000).collect()}
    assert got == {("A1", "S"), ("A2", "S")}


def test_insider_summary(spark):
    trades = FL.form4_trades(form4(spark), ["S", "F"], "D")
    r = FS.insider_sales(trades).first()
    assert (r.insider_name, r.transaction_count, r.total_proceeds, r.classification) == ("Ann", 3, 1_255_000.0, "Very notable")
    assert r.transaction_codes == ["S", "F"] and r.max_trade_value == 1_050_000
    assert (r.first_tx_date, r.last_tx_date, r.latest_accession_number) == (D(2025, 1, 2), D(2025, 2, 2), "A2")
    assert r.average_price == pytest.approx(1_255_000 / 6010)
    assert FS.insider_sale_accessions(trades).count() == 2
    with pytest.raises(ValueError):
        FS.insider_sales(trades, "ticker")


def events(spark):
    rows = [("T", "E1", "8-K", D(2025, 1, 1), D(2025, 1, 1), "press", True, [("Item 5.02", "Item 5.02 Old officer left. More."), ("Item 9.01", None)]),
            ("T", "E2", "8-K", D(2025, 3, 1), D(2025, 2, 28), "other", None, [("Item 5.02", "New   officer came.")])]
    schema = ("ticker string, accession_number string, form_type string, filing_date date, date_of_report date, content_type string, "
              "has_press_release boolean, items array<struct<item: string, text: string>>")
    return FL.material_events(spark.createDataFrame(rows, schema))


def test_event_summary(spark):
    got = {r.item_code: r for r in FS.material_event_summary(events(spark)).collect()}
    r = got["5.02"]
    assert (r.event_count, r.latest_filing_date, r.has_press_release) == (2, D(2025, 3, 1), True)
    assert r.sample_summaries == ["New officer came.", "Item 5.02 Old officer left. More."] and r.content_types == ["other", "press"]
    assert got["9.01"].sample_summaries == []
    d = {x.item_code: x for x in FS.event_digest(events(spark)).collect()}["5.02"]
    assert d.recent_dates == ["2025-03-01", "2025-01-01"] and (d.first_year, d.title) == (2025, "Item 5.02")


def test_eightk_sections_from_items(spark):
    got = {(r.accession_number, r.item_code): (r.heading, r.title) for r in FL.eightk_sections(events(spark)).collect()}
    title = M.EIGHTK_ITEM_TITLES["5.02"]
    assert got["E1", "5.02"] == (f"Item 5.02. {title}", title)


def test_ownership(spark):
    person = [("", "P", None, None, 1.0, 1.0, 5_000_000.0, 250_000.0, None, None, None, None)]
    ps = ("array<struct<cik: string, name: string, citizenship: string, type_of_reporting_person: string, aggregate_amount: double, percent_of_class: double, "
          "sole_voting_power: double, shared_voting_power: double, sole_dispositive_power: double, shared_dispositive_power: double, "
          "is_aggregate_exclude_shares: boolean, no_cik: boolean>>")
    rows = [("T", f"O{i}", f, D(2025, i, 1), "Acme Inc." if i < 3 else "ACME, INC", "100", None, None, person) for i, f in ((1, "SC 13D"), (2, "SCHEDULE 13G/A"), (3, "10-K"))]
    df = spark.createDataFrame(rows, f"ticker string, accession_number string, form_type string, filing_date date, issuer_name string, total_shares string, "
                               f"total_percent double, is_amendment boolean, reporting_persons {ps}")
    rep = FL.ownership_reports(df)
    assert rep.count() == 2 and FL.ownership_reports(df, "13g").count() == 1
    assert rep.first().reporting_persons[0].total_voting_power == 5_250_000
    s = FS.ownership_summary(rep).first()
    assert (s.latest_accession_number, s.filings_count, FS.ownership_history(rep).count(), FS.ownership_history(rep, newest=1).count()) == ("O2", 2, 2, 1)
    assert s.form_types_present == ["SCHEDULE 13G/A", "SC 13D"]


def test_primary_issuer(spark):
    rows = [("F", "a1", "Acme Inc.", D(2025, 1, 1)), ("F", "a2", "ACME, INC", D(2025, 1, 2)), ("F", "a3", "Beta", D(2025, 1, 3)),
            ("G", "b1", None, D(2025, 1, 1)), ("H", "c1", "X", D(2025, 1, 1)), ("H", "c2", "Y", D(2025, 1, 2))]
    df = spark.createDataFrame(rows, "filer string, accession_number string, issuer_name string, filing_date date")
    assert {r.accession_number for r in FL.primary_issuer_rows(df).collect()} == {"a1", "a2", "b1", "c2"}


def test_proxy_summary(spark):
    rows = [("1", f"P{y}", "DEF 14A", D(y, 4, 1), D(y - 1, 12, 31), "Pat", str(v), [m, "TSR"], None) for y, v, m in ((2023, 100, "Rev"), (2024, 0, "EPS"), (2025, 150, "Rev"))]
    df = spark.createDataFrame(rows, "cik string, accession_number string, form_type string, filing_date date, fiscal_year_end date, peo_name string, "
                               "peo_total_comp string, performance_measures array<string>, has_xbrl boolean")
    s = FS.proxy_summary(FL.proxy_records(df)).first()
    assert (s.latest_accession_number, s.peo_total_comp_change, s.peo_total_comp_change_pct) == ("P2025", 150.0, None)
    assert s.available_performance_measures == ["EPS", "Rev", "TSR"]
    assert [h.peo_total_comp for h in FS.proxy_history(FL.proxy_records(df)).orderBy("filing_date").collect()] == [100.0, 0.0, 150.0]


def test_summaries_count_beyond_any_limit(spark):
    """Thirty reports, proxies, insiders and items of one company: none is cut."""
    days = [D(2020 + i // 12, i % 12 + 1, 1) for i in range(30)]
    own = spark.createDataFrame([("T", f"O{i:02}", "SC 13D" if i else "SC 13G", d, ["P"]) for i, d in enumerate(days)],
                                "ticker string, accession_number string, form_type string, filing_date date, reporting_person_names array<string>")
    s = FS.ownership_summary(own).first()
    assert (s.filings_count, s.form_types_present, s.latest_accession_number) == (30, ["SC 13D", "SC 13G"], "O29")
    proxy = spark.createDataFrame([("1", f"P{i:02}", d, D(2050 - i, 1, 1), float(i), [f"m{i:02}"]) for i, d in enumerate(days)],
                                  "cik string, accession_number string, filing_date date, fiscal_year_end date, peo_total_comp double, performance_measures array<string>")
    p = FS.proxy_summary(proxy).first()
    assert (p.filings_count, len(p.available_performance_measures), p.latest_accession_number, p.peo_total_comp_change) == (30, 30, "P00", -1.0)
    rows = [("T", f"E{i}", "8-K", d, d, "press", True, [(f"Item {i + 1}.01", f"text {i}")]) for i, d in enumerate(days)]
    schema = ("ticker string, accession_number string, form_type string, filing_date date, date_of_report date, content_type string, "
              "has_press_release boolean, items array<struct<item: string, text: string>>")
    found = FL.material_events(spark.createDataFrame(rows, schema))
    assert FS.material_event_summary(found).count() == 30 and FS.material_event_summary(found, limit=4).count() == 4


def test_ranking_of_all_rows(spark):
    from tallyfold.operators.series import ranked

    rows = spark.range(500).select(F.col("id"), (F.col("id") % 7).alias("v")).repartition(5)
    got = [(r.id, r["rank"]) for r in ranked(rows, F.col("v").desc(), F.col("id")).collect()]
    want = sorted(range(500), key=lambda i: (-(i % 7), i))
    assert sorted(got) == sorted((x, i + 1) for i, x in enumerate(want))


def holdings(spark):
    rows = [("H1", "13F-HR", D(2025, 5, 1), D(2025, 3, 31), "M", "9", 300e6, 3, n, "COM", cu, None, str(v), 1.0, "SH", None, None, None, None)
            for n, cu, v in (("A", "c1", 120e6), ("B", "c2", 80e6), ("C", "c3", 60e6))]
    return spark.createDataFrame(rows, "accession_number string, form_type string, filing_date date, report_period date, manager_name string, manager_cik string, "
                                 "total_value double, total_holdings int, Issuer string, Class string, Cusip string, Ticker string, Value string, SharesPrnAmount double, "
                                 "Type string, PutCall string, SoleVoting string, SharedVoting string, NonVoting string")


def test_13f(spark):
    rows = FL.holdings_rows(holdings(spark), 70e6).orderBy(F.desc("value")).collect()
    assert [r.portfolio_weight_pct for r in rows] == [pytest.approx(40.0), pytest.approx(80 / 3)]
    s = FS.holdings_concentration(FL.holdings_rows(holdings(spark), limit=None), 2).first()
    assert (s.top_5_concentration_pct, s.distinct_securities, [x.cusip for x in s.top_holdings]) == (86.666667, 3, ["c1", "c2"])


def test_prior_comparable_filing(spark):
    rows = [("1", "a1", "10-K", D(2023, 2, 1)), ("1", "a2", "10-K/A", D(2023, 5, 1)), ("1", "a3", "10-Q", D(2024, 1, 1)), ("1", "a4", "10-K", D(2026, 2, 1))]
    df = spark.createDataFrame(rows, "cik string, accession_number string, form_type string, filing_date date")
    got = {r.accession_number: r.prior and r.prior.accession_number for r in FL.prior_comparable(df).collect()}
    assert got == {"a1": None, "a2": "a1", "a3": None, "a4": "a2"}


def test_previous_row_over_buckets_equals_a_plain_lag(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(5)}", D(2000, 1, 1) + dt.timedelta(rnd.randrange(4000)), f"{i:04d}") for i in range(400)]
    df = spark.createDataFrame(rows, "k string, day date, id string")
    got = {r.id: r.prev and r.prev.id for r in previous_row(df, ["k"], ["day", "id"], ["id"], F.year("day"), "prev").collect()}
    want = {}
    for key in {r[0] for r in rows}:
        mine = sorted((r[1], r[2]) for r in rows if r[0] == key)
        want |= {cur[1]: (before[1] if before else None) for before, cur in zip([None, *mine], mine)}
    assert got == want


def test_provenance(spark):
    df = spark.createDataFrame([("A", "2025-01-02", None), ("B", "2025-03-04 10:00", "x"), ("B", "bad", None)], "accession string, filing_date string, note string")
    p = FS.provenance(df, "2025-03-14").first()
    assert (p.row_count, p.null_value_count, p.latest_filing_date, p.staleness_days) == (3, 2, D(2025, 3, 4), 10)
    assert p.accession_numbers == ["B", "A"] and p.sources == []


# ------------------------------------------------------------ text

TEXT = """# ACME CORPORATION

Item 1. Business
Item 1A. Risk Factors
Item 1B. Unresolved Staff Comments

## Item 1. Business
Actual business discussion.

## Item 1A. Risk Factors
Actual risk discussion that should be surfaced.
More risk detail.

## Item 1B. Unresolved Staff Comments
None.
"""


def texts(spark, *pairs):
    return spark.createDataFrame(list(pairs), "accession_number string, markdown string")


def test_sections_take_the_last_heading(spark):
    got = {r.item_code: r for r in X.sections(texts(spark, ("a", TEXT))).collect()}
    assert list(got) == ["1", "1A", "1B"]
    assert (got["1A"].line_number, got["1A"].heading, got["1A"].title) == (10, "Item 1A. Risk Factors", "Risk Factors")
    assert got["1A"].body == "Actual risk discussion that should be surfaced.\nMore risk detail."
    for s in got.values():
        assert TEXT[s.start:].startswith(s.content) and s.text_length == len(s.content)
    assert got["1A"].match_keys == ["1a", "item1a", "item1ariskfactors", "riskfactors"]


def test_heading_white_space_may_span_lines(spark):
    got = X.sections(texts(spark, ("a", "Item 1.\nSwallowed line\nItem 2 describes the plan\ntext\n"))).collect()
    assert [(s.heading, s.title, s.body) for s in got] == [
        ("Item 1. Swallowed line", "Swallowed line", ""), ("Item 2 describes the plan", "describes the plan", "text")]


def test_section_selectors(spark):
    t = texts(spark, ("a", TEXT + "\nItem 7. Management's Discussion and Analysis 31\nGood year.\n"))
    for name in ("1a", "Item 1A", "risk factors", "Item 1A. Risk Factors"):
        assert X.extract_section(t, name).first().item_code == "1A"
    assert X.extract_section(t, "MD&A").first().title == "Management's Discussion and Analysis"
    assert X.extract_section(t, "9Z").count() == 0


def test_search(spark):
    t = texts(spark, ("a", TEXT), ("b", "no headings\nbut RISK\n factors here"))
    hit = {r.accession_number: r for r in X.search(t, "risk factors", max_matches=1).collect()}
    assert (hit["a"].item_code, hit["a"].line_number) == ("1A", 10)
    assert hit["a"].excerpt.startswith("## Item 1A. Risk Factors Actual risk")
    assert (hit["b"].item_code, hit["b"].line_number, hit["b"].matched_text) == (None, 2, "RISK factors")
    assert X.search(t, "Actual", section_name="1A").count() == 1 and X.search(t, "Actual").count() == 2
    assert X.search(t, "risk", context_chars=3).where("accession_number = 'b'").first().excerpt == "...ut RISK f..."


def test_compare_sections(spark):
    head = "## Item 1A. Risk Factors\n\nShared baseline risk paragraph.\n\n"
    t = texts(spark, ("n", head + "Supply chain concentration."), ("o", head + "Demand concentration."))
    pairs = spark.createDataFrame([("n", "o")], "accession_number string, previous_accession string")
    r = X.compare_sections(pairs, t, "risk factors").first()
    assert (r.current_only_count, r.previous_only_count, r.similarity_ratio) == (1, 1, 0.666667)
    assert r.current_only_excerpts == ["Supply chain concentration."] and r.previous_only_excerpts == ["Demand concentration."]


def test_highlights(spark):
    risk = ("Item 1A. Risk Factors\nRisks Related to Our Supply:\nSentence one. Sentence two.\n- bullet x\n"
            "## Risks related to Demand\n- first bullet\n- second bullet\nItem 1B. none\n- late")
    story = ("## Overview\nWe did well. Really.\nRESULTS OF OPERATIONS\n- up 5%\n- up 6%\nLiquidity And Capital:\nCash is fine! Yes.\n"
             "this is a plain sentence with nothing.")
    r = spark.createDataFrame([(risk, story)], "r string, s string").select(
        X.risk_themes(F.col("r")).alias("a"), X.risk_highlights(F.col("r")).alias("b"), X.narrative_highlights(F.col("s")).alias("c")).first()
    assert r.a == ["Risks Related to Our Supply", "Risks related to Demand"]
    assert r.b == ["Risks Related to Our Supply: Sentence one.", "Risks related to Demand: first bullet"]
    assert r.c == ["Overview: We did well.", "RESULTS OF OPERATIONS: up 5%", "Liquidity And Capital: Cash is fine!"]
    pick = spark.range(1).select(X.pick_highlights(F.lit(["a: 1", "a: 2", "b: 3"])).alias("x"), X.pick_highlights(F.lit(["a: 1", "a: 2"])).alias("y")).first()
    assert pick.x == ["a: 1", "b: 3"] and pick.y == ["a: 1", "a: 2"]


def test_excerpts_and_truncation(spark):
    t = texts(spark, ("a", TEXT + "x " * 400), ("b", "y " * 900 + "the Risk Factors" + " z" * 5))
    got = {r.accession_number: r for r in t.select("*", X.risk_excerpt(F.col("markdown")).alias("e")).collect()}
    assert got["a"].e.startswith("## Item 1A. Risk Factors") and got["a"].e.endswith("More risk detail.")
    assert got["b"].e == ("y " * 900 + "the Risk Factors" + " z" * 5)[1804 - 800:]
    cut = {r.accession_number: r.truncated for r in X.truncated_text(t, 600, 100).collect()}
    assert cut["a"].startswith("# ACME CORPORATION") and X.SKIPS[0][1] in cut["a"] and cut["a"].endswith(X.NOTICE)
    assert len(cut["b"]) <= 600 and cut["b"].endswith(X.NOTICE)


# ------------------------------------------------------------ lookup, relations


def test_search_companies(spark):
    m = spark.createDataFrame([("AAPL",), ("AA",), ("AAPL",), ("B",)], "ticker string")
    assert [r.ticker for r in SE.search_companies(m, " aa ").collect()] == ["AA", "AAPL"]
    assert [r.ticker for r in SE.search_companies(m, "_A").collect()] == ["AA", "AAPL"]
    assert SE.search_companies(m, "").count() == 0


def test_close_matches_equal_brute_force(spark):
    rnd = random.Random(3)
    names = sorted({"".join(rnd.choice("ABCDEQ-1") for _ in range(rnd.randrange(1, 7))) for _ in range(150)})
    words = sorted({"".join(rnd.choice("ABCDEQ-1") for _ in range(rnd.randrange(1, 7))) for _ in range(30)})
    got = {}
    rows = SE.close_matches(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(n,) for n in names], "ticker string"))
    for r in sorted(rows.collect(), key=lambda r: (r.word, r["rank"])):
        got.setdefault(r.word, []).append(r.ticker)
    want = {}
    for w in set(words) - {""}:
        near = [(1 - edits(w, n) / max(len(w), len(n)), n) for n in set(names) if n]
        best = [n for x, n in sorted(near, reverse=True) if x >= 0.6 - 1e-9][:5]
        if best:
            want[w] = best
    assert got == want


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_prefix_search_takes_a_backslash(spark):
    m = spark.createDataFrame([("A\\B",), ("AXB",), ("A1",)], "ticker string")
    assert [r.ticker for r in SE.search_companies(m, "a\\b").collect()] == ["A\\B"]
    assert [r.ticker for r in SE.search_companies(m, "a\\%").collect()] == ["A\\B"] and SE.search_companies(m, "a_b").count() == 2


def test_missing_keys_do_not_meet(spark):
    """Nine of ten mentions lack a key: their rows spread over the partitions of each join."""
    from pyspark.sql import functions as F

    rows = spark.range(4000).select(
        F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).alias("cik"), F.lit(None).cast("string").alias("symbol"), F.concat(F.lit("n"), "id").alias("name"))
    companies = spark.createDataFrame([("10", "TEN", "x"), ("7", "SEV", "n 21")], "cik string, ticker string, name string")
    got = {(r.name, r.resolved, r.resolved_by) for r in SE.resolve_entities(rows, companies).where("resolved is not null").collect()}
    assert got == {("n10", "TEN", "cik"), ("n21", "SEV", "name")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        sizes = [r["count"] for r in SE.resolve_entities(rows, companies).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", True)
    assert len(sizes) == 4 and max(sizes) < 1.3 * 1000


def test_texts_with_control_characters(spark):
    text = "## Item 1. Business\n\nalpha \u0001 needle \u0002 gamma\n\n## Item 2. Properties\n\n\u0001x needle"
    df = spark.createDataFrame([("a", text)], "accession_number string, markdown string")
    got = {r.item_code: r for r in X.sections(df).collect()}
    assert set(got) == {"1", "2"} and got["1"].body == "alpha \u0001 needle \u0002 gamma" and got["2"].line_number == 5
    hits = X.search(df, "needle").collect()
    assert [(h.matched_text, h.item_code) for h in sorted(hits, key=lambda h: h.match_number)] == [("needle", "1"), ("needle", "2")]
    assert X.search(df, "gamma").first().matched_text == "gamma"


def test_compare_sections_as_multisets(spark):
    body = "## Item 7. Discussion\n\n{}\n\n## Item 8. End\n\nx"
    df = spark.createDataFrame([("n", body.format("one\n\ntwo\n\ntwo\n\nnew")), ("o", body.format("two\n\none\n\ngone"))], "accession_number string, markdown string")
    pairs = spark.createDataFrame([("n", "o")], "accession_number string, previous_accession string")
    r = X.compare_sections(pairs, df, "7").first()
    assert r.current_only_excerpts == ["two", "new"] and r.previous_only_excerpts == ["gone"]
    assert (r.current_only_count, r.previous_only_count) == (2, 1) and r.similarity_ratio == pytest.approx(1 - 3 / 9, abs=1e-6)


def test_first_item_row_counts(spark):
    rows = [("T", "E1", "8-K", D(2025, 1, 1), D(2025, 1, 1), "press", True, [("Item 5.02 Zeta", "first"), ("Item 5.02 Alpha", "second")])]
    schema = ("ticker string, accession_number string, form_type string, filing_date date, date_of_report date, content_type string, "
              "has_press_release boolean, items array<struct<item: string, text: string>>")
    assert FL.eightk_sections(FL.material_events(spark.createDataFrame(rows, schema))).first().preview == "first"


def test_share_classes_and_scope(spark, monkeypatch):
    rows = spark.createDataFrame([("0000000001", "x"), ("2", "y")], "cik string, v string")
    ref = spark.createDataFrame([(1, "AAA", 2), (1, "BBB", 1), (3, "CCC", 3)], "cik long, ticker string, position int")
    assert {(r.ticker, r.v) for r in RD.with_ticker(rows, ref).collect()} == {("AAA", "x"), ("BBB", "x")}
    assert [r.ticker for r in RD.with_ticker(rows, ref, one=True).collect()] == ["AAA"]
    assert [r.ticker for r in RD.with_ticker(rows, ref.drop("position"), one=True).collect()] == ["BBB"]
    assert IN.ticker_scope(None) == IN.ticker_scope("  ") == IN.DEFAULT_SCOPE and IN.ticker_scope(" all") is None
    assert IN.ticker_scope("b, a,,") == ["A", "B"]


def test_resolve_tickers(spark):
    known = spark.createDataFrame([("AAPL",), ("BRK-B",), ("MSFT",), ("MSTR",), ("NVDA",)], "ticker string")
    req = spark.createDataFrame([("aapl ",), ("brk.b",), ("NV",), ("MS",), ("NVDIA",), ("//",)], "requested string")
    got = {r.requested: (r.resolved, r.exact, r.candidates) for r in SE.resolve_tickers(req, known).collect()}
    assert got["aapl"] == ("AAPL", True, ["AAPL"]) and got["brk.b"] == ("BRK-B", True, ["BRK-B"])
    assert got["NV"] == ("NVDA", False, ["NVDA"]) and got["MS"] == ("MS", False, ["MSFT", "MSTR"])
    assert got["NVDIA"] == ("NVDIA", False, ["NVDA"]) and got["//"] == ("//", False, [])


def test_ripple_combines_paths(spark):
    e = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.8), ("b", "d", 0.9), ("c", "d", 1.0), ("a", "z", 0.1)], "src string, dst string, confidence double")
    got = {(r.node, r.hops): (round(r.confidence, 4), r.paths) for r in RL.ripple(e, spark.createDataFrame([("a",)], "node string"), 2, 0.5).collect()}
    assert got == {("b", 1): (0.81, 1), ("c", 1): (0.72, 1), ("d", 2): (0.6561, 2)}


# ------------------------------------------------------------ sources and streams


def test_companyfacts_reader(spark, tmp_path):
    (tmp_path / "1.json").write_text(
        '{"cik": 1, "entityName": "A", "facts": {"us-gaap": {"Revenues": {"label": "r", "units": {"USD": ['
        '{"start": "2023-01-01", "end": "2023-12-31", "val": 10, "accn": "x", "fy": 2023, "fp": "FY", "form": "10-K", "filed": "2024-02-01"}]}}}}}')
    (tmp_path / "2.json").write_text('{"cik": 2, "facts": {broken')
    ref = spark.createDataFrame([(1, "AAA")], "cik long, ticker string")
    r = RD.companyfacts(spark, str(tmp_path), ref).collect()
    assert len(r) == 1 and (r[0].ticker, r[0].concept, r[0].numeric_value, r[0].period_end) == ("AAA", "us-gaap:Revenues", 10.0, D(2023, 12, 31))


def test_vendor_and_bulk_readers(spark, tmp_path):
    from tallyfold.operators import reconcile as RC

    (tmp_path / "v.json").write_text('[{"symbol": "T", "date": "2024-12-31", "period": "FY", "revenue": 5, "epsdiluted": 1.5, "capitalExpenditure": -3, "other": "x"}]')
    got = {r.metric_type: r.value for r in RC.vendor_points(RD.vendor_statements(spark, str(tmp_path / "v.json")), "annual").collect()}
    assert got == {"revenue": 5.0, "eps_diluted": 1.5, "capex": 3.0}
    (tmp_path / "num.txt").write_text("adsh\ttag\tversion\tcoreg\tddate\tqtrs\tuom\tvalue\tfootnote\na\tAssets\tv\t\t20241231\t0\tUSD\t12.5\t\na\tAssets\tv\t\t20241399\t0\tUSD\t1\t\na\tAssets\tv\t\t20241231\tx\tUSD\t1\t\n")
    assert [r.value for r in RD.dera_num(spark, str(tmp_path / "num.txt")).collect()] == [12.5]


def fact(acc, form, filed, cik, value, end=D(2024, 3, 31)):
    return (acc, form, filed, cik, "us-gaap:Assets", value, "USD", False, "Q1", 2024, None, end)


def test_stream_ingest_is_exactly_once_and_equals_batch(spark, tmp_path):
    landing = str(tmp_path / "landing")
    ref = spark.createDataFrame([(1, "AAA")], "cik long, ticker string")

    def land(*rows):
        spark.createDataFrame(list(rows), M.FILING_FACTS_SCHEMA).coalesce(1).write.mode("append").parquet(landing)

    job = IN.FilingIngest(MetricStore(spark, str(tmp_path / "s")), Ledger(spark, str(tmp_path / "l")), ref)

    def run():
        job.start(IN.filing_fact_stream(spark, landing, 1), str(tmp_path / "ck")).awaitTermination()

    land(fact("a1", "10-Q", "2024-05-01", "0000000001", 10.0), fact("x1", "10-Q", "2024-05-01", "77", 1.0), fact("p1", "8-K", "2024-05-01", "1", 2.0))
    run()
    assert [(r.ticker, r.value) for r in job.store.read().collect()] == [("AAA", 10.0)]
    assert {r.accession_number for r in job.ledger.read().collect()} == {"a1"}
    land(fact("a1", "10-Q", "2024-05-01", "1", 99.0), fact("a2", "10-Q/A", "2024-08-01", "1", 11.0))
    run()
    assert [(r.value, r.accession) for r in job.store.read().collect()] == [(11.0, "a2")]
    batch = IN.FilingIngest(MetricStore(spark, str(tmp_path / "s2")), Ledger(spark, str(tmp_path / "l2")), ref)
    facts = RD.filing_facts(spark, landing).where("numeric_value <> 99")
    assert batch.run_batch(facts, "b1") == 1 and batch.run_batch(facts, "b1") == 1
    assert batch.run_batch(facts, "b2") == 0
    assert batch.store.read().drop("ingested_at").collect() == job.store.read().drop("ingested_at").collect()


def test_compaction_keeps_the_newest_entries(spark, tmp_path):
    from tallyfold.sources.store import CompanyState

    book, state = Ledger(spark, str(tmp_path / "l")), CompanyState(spark, str(tmp_path / "c"))
    rows = spark.createDataFrame([("a", "T", "10-K", "2024-01-01"), ("b", "T", "10-Q", "2024-02-01")], "accession_number string, ticker string, form_type string, filed_date string")
    for n in range(3):
        book.mark(rows)
        state.update(spark.createDataFrame([("T", "1"), ("U", "2")], "ticker string, cik string"), f"x{n}")
    state.delete(["U"])
    assert book.compact_to(str(tmp_path / "l2")).log.read().count() == 2 and book.count() == 2
    small = state.compact_to(str(tmp_path / "c2"))
    assert small.log.read().count() == 1 and [(r.ticker, r.extraction_type) for r in small.read().collect()] == [("T", "x2")]


def test_streams_with_two_checkpoints_keep_all(spark, tmp_path):
    """Epochs of a new checkpoint start at 0 again; nothing stored before is touched."""
    ref = spark.createDataFrame([(1, "AAA")], "cik long, ticker string")
    job = IN.FilingIngest(MetricStore(spark, str(tmp_path / "s")), Ledger(spark, str(tmp_path / "l")), ref)
    for n, (acc, end) in enumerate((("a1", D(2020, 3, 31)), ("a2", D(2021, 3, 31)))):
        folder = str(tmp_path / f"landing{n}")
        spark.createDataFrame([fact(acc, "10-Q", "2024-05-01", "1", 10.0 + n, end)], M.FILING_FACTS_SCHEMA).write.parquet(folder)
        job.start(IN.filing_fact_stream(spark, folder), str(tmp_path / f"ck{n}")).awaitTermination()
    assert sorted(r.accession for r in job.store.read().collect()) == ["a1", "a2"] and job.ledger.count() == 2


def test_stream_unique_filings(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), ("a", dt.datetime(2024, 1, 2)), ("b", dt.datetime(2024, 1, 3))],
                          "accession_number string, filed_at timestamp").write.parquet(src)
    stream = spark.readStream.schema("accession_number string, filed_at timestamp").parquet(src)
    IN.drain_to_parquet(IN.unique_filings(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r.accession_number for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_ingest_moves_facts_by_filing_and_rows_by_period(spark, tmp_path):
    from test_facts import D, REV, filing
    from tallyfold.operators.facts import extract_filings

    path = str(tmp_path / "facts")
    rows = [(REV, 10.0, "Q1", D(2024, 1, 1), D(2024, 3, 31), False, "A1"), (REV, 20.0, "Q1", D(2024, 1, 1), D(2024, 3, 31), False, "A2")]
    filing(spark, rows).write.parquet(path)
    facts = spark.read.parquet(path)
    fresh = spark.createDataFrame([("A2", "2024-05-01")], "accession string, filing_date string")
    out = IN.newest_filing_rows(extract_filings(facts, fresh), fresh)
    assert [(r.accession, r.value) for r in out.collect()] == [("A2", 20.0)]
    plan = extract_filings(facts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_batch_keeps_a_row_per_filing_not_its_facts(spark, tmp_path, monkeypatch):
    from test_facts import D, REV, filing

    facts = filing(spark, [(REV, float(i), "Q1", D(2024, 1, 1), D(2024, 3, 31), False) for i in range(9)]).drop("ticker")
    ref = spark.createDataFrame([("1", "T")], "cik string, ticker string")
    job = IN.FilingIngest(MetricStore(spark, str(tmp_path / "s")), Ledger(spark, str(tmp_path / "l")), ref)
    kept, persist = [], type(facts).persist

    def counted(self, *a):
        kept.append(self.count())
        return persist(self, *a)

    monkeypatch.setattr(type(facts), "persist", counted)
    assert job.run_batch(facts) == 1 and job.run_batch(facts) == 0
    assert kept == [1, 0]
