"""Series, TTM, ratio and store rules on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyfold import model as M
from tallyfold.functions import columns as K
from tallyfold.functions import ratios as R
from tallyfold.functions.derived import with_derived
from tallyfold.operators import quality as Q
from tallyfold.operators import ratio_ops as RO
from tallyfold.operators import reconcile as RC
from tallyfold.operators import series as S
from tallyfold.operators import ttm as T
from tallyfold.plans import jobs
from tallyfold.sources.store import CompanyState, Ledger, MetricStore

D = dt.date
ENDS25 = [D(2025, 3, 31), D(2025, 6, 30), D(2025, 9, 30), D(2025, 12, 31)]


def metrics(spark, rows):
    """(ticker, metric, value, period_type, period_end)"""
    full = []
    for t, m, v, p, e in rows:
        lead = "Twelve Months" if p == "annual" else "Quarter"
        full.append((t, m, v, p, e, f"{lead} Ended {e:%m/%d/%Y}"))
    return spark.createDataFrame(full, "ticker string, metric_type string, value double, period_type string, period_end date, period string")


def quarters(metric, ends, vals, ticker="T"):
    return [(ticker, metric, float(v), "quarterly", e) for e, v in zip(ends, vals)]


def test_ttm_sums_four_and_drops_stale_series(spark):
    old = [D(2020, e.month, e.day) for e in ENDS25]
    m = metrics(spark, quarters("revenue", ENDS25, (100, 110, 120, 130)) + quarters("gross_profit", old, (1, 2, 3, 4)))
    r = T.ttm_wide(m).first()
    assert r.revenue == 460 and r.gross_profit is None


def test_ttm_needs_four_quarters(spark):
    assert T.ttm_wide(metrics(spark, quarters("revenue", ENDS25[:3], (1, 2, 3)))).first().revenue is None


def test_ttm_as_of(spark):
    rows = quarters("revenue", [*ENDS25, D(2026, 3, 31)], (100, 110, 120, 130, 140))
    rows += quarters("cash", [ENDS25[3], D(2026, 3, 31)], (50, 60))
    m = metrics(spark, rows)
    first = T.ttm_wide(m, as_of="2025-12-31").first()
    last = T.ttm_wide(m, as_of="2026-03-31").first()
    assert (first.revenue, first.cash, last.revenue, last.cash) == (460, 50, 500, 60)
    dates = spark.createDataFrame([("T", D(2025, 12, 31)), ("T", D(2026, 3, 31))], "ticker string, as_of date")
    both = {r.as_of: (r.revenue, r.cash) for r in T.ttm_wide_at(m, dates).collect()}
    assert both == {D(2025, 12, 31): (460, 50), D(2026, 3, 31): (500, 60)}


def test_annual_fallback_and_stale_shares(spark):
    base = quarters("cash", [D(2025, 12, 31)], (1,))
    near = metrics(spark, base + [("T", "common_shares_outstanding", 7.0, "annual", D(2024, 12, 31)), ("T", "total_current_assets", 9.0, "annual", D(2019, 12, 31))])
    far = metrics(spark, base + [("T", "common_shares_outstanding", 7.0, "annual", D(2024, 6, 30))])
    r = T.ttm_wide(near).first()
    assert (r.common_shares_outstanding, r.total_current_assets) == (7.0, 9.0)
    assert T.ttm_wide(far).first().common_shares_outstanding is None


def test_ttm_prunes_metrics_but_keeps_the_newest_date(spark):
    ends = [D(2024, e.month, e.day) for e in ENDS25]
    m = metrics(spark, quarters("revenue", ends, (1, 1, 1, 1)) + quarters("goodwill", [D(2025, 12, 31)], (5,)))
    assert T.ttm_wide(m, names=["revenue"]).first().revenue is None


def wide(spark, **vals):
    names = list(vals)
    return spark.createDataFrame([tuple(None if v is None else float(v) for v in vals.values())], ", ".join(f"{n} double" for n in names))


@pytest.mark.parametrize("given,metric,expected", [
    (dict(operating_income=10, depreciation_and_amortization=-3), "ebitda", 13),
    (dict(net_income=5, income_tax_expense=-2, interest_expense=-1, depreciation_and_amortization=-3), "ebitda", 11),
    (dict(ebitda=1, operating_income=10, depreciation_and_amortization=-3), "ebitda", 1),
    (dict(operating_cash_flow=10, capex=-4, free_cash_flow=99), "free_cash_flow", 6),
    (dict(operating_cash_flow=10, free_cash_flow=99), "free_cash_flow", 99),
    (dict(revenue=100, cost_of_revenue=-60), "gross_profit", 40),
    (dict(revenue=100, cost_of_revenue=-10), "gross_profit", None),
    (dict(gross_profit=40, operating_expenses=-15), "operating_income", 25),
    (dict(commercial_paper=3), "short_term_debt", 3),
    (dict(accounts_receivable=3, nontrade_receivables=4), "total_receivables", 7),
])
def test_derived_metrics(spark, given, metric, expected):
    assert with_derived(wide(spark, **given)).first()[metric] == expected


def test_ratio_registry_shape(spark):
    assert len(R.REGISTRY) == 31 and len({r.category for r in R.REGISTRY}) == 8
    assert R.registry_table(spark).count() == 31
    assert "operating_expenses" not in R.required_metrics()


@pytest.mark.parametrize("name,given,expected", [
    ("gross_profit_margin", dict(gross_profit=40, revenue=100), 0.4),
    ("gross_profit_margin", dict(gross_profit=40, revenue=0), None),
    ("pretax_profit_margin", dict(net_income=8, income_tax_expense=-2, revenue=100), 0.1),
    ("effective_tax_rate", dict(net_income=8, income_tax_expense=-2), 0.2),
    ("return_on_capital_employed", dict(operating_income=10, total_assets=150, total_current_liabilities=50), 0.1),
    ("payables_turnover", dict(cost_of_revenue=-60, accounts_payable=20), 3.0),
    ("dividend_paid_and_capex_coverage_ratio", dict(operating_cash_flow=10, capex=-4), 2.5),
    ("interest_coverage_ratio", dict(operating_income=10, interest_expense=-4), 2.5),
    ("cash_per_share", dict(cash=10, common_shares_outstanding=5), 2.0),
    ("cash_per_share", dict(short_term_investments=10, common_shares_outstanding=5), None),
    ("net_debt", dict(long_term_debt=10, cash=4), 6.0),
    ("net_debt", dict(cash=4), None),
])
def test_ratio_formulas(spark, name, given, expected):
    base = {i: None for r in R.REGISTRY for i in r.inputs}
    row = wide(spark, **{**base, "short_term_investments": None, **given}).select(*R.ratio_columns([name])).first()
    assert row[0] == pytest.approx(expected) if expected is not None else row[0] is None


def test_split_adjustment(spark):
    shares = [(2020, 10.0), (2021, None), (2022, 41.0), (2023, 42.0), (2024, 420.0)]
    df = spark.createDataFrame([("T", D(y, 12, 31), v) for y, v in shares], "ticker string, period_end date, common_shares_outstanding double")
    got = {r.period_end.year: r.common_shares_outstanding for r in RO.split_adjusted(df).collect()}
    assert got == {2020: 400.0, 2021: None, 2022: 410.0, 2023: 420.0, 2024: 420.0}


def test_latest_ratios_are_not_carried_forward(spark):
    rows = [("T", "revenue", 10.0, "annual", D(2023, 12, 31)), ("T", "net_income", 1.0, "annual", D(2023, 12, 31)),
            ("T", "total_assets", 5.0, "annual", D(2024, 12, 31)), ("T", "revenue", 20.0, "annual", D(2024, 12, 31))]
    got = {r.ratio_name: r.value for r in RO.latest_ratios(metrics(spark, rows)).collect()}
    assert got == {"asset_turnover": 4.0}


def test_growth_is_positional_and_null_safe(spark):
    rows = [("T", "revenue", v, "annual", D(y, 12, 31)) for y, v in ((2020, 0.0), (2021, 10.0), (2023, 15.0))]
    got = {r.period_end.year: r.revenue for r in S.growth_rates(metrics(spark, rows), ["revenue"]).collect()}
    assert got == {2021: None, 2023: 50.0}


def test_quarterly_detail_window(spark):
    rows = quarters("revenue", [D(2025, 3, 29), D(2025, 6, 28), D(2025, 9, 27), D(2025, 12, 27)], (1, 2, 3, 4))
    rows += quarters("interest_expense", [D(2022, 12, 31), D(2023, 4, 1), D(2023, 7, 1), D(2023, 9, 30)], (1, 1, 1, 1))
    m = metrics(spark, rows)
    out = {r.metric_type: r for r in S.quarterly_detail(m, ["revenue", "interest_expense"], T.ttm_long(T.ttm_wide(m)), 2).collect()}
    assert (out["revenue"].ttm, out["revenue"].q1, out["revenue"].q2) == (10, 4, 3)
    assert out["revenue"].q1_label == "Quarter Ended 12/27/2025"
    assert (out["interest_expense"].ttm, out["interest_expense"].q1) == (None, None)
    assert (out["revenue"].position, out["interest_expense"].position) == (1, 2)


def test_health_scores(spark):
    latest = spark.createDataFrame([("T", "current_ratio", 1.5), ("T", "return_on_equity", 9.0)], "ticker string, ratio_name string, value double")
    ttm = spark.createDataFrame([("T", 10.0)], "ticker string, interest_coverage_ratio double")
    got = {r.ratio_name: (r.score, r.light) for r in RO.health_scores(latest, ttm).collect()}
    assert got["current_ratio"] == (50.0, "amber") and got["return_on_equity"] == (100.0, "green")
    assert got["interest_coverage_ratio"] == (50.0, "amber")
    assert got["financial_leverage_ratio"] == (100.0, "green") and got["gross_profit_margin"] == (0.0, "red")


def row(spark, metric, value, ticker="T"):
    return metrics(spark, [(ticker, metric, value, "annual", D(2024, 12, 31))])


def test_store_upsert_delete_and_empty(spark, tmp_path):
    st = MetricStore(spark, str(tmp_path / "s"))
    assert st.is_empty()
    assert st.upsert(row(spark, "revenue", 100.0).unionByName(row(spark, "cash", 1.0, "U"))) == 2
    st.upsert(row(spark, "revenue", 200.0))
    got = {(r.ticker, r.metric_type): (r.value, r.currency) for r in st.read().collect()}
    assert got == {("T", "revenue"): (200.0, "USD"), ("U", "cash"): (1.0, "USD")}
    assert st.delete_tickers([" t ", "T"]) == 1
    assert {r.ticker for r in st.read().collect()} == {"U"}
    st.upsert(row(spark, "revenue", 5.0))
    assert st.read().count() == 2
    assert st.compact_to(str(tmp_path / "c")).read().count() == 2
    with pytest.raises(ValueError):
        st.upsert(row(spark, "cash", 1.0).drop("period"))


def test_a_repeated_batch_leaves_one_copy(spark, tmp_path):
    st = MetricStore(spark, str(tmp_path / "s"))
    for value in (1.0, 2.0):
        st.upsert(row(spark, "cash", value), "b1")
    assert st.rows.read().count() == 1 and st.read().first().value == 2.0


def test_sign_migration(spark, tmp_path):
    st = MetricStore(spark, str(tmp_path / "s"))
    raw = {"capex": 12.0, "dividends_paid": 5.0, "cash": -30.0, "income_tax_expense": 7.0, "revenue": 9.0}
    st.upsert(metrics(spark, [("T", m, v, "annual", D(2024, 12, 31)) for m, v in raw.items()]))
    assert st.normalize_signs(dry_run=True)["rows_changed"] == 4
    res = st.normalize_signs()
    assert res["by_rule"] == {"negative_magnitude": 2, "positive_magnitude": 1, "sign_flip": 1}
    got = {r.metric_type: r.value for r in st.read().collect()}
    assert got == {"capex": -12.0, "dividends_paid": -5.0, "cash": 30.0, "income_tax_expense": -7.0, "revenue": 9.0}
    with pytest.raises(ValueError):
        st.normalize_signs()
    again = st.normalize_signs(dry_run=True)
    assert again["already_applied"] and again["rows_changed"] == 0


def test_ledger_and_company_state(spark, tmp_path):
    led = Ledger(spark, str(tmp_path / "l"))
    new = spark.createDataFrame([("A", "T", "10-K", "2024-01-01"), ("A", "T", "10-K", "2024-01-01"), ("B", "U", "10-Q", "2024-02-01")],
                                "accession_number string, ticker string, form_type string, filed_date string")
    assert led.mark(new) == 2 and led.mark(new) == 0
    assert led.count() == 2 and led.contains("A") and not led.contains("C")
    state = CompanyState(spark, str(tmp_path / "c"))
    state.update(spark.createDataFrame([("T", "1"), ("U", "2")], "ticker string, cik string"))
    assert state.count() == 2 and state.delete("t") == 1 and state.count() == 1
    assert state.last_extracted("T") is None and state.last_extracted("U") is not None


def test_rerun_of_chosen_companies(spark, tmp_path):
    from test_facts import REV, facts

    st, state = MetricStore(spark, str(tmp_path / "s")), CompanyState(spark, str(tmp_path / "c"))
    src = facts(spark, [(REV, 1.0, "FY", D(2023, 1, 1), D(2023, 12, 31), 2023, "USD", t) for t in ("T", "U")])
    assert jobs.refresh_companies(st, state, src) == 2
    st.upsert(row(spark, "goodwill", 3.0))
    res = {r.ticker: (r.deleted_rows, r.deleted_state_rows, r.written_rows) for r in jobs.rerun_companies(st, state, src, ["t", "x"]).collect()}
    assert res == {"T": (2, 1, 1), "X": (0, 0, 0)}
    assert st.read().count() == 2


def points(spark, rows):
    return spark.createDataFrame(rows, "ticker string, metric_type string, period_type string, period_end date, value double")


def test_matching_prefers_the_nearest_then_the_earlier_date(spark):
    a = points(spark, [("T", "revenue", "annual", D(2024, 1, 10), 1.0), ("T", "revenue", "annual", D(2024, 6, 30), 2.0)])
    b = points(spark, [("T", "revenue", "annual", d, float(d.day)) for d in (D(2024, 1, 7), D(2024, 1, 13), D(2024, 1, 3), D(2024, 7, 8))])
    got = {r.l_period_end: (r.r_period_end, r.days) for r in RC.source_matches(a, b).collect()}
    assert got == {D(2024, 1, 10): (D(2024, 1, 7), 3)}


def test_matching_equals_brute_force(spark):
    import random
    rnd = random.Random(5)
    day0 = D(2020, 1, 1)
    left = [("T", "m", "q", day0 + dt.timedelta(x), float(x)) for x in sorted(rnd.sample(range(900), 80))]
    right = [("T", "m", "q", day0 + dt.timedelta(x), float(x)) for x in sorted(rnd.sample(range(900), 80))]
    want = {}
    for lrow in left:
        near = sorted((abs((lrow[3] - r[3]).days), r[3]) for r in right)
        if near[0][0] <= 7:
            want[lrow[3]] = near[0][1]
    got = {r.l_period_end: r.r_period_end for r in RC.source_matches(points(spark, left), points(spark, right)).collect()}
    assert got == want
    merged = {(r.period_end, r.source) for r in RC.merge_sources(points(spark, left), points(spark, right)).collect()}
    used, mine = set(want.values()), {x[3] for x in left}
    assert merged == {(x[3], "both" if x[3] in want else "dera") for x in left} | {
        (x[3], "fmp") for x in right if x[3] not in used and x[3] not in mine}


@pytest.mark.parametrize("parts,long_debt,short_debt", [
    ({"__long_term_debt_noncurrent": 5, "__long_term_debt_total": 9}, 5, None),
    ({"__long_term_debt_total": 9, "__long_term_debt_current": 2}, 7, 2),
    ({"__long_term_debt_total": 9, "__debt_current": 3}, 6, 3),
    ({"__long_term_debt_total": 1, "__debt_current": 3}, None, 3),
    ({"__long_term_debt_total": 9, "__commercial_paper": 4}, 9, 4),
    ({"__long_term_debt_total": 9, "__commercial_paper": 4, "__long_term_debt_current": 1}, 8, 5),
])
def test_debt_parts(spark, parts, long_debt, short_debt):
    rows = [("T", m, "annual", D(2024, 12, 31), float(v)) for m, v in parts.items()]
    got = {r.metric_type: r.value for r in RC.dera_points(points(spark, rows)).collect()}
    assert (got.get("long_term_debt"), got.get("short_term_debt")) == (long_debt, short_debt)


def test_operating_income_and_equity_repair(spark):
    e = D(2024, 12, 31)
    rows = [("T", m, "annual", e, float(v)) for m, v in (
        ("net_income", 10), ("gross_profit", 100), ("operating_income", 500), ("operating_income", 60), ("operating_income", 50),
        ("operating_income", 5), ("total_assets", 100), ("total_liabilities", 70), ("stockholders_equity", 12))]
    got = {r.metric_type: r.value for r in RC.dera_points(points(spark, rows)).collect()}
    assert (got["operating_income"], got["stockholders_equity"]) == (50.0, 30.0)


def test_expected_values_use_canonical_signs(spark):
    actual = points(spark, [("T", "capex", "annual", D(2024, 12, 28), -100.0)])
    want = points(spark, [("T", "capex", "annual", D(2024, 12, 31), 100.5), ("T", "capex", "annual", D(2023, 12, 31), 1.0)]).withColumn("tolerance_pct", F.lit(1.0))
    got = {r.period_end.year: r.passes for r in RC.check_expected(actual, want).collect()}
    assert got == {2024: True, 2023: False}


def test_quality_checks(spark):
    m = metrics(spark, quarters("revenue", ENDS25, (1, 2, 3, 4)) + [("T", "revenue", 11.0, "annual", D(2025, 12, 31))])
    assert Q.quarters_off_total(m, ["revenue"]).first().quarter_sum == 10.0
    assert Q.label_breaks(m.withColumn("period", F.lit("FY-2025"))).count() == 5
    assert {r.missing for r in Q.core_metric_gaps(m, ["revenue", "capex"]).collect()} == {"capex"}


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_scalar_rules(spark):
    lit = F.lit
    assert one(spark, K.ticker_key(lit(" brk. b/ "))) == "BRK-B"
    assert one(spark, K.item_code(lit("Item 5 . 02 x"))) == "5.02"
    assert one(spark, K.item_title(lit("9.01"))) == "Financial Statements and Exhibits"
    assert one(spark, K.base_form(lit(" 10-k/A "))) == "10-K"
    assert one(spark, K.ownership_form(lit("SCHEDULE 13d/A"))) == "SC 13D"
    assert one(spark, K.manager_key(lit("Berkshire Hathaway Inc."))) == "BRK-B"
    assert one(spark, K.iso_day(lit("2024-02-30"))) is None
    assert one(spark, K.iso_day(lit("2024-02-29T10:00"))) == D(2024, 2, 29)
    assert one(spark, K.label_day(lit("Quarter Ended 12/31/2025"))) == D(2025, 12, 31)
    assert one(spark, K.excerpt(lit("a  b\n c d"), 6)) == "a b..."
    assert one(spark, K.excerpt(lit("  "), 6)) is None
    assert one(spark, K.ticker_tokens(lit("Compare AAPL and MSFT, AAPL TTM in FORM"))) == ["AAPL", "MSFT"]
    assert one(spark, K.first_iso_date(lit("since 2024-03-01 or 2025-01-01"))) == "2024-03-01"
    assert one(spark, K.postal_line(lit(" 1 Main "), lit(None).cast("string"), lit("Omaha"))) == "1 Main, Omaha"
    assert one(spark, K.money(lit(-2.5e9))) == "-$2.50B" and one(spark, K.money(lit(1234.0))) == "$1,234"
    assert one(spark, K.compact_percent(lit(5.50))) == "5.5%" and one(spark, K.compact_percent(lit(7.0))) == "7%"
    assert one(spark, K.currency_short(lit(1500.0))) == "$1.5K" and one(spark, K.count_short(lit(2.5e9))) == "2.50B"
    assert one(spark, K.ratio_text(lit(0.1234), lit("pct"))) == "12.34%" and one(spark, K.ratio_text(lit(1.5), lit("multiple"))) == "1.50x"
    assert one(spark, K.metric_text(lit(-2.5e9), lit("millions"))) == "-2,500" and one(spark, K.metric_text(lit(None).cast("double"), lit("count"))) == "—"
    assert one(spark, K.trade_significance(lit(-1e6))) == "Very notable" and one(spark, K.trade_significance(lit(None).cast("double"))) == "Normal"
    assert [one(spark, K.duration_bucket(F.date_sub(lit(D(2024, 12, 31)), n), lit(D(2024, 12, 31)))) for n in (69, 70, 120, 140, 230, 330, 421)] == [
        None, "quarter", "quarter", "ytd_6m", "ytd_9m", "annual", None]
