"""Expected numbers of the extraction rules, on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyfold import model as M
from tallyfold.operators import facts as X

D = dt.date
REV = "us-gaap:Revenues"


def facts(spark, rows):
    """(concept, value, label, start, end[, fiscal_year, unit, ticker])"""
    full = []
    for r in rows:
        concept, value, label, start, end, *more = r
        year = more[0] if more else end.year
        unit = more[1] if len(more) > 1 else "USD"
        ticker = more[2] if len(more) > 2 else "T"
        full.append((ticker, "1", concept, value, unit, label, year, start, end))
    return spark.createDataFrame(full, M.FACTS_SCHEMA)


def values(df, metric, period_type="quarterly"):
    rows = df.where((F.col("metric_type") == metric) & (F.col("period_type") == period_type)).collect()
    return {r.period_end: r.value for r in rows}


OCT = D(2023, 10, 1)
YEAR = [
    (100.0, "Q1", D(2023, 12, 31)), (250.0, "Q2", D(2024, 3, 31)),
    (400.0, "Q3", D(2024, 6, 30)), (600.0, "FY", D(2024, 9, 30)),
]


def test_quarters_from_cumulative_values(spark):
    out = X.extract_companies(facts(spark, [(REV, v, q, OCT, e, 2024) for v, q, e in YEAR]))
    got = values(out, "revenue")
    assert got == {D(2023, 12, 31): 100, D(2024, 3, 31): 150, D(2024, 6, 30): 150, D(2024, 9, 30): 200}
    assert sum(got.values()) == values(out, "revenue", "annual")[D(2024, 9, 30)] == 600
    q4 = out.where("period_end = date'2024-09-30' and period_type = 'quarterly'").first()
    assert (q4.source, q4.period) == ("10-K", "Quarter Ended 09/30/2024")


def test_negative_flows_are_subtracted_before_the_sign_rule(spark):
    cf = "us-gaap:NetCashProvidedByUsedInInvestingActivities"
    raw = [(-50.0, "Q1", YEAR[0][2]), (-120.0, "Q2", YEAR[1][2]), (-200.0, "Q3", YEAR[2][2]), (-280.0, "FY", YEAR[3][2])]
    got = values(X.extract_companies(facts(spark, [(cf, v, q, OCT, e, 2024) for v, q, e in raw])), "investing_cash_flow")
    assert [got[e] for _, _, e in raw] == [-50, -70, -80, -80]


def test_derived_quarter_of_a_negative_magnitude_metric_loses_its_sign(spark):
    capex = "us-gaap:PaymentsToAcquirePropertyPlantAndEquipment"
    rows = [(capex, 100.0, "Q1", OCT, YEAR[0][2], 2024), (capex, 90.0, "Q2", OCT, YEAR[1][2], 2024)]
    assert values(X.extract_companies(facts(spark, rows)), "capex")[D(2024, 3, 31)] == -10


def test_credible_annual_rows_only(spark):
    rows = [
        (REV, 900.0, "Q2", D(2022, 7, 1), D(2023, 6, 30)),   # twelve months under a quarter label
        (REV, 50.0, "FY", D(2023, 10, 1), D(2023, 12, 31)),  # one quarter under an FY label
        (REV, 1000.0, "FY", D(2023, 1, 1), D(2023, 12, 31)),
        (REV, 990.0, "FY", D(2023, 1, 1), D(2023, 12, 31), 2024),
    ]
    out = X.extract_companies(facts(spark, rows))
    assert values(out, "revenue", "annual") == {D(2023, 12, 31): 1000}
    assert values(out, "revenue") == {}


def test_alias_priority_and_gap_fill(spark):
    other = "us-gaap:SalesRevenueNet"
    rows = [
        (other, 200.0, "FY", D(2023, 1, 1), D(2023, 12, 31)), (REV, 100.0, "FY", D(2023, 1, 1), D(2023, 12, 31)),
        (other, 300.0, "FY", D(2022, 1, 1), D(2022, 12, 31)),
    ]
    got = values(X.extract_companies(facts(spark, rows)), "revenue", "annual")
    assert got == {D(2023, 12, 31): 100, D(2022, 12, 31): 300}


def test_unit_rules(spark):
    eps, shares = "us-gaap:EarningsPerShareDiluted", "us-gaap:CommonStockSharesOutstanding"
    year = (D(2023, 1, 1), D(2023, 12, 31))
    rows = [
        (REV, 1.0, "FY", *year, 2023, "EUR"), (eps, 2.0, "FY", *year, 2023, "USD/shares"), (eps, 9.0, "FY", *year, 2023, "USD"),
        (shares, 3.0, "FY", None, year[1], 2023, "shares"), (shares, 8.0, "FY", None, year[1], 2023, "USD"),
    ]
    got = {r.metric_type: r.value for r in X.extract_companies(facts(spark, rows)).collect()}
    assert got == {"eps_diluted": 2.0, "common_shares_outstanding": 3.0}


def test_standardised_series_wins_and_raw_facts_fill(spark):
    raw = facts(spark, [(REV, 1.0, "FY", D(y, 1, 1), D(y, 12, 31)) for y in (2021, 2022, 2023)])
    std = facts(spark, [("revenue", 5.0, "FY", D(2023, 1, 1), D(2023, 12, 31)),
                        ("earnings_per_share_diluted", 2.5, "FY", D(2023, 1, 1), D(2023, 12, 31))])
    out = X.extract_companies(raw, std)
    assert values(out, "revenue", "annual") == {D(2021, 12, 31): 1, D(2022, 12, 31): 1, D(2023, 12, 31): 5}
    assert values(out, "eps_diluted", "annual") == {D(2023, 12, 31): 2.5}


def test_backfilled_income_lines(spark):
    year = (D(2023, 1, 1), D(2023, 12, 31))
    rows = [(REV, 1000.0, "FY", *year), ("us-gaap:CostOfRevenue", 620.0, "FY", *year), ("us-gaap:OperatingIncomeLoss", 180.0, "FY", *year)]
    got = {r.metric_type: (r.value, r.source) for r in X.extract_companies(facts(spark, rows)).collect()}
    assert got["gross_profit"] == (380.0, "10-K-derived")
    assert got["operating_expenses"] == (-200.0, "10-K-derived")
    assert len(got) == 5


def test_no_backfill_outside_the_cost_range(spark):
    year = (D(2023, 1, 1), D(2023, 12, 31))
    rows = [(REV, 1000.0, "FY", *year), ("us-gaap:CostOfRevenue", 100.0, "FY", *year)]
    assert values(X.extract_companies(facts(spark, rows)), "gross_profit", "annual") == {}


@pytest.mark.parametrize("tags,expected", [
    ({"LongTermDebt": 90.678, "LongTermDebtNoncurrent": 78.328, "LongTermDebtCurrent": 12.350}, 78.328),
    ({"LongTermDebt": 90.0, "LongTermDebtCurrent": 12.0}, 78.0),
    ({"LongTermDebt": 10.0, "LongTermDebtCurrent": 12.0}, 10.0),
    ({"LongTermDebtAndCapitalLeaseObligations": 7.0}, 7.0),
])
def test_canonical_long_term_debt(spark, tags, expected):
    rows = [(f"us-gaap:{t}", v, "FY", None, D(2023, 12, 31)) for t, v in tags.items()]
    assert values(X.extract_companies(facts(spark, rows)), "long_term_debt", "annual") == {D(2023, 12, 31): expected}


def test_balances_pass_through_with_q4(spark):
    rows = [("us-gaap:Assets", float(i), q, None, D(2023, 3 * i, 28)) for i, q in enumerate(("Q1", "Q2", "Q3", "Q4"), 1)]
    out = X.extract_companies(facts(spark, rows))
    assert values(out, "total_assets") == {D(2023, 3 * i, 28): i for i in range(1, 5)}
    assert {r.source for r in out.collect()} == {"10-Q"}


def test_flows_without_a_start_column_follow_their_label(spark):
    rows = [(REV, 1.0, "Q1", None, D(2023, 3, 31)), (REV, 4.0, "Q4", None, D(2023, 12, 31)), (REV, 9.0, "FY", None, D(2023, 12, 31))]
    out = X.extract_companies(facts(spark, rows).drop("period_start"))
    assert values(out, "revenue") == {D(2023, 3, 31): 1} and values(out, "revenue", "annual") == {D(2023, 12, 31): 9}


def filing(spark, rows):
    """(concept, value, label, start, end, dimensioned[, accession, form])"""
    full = [(r[6] if len(r) > 6 else "A1", r[7] if len(r) > 7 else "10-Q", "2024-05-01", "1", r[0], r[1], "iso4217-USD", r[5], r[2], 2024, r[3], r[4])
            for r in rows]
    return spark.createDataFrame(full, M.FILING_FACTS_SCHEMA).withColumn("ticker", F.lit("T"))


def test_consolidated_rows_unless_there_are_none(spark):
    end = D(2024, 3, 31)
    rows = [("us-gaap:Assets", 5.0, "Q1", None, end, False), ("us-gaap:Assets", 50.0, "Q1", None, end, True),
            ("us-gaap:Liabilities", 7.0, "Q1", None, end, True)]
    got = {r.metric_type: r.value for r in X.extract_filings(filing(spark, rows)).collect()}
    assert got == {"total_assets": 5.0, "total_liabilities": 7.0}
    assert X.consolidated_only(filing(spark, rows)).count() == 2


def test_filing_labels_decide_the_period_type(spark):
    rows = [(REV, 10.0, "FY", D(2024, 1, 1), D(2024, 3, 31), False), (REV, 99.0, "Q2", D(2023, 7, 1), D(2024, 6, 30), False)]
    got = {(r.period_type, r.period_end): r.value for r in X.extract_filings(filing(spark, rows)).collect()}
    assert got == {("annual", D(2024, 3, 31)): 10.0, ("quarterly", D(2024, 6, 30)): 99.0}


def test_filing_keeps_accession_and_form_source(spark):
    rows = [(REV, 10.0, "Q1", D(2024, 1, 1), D(2024, 3, 31), False, "B7", "10-K/A")]
    r = X.extract_filings(filing(spark, rows)).first()
    assert (r.accession, r.source) == ("B7", "10-K")


def test_coverage_and_missing(spark):
    out = X.extract_companies(facts(spark, [(REV, 1.0, "FY", D(y, 1, 1), D(y, 12, 31)) for y in (2022, 2023)]))
    cov = X.coverage(out).first()
    assert (cov.periods, cov.first_period, cov.last_period) == (2, D(2022, 12, 31), D(2023, 12, 31))
    assert X.missing_metrics(out, ["revenue", "capex"]).collect()[0].metric_type == "capex"


def test_a_hot_company_gives_the_same_result_as_one_copy(spark):
    base = facts(spark, [(REV, v, q, OCT, e, 2024) for v, q, e in YEAR])
    hot = base.crossJoin(spark.range(2000)).drop("id")
    a = sorted(X.extract_companies(base).collect())
    assert a == sorted(X.extract_companies(hot).collect())


def test_extraction_scans_facts_once(spark, tmp_path):
    path = str(tmp_path / "facts")
    facts(spark, [(REV, v, q, OCT, e, 2024) for v, q, e in YEAR]).write.parquet(path)
    plan = X.extract_companies(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert plan.count("Exchange hashpartitioning") == 4


def test_fast_path_shuffles_facts_once_by_filing(spark, tmp_path):
    path = str(tmp_path / "facts")
    filing(spark, [(REV, 10.0, "Q1", D(2024, 1, 1), D(2024, 3, 31), False)]).write.parquet(path)
    plan = X.extract_filings(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
