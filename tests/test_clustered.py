"""The table by ticker: same rows, no shuffle for work per ticker, pruned buckets, opened again."""

import re
from datetime import date

from tallyfold.operators import series as S
from tallyfold.operators import ttm as T
from tallyfold.sources import clustered as CL

ENDS = [date(y, m, d) for y in (2021, 2022, 2023) for m, d in ((3, 31), (6, 30), (9, 30), (12, 31))]


def metric_rows(spark, tickers=12):
    rows = [(f"T{t}", m, float(t * 100 + i), "quarterly", e, "p") for t in range(tickers) for i, e in enumerate(ENDS) for m in ("revenue", "cash")]
    rows += [(f"T{t}", "revenue", float(t + y), "annual", date(y, 12, 31), "p") for t in range(tickers) for y in (2021, 2022, 2023)]
    return spark.createDataFrame(rows, "ticker string, metric_type string, value double, period_type string, period_end date, period string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ttm_and_growth_need_no_shuffle(spark, tmp_path):
    rows = metric_rows(spark)
    table = CL.write_by_ticker(rows, str(tmp_path / "m"), 8)
    assert sorted(table.collect()) == sorted(rows.select(*table.columns).collect())
    for work in (lambda m: T.ttm_wide(m, names=["revenue", "cash"]), lambda m: S.growth_rates(m, ["revenue"], "annual")):
        assert "Exchange" in plan(work(rows))
        assert "Exchange" not in plan(work(table))
        assert sorted(map(str, work(table).collect())) == sorted(map(str, work(rows).collect()))


def test_a_ticker_list_reads_its_buckets(spark, tmp_path):
    CL.write_by_ticker(metric_rows(spark), str(tmp_path / "m"), 8)
    found = CL.read_by_ticker(spark, str(tmp_path / "m"), ["t3 "])
    asked = T.ttm_wide(found, names=["revenue"])
    picked = asked._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert re.search(r"SelectedBucketsCount: 1 out of 8", picked)
    assert {r.ticker for r in found.collect()} == {"T3"}


def test_files_are_opened_by_a_session_that_does_not_know_them(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = metric_rows(spark)
    CL.write_by_ticker(rows, path, 4)
    spark.sql(f"DROP TABLE {CL._name(path)}")
    table = CL.read_by_ticker(spark, path)
    assert sorted(table.collect()) == sorted(rows.select(*table.columns).collect())
    assert "Exchange" not in plan(T.ttm_wide(table, names=["revenue"]))


def test_written_again_empty_and_null_tickers(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = metric_rows(spark, 2)
    CL.write_by_ticker(rows, path)
    assert CL.write_by_ticker(rows.where("false"), path).count() == 0
    nulls = rows.withColumn("ticker", rows["ticker"].substr(9, 1)).selectExpr("nullif(ticker, '') as ticker", "metric_type", "value", "period_type", "period_end", "period")
    assert CL.write_by_ticker(nulls.unionByName(nulls), path, 3).count() == 2 * rows.count()
