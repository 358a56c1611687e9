"""Values in two times, against a day-by-day computation."""

import itertools
import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from tallyfold import model as M
from tallyfold.operators import known as KN
from tallyfold.operators import ttm as T
from tallyfold.sources.store import by_period

SCHEMA = "ticker string, metric_type string, period_type string, period_end date, value double, accession string, filed date"
ENDS = [date(2023, 3, 31), date(2023, 6, 30), date(2023, 9, 30), date(2023, 12, 31), date(2024, 3, 31)]


def reports(seed=5):
    """Random reports: repeats, restatements, withdrawals, several filings on one day, no day."""
    r, rows = random.Random(seed), []
    for t, m, e in itertools.product("AB", ["revenue", "cash"], ENDS):
        for k in range(r.randint(0, 5)):
            filed = e + timedelta(days=r.randint(0, 6) * 30)
            rows.append((t, m, "quarterly", e, r.choice([None, 1.0, 2.0, 3.0]), f"{t}{k}{r.randint(0, 99):02d}", r.choice([filed] * 9 + [None])))
    return list({(*x[:4], x[5], x[6]): x for x in rows}.values())


def plainly(rows, day):
    """The newest report of each key up to a day."""
    found = {}
    for x in sorted((x for x in rows if x[6] is not None and x[6] <= day), key=lambda x: (x[6], x[5])):
        found[x[:4]] = x[4]
    return {k: v for k, v in found.items() if v is not None}


def test_versions_hold_what_was_known_each_day(spark):
    rows = reports()
    frame = spark.createDataFrame(rows, SCHEMA)
    history = KN.versions(frame)
    kept = [r.asDict() for r in history.collect()]
    days = sorted({x[6] + timedelta(days=n) for x in rows if x[6] for n in (-1, 0, 1)})
    for day in days:
        own = {tuple(r[k] for k in M.PK): r["value"] for r in kept
               if r["known_from"] <= day and (r["known_until"] is None or r["known_until"] > day)}
        assert {(k[M.PK.index("ticker")], k[M.PK.index("metric_type")], k[M.PK.index("period_type")], k[M.PK.index("period_end")]): v
                for k, v in own.items()} == plainly(rows, day)
    by_key = {}
    for r in sorted(kept, key=lambda r: r["known_from"]):
        before = by_key.get(tuple(r[k] for k in M.PK))
        assert before is None or before["known_until"] < r["known_from"] or before["value"] != r["value"]
        by_key[tuple(r[k] for k in M.PK)] = r
    for day in days[:: len(days) // 3]:
        want = plainly(rows, day)
        for found in (KN.as_known(history, str(day)), KN.known_on(frame, str(day))):
            assert {(r.ticker, r.metric_type, r.period_type, r.period_end): r.value for r in found.collect()} == want


def test_empty_table_and_repeated_rows(spark):
    assert KN.versions(spark.createDataFrame([], SCHEMA)).count() == 0
    row = ("A", "revenue", "quarterly", ENDS[0], 1.0, "a", ENDS[1])
    twice = spark.createDataFrame([row, row], SCHEMA)
    assert [(r.known_from, r.known_until) for r in KN.versions(twice).collect()] == [(ENDS[1], None)]
    assert KN.restatements(KN.versions(twice)).count() == 0


def test_ttm_before_and_after_an_amendment(spark):
    rows = [("A", "revenue", "quarterly", e, 10.0, f"q{i}", e + timedelta(days=30)) for i, e in enumerate(ENDS[:4])]
    rows.append(("A", "revenue", "quarterly", ENDS[1], 25.0, "amended", date(2024, 2, 20)))
    frame = spark.createDataFrame(rows, SCHEMA)
    ask = lambda day: KN.ttm_as_known(frame, day, as_of="2023-12-31", names=["revenue"]).first()["revenue"]
    assert (ask("2024-01-29"), ask("2024-01-30"), ask("2024-02-19"), ask("2024-02-20")) == (None, 40.0, 40.0, 55.0)
    history = KN.versions(frame)
    points = spark.createDataFrame([("A", date(2023, 12, 31), date(2024, 1, 31)), ("A", date(2023, 12, 31), date(2024, 3, 1)),
                                    ("A", date(2022, 12, 31), date(2024, 3, 1)), ("B", date(2023, 12, 31), date(2024, 3, 1))],
                                   "ticker string, as_of date, known_on date")
    found = {(r.ticker, r.known_on): r.revenue for r in KN.ttm_known_at(history, points, ["revenue"]).collect()}
    assert found == {("A", date(2024, 1, 31)): 40.0, ("A", date(2024, 3, 1)): 55.0}
    one = KN.restatements(history).first()
    assert (one.period_end, one.known_from, one.before, one.value, one.change) == (ENDS[1], date(2024, 2, 20), 10.0, 25.0, 1.5)


def test_points_equal_single_days(spark):
    frame = spark.createDataFrame(reports(9), SCHEMA)
    days = [date(2023, 10, 1), date(2024, 5, 1), date(2024, 8, 1)]
    points = spark.createDataFrame([(t, d, d) for t in "AB" for d in days], "ticker string, as_of date, known_on date")
    many = {(r.known_on, r.ticker): (r.revenue, r.cash) for r in KN.ttm_known_at(KN.versions(frame), points, ["revenue", "cash"]).collect()}
    single = {(d, r.ticker): (r.revenue, r.cash) for d in days
              for r in T.ttm_wide(KN.known_on(frame, str(d)), str(d), names=["revenue", "cash"]).collect()}
    assert many == single


def test_versions_shuffle_once(spark):
    plan = KN.versions(spark.createDataFrame(reports(), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_store_as_it_was(spark, tmp_path):
    from tallyfold.sources.store import MetricStore

    store = MetricStore(spark, str(tmp_path / "store"))
    rows = "ticker string, metric_type string, value double, period string, period_type string, period_end date"
    store.upsert(spark.createDataFrame([("A", "revenue", 1.0, "p", "quarterly", ENDS[0]), ("B", "revenue", 2.0, "p", "quarterly", ENDS[0])], rows))
    then = str(spark.sql("select current_timestamp()").first()[0])
    store.upsert(spark.createDataFrame([("A", "revenue", 5.0, "p", "quarterly", ENDS[0])], rows))
    store.delete_tickers(["B"])
    held = lambda x: {r.ticker: r.value for r in x.collect()}
    assert held(store.read()) == {"A": 5.0}
    assert held(store.read(then)) == {"A": 1.0, "B": 2.0}
    assert held(store.read("2000-01-01 00:00:00")) == {}


def test_versions_of_filings_shuffle_facts_and_rows_once_each(spark, tmp_path):
    from test_facts import D, REV, filing
    from tallyfold.operators import facts as X

    path = str(tmp_path / "facts")
    filing(spark, [(REV, 10.0, "Q1", D(2024, 1, 1), D(2024, 3, 31), False)]).write.parquet(path)
    rows = X.extract_filings(spark.read.parquet(path)).withColumn("filed", F.lit("2024-05-01").cast("date"))
    plan = KN.restatements(KN.versions(rows))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_metrics_of_a_period_move_together(spark):
    rows = spark.range(400).selectExpr("concat('T', id % 5) ticker", "concat('m', id) metric_type", "'q' period_type", "date '2024-03-31' period_end", "id value")
    dealt = by_period(rows, M.PK)
    assert dealt.columns == rows.columns and dealt.count() == 400
    placed = dealt.select("ticker", "period_end", F.spark_partition_id().alias("at")).distinct().groupBy("ticker", "period_end").count()
    assert placed.where("count > 1").count() == 0
