"""How reconciliation moves and stores its rows."""

import os

from tallyfold.operators import reconcile as RC


def test_statement_points_shuffle_candidates_once(spark, tmp_path):
    path = str(tmp_path / "candidates")
    rows = spark.sql("select 'T' ticker, 'net_income' metric_type, 'annual' period_type, date '2024-12-31' period_end, double(id % 2) value from range(6)")
    rows.write.parquet(path)
    points = RC.dera_points(spark.read.parquet(path))
    assert points._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [r.value for r in points.collect()] == [1.0]


def test_fixture_is_compressed_and_reads_back(spark, tmp_path):
    path = str(tmp_path / "fixture")
    rows = spark.sql("select concat('T', id) ticker, 'cash' metric_type, 'annual' period_type, date '2024-12-31' period_end, double(id) value from range(50)")
    RC.write_fixture(rows, path)
    assert all(x.endswith(".json.gz") for x in os.listdir(path) if x.startswith("part-"))
    assert sorted(spark.read.schema(rows.schema).json(path).collect()) == sorted(rows.collect())
