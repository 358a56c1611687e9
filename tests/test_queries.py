"""Registered queries against their SQL counterparts in DuckDB.

All of the library's own queries run; those of the training-data subpackage have tests of their own.
"""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, duck
from tallyfold.plans import catalog

SF = "/root/testdata/sf0.001"


NAMES = list(catalog.oracles())
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.queries()) == set(catalog.oracles())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
