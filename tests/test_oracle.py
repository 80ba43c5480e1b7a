"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle_check import compare, duck

from __spark_entry__ import entry
from terrafold.plans import all_queries
from terrafold.plans.registry import ORACLES as SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
all_queries.load()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


def test_entry_runs(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    ok, note = compare(spark, con, QUERIES[name], SQL[name], FOLDER)
    assert ok, note
