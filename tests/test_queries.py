"""Every named query against its SQL; those without one run and have rows."""

import os

import pytest

from lectern.queries import QUERIES, SQL

from .oracle import DIR, compare

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DIR)
    rows = df.collect()
    assert rows and len(rows[0]) == len(df.columns)


def test_registry():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
