"""Every registered query agrees with its SQL on the smallest tables."""

import pytest

from grapevine.queries import QUERIES, SQL

from .oracle import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, tables, name):
    _, problems = differences(QUERIES[name](spark, FOLDER), tables, SQL[name])
    assert not problems


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    result = QUERIES[name](spark, FOLDER)
    assert result.columns
    assert result.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
