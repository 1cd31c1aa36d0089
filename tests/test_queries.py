"""Every query with SQL gives the same rows in Spark and in DuckDB."""

import pytest
from oracle import SF, SF_SMALL, connect, spark_rows, sql_rows

import __spark_entry__ as entry
from tonelake.plans import queries as core


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_same_rows(spark, con, name):
    assert spark_rows(core.QUERIES[name](spark, SF)) == sql_rows(con, core.SQL[name])


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_others_run(spark, name):
    assert core.QUERIES[name](spark, SF_SMALL).columns
