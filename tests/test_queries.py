"""Every registered query against its SQL twin in DuckDB, on the smallest tables."""

import pytest

import suite
from compare import diff, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(suite.queries()))
def test_query(spark, con, name):
    got = suite.queries()[name](spark, SF).toPandas()
    sql = suite.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
    else:
        assert diff(got, con.sql(sql).df()) is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
