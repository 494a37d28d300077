"""Every registered query against its SQL, and the entry points."""

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 1000 and df.columns == entry.entry(spark).columns


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sf, con, name):
    got = entry.queries()[name](spark, sf).toPandas()
    assert len(got)
    if name in ORACLES:
        assert compare(got, con.sql(ORACLES[name]).df()) == "ok"
