"""Every query with SQL gives the rows of the SQL; every other query gives rows."""

import pytest
from compare import connect, difference

import __spark_entry__ as contract

SQL = contract.oracle_sql()
QUERIES = contract.queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(SQL))
def test_matches_sql(spark, sf_dir, con, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = con.execute(SQL[name]).df()
    assert difference(got, want) is None


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_has_a_row_per_region(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 5
    assert not any(r.is_anomaly for r in rows)
