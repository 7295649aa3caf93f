"""Every registered query that has SQL gives the same rows as that SQL in another engine."""
import pytest

import __spark_entry__ as entry
from beatwise.checks.compare import check, duck

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    ok, message = check(spark, SF, name, QUERIES[name], SQL[name], con)
    assert ok, message


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "rep_id" in df.columns
