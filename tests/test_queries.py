"""Every query that has SQL gives DuckDB's rows on the smallest tables; the others run and give rows."""

import pytest
from oracle import connect, same

from weftline import catalog

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_duckdb(spark, duck, name):
    same(QUERIES[name](spark, FOLDER), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
