import pytest
from tests.oracle import assert_same, connect

from tensorloom.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert_same(queries()[name](spark, SF).toPandas(), duck.execute(SQL[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(queries()) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert queries()[name](spark, SF).count() > 0
