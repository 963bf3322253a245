import pytest

from pageloom.llm.catalogue import QUERIES, SQL
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, name):
    check(spark, sf, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
