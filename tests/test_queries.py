import pytest

from pageloom.plans import articles, corpus, records, values, wiki
from tests.oracle import check

_PLANS = (corpus, wiki, articles, records, values)
ALL = {n: f for p in _PLANS for n, f in p.QUERIES.items()}
SQL = {n: q for p in _PLANS for n, q in p.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, name):
    check(spark, sf, ALL[name], SQL[name])


#: Documents hold little that these change; the small tables may hold nothing.
SPARSE = {"cosmetic_changes", "fixed_texts"}


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_runs(spark, sf, name):
    assert ALL[name](spark, sf).count() > 0 or name in SPARSE


def test_entry_stands_alone(spark):
    import __spark_entry__ as e

    assert set(ALL) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["delivery_no"]
