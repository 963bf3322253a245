import pytest

from pageloom.operators import graph
from pageloom.plans.generators import Relations, page_query


def test_closure_deeper_than_ten(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 20)], "parent bigint, child bigint")
    seeds = spark.createDataFrame([(1,)], "node bigint")
    assert sorted(map(tuple, graph.closure(e, seeds).collect())) == [(1, 1 + i, i) for i in range(20)]
    assert graph.closure(e, seeds, max_depth=3).count() == 4


def test_chains_longer_than_thirty_two(spark):
    red = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (201, 202), (202, 200), (203, 200)], "page_id bigint, target_id bigint")
    page = spark.createDataFrame([(100,), *[(i,) for i in range(200, 204)]], "page_id bigint")
    got = {r.page_id: (r.final_id, r.hops, r.kind) for r in graph.redirect_chains(red, page).collect()}
    assert got == {i: (100, 100 - i, "ok") for i in range(100)} | {i: (None, None, "loop") for i in range(200, 204)}


def test_components_that_do_not_settle(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)], "a bigint, b bigint")
    with pytest.raises(RuntimeError):
        graph.components(e, max_rounds=1)
    assert {r.component for r in graph.components(e).collect()} == {0}


def test_catr_deeper_than_ten(spark):
    n = 15
    page = spark.createDataFrame([(i, 14, f"Category:C{i}", False, 1) for i in range(n)] + [(99, 0, "P", False, 1)], "page_id bigint, ns int, title string, is_redirect boolean, length bigint")
    category = spark.createDataFrame([(i + 1, i) for i in range(n - 1)] + [(99, n - 1)], "member bigint, category bigint")
    none = lambda schema: spark.createDataFrame([], schema)
    r = Relations(page, none("from_id bigint, to_id bigint"), category, none("page_id bigint, user_name string, ts timestamp"), none("page_id bigint, type string, ts timestamp"), none("page_id bigint, url string"))
    assert 99 in {x.page_id for x in page_query(r, "-catr:C0").collect()}
