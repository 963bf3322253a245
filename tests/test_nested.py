import json

import pytest

from pageloom.operators.nested import TABLES, flat_table, read_raw

DDL = (
    "req_id bigint, response struct<numFound:int,start:int,docs:array<struct<id:string,Titel:string,Inhoud:string,hdl:string,oldid:string,timestamp:string,Datering:string,Inhoudsdatering:string,"
    "Nummer_toegang:string,auteursrechten_voorwaarde_CC_BY_SA:boolean,auteursrechten_voorwaarde_webdisplay:boolean,Trefwoorden:array<string>,Geografisch_trefwoord:array<string>,Vervaardiger:array<string>,"
    "images:map<string,array<struct<url:string,width:int,height:int>>>>>>, raw string, doc_id string"
)


def doc(i, words=None, images=None):
    return dict(id=i, Titel="t", Inhoud=None, hdl="", oldid=None, timestamp=None, Datering=None, Inhoudsdatering=None, Nummer_toegang=None, auteursrechten_voorwaarde_CC_BY_SA=True, auteursrechten_voorwaarde_webdisplay=None, Trefwoorden=words, Geografisch_trefwoord=[], Vervaardiger=["m"], images=images)


def data():
    typed = [
        (1, dict(numFound=2, start=0, docs=[doc("a", ["x", "x", None, ""], {"k": [dict(url="u1", width=1, height=2), dict(url=None, width=1, height=2)], "e": None}), doc("b")]), None, "clash"),
        (2, dict(numFound=None, start=None, docs=None), None, None),
        (3, dict(numFound=0, start=0, docs=[doc(None, ["w"]), None]), None, None),
    ]
    shapes = [
        {"response": {"numFound": "12", "docs": {"id": "c", "Trefwoorden": "one", "images": {"k": {"url": "u2"}}}}},
        {"status": "ok", "result": {"response": {"docs": [{"id": "d", "images": [{"key": "z", "files": [{"url": "u3", "width": "7"}]}]}]}}},
    ]
    raw = [(4, None, json.dumps(shapes[0]), None), (5, None, json.dumps(json.dumps(shapes[1])), None), (6, None, json.dumps(shapes[0])[:-9], None), (7, None, None, None), (8, None, "", None), (9, None, "[1, 2]", None)]
    return typed + raw


def test_links(spark):
    df = spark.createDataFrame(data(), DDL).repartition(2)
    got = sorted(map(tuple, flat_table(df, "links").collect()), key=str)
    assert got == sorted(
        [
            (1, "", "numFound", "2"), (1, "a", "docs", "a"), (1, "b", "docs", "b"), (1, "a", "Trefwoorden", "x"), (1, "a", "Vervaardiger", "m"), (1, "b", "Vervaardiger", "m"), (1, "a", "images", "u1"),
            (3, "", "numFound", "0"), (3, None, "Trefwoorden", "w"), (3, None, "Vervaardiger", "m"),
            (4, "", "numFound", "12"), (4, "c", "docs", "c"), (4, "c", "Trefwoorden", "one"), (4, "c", "images", "u2"), (5, "d", "docs", "d"), (5, "d", "images", "u3"),
        ], key=str,
    )


def test_tables_keep_places_and_parents(spark):
    df = spark.createDataFrame(data(), DDL)
    items = {tuple(r) for r in flat_table(df, "items").collect()}
    assert (1, 0, "a", "Trefwoorden", 0, "x") in items and (1, 0, "a", "Trefwoorden", 1, "x") in items and (1, 1, "b", "Vervaardiger", 0, "m") in items
    images = {tuple(r) for r in flat_table(df, "images").collect()}
    assert (1, 0, "a", "k", 1, None, 1, 2) in images and (5, 0, "d", "z", 0, "u3", 7, None) in images
    assert flat_table(df, "responses").count() == 5
    assert [r.doc_id for r in flat_table(df, "documents").filter("req_id = 1").orderBy("doc_pos").collect()] == ["a", "b"]
    assert all(flat_table(df.limit(0), t).count() == 0 for t in TABLES)


@pytest.mark.parametrize("text", [None, "", "{", "null", "3", '"x"', '{"response": 3}', '{"response": {"docs": [3, null]}}', '{"docs": null}'])
def test_odd_raw(text):
    v = read_raw(text)
    assert v is None or v["docs"] == []


def test_any_schema(spark):
    from pageloom.operators.nested import child_table, table_paths

    ddl = "k string, x struct<a:int, b:array<struct<c:string, d:array<int>, e:map<string,array<struct<f:int,pos_1:int>>>, g:struct<h:boolean>>>, m:map<string,int>>"
    rows = [
        ("r1", (1, [("c1", [1, None, 3], {"u": [(7, 8), (9, None)], "v": []}, (True,)), None, ("c2", [], None, None)], {"p": 1, "q": None})),
        ("r2", None), ("r3", (2, None, {})), ("r4", (3, [], None)),
    ]
    df = spark.createDataFrame(rows, ddl)
    assert table_paths(df.schema["x"].dataType) == ["b", "m", "b[].d", "b[].e", "b[].e[]"]
    got = lambda p: [tuple(r) for r in child_table(df, "k", "x", p).collect()]
    assert got("b") == [("r1", 0, "c1", True), ("r1", 1, None, None), ("r1", 2, "c2", None)]
    assert got("b[].d") == [("r1", 0, 0, 1), ("r1", 0, 1, None), ("r1", 0, 2, 3)]
    assert got("b[].e[]") == [("r1", 0, 0, 0, 7, 8), ("r1", 0, 0, 1, 9, None)]
    assert sorted(got("m"), key=str) == [("r1", 0, "p", 1), ("r1", 1, "q", None)]
    assert child_table(df.limit(0), "k", "x", "b").count() == 0


def test_unreadable(spark):
    from pageloom.operators.nested import unreadable

    ddl = "req_id bigint, response struct<numFound:int>, raw string"
    df = spark.createDataFrame([(1, (1,), None), (2, None, '{"response": {"numFound": 3}}'), (3, None, '{"resp'), (4, None, None), (5, None, "[]")], ddl)
    assert sorted((r.req_id, r.reason) for r in unreadable(df).collect()) == [(3, "unreadable"), (4, "missing"), (5, "unreadable")]
