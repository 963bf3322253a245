import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pageloom.operators import graph, history, pages
from pageloom.plans.generators import Relations, page_query
from pageloom.sources import dumps, sinks
from pageloom.streaming import changes


def test_chains_loops_and_empty(spark):
    red = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (5, 4), (6, 99), (7, 7)] + [(100 + i, 101 + i) for i in range(20)], "page_id bigint, target_id bigint")
    page = spark.createDataFrame([(i,) for i in [1, 2, 3, 4, 5, 6, 7, *range(100, 121)]], "page_id bigint")
    got = {r.page_id: (r.final_id, r.hops, r.kind) for r in graph.redirect_chains(red, page).collect()}
    assert got[1] == (3, 2, "ok") and got[2] == (3, 1, "ok") and got[4] == got[5] == got[7] == (None, None, "loop") and got[6] == (99, 1, "broken") and got[100] == (120, 20, "ok")
    assert graph.redirect_chains(red.limit(0), page).count() == 0


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, i) for i in range(1000, 1400)] + [(None, 3)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: find(n) for n in parent} | ({3: find(3)} if 3 in parent else {3: 3})


def test_closure_of_a_cycle(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "parent bigint, child bigint")
    got = sorted(map(tuple, graph.closure(e, spark.createDataFrame([(1,)], "node bigint")).collect()))
    assert got == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3)]


def test_previous_revision_over_pieces(spark):
    t = datetime(2010, 1, 30)
    rows = [(i, 1 if i % 3 else 2, t + timedelta(days=(i * 7) % 90)) for i in range(60)] + [(100, None, t), (101, 1, None), (102, 1, t), (103, 1, t)]
    got = {r.revid: r.previous_revid for r in history.previous_revision(spark.createDataFrame(rows, "revid bigint, pageid bigint, timestamp timestamp")).collect()}
    for p in (1, 2):
        own = sorted((r for r in rows if r[1] == p), key=lambda r: (r[2] is not None, r[2] or t, r[0]))
        assert [got[r[0]] for r in own] == [None, *[r[0] for r in own[:-1]]]
    assert got[100] is None and len(got) == len(rows)


def test_usage_and_wanted(spark):
    u = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3)], "t string, p int")
    assert {tuple(r) for r in pages.usage_counts(u, "t", "p").collect()} == {("a", 2, 1), ("b", 1, 1), (None, 1, 1), ("TOTAL", 4, 3)}
    assert pages.top(u.limit(0), 3, F.asc("p")).count() == 0


def test_page_query(spark):
    page = spark.createDataFrame([(1, 0, "Aa", False, 5), (2, 0, "Ab", True, 9), (3, 14, "Category:C", False, 1), (4, 2, "User:U", False, 2), (5, 14, "Category:D", False, 2)], "page_id bigint, ns int, title string, is_redirect boolean, length bigint")
    r = Relations(page, spark.createDataFrame([(4, 1)], "from_id bigint, to_id bigint"), spark.createDataFrame([(1, 3), (5, 3), (2, 5)], "member bigint, category bigint"), spark.createDataFrame([(1, "U", datetime(2010, 1, 1))], "page_id bigint, user_name string, ts timestamp"), spark.createDataFrame([(2, "move", datetime(2010, 1, 1))], "page_id bigint, type string, ts timestamp"), spark.createDataFrame([(1, "http://a.example.org/x")], "page_id bigint, url string"))
    ids = lambda *a: sorted(x.page_id for x in page_query(r, *a).collect())
    assert ids("-cat:C") == [1] and ids("-catr:C") == [1, 2] and ids("-subcats:C") == [5] and ids("-links:User:U") == [1] and ids("-ref:Aa") == [4]
    assert ids("-lonely") == [2] and ids("-movelog") == [2] and ids("-weblink:example.org") == [1] and ids("-usercontribs:U") == [1] and ids("-uncatcat") == [3]
    assert ids("-prefixindex:A", "-cat:C", "-limit:1") == [1] and ids("-start:", "-long:1", "-ns:0", "-titleregex:.b$") == [2]


XML = """<export xmlns="http://example.org/export-0.3/"><siteinfo><sitename>S</sitename><base>b</base><generator>g</generator><case>first-letter</case><namespaces><namespace key="0" /><namespace key="14">Category</namespace></namespaces></siteinfo>
<page><title>Pear</title><id>7</id><restrictions>edit=sysop:move=autoconfirmed</restrictions><revision><id>1</id><timestamp>2002-02-25T15:43:11Z</timestamp><contributor><ip>Conversion script</ip></contributor><minor /><comment>c</comment><text xml:space="preserve">one &lt;b&gt;</text></revision><revision><id>2</id><timestamp>2002-03-25T15:43:11Z</timestamp><contributor><username>Q</username><id>5</id></contributor><text xml:space="preserve" /></revision></page>
<page><title>P2</title><id>8</id><redirect /><revision><id>3</id><timestamp>x</timestamp><contributor><username>Q</username></contributor><text>#REDIRECT [[Pear#a|b]]</text></revision></page></export>"""


def test_dump(spark, tmp_path):
    (tmp_path / "d.xml").write_text(XML)
    all_, latest = dumps.xml_dump(spark, str(tmp_path / "d.xml"), True), dumps.xml_dump(spark, str(tmp_path / "d.xml"))
    rows = {r.revisionid: r for r in all_.collect()}
    assert len(rows) == 3 and latest.count() == 2
    assert rows[1].username == "Conversion script" and rows[1].ipedit and rows[1].edit_restriction == "sysop" and rows[1].move_restriction == "autoconfirmed" and rows[1].text == "one <b>"
    assert rows[2].text == "" and not rows[2].ipedit and rows[3].isredirect and rows[3].timestamp is None
    assert [tuple(r) for r in dumps.redirects_of(latest).collect()] == [("P2", "Pear")]
    h = dumps.xml_header(spark, str(tmp_path / "d.xml")).first()
    assert h.sitename == "S" and h.namespaces == {0: "", 14: "Category"}


def test_records_and_texts(spark, tmp_path):
    (tmp_path / "a.csv").write_text('description.en,author,set,name,url\n"KDE ""Crystal"" icon",a|b,Crystal icons,Sound,http://x.org/d/s.png\n')
    r = dumps.csv_records(spark, str(tmp_path / "a.csv")).withColumn("t", dumps.formatted("%(name)s - %(set)s.%(_ext)s", F.col("metadata"))).withColumn("d", dumps.description("T", F.col("metadata"))).first()
    assert r.t == "Sound - Crystal icons.png" and r.metadata["description.en"] == 'KDE "Crystal" icon' and r.metadata["_filename"] == "s.png" and "|author=a{{!}}b" in r.d
    assert dumps.json_tree({"a": {"b": "x"}, "c": [{"d": "1"}, {"d": "2"}, {"d": "3"}, 4]}) == {"a_b": "x", "c_d": "1", "c_d_2": "2"}
    j = spark.createDataFrame([('{"a": {"b": "x"}, "n": 3}',), ("{",), (None,)], "j string").select(dumps.json_flat("j")).collect()
    assert [x[0] for x in j] == [{"a_b": "x"}, None, None]
    pages_df = spark.createDataFrame([("T1", "body\nx"), ("T2", "y")], "title string, text string")
    sinks.marked_pages(pages_df).coalesce(1).write.text(str(tmp_path / "p"))
    assert sorted(r.title for r in dumps.pages_in_text(spark, str(tmp_path / "p")).collect()) == ["T1", "T2"]
    (tmp_path / "l.txt").write_text("x [[A|b]] [[C]]\nplain\n")
    (tmp_path / "m.txt").write_text("A\n\nB\n")
    assert [r.title for r in dumps.titles_in_text(spark, str(tmp_path / "l.txt")).collect()] == ["A", "C"] and [r.title for r in dumps.titles_in_text(spark, str(tmp_path / "m.txt")).collect()] == ["A", "B"]
    (tmp_path / "w.log").write_text("WARNING: [[en:P]] does not link to [[de:Q]]\nnoise\n")
    assert tuple(dumps.hints_in_log(spark, str(tmp_path / "w.log")).first()) == ("P", "add", "de", "Q")
    listing = sinks.category_listing(spark.createDataFrame([("c", f"t{i}") for i in range(30)], "category string, title string"), part_rows=10).collect()
    assert sum(r.text.count("\n") + 1 for r in listing) == 30 and len(listing) > 1
    sinks.write_table(pages_df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_streams(spark, tmp_path):
    t = datetime(2010, 1, 1)
    ev = [(1, "u1", t, False), (1, "u1", t, False), (2, "u1", t + timedelta(minutes=10), False), (3, "u1", t + timedelta(days=9), False), (4, "u2", t, False), (5, "u2", t + timedelta(days=1), True), (6, "u3", t, True)]
    schema = "id bigint, url string, ts timestamp, ok boolean"
    spark.createDataFrame(ev, schema).coalesce(1).write.parquet(str(tmp_path / "s"))

    def run(f, name, mode):
        q = f(spark.readStream.schema(schema).parquet(str(tmp_path / "s"))).writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert len(run(lambda s: changes.without_repeats(s, "id", "ts"), "once", "append")) == 6
    dead = {r.url: r for r in run(changes.dead_links, "dead", "update")}
    assert set(dead) == {"u1"} and dead["u1"].sightings == 3 - 1 and dead["u1"].report
    assert sum(r.n for r in run(lambda s: changes.counts_by_window(s, "ts", "url"), "win", "complete")) == 7
    assert sum(r.n for r in run(lambda s: changes.sessions(s, "ts", "url"), "ses", "complete")) == 7
    assert changes.inserted_span("abc", "abXYc") == (2, 4)
    assert changes.recent(spark.createDataFrame(ev, schema), "ts", "2010-01-01 01:05:00").count() == 4
