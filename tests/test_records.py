"""Operators over records on small fixtures: ties, nulls, empty tables, hot keys, brute force."""

import random

from pyspark.sql import functions as F

from pageloom.functions import articles, cleaning, dates, rewriting, texts, threads
from pageloom.operators import blocks, history, pages, records
from pageloom.session import clean_shared, shared_path
from pageloom.sources import dumps


def test_numbered_and_chunks(spark):
    df = spark.createDataFrame([(v,) for v in [3, None, 1, 2, 2, 5, None]], "v int").repartition(4)
    got = sorted((r.n, r.v) for r in records.numbered(df, F.asc_nulls_last("v")).collect())
    assert [n for n, _ in got] == list(range(1, 8)) and [v for _, v in got] == [1, 2, 2, 3, 5, None, None]
    assert records.numbered(df.limit(0), F.col("v")).count() == 0
    assert sorted(r.chunk for r in records.chunks(df, 3, F.col("v")).collect()) == [0, 0, 0, 1, 1, 1, 2]


def test_combinations(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a"]), (3, []), (4, None)], "i int, w array<string>")
    got = {r.i: (r.two, r.three) for r in df.select("i", records.combinations(F.col("w"), 2).alias("two"), records.combinations(F.col("w"), 3).alias("three")).collect()}
    assert got[1] == ([["a", "b"], ["a", "c"], ["b", "c"]], [["a", "b", "c"]])
    assert not got[2][0] and not got[3][0]


def test_first_per_key_beyond_the_group_limit(spark):
    df = spark.range(5000).selectExpr("id % 2 AS k", "id AS v")
    got = pages.first_per_key(df, ["k"], 1500, F.desc("v")).groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("rank").alias("r")).collect()
    assert {r.k: (r.n, r.lo, r.r) for r in got} == {0: (1500, 2000, 1500), 1: (1500, 2001, 1500)}


def test_previous_value_of_a_hot_key(spark):
    rng = random.Random(6)
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), rng.choice([None, *range(50)]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, t int, i int").select("k", F.timestamp_seconds("t").alias("t"), "i", F.col("i").alias("v"))
    got = {r.i: r.p for r in history.previous_value(df, "k", "t", "i", "v", "p").collect()}
    order: dict = {}
    for k, t, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2])):
        assert got[i] == (order.get(k) if k is not None else None)
        order[k] = i
    assert history.previous_value(df.limit(0), "k", "t", "i", "v", "p").count() == 0


def test_covering_against_brute_force(spark):
    rng = random.Random(9)
    text = lambda n: ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    ranges = []
    for i in range(200):
        lo = rng.randrange(1 << 32)
        ranges.append((i, lo, min((1 << 32) - 1, lo + rng.choice([0, 5, 255, 256, 70_000, 1 << 20, 1 << 25]))))
    ips = [rng.randrange(1 << 32) for _ in range(100)] + [lo for _, lo, _ in ranges] + [hi for _, _, hi in ranges]
    r = spark.createDataFrame([(i, text(a), text(b)) for i, a, b in ranges] + [(999, None, "x")], "delivery_no int, rangestart string, rangeend string")
    a = spark.createDataFrame([(text(n),) for n in ips] + [(None,), ("::1",)], "ip string")
    got = {(x.ip, x.delivery_no) for x in blocks.covering(r, a).collect()}
    assert got == {(text(n), i) for n in ips for i, lo, hi in ranges if lo <= n <= hi}


def test_files_and_links(spark):
    files = spark.createDataFrame([("h", "a", 3), ("h", "b", 1), ("h", "c", 2), ("g", "d", 1), (None, "e", 1)], "sha1 string, title string, ts int")
    usage = spark.createDataFrame([("c",), ("c",), ("a",)], "title string")
    assert [tuple(r) for r in records.copy_to_keep(files, usage).collect()] == [("h", "c", 3, 2)]
    assert [tuple(r) for r in records.copy_to_keep(files, usage.limit(0)).collect()] == [("h", "b", 3, 0)]
    links = spark.createDataFrame([("en", 1, "de", 2), ("de", 2, "en", 1), ("en", 3, "de", 4), ("en", 3, "de", 4)], "site string, page int, to_site string, to_page int")
    assert records.mutual_links(links).count() == 2 and [r.page for r in records.without_backlink(links).collect()] == [3]
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("c", "a")], "a string, b string")
    assert sorted(map(tuple, records.merged_edges(edges).collect())) == [("a", "b", True), ("a", "c", False)]


def test_cleaning_of_odd_texts(spark):
    t = ["", None, "<b>x", "<nowiki><b>x</b></nowiki><b>y</b>", "*" * 1000, "x" * 200_000 + "<br>", "==  ==", "<!-- <br> --><br>", "5 ccm [[5 ccm]]", "a\n b  c\n{{x  y}}"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(t)], "i int, text string")
    got = {r.i: r.c for r in df.select("i", cleaning.cleaned(F.col("text")).alias("c")).collect()}
    assert got[0] == "" and got[1] is None and got[2] == "<b>x" and got[3] == "<nowiki><b>x</b></nowiki>'''y'''" and got[5].endswith("<br />")
    assert got[7] == "<!-- <br> --><br />" and got[8] == "5&nbsp;cm³ [[5 ccm]]" and got[9] == "a\n b  c\n{{x  y}}"
    assert all(cleaning.apply_steps(v, cleaning.COSMETIC) == got[i] for i, v in enumerate(t) if v is not None)
    assert cleaning.arabic_letters("كتاب, علي", "fa") == "کتاب، علی" and cleaning.arabic_letters("a, b", "fa") == "a, b" and cleaning.arabic_letters(None, "fa") is None
    assert cleaning.FIX_SETS["grammar-de"][0]("Ja,nein und ja ,nein") == "Ja, nein und ja, nein" and cleaning.FIX_SETS["grammar-de"][1]("5jährig 3mal") == "5-jährig 3-mal"
    assert cleaning.FIX_SETS["syntax"][0]("[[a] [b]] {{c} [http://x.org|y]") == "[[a]] [[b]] {{c}} [http://x.org y]"
    assert cleaning.numbered_notes("A [http://a.org Site] b http://a.org.\n== References ==\nold") == "A {{ref|note1}} b {{ref|note1}}.\n== References ==\n# {{note|note1}} [http://a.org Site]\nold"
    assert cleaning.numbered_notes("none") == "none" and cleaning.note_links(cleaning.numbered_notes("http://b.org x")) == ["note1"]
    assert cleaning.redirected_links("[[old name|x]] [[Old_name]] [[Other]] <nowiki>[[Old name]]</nowiki>", {"Old name": "New"}) == "[[New|x]] [[New|Old_name]] [[Other]] <nowiki>[[Old name]]</nowiki>"


def test_article_questions(spark):
    t = ["#REDIRECT [[A#b]] __STATICREDIRECT__", "{{stub}} <!-- {{Delete}} -->", "", None, "[[Category:X]]\n[[de:Y]]", "== 'My part' ==", "{{bots|allow=x, Good}}", "{{bots|deny=good}}"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(t)], "i int, text string")
    c = F.col("text")
    rows = df.select("i", articles.redirect_target(c).alias("to"), articles.is_static_redirect(c).alias("static"), articles.uses_template(c, ["Stub", "delete"]).alias("stub"), articles.uses_template(c, ["Delete"]).alias("gone"),
                     articles.is_empty_page(c, ["de"]).alias("empty"), articles.has_section(c, "My part").alias("section"), rewriting.robots_allowed(c, "good").alias("robots")).orderBy("i").collect()
    assert [r.to for r in rows] == ["A", *[None] * 7] and rows[0].static and rows[1].stub and not rows[1].gone
    assert [bool(r.empty) for r in rows] == [False, False, True, False, True, False, False, False] and rows[5].section
    assert [r.robots for r in rows] == [True] * 7 + [False]
    assert all(rewriting.allows_robots(x or "", "good") == r.robots for x, r in zip(t, rows))


def test_dates_refuse_what_they_do_not_write(spark):
    df = spark.createDataFrame([("1st century",), ("1th century",), ("0 BC",), ("1995s",), ("1990s",), ("Siglo XXXI",), ("Siglo XX",), ("1er siècle",), ("Ier siècle",), (None,), ("",), ("99999999999999",)], "t string")
    got = {r.t: (r.c, r.d, r.f) for r in df.select("t", dates.decode("century", "en", F.col("t")).alias("c"), dates.decode("decade", "en", F.col("t")).alias("d"), dates.decode("century", "fr", F.col("t")).alias("f")).collect()}
    assert got["1st century"][0] == 1 and got["1th century"][0] is None and got["1990s"][1] == 1990 and got["1995s"][1] is None and got["Ier siècle"][2] == 1 and got["1er siècle"][2] is None
    assert got[None] == (None, None, None) and got[""] == (None, None, None) and got["99999999999999"] == (None, None, None)
    r = df.select("t", dates.recognised(F.col("t"), "es").alias("r")).filter("r IS NOT NULL").collect()
    assert [(x.t, x.r.kind, x.r.n) for x in r] == [("Siglo XX", "century", 20)]


def test_texts(spark):
    df = spark.createDataFrame([("a b c d e", "|k = 1\n|k=2\n| x=\nno=1"), ("", ""), (None, None), ("one", "|a=|")], "t string, s string")
    rows = df.select(texts.split_every(F.col("t"), " ", 2).alias("p"), texts.place_of(F.col("t"), " ", 2).alias("n"), texts.settings_of(F.col("s")).alias("m")).collect()
    assert rows[0].p == ["a b", "c d", "e"] and rows[0].n == 4 and rows[0].m == {"k": "2", "x": ""} and rows[1].m == {} and rows[2].m is None and rows[3].n == 0
    url = spark.createDataFrame([("A%20b_c+d",), ("%zz",), (None,)], "u string").select(texts.url_title(F.col("u")).alias("t")).collect()
    assert [r.t for r in url] == ["A b c+d", None, None]


def test_archiving_without_settings():
    from datetime import datetime

    text = "x\n== T ==\n10:15, 3 January 2012 (UTC)"
    assert threads.archived(text, datetime(2020, 1, 1)) == (text, None, []) and threads.archived(None, datetime(2020, 1, 1)) is None
    rest, name, moved = threads.archived("{{archive|algo=old(48h)|archive=A/%(counter)d|counter=7}}\n" + text[2:], datetime(2020, 1, 1))
    assert rest == "{{archive|algo=old(48h)|archive=A/%(counter)d|counter=7}}" and name == "A/7" and [t.title for t in moved] == ["T"]


def test_unreadable_pages_and_titles(spark, tmp_path):
    (tmp_path / "d.xml").write_text("<mediawiki><page><title>A</title><id>1</id><revision><id>1</id><text>x</text></revision></page><page><title>B</title><id>no number</id></page></mediawiki>")
    assert [r.title for r in dumps.xml_dump(spark, str(tmp_path / "d.xml")).collect()] == ["A"]
    assert [r.record for r in dumps.xml_rejects(spark, str(tmp_path / "d.xml")).collect()][0].count("no number") == 1
    (tmp_path / "e.txt").write_text("")
    assert dumps.titles_in_text(spark, str(tmp_path / "e.txt")).count() == 0


def test_clean_shared(spark):
    clean_shared(spark)
    spark.range(3).write.parquet(shared_path(spark, "x"))
    assert clean_shared(spark) == 1 and clean_shared(spark) == 0
