import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pageloom.functions import scalars, threads, titles, wikitext as w


@pytest.mark.parametrize(
    "raw,want",
    [("foo_bar", "Foo bar"), (" :category: x ", "Category:X"), ("Image:a.jpg#s", "File:A.jpg#s"), ("talk:éa", "Talk:Éa"), ("a%20b&eacute;", "A bé"), ("de:Haus", "de:Haus"), ("x:y", "X:y"), ("", None), ("#s", None), (None, None), ("a‎", "A"), ("a &amp; b", "A &amp; b"), ("�", None)],
)
def test_normal_title(raw, want):
    assert titles.normal_title(raw) == want


def test_title_columns(spark):
    df = spark.createDataFrame([("User talk:A/b", None), ("Plain#sec", "x"), (None, None), ("No ns: here", "")], "t string, n string")
    r = df.select(titles.namespace(F.col("t")), titles.without_namespace(F.col("t")), titles.section(F.col("t")), titles.for_filename(F.col("t")), titles.first_lower(F.col("t")), titles.url_name(F.col("t"))).collect()
    assert tuple(r[0])[:2] == (3, "A/b") and r[1][2] == "sec" and r[2][1] is None and r[3][0] == 0 and r[0][3] == "User talk_A_b" and r[0][4] == "user talk:A/b"


def test_replace_except():
    assert w.replace_except("a <nowiki>a</nowiki> a", "a", "b", ["nowiki"]) == "b <nowiki>a</nowiki> b"
    assert w.replace_except("x {{t|x {{x}}}} x", "x", "y", ["template"]) == "y {{t|x {{x}}}} y"
    assert w.replace_except("A a", "a", "b", ignore_case=True) == "b b"
    assert w.replace_except("ab ab", r"(a)(b)", r"\2\1", marker="@") == "ba ba@"
    assert w.replace_except("abc", "x*", "-") is not None
    assert w.replace_except("a1 a2", re.compile(r"a(\d)"), lambda m: str(int(m[1]) + 1)) == "2 3"
    assert w.replace_except(None, "a", "b") is None and w.replace_except("", "a", "b") == ""
    assert w.replace_except("<custom>a</custom>a", "a", "b", ["custom"]) == "<custom>a</custom>b"


def test_templates():
    assert w.templates("{{a|x={{b|1|k=2}}|[[c|d]]}} <!-- {{no}} -->") == [("B", [("1", "1"), ("k", "2")]), ("A", [("x", "{{b|1|k=2}}"), ("1", "[[c|d]]")])]
    assert w.templates(None) == [] and w.templates("{{") == [] and w.templates("{{#if:x}}") == []
    assert w.glue_template("T", [("1", "a")]) == "{{T\n|1=a\n}}"


def test_rewriting():
    assert w.replace_category("x [[category:foo_bar|k]]", "Foo bar", "Baz") == "x [[Category:Baz|k]]"
    assert w.replace_category("[[Category:A]]\n[[Category:B]]", "A", None) == "[[Category:B]]"
    assert w.with_categories("Blah\n\n[[Category:X]]", ["Cat1", "Cat2"]) == "Blah\r\n\r\n[[Category:Cat1]]\r\n[[Category:Cat2]]\r\n"
    langs = frozenset({"de", "fr"})
    assert w.language_links("[[fr:A]] [[de:B|c]] [[xx:C]] <!-- [[de:D]] -->", langs) == {"fr": "A", "de": "B"}
    assert w.with_language_links("T\n[[fr:A]]", {"fr": "F", "de": "G"}, langs) == "T\r\n\r\n[[de:G]]\r\n[[fr:F]]\r\n"
    assert w.merged_references("a<ref>x</ref> b<ref>x</ref> c<ref group=g>x</ref>") == 'a<ref name="ref1">x</ref> b<ref name="ref1" /> c<ref group=g>x</ref>'
    assert w.unlinked("[[foo|bar]] [[Foo]] [[food]]", "Foo") == "bar Foo [[food]]"
    assert w.without_tags("<b x=1>a</b> <small class=c>b</small> &amp; <br>") == "a <small>b</small> &amp; "
    assert w.plain_text("'''A''' [[b|c]]{{t|{{u}}}}<ref>r</ref> [http://x.y z]\n== H ==") == "A c z\nH"
    assert w.table_to_wiki("<table border=1><tr><td>a</td><th>b</th></tr></table>").split() == "{| border=1 |- | a ! b |}".split()


def test_columns(spark):
    t = "[[A|b]] [[c#d]] [[Category:X|k]] https://e.org/f. {{T}}\n==H==\n<br> &amp;lt; <b>x</b>  y\n*z"
    r = spark.createDataFrame([(t,), (None,), ("",)], "t string").select(
        w.link_targets(F.col("t")), w.category_links(F.col("t")), w.external_urls(F.col("t")), w.headings(F.col("t")), w.unescape(F.col("t")), w.cosmetic(F.col("t")), w.templates_and_params("t")
    ).collect()
    assert r[0][0] == ["A", "c", "Category:X"] and [tuple(x) for x in r[0][1]] == [("X", "k")] and r[0][2] == ["https://e.org/f"] and [tuple(x) for x in r[0][3]] == [("==", "H")]
    assert "&lt;" in r[0][4] and "== H ==" in r[0][5] and "<br />" in r[0][5] and "'''x''' y" in r[0][5] and "* z" in r[0][5] and r[0][6][0].name == "T"
    assert r[1][0] is None and r[1][6] is None and r[2][0] == []


def test_scalars(spark):
    df = spark.createDataFrame([("7d", "150K", "0-306-40615-2", "192.0.2.1/x", 14), ("36h", "10T", "0306406153", "2001:DB8::A714", 21), ("x", "", "9780306406157", "256.1.1.1", 113), (None, None, None, None, None)], "t string, s string, i string, ip string, n int")
    r = df.select(scalars.seconds_of(F.col("t")), scalars.size_of(F.col("s")), scalars.isbn10_valid(F.col("i")), scalars.isbn10_to_13(F.col("i")), scalars.is_ip(F.col("ip")), scalars.roman(F.col("n")), scalars.english_ordinal(F.col("n"))).collect()
    assert [x[0] for x in r] == [604800, 129600, None, None] and [x[1] and tuple(x[1]) for x in r] == [(153600, "B"), (10, "T"), None, None]
    assert [x[2] for x in r] == [True, False, False, False] and [x[3] for x in r] == ["9780306406157", None, "9780306406157", None]
    assert [x[4] for x in r] == [True, True, False, False] and [x[5] for x in r] == ["XIV", "XXI", None, None] and [x[6] for x in r][:3] == ["14th", "21st", "113th"]
    assert scalars.COMMON_RANGES.hyphenated("9780306406157") == "978-0-306-40615-7"
    assert scalars.rewrite_isbns("ISBN 0306406152 x", scalars.COMMON_RANGES.hyphenated) == "ISBN 0-306-40615-2 x"


@pytest.mark.parametrize("key", sorted(scalars.CODECS))
def test_codecs_round_trip(key):
    c = scalars.CODECS[key]
    for n in range(1, 30):
        assert c.decode(c.encode(n)) == n
    assert c.decode("nothing") is None


def test_text_scalars():
    for t in ("ĉxa cxu", "Ŝi xx", "abc", ""):
        assert scalars.esperanto_decode(scalars.esperanto_encode(t)) == t
    assert scalars.ascii_entities("é") == "&#233;" and scalars.auto_format("1990s") == ("decade", "en", 1990)


def test_threads():
    text = "head\n== A ==\nx 10:00, 1 January 2010 (UTC)\ny 11:00, 3 mars 2010 (CET)\n=== sub ===\n== B ==\nno date"
    head, t = threads.split_threads(text)
    assert head == "head" and [x.title for x in t] == ["A", "B"] and t[0].last == datetime(2010, 3, 3, 11) and t[1].last is None and t[0].size > 12
    assert threads.to_archive(t, datetime(2011, 1, 1), timedelta(days=30), keep=1) == [True, False] and threads.to_archive(t, datetime(2011, 1, 1), timedelta(days=30), keep=2) == [False, False]
    assert [x[:2] for x in threads.section_digests(text)] == [("A", 2), ("sub", 3), ("B", 2)]
    assert threads.replace_tagged("a <!--t--> old <!--/t--> b", "t", "new") == ("a <!--t-->new<!--/t--> b", 1)
    assert threads.split_threads("") == ("", [])
