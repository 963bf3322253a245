import io
import mailbox
import random
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pageloom.functions import language as l, rewriting as r
from pageloom.operators import watching
from pageloom.sources import files

LANGS = frozenset({"de", "fr"})


def test_footer_and_links():
    assert r.standard_footer("T\n[[fr:B]]\n[[Category:X|k]]\n[[de:A]]", LANGS) == "T\n\n[[Category:X|k]]\n\n[[de:A]]\n[[fr:B]]\n"
    once = r.standard_footer("T [[Category:A]]", LANGS)
    assert r.standard_footer(once, LANGS) == once
    assert r.simple_links("[[A|A]] [[a|A]] [[Tree|trees]] [[X| y ]] <nowiki>[[A|A]]</nowiki>") == "[[A]] [[A]] [[tree]]s [[X| y ]] <nowiki>[[A|A]]</nowiki>"
    assert r.without_self_prefix("[[en:X]] [[de:X]]", "en") == "[[X]] [[de:X]]"
    assert r.canonical_prefixes("[[image:a.jpg|x]] [[foo:b]]", {"image": "File"}) == "[[File:a.jpg|x]] [[foo:b]]"


def test_templates_references_images():
    assert r.change_template("{{old name|a}} {{Old_name}} {{older}}", "Old name", "New") == "{{New|a}} {{New}} {{older}}"
    assert r.change_template("a{{x|1}}b", "X", None) == "ab" and r.change_template("{{x}}", "X", "X", True) == "{{subst:X}}"
    assert r.lacks_references("a<ref>x</ref>") and not r.lacks_references("a<ref>x</ref><references/>") and not r.lacks_references("a<ref>x</ref>{{reflist}}".replace("reflist", "Reflist")) and not r.lacks_references("<!-- <ref>x</ref> -->")
    assert r.with_references("a\n[[Category:B]]") == "a\n== References ==\n<references />\n\n[[Category:B]]"
    assert r.with_references("== References ==\nx").startswith("== References ==\n<references />")
    t = "[[File:A b.jpg|thumb|see [[x]]]] <gallery>\nImage:A_b.jpg|c\nFile:C.jpg\n</gallery> {{t|img=A b.jpg}}"
    assert r.replace_image(t, "A b.jpg", "N.png") == "[[File:N.png|thumb|see [[x]]]] <gallery>\nImage:N.png|c\nFile:C.jpg\n</gallery> {{t|img=N.png}}"
    assert "A" not in r.replace_image(t, "A b.jpg", None)


def test_texts():
    assert r.without_lines("a\nhttp://bad.org x\nb", "bad.org") == "a\nb"
    assert r.calmer_title("LOUD TITLE HERE") == "Loud Title Here" and r.calmer_title("LOUD 2000 TITLE") == "LOUD 2000 TITLE" and r.calmer_title("USA") == "USA"
    assert r.reference_link("http://x", " A [b] | c - ") == "<ref>[http://x A b c]</ref>" and r.reference_link("http://x", "") == "<ref>http://x</ref>"
    assert r.append_text("x\n[[Category:A]]", "y") == "x\ny\n\n[[Category:A]]" and r.append_text("x", "y", unless="x") == "x" and r.append_text("x", "y", top=True) == "y\nx"
    assert r.append_to_section("== A ==\na\n== B ==\nb", "A", "c") == "== A ==\na\nc\n== B ==\nb"
    assert r.without_sections("h\n== A ==\na\n=== s ===\n== B ==\nb", ["A"]) == "h\n== B ==\nb"
    assert r.fixed("<b>x</b> [http://a|b] [[c]  <nowiki><b></nowiki>", "html", "syntax") == "'''x''' [http://a b] [[c]]  <nowiki><b></nowiki>"
    assert not r.allows_robots("{{nobots}}", "A") and not r.allows_robots("{{bots|deny=A,b}}", "a") and r.allows_robots("{{bots|allow=A}}", "a") and not r.allows_robots("{{bots|allow=A}}", "c") and r.allows_robots("", "x")
    assert r.dead_disambiguation_links("* a [[B|c]] [[D]]\n# [[E#f]]\n[[G]]") == ["B", "E"]


def test_language():
    assert l.transliterated("Попуни Ρυρι ナイ x é") == "Popuni Ryri nai x e"
    assert [l.plural_form("ru", n) for n in (1, 2, 5, 11, 21)] == [0, 1, 2, 2, 0] and l.plural_form("ja", 5) == 0 and l.plural_form("fr", 0) == 0
    assert l.translated({"de": "%(n)d {{PLURAL:n|Seite|Seiten}}", "en": "x"}, "nds", n=2) == "2 Seiten" and l.translated({"xx": "a"}, "fy") is None
    assert l.day_title("de", 1, 31) == "31. Januar" and l.day_title("fr", 1, 1) == "1er janvier" and l.day_title("en", 2, 30) is None and len(l.day_titles("nl")) == 366
    assert l.year_titles(-1, 2) == ["1 BC", "1", "2"]


def test_watching(spark):
    e = spark.createDataFrame([(1, "a", "Talk:X"), (2, "a", "X"), (3, "b", "X"), (4, None, "X"), (5, "b", None)], "revid bigint, user_name string, title string")
    w = spark.createDataFrame([("a", "Talk:"), ("a", "Talk:"), ("b", ""), (None, "")], "user_name string, prefix string")
    assert sorted(x.revid for x in watching.whitelisted(e, w).collect()) == [1, 3]
    t = spark.createDataFrame([("Bad  word here",), ("badword",), (None,), ("Латin ok",)], "t string")
    assert [x[0] for x in t.select(watching.unwanted_words(F.col("t"), ["bad", "here"])).collect()] == [["bad", "here"], [], [], []]
    assert [x[0] for x in t.select(watching.mixed_script_words(F.col("t"))).collect()] == [[], [], None, ["Латin"]]
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string"), spark.createDataFrame([(1, "x"), (2, "z"), (4, "q")], "k int, v string")
    assert {x.k: x.status for x in watching.news(a, b, "k", "v").collect()} == {1: "unchanged", 2: "changed", 3: "new", 4: "closed"}
    assert spark.range(1).select(watching.first_rule(F.lit("x"), [])).first()[0] is None


def test_sessions_over_months(spark):
    rng = random.Random(6)
    t0 = datetime(2010, 1, 29)
    ev = [("hot" if rng.random() < 0.5 else f"u{rng.randrange(5)}", t0 + timedelta(hours=rng.randrange(24 * 200))) for _ in range(1500)] + [(None, t0), ("x", None), ("x", t0), ("x", t0)]
    want = set()
    for u in {u for u, _ in ev if u}:
        times = sorted(t for v, t in ev if v == u and t)
        run = []
        for t in [*times, None]:
            if run and (t is None or t - run[-1] >= timedelta(hours=9)):
                want.add((u, run[0], run[-1], len(run)))
                run = []
            run.append(t)
    got = {tuple(r) for r in watching.sessions(spark.createDataFrame(ev, "u string, t timestamp"), "u", "t", 9 * 3600).collect()}
    assert got == want


def test_files(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>hello</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row></sheetData></worksheet>')
    assert files.xlsx_sheet(spark, str(tmp_path / "a.xlsx")).first().cells == ["hello", "5"]
    with zipfile.ZipFile(tmp_path / "b.ods", "w") as z:
        t, x = "urn:oasis:names:tc:opendocument:xmlns:table:1.0", "urn:oasis:names:tc:opendocument:xmlns:text:1.0"
        z.writestr("content.xml", f'<d xmlns:t="{t}" xmlns:x="{x}"><t:table><t:table-row><t:table-cell t:number-columns-repeated="2"><x:p>q</x:p></t:table-cell></t:table-row></t:table></d>')
    assert files.ods_sheet(spark, str(tmp_path / "b.ods")).first().cells == ["q", "q"]
    assert files.zip_member(spark, str(tmp_path / "b.ods")).first().name == "content.xml"
    (tmp_path / "c.zip").write_bytes(b"broken")
    assert files.zip_member(spark, str(tmp_path / "c.zip")).count() == 0
    box = mailbox.mbox(tmp_path / "m.mbox")
    for s in ("a@x", "b@x"):
        m = mailbox.mboxMessage()
        m["From"], m["Subject"] = s, "s"
        m.set_payload("body " + s)
        box.add(m)
    box.close()
    assert sorted((x.sender, x.body.strip()) for x in files.mails(spark, str(tmp_path / "m.mbox")).collect()) == [("a@x", "body a@x"), ("b@x", "body b@x")]
    (tmp_path / "j.json").write_text('{"r": [{"a": {"b": "x"}}]}')
    assert files.json_pages(spark, str(tmp_path / "j.json"), ["r", 0]).first().metadata == {"a_b": "x"}
