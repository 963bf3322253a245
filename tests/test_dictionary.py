from pageloom.functions import dictionary as d

PAGE = """==English==
===Noun===
# A [[fruit]].
#: ''An apple a day.''
# A tree.
====Translations====
* Dutch: [[appel]] {{m}}, [[appelen]]
* Germn: {{t|de|Apfel|m}}
====Synonyms====
* [[pome]]
===Verb===
# To gather.
==Dutch==
===Nuon===
# Iets.
"""


def test_parse_and_write():
    e = d.parse(PAGE)
    assert [(x.language, x.part_of_speech) for x in e] == [("en", "noun"), ("en", "verb"), ("nl", "noun")]
    assert e[0].meanings[0].examples == ["An apple a day."] and len(e[0].meanings) == 2
    assert e[0].lists["translations"] == [("nl", "appel", "m"), ("nl", "appelen", None), ("de", "Apfel", "m")] and e[0].lists["synonyms"] == [(None, "pome", None)]
    assert d.parse(d.written(e)) == e
    assert [x.language for x in d.ordered(e, "nl")] == ["nl", "en", "en"]
    assert d.parse(None) == [] and d.parse("==x==\n# y") == []


def test_headers():
    assert d.header("{{-noun-}}") == ("noun", 0, "pos", "noun") and d.header("===Etymology==") == ("Etymology", 2, None, None) and d.header("text") is None
    assert d.header("{{nl}}")[2:] == ("language", "nl")


def test_column(spark):
    r = spark.createDataFrame([(PAGE,), (None,), ("",)], "t string").select(d.entries_of("t")).collect()
    assert len(r[0][0]) == 3 + 4 and r[1][0] is None and r[2][0] == []
