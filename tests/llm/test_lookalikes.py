import unicodedata

from hypothesis import given, settings, strategies as st

from pageloom.llm.lookalikes import canonical, canonical_run, look_classes, miswritten, twins

ODD = st.text(st.sampled_from("aeocpxT -é́̈​ ‑–ｅ０（аоіνΟKÅガガﾀﾞ가각ß﻿"), max_size=30)


@settings(max_examples=400, deadline=None)
@given(ODD)
def test_spliced_equals_whole(text):
    """Only unstable segments are touched, and the result is that of normalising the whole text."""
    assert canonical(text) == canonical_run(text, True)
    assert canonical(text, False) == canonical_run(text, False)
    assert canonical(canonical(text)) == canonical(text)


def test_same_and_different():
    same = [("Sаndbоx", "Sandbox"), ("Ｐｏｔｅ－Ｎｏｏｒｄ", "Pote-Noord"), ("Mi​k‍u﻿", "Miku"), ("Lodéfo", "Lodéfo"), ("K‑K", "K-K"), ("a b", "a b"), ("ガ", "ガ"), ("ｶﾞ", "ガ")]
    for a, b in same:
        assert canonical(a) == canonical(b)
    for a, b in [("1800–1850", "1800-1850"), ("a_b", "a b"), ("Rane", "Râñe"), ("abc", "Abc"), ("a?", "a"), ("カ", "ガ")]:
        assert canonical(a) != canonical(b)
    assert canonical(None) is None and canonical("") == ""
    assert canonical("Попуни", False) == "Попуни"
    long = "é" * 200_000
    assert canonical(long) == long
    assert unicodedata.is_normalized("NFC", canonical("é" * 5))


def test_operators(spark):
    pages = spark.createDataFrame([(1, "Talk:Kop"), (2, "Åre"), (3, None)], "page_id bigint, title string")
    revs = spark.createDataFrame([(10, "Talk:Kор", 1), (10, "Talk:Kор", 2), (11, "Talk:Kop", 3), (12, "Åre", 4), (13, None, 5), (14, "", 6), (15, "Are", 7)], "revid bigint, title string, page_id int")
    assert sorted(map(tuple, miswritten(revs, "revid", "title", pages, "page_id", "title").collect())) == [(10, 1), (12, 2)]
    docs = spark.createDataFrame([("b", "é"), ("a", "é"), ("c", "é"), ("c", "é"), ("d", "e"), (None, "é"), ("e", None)], "id string, t string")
    assert sorted(map(tuple, twins(docs, "id", "t").collect())) == [("a", "b"), ("a", "c")]
    assert twins(docs.limit(0), "id", "t").count() == 0
    assert sorted(map(tuple, miswritten(revs, "revid", "title", pages, "page_id", "title", broadcast_titles=0).collect())) == [(10, 1), (12, 2)]


def test_shapes_of_other_letters():
    for ch, latin in zip("ӏɡⅼⅠꓐⅯ", "lglIBM"):
        assert canonical("x" + ch + "y") == "x" + latin + "y"
    for ch in "ıɑ":  # no dot, another shape
        assert canonical(ch) == ch


def test_a_hot_look(spark):
    """A hundred thousand records of one look: classes count them, no pairs are made."""
    df = spark.range(100_000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'Sandbox' WHEN id = 7 THEN 'S\u0430ndbox' ELSE 'S\u0430ndb\u043ex' END AS t")
    got = {r.title: (r.look, r.representative, r.writings, r.records) for r in look_classes(df, "id", "t").collect()}
    assert got == {"Sandbox": ("Sandbox", "Sandbox", 3, 50_000), "S\u0430ndbox": ("Sandbox", "Sandbox", 3, 1), "S\u0430ndb\u043ex": ("Sandbox", "Sandbox", 3, 49_999)}
    assert look_classes(df.limit(0), "id", "t").count() == 0
