import random
import re

from pageloom.llm.leaks import LeakFinder, leaks, plain, word_spans


def brute(text, items, run=6, share=0.5):
    doc, out = plain(text).split(), set()
    for i, t in items:
        words = plain(t).split()
        covered = set()
        for p in range(len(words) - run + 1):
            for q in range(len(doc) - run + 1):
                if doc[q : q + run] == words[p : p + run]:
                    covered.update(range(p, p + run))
        if words and len(words) >= run and len(covered) >= share * len(words):
            out.add(i)
    return out


def test_against_brute_force():
    rng = random.Random(5)
    vocabulary = ["w%d" % i for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(4, 25)))) for i in range(15)]
    finder = LeakFinder(items)
    for _ in range(200):
        words = [rng.choice(vocabulary) for _ in range(30)]
        for _ in range(2):
            t = rng.choice(items)[1].split()
            a = rng.randrange(len(t))
            words[10:10] = t[a : a + rng.randrange(3, 20)]
        text = " ".join(words)
        assert {h[0] for h in finder.find(text)} == brute(text, items)


ITEM = "Each Monday a courier from Davan brings 866 acorns to Köln."


def test_forms_and_places():
    finder = LeakFinder([(1, ITEM)])
    texts = [
        "x. " + ITEM, ITEM.upper(), "EACH monday, a   courier\nfrom '''Davan''' [[brings|brings]] 866&nbsp;acorns to Köln", "Eаch Mondаy a cou​rier from Ｄａｖａｎ brings <br />866 acorns to Köln!",
        "> Each Monday a\n> courier from Davan\n> brings 866 acorns to Köln",
    ]
    for t in texts:
        (hit,) = finder.find(t)
        assert hit[:3] == (1, 11, 11)
        (a, b), = hit[3]
        assert plain(t[a:b]).split()[0] == "each" and re.search("k(ö|ö)ln$", plain(t[a:b]).strip())
    assert not finder.find("Each Monday a courier from Madrid brings 866 acorns to Köln.")
    assert not finder.find(None) and not finder.find("") and not LeakFinder([]).find("x") and not LeakFinder([(1, "too short")]).find("too short")


def test_spans_match_words():
    for t in ["a '''b''' [[c|d e]] &amp;f&nbsp;g", "Ｆｕｌｌ ｗidth é x​y <ref name=a>q</ref>", "", "ﬁn ß İ"]:
        assert len(word_spans(t)) == len(plain(t).split())


def test_operator(spark):
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ITEM)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "y " + ITEM, 5), (2, None, 5), (3, "", 5), (1, ITEM, 6)], "doc_id bigint, text string, item_id int")
    got = sorted((r.doc_id, r.item_id) for r in leaks(docs, items).collect())
    assert got == [(1, 1), (1, 1), (1, 3), (1, 3)]
    assert leaks(docs, items.limit(0)).count() == 0 and leaks(docs.limit(0), items).count() == 0


def test_signs_that_are_no_tags():
    finder = LeakFinder([(1, ITEM)])
    for t in ["if x < 3 then " + ITEM + " and y > 2", "a <- b. " + ITEM + " c -> d", "i<n " + ITEM + " n>i", "x <!-- " + ITEM + " --> y", "<p>" + ITEM + "</p>"]:
        (hit,) = finder.find(t)
        assert hit[:3] == (1, 11, 11) and len(word_spans(t)) == len(plain(t).split())
    long = "<td nowrap align=center title=\"" + "many words " * 40 + "\" style='a: b' valign = top />"
    for tag in ["<br>", "<br />", "</B>", "<ref name=Foo Bar>", '<ref name="a b"/>', "<td nowrap>", "<br clear=all / >", "<references\n/>", long]:
        assert plain(f"a{tag}b") == " a b "
    assert plain("<a " + "x=1 " * 50_000) and plain("<" * 50_000) and plain("<a " + "b " * 50_000)


def test_short_items_and_several_automata(spark):
    items = [(1, ITEM), (2, "forty two"), (3, "one  SINGLE answer here"), (4, "six")]
    docs = spark.createDataFrame([(1, "It is Forty-two, not one single answer."), (2, ITEM + " One single answer here."), (3, "forty or two")], "doc_id bigint, text string")
    table = spark.createDataFrame(items, "item_id bigint, text string")
    want = [(1, 2), (2, 1), (2, 3)]
    for size in (1, 70, 1 << 20):
        assert sorted((r.doc_id, r.item_id) for r in leaks(docs, table, short=True, automaton_bytes=size).collect()) == want
    assert [(r.doc_id, r.item_id) for r in leaks(docs, table, automaton_bytes=1).collect()] == [(2, 1)]


def test_many_items():
    """More than twenty thousand items in one automaton, against exact search."""
    rng = random.Random(8)
    vocabulary = ["w%d" % i for i in range(50_000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=24))) for i in range(20_001)]
    finder = LeakFinder(items)
    for k in (0, 777, 20_000):
        text = "before " + " ".join(items[k][1].split()[4:20]) + " after"
        (hit,) = finder.find(text)
        assert hit[:3] == (k, 16, 24) and text[slice(*hit[3][0])] == " ".join(items[k][1].split()[4:20])
    assert len(finder.first) > 370_000
