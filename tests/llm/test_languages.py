import numpy as np
import pytest

from pageloom.llm.languages import LANGUAGES, OTHER, fit, forward_backward, label_texts, language_of_label, sentence_languages, training_texts
from pageloom.llm.prose import complete, pieces, prose
from pageloom.session import table
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def model(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    return fit(training_texts(docs, F.col("doc_id"), F.col("lang"), F.col("text")))


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(1)
    k, t = 3, 5
    step, start = rng.random((k, k)) + 0.1, rng.random(k) + 0.1
    emit = rng.random((2, t, k)).astype(np.float32) + 0.05
    lengths = np.array([5, 3])
    got = forward_backward(emit, lengths, step.astype(np.float32), start.astype(np.float32))
    for s, n in enumerate(lengths):
        want = np.zeros((n, k))
        for path in np.ndindex(*[k] * n):
            p = start[path[0]] * emit[s, 0, path[0]]
            for i in range(1, n):
                p *= step[path[i - 1], path[i]] * emit[s, i, path[i]]
            for i, y in enumerate(path):
                want[i, y] += p
        assert np.allclose(got[s, :n], want / want.sum(1, keepdims=True), atol=1e-4)


def test_held_out_accuracy(spark, model):
    """On other documents than those of the training folder, sentence by sentence, by their (partly wrong) labels."""
    rows = table(spark, "/root/testdata/sf0.1", "documents").select("lang", "text").limit(2000).collect()
    right = n = 0
    for r, found in zip(rows, sentence_languages(model, [r.text for r in rows])):
        label = language_of_label(r.lang)
        if label in LANGUAGES and len({x[2] for x in found if x[4]}) == 1:
            n += 1
            right += found[0][2] == label
    assert right / n > 0.93  # a part of the labels is wrong


def test_pair_marginals_against_all_paths():
    rng = np.random.default_rng(2)
    k, t = 3, 4
    step, start, emit = rng.random((k, k)) + 0.1, rng.random(k) + 0.1, rng.random((1, t, k)) + 0.05
    want = np.zeros((k, k))
    total = 0.0
    for path in np.ndindex(*[k] * t):
        p = start[path[0]] * emit[0, 0, path[0]]
        for i in range(1, t):
            p *= step[path[i - 1], path[i]] * emit[0, i, path[i]]
        total += p
        for i in range(1, t):
            want[path[i - 1], path[i]] += p
    _, pairs = forward_backward(emit.astype(np.float32), np.array([t]), step.astype(np.float32), start.astype(np.float32), with_pairs=True)
    assert np.allclose(pairs, want / total, atol=1e-4)


def test_the_sample_does_not_matter(spark):
    """Models of two different halves of the labelled texts find the same."""
    rows = [r for r in table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "lang", "text").filter("doc_id % 4 < 2").collect()]
    got = []
    for half in (0, 1):
        texts: dict = {}
        for r in rows:
            if r.doc_id % 2 == half and (l := language_of_label(r.lang)) in LANGUAGES:
                texts.setdefault(l, []).append((l, r.text))
        m = fit([x for l in sorted(texts) for x in texts[l][:400]])
        got.append([frozenset(x[2] for x in f if x[4]) for f in sentence_languages(m, [r.text for r in rows[:3000]])])
    assert sum(a != b for a, b in zip(*got)) <= 0.002 * len(got[0])


OTHERS = [
    "Questa casa è molto bella, ma il giardino non è grande come quello di mia sorella.", "O menino comeu todas as maçãs que estavam em cima da mesa da cozinha.",
    "Wczoraj poszliśmy do sklepu, żeby kupić chleb i mleko dla naszej rodziny.", "Kissa istuu pöydän alla ja katselee lintuja ikkunasta.", "Il presidente del consiglio ha detto che la legge sarà approvata domani.",
]
OWN = [
    ("en", "The quick brown fox jumps over the lazy dog near a quiet riverbank."), ("nl", "Gisteren kochten we vers brood en melk bij de kleine winkel om de hoek."), ("de", "Gestern kauften wir frisches Brot und Milch im kleinen Laden um die Ecke."),
    ("fr", "Hier nous avons acheté du pain frais et du lait dans la petite boutique du coin."), ("es", "Ayer compramos pan fresco y leche en la pequeña tienda de la esquina."),
]


def test_other_languages_are_none_of_ours(model):
    assert [[(x[2], x[4]) for x in f] for f in sentence_languages(model, OTHERS)] == [[(OTHER, False)]] * len(OTHERS)
    assert [[(x[2], x[4]) for x in f] for f in sentence_languages(model, [t for _, t in OWN])] == [[(l, True)] for l, _ in OWN]


def test_switch_inside_a_sentence(model):
    text = "I really like this book pero no me gusta nada la película que hicieron después, honestly speaking it was boring."
    (found,) = sentence_languages(model, [text])
    assert [(text[a:b], l) for a, b, l, _, _ in found] == [("I really like this book", "en"), ("pero no me gusta nada la película que hicieron después", "es"), ("honestly speaking it was boring.", "en")]
    long = "palabra " * 60_000
    assert len(sentence_languages(model, [long, "De koppeling in de tweede alinea werkt niet meer."] * 3)) == 6


def test_labels():
    assert [language_of_label(x) for x in ("EN", "en_US", "Dutch", " deu ", "fr-FR", "xx", "", None, "und", "it")] == ["en", "en", "nl", "de", "fr", None, None, None, None, "it"]


ROWS = [
    ("s", "1", "en", "The link in the second paragraph no longer works."), ("s", "2", "en", "De koppeling in de tweede alinea werkt niet meer."), ("s", "3", None, "Over de jaren voor 1902 is niets bekend."),
    ("s", "4", "en", "See also the page about Fixum. Le lien du deuxième paragraphe ne fonctionne plus."), ("s", "5", "en", "IMG 123"), ("s", "6", "nl", None), ("s", "7", None, ""),
    ("s", "8", "en", "The missing signature was added 11 minutes later („las fracturas“)."), ("s", "9", "it", "Die fehlende Unterschrift kam 2 Minuten später dazu."),
]


def test_found_segments_and_documents(spark, model):
    df = spark.createDataFrame(ROWS, "src string, rec_id string, label string, text string")
    found = sorted((r.rec_id, r.lang) for r in label_texts(df, model, "found").collect())
    assert found == [("2", "nl"), ("3", "nl"), ("4", "en"), ("4", "fr"), ("9", "de")]
    seg = [(r.start, r.stop, r.lang) for r in label_texts(df, model, "segments").filter("rec_id = '4'").orderBy("start").collect()]
    assert [x[2] for x in seg] == ["en", "fr"] and seg[0][0] == 0 and seg[1][1] == len(ROWS[3][3])
    docs = {r.rec_id: r for r in label_texts(df, model, "documents").collect()}
    assert len(docs) == 9 and docs["6"].lang is None and docs["7"].lang is None and docs["2"].lang == "nl" and 0.5 < docs["2"].confidence <= 1
    assert all(label_texts(df.limit(0), model, w).count() == 0 for w in ("found", "segments", "documents"))
    assert training_texts(df.limit(0), F.col("rec_id"), F.col("label"), F.col("text")) == [] and fit([]).marginals([[]])[0].shape == (0, len(LANGUAGES))


def test_prose():
    text = "== Head ==\n{{Infobox|name=x}}\nOne [[two|three]] four.<ref>Not, p. 3</ref> Five '''six''' seven! -- [[User:A]] 08:01\n[[Category:C]]\n> Eight nine\n> ten eleven?"
    assert len(prose(text)) == len(text)
    got = [" ".join(p.split()) for _, p in pieces(prose(text))]
    assert got == ["One three four.", "Five six seven!", "Eight nine ten eleven?"] and all(map(complete, got))
    assert pieces("") == [] and pieces("a" * 100_000) == [(0, "a" * 100_000)]
