"""Problem 4: visually identical text with different characters.

Each character has a quick-check property: stable (stays itself, never joins its neighbours) or
not. Text of stable characters is returned as it is; otherwise only the runs of unstable characters,
with the starter before them, are normalised and spliced into the unchanged rest.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pageloom.session import materialised

# Letters of other scripts (first of each pair) of the same shape as a Latin letter (second).
CYRILLIC = "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY ԌG ԚQ ԜW ѴV аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ѵv үy"
GREEK = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC Ϳ" + "J οo νv ρp ϲc ϳj"
ARMENIAN = "ՕO ՏS օo հh ցg զq"
CHEROKEE = "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᎡR ᏚS ᎢT ᏙV ᎳW ᏃZ"
COPTIC = "ⲞO ⲟo ⲢP ⲤC ⲦT ⲬX ⲎH ⲒI ⲔK ⲘM ⲚN"
SYMBOLS = "µμ ∆Δ ∑Σ ∏Π"
LISU = "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU"
NUMERALS = "ⅠI ⅤV ⅩX ⅬL ⅭC ⅮD ⅯM ⅰi ⅴv ⅹx ⅼl ⅽc ⅾd ⅿm"
SINGLE = "ӏl ӀI ɡg"
#: Hyphens that look as the ASCII one; dashes and the minus sign are longer and differ.
HYPHENS = "‐‑"

_SHAPES = {ord(p[0]): p[1] for line in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, COPTIC, SYMBOLS, LISU, NUMERALS, SINGLE) for p in line.split()}
#: Compatibility decompositions that keep the look: width forms, letter-like symbols in another font, no-break forms.
_SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>")
_ASCII_RUN = re.compile(r"[^ -~]+")


def _invisible(ch: str) -> bool:
    o = ord(ch)
    return unicodedata.category(ch) in ("Cf", "Cc") and ch not in "\t\n\r\x0b\x0c\x85" or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D)


@lru_cache(maxsize=1 << 16)
def _folded(ch: str) -> str:
    """The character without width forms, invisible characters, kinds of space and hyphen; canonically decomposed."""
    if ch in HYPHENS:
        return "-"
    if ch.isspace() or unicodedata.category(ch) in ("Zs", "Zl", "Zp"):
        return " "
    if _invisible(ch):
        return ""
    d = unicodedata.decomposition(ch)
    if d.startswith(_SAME_LOOK):
        return "".join(_folded(chr(int(x, 16))) for x in d.split()[1:])
    return unicodedata.normalize("NFD", ch)


@lru_cache(maxsize=1 << 16)
def _stable(ch: str, shapes: bool) -> bool:
    """Quick check of one character: it stays itself and can't join a neighbour."""
    if unicodedata.combining(ch) or not unicodedata.is_normalized("NFC", "a" + ch):
        return False
    if "\u1100" <= ch <= "\u11ff" or ch in "\u3099\u309a":  # parts of syllables, voicing marks
        return False
    return canonical_run(ch, shapes) == ch


def canonical_run(run: str, shapes: bool) -> str:
    out = "".join(map(_folded, run))
    if shapes:
        out = out.translate(_SHAPES)
    return unicodedata.normalize("NFC", out)


def canonical(text: str | None, shapes: bool = True) -> str | None:
    """Text in one form. ``shapes``: look-alike letters of other scripts too become Latin letters,
    so that texts that look the same are equal. Null stays null; ASCII text stays as it is, but for
    control characters. Case, missing accents, underscores, dashes and double spaces stay."""
    if text is None or (text.isascii() and text.isprintable()):
        return text
    out, done = [], 0
    for m in _ASCII_RUN.finditer(text):
        a, b = m.span()
        while a < b:
            if _stable(text[a], shapes):
                a += 1
                continue
            e = a + 1
            while e < b and not _stable(text[e], shapes):
                e += 1
            s = max(done, a - 1)  # the starter before the run
            out += [text[done:s], canonical_run(text[s:e], shapes)]
            done = a = e
    out.append(text[done:])
    return "".join(out)


def canonical_values(values: pa.Array, shapes: bool = True) -> pa.Array:
    """``canonical`` of each distinct value once."""
    d = values.dictionary_encode()
    return pa.array([canonical(v, shapes) for v in d.dictionary.to_pylist()], pa.string()).take(d.indices)


@F.arrow_udf(T.StringType())
def _same_look(values: pa.Array) -> pa.Array:
    return canonical_values(values)


@F.arrow_udf(T.StringType())
def _one_form(values: pa.Array) -> pa.Array:
    return canonical_values(values, shapes=False)


def look(c: Column) -> Column:
    """One form in which texts that look the same are equal. Plain ASCII never leaves the JVM."""
    return F.coalesce(_same_look(F.when(c.rlike(r"[^ -~]"), c)), c)


def one_form(c: Column) -> Column:
    """One way of writing the same letters: accents composed, no width forms or invisible
    characters, plain spaces and hyphens; letters keep their script."""
    return F.coalesce(_one_form(F.when(c.rlike(r"[^ -~]"), c)), c)


#: A list of wanted titles up to this many rows is sent to every executor; a longer one is shuffled.
BROADCAST_TITLES = 500_000


def miswritten(df: DataFrame, id_col: str, title_col: str, wanted: DataFrame, wanted_id: str, wanted_title: str, broadcast_titles: int = BROADCAST_TITLES) -> DataFrame:
    """(rec_id, twin_id) of rows whose title looks as a wanted title but is not the same characters.

    Null titles and titles that look as no wanted one give nothing; empty text looks as empty text
    only; repeated rows give one. If several wanted titles look the same, each is a twin."""
    w = wanted.filter(F.col(f"`{wanted_title}`").isNotNull()).select(F.col(f"`{wanted_id}`").alias("twin_id"), F.col(f"`{wanted_title}`").alias("__w"), look(F.col(f"`{wanted_title}`")).alias("__look"))
    if wanted.limit(broadcast_titles + 1).count() <= broadcast_titles:
        w = F.broadcast(w)
    rows = df.filter(F.col(f"`{title_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("rec_id"), F.col(f"`{title_col}`").alias("__t"))
    return rows.withColumn("__look", look(F.col("__t"))).join(w, "__look").filter("__t <> __w").select("rec_id", "twin_id").distinct()


def _mixed(titles: DataFrame) -> DataFrame:
    """(look, t) of the distinct titles whose look has several writings."""
    every = materialised(titles.filter("t IS NOT NULL").distinct().withColumn("look", look(F.col("t"))))
    mixed = every.groupBy("look").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).filter("lo <> hi").select("look")
    return every.join(mixed, "look", "left_semi")


def twins(df: DataFrame, id_col: str, title_col: str) -> DataFrame:
    """(rec_id, twin_id), rec_id < twin_id, of rows whose titles look the same but differ.

    Distinct titles are paired, not rows, and only those whose look has several writings; a pair's
    rows are joined by title. Rows with a null id or title, and equal titles, are no twins. A record
    with several titles counts with each. Where one look has very many rows, ``look_classes`` says
    the same without their pairs."""
    rows = materialised(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{title_col}`").alias("t")).filter("id IS NOT NULL AND t IS NOT NULL").distinct())
    kept = _mixed(rows.select("t"))
    pairs = kept.select("look", F.col("t").alias("ta")).join(kept.select("look", F.col("t").alias("tb")), "look").filter("ta <> tb").select("ta", "tb")
    a, b = rows.select(F.col("id").alias("rec_id"), F.col("t").alias("ta")), rows.select(F.col("id").alias("twin_id"), F.col("t").alias("tb"))
    return pairs.join(a, "ta").join(b, "tb").filter("rec_id < twin_id").select("rec_id", "twin_id").distinct()


def look_classes(df: DataFrame, id_col: str, title_col: str) -> DataFrame:
    """(look, title, representative, writings, records): every writing of each look that has several,
    with its least writing as the representative and how many records are written so. One row a
    writing, however many records it has: records are counted before anything is joined."""
    counts = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{title_col}`").alias("t")).filter("id IS NOT NULL AND t IS NOT NULL").distinct().groupBy("t").agg(F.count("*").alias("records"))
    kept = _mixed(counts.select("t"))
    of_look = kept.groupBy("look").agg(F.min("t").alias("representative"), F.count("*").alias("writings"))
    return kept.join(of_look, "look").join(counts, "t").select("look", F.col("t").alias("title"), "representative", "writings", "records")
