"""Questions about a page's text, as expressions of the JVM: what it uses, and what kind of page it is.
Comments, nowiki, pre, source and includeonly regions don't count unless a docstring says so."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.functions.wikitext import LINK, without_disabled_parts

FILE_LINK = r"(?i)\[\[\s*(?:File|Image)\s*:\s*([^\[\]|\n]+?)\s*(?:\||\]\])"
GALLERY = r"(?is)<gallery\b[^>]*>(.*?)</gallery>"
GALLERY_LINE = r"(?im)^\s*(?:File|Image)\s*:\s*([^|\n]+?)\s*(?:\||$)"
LANGUAGE_LINK = r"\[\[([a-z]{2,3}(?:-[a-z]+)*)\s*:\s*([^\[\]|\n]+?)\s*(?:\|[^\[\]]*)?\]\]"
TEMPLATE_NAME = r"\{\{\s*(?:[Tt]emplate\s*:\s*)?([^{}|#\n]+?)\s*(?:\||\}\})"
FUNCTION_CALL = r"\{\{\s*#(\w+):"


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _first_capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def image_links(text: Column) -> Column:
    """Different names of the images that a page shows: in links, with nested captions, and in galleries."""
    live = without_disabled_parts(text)
    galleries = F.array_join(_all(live, GALLERY), "\n")
    names = F.concat(_all(live, FILE_LINK), _all(galleries, GALLERY_LINE))
    return F.array_distinct(F.transform(names, lambda n: _first_capital(F.replace(n, F.lit("_"), F.lit(" ")))))


def language_link_pairs(text: Column, languages: Sequence[str]) -> Column:
    """array<struct<lang, title>> of links to other languages, in order."""
    live = without_disabled_parts(text)
    pairs = F.arrays_zip(_all(live, LANGUAGE_LINK).alias("lang"), _all(live, LANGUAGE_LINK, 2).alias("title"))
    return F.filter(pairs, lambda p: p["lang"].isin(*languages))


def linked_pages(text: Column, languages: Sequence[str]) -> Column:
    """Different pages that a page links to: no languages, categories or files, no sections."""
    names = F.transform(_all(without_disabled_parts(text), LINK), lambda n: _first_capital(F.trim(F.replace(n, F.lit("_"), F.lit(" ")))))
    other = r"(?i)^(?:category|file|image|" + "|".join(map(re.escape, languages)) + r")\s*:"
    return F.array_distinct(F.filter(names, lambda n: (n != "") & ~n.rlike(other)))


def template_names(text: Column) -> Column:
    """Names of the templates that a page uses, each use once; parser functions are none."""
    return F.transform(_all(without_disabled_parts(text), TEMPLATE_NAME), lambda n: _first_capital(F.replace(n, F.lit("_"), F.lit(" "))))


def uses_template(text: Column, names: Sequence[str]) -> Column:
    return F.arrays_overlap(template_names(text), F.array(*[F.lit(n[:1].upper() + n[1:]) for n in names]))


def template_uses(pages: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """(key, template): each template of a page once."""
    return pages.select(key, F.explode(F.array_distinct(template_names(F.col(text)))).alias("template"))


def function_calls(text: Column, name: str | None = None) -> Column:
    """How often a text calls parser functions, or one of them."""
    return F.size(F.filter(_all(text, FUNCTION_CALL), lambda f: f == name if name else F.lit(True)))


def redirect_target(text: Column) -> Column:
    """The title that a redirect leads to; null for other pages."""
    return F.nullif(F.trim(F.regexp_extract(text, r"(?i)^\s*#REDIRECT\s*:?\s*\[\[\s*:?([^\[\]|#\n]+)", 1)), F.lit(""))


def is_static_redirect(text: Column) -> Column:
    return redirect_target(text).isNotNull() & F.contains(text, F.lit("__STATICREDIRECT__"))


def is_hidden_category(text: Column) -> Column:
    return F.contains(text, F.lit("__HIDDENCAT__"))


def is_empty_page(text: Column, languages: Sequence[str]) -> Column:
    """Fewer than four characters without links to languages and categories."""
    bare = F.regexp_replace(text, r"(?i)\[\[\s*(?:category|" + "|".join(languages) + r")\s*:[^\[\]]*\]\]", "")
    return F.length(F.trim(F.regexp_replace(bare, r"\s+", " "))) < 4


def has_section(text: Column, name: str) -> Column:
    """A heading of this name, also within quotes or italics; regions of code count as text."""
    parts = "[ _]".join(re.escape(p).replace(r"\-", "-") for p in re.split("[ _]", name))
    return text.rlike(rf"=+[ ']*{parts}[ ']*=+")


def has_html_table(text: Column) -> Column:
    return text.rlike("(?i)<table")


def excepted(value: Column, any_of: Sequence[str] = (), all_of: Sequence[str] = ()) -> Column:
    """Whether any of the first patterns is found, or one of the second is not."""
    out = F.lit(False)
    for p in any_of:
        out = out | value.rlike(p)
    for p in all_of:
        out = out | ~value.rlike(p)
    return out


def first_match(text: Column, rules: Sequence[tuple[str, Sequence[str]]], otherwise: str) -> Column:
    """The name of the first rule of which any pattern is found."""
    out = None
    for name, patterns in rules:
        for p in patterns:
            out = (F if out is None else out).when(text.rlike(p), name)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def page_states(wanted: DataFrame, pages: DataFrame, title: str = "title", text: str = "text") -> DataFrame:
    """(title, status, target) of wanted titles: 'missing', 'redirect' with its target, 'empty' or 'ok'."""
    p = pages.select(F.col(title).alias("title"), F.col(text).alias("__text"), redirect_target(F.col(text)).alias("target"), F.lit(1).alias("__here"))
    got = wanted.select(F.col(title).alias("title")).distinct().join(p, "title", "left")
    status = F.when(F.col("__here").isNull(), "missing").when(F.col("target").isNotNull(), "redirect").when(F.coalesce(F.trim("__text"), F.lit("")) == "", "empty").otherwise("ok")
    return got.select("title", status.alias("status"), "target")


def snippets(pages: DataFrame, words: Sequence[str], key: str = "page_id", text: str = "text", around: int = 20) -> DataFrame:
    """(key, size, words, snippet): pages that hold all the words, whatever the case, with the place of the first."""
    low, hit = F.lower(F.col(text)), F.lit(True)
    for w in words:
        hit = hit & F.array_contains(F.split(low, r"[^\p{L}\p{N}]+"), w.lower())
    at = F.instr(low, words[0].lower())
    return pages.filter(hit).select(key, F.length(text).cast("bigint").alias("size"), F.size(F.filter(F.split(F.col(text), r"\s+"), lambda x: x != "")).cast("bigint").alias("words"),
                                    F.substring(F.col(text), F.greatest(at - around, F.lit(1)), F.lit(2 * around)).alias("snippet"))
