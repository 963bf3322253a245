"""Page titles: normal form (the join key of all page relations) and the algebra of its parts."""

from __future__ import annotations

import html
import re
import unicodedata
from dataclasses import dataclass, field
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

# Numbers and canonical names of the namespaces.
NAMESPACES = {
    -2: "Media", -1: "Special", 0: "", 1: "Talk", 2: "User", 3: "User talk", 4: "Project", 5: "Project talk", 6: "File", 7: "File talk",
    8: "MediaWiki", 9: "MediaWiki talk", 10: "Template", 11: "Template talk", 12: "Help", 13: "Help talk", 14: "Category", 15: "Category talk",
}
ALIASES = {"image": 6, "image talk": 7}
#: Entities that stay written: they would become markup.
_KEPT_ENTITIES = {38, 39, 60, 62, 91, 93, 124, 160, 173, 8206, 8207}
_ENTITY = re.compile(r"&(?:#(\d+)|#x([0-9a-fA-F]+)|(\w+));")


@dataclass(frozen=True)
class TitleRules:
    """How a site writes titles: its namespaces' names, and whether first letters are capital."""

    names: dict[str, int] = field(default_factory=lambda: {n.lower(): k for k, n in NAMESPACES.items() if n} | ALIASES)
    canonical: dict[int, str] = field(default_factory=lambda: dict(NAMESPACES))
    languages: frozenset[str] = frozenset("en de fr nl es it pt pl ru ja sv zh".split())
    capitalised: bool = True


DEFAULT_RULES = TitleRules()


def decode_entities(text: str, kept: set[int] = _KEPT_ENTITIES) -> str:
    def one(m: re.Match) -> str:
        ch = html.unescape(m[0])
        return m[0] if len(ch) != 1 or ord(ch) in kept else ch

    return _ENTITY.sub(one, text) if "&" in text else text


def split_title(raw: str | None, rules: TitleRules = DEFAULT_RULES) -> tuple[str | None, int, str, str] | None:
    """(language, namespace, title without namespace, section) or None for what is no title: null,
    empty, undecodable, or a bare section."""
    if raw is None:
        return None
    t = unicodedata.normalize("NFC", unquote(decode_entities(raw)))
    if "\ufffd" in t:
        return None
    t = re.sub(r"[ _]+", " ", t).strip(" ").replace("\u200e", "").replace("\u200f", "").strip(" ")
    lang, ns = None, 0
    t = t.removeprefix(":").lstrip()
    while ":" in t:
        head, rest = t.split(":", 1)
        key = head.strip().lower()
        if key in rules.names:
            ns, t = rules.names[key], rest.strip()
            break
        if key in rules.languages and lang is None:
            lang, t = key, rest.strip().removeprefix(":").lstrip()
            continue
        break
    t, _, section = t.partition("#")
    t = t.strip()
    if not t:
        return None
    if rules.capitalised and lang is None:
        t = t[0].upper() + t[1:]
    return lang, ns, t, section.strip()


def normal_title(raw: str | None, rules: TitleRules = DEFAULT_RULES) -> str | None:
    parts = split_title(raw, rules)
    if parts is None:
        return None
    lang, ns, t, section = parts
    name = rules.canonical.get(ns, "")
    return (f"{lang}:" if lang else "") + (f"{name}:" if name else "") + t + (f"#{section}" if section else "")


def title_udf(rules: TitleRules = DEFAULT_RULES):
    """Normal titles of a column, each distinct text once; null where the text is no title."""

    @F.arrow_udf(T.StringType())
    def normal(values: pa.Array) -> pa.Array:
        d = values.dictionary_encode()
        return pa.array([normal_title(v, rules) for v in d.dictionary.to_pylist()], pa.string()).take(d.indices)

    return normal


# ---- parts of normal titles, in the JVM -------------------------------------------------------


def _ns_names(rules: TitleRules) -> Column:
    return F.create_map(*[x for n, k in rules.names.items() for x in (F.lit(n), F.lit(k))])


def namespace(title: Column, rules: TitleRules = DEFAULT_RULES) -> Column:
    """Number of the namespace of a title; 0 where its prefix is no namespace's name."""
    head = F.lower(F.regexp_replace(F.regexp_extract(title, r"^([^:]*):", 1), "_", " "))
    return F.when(title.isNotNull(), F.coalesce(F.try_element_at(_ns_names(rules), head), F.lit(0)))


def without_namespace(title: Column, rules: TitleRules = DEFAULT_RULES) -> Column:
    return F.when(namespace(title, rules) != 0, F.regexp_replace(title, r"^[^:]*:\s*", "")).otherwise(title)


def section(title: Column) -> Column:
    """What follows the first #; null without one."""
    return F.when(F.instr(title, "#") > 0, F.regexp_extract(title, r"^[^#]*#(.*)$", 1))


def without_section(title: Column) -> Column:
    return F.regexp_replace(title, r"(?s)#.*$", "")


def for_filename(title: Column) -> Column:
    return F.regexp_replace(title, r"[:*?/\\]", "_")


def url_name(title: Column) -> Column:
    return F.regexp_replace(F.url_encode(F.regexp_replace(title, " ", "_")), "%3A", ":")


def talk_namespace(ns: Column) -> Column:
    """The other side of a page and its talk page; null for namespaces below 0."""
    return F.when(ns >= 0, ns.bitwiseXOR(F.lit(1)))


def is_talk(ns: Column) -> Column:
    return (ns >= 0) & (ns % 2 == 1)


def first_upper(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def first_lower(c: Column) -> Column:
    return F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def as_link(title: Column, ns: Column, text: Column | None = None) -> Column:
    """[[title]], with a colon before files and categories, and a text if it differs."""
    target = F.concat(F.when(ns.isin(6, 14), ":").otherwise(""), title)
    return F.concat(F.lit("[["), target, F.coalesce(F.when(text != title, F.concat(F.lit("|"), text)), F.lit("")) if text is not None else F.lit(""), F.lit("]]"))


def last_name_first(name: Column) -> Column:
    """'Last, First' of a name of several words, for sorting."""
    last, first = F.regexp_extract(name, r"(\S+)$", 1), F.regexp_extract(name, r"^(.*) \S+$", 1)
    return F.when(F.contains(name, F.lit(" ")), F.concat(last, F.lit(", "), first)).otherwise(name)


def expand_namespace_words(text: Column, rules: TitleRules = DEFAULT_RULES) -> Column:
    """{{ns:6}} and {{ns:file}} as the namespace's name; unknown ones stay."""
    for number, name in rules.canonical.items():
        for key in (str(number), name):
            if key:
                text = F.regexp_replace(text, r"(?i)\{\{\s*ns\s*:\s*" + re.escape(key).replace(r"\ ", "[ _]") + r"\s*\}\}", name)
    return text


def from_database_name(link: Column) -> Column:
    """'dewiki:Title' as 'de:Title', 'frwiktionary:x' as 'wiktionary:fr:x'; other links stay."""
    lang, kind, rest = (F.regexp_extract(link, r"^([a-z]{2,3}(?:_[a-z]+)*)(wiki|wiktionary|wikibooks|wikisource|wikinews):(.*)$", i) for i in (1, 2, 3))
    lang = F.replace(lang, F.lit("_"), F.lit("-"))
    return F.when(kind == "", link).when(kind == "wiki", F.concat(lang, F.lit(":"), rest)).otherwise(F.concat(kind, F.lit(":"), lang, F.lit(":"), rest))
