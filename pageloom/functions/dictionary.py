"""Dictionary pages: languages, parts of speech, meanings, translations, and pages written back."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import functions as F, types as T

# Headings of parts of speech and of lists, and names of the languages.
PARTS_OF_SPEECH = "noun verb adjective adverb pronoun preposition conjunction interjection article numeral proper".split()
LISTS = "synonyms antonyms translations related derived".split()
LANGUAGE_NAMES = {"en": "English", "nl": "Dutch", "de": "German", "fr": "French", "es": "Spanish", "it": "Italian", "pt": "Portuguese", "sv": "Swedish", "pl": "Polish", "ru": "Russian", "eo": "Esperanto", "la": "Latin"}


@dataclass
class Meaning:
    definition: str
    examples: list[str] = field(default_factory=list)


@dataclass
class Entry:
    language: str | None
    part_of_speech: str | None
    meanings: list[Meaning] = field(default_factory=list)
    lists: dict[str, list[tuple[str | None, str, str | None]]] = field(default_factory=dict)  # (language, term, gender)


def _misspelt(word: str) -> set[str]:
    """The word with one letter left out, or two neighbours exchanged."""
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    return out | {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)}


def codes_by_name(names: dict[str, str] = LANGUAGE_NAMES) -> dict[str, str]:
    """Language codes by name in lower case, also with a common slip; true names win."""
    slips = {m: code for code, n in names.items() for m in _misspelt(n.lower()) if len(m) > 3}
    return slips | {n.lower(): code for code, n in names.items()} | {code: code for code in names}


_CODES = codes_by_name()
_KINDS = {m: k for k in (*PARTS_OF_SPEECH, *LISTS) for m in _misspelt(k) if len(m) > 3} | {k: k for k in (*PARTS_OF_SPEECH, *LISTS)}


def header(line: str) -> tuple[str, int, str | None, str | None] | None:
    """(contents, level, 'language' | 'pos' | 'list' | None, what it names); unequal signs count by the
    smaller side, and {{-noun-}} and {{en}} are headers too."""
    m = re.match(r"\s*(=+)\s*(.*?)\s*(=*)\s*$", line)
    t = re.match(r"\s*\{\{\s*=?-?\s*([\w ]+?)\s*-?=?\s*\}\}\s*$", line)
    if not m and not t:
        return None
    contents = re.sub(r"[\[\]{}'=]", "", (m[2] if m else t[1])).strip(" -")
    key = contents.lower()
    level = min(len(m[1]), len(m[3]) or len(m[1])) if m else 0
    if key in _KINDS:
        k = _KINDS[key]
        return contents, level, "pos" if k in PARTS_OF_SPEECH else "list", k
    return (contents, level, "language", _CODES[key]) if key in _CODES else (contents, level, None, None)


_TERM = re.compile(r"\[\[([^\[\]|]+)(?:\|[^\[\]]*)?\]\]((?:\s*(?:\{\{[mfnc]\}\}|''[mfnc]''))?)|\{\{t\|([a-z]+)\|([^|{}]+)(?:\|([mfnc]))?[^{}]*\}\}")


def _terms(text: str, language: str | None) -> list[tuple[str | None, str, str | None]]:
    out = []
    for m in _TERM.finditer(text):
        if m[1]:
            out.append((language, m[1], re.sub(r"[{}'\s]", "", m[2]) or None))
        else:
            out.append((m[3], m[4], m[5]))
    return out


def parse(text: str | None) -> list[Entry]:
    """Entries in their order. Lines with # are meanings, #: examples; lines with * in a list section are terms."""
    entries: list[Entry] = []
    language, current, section = None, None, None
    for line in (text or "").splitlines():
        h = header(line)
        if h and (h[2] or h[1]):
            section = None
            if h[2] == "language":
                language, current = h[3], None
            elif h[2] == "pos":
                current = Entry(language, h[3])
                entries.append(current)
            elif h[2] == "list" and current:
                section = h[3]
            continue
        if current is None:
            continue
        if m := re.match(r"#[:*]\s*(.+)", line):
            if current.meanings:
                current.meanings[-1].examples.append(m[1].strip(" '"))
        elif m := re.match(r"#\s*(.+)", line):
            current.meanings.append(Meaning(m[1].strip()))
        elif section and (m := re.match(r"\*+\s*(?:([^\[\]:{}]+):)?\s*(.*)", line)):
            code = _CODES.get(m[1].strip().lower(), m[1].strip()) if m[1] else None
            current.lists.setdefault(section, []).extend(_terms(m[2], code))
    return entries


def ordered(entries: list[Entry], own: str, names: dict[str, str] = LANGUAGE_NAMES) -> list[Entry]:
    """Translingual entries, those of the dictionary's own language, then others by the language's name."""
    return sorted(entries, key=lambda e: (0 if e.language is None else 1 if e.language == own else 2, names.get(e.language or "", e.language or "")))


def written(entries: list[Entry], own: str = "en", names: dict[str, str] = LANGUAGE_NAMES) -> str:
    out, last = [], object()
    for e in ordered(entries, own, names):
        if e.language != last:
            out.append(f"=={names.get(e.language, e.language or 'Translingual')}==")
            last = e.language
        out.append(f"==={(e.part_of_speech or '').capitalize()}===")
        for m in e.meanings:
            out += [f"# {m.definition}", *(f"#: ''{x}''" for x in m.examples)]
        for name, terms in e.lists.items():
            out.append(f"===={name.capitalize()}====")
            out += [f"* {names.get(l, l) + ': ' if l else ''}[[{t}]]{f' {{{{{g}}}}}' if g else ''}" for l, t, g in terms]
    return "\n".join(out)


_ENTRIES = T.ArrayType(T.StructType([T.StructField(n, k) for n, k in (("language", T.StringType()), ("part_of_speech", T.StringType()), ("definitions", T.ArrayType(T.StringType())), ("section", T.StringType()), ("term_language", T.StringType()), ("term", T.StringType()), ("gender", T.StringType()))]))


@F.arrow_udf(_ENTRIES)
def entries_of(values):
    """Dictionary pages as rows: one for each entry, and one for each term of its lists."""
    import pyarrow as pa

    def rows(text):
        for e in parse(text):
            base = {"language": e.language, "part_of_speech": e.part_of_speech}
            yield base | {"definitions": [m.definition for m in e.meanings], "section": None, "term_language": None, "term": None, "gender": None}
            for name, terms in e.lists.items():
                for l, t, g in terms:
                    yield base | {"definitions": None, "section": name, "term_language": l, "term": t, "gender": g}

    s = pa.string()
    kind = pa.list_(pa.struct([("language", s), ("part_of_speech", s), ("definitions", pa.list_(s)), ("section", s), ("term_language", s), ("term", s), ("gender", s)]))
    return pa.array([None if v is None else list(rows(v)) for v in values.to_pylist()], kind)
