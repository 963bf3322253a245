"""Rewriting of whole pages, built on protected replacement: footers, templates, references, images, links, fix sets."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pageloom.functions.wikitext import CATEGORY, DISABLED, language_links, replace_except, with_categories, with_language_links, without_disabled_parts, without_language_links

_CODE = ["nowiki", "comment", "pre", "source", "math"]


def _title_pattern(title: str) -> str:
    first = f"[{re.escape(title[0].upper())}{re.escape(title[0].lower())}]" if title else ""
    return first + re.escape(title[1:]).replace(r"\ ", "[ _]+")


def standard_footer(text: str, languages: frozenset[str], first: Sequence[str] = (), newline: str = "\n") -> str:
    """Categories, then language links in their standard order, at the end of the page."""
    links = language_links(text, languages)
    body = without_language_links(text, languages)
    seen: dict[str, None] = {}
    for m in re.finditer(CATEGORY, body):
        seen.setdefault(m[1] + (f"|{m[2]}" if m[2] is not None else ""))
    return with_language_links(with_categories(body, list(seen), newline).rstrip(), links, languages, tuple(first), newline)


def without_self_prefix(text: str, own: str) -> str:
    """[[own:X]] becomes [[X]]."""
    return replace_except(text, re.compile(rf"\[\[:?{re.escape(own)}:(?=[^\[\]]+\]\])"), "[[", _CODE)


def simple_links(text: str) -> str:
    """[[A|A]] and [[a|A]] become [[A]], [[A|As]] becomes [[A]]s, spaces go outside the brackets."""

    def one(m: re.Match) -> str:
        target, label = m[1].strip(), m[2]
        lead, trail = " " * (label[:1] == " "), " " * (label[-1:] == " ")
        label = label.strip()
        same = target[:1].lower() + target[1:] == label[:1].lower() + label[1:]
        if same:
            return f"{lead}[[{label}]]{trail}"
        low = target[:1].lower() + target[1:], label[:1].lower() + label[1:]
        if low[1].startswith(low[0]) and re.fullmatch(r"[a-zäöüß]+", label[len(target) :]):
            return f"{lead}[[{label[: len(target)]}]]{label[len(target) :]}{trail}"
        return m[0]

    return replace_except(text, re.compile(r"\[\[([^\[\]|#:]+)\|([^\[\]|]+)\]\]"), one, _CODE + ["gallery"])


def canonical_prefixes(text: str, canonical: dict[str, str]) -> str:
    """Prefixes of links ({'image': 'File', ...}, by lower case) by their canonical names."""
    return replace_except(text, re.compile(r"\[\[(:?)\s*([^\[\]|:]+?)\s*:\s*(?=[^\[\]]*\]\])"), lambda m: f"[[{m[1]}{canonical[m[2].lower()]}:" if m[2].lower() in canonical else m[0], _CODE)


def change_template(text: str, old: str, new: str | None, substitute: bool = False) -> str:
    """Renames a template, removes it (new None), or puts subst: before it; its parameters stay."""
    name = rf"\{{\{{\s*(?:[Tt]emplate\s*:\s*)?{_title_pattern(old)}\s*(?=\||\}}\}})"
    if new is None:
        return replace_except(text, re.compile(name + r"(?:\|[^{}]*)?\}\}\n?"), "", _CODE)
    return replace_except(text, re.compile(name), lambda m: "{{" + ("subst:" if substitute else "") + new, _CODE)


def lacks_references(text: str, templates: Sequence[str] = ("Reflist", "References")) -> bool:
    """The page has citations and nothing that lists them."""
    t = re.sub(DISABLED, "", text)
    if not re.search(r"(?i)</ref>", t):
        return False
    listed = r"(?i)<references\s*/?>|\{\{\s*(?:" + "|".join(map(re.escape, templates)) + r")\s*[|}]"
    return not re.search(listed, t)


def references_lacking(text: Column, templates: Sequence[str] = ("Reflist", "References")) -> Column:
    """``lacks_references`` as an expression of the JVM."""
    t = without_disabled_parts(text)
    return t.rlike(r"(?i)</ref>") & ~t.rlike(r"(?i)<references\s*/?>|\{\{\s*(?:" + "|".join(templates) + r")\s*[|}]")


def robots_allowed(text: Column, robot: str) -> Column:
    """``allows_robots`` as an expression of the JVM; null text allows."""
    kind = F.lower(F.regexp_extract(text, r"(?i)\{\{\s*bots\s*\|\s*(allow|deny)\s*=", 1))
    listed = F.transform(F.split(F.lower(F.regexp_extract(text, r"(?i)\{\{\s*bots\s*\|\s*(?:allow|deny)\s*=\s*([^{}|]*)", 1)), ","), lambda x: F.trim(x))
    hit = F.arrays_overlap(listed, F.array(F.lit("all"), F.lit(robot.lower())))
    return F.coalesce(F.when(text.rlike(r"(?i)\{\{\s*nobots\s*\}\}"), False).when(kind == "allow", hit).when(kind == "deny", ~hit), F.lit(True))


def maps_of(pairs: DataFrame, key: str, old: str = "old", new: str = "new") -> DataFrame:
    """(key, map): the replacements of each page; bounded by what the page itself holds."""
    return pairs.groupBy(key, old).agg(F.min(new).alias(new)).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(old, new))).alias("map"))


def with_map(f: Callable[[str, dict[str, str]], str]):
    """A function of a text and a map as a column function; a null map leaves the text."""

    @F.arrow_udf(T.StringType())
    def rewrite(texts: pa.Array, maps: pa.Array) -> pa.Array:
        return pa.array([None if t is None else f(t, dict(m)) if m else t for t, m in zip(texts.to_pylist(), maps.to_pylist())], pa.string())

    return rewrite


def with_title(f: Callable[[str, str], str]):
    """A function of a text and its page's title as a column function; nulls leave the text."""

    @F.arrow_udf(T.StringType())
    def rewrite(texts: pa.Array, titles: pa.Array) -> pa.Array:
        return pa.array([t if not t or not n else f(t, n) for t, n in zip(texts.to_pylist(), titles.to_pylist())], pa.string())

    return rewrite


def with_references(text: str, heading: str = "References", before: Sequence[str] = ("External links",)) -> str:
    """A section with <references /> before the first of these sections, else before the categories, else at the end."""
    if re.search(rf"(?m)^=+ *{re.escape(heading)} *=+ *$", text):
        return re.sub(rf"(?m)^(=+ *{re.escape(heading)} *=+ *)$", "\\1\n<references />", text, count=1)
    block = f"== {heading} ==\n<references />\n\n"
    for name in before:
        if m := re.search(rf"(?m)^=+ *{re.escape(name)} *=+ *$", text):
            return text[: m.start()] + block + text[m.start() :]
    if m := re.search(CATEGORY, text):
        return text[: m.start()] + block + text[m.start() :]
    return text.rstrip() + "\n\n" + block.rstrip() + "\n"


def replace_image(text: str, old: str, new: str | None) -> str:
    """An image by another one (None: removed) in links with nested captions, galleries, and template values."""
    name, out, at = _title_pattern(old), [], 0
    for m in re.finditer(rf"\[\[\s*(?:[Ff]ile|[Ii]mage)\s*:\s*{name}\s*(?=\||\]\])", text):
        if m.start() < at:
            continue
        depth, i = 1, m.end()
        while i < len(text) and depth:
            two = text[i : i + 2]
            depth += (two == "[[") - (two == "]]")
            i += 2 if two in ("[[", "]]") else 1
        out += [text[at : m.start()], f"[[File:{new}{text[m.end() : i]}" if new else ""]
        at = i
    text = "".join([*out, text[at:]])
    line = re.compile(rf"^(\s*(?:[Ff]ile|[Ii]mage):){name}(?=\s*(?:\||$))[^\n]*\n?", re.M)
    text = re.sub(r"(?is)<gallery\b[^>]*>.*?</gallery>", lambda g: line.sub(lambda m: re.sub(name, new.replace("\\", r"\\"), m[0], count=1) if new else "", g[0]), text)
    return re.sub(rf"(\|\s*[^|={{}}\[\]]*=\s*){name}(?=\s*(?:\||\}}\}}))", lambda m: m[1] + (new or ""), text)


def without_lines(text: str, part: str) -> str:
    """Text without the lines that hold this part (an unwanted address)."""
    return "\n".join(l for l in text.split("\n") if part not in l)


def calmer_title(title: str, share: float = 0.7, longer_than: int = 6) -> str:
    """Title case for titles that are mostly capitals and have no digits."""
    letters = [c for c in title if c.isalpha()]
    loud = len(title) > longer_than and letters and sum(c.isupper() for c in letters) > share * len(letters) and not any(c.isdigit() for c in title)
    return title.title() if loud else title


def reference_link(url: str, title: str) -> str:
    """A citation of a page by its cleaned title."""
    t = re.sub(r"[\s\u00a0]+", " ", re.sub(r"[\[\]{}|<>]", " ", title)).strip(" -=|»~.")
    return f"<ref>[{url} {calmer_title(t)}]</ref>" if t else f"<ref>{url}</ref>"


def append_text(text: str, addition: str, top: bool = False, unless: str | None = None) -> str:
    """Text with an addition at its end (before categories and language links) or beginning, unless a pattern matches."""
    if unless and re.search(unless, text):
        return text
    if top:
        return addition + "\n" + text
    m = re.search(r"(?m)^(?:\[\[(?:[Cc]ategory|[a-z]{2,3}):)", text)
    return text[: m.start()] + addition + "\n\n" + text[m.start() :] if m else text.rstrip() + "\n\n" + addition + "\n"


def append_to_section(text: str, section: str, addition: str) -> str:
    m = re.search(rf"(?m)^(=+) *{re.escape(section)} *=+ *$", text)
    if not m:
        return append_text(text, addition)
    nxt = re.search(rf"(?m)^={{1,{len(m[1])}}}[^=]", text[m.end() :])
    z = m.end() + nxt.start() if nxt else len(text)
    return text[:z].rstrip() + "\n" + addition + "\n" + text[z:]


def without_sections(text: str, names: Sequence[str]) -> str:
    """Text without the sections of these names and what belongs to them."""
    for name in names:
        while m := re.search(rf"(?m)^(=+) *{re.escape(name)} *=+ *$", text):
            nxt = re.search(rf"(?m)^={{1,{len(m[1])}}}(?!=)", text[m.end() :])
            text = text[: m.start()] + (text[m.end() + nxt.start() :] if nxt else "")
    return text


def dead_disambiguation_links(text: str) -> list[str]:
    """The first link of each bullet."""
    return re.findall(r"(?m)^[*#]+[^\[\n]*\[\[([^\[\]|#\n]+)", text)


#: Fix sets: (pattern, replacement) in order, and the regions that they leave alone.
FIXES: dict[str, tuple[list[tuple[str, str | Callable]], list[str]]] = {
    "html": ([(r"(?i)</?b>", "'''"), (r"(?i)</?i>", "''"), (r"(?i)<br */? *>", "<br />"), (r"(?i)^<hr */? *>$", "----")], _CODE),
    "syntax": ([(r"\[(https?://[^\s\]|]+)\|([^\]]+)\]", r"[\1 \2]"), (r"\[\[(https?://[^\s\]]+) ([^\]]*)\]\]", r"[\1 \2]"), (r"(?<!\[)\[\[([^\[\]]+)\](?!\])", r"[[\1]]"), (r"\{\{\s*([^{}|]+?)\s*\}\}", r"{{\1}}")], _CODE),
    "spaces": ([(r" +([,.;:])(?=\s)", r"\1"), (r"([^\s]) {2,}(?=\S)", r"\1 ")], [*_CODE, "template", "table", "hyperlink", "startspace"]),
    "percent": ([(r"(\d)&nbsp;%", r"\1 %")], _CODE),
}


def fixed(text: str, *names: str) -> str:
    for n in names or FIXES:
        rules, regions = FIXES[n]
        for old, new in rules:
            text = replace_except(text, re.compile(old, re.M), new, regions)
    return text


def allows_robots(text: str, robot: str) -> bool:
    """Whether {{nobots}} or {{bots|allow=...|deny=...}} lets this robot edit."""
    if re.search(r"(?i)\{\{\s*nobots\s*\}\}", text):
        return False
    m = re.search(r"(?i)\{\{\s*bots\s*\|\s*(allow|deny)\s*=\s*([^{}|]*)", text)
    if not m:
        return True
    listed = {x.strip().lower() for x in m[2].split(",")}
    hit = "all" in listed or robot.lower() in listed
    return hit if m[1].lower() == "allow" else not hit
