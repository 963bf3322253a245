"""Wikitext: what is found in a text (links, templates, sections, ...) and how texts are rewritten.

Extraction with plain patterns is done by the JVM's regular expressions; what needs a parser
(nested templates, protected regions) runs as a function on Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

# ---- extraction in the JVM --------------------------------------------------------------------

LINK = r"\[\[([^\[\]|<>{}#\n]+)(?:#[^\[\]|\n]*)?(?:\|[^\[\]]*)?\]\]"
CATEGORY = r"(?i)\[\[\s*Category\s*:\s*([^\[\]|\n]+?)\s*(?:\|([^\[\]\n]*))?\]\]"
URL = r"https?://[^\s\[\]<>\"'|{}]*[^\s\[\]<>\"'|{}.,;:!?)]"
HEADING = r"(?m)^(={1,6})[ \t]*([^=\n].*?)[ \t]*={1,6}[ \t]*$"
DISABLED = r"(?is)<!--.*?-->|<nowiki>.*?</nowiki>|<pre>.*?</pre>|<source\b[^>]*>.*?</source>|<includeonly>.*?</includeonly>"


def link_targets(text: Column) -> Column:
    """Targets of internal links in order, without sections and link texts; repeated ones repeat."""
    return F.transform(F.regexp_extract_all(text, F.lit(LINK), F.lit(1)), lambda x: F.trim(x))


def category_links(text: Column) -> Column:
    """array<struct<category, sort_key>>; repeated categories are kept, a missing key is ''."""
    names, keys = F.regexp_extract_all(text, F.lit(CATEGORY), F.lit(1)), F.regexp_extract_all(text, F.lit(CATEGORY), F.lit(2))
    return F.arrays_zip(names.alias("category"), keys.alias("sort_key"))


def external_urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(URL), F.lit(0))


def headings(text: Column) -> Column:
    """array<struct<marks, heading>>: the equal signs give the level."""
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(HEADING), F.lit(1)).alias("marks"), F.regexp_extract_all(text, F.lit(HEADING), F.lit(2)).alias("heading"))


def without_disabled_parts(text: Column) -> Column:
    """Text without comments and the regions in which markup has no meaning."""
    return F.regexp_replace(text, DISABLED, "")


def without_categories(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)\[\[\s*Category\s*:[^\[\]\n]*\]\][ \t]*\n?", "")


def unescape(text: Column) -> Column:
    """The five entities of markup; &amp; last, so that nothing is decoded twice."""
    for entity, ch in (("&lt;", "<"), ("&gt;", ">"), ("&apos;", "'"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(ch))
    return text


# ---- cosmetic rewriting in the JVM ------------------------------------------------------------


def valid_breaks(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)<br[ /]*>", "<br />")


def spaced_headings(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)^(={1,6})[ \t]*([^=\n].*?)[ \t]*(={1,6})[ \t]*$", "$1 $2 $3")


def without_useless_spaces(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?m)[ \t]+$", ""), r"(?<=\S)  +(?=\S)", " ")


def spaces_in_lists(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)^([*#:]+)([^\s*#:;'|{}\[\]=<>-])", "$1 $2")


def html_to_wiki(text: Column) -> Column:
    """<b>, <strong>, <i>, <em>, <hr> and lines of <h1>-<h6> as wikitext."""
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)</?(?:b|strong)>", "'''"), r"(?i)</?(?:i|em)>", "''")
    text = F.regexp_replace(text, r"(?im)^<hr[ /]*>$", "----")
    for n in range(1, 7):
        text = F.regexp_replace(text, rf"(?im)^<h{n}>\s*(.*?)\s*</h{n}>$", "=" * n + " $1 " + "=" * n)
    return text


def typography(text: Column) -> Column:
    """ccm before a number's end becomes cm³; the ordinal sign before C or F the degree sign."""
    return F.regexp_replace(F.regexp_replace(text, r"(\d)\s*(?:&nbsp;)?ccm\b", "$1 cm³"), r"(\d\s*)º([CF])\b", "$1°$2")


def percent_without_nbsp(text: Column) -> Column:
    return F.regexp_replace(text, r"(\d)&nbsp;%", "$1 %")


def cosmetic(text: Column) -> Column:
    """All cosmetic steps, in their fixed order."""
    for step in (valid_breaks, html_to_wiki, spaced_headings, spaces_in_lists, percent_without_nbsp, typography, without_useless_spaces):
        text = step(text)
    return text


# ---- protected regions ------------------------------------------------------------------------

_REGIONS: dict[str, str] = {
    "comment": r"<!--.*?-->",
    "header": r"^=+[^\n]*?=+[ \t]*$",
    "pre": r"<pre\b[^>]*>.*?</pre>",
    "source": r"<source\b[^>]*>.*?</source>",
    "nowiki": r"<nowiki>.*?</nowiki>",
    "math": r"<math\b[^>]*>.*?</math>",
    "ref": r"<ref\b[^>/]*>.*?</ref>",
    "table": r"^\{\|.*?^\|\}",
    "hyperlink": r"https?://[^\s\[\]<>\"|]+",
    "gallery": r"<gallery\b[^>]*>.*?</gallery>",
    "link": r"\[\[[^\[\]|]*(?:\|[^\[\]]*)?\]\]",
    "interwiki": r"\[\[:?[a-z-]{2,12}:[^\[\]]*\]\]",
    "startspace": r"^ [^\n]*$",
    "inputbox": r"<inputbox>.*?</inputbox>",
    "invoke": r"\{\{\s*#invoke:.*?\}\}",
}


def _template_spans(text: str) -> list[tuple[int, int]]:
    """Outermost {{...}} regions, nested ones inside."""
    spans, depth, start = [], 0, 0
    for m in re.finditer(r"\{\{|\}\}", text):
        if m[0] == "{{":
            start = m.start() if depth == 0 else start
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                spans.append((start, m.end()))
    return spans


def protected_spans(text: str, exceptions: list[str | re.Pattern]) -> list[tuple[int, int]]:
    """Regions by name, any tag's name, or a compiled pattern; sorted."""
    spans: list[tuple[int, int]] = []
    for e in exceptions:
        if e == "template":
            spans += _template_spans(text)
            continue
        p = e if isinstance(e, re.Pattern) else re.compile(_REGIONS.get(e, rf"<{re.escape(e)}\b[^>]*>.*?</{re.escape(e)}>"), re.S | re.M | re.I)
        spans += [m.span() for m in p.finditer(text) if m.end() > m.start()]
    return sorted(spans)


def replace_except(text: str | None, old: str | re.Pattern, new: str | Callable[[re.Match], str], exceptions: list[str | re.Pattern] = (), ignore_case: bool = False, allow_overlap: bool = False, marker: str = "") -> str | None:
    """Replaces matches of ``old`` that don't begin inside a protected region or run into one.

    ``new`` may be a template (\\1, \\g<name>) or a function of the match. ``allow_overlap``: search
    goes on one character after a match's beginning. ``marker`` is put after the last replacement
    (at the end where nothing was replaced). Null stays null."""
    if text is None:
        return None
    pattern = old if isinstance(old, re.Pattern) else re.compile(old, re.I if ignore_case else 0)
    spans, out, done, at, k, last = protected_spans(text, list(exceptions)), [], 0, 0, 0, None
    while at <= len(text):
        m = pattern.search(text, at)
        if not m:
            break
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        inside = next((s for s in spans[k:] if s[0] < max(m.end(), m.start() + 1) and m.start() < s[1]), None)
        if inside and inside[0] <= m.start():
            at = inside[1]  # begins in a region: go on behind it
            continue
        if inside:
            at = m.start() + 1
            continue
        repl = new(m) if callable(new) else m.expand(new)
        out += [text[done : m.start()], repl]
        last, done = sum(map(len, out)), m.end()
        at = m.start() + 1 if allow_overlap else max(m.end(), m.start() + 1)
        if at < done:
            at = done
    out.append(text[done:])
    result = "".join(out)
    if marker:
        last = len(result) if last is None else last
        result = result[:last] + marker + result[last:]
    return result


# ---- templates --------------------------------------------------------------------------------


def templates(text: str | None) -> list[tuple[str, list[tuple[str, str]]]]:
    """Templates with their parameters, inner ones before those that hold them; parameters without
    a name are numbered from 1; the last value of a name counts. Comments and nowiki don't count."""
    if not text or "{{" not in text:
        return []
    text = re.sub(r"(?<!\{)\{\{\{[^{}]*\}\}\}(?!\})", "", re.sub(DISABLED, "", text))  # parameters are no templates
    found, stack = [], []
    for m in re.finditer(r"\{\{|\}\}", text):
        if m[0] == "{{":
            stack.append(m.start())
        elif m[0] == "}}" and stack:
            start = stack.pop()
            found.append(_template(text[start + 2 : m.start()]))
    return [t for t in found if t]


def _template(body: str):
    parts = _split_top(body, "|")
    name = re.sub(r"[ _]+", " ", parts[0]).strip()
    if not name or name.startswith("#") or "\n" in name:
        return None
    params: dict[str, str] = {}
    n = 0
    for p in parts[1:]:
        key, eq, value = p.partition("=")
        if eq and "{{" not in key and "[[" not in key:
            params[key.strip()] = value.strip()
        else:
            n += 1
            params[str(n)] = p
    return name[0].upper() + name[1:], list(params.items())


def _split_top(text: str, sep: str) -> list[str]:
    out, depth, start, i = [], 0, 0, 0
    while i < len(text):
        two = text[i : i + 2]
        if two in ("{{", "[["):
            depth, i = depth + 1, i + 2
            continue
        if two in ("}}", "]]"):
            depth, i = max(0, depth - 1), i + 2
            continue
        if text[i] == sep and depth == 0:
            out.append(text[start:i])
            start = i + 1
        i += 1
    return [*out, text[start:]]


def glue_template(name: str, params: list[tuple[str, str]]) -> str:
    return "{{" + name + "".join(f"\n|{k}={v}" for k, v in params) + ("\n" if params else "") + "}}"


_TEMPLATES = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("params", T.MapType(T.StringType(), T.StringType()))]))


@F.arrow_udf(_TEMPLATES)
def templates_and_params(values: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("name", pa.string()), ("params", pa.map_(pa.string(), pa.string()))]))
    return pa.array([None if v is None else [{"name": n, "params": p} for n, p in templates(v)] for v in values.to_pylist()], kind)


# ---- tags, categories and language links ------------------------------------------------------


class _Stripper(HTMLParser):
    def __init__(self, keep):
        super().__init__(convert_charrefs=False)
        self.keep, self.out = keep, []

    def handle_starttag(self, tag, attrs):
        if tag in self.keep:
            self.out.append(f"<{tag}>")

    def handle_endtag(self, tag):
        if tag in self.keep:
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        self.out.append(data)

    def handle_entityref(self, name):
        self.out.append(f"&{name};")

    def handle_charref(self, name):
        self.out.append(f"&#{name};")


def without_tags(text: str | None, keep: tuple[str, ...] = ("tt", "nowiki", "small", "sup")) -> str | None:
    """Text without tags, but for those in ``keep`` (which lose their attributes)."""
    if text is None or "<" not in text:
        return text
    p = _Stripper(set(keep))
    p.feed(text)
    p.close()
    return "".join(p.out)


_LANG_LINK = re.compile(r"\[\[([a-z]{2,3}(?:-[a-z]+)*):([^\[\]|\n]+)(?:\|[^\[\]]*)?\]\][ \t]*\n?")


def language_links(text: str | None, languages: frozenset[str]) -> dict[str, str]:
    """{language: title}; the last link of a language counts; not in protected regions."""
    out: dict[str, str] = {}
    for m in _LANG_LINK.finditer(re.sub(DISABLED, "", text or "")):
        if m[1] in languages:
            out[m[1]] = m[2].strip()
    return out


def without_language_links(text: str, languages: frozenset[str]) -> str:
    return replace_except(text, _LANG_LINK, lambda m: "" if m[1] in languages else m[0], ["comment", "nowiki", "pre", "source", "math"]).strip()


def with_language_links(text: str, links: dict[str, str], languages: frozenset[str], first: tuple[str, ...] = (), newline: str = "\r\n") -> str:
    """The text with these language links at its end: languages in ``first`` lead, others by code."""
    body = without_language_links(text, languages)
    order = [l for l in first if l in links] + sorted(l for l in links if l not in first)
    return body + (newline * 2 if body and order else "") + "".join(f"[[{l}:{links[l]}]]{newline}" for l in order)


def without_live_categories(text: str) -> str:
    """Text without its categories and the ends of their lines; those in comments and code stay."""
    return replace_except(text, re.compile(r"(?i)\[\[\s*Category\s*:[^\[\]\n]*\]\][ \t]*\n?"), "", ["comment", "nowiki", "pre", "source", "math"])


def with_categories(text: str, names: list[str], newline: str = "\r\n") -> str:
    """The text with these categories at its end."""
    body = re.sub(CATEGORY + r"[ \t]*\r?\n?", "", text).rstrip()
    return body + (newline * 2 if body and names else "") + "".join(f"[[Category:{n}]]{newline}" for n in names)


def replace_category(text: str, old: str, new: str | None, sort_key: str | None = None) -> str:
    """Renames (new None: removes) one category in place; spaces, underscores and the first letter's case don't matter."""
    first = f"[{re.escape(old[0].upper())}{re.escape(old[0].lower())}]" if old else ""
    name = first + "[ _]+".join(re.escape(w) for w in re.split(r"[ _]+", old[1:]))
    pattern = re.compile(rf"\[\[\s*category\s*:\s*{name}\s*(\|[^\[\]\n]*)?\]\]([ \t]*\n)?", re.I)

    def put(m: re.Match) -> str:
        if new is None:
            return ""
        return f"[[Category:{new}{'|' + sort_key if sort_key is not None else m[1] or ''}]]{m[2] or ''}"

    return replace_except(text, pattern, put, ["nowiki", "comment", "pre", "source"])


def merged_references(text: str) -> str:
    """Equal <ref>s of a group get one name at the first and point to it at the others."""
    refs: dict[tuple[str, str], list[re.Match]] = {}
    for m in re.finditer(r"<ref(?P<attrs>[^>/]*)>(?P<body>.*?)</ref>", text, re.S | re.I):
        group = re.search(r"group\s*=\s*[\"']?([^\"'\s>]+)", m["attrs"])
        refs.setdefault((group[1] if group else "", m["body"].strip()), []).append(m)
    edits, n = [], 0
    for (group, body), ms in refs.items():
        if len(ms) < 2:
            continue
        name = next((x[1] for m in ms if (x := re.search(r"name\s*=\s*[\"']?([^\"'>]+?)[\"']?\s*(?:$|group)", m["attrs"]))), None)
        if name is None:
            n += 1
            name = f"ref{n}"
        g = f' group="{group}"' if group else ""
        edits.append((ms[0].span(), f'<ref name="{name}"{g}>{body}</ref>'))
        edits += [(m.span(), f'<ref name="{name}"{g} />') for m in ms[1:]]
    for (a, b), new in sorted(edits, reverse=True):
        text = text[:a] + new + text[b:]
    return text


def unlinked(text: str, title: str) -> str:
    """Links to ``title`` become their texts."""
    first = f"[{re.escape(title[0].upper())}{re.escape(title[0].lower())}]" + re.escape(title[1:]).replace(r"\ ", "[ _]")
    return replace_except(text, re.compile(rf"\[\[\s*({first})\s*(?:#[^\[\]|]*)?(?:\|([^\[\]]*))?\]\]"), lambda m: m[2] if m[2] is not None else m[1], ["nowiki", "comment"])


def rewrite_udf(f: Callable[[str], str]):
    """A text -> text function as a column function on Arrow batches; null stays null."""

    @F.arrow_udf(T.StringType())
    def rewrite(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f(v) for v in values.to_pylist()], pa.string())

    return rewrite


def table_to_wiki(text: str) -> str:
    """HTML tables as wikitables; attributes of table, row and cell are kept."""
    if "<table" not in text.lower():
        return text
    text = re.sub(r"(?is)\s*<table\b([^>]*)>", lambda m: "\n{|" + m[1].rstrip(), text)
    text = re.sub(r"(?i)\s*</table>", "\n|}", text)
    text = re.sub(r"(?is)\s*<caption\b[^>]*>(.*?)</caption>", lambda m: "\n|+ " + m[1].strip(), text)
    text = re.sub(r"(?is)\s*<tr\b([^>]*)>", lambda m: "\n|-" + m[1].rstrip(), text)
    for tag, mark in (("th", "!"), ("td", "|")):
        text = re.sub(rf"(?is)\s*<{tag}\b([^>]*)>(.*?)(?=\s*(?:</?t[dhr]\b|</?table|\n\|[}}-]))", lambda m, mark=mark: f"\n{mark}{m[1] + ' |' if m[1].strip() else ''} {m[2].strip()}", text)
    return re.sub(r"(?i)\s*</?t[dhr]\b[^>]*>", "", text)


def plain_text(text: str) -> str:
    """Words of a wikitext without its markup."""
    text = re.sub(DISABLED, "", text)
    for _ in range(20):
        new = re.sub(r"\{\{[^{}]*\}\}", "", text)
        if new == text:
            break
        text = new
    text = re.sub(r"(?is)<ref\b[^>/]*>.*?</ref>|<ref\b[^>]*/>|^\{\|.*?^\|\}", "", text, flags=re.M)
    text = re.sub(r"(?i)\[\[(?:category|file|image):[^\[\]]*\]\]", "", text)
    text = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]", r"\1", text)
    text = re.sub(r"\[https?://\S+ ?([^\]]*)\]", r"\1", text)
    text = re.sub(r"'{2,5}|^=+\s*|\s*=+\s*$|^[*#:;]+\s*", "", without_tags(text, ()), flags=re.M)
    return re.sub(r"[ \t]+", " ", text).strip()
