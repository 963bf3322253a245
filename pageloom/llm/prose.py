"""Sentences of a wiki text: markup that holds no prose is taken out, the rest is split."""

from __future__ import annotations

import re

#: Not prose: comments, citations, templates, categories and files, headings, signatures, tables' marks, tags.
_NOT_PROSE = re.compile(
    r"<!--.*?-->|<ref[^<>/]*/>|<ref\b.*?</ref>|\{\{[^{}]*\}\}|\[\[(?:Category|File|Image):[^\[\]]*\]\]|^=+[^=\n]+=+[ \t]*$|--+ ?\[\[User:[^\[\]]*\]\](?: \d\d:\d\d)?|<[^<>]{0,200}>",
    re.S | re.M | re.I,
)
_MARKS = re.compile(r"\[\[(?:[^\[\]|]*\|)?|\]\]|'{2,5}|^[ \t]*[:*#>;]+[ \t]*", re.M)
_ENTITY = re.compile(r"&(?:nbsp|#160|#xa0);", re.I)
_ENDS = re.compile(r"([.?!…][\"'”’»“)\]]{0,2})\s+|\n+")
_COMPLETE = re.compile(r"[.?!…][\"'”’»“)\]]*\s*\Z")


def prose(text: str) -> str:
    """Text with what is no prose replaced by spaces of the same length, so that places stay."""
    if "<" in text or "{{" in text or "[[" in text or "==" in text:
        text = _NOT_PROSE.sub(lambda m: " " * len(m[0]) if "\n" not in m[0] else "\n" * len(m[0]), text)
    if "[[" in text or "''" in text or text[:1] in ":*#>;" or "\n" in text:
        text = _MARKS.sub(lambda m: " " * len(m[0]), text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: " " * len(m[0]), text)
    return text


def pieces(text: str) -> list[tuple[int, str]]:
    """(place, sentence) of the prose. A line that goes on an unfinished sentence belongs to it;
    an empty line or a heading ends one."""
    spans: list[tuple[int, int]] = []
    at, gap = 0, "\n\n"
    for m in [*_ENDS.finditer(text), None]:
        end = len(text) if m is None else m.start() if m[1] is None else m.end(1)
        if end > at:
            piece = text[at:end]
            if piece.isspace():
                gap = "\n\n"
            else:
                if gap == "\n" and spans and not _COMPLETE.search(text, *spans[-1]):
                    spans[-1] = (spans[-1][0], end)
                else:
                    spans.append((at, end))
                gap = ""
        if m:
            gap = "\n\n" if gap == "\n\n" or m[0].count("\n") > 1 else "\n" if "\n" in m[0] else " "
            at = m.end()
    return [(a, text[a:b]) for a, b in spans]


def complete(piece: str) -> bool:
    return bool(_COMPLETE.search(piece))
