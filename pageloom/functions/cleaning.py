"""Cosmetic steps and fix sets as tables of rules, each with the regions that it leaves alone.

A step is a list of (pattern, replacement). Texts that no pattern of a step can match never leave the
JVM; the rest go through ``replace_except`` on Arrow batches.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, functions as F

from pageloom.functions.wikitext import replace_except, rewrite_udf

CODE = ("comment", "math", "nowiki", "pre")
CODE_LINES = (*CODE, "source", "startspace")


@dataclass(frozen=True)
class Step:
    name: str
    #: A pattern of the JVM that every text has which the step can change.
    hint: str
    rules: tuple[tuple[str, str], ...]
    regions: tuple = CODE

    def __call__(self, text: str | None) -> str | None:
        for old, new in self.rules:
            pattern = re.compile(old)
            if text is not None and pattern.search(text):  # else there is no need to look for regions
                text = replace_except(text, pattern, new, list(self.regions))
        return text


BREAKS = Step("breaks", r"(?i)<br", ((r"(?i)<br[ /]*>", "<br />"),))
HTML = Step(
    "html", r"(?i)<(b|strong|i|em|hr|h[1-6])\b",
    (
        *((rf"(?i)<{tag}>(.*?)</{tag}>", rf"{marks}\1{marks}") for tag, marks in (("b", "'''"), ("strong", "'''"), ("i", "''"), ("em", "''"))),
        (r"(?im)^<hr[ /]*>$", "----"), (r"(?i)<hr ([^>/]+?)>", r"<hr \1 />"),
        *((rf"(?im)^ *<h{n}> *([^<\n]+?) *</h{n}> *$", "=" * n + r" \1 " + "=" * n) for n in range(1, 7)),
    ),
    CODE_LINES,
)
HEADINGS = Step("headings", r"(?m)^=", ((r"(?m)^(={1,6})[ \t]*([^=\n]+?)[ \t]*\1[ \t]*$", r"\1 \2 \1"),))
LISTS = Step("lists", r"(?m)^[:;]*[*#]", ((r"(?m)^(?!(?i:#REDIRECT))([:;]*[*#]+[:;*#]*)(?=[^\s*#:;])", r"\1 "),), (*CODE, "source", "template"))
SPACES = Step("spaces", r"(?m)  | $", ((r"  +", " "), (r"(?m) +$", "")), (*CODE, "startspace", "table", "template"))
PERCENT = Step("percent", r"\d&nbsp;%", ((r"(\d)&nbsp;%", r"\1 %"),), ())
REFERENCES = Step(
    "references", r"(?i)<ref",
    ((r'(?i)<ref +name(?: *=|= *) *"', '<ref name="'), (r"(?i)<ref\s*/>|<ref *>\s*</ref>", ""), (r"(?i)<ref\s+([^>/]+?)\s*>\s*</ref>", r"<ref \1/>")),
    CODE_LINES,
)
_LITERAL = (*CODE_LINES, "gallery", "hyperlink", "interwiki", "link")
UNITS = Step("units", r"\d\s*(&nbsp;)?ccm", ((r"(\d)\s*(?:&nbsp;)?ccm\b", r"\1&nbsp;cm³"),), _LITERAL)
DEGREES = Step("degrees", "º|°", ((r"(\d)\s*(?:&nbsp;)?[º°]([CF])", r"\1&nbsp;°\2"), (r"º([CF])", r"°\1")), (*_LITERAL, re.compile("«.*?»")))
TABLE_CLASS = Step("table class", "prettytable", ((r'(class="[^"]*)prettytable([^"]*")', r"\1wikitable\2"),), CODE_LINES)
#: The steps of a page's cleaning, in order.
COSMETIC = (BREAKS, HTML, HEADINGS, LISTS, PERCENT, REFERENCES, UNITS, DEGREES, SPACES)

_FILE_CODE = ("comment", "includeonly", "noinclude", *CODE[1:], "source", "ref")
#: Descriptions of files: headings and field values by their translatable names.
FILE_DESCRIPTION = Step(
    "file description", r"(?i)==|\| *(source|permission) *=|__NOTOC__|\{\{ImageUpload",
    (
        (r"(?im)^== *Summary *==", "== {{int:filedesc}} =="),
        (r"(?im)^== *(?:\[\[Commons:Copyright tags\|Licensing\]\]:|Licensing|License information|\{\{int:license\}\}) *==", "== {{int:license-header}} =="),
        (r"(?im)^(\|source *= *)(?:own work by uploader|own work|eigene arbeit) *$", r"\1{{own}}"),
        (r"(?im)(\| *Permission *=) *(?:see below|siehe unten) *$", r"\1"),
        (r"__NOTOC__", ""),
        (r"(?i)\{\{ImageUpload\|(?:basic|full)\}\}", ""),
        *((rf"(?im)^== *\{{\{{int:{name}\}}\}} *==\s*== *\{{\{{int:{name}\}}\}} *==", f"== {{{{int:{name}}}}} ==") for name in ("filedesc", "license-header")),
    ),
    _FILE_CODE,
)

_ADDRESS = r"https?://[^\s\[\]|]+?"
#: Fix sets by name; those marked in ``SUPERVISED`` can go wrong and want a look at each change.
FIX_SETS: dict[str, tuple[Step, ...]] = {
    "HTML": (replace(HTML, regions=CODE),),
    "syntax-safe": (
        Step(
            "links", r"\[\[?https?://",
            ((r"\[\[(https?://[^\]]+?)\]\]", r"[\1]"), (r"\[\[(https?://[^\]\n]+?)\](?!\])", r"[\1]"), (rf"\[({_ADDRESS}) +\| *([^|\]]+?)\]", r"[\1 \2]"),
             (rf"\[({_ADDRESS}\.(?:pdf|html?|php|aspx?|jsp)) *\| *([^|\]]+?)\]", r"[\1 \2]")),
            CODE_LINES,
        ),
    ),
    "syntax": (
        Step(
            "brackets", r"[\[{]",
            ((r"\[\[(https?://[^\]]+?)\]\]", r"[\1]"), (r"\[\[(https?://[^\]\n]+?)\](?!\])", r"[\1]"), (r"(?<!\[)\[(https?://[^\[\]]+?)\]\](?!\])", r"[\1]"), (rf"\[({_ADDRESS}) *\| *([^|\]]+?)\]", r"[\1 \2]"),
             (r"\[\[([^\[\]]+?)\](?!\])", r"[[\1]]"), (r"(?<!\[)\[(?!https?:)([^\[\]]+?)\]\](?!\])", r"[[\1]]"), (r"\{\{([^{}]+?)\}(?!\})", r"{{\1}}")),
            CODE_LINES,
        ),
    ),
    "grammar-de": (
        Step(
            "commas", r"[a-zäöüß](\]\])? ?[,.!?]",
            ((r"([a-zäöüß](?:\]\])?,)((?:\[\[)?[a-zäöüA-ZÄÖÜ])", r"\1 \2"), (r"([a-zäöüß](?:\]\])?) ,((?:\[\[)?[a-zäöüA-ZÄÖÜ])", r"\1, \2"), (r"([a-zäöüß](?:\]\])?) ([,.!?]) ((?:\[\[)?[a-zäöüA-ZÄÖÜ])", r"\1\2 \3")),
            (*CODE_LINES, "hyperlink", "gallery", "template"),
        ),
        Step("numbers", r"\d(jährig|tägig|stündig|fach|mal)", ((r"(\d+)(minütig|stündig|tägig|wöchig|jährig|fach|mal|köpfig|teilig)", r"\1-\2"),), (*CODE_LINES, "hyperlink", "gallery")),
        Step("units", r"\d(km|kg|cm|mm|ml|kW|MHz|GHz|°C)", ((r"(?<!\w)(\d+(?:[.,]\d+)?)(km|kg|cm|mm|ml|kW|MW|Hz|kHz|MHz|GHz|°C)(?=\W|$)", r"\1 \2"), (r"(?<!\w)(\d+(?:[.,]\d+)?)° C(?=\W|$)", r"\1 °C")), (*CODE_LINES, "hyperlink", "gallery", "template")),
    ),
    "spaces": (Step("punctuation", r" [,.;:]|  ", ((r" +([,.;:])(?=\s)", r"\1"), (r"(\S) {2,}(?=\S)", r"\1 ")), (*CODE, "source", "template", "table", "hyperlink", "startspace")),),
    "percent": (PERCENT,),
    "references": (REFERENCES,),
    "file-description": (FILE_DESCRIPTION,),
}
SUPERVISED = ("syntax", "grammar-de")


def apply_steps(text: str | None, steps: tuple[Step, ...]) -> str | None:
    for s in steps:
        text = s(text)
    return text


def cleaned(text: Column, steps: tuple[Step, ...] = COSMETIC) -> Column:
    """The text after the steps; null stays null. Texts with nothing to change stay in the JVM."""
    possible = text.rlike("|".join(f"(?:{s.hint})" for s in steps)) if len(steps) == 1 else F.lit(False)
    for s in steps if len(steps) > 1 else ():
        possible = possible | text.rlike(s.hint)
    return F.coalesce(rewrite_udf(lambda t: apply_steps(t, steps))(F.when(possible, text)), text)


# ---- letters ----------------------------------------------------------------------------------

_ARABIC_REGIONS = ["gallery", "hyperlink", "interwiki", "math", "pre", "template", "ref", "source", "startspace", "inputbox"]
#: Letters that stand in Arabic, Persian and Kurdish words.
_ARABIC = r"؀-ۿ"


def arabic_letters(text: str | None, lang: str) -> str | None:
    """Persian (fa) or Kurdish (ckb) text with that language's comma, kaf, yeh and heh; Latin matter and files stay."""
    if text is None or lang not in ("fa", "ckb"):
        return text
    keep = [*_ARABIC_REGIONS, re.compile(r"\[\[(?:File|Image):.+?\]\]"), re.compile(rf'[^{_ARABIC}] *"* *, *[^{_ARABIC}]')]
    rules = [(",", "،")]
    if lang == "ckb":
        rules += [("ه(?=[.،_<\\]\\s])", "ە"), ("ه‌", "ە"), ("ه", "ھ")]
    for old, new in [*rules, ("ك", "ک"), ("[ىي]", "ی")]:
        text = replace_except(text, re.compile(old), new, keep)
    return text


def resolve_entities(text: str | None, keep: frozenset[int] = frozenset({38, 39, 60, 62, 91, 93, 124, 160, 173, 8206, 8207})) -> str | None:
    """Entities as characters, but for those that would become markup."""

    def one(m: re.Match) -> str:
        ch = html.unescape(m[0])
        return m[0] if len(ch) != 1 or ord(ch) in keep else ch

    return replace_except(text, re.compile(r"&#?\w+;"), one, list(CODE))


def replace_deprecated(text: str | None, templates: dict[str, str | None]) -> str | None:
    """Templates by their successors (None: removed), outside code."""
    for old, new in templates.items():
        name = rf"\{{\{{(?:[Tt]emplate:)?[{old[0].upper()}{old[0].lower()}]{re.escape(old[1:])}(\|[^{{}}]*)?\}}\}}"
        text = replace_except(text, re.compile(name), (lambda m, n=new: "{{" + n + (m[1] or "") + "}}") if new is not None else "", list(CODE))
    return text


# ---- links ------------------------------------------------------------------------------------


def redirected_links(text: str | None, targets: dict[str, str]) -> str | None:
    """Links to redirects lead to their targets and keep their texts; the first letter's case and underscores don't matter."""
    if text is None or not targets:
        return text
    by = {k[:1].upper() + k[1:]: v for k, v in targets.items()}

    def one(m: re.Match) -> str:
        written = m[1].strip()
        name = re.sub(r"[_ ]+", " ", written).strip()
        new = by.get(name[:1].upper() + name[1:])
        return m[0] if new is None else f"[[{new}{m[2] or ''}|{m[3] if m[3] is not None else written}]]"

    return replace_except(text, re.compile(r"\[\[([^\[\]|#]+)(#[^\[\]|]*)?(?:\|([^\[\]]*))?\]\]"), one, list(CODE))


def numbered_notes(text: str | None, heading: str = "References", template: str = "ref") -> str | None:
    """Bare and bracketed addresses before the notes' heading become {{ref|name}} with a list of notes at
    the heading (or the end); an address that comes again gets the same note."""
    if text is None:
        return None
    m = re.search(rf"(?m)^=+ *{re.escape(heading)} *=+ *$", text)
    head, tail = (text[: m.start()], text[m.start() :]) if m else (text, "")
    notes: dict[str, tuple[str, str]] = {}

    def one(x: re.Match) -> str:
        url = x["a"] or x["b"]
        name, _ = notes.setdefault(url, (f"note{len(notes) + 1}", (x["label"] or "").strip()))
        return f"{{{{{template}|{name}}}}}"

    head = replace_except(head, re.compile(r"\[(?P<a>https?://[^\s\]]+)(?P<label>[^\]]*)\]|(?P<b>https?://[^\s\[\]<>\"|{}]*[^\s\[\]<>\"|{}.,;:!?)])"), one, [*CODE, "template", "ref"])
    if not notes:
        return text
    lines = "".join(f"# {{{{note|{n}}}}} [{u}{' ' + l if l else ''}]\n" for u, (n, l) in notes.items())
    if not m:
        return head.rstrip() + f"\n\n== {heading} ==\n{lines}"
    first, _, rest = tail.partition("\n")
    return f"{head}{first}\n{lines}{rest}"


def note_links(text: str | None) -> list[str]:
    return re.findall(r"\{\{note\|([^{}|]+)\}\}", text or "")
