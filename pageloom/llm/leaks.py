"""Problem 7: evaluation texts leaking into training text.

One Aho-Corasick automaton holds every run of six consecutive words of all items, normalised; each
text is normalised and scanned once. Words of the items are numbered and written as two letters of an
alphabet as small as that allows (all other words are one more pair), so the automaton has at most
twelve states a window and few ways on from each. A run of six or more words is the union of its six-word windows, so the covered words of an item are
exact. Only for texts with enough covered words are the places mapped back to the original text.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pageloom.llm.lookalikes import canonical

RUN = 6
SHARE = 0.5
#: One automaton holds items of up to this many bytes of text (the test items of all known suites together are fewer);
#: its states take some hundred bytes a word in each Python worker. Longer lists go out as several automata, each of which
#: scans the texts once more.
AUTOMATON_BYTES = 8 << 20
#: Items are held on the driver; more text than this is refused.
MAX_ITEM_BYTES = 1 << 30

#: A tag: a name, attributes with values, and between them fewer loose words than a run has, so that
#: a '<' and a later '>' of the text hide no run. Comments are text: their marks are no words.
_VALUE = r"""\s+[\w:.-]+\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>]+)"""
_LOOSE = r"""(?>[^\w<>]+)(?![\w:.-]+\s*=)\w+"""
_TAG = rf"</?[A-Za-z][\w:-]*+(?:(?>(?:{_LOOSE}){{0,{RUN - 1}}})(?>{_VALUE}))*+(?>(?:{_LOOSE}){{0,{RUN - 1}}})[^\w<>]*+>"
_MARKUP = re.compile(_TAG + r"|\[\[[^\[\]|]*\||'{2,5}|\[(?:https?|ftp)://\S*", re.S)
_NOT_WORD = re.compile(r"[\W_]+")
_SIMPLE = str.maketrans({chr(i): " " for i in range(128) if not chr(i).isalnum()})


def plain(text: str) -> str:
    """The words of a text in one form, with one space between and around them."""
    if "<" in text or "[[" in text or "''" in text or "://" in text:
        text = _MARKUP.sub(lambda m: " " if m[0][0] == "<" else "", text)
    if "&" in text:
        text = html.unescape(text)
    if text.isascii():
        return f" {' '.join(text.lower().translate(_SIMPLE).split())} "
    text = unicodedata.normalize("NFC", canonical(text).lower())
    return f" {_NOT_WORD.sub(' ', text).strip()} "


def word_spans(text: str) -> list[tuple[int, int]]:
    """Places in ``text`` of the words of ``plain(text)``: markup is blanked, entities and invisible
    characters are followed through the same steps by character."""
    kept: list[tuple[str, int, int]] = []
    at = 0
    pieces = [(m.start(), m.end(), m[0]) for m in _MARKUP.finditer(text)] + [(len(text), len(text), "")]
    for a, b, what in pieces:
        for m in re.finditer(r"&#?\w+;|.", text[at:a], re.S):
            kept += [(ch, at + m.start(), at + m.end()) for ch in (html.unescape(m[0]) if len(m[0]) > 1 else m[0])]
        if what[:1] == "<":
            kept.append((" ", a, b))
        at = b
    # normalise in groups of a starter with what follows it, so that places stay known
    groups: list[list] = []
    for ch, a, b in kept:
        if groups and (unicodedata.combining(ch) or canonical(ch) == ""):
            groups[-1][0] += ch
            groups[-1][2] = b
        else:
            groups.append([ch, a, b])
    spans: list[tuple[int, int]] = []
    inside = False
    for chars, a, b in groups:
        for ch in unicodedata.normalize("NFC", (canonical(chars) or "").lower()):
            if ch.isalnum():
                if inside:
                    spans[-1] = (spans[-1][0], b)
                else:
                    spans.append((a, b))
                inside = True
            else:
                inside = False
    return spans


class LeakFinder:
    """The automaton of some items; it is built once and sent to the workers."""

    def __init__(self, items: list[tuple[int, str]], run: int = RUN, share: float = SHARE, short: bool = False):
        import ahocorasick

        self.run, self.share = run, share
        self.ids = [i for i, _ in items]
        texts = [plain(t).split() for _, t in items]
        self.sizes = np.array([len(t) for t in texts], np.int64)
        words = {w: n for n, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        base = math.isqrt(max(len(words) - 1, 0)) + 1
        # first and second letters differ, so that nothing is found between two words
        self.letters = {w: chr(2 + n // base) + chr(2 + base + n % base) for w, n in words.items()}
        coded = ["".join([self.letters[w] for w in t]) for t in texts]
        keys: dict[str, int] = {}
        of_key, item, place = [], [], []
        for k, c in enumerate(coded):
            n = len(c) // 2
            for p in range(n - run + 1) if n >= run else range(int(short and n > 0)):
                of_key.append(keys.setdefault(c[2 * p : 2 * (p + run)], len(keys)))
                item.append(k)
                place.append(p)
        # the (item, place)s of key i stand at first[i] to first[i + 1]
        order = np.argsort(np.array(of_key, np.int64), kind="stable")
        self.first = np.searchsorted(np.array(of_key, np.int64)[order], np.arange(len(keys) + 1))
        self.item, self.place = np.array(item, np.int32)[order], np.array(place, np.int32)[order]
        self.lengths = np.array([len(c) // 2 for c in keys], np.int32)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for c, i in keys.items():
            self.automaton.add_word(c, i)
        self.empty = not keys
        if keys:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, list[tuple[int, int]]]]:
        """(item, covered words, words, places) of each item of which the text holds enough."""
        if not text or self.empty:
            return []
        letters, other = self.letters.get, "\1\1"
        coded = "".join([letters(w, other) for w in plain(text).split()])
        hits = list(self.automaton.iter(coded))
        if not hits:
            return []
        first, covered, runs = self.first, {}, {}
        for end, key in hits:
            n, end = int(self.lengths[key]), end // 2
            for j in range(first[key], first[key + 1]):
                k, p = int(self.item[j]), int(self.place[j])
                covered.setdefault(k, set()).update(range(p, p + n))
                runs.setdefault(k, []).append((end - n + 1, end))
        found = [k for k, c in covered.items() if len(c) >= self.share * self.sizes[k]]
        if not found:
            return []
        spans = word_spans(text)
        return [(self.ids[k], len(covered[k]), int(self.sizes[k]), self._places(runs[k], spans)) for k in found]

    def _places(self, runs: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[list[int]] = []
        for first, last in sorted(runs):
            if last < len(spans):
                if out and first <= out[-1][1] + 1:
                    out[-1][1] = max(last, out[-1][1])
                else:
                    out.append([first, last])
        return [(spans[a][0], spans[b][1]) for a, b in out]


SCHEMA = "doc_id bigint, item_id bigint, covered int, words int, places array<struct<start:int,stop:int>>"


def leaks(
    docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", run: int = RUN, share: float = SHARE, short: bool = False, automaton_bytes: int = AUTOMATON_BYTES
) -> DataFrame:
    """Documents with the items they hold: at least ``share`` of the item's words stand in the text
    in runs of ``run`` or more consecutive words of the item. ``places`` are those runs in the
    original text (start, stop). No shuffle; whole texts are scanned.

    Null and empty texts hold nothing and are held by nothing; items of fewer than ``run`` words
    can't be held, or, with ``short``, are held where all their words stand in a row. Repeated
    documents are each reported; repeated items too, under their own id."""
    text = F.col(f"`{item_text}`")
    # the held-out items are few by nature; their size is checked before they come to the driver
    size = items.agg(F.sum(F.octet_length(text))).first()[0] or 0
    if size > MAX_ITEM_BYTES:
        raise ValueError(f"{size} bytes of items, more than {MAX_ITEM_BYTES}; call leaks() on parts of them")
    rows = [(r[0], r[1]) for r in items.select(F.col(f"`{item_col}`"), text).filter(text.isNotNull()).collect()]
    rows.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    narrow = docs.select(F.col(f"`{doc_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    blocks, held = [[]], 0
    for r in rows:
        if blocks[-1] and held + len(r[1]) > automaton_bytes:
            blocks.append([])
            held = 0
        blocks[-1].append(r)
        held += len(r[1])
    out = None
    for block in blocks:
        part = narrow.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(LeakFinder(block, run, share, short))), SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def _scan(shipped):
    def scan(batches):
        import pyarrow as pa

        finder = shipped.value
        schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("covered", pa.int32()), ("words", pa.int32()), ("places", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])
        for b in batches:
            rows = [(d, *hit) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for hit in finder.find(t)]
            if rows:
                cols = list(zip(*rows))
                places = [[{"start": a, "stop": z} for a, z in p] for p in cols[4]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*cols[:4], places], schema)], schema=schema)

    return scan
