"""Scalar functions: sizes and intervals written as text, ISBNs, Roman numbers, centuries and
decades, Esperanto's x-notation, entities, spelling distance, addresses."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# ---- intervals and sizes ----------------------------------------------------------------------


def seconds_of(text: Column) -> Column:
    """'7d', '36h', '90' -> seconds; null for other text."""
    n = F.regexp_extract(text, r"^(\d+)[dh]?$", 1)
    unit = F.regexp_extract(text, r"^\d+([dh]?)$", 1)
    return F.when(n != "", n.cast("bigint") * F.when(unit == "d", 86400).when(unit == "h", 3600).otherwise(1))


def size_of(text: Column) -> Column:
    """'150K', '2M', '10T', '500' -> struct(n, unit): bytes ('B') or threads ('T'); null for other text."""
    n = F.regexp_extract(text, r"^(\d+) ?(?:[kKmMtT]?)$", 1)
    unit = F.upper(F.regexp_extract(text, r"^\d+ ?([kKmMtT]?)$", 1))
    scaled = n.cast("bigint") * F.when(unit == "K", 1024).when(unit == "M", 1024 * 1024).otherwise(1)
    return F.when(n != "", F.struct(scaled.alias("n"), F.when(unit == "T", "T").otherwise("B").alias("unit")))


def stamp_number(iso: Column) -> Column:
    """2008-01-14T08:42:38Z -> 20080114084238."""
    return F.when(iso.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$"), F.regexp_replace(iso, r"\D", "").cast("bigint"))


# ---- ISBN -------------------------------------------------------------------------------------


def isbn_digits(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, r"[\s-]", ""))


def _digit(d: Column, i: int) -> Column:
    c = F.substring(d, i, 1)
    return F.when(c == "X", 10).otherwise(c.cast("int"))


def _weighted(d: Column, weights: list[int]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights, 1):
        total = total + _digit(d, i) * w
    return total


def isbn10_valid(text: Column) -> Column:
    """Ten digits (the last may be X) whose weighted sum divides by 11."""
    d = isbn_digits(text)
    return F.when(d.rlike(r"^\d{9}[\dX]$"), _weighted(d, list(range(1, 11))) % 11 == 0).otherwise(False)


def isbn13_valid(text: Column) -> Column:
    d = isbn_digits(text)
    return F.when(d.rlike(r"^\d{13}$"), _weighted(d, [1, 3] * 6 + [1]) % 10 == 0).otherwise(False)


def isbn13_check(first12: Column) -> Column:
    return (10 - _weighted(first12, [1, 3] * 6) % 10) % 10


def isbn10_to_13(text: Column) -> Column:
    """The 13 digits of a valid ISBN-10; a valid ISBN-13 stays; null for others."""
    d = isbn_digits(text)
    body = F.concat(F.lit("978"), F.substring(d, 1, 9))
    return F.when(isbn13_valid(text), d).when(isbn10_valid(text), F.concat(body, isbn13_check(body).cast("string")))


def thirteen(digits: str) -> str:
    """The 13 digits of an ISBN-10 (or -13), by text."""
    if len(digits) != 10:
        return digits
    body = "978" + digits[:9]
    return body + str(-sum(int(c) * (1, 3)[i % 2] for i, c in enumerate(body)) % 10)


@dataclass(frozen=True)
class IsbnRanges:
    """For each group ('0', '3', '80', ...) the ranges of publishers as texts of equal length, both ends included."""

    groups: dict[str, list[tuple[str, str]]]

    def hyphenated(self, digits: str) -> str | None:
        prefix, body = (digits[:3], digits[3:]) if len(digits) == 13 else ("", digits)
        for n in range(1, 6):
            for lo, hi in self.groups.get(body[:n], []):
                if lo <= body[n : n + len(lo)] <= hi:
                    k = n + len(lo)
                    return "-".join(x for x in (prefix, body[:n], body[n:k], body[k:-1], body[-1]) if x)
        return None


# publishers' ranges of the English, French and German groups.
COMMON_RANGES = IsbnRanges({
    "0": [("00", "19"), ("200", "699"), ("7000", "8499"), ("85000", "89999"), ("900000", "949999"), ("9500000", "9999999")],
    "1": [("00", "09"), ("100", "399"), ("4000", "5499"), ("55000", "86979"), ("869800", "998999")],
    "2": [("00", "19"), ("200", "349"), ("35000", "39999"), ("400", "699"), ("7000", "8399"), ("84000", "89999"), ("900000", "949999"), ("9500000", "9999999")],
    "3": [("00", "02"), ("030", "033"), ("0340", "0369"), ("03700", "03999"), ("04", "19"), ("200", "699"), ("7000", "8499"), ("85000", "89999"), ("900000", "949999"), ("9500000", "9539999")],
})


def rewrite_isbns(text: str, one: Callable[[str], str | None]) -> str:
    """Each number after 'ISBN ' through ``one``; what it can't do stays."""
    return re.sub(r"(?<=ISBN )(?:97[89][- ]?)?(?:\d[- ]?){9}[\dxX]", lambda m: one(re.sub(r"[- ]", "", m[0]).upper()) or m[0], text)


# ---- numbers, decades, centuries --------------------------------------------------------------


def roman(n: Column) -> Column:
    """1 to 30 in Roman numbers; null beyond."""
    tens = F.element_at(F.array(*map(F.lit, ("", "X", "XX", "XXX"))), (F.floor(n / 10) + 1).cast("int"))
    ones = F.element_at(F.array(*map(F.lit, ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"))), (n % 10 + 1).cast("int"))
    return F.when((n >= 1) & (n <= 30), F.concat(tens, ones))


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def century(year: Column) -> Column:
    """Years 1 to 100 are the first century."""
    return F.floor((year - 1) / 100 + 1).cast("int")


def english_ordinal(n: Column) -> Column:
    teen = (n % 100).between(11, 13)
    end = F.when(teen, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


class DateCodec:
    """Numbers as localised text and back, by a pattern: %d the number, %R Roman, %B the first and %G
    the last letter case kept. decode(encode(n)) = n; text that does not encode again is refused."""

    _ROMAN = ["", *(t + o for t in ("", "X", "XX", "XXX") for o in ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"))][1:]

    def __init__(self, pattern: str, to_text: Callable[[int], int] = lambda n: n, to_number: Callable[[int], int] = lambda n: n, digits: str = "0123456789"):
        self.pattern, self.to_text, self.to_number, self.digits = pattern, to_text, to_number, digits
        self.regex = re.compile(re.escape(pattern).replace("%d", f"([{re.escape(digits)}]+)").replace("%R", "([IVX]+)") + r"\Z")

    def encode(self, n: int) -> str:
        shown = self.to_text(n)
        number = str(shown).translate(str.maketrans("0123456789", self.digits)) if "%d" in self.pattern else self._ROMAN[shown]
        return self.pattern.replace("%d", number).replace("%R", number)

    def decode(self, text: str) -> int | None:
        m = self.regex.match(text)
        if not m:
            return None
        if "%R" in self.pattern:
            shown = self._ROMAN.index(m[1]) if m[1] in self._ROMAN else None
        else:
            shown = int(m[1].translate(str.maketrans(self.digits, "0123456789")))
        n = None if shown is None else self.to_number(shown)
        return n if n is not None and self.encode(n) == text else None


# How titles name years, decades and centuries.
CODECS = {
    ("year", "en"): DateCodec("%d"),
    ("year_bc", "en"): DateCodec("%d BC"),
    ("year_bc", "de"): DateCodec("%d v. Chr."),
    ("decade", "en"): DateCodec("%ds"),
    ("decade", "de"): DateCodec("%der"),
    ("decade", "fr"): DateCodec("Années %d"),
    ("decade", "nl"): DateCodec("%d-%d".replace("-%d", "-plus")),
    ("century", "de"): DateCodec("%d. Jahrhundert"),
    ("century", "nl"): DateCodec("%de eeuw"),
    ("century", "es"): DateCodec("Siglo %R"),
    ("century", "it"): DateCodec("%R secolo"),
    ("millennium", "de"): DateCodec("%d. Jahrtausend"),
}


def auto_format(title: str) -> tuple[str, str, int] | None:
    """(kind, language, number) of a title that names a date."""
    return next(((k, l, n) for (k, l), c in CODECS.items() if (n := c.decode(title)) is not None), None)


# ---- text -------------------------------------------------------------------------------------

_ESPERANTO = dict(zip("cghjsuCGHJSU", "ĉĝĥĵŝŭĈĜĤĴŜŬ"))


def esperanto_decode(text: str) -> str:
    """cx -> ĉ, cxx -> cx, and so on: pairs of x stand for one."""
    def one(m: re.Match) -> str:
        n = len(m[2])
        return (_ESPERANTO[m[1]] if n % 2 else m[1]) + m[2][0] * (n // 2)

    return re.sub(r"([cghjsuCGHJSU])([xX]+)", one, text)


def esperanto_encode(text: str) -> str:
    back = {v: k for k, v in _ESPERANTO.items()}
    text = re.sub(r"([cghjsuĉĝĥĵŝŭCGHJSUĈĜĤĴŜŬ])([xX]+)", lambda m: m[1] + m[2] * 2, text)
    return "".join(f"{back[ch]}x" if ch in back else ch for ch in text)


def ascii_entities(text: str) -> str:
    return "".join(ch if ord(ch) < 128 else f"&#{ord(ch)};" for ch in text)


def is_ip(name: Column) -> Column:
    """IPv4 or IPv6 (its long or shortened form), before any '/'."""
    head = F.regexp_extract(name, r"^([^/]*)", 1)
    v4 = head.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")
    v6 = head.rlike(r"(?i)^(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$") | (
        head.rlike(r"(?i)^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6})?::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6})?$") & (F.length(F.regexp_replace(head, "[^:]", "")) <= 7)
    )
    return F.coalesce(v4 | v6, F.lit(False))


def ip_sort_key(ip: Column) -> Column:
    """Octets padded to three digits, to sort addresses as numbers."""
    return F.array_join(F.transform(F.split(F.regexp_extract(ip, r"^([\d.]+)", 1), r"\."), lambda o: F.lpad(o, 3, "0")), ".")


def nearest_words(words, dictionary, column: str = "word", within: int = 11, most: int = 30):
    """Dictionary words nearest to each word by edits: fewer than ``within``, at most ``most`` each,
    nearest first then by the alphabet. Lengths that differ by ``within`` or more are never joined."""
    from pyspark.sql import Window

    d = dictionary.select(F.col(column).alias("candidate")).distinct().withColumn("__len", F.length("candidate"))
    w = words.select(F.col(column).alias("word")).distinct().withColumn("__n", F.explode(F.sequence(F.greatest(F.lit(0), F.length("word") - within + 1), F.length("word") + within - 1)))
    pairs = w.join(d, F.col("__n") == F.col("__len")).withColumn("distance", F.levenshtein("word", "candidate", within - 1)).filter("distance >= 0")
    rank = F.row_number().over(Window.partitionBy("word").orderBy("distance", "candidate"))
    return pairs.select("word", "candidate", "distance", rank.alias("rank")).filter(F.col("rank") <= most)
