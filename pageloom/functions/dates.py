"""Titles that name dates: numbers as localised text and back, by families of patterns, as expressions of
the JVM. A text is decoded only if its number encodes to the same text again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from pageloom.functions.scalars import english_ordinal

_ROMANS = [t + o for t in ("", "X", "XX") for o in ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")][1:] + ["XXX"]

# How titles name dates. %d number, %R Roman number, %o English ordinal, %F French Roman ordinal, %P Persian digits.
PATTERNS: dict[tuple[str, str], str] = {
    ("year", "en"): "%d", ("year", "fa"): "%P (میلادی)", ("year", "ja"): "%d年",
    ("year_bc", "en"): "%d BC", ("year_bc", "de"): "%d v. Chr.", ("year_bc", "nl"): "%d v.Chr.", ("year_bc", "fr"): "-%d", ("year_bc", "es"): "%d a. C.",
    ("decade", "en"): "%ds", ("decade", "de"): "%der", ("decade", "fr"): "Années %d", ("decade", "es"): "Años %d", ("decade", "nl"): "%d-%n",
    ("decade_bc", "en"): "%ds BC", ("decade_bc", "de"): "%der v. Chr.", ("decade_bc", "fr"): "Années -%d",
    ("century", "en"): "%o century", ("century", "de"): "%d. Jahrhundert", ("century", "nl"): "%de eeuw", ("century", "fr"): "%F siècle", ("century", "es"): "Siglo %R", ("century", "it"): "%R secolo", ("century", "pl"): "%R wiek",
    ("century_bc", "en"): "%o century BC", ("century_bc", "de"): "%d. Jahrhundert v. Chr.", ("century_bc", "nl"): "%de eeuw v.Chr.", ("century_bc", "es"): "Siglo %R a. C.",
    ("millennium", "en"): "%o millennium", ("millennium", "de"): "%d. Jahrtausend", ("millennium", "es"): "%R milenio",
    ("millennium_bc", "en"): "%o millennium BC", ("millennium_bc", "de"): "%d. Jahrtausend v. Chr.", ("millennium_bc", "es"): "%R milenio a. C.",
    ("number", "en"): "%d (number)", ("number", "fr"): "%d (nombre)", ("number", "nl"): "%d (getal)", ("number", "ja"): "%d",
}
#: first and last number of each family, and the step between them
RANGES = {"year": (1, 2500, 1), "year_bc": (1, 500, 1), "decade": (0, 2200, 10), "decade_bc": (0, 500, 10), "century": (1, 30, 1), "century_bc": (1, 30, 1), "millennium": (1, 6, 1), "millennium_bc": (1, 20, 1), "number": (0, 1000, 1)}
# Month names.
MONTHS = {
    "en": "January February March April May June July August September October November December", "nl": "januari februari maart april mei juni juli augustus september oktober november december",
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember", "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre", "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "pt": "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro", "sv": "januari februari mars april maj juni juli augusti september oktober november december",
    "da": "januar februar marts april maj juni juli august september oktober november december", "pl": "styczeń luty marzec kwiecień maj czerwiec lipiec sierpień wrzesień październik listopad grudzień",
}
# Days of a month by language; %d day, %B month.
DAY_PATTERNS = {"en": "%B %d", "nl": "%d %B", "de": "%d. %B", "fr": "%d %B", "es": "%d de %B", "it": "%d %B", "pt": "%d de %B", "sv": "%d %B", "da": "%d. %B"}
MONTH_YEAR_PATTERNS = {"en": "%B %d", "nl": "%B %d", "de": "%B %d", "fr": "%B %d", "es": "%B de %d", "it": "%B %d", "pt": "%B de %d", "sv": "%B %d"}
_PERSIAN = "۰۱۲۳۴۵۶۷۸۹"
_DIGITS = "0123456789"


def roman_text(n: Column) -> Column:
    """1 to 30; null beyond."""
    return F.when((n >= 1) & (n <= 30), F.element_at(F.array(*map(F.lit, _ROMANS)), n.cast("int")))


def roman_number(text: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, _ROMANS)), text)
    return F.when(at > 0, at.cast("int"))


def persian_digits(text: Column) -> Column:
    return F.translate(text, _DIGITS, _PERSIAN)


def latin_digits(text: Column) -> Column:
    return F.translate(text, _PERSIAN, _DIGITS)


def _shown(n: Column, mark: str) -> Column:
    if mark == "%R":
        return roman_text(n)
    if mark == "%F":
        return F.concat(roman_text(n), F.when(n == 1, "er").otherwise("e"))
    if mark == "%o":
        return english_ordinal(n)
    if mark == "%n":  # the decade's last year
        return (n + 9).cast("string")
    return persian_digits(n.cast("string")) if mark == "%P" else n.cast("string")


def _pieces(pattern: str) -> list[str]:
    import re

    return [p for p in re.split(r"(%[dRoFPn])", pattern) if p]


def encode(kind: str, lang: str, n: Column) -> Column:
    """The title of a number of this family; null outside the family's range."""
    lo, hi, step = RANGES[kind]
    text = F.concat(*[_shown(n, p) if p[0] == "%" else F.lit(p) for p in _pieces(PATTERNS[kind, lang])])
    return F.when((n >= lo) & (n <= hi) & (n % step == 0), text)


def decode(kind: str, lang: str, text: Column) -> Column:
    """The number that a title names; null where it names none of this family."""
    import re

    forms = {"%d": r"(\d+)", "%n": r"\d+", "%R": "([IVX]+)", "%F": "([IVX]+)(?:er|e)", "%o": r"(\d+)(?:st|nd|rd|th)", "%P": f"([{_PERSIAN}]+)"}
    pattern = "^" + "".join(forms[p] if p[0] == "%" else re.escape(p) for p in _pieces(PATTERNS[kind, lang])) + "$"
    found = F.regexp_extract(text, pattern, 1)
    marks = PATTERNS[kind, lang]
    n = roman_number(found) if "%R" in marks or "%F" in marks else F.nullif(latin_digits(found), F.lit("")).try_cast("int")
    return F.when(encode(kind, lang, n) == text, n)


def recognised(text: Column, lang: str | None = None) -> Column:
    """struct<kind, lang, n> of the first family that a title belongs to."""
    return F.coalesce(*[F.when(decode(k, l, text).isNotNull(), F.struct(F.lit(k).alias("kind"), F.lit(l).alias("lang"), decode(k, l, text).alias("n"))) for k, l in PATTERNS if lang in (None, l)])


def _month(lang: str, m: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, MONTHS[lang].split())), m.cast("int"))


def month_number(lang: str, text: Column) -> Column:
    """1 to 12 of a month's name, whatever the case; null for others."""
    at = F.array_position(F.array(*[F.lit(w.lower()) for w in MONTHS[lang].split()]), F.lower(text))
    return F.when(at > 0, at.cast("int"))


def _filled(pattern: str, month: Column, number: Column) -> Column:
    import re

    return F.concat(*[month if p == "%B" else number if p == "%d" else F.lit(p) for p in re.split(r"(%[Bd])", pattern) if p])


def day_of_month(lang: str, month: Column, day: Column) -> Column:
    """The title of a day; null for no day of the month (February has 29)."""
    days = F.try_element_at(F.array(*map(F.lit, [31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])), month.cast("int"))
    shown = F.when((day == 1) & F.lit(lang == "fr"), "1er").otherwise(day.cast("string"))
    return F.when((day >= 1) & (day <= days), _filled(DAY_PATTERNS[lang], _month(lang, month), shown))


def month_of_year(lang: str, month: Column, year: Column) -> Column:
    return F.when((year >= 1) & (year <= 2050), _filled(MONTH_YEAR_PATTERNS[lang], _month(lang, month), year.cast("string")))


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)
