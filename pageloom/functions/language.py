"""Help for many languages: letters in Latin, plural forms, fallback languages, titles of days and years."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pageloom.operators.timestamps import MONTHS

# Sounds of letters whose Unicode names don't spell them.
_SOUNDS = {
    "IE": "e", "IO": "yo", "ZHE": "zh", "ZE": "z", "KA": "k", "EL": "l", "EM": "m", "EN": "n", "ER": "r", "ES": "s", "TE": "t", "EF": "f", "HA": "kh", "TSE": "ts", "CHE": "ch", "SHA": "sh", "SHCHA": "shch",
    "HARD SIGN": "", "SOFT SIGN": "", "YERU": "y", "E": "e", "YU": "yu", "YA": "ya", "BE": "b", "VE": "v", "GHE": "g", "DE": "d", "PE": "p", "SHORT I": "y", "I": "i", "O": "o", "U": "u", "A": "a",
    "ALPHA": "a", "BETA": "b", "GAMMA": "g", "DELTA": "d", "EPSILON": "e", "ZETA": "z", "ETA": "i", "THETA": "th", "IOTA": "i", "KAPPA": "k", "LAMDA": "l", "MU": "m", "NU": "n", "XI": "x", "OMICRON": "o", "PI": "p",
    "RHO": "r", "SIGMA": "s", "FINAL SIGMA": "s", "TAU": "t", "UPSILON": "y", "PHI": "f", "CHI": "ch", "PSI": "ps", "OMEGA": "o",
}


@lru_cache(maxsize=1 << 15)
def _latin(ch: str) -> str | None:
    base = unicodedata.normalize("NFD", ch)[0]
    if ord(base) < 128:
        return base
    name = unicodedata.name(base, "")
    for script in ("CYRILLIC", "GREEK"):
        for size in ("CAPITAL", "SMALL"):
            if name.startswith(f"{script} {size} LETTER "):
                sound = _SOUNDS.get(name.removeprefix(f"{script} {size} LETTER "))
                return sound.capitalize() if sound and size == "CAPITAL" else sound
    if name.startswith(("KATAKANA LETTER ", "HIRAGANA LETTER ")):
        return name.rpartition(" ")[2].lower()
    return None


def transliterated(text: str, unknown: str = "?") -> str:
    """Text in Latin letters; a capital between capitals is written in capitals."""
    out = []
    for i, ch in enumerate(text):
        s = ch if ord(ch) < 128 else _latin(ch)
        s = unknown if s is None and ch.isalpha() else ch if s is None else s
        if len(s) > 1 and s[0].isupper() and i + 1 < len(text) and text[i + 1].isupper():
            s = s.upper()
        out.append(s)
    return "".join(out)


#: Fallback languages, nearest first.
FALLBACK = {"nds": ["de", "en"], "fy": ["nl", "de", "en"], "li": ["nl", "en"], "oc": ["fr", "ca", "es", "en"], "ca": ["es", "en"], "gl": ["es", "pt", "en"], "als": ["de", "en"], "wa": ["fr", "en"], "be": ["ru", "en"], "uk": ["ru", "en"]}


def translated(messages: dict[str, str], lang: str, **values) -> str | None:
    """A message in this language or the next best; %(name)s is filled in; {{PLURAL:n|one|many}} chosen."""
    import re

    text = next((messages[l] for l in [lang, *FALLBACK.get(lang, []), "en"] if l in messages), None)
    if text is None:
        return None

    def pick(m) -> str:
        forms = m[2].split("|")
        n = int(values[m[1]]) if m[1] in values else int(m[1])
        return forms[min(plural_form(lang, n), len(forms) - 1)]

    return re.sub(r"\{\{PLURAL:(\w+)\|([^{}]*)\}\}", pick, text) % values if values else text


def plural_form(lang: str, n: int) -> int:
    """Which of a language's plural forms a number takes."""
    if lang in ("ja", "zh", "ko", "vi", "th"):
        return 0
    if lang in ("fr", "pt-br"):
        return int(n > 1)
    if lang in ("ru", "uk", "be", "sr", "hr"):
        return 0 if n % 10 == 1 and n % 100 != 11 else 1 if 2 <= n % 10 <= 4 and not 12 <= n % 100 <= 14 else 2
    if lang == "pl":
        return 0 if n == 1 else 1 if 2 <= n % 10 <= 4 and not 12 <= n % 100 <= 14 else 2
    if lang in ("cs", "sk"):
        return 0 if n == 1 else 1 if 2 <= n <= 4 else 2
    return int(n != 1)


DAYS_IN_MONTH = [31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]


def day_title(lang: str, month: int, day: int) -> str | None:
    """'January 31', '31 januari', '31. Januar', '31 de enero', '1er janvier'; null for no day."""
    if not 1 <= month <= 12 or not 1 <= day <= DAYS_IN_MONTH[month - 1]:
        return None
    name = MONTHS[lang].split()[month - 1]
    if lang == "en":
        return f"{name.capitalize()} {day}"
    if lang == "de":
        return f"{day}. {name.capitalize()}"
    if lang == "es":
        return f"{day} de {name}"
    return f"{'1er' if lang == 'fr' and day == 1 else day} {name}"


def day_titles(lang: str) -> list[str]:
    return [day_title(lang, m, d) for m in range(1, 13) for d in range(1, DAYS_IN_MONTH[m - 1] + 1)]


def year_titles(start: int = 1, end: int = 2050, bc: str = "%d BC") -> list[str]:
    """Titles of years; there is no year 0."""
    return [str(y) if y > 0 else bc % -y for y in range(start, end + 1) if y]
