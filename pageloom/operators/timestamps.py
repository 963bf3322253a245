"""Problem 3: mixed timestamp formats and time zones.

Each text is reduced to the mask of its character classes; each distinct mask (with the kinds of
its words) gets a parser once; all texts of a mask are then converted by array arithmetic, wall
clock times through zone transition tables.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pageloom.functions.zones import ZoneTable, zone_tables

#: Zone tables are sent to every executor; more zones than the database has can't come.
MAX_ZONES = 2000
#: No form has more numbers and words than this.
MOST_PARTS = 16

# Month names, weekdays and words of the five languages, as they are written.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "nl": "januari februari maart april mei juni juli augustus september oktober november december",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
}
SHORT_MONTHS = {
    "en": "jan feb mar apr may jun jul aug sep oct nov dec",
    "nl": "jan feb mrt apr mei jun jul aug sep okt nov dec",
    "de": "jan feb mär apr mai jun jul aug sep okt nov dez",
    "fr": "janv févr mars avr mai juin juil août sept oct nov déc",
    "es": "ene feb mar abr may jun jul ago sept oct nov dic",
}
WEEKDAYS = {
    "en": "monday tuesday wednesday thursday friday saturday sunday",
    "en short": "mon tue wed thu fri sat sun",
    "nl": "maandag dinsdag woensdag donderdag vrijdag zaterdag zondag",
    "nl short": "ma di wo do vr za zo",
    "de": "montag dienstag mittwoch donnerstag freitag samstag sonntag",
    "fr": "lundi mardi mercredi jeudi vendredi samedi dimanche",
    "es": "lunes martes miércoles jueves viernes sábado domingo",
}
CLOCK_WORDS = "uur uhr h heures hrs".split()
UTC_NAMES = "UTC GMT UT".split()

_MONTH = {w: i + 1 for names in (*MONTHS.values(), *SHORT_MONTHS.values()) for i, w in enumerate(names.split())} | {"maa": 3, "sept": 9}
_WEEKDAY = {w for names in WEEKDAYS.values() for w in names.split()}

# Shapes, in the language of masks: 9 a digit; M month, W weekday, V the W of a week's number, P am/pm, T and Z themselves, X a
# zone's name, U a word after the clock time, A any other word.
_TIME = r"(?P<H>9{1,2})(?P<c>[:.])(?P<I>99)(?:(?P=c)(?P<S>99)(?:[.,](?P<f>9+))?)?(?: ?(?P<P>P))?(?: ?U)?"
_ZONE = r"(?: ?Z| ?\(?(?P<X>X)\)?| ?(?P<sign>[+-])(?:(?P<z4>9{4})|(?P<zh>99)(?::(?P<zm>99))?))?"
_DATES = [
    r"(?P<y>9{4})(?P<s>[-/:.])(?P<m>9{1,2})(?P=s)(?P<d>9{1,2})",
    r"(?P<d>9{1,2})(?P<s>[-/.])(?P<m>9{1,2})(?P=s)(?P<y>9{4})",
    r"(?:W,? )?(?P<d>9{1,2})\.?[ -](?P<M>M)\.?[ -](?P<y>9{4})",
    r"(?:W,? )?(?P<M>M)\.? (?P<d>9{1,2}),? (?P<y>9{4})",
    r"(?P<ymd>9{8})",
    r"(?P<y>9{4})-(?P<ordinal>999)",
    r"(?P<y>9{4})-?V(?P<week>99)-?(?P<wd>9)",
]
_INSTANTS = [re.compile(p) for d in _DATES for p in (rf"{d}(?:[ ]?T[ ]?|,? ){_TIME}{_ZONE}", rf"{_TIME},? {d}{_ZONE}")] + [
    re.compile(p) for p in (r"(?P<all>9{14})(?P<bare>)", r"(?P<all>9{14})(?: ?Z| ?(?P<sign>[+-])(?:(?P<z4>9{4})|(?P<zh>99)(?::(?P<zm>99))?))", r"(?P<ymd>9{8})T(?P<hms>9{6})(?:[.,](?P<f>9+))?" + _ZONE, r"(?P<ymd>9{8})T(?P<hm>9{4})" + _ZONE, r"(?P<epoch>9{9,10})", r"(?P<epoch_ms>9{13})", r"(?P<epoch_us>9{16})")
]
_DAYS = [re.compile(rf"(?P<open>\[)?{d}(?:(?:[ ]?T[ ]?|,? ){_TIME}{_ZONE})?(?(open)\])") for d in _DATES]


def word_kind(w: str) -> str:
    low = w.lower()
    if low in _MONTH:
        return "M"
    if low in _WEEKDAY:
        return "W"
    if low in ("am", "pm"):
        return "P"
    if low in ("t", "z"):
        return low.upper()
    if w == "W":
        return "V"
    if low in CLOCK_WORDS:
        return "U"
    return "X" if w.isascii() and w.isupper() and 2 <= len(w) <= 5 else "A"


@lru_cache(maxsize=4096)
def _mask_pattern(mask: str) -> tuple[str, list[str]]:
    """RE2 that takes the digit runs and words out of any text of the mask, and the kind of each."""
    tokens = re.findall(r"9+|A|[^9A]+", mask)
    kinds = [t for t in tokens if t[0] in "9A"]
    i, out = 0, []
    for t in tokens:
        if t[0] in "9A":
            out.append(rf"(?P<g{i}>{'[0-9]+' if t[0] == '9' else chr(92) + 'pL+'})")
            i += 1
        else:
            out.append(re.escape(t))
    return "^" + "".join(out) + "$", kinds


@lru_cache(maxsize=4096)
def _parser(shape: str, days: bool) -> dict[str, int | str] | None:
    """Which run of the shape holds which part; None where the shape names no instant (no day)."""
    starts = [m.start() for m in re.finditer(r"9+|[A-Z]", shape)]
    for p in _DAYS if days else _INSTANTS:
        if m := p.fullmatch(shape):
            got: dict[str, int | str] = {k: starts.index(m.start(k)) for k, v in m.groupdict().items() if v and k not in ("s", "c", "sign", "open", "bare")}
            if m.groupdict().get("sign"):
                got["sign"] = m["sign"]
            got["utc"] = int("Z" in shape or "all" in got)
            return got
    return None


def _days(y, m, d):
    """Days since 1970-01-01 of the proleptic calendar, and whether the day exists."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    length = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(m, 0, 12)] + ((m == 2) & leap)
    ok = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= length)
    y2, m2 = np.where(ok, y, 1970), np.where(ok, m, 1)
    months = (y2 - 1970) * 12 + m2 - 1
    return np.datetime64(0, "M").astype("datetime64[M]").astype(np.int64) + (months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)) + np.where(ok, d, 1) - 1, ok


#: What became of a text: an instant, one of two (the earlier), in the gap of a clock change or no real time, without a known zone, or in a form that is not understood.
STATUS = ["unknown form", "parsed", "ambiguous", "does not exist", "no zone"]


def convert(values: pa.Array, zones: pa.Array | None, tables: dict[str, ZoneTable], days: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Seconds since 1970 (``days``: days since 1970), and whether the text denotes an instant (a day)."""
    seconds, _, status = convert_fully(values, zones, tables, days)
    return seconds, (status == 1) | (status == 2)


def convert_fully(values: pa.Array, zones: pa.Array | None, tables: dict[str, ZoneTable], days: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seconds (days) since 1970, the microseconds of the second, and the place in STATUS."""
    n = len(values)
    out, micros, status = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int8)
    plain = pc.fill_null(pc.string_is_ascii(values), True)
    if not pc.all(plain).as_py():  # full-width digits, accents in two characters
        values = pc.if_else(plain, values, pa.array([None if p or x is None else unicodedata.normalize("NFKC", x) for x, p in zip(values.to_pylist(), plain.to_pylist())], pa.string()))
    text = pc.utf8_trim_whitespace(values)
    mask = pc.replace_substring_regex(pc.replace_substring_regex(text, r"\pL+", "A"), "[0-9]", "9")
    # letters that are masked first can't hide digits; a text with its own 'A' or '9' only masks to itself
    masks = mask.dictionary_encode()
    codes = pc.fill_null(masks.indices, -1).to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    bounds = np.searchsorted(codes[order], np.arange(len(masks.dictionary) + 1))
    for k, name in enumerate(masks.dictionary.to_pylist()):
        if "9" not in name or len(re.findall("9+|A", name)) > MOST_PARTS:
            continue
        at = order[bounds[k] : bounds[k + 1]]
        pattern, kinds = _mask_pattern(name)
        parts = pc.extract_regex(text.take(pa.array(at)), pattern).flatten()
        words = {i: parts[i].dictionary_encode() for i, kind in enumerate(kinds) if kind == "A"}
        shape_of = np.full(len(at), name, dtype=object)
        if words:
            kind_of = {i: np.array([word_kind(w) for w in d.dictionary.to_pylist()])[d.indices.to_numpy()] for i, d in words.items()}
            rows = np.stack(list(kind_of.values()), 1)
            uniq, inv = np.unique(rows, axis=0, return_inverse=True)
            pieces = re.split("A", name)
            shapes = ["".join(p + w for p, w in zip(pieces, [*u, ""])) for u in uniq]
            shape_of = np.array(shapes, dtype=object)[inv.ravel()]
        for shape in set(shape_of.tolist()):
            parser = _parser(shape, days)
            if parser is None:
                continue
            sub = np.flatnonzero(shape_of == shape)
            v, ok = _apply(parser, parts, words, pa.array(sub), zones.take(pa.array(at[sub])) if zones is not None else None, tables, days)
            out[at[sub]], status[at[sub]] = v, ok
            if not days:
                micros[at[sub]] = _micros(parser, parts, pa.array(sub))
    return out, micros, status


def _micros(parser, parts, sub) -> np.ndarray:
    for key, unit, factor in (("epoch_ms", 1000, 1000), ("epoch_us", 1_000_000, 1)):
        if key in parser:
            return pc.cast(parts[parser[key]].take(sub), pa.int64()).to_numpy() % unit * factor
    if "f" not in parser:
        return np.zeros(len(sub), np.int64)
    digits = pc.utf8_slice_codeunits(pc.utf8_rpad(parts[parser["f"]].take(sub), 6, "0"), 0, 6)
    return pc.cast(digits, pa.int64()).to_numpy()


def _apply(parser, parts, words, sub, zones, tables, days):
    """Seconds (days) and the place in STATUS of each text of a shape."""

    def number(key, default=0):
        if key not in parser:
            return np.full(len(sub), default, np.int64)
        return pc.cast(parts[parser[key]].take(sub), pa.int64()).to_numpy()

    def word(key, f):
        d = words[parser[key]]
        return np.array([f(w) for w in d.dictionary.to_pylist()])[d.indices.take(sub).to_numpy()]

    for key, unit in (("epoch", 1), ("epoch_ms", 1000), ("epoch_us", 1_000_000)):
        if key in parser:
            return number(key) // unit, np.ones(len(sub), np.int8)
    if "all" in parser or "ymd" in parser:
        ymd = number("all") // 1_000_000 if "all" in parser else number("ymd")
        y, m, d = ymd // 10000, ymd // 100 % 100, ymd % 100
    elif "ordinal" in parser:
        y, m, d = number("y"), np.ones(len(sub), np.int64), np.ones(len(sub), np.int64)
    elif "week" in parser:  # the 4th of January is in the first week
        y, m, d = number("y"), np.ones(len(sub), np.int64), np.full(len(sub), 4, np.int64)
    else:
        y, d = number("y"), number("d")
        m = word("M", lambda w: _MONTH.get(w.lower(), 0)) if "M" in parser else number("m")
    day, ok = _days(y, m, d)
    if "ordinal" in parser:
        ok &= (number("ordinal") >= 1) & (number("ordinal") <= _days(y + 1, m, d)[0] - day)
        day = day + number("ordinal") - 1
    elif "week" in parser:
        monday = day - (day + 3) % 7
        later = _days(y + 1, m, d)[0]
        ok &= (number("wd") >= 1) & (number("wd") <= 7) & (number("week") >= 1) & (number("week") <= (later - (later + 3) % 7 - monday) // 7)
        day = monday + (number("week") - 1) * 7 + number("wd") - 1
    exists = lambda x: np.where(x, 1, 3).astype(np.int8)
    if days:
        return day, exists(ok)
    if "all" in parser or "hms" in parser:
        hms = number("all") % 1_000_000 if "all" in parser else number("hms")
        hour, minute, second = hms // 10000, hms // 100 % 100, hms % 100
    elif "hm" in parser:
        hour, minute, second = number("hm") // 100, number("hm") % 100, number("S")
    else:
        hour, minute, second = number("H"), number("I"), number("S")
    if "P" in parser:
        ok &= (hour >= 1) & (hour <= 12)
        hour = hour % 12 + 12 * word("P", lambda w: int(w.lower() == "pm"))
    ok &= (hour <= 23) & (minute <= 59) & (second <= 59)
    wall = day * 86400 + hour * 3600 + minute * 60 + second
    if "sign" in parser:
        zh, zm = (number("z4") // 100, number("z4") % 100) if "z4" in parser else (number("zh"), number("zm"))
        ok &= (zh <= 15) & (zm <= 59)
        return wall - (zh * 3600 + zm * 60) * (-1 if parser["sign"] == "-" else 1), exists(ok)
    if parser["utc"]:
        return wall, exists(ok)
    site = zones.dictionary_encode() if zones is not None else pa.nulls(len(sub), pa.string()).dictionary_encode()
    code = pc.fill_null(site.indices, -1).to_numpy(zero_copy_only=False)
    utc, known = np.zeros(len(sub), np.int64), np.zeros(len(sub), bool)
    if "X" in parser:
        names = word("X", str.upper)
        for k, zone in [*enumerate(site.dictionary.to_pylist()), (-1, None)]:
            for name in set(names[code == k].tolist()):
                offset = _named_offset(name, zone, tables)
                if offset is not None:
                    here = (code == k) & (names == name)
                    utc[here], known[here] = wall[here] - offset, True
        return utc, np.where(known, exists(ok), 4).astype(np.int8)
    state = np.full(len(sub), 4, np.int8)
    for k, zone in enumerate(site.dictionary.to_pylist()):
        if zone in tables:
            here = code == k
            utc[here], there, twice = tables[zone].to_utc(wall[here])
            state[here] = np.where(there, np.where(twice, 2, 1), 3)
    return utc, np.where(ok | (state == 4), state, 3).astype(np.int8)


def _named_offset(name: str, zone: str | None, tables: dict[str, ZoneTable]) -> int | None:
    """The site's own meaning of the abbreviation; else UTC's names; else what all other zones that know it agree on."""
    if zone in tables and name in tables[zone].names and name not in ("UTC", "UT"):
        return tables[zone].names[name]
    if name in UTC_NAMES:
        return 0
    others = {t.names[name] for t in tables.values() if name in t.names}
    return others.pop() if len(others) == 1 else None


def instant_udf(zones) -> object:
    """A vectorised function (text, IANA zone of its wall clock) -> the instant as YYYY-MM-DDThh:mm:ssZ.

    Null for null and empty text, unknown forms, dates without a time, times that don't exist (also
    in the gap of a clock change), and wall-clock times whose zone is null or unknown. Of two
    instants the earlier is given; fractions are dropped; missing seconds are 00."""
    tables = zone_tables(zones)
    if len(tables) > MAX_ZONES:
        raise ValueError(f"{len(tables)} zones")

    @F.arrow_udf(T.StringType())
    def instant(values: pa.Array, tz: pa.Array) -> pa.Array:
        v, ok = convert(values, tz, tables)
        text = np.datetime_as_string(v.astype("datetime64[s]"), unit="s").astype(object) + "Z"
        return pa.array(text, pa.string(), mask=~ok | (np.char.str_len(text.astype(str)) != 20))

    return instant


PARSED = "at timestamp, status string"


def instant_and_status_udf(zones) -> object:
    """As ``instant_udf``, but gives struct<at, status>: the instant with its fraction to the
    microsecond, and what became of the text (see STATUS; null for null)."""
    tables = zone_tables(zones)
    if len(tables) > MAX_ZONES:
        raise ValueError(f"{len(tables)} zones")

    @F.arrow_udf(PARSED)
    def parsed(values: pa.Array, tz: pa.Array) -> pa.Array:
        seconds, micros, status = convert_fully(values, tz, tables)
        ok = ((status == 1) | (status == 2)) & (np.abs(seconds) < 1 << 43)
        at = pa.array(np.where(ok, seconds * 1_000_000 + micros, 0), pa.int64(), mask=~ok).cast(pa.timestamp("us", "UTC"))
        said = pc.if_else(pc.is_valid(values), pa.array(STATUS, pa.string()).take(pa.array(status)), pa.scalar(None, pa.string()))
        return pa.StructArray.from_arrays([at, said], names=["at", "status"])

    return parsed


def form(value: Column) -> Column:
    """The mask of a text: letters' runs as A, digits as 9. Counting the masks of what was not
    understood shows what a new parser would have to read."""
    return F.regexp_replace(F.regexp_replace(F.trim(value), r"\pL+", "A"), "[0-9]", "9")


@F.arrow_udf(T.StringType())
def day_text(values: pa.Array) -> pa.Array:
    """The one day that a text names, as YYYY-MM-DD; any time of day is ignored, numbers before a
    last year go day, month. Null for everything else (ranges, months, years, no text)."""
    v, ok = convert(values, None, {}, days=True)
    text = np.datetime_as_string(v.astype("datetime64[D]"), unit="D").astype(object)
    return pa.array(text, pa.string(), mask=~ok)


def _with_zone(df: DataFrame, site: Column, sites: DataFrame) -> DataFrame:
    s = sites.filter("site IS NOT NULL").groupBy("site").agg(F.min("tz").alias("__tz")).withColumnRenamed("site", "__site")
    return df.join(s, site == F.col("__site"), "left").drop("__site")


def parsed_instants(df: DataFrame, value: Column, site: Column, sites: DataFrame, out: str = "parsed") -> DataFrame:
    """df with struct<at, status> of ``value`` in column ``out``; see ``instant_and_status_udf``."""
    zones = [r.tz for r in sites.select("tz").distinct().limit(MAX_ZONES + 1).collect()]
    return _with_zone(df, site, sites).withColumn(out, instant_and_status_udf(zones)(value, F.col("__tz"))).drop("__tz")


def normalised_instants(df: DataFrame, value: Column, site: Column, sites: DataFrame, out: str = "norm", only_other_forms: bool = False) -> DataFrame:
    """df with the UTC instant of ``value`` in column ``out``. ``sites`` (site, tz) gives each
    record's wall clock; it is small by nature (its distinct zones are at most MAX_ZONES).
    ``only_other_forms``: rows already written as YYYY-MM-DDThh:mm:ssZ are left out before parsing."""
    zones = [r.tz for r in sites.select("tz").distinct().limit(MAX_ZONES + 1).collect()]
    instant = instant_udf(zones)
    if only_other_forms:
        df = df.filter(value.isNotNull() & ~value.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z\z"))
    return _with_zone(df, site, sites).withColumn(out, instant(value, F.col("__tz"))).drop("__tz")
