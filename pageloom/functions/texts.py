"""Small functions over texts, lists, maps and times, as expressions of the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# ---- parameters -------------------------------------------------------------------------------


def list_to_param(items: Column) -> Column:
    """a|b|c; null where an item itself holds the mark."""
    return F.when(~F.exists(items, lambda x: F.contains(x, F.lit("|"))), F.array_join(items, "|"))


def combined_params(a: Column, b: Column) -> Column:
    """Two maps in one; where both have a key the values are joined as v1|v2."""
    return F.map_zip_with(a, b, lambda k, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(F.concat(x, F.lit("|"), y)))


def as_list(value: Column) -> Column:
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array(value))


def settings_of(text: Column) -> Column:
    """The |key=value lines of a text as a map; the last value of a key counts."""
    keys, values = F.regexp_extract_all(text, F.lit(r"(?m)^\|[ \t]*(\w+)[ \t]*=[ \t]*(.*?)[ \t]*$"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"(?m)^\|[ \t]*(\w+)[ \t]*=[ \t]*(.*?)[ \t]*$"), F.lit(2))
    last = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v"), F.sequence(F.lit(1), F.greatest(F.size(keys), F.lit(1))).alias("i")), lambda e: e["k"].isNotNull() & (F.array_position(F.slice(F.concat(keys, F.array(F.lit("\0"))), e["i"] + 1, F.size(keys) + 1), e["k"]) == 0))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"])))


def before_bar(text: Column) -> Column:
    return F.trim(F.substring_index(text, "|", 1))


def without_scheme(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), F.substring_index(url, "://", -1)).otherwise(url)


def permalink(base: str, title: Column, rev: Column) -> Column:
    from pageloom.functions.titles import url_name

    return F.concat(F.lit(base + "?title="), url_name(title), F.lit("&oldid="), rev.cast("string"))


def url_title(name: Column) -> Column:
    """The title that a URL names: percent signs decoded, underscores as spaces; null where it can't be decoded.
    A plus sign stays one."""
    return F.regexp_replace(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), "_", " ")


# ---- cutting ----------------------------------------------------------------------------------


def split_every(text: Column, sep: str, n: int) -> Column:
    """The text cut at every n-th separator."""
    parts = F.split(text, "\\Q" + sep + "\\E")
    starts = F.sequence(F.lit(1), F.size(parts), F.lit(n))
    return F.transform(starts, lambda i: F.array_join(F.slice(parts, i, F.lit(n)), sep))


def place_of(text: Column, sep: str, n: int) -> Column:
    """Place (from 1) of the n-th separator; 0 where there are fewer."""
    return F.when(F.size(F.split(text, "\\Q" + sep + "\\E")) > n, F.length(F.substring_index(text, sep, n)) + 1).otherwise(0)


# ---- times ------------------------------------------------------------------------------------


def rough_minutes(a: Column, b: Column) -> Column:
    """Minutes between two times, with months of 30 days and years of 12 months."""

    def total(t: Column) -> Column:
        days = (F.year(t) * 12 + F.month(t)) * 30 + F.dayofmonth(t)
        return (days * 24 + F.hour(t)) * 60 + F.minute(t)

    return (total(b) - total(a)).cast("bigint")


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def from_iso(text: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, "T", " "), "Z$", ""), F.lit("yyyy-MM-dd HH:mm:ss"))


# ---- words ------------------------------------------------------------------------------------


def words(text: Column) -> Column:
    """Words in lower case, without digits and signs."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def unknown_words(docs: DataFrame, dictionary: DataFrame, text: str = "text", word: str = "word") -> DataFrame:
    """(word, n) of the words that no dictionary has; counted before the join."""
    n = docs.select(F.explode(words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return n.join(dictionary.select(F.lower(word).alias("word")).distinct(), "word", "left_anti")


def as_written(found: Column, like: Column) -> Column:
    """A word with the case of another: first letter or all letters capital."""
    first = F.concat(F.upper(F.substring(found, 1, 1)), F.substring(found, 2, 1 << 30))
    return F.when((like == F.upper(like)) & (F.length(like) > 1), F.upper(found)).when(F.substring(like, 1, 1) == F.upper(F.substring(like, 1, 1)), first).otherwise(found)


# ---- lines ------------------------------------------------------------------------------------


def filled_down(lines: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """Each line with the last value before it (or its own) within its page."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(out, F.last(value, ignorenulls=True).over(w))


# ---- lists of rules ---------------------------------------------------------------------------


def holds_any(value: Column, parts: list[str]) -> Column:
    """Whether a text holds any of some parts; the parts go into the plan."""
    return F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(value, p)) if parts else F.lit(False)


def worth_searching(title: Column) -> Column:
    """Not lists with commas, and not mostly numbers."""
    digits = F.length(F.regexp_replace(title, "[^0-9]", ""))
    return (F.size(F.split(title, ",")) < 3) & (digits * 2 < F.length(title))


def listed_users(text: Column) -> Column:
    """array<struct<user, page>> of a whitelist page: '* [[User:A]]' lines with [[pages]] behind or in '**' lines below."""
    lines = F.split(text, "\n")
    user = lambda l: F.regexp_extract(l, r"^\*\s*\[\[\s*(?:[Uu]ser\s*:|Special:Contributions/)\s*([^\[\]|]+)", 1)
    state = F.aggregate(
        lines,
        F.struct(F.lit("").alias("user"), F.array().cast("array<struct<user:string,page:string>>").alias("rows")),
        lambda acc, l: F.struct(
            F.when(user(l) != "", F.trim(user(l))).otherwise(acc["user"]).alias("user"),
            F.concat(acc["rows"], F.transform(F.filter(F.regexp_extract_all(l, F.lit(r"\[\[([^\[\]|]+)"), F.lit(1)), lambda p: ~p.rlike("(?i)^\\s*(?:user\\s*:|special:contributions/)") & (F.when(user(l) != "", F.trim(user(l))).otherwise(acc["user"]) != "")),
                                              lambda p: F.struct(F.when(user(l) != "", F.trim(user(l))).otherwise(acc["user"]).alias("user"), F.trim(p).alias("page")))).alias("rows"),
        ),
    )
    return state["rows"]


def free_marker(text: Column, base: str = "@", most: int = 8) -> Column:
    """The shortest run of a sign that a text doesn't hold; null where it holds runs of ``most``."""
    return F.coalesce(*[F.when(~F.contains(text, F.lit(base * n)), F.lit(base * n)) for n in range(1, most + 1)])
