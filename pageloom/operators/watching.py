"""Watching edits: whitelists, rule tables, unwanted words, and states replayed from logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pageloom.operators.history import previous_value


def whitelisted(edits: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Edits whose user may edit pages with this prefix: whitelist (user_name, prefix); an empty prefix
    allows all. Joined by user, then compared."""
    w = whitelist.select(F.col("user_name").alias("__u"), F.col("prefix").alias("__p")).distinct()
    return edits.join(w, (F.col("user_name") == F.col("__u")) & F.col("title").startswith(F.col("__p")), "left_semi")


def first_rule(text: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Name of the first rule that holds: (name, 'equals' | 'contains' | 'matches', value); null for none."""
    tests = {"equals": lambda v: F.trim(text) == v, "contains": lambda v: F.contains(F.lower(text), F.lit(v.lower())), "matches": lambda v: text.rlike(v)}
    return F.coalesce(*[F.when(tests[how](value), F.lit(name)) for name, how, value in rules]) if rules else F.lit(None).cast("string")


def unwanted_words(text: Column, words: Sequence[str]) -> Column:
    """The unwanted words that stand in a text between spaces, in the order of the list."""
    padded = F.concat(F.lit(" "), F.lower(F.regexp_replace(text, r"\s+", " ")), F.lit(" "))
    return F.filter(F.array(*[F.when(F.contains(padded, F.lit(f" {w.lower()} ")), F.lit(w)) for w in words]), lambda x: x.isNotNull())


def mixed_script_words(text: Column) -> Column:
    """Words that mix Latin and Cyrillic letters."""
    letters = r"[A-Za-z\u0400-\u04FF]*"
    return F.regexp_extract_all(text, F.lit(rf"{letters}(?:[A-Za-z][\u0400-\u04FF]|[\u0400-\u04FF][A-Za-z]){letters}"), F.lit(0))


def state_as_of(log: DataFrame, key: str, ts: str, at: Column, *tie: str) -> DataFrame:
    """The last entry of each key not after ``at``: a state replayed from its deltas."""
    rest = [c for c in log.columns if c not in (key, ts, *tie)]
    return log.filter(F.col(ts) <= at).groupBy(key).agg(F.max(F.struct(ts, *tie, *rest)).alias("s")).select(key, "s.*")


def news(now: DataFrame, before: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status) of two states: new, changed, unchanged or closed."""
    n, b = now.select(key, F.col(value).alias("__n"), F.lit(True).alias("__now")), before.select(key, F.col(value).alias("__b"), F.lit(True).alias("__was"))
    status = F.when(F.col("__was").isNull(), "new").when(F.col("__now").isNull(), "closed").when(F.col("__n").eqNullSafe(F.col("__b")), "unchanged").otherwise("changed")
    return n.join(b, key, "full_outer").select(key, status.alias("status"))


def sessions(edits: DataFrame, user: str, ts: str, gap_seconds: int) -> DataFrame:
    """(user, begin, end, edits) of runs of edits with less than the gap between them. Sessions are
    numbered inside (user, month) and then by the numbers of the months before, so that a user who
    made a third of all edits is no single task. Rows with a null user or time belong to none."""
    e = edits.filter(F.col(ts).isNotNull() & F.col(user).isNotNull()).select(F.col(user).alias("u"), F.col(ts).alias("t"), F.col(ts).alias("v"))
    rows = previous_value(e, "u", "t", "v", "v", "before")
    new = F.when(F.col("before").isNull() | (F.unix_micros("t") - F.unix_micros("before") >= gap_seconds * 1_000_000), 1).otherwise(0)
    rows = rows.select("u", "t", new.alias("new"), F.date_trunc("month", "t").alias("piece"))
    rows = rows.withColumn("k", F.sum("new").over(Window.partitionBy("u", "piece").orderBy("t", F.desc("new")).rowsBetween(Window.unboundedPreceding, 0)))
    parts = rows.groupBy("u", "piece", "k").agg(F.min("t").alias("begin"), F.max("t").alias("end"), F.count("*").alias("edits"))
    before = rows.groupBy("u", "piece").agg(F.sum("new").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("u").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.join(before.select("u", "piece", F.coalesce(earlier, F.lit(0)).alias("earlier")), ["u", "piece"])
    g = parts.groupBy("u", (F.col("earlier") + F.col("k")).alias("session")).agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.sum("edits").alias("edits"))
    return g.select(F.col("u").alias(user), "begin", "end", "edits")


def on_day_before(df: DataFrame, ts: str, day: str) -> DataFrame:
    """Rows of the calendar day before ``day``; a range, so that it reaches the scan."""
    end = F.lit(day).cast("date")
    return df.filter((F.col(ts) >= F.date_sub(end, 1).cast("timestamp")) & (F.col(ts) < end.cast("timestamp")))


def compressed(log: DataFrame, key: str, order: list[str], *columns: str) -> DataFrame:
    """Of a log of states the last of each key, and how many entries it had."""
    g = log.groupBy(key).agg(F.max(F.struct(*order, *columns)).alias("m"), F.count("*").alias("entries"))
    return g.select(key, *[f"m.{c}" for c in (*order, *columns)], "entries")


def shelves(log: DataFrame, key: str, ts: str, seen: Column, changed: Column) -> DataFrame:
    """(key, shelf): 'news' where something changed after it was last seen (or it never was), else 'hist'."""
    g = log.groupBy(key).agg(F.max(F.when(seen, F.col(ts))).alias("__seen"), F.max(F.when(changed, F.col(ts))).alias("__changed"))
    news = F.col("__changed").isNotNull() & (F.col("__seen").isNull() | (F.col("__changed") > F.col("__seen")))
    return g.select(key, F.when(news, "news").otherwise("hist").alias("shelf"))
