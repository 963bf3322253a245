"""Lists of block records: by kind, by address, by time. All values come as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.operators.timestamps import normalised_instants

ISO = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$"
ENDLESS = ("infinity", "infinite", "indefinite", "never")


def instant(c: Column) -> Column:
    """Timestamp of text in the canonical form; null for all other text (``with_instant`` reads that too)."""
    return F.when(c.rlike(ISO), F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssX")))


def with_instant(df: DataFrame, column: str, sites: DataFrame, out: str) -> DataFrame:
    """df with the instant that a text column names, in whatever form, as a timestamp in ``out``; wall
    clock times count in the zone of the record's site. The canonical form is read without Python."""
    plain = instant(F.col(column))
    got = normalised_instants(df, F.when(plain.isNull(), F.col(column)), F.col("site"), sites, "__norm")
    return got.withColumn(out, F.coalesce(plain, instant(F.col("__norm")))).drop("__norm")


def kind(df: DataFrame) -> Column:
    """auto (no user), range, anon, or user."""
    return F.when(F.col("user_name").isNull(), "auto").when(F.col("rangestart").isNotNull() & (F.col("rangestart") != F.col("rangeend")), "range").when(F.col("userid") == "0", "anon").otherwise("user")


def endless(df: DataFrame) -> DataFrame:
    return df.filter(F.lower("expiry").isin(*ENDLESS))


def finite(df: DataFrame, end: Column) -> DataFrame:
    """Blocks that end: the expiry begins with a digit, or names an instant (``end``) in words."""
    return df.filter(F.trim("expiry").rlike(r"^\d") | end.isNotNull())


def expiring(df: DataFrame, end: Column, after: str | None = None, until: str | None = None) -> DataFrame:
    out = df.filter(end.isNotNull())
    if after is not None:
        out = out.filter(end > F.lit(after).cast("timestamp"))
    return out.filter(end <= F.lit(until).cast("timestamp")) if until is not None else out


def durations(df: DataFrame, begin: Column, end: Column) -> DataFrame:
    """Whole days from a block's time to its expiry, where both are instants."""
    return df.withColumn("days", F.floor((F.unix_timestamp(end) - F.unix_timestamp(begin)) / 86400)).filter("days IS NOT NULL")


def between(df: DataFrame, at: Column, start: str, end: str) -> DataFrame:
    return df.filter(at.between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def address_number(ip: Column) -> Column:
    """IPv4 as a number; null for other text."""
    parts = F.transform(F.split(ip, r"\."), lambda o: o.cast("bigint"))
    n = F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, o: s * 256 + o)
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), n)


def covering(ranges: DataFrame, addresses: DataFrame) -> DataFrame:
    """(ip, delivery_no) of range blocks that hold an address. A range meets addresses at the level of
    its own size (the last 8, 16, 24 or all bits are left out of the key), where it lies in at most two
    blocks; so small ranges of one large network are not compared with all its addresses."""
    r = ranges.select("delivery_no", address_number(F.col("rangestart")).alias("lo"), address_number(F.col("rangeend")).alias("hi")).filter("lo <= hi")
    size = F.col("hi") - F.col("lo")
    r = r.withColumn("bits", F.when(size < 1 << 8, 8).when(size < 1 << 16, 16).when(size < 1 << 24, 24).otherwise(32))
    shifted = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("bits"))).cast("bigint")
    r = r.withColumn("block", F.explode(F.sequence(shifted("lo"), shifted("hi"))))
    a = addresses.select("ip", address_number(F.col("ip")).alias("n")).distinct().filter("n IS NOT NULL").withColumn("bits", F.explode(F.array(*[F.lit(b) for b in (8, 16, 24, 32)])))
    return a.withColumn("block", shifted("n")).join(r, ["bits", "block"]).filter("n BETWEEN lo AND hi").select("ip", "delivery_no")
