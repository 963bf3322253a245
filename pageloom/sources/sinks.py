"""Writers: tables, category listings, pages as text, wikitables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def category_listing(members: DataFrame, category: str = "category", title: str = "title", part_rows: int = 5000) -> DataFrame:
    """(category, part, text): lists of a category's members as wikitext, in parts of about ``part_rows``
    lines, so that a large category never becomes one value."""
    n = members.groupBy(category).agg(F.count("*").alias("__n"))
    parts = members.join(n, category).withColumn("part", F.pmod(F.xxhash64(title), F.ceil(F.col("__n") / part_rows)).cast("int")).drop("__n")
    lines = F.transform(F.array_sort(F.collect_set(title)), lambda t: F.concat(F.lit("* [[:"), t, F.lit("]]")))
    return parts.groupBy(category, "part").agg(F.array_join(lines, "\n").alias("text"))


def table_row(*cells: Column) -> Column:
    return F.concat(F.lit("|-\n| "), F.concat_ws(" || ", *[c.cast("string") for c in cells]))


def marked_pages(df: DataFrame, title: str = "title", text: str = "text", begin: str = "{{-start-}}", end: str = "{{-stop-}}") -> DataFrame:
    """One text a row as ``pages_in_text`` reads it; write it with .text()."""
    return df.select(F.concat(F.lit(begin + "\n'''"), F.col(title), F.lit("'''\n"), F.col(text), F.lit("\n" + end)).alias("value"))
