"""Readers of page sources: XML dumps, CSV and JSON records, texts of many pages, title lists, warning logs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

_TEXT = T.StringType()
_REVISION = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("timestamp", _TEXT),
    T.StructField("contributor", T.StructType([T.StructField("ip", _TEXT), T.StructField("username", _TEXT), T.StructField("id", T.LongType())])),
    T.StructField("minor", _TEXT), T.StructField("comment", _TEXT),
    T.StructField("text", T.StructType([T.StructField("_VALUE", _TEXT), T.StructField("_space", _TEXT), T.StructField("_xml:space", _TEXT)])),
])
PAGE = T.StructType([
    T.StructField("title", _TEXT), T.StructField("ns", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("restrictions", _TEXT),
    T.StructField("redirect", T.StructType([T.StructField("_title", _TEXT)])), T.StructField("revision", T.ArrayType(_REVISION)),
])


def restrictions(c: Column) -> tuple[Column, Column]:
    """(edit, move) of 'edit=a:move=b'; a bare level counts for both; null for none."""
    def of(action: str) -> Column:
        found = F.regexp_extract(c, rf"(?:^|:){action}=([^:]*)", 1)
        return F.when(c.rlike("="), F.nullif(found, F.lit(""))).otherwise(F.nullif(c, F.lit("")))

    return of("edit"), of("move")


_CORRUPT = "_corrupt_record"


def _raw_pages(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*PAGE.fields, T.StructField(_CORRUPT, _TEXT)])
    return spark.read.format("xml").option("rowTag", "page").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT).option("ignoreNamespace", "true").schema(schema).load(path)


def xml_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(title, record) of the pages of an export that can't be read, with what could be read of the title."""
    # only what is read can be found unreadable, so the (always true) condition on a hash asks for all columns
    everything = F.xxhash64(*[F.col(f.name) for f in PAGE.fields]) >= F.lit(-(1 << 63))
    return _raw_pages(spark, path).filter(F.col(_CORRUPT).isNotNull() & everything).select("title", F.col(_CORRUPT).alias("record"))


def xml_dump(spark: SparkSession, path: str, all_revisions: bool = False) -> DataFrame:
    """Pages of an export (plain, .bz2 or .gz; large dumps are split at <page>), one row for each
    revision, or only the first of each page. Null text is read as empty; the schema is fixed, so
    pages with one revision and with many read alike; ``xml_rejects`` has the pages that can't be read."""
    raw = _raw_pages(spark, path).filter(f"{_CORRUPT} IS NULL")
    revs = F.col("revision") if all_revisions else F.slice("revision", 1, 1)
    edit, move = restrictions(F.col("restrictions"))
    rows = raw.select("title", "ns", F.col("id").alias("page_id"), edit.alias("edit_restriction"), move.alias("move_restriction"), F.col("redirect").isNotNull().alias("has_redirect"), F.posexplode(revs).alias("seq", "r"))
    text = F.coalesce("r.text._VALUE", F.lit(""))
    return rows.select(
        "title", "ns", "page_id", text.alias("text"), F.coalesce("r.contributor.username", "r.contributor.ip").alias("username"), F.col("r.contributor.ip").isNotNull().alias("ipedit"),
        F.try_to_timestamp("r.timestamp").alias("timestamp"), "edit_restriction", "move_restriction", F.col("r.id").alias("revisionid"), F.col("r.comment").alias("comment"),
        (F.col("has_redirect") | text.rlike(r"(?i)^\s*#REDIRECT\s*:?\s*\[\[")).alias("isredirect"), "seq",
    )


def xml_header(spark: SparkSession, path: str) -> DataFrame:
    """sitename, base, generator, case and the namespaces of an export."""
    ns = T.StructType([T.StructField("namespace", T.ArrayType(T.StructType([T.StructField("_key", T.IntegerType()), T.StructField("_VALUE", _TEXT)])))])
    schema = T.StructType([*[T.StructField(n, _TEXT) for n in ("sitename", "base", "generator", "case")], T.StructField("namespaces", ns)])
    raw = spark.read.format("xml").option("rowTag", "siteinfo").option("ignoreNamespace", "true").schema(schema).load(path)
    pairs = F.transform("namespaces.namespace", lambda x: F.struct(x["_key"], F.coalesce(x["_VALUE"], F.lit(""))))
    return raw.select("sitename", "base", "generator", "case", F.map_from_entries(pairs).alias("namespaces"))


def redirects_of(dump: DataFrame) -> DataFrame:
    """(title, target) of the redirects in a dump, by their text; targets in other wikis are left out."""
    target = F.regexp_extract("text", r"(?i)^\s*#REDIRECT\s*:?\s*\[\[\s*:?([^\[\]|#]+)", 1)
    return dump.filter("isredirect").select("title", F.trim(F.regexp_replace(target, "_", " ")).alias("target")).filter("target <> '' AND NOT target RLIKE '^[a-z-]{2,12}:'")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """Records with a header and doubled quotes: url and all other columns as a map."""
    raw = spark.read.option("header", "true").option("quote", '"').option("escape", '"').option("multiLine", "true").csv(path)
    others = [c for c in raw.columns if c != "url"]
    meta = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(c), F.col(f"`{c}`").cast("string")) for c in others]), lambda x: x["col2"].isNotNull()))
    return with_derived(raw.select(F.col("url"), meta.alias("metadata")))


def with_derived(photos: DataFrame) -> DataFrame:
    """metadata with _url, _filename and _ext of the url."""
    extra = F.create_map(F.lit("_url"), F.col("url"), F.lit("_filename"), F.regexp_extract("url", r"([^/]*)$", 1), F.lit("_ext"), F.regexp_extract("url", r"\.([^./]*)$", 1))
    return photos.withColumn("metadata", F.when(F.col("url").isNotNull(), F.map_concat("metadata", extra)).otherwise(F.col("metadata")))


def formatted(pattern: str, metadata: Column) -> Column:
    """'%(name)s - %(set)s.%(_ext)s' with values of a map; missing ones are empty."""
    parts = re.split(r"%\((\w[\w.]*)\)s", pattern)
    return F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(F.try_element_at(metadata, F.lit(p)), F.lit("")) for i, p in enumerate(parts)])


def description(template: str, metadata: Column) -> Column:
    """Call of a template with all values in the order of their names; | in values is {{!}}."""
    lines = F.transform(F.array_sort(F.map_entries(metadata)), lambda e: F.concat(F.lit("|"), e["key"], F.lit("="), F.regexp_replace(e["value"], r"\|", "{{!}}")))
    return F.concat(F.lit("{{" + template + "\n"), F.array_join(lines, "\n"), F.lit("\n}}"))


def json_tree(value, prefix: str = "", out: dict | None = None) -> dict[str, str]:
    """Text leaves of nested JSON under their joined names; a name's second value gets _2, later ones and other leaves are left out."""
    out = {} if out is None else out
    items = value.items() if isinstance(value, dict) else ((None, v) for v in value) if isinstance(value, list) else ()
    for k, v in items:
        name = prefix if k is None else f"{prefix}_{k}" if prefix else str(k)
        if isinstance(v, str):
            out.setdefault(name if name not in out else f"{name}_2", v)
        else:
            json_tree(v, name, out)
    return out


@F.arrow_udf(T.MapType(T.StringType(), T.StringType()))
def json_flat(values):
    """json_tree of a column of JSON texts; null where the text can't be read."""
    import json

    import pyarrow as pa

    def one(v):
        try:
            return None if v is None else list(json_tree(json.loads(v)).items())
        except ValueError:
            return None

    return pa.array([one(v) for v in values.to_pylist()], pa.map_(pa.string(), pa.string()))


def pages_in_text(spark: SparkSession, path: str, begin: str = "{{-start-}}", end: str = "{{-stop-}}") -> DataFrame:
    """(title, contents) of pages between markers; the title stands in ''' ''' and stays in the contents.
    The file is cut at the end marker, so it is read in parts however long it is."""
    raw = spark.read.option("lineSep", end).text(path)
    body = F.regexp_extract("value", "(?s)" + re.escape(begin) + r"\r?\n?(.*)$", 1)
    return raw.select(body.alias("contents")).filter("contents <> ''").select(F.regexp_extract("contents", r"'''(.*?)'''", 1).alias("title"), "contents").filter("title <> ''")


def titles_in_text(spark: SparkSession, path: str) -> DataFrame:
    """Titles in [[ ]]; or, if there is none in all the text, one title a line."""
    lines = spark.read.text(path).select("value", F.regexp_extract_all("value", F.lit(r"\[\[([^\[\]|\n]+)"), F.lit(1)).alias("links"))
    linked = lines.select(F.explode("links").alias("title")).withColumn("kind", F.lit(1))
    every = linked.unionByName(lines.select(F.trim("value").alias("title")).filter("title <> ''").withColumn("kind", F.lit(0)))
    best = every.agg(F.max("kind").alias("kind"))  # one row
    return every.join(F.broadcast(best), "kind").select("title")


def hints_in_log(spark: SparkSession, path: str) -> DataFrame:
    """(page, action, lang, title) of a warning log: 'WARNING: [[page]] does (not) link to [[lang:title]]'."""
    line = spark.read.text(path).select("value")
    p = r"WARNING: (?:[^\[]*)\[\[(?:[a-z-]+:)?([^\[\]]+)\]\](.*)\[\[([a-z-]+):([^\[\]]+)\]\]"
    got = line.filter(F.col("value").rlike(p)).select(F.regexp_extract("value", p, 1).alias("page"), F.regexp_extract("value", p, 2).alias("what"), F.regexp_extract("value", p, 3).alias("lang"), F.regexp_extract("value", p, 4).alias("title"))
    return got.select("page", F.when(F.col("what").rlike("does not|doesn't"), "add").otherwise("remove").alias("action"), "lang", "title")
