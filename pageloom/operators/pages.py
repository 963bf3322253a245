"""Lists of pages as relational operators: scans, anti joins, top-k, counts.

Relations: page(page_id, ns, title, is_redirect, length), link(from_id, to_id or title), category
link(from_id, category), revision(rev_id, page_id, user, ts, ...).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# ---- scans ------------------------------------------------------------------------------------


def all_pages(page: DataFrame, ns: int = 0, start: str = "", redirects: bool | None = True, prefix: str = "") -> DataFrame:
    """Pages of a namespace from a title on; redirects: True all, False none, None only redirects.
    A prefix is a range on the title, so it reaches the scan."""
    out = page.filter(F.col("ns") == ns).filter(F.col("title") >= start)
    if prefix:
        out = out.filter(F.col("title").startswith(prefix))
    return out if redirects is True else out.filter("NOT is_redirect" if redirects is False else "is_redirect")


def titles_matching(page: DataFrame, patterns: Sequence[str], inverse: bool = False, namespace_free: bool = True) -> DataFrame:
    """Pages whose title (without namespace) matches any of the patterns at its start, whatever the case."""
    title = F.regexp_replace("title", r"^[^:]+:", "") if namespace_free else F.col("title")
    any_of = F.lit(False)
    for p in patterns:
        any_of = any_of | title.rlike(f"(?i)^(?:{p})")
    return page.filter(~any_of if inverse else any_of)


def in_namespaces(page: DataFrame, namespaces: Sequence[int]) -> DataFrame:
    return page.filter(F.col("ns").isin(*namespaces))


def combined(pages: Sequence[DataFrame], limit: int | None = None, namespaces: Sequence[int] | None = None) -> DataFrame:
    """Union, first occurrences only, then the limit, then the namespaces: the limit counts before
    the filter. Order: place of the source, then title."""
    every = None
    for i, p in enumerate(pages):
        part = p.select("page_id", "ns", "title", F.lit(i).alias("source"))
        every = part if every is None else every.unionByName(part)
    out = every.groupBy("page_id", "ns", "title").agg(F.min("source").alias("source"))
    if limit is not None:
        out = out.orderBy("source", "title", "page_id").limit(limit)
    return in_namespaces(out, namespaces) if namespaces is not None else out


# ---- pages without something ------------------------------------------------------------------


def without(page: DataFrame, other: DataFrame, key: str = "page_id", other_key: str = "page_id") -> DataFrame:
    """Pages that ``other`` does not name: lonely, dead-end, uncategorised, unused, unwatched, without language links."""
    return page.join(other.select(F.col(other_key).alias(key)).distinct(), key, "left_anti")


def wanted(links: DataFrame, page: DataFrame, title: str = "title") -> DataFrame:
    """Link targets that don't exist, with the number of links."""
    n = links.groupBy(title).agg(F.count("*").alias("links"))
    return n.join(page.select(F.col("title").alias(title)).distinct(), title, "left_anti")


# ---- extremes ---------------------------------------------------------------------------------


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows in this order, each with its rank. The k rows are gathered before they are ranked."""
    first = df.orderBy(*order).limit(k)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def longest(page: DataFrame, k: int) -> DataFrame:
    return top(page, k, F.desc("length"), F.asc("page_id"))


def shortest(page: DataFrame, k: int) -> DataFrame:
    return top(page, k, F.asc("length"), F.asc("page_id"))


def ancient(revision: DataFrame, k: int) -> DataFrame:
    """Pages whose last edit is longest ago."""
    return top(revision.groupBy("page_id").agg(F.max("ts").alias("last_edit")), k, F.asc("last_edit"), F.asc("page_id"))


#: Up to this rank the optimiser drops rows before the shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000
SALTS = 64


def first_per_key(df: DataFrame, key: Sequence[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key. Ranks above k are dropped before the shuffle (the optimiser's
    window group limit), so a hot key sends k rows a task; for a larger k the keys are first ranked in
    SALTS parts, of which each sends k rows on."""
    if k > GROUP_LIMIT:
        part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(SALTS))
        df = df.withColumn("__salt", part).withColumn("__n", F.row_number().over(Window.partitionBy(*key, "__salt").orderBy(*order))).filter(F.col("__n") <= k).drop("__salt", "__n")
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def random_pages(page: DataFrame, n: int, seed: int) -> DataFrame:
    """n different pages, drawn by the hash of 'seed:page'; the same for the same seed."""
    return page.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("page_id").cast("string")))).orderBy("__h", "page_id").limit(n).drop("__h")


# ---- links ------------------------------------------------------------------------------------


def backlinks(links: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(to_id, from_id, via) of distinct links; with ``redirects`` (page_id, target_id) also the links
    to a redirect count for its target."""
    direct = links.select("to_id", "from_id", F.lit(None).cast("bigint").alias("via")).distinct()
    if redirects is None:
        return direct
    r = redirects.select(F.col("page_id").alias("via"), F.col("target_id"))
    hop = links.join(r, links["to_id"] == r["via"]).select(F.col("target_id").alias("to_id"), "from_id", "via").distinct()
    return direct.unionByName(hop)


def usage_counts(uses: DataFrame, key: str, page_key: str) -> DataFrame:
    """Uses and pages of each key, and a TOTAL row."""
    out = uses.rollup(key).agg(F.count("*").alias("uses"), F.countDistinct(page_key).alias("pages"), F.grouping(key).alias("g"))
    return out.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col(key)).alias(key), "uses", "pages")


def duplicates(files: DataFrame, content: Column, id_col: str) -> DataFrame:
    """(sha1, copies, first_id) of contents that occur more than once. Null contents are no duplicates."""
    h = files.select(F.sha1(content).alias("sha1"), F.col(id_col).alias("id")).filter("sha1 IS NOT NULL")
    return h.groupBy("sha1").agg(F.count("*").alias("copies"), F.min("id").alias("first_id")).filter("copies > 1")


def link_changes(old: DataFrame, new: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """What differs between two maps of links: added, removed and modified keys."""
    o, n = old.select(*key, F.col(value).alias("old")), new.select(*key, F.col(value).alias("new"))
    both = o.join(n, list(key), "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return both.withColumn("change", change).filter("change IS NOT NULL")


def in_category_and_parent(members: DataFrame, tree: DataFrame) -> DataFrame:
    """(member, category, parent): members of a category and of its parent category."""
    child = members.select("member", F.col("category").alias("child"))
    up = child.join(tree.select(F.col("member").alias("child"), F.col("category").alias("parent")), "child")
    return up.join(members.select("member", F.col("category").alias("parent")), ["member", "parent"], "left_semi").select("member", F.col("child").alias("category"), "parent").distinct()


def matching_histograms(a: DataFrame, b: DataFrame, vector: str, key: str) -> DataFrame:
    """Weighted Jaccard (sum of minima over sum of maxima, in percent) of the vectors of two keyed tables, pairwise by ``key``."""
    pairs = a.select(key, F.col(vector).alias("x")).join(b.select(key, F.col(vector).alias("y")), key)
    low = F.aggregate(F.zip_with("x", "y", lambda p, q: F.least(p, q).cast("double")), F.lit(0.0), lambda s, v: s + v)
    high = F.aggregate(F.zip_with("x", "y", lambda p, q: F.greatest(p, q).cast("double")), F.lit(0.0), lambda s, v: s + v)
    return pairs.select(key, F.round(100 * low / high, 4).alias("match"))
