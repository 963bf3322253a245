"""Pages, revisions, users, files, log entries and items as records: lookups, feeds, choices among copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pageloom.session import materialised

# ---- numbering and order ----------------------------------------------------------------------


def numbered(df: DataFrame, *order: Column, name: str = "n") -> DataFrame:
    """df with the place (from 1) of each row in this order. Rows are sorted by ranges; only the number
    of rows of each range is put in order by one task, never the rows themselves. Equal rows are numbered in any order."""
    ranges = materialised(df.orderBy(*order).withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}))
    sizes = ranges.groupBy("__part").agg(F.count("*").alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))  # as many rows as shuffle partitions
    at = F.shiftrightunsigned("__row", 33)  # a partition's ids begin at its number times 2^33
    place = F.col("__row") - F.shiftleft(at, 33)
    return ranges.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + place + 1).drop("__part", "__row", "__before")


def chunks(df: DataFrame, size: int, *order: Column, name: str = "chunk") -> DataFrame:
    """df in pieces of ``size`` rows in this order, numbered from 0."""
    return numbered(df, *order, name="__n").withColumn(name, F.floor((F.col("__n") - 1) / size)).drop("__n")


def combinations(items: Column, k: int) -> Column:
    """All subsets of k different elements of an array, each in the array's order; k of 2 or 3."""
    if k not in (2, 3):
        raise ValueError("k is 2 or 3")
    n = F.size(items)
    places = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    pairs = F.flatten(F.transform(places, lambda i: F.transform(F.filter(places, lambda j: j > i), lambda j: F.array(i, j))))
    if k == 3:
        pairs = F.flatten(F.transform(pairs, lambda p: F.transform(F.filter(places, lambda j: j > p[1]), lambda j: F.concat(p, F.array(j)))))
    return F.when(n >= k, F.transform(pairs, lambda p: F.transform(p, lambda i: F.element_at(items, i)))).otherwise(F.slice(F.transform(pairs, lambda p: F.transform(p, lambda i: F.element_at(items, F.lit(1)))), 1, 0))


# ---- feeds ------------------------------------------------------------------------------------


def changes(log: DataFrame, ts: str = "ts", since=None, until=None, kinds: Sequence | None = None, kind: str = "kind", without_users: DataFrame | None = None, user: str = "user", only_user=None) -> DataFrame:
    """Entries of a log by time (since included, until not), kind and user; ``without_users`` (user) are
    left out: bots, or one's own account. Every filter that is a constant reaches the scan."""
    out = log
    if since is not None:
        out = out.filter(F.col(ts) >= F.lit(since).cast("timestamp"))
    if until is not None:
        out = out.filter(F.col(ts) < F.lit(until).cast("timestamp"))
    if kinds is not None:
        out = out.filter(F.col(kind).isin(*kinds))
    if only_user is not None:
        out = out.filter(F.col(user) == only_user)
    return out if without_users is None else out.join(without_users.select(F.col(user)).distinct(), user, "left_anti")


def first_versions(revisions: DataFrame, key: str, ts: str, *columns: str) -> DataFrame:
    """The first revision of each page: when it was new. Combined before the shuffle."""
    return revisions.groupBy(key).agg(F.min(F.struct(ts, *columns)).alias("m")).select(key, f"m.{ts}", *[f"m.{c}" for c in columns])


def latest_by(df: DataFrame, key: Sequence[str] | str, order: Sequence[str], *columns: str) -> DataFrame:
    """Of each key the columns of its last row by ``order``; nulls come first, so they lose."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *columns)).alias("m")).select(*keys, *[f"m.{c}" for c in columns])


def edited_by(revisions: DataFrame, users: DataFrame, last: int = 100, page: str = "page_id", user: str = "user", ts: str = "ts", rev: str = "rev_id", skip: bool = False) -> DataFrame:
    """Pages among whose last ``last`` revisions is one of a listed user (``skip``: pages where none is)."""
    rank = F.row_number().over(Window.partitionBy(page).orderBy(F.desc_nulls_last(ts), F.desc(rev)))
    recent = revisions.select(page, user, ts, rev).withColumn("__n", rank).filter(F.col("__n") <= last)
    hit = recent.join(users.select(user).distinct(), user, "left_semi").select(page).distinct()
    return revisions.select(page).distinct().join(hit, page, "left_anti") if skip else hit


# ---- files ------------------------------------------------------------------------------------


def copy_to_keep(files: DataFrame, usage: DataFrame, hash_: str = "sha1", title: str = "title", ts: str = "ts") -> DataFrame:
    """(hash, kept, copies, uses): of the copies of a file the most used one, of equally used ones the oldest."""
    used = files.join(usage.groupBy(title).agg(F.count("*").alias("uses")), title, "left").fillna(0, ["uses"])
    best = used.groupBy(hash_).agg(F.count("*").alias("copies"), F.min(F.struct((-F.col("uses")).alias("less"), ts, title)).alias("m"))
    return best.filter("copies > 1").select(hash_, F.col(f"m.{title}").alias("kept"), "copies", (-F.col("m.less")).alias("uses"))


def in_both(local: DataFrame, shared: DataFrame, key: str, *columns: str) -> DataFrame:
    """Local files that the shared collection has too, by hash or name; each local file once with the
    least of the shared ones. The shared side is combined before the join."""
    other = shared.groupBy(key).agg(*[F.min(c).alias(f"shared_{c}") for c in columns])
    return local.join(other, key)


# ---- titles and items -------------------------------------------------------------------------


def with_talk_pages(pages: DataFrame, ns: str = "ns", key: str = "page_id") -> DataFrame:
    """Each page that is no talk page, followed by its talk page (``talk`` true)."""
    subject = pages.filter((F.col(ns) >= 0) & (F.col(ns) % 2 == 0))
    return subject.withColumn("talk", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn(ns, F.when(F.col("talk"), F.col(ns) + 1).otherwise(F.col(ns)))


def hinted(titles: DataFrame, hints: Sequence[str], sites: Sequence[str], title: str = "title") -> DataFrame:
    """Candidates on other sites: hints are 'site:Title', 'site:' for the same title, 'all:' for all
    sites, or 'n:' for the first n of them."""
    pairs: list[tuple[str, str]] = []
    for h in hints:
        to, _, name = h.partition(":")
        chosen = list(sites) if to == "all" else list(sites[: int(to)]) if to.isdigit() else [to]
        pairs += [(s, name) for s in chosen]
    options = F.array(*[F.struct(F.lit(s).alias("site"), F.lit(n).alias("name")) for s, n in pairs])
    return titles.select(F.col(title).alias("title"), F.explode(options).alias("h")).select("title", "h.site", F.when(F.col("h.name") == "", F.col("title")).otherwise(F.col("h.name")).alias("candidate")).distinct()


def items_with_label(items: DataFrame, part: str, labels: str = "labels", key: str = "item_id") -> DataFrame:
    """(key, lang, label) of the labels that hold a text, whatever the case."""
    return items.select(key, F.explode(labels).alias("lang", "label")).filter(F.contains(F.lower("label"), F.lit(part.lower())))


# ---- categories and language links ------------------------------------------------------------


def without_ancestors(members: DataFrame, tree: DataFrame, member: str = "member", category: str = "category") -> DataFrame:
    """Categories of each member without those above another of its categories. ``tree`` (root, node,
    depth) is the closure of the categories."""
    above = members.select(member, F.col(category).alias("node")).join(tree.filter("depth > 0").select("root", "node"), "node").select(member, F.col("root").alias(category)).distinct()
    return members.select(member, category).distinct().join(above, [member, category], "left_anti")


def mutual_links(links: DataFrame, a: Sequence[str] = ("site", "page"), b: Sequence[str] = ("to_site", "to_page")) -> DataFrame:
    """Links whose other side links back."""
    back = links.select(*[F.col(y).alias(x) for x, y in zip(a, b)], *[F.col(x).alias(y) for x, y in zip(a, b)])
    return links.distinct().join(back.distinct(), [*a, *b], "left_semi")


def without_backlink(links: DataFrame, a: Sequence[str] = ("site", "page"), b: Sequence[str] = ("to_site", "to_page")) -> DataFrame:
    """Links whose other side doesn't link back."""
    back = links.select(*[F.col(y).alias(x) for x, y in zip(a, b)], *[F.col(x).alias(y) for x, y in zip(a, b)])
    return links.distinct().join(back.distinct(), [*a, *b], "left_anti")


def merged_edges(links: DataFrame) -> DataFrame:
    """(a, b, both): each pair of linked nodes once, and whether the links go both ways."""
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    return links.select(lo.alias("a"), hi.alias("b"), (F.col("a") <= F.col("b")).alias("up")).distinct().groupBy("a", "b").agg((F.count("*") > 1).alias("both"))


def mismatched(links: DataFrame, left: DataFrame, right: DataFrame, allowed: Sequence[tuple] = ()) -> DataFrame:
    """Links between pages whose property (a namespace, being a disambiguation, ...) differs, but for
    allowed pairs. left (page, kind), right (to_page, to_kind)."""
    j = links.join(left, "page").join(right, "to_page").filter(F.col("kind") != F.col("to_kind"))
    ok = F.lit(False)
    for x, y in allowed:
        ok = ok | ((F.col("kind") == x) & (F.col("to_kind") == y))
    return j.filter(~ok)
