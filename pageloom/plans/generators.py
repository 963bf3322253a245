"""Page lists by arguments: '-prefixindex:B', '-ns:0', '-limit:10', ... become one plan.

Sources are united in the order they are given, repeated pages dropped, the limit applied, then the
filters: the limit counts before the namespace filter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from pageloom.operators import graph, pages


@dataclass
class Relations:
    """The tables that sources read; those that are not needed may be None."""

    page: DataFrame
    link: DataFrame | None = None  # from_id, to_id
    category: DataFrame | None = None  # member, category (page ids)
    revision: DataFrame | None = None  # page_id, user_name, ts
    log: DataFrame | None = None  # page_id, type, ts, user_name
    url: DataFrame | None = None  # page_id, url
    text: DataFrame | None = None  # page_id, text
    image: DataFrame | None = None  # page_id, file
    template: DataFrame | None = None  # page_id, template
    language: DataFrame | None = None  # page_id, lang, title
    watch: DataFrame | None = None  # page_id
    bot: DataFrame | None = None  # user_name


@dataclass
class PageQuery:
    relations: Relations
    sources: list[DataFrame] = field(default_factory=list)
    limit: int | None = None
    namespaces: list[int] = field(default_factory=list)
    filters: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)

    def argument(self, arg: str) -> bool:
        """Takes one argument; False if it is none of the known ones."""
        name, _, value = arg.lstrip("-").partition(":")
        handler = _SOURCES.get(name)
        if handler:
            self.sources.append(handler(self.relations, value))
        elif name in ("namespace", "ns"):
            self.namespaces += [int(v) for v in value.split(",")]
        elif name == "limit":
            self.limit = int(value)
        elif name in ("titleregex", "titleregexnot"):
            self.filters.append(lambda p: pages.titles_matching(p, [value], inverse=name.endswith("not")))
        elif name.endswith("log"):
            self.sources.append(_logged(self.relations, name[:-3], value))
        else:
            return False
        return True

    def plan(self) -> DataFrame:
        if not self.sources:
            raise ValueError("no source of pages is given")
        out = pages.combined(self.sources, self.limit, self.namespaces or None)
        for f in self.filters:
            out = f(out)
        return out


def page_query(relations: Relations, *arguments: str) -> DataFrame:
    q = PageQuery(relations)
    for a in arguments:
        if not q.argument(a):
            raise ValueError(f"unknown argument {a}")
    return q.plan()


def _titled(r: Relations, title: str) -> DataFrame:
    return r.page.filter(F.col("title") == title)


def _members(r: Relations, title: str, recurse: bool, subcategories: bool = False) -> DataFrame:
    title, _, start = title.replace("#", "|").partition("|")
    root = _titled(r, f"Category:{title}").select(F.col("page_id").alias("node"))
    found = graph.closure(r.category.select(F.col("category").alias("parent"), F.col("member").alias("child")), root, None if recurse else 1).filter("depth > 0")
    out = r.page.join(found.select(F.col("node").alias("page_id")).distinct(), "page_id", "left_semi").filter(F.col("title") >= start)
    return out.filter("ns = 14") if subcategories else out.filter("ns <> 14")


def _linked(r: Relations, title: str, back: bool) -> DataFrame:
    here, there = ("to_id", "from_id") if back else ("from_id", "to_id")
    l = r.link.join(_titled(r, title).select(F.col("page_id").alias(here)), here, "left_semi")
    return r.page.join(l.select(F.col(there).alias("page_id")).distinct(), "page_id", "left_semi")


def _edited_by(r: Relations, value: str) -> DataFrame:
    user, _, n = value.partition(";")
    last = r.revision.filter(F.col("user_name") == user).groupBy("user_name", "page_id").agg(F.max("ts").alias("ts"))
    own = pages.first_per_key(last, ["user_name"], int(n or 250), F.desc("ts"), F.desc("page_id"))
    return r.page.join(own.select("page_id").distinct(), "page_id", "left_semi")


def _of(r: Relations, ids: DataFrame) -> DataFrame:
    return r.page.join(ids.select("page_id").distinct(), "page_id", "left_semi")


def _logged(r: Relations, kind: str, value: str) -> DataFrame:
    """'-movelog', '-deletelog:10', '-protectlog:User;20': pages of the last entries of a log (of a user)."""
    user, _, n = value.partition(";")
    if user.isdigit() and not n:
        user, n = "", user
    entries = r.log.filter(F.col("type") == kind)
    if user:
        entries = entries.filter(F.col("user_name") == user)
    return _of(r, entries.orderBy(F.desc("ts"), F.desc("page_id")).limit(int(n or 500)))


def _newest(r: Relations, value: str, n: int, bots: bool = True) -> DataFrame:
    """Pages by their first revision, the newest first."""
    revisions = r.revision if bots or r.bot is None else r.revision.join(r.bot.select("user_name").distinct(), "user_name", "left_anti")
    first = revisions.groupBy("page_id").agg(F.min("ts").alias("ts"))
    return _of(r, first.orderBy(F.desc("ts"), F.desc("page_id")).limit(int(value or n)))


def _recent(r: Relations, value: str, bots: bool) -> DataFrame:
    revisions = r.revision if bots or r.bot is None else r.revision.join(r.bot.select("user_name").distinct(), "user_name", "left_anti")
    last = revisions.groupBy("page_id").agg(F.max("ts").alias("ts"))
    return _of(r, last.orderBy(F.desc("ts"), F.desc("page_id")).limit(int(value or 100)))


def _found(r: Relations, words: str) -> DataFrame:
    from pageloom.functions.articles import snippets

    return _of(r, snippets(r.text, words.split()))


def _in_file(r: Relations, path: str) -> DataFrame:
    from pageloom.sources.dumps import titles_in_text

    return r.page.join(titles_in_text(r.page.sparkSession, path).distinct(), "title", "left_semi")


def _images_of(r: Relations, title: str) -> DataFrame:
    shown = r.image.join(_titled(r, title).select("page_id"), "page_id", "left_semi").select(F.concat(F.lit("File:"), "file").alias("title")).distinct()
    return r.page.join(shown, "title", "left_semi")


def _capital(v: str) -> str:
    return v[:1].upper() + v[1:].replace("_", " ")


def _from(r: Relations, value: str, redirects: bool | None) -> DataFrame:
    """A title to begin at; a namespace's name before it begins in that namespace."""
    from pageloom.functions.titles import DEFAULT_RULES

    head, colon, _ = value.partition(":")
    return pages.all_pages(r.page, DEFAULT_RULES.names.get(head.lower(), 0) if colon else 0, value, redirects)


_SOURCES: dict[str, Callable[[Relations, str], DataFrame]] = {
    "start": lambda r, v: _from(r, v, True),
    "gorandom": lambda r, v: _from(r, pages.random_pages(r.page.filter("ns = 0"), 1, seed=0).first()["title"], True),
    "file": _in_file,
    "filelinks": lambda r, v: _of(r, r.image.filter(F.col("file") == _capital(v.removeprefix("File:")))),
    "imageused": lambda r, v: _of(r, r.image.filter(F.col("file") == _capital(v.removeprefix("File:")))),
    "imagelinks": _images_of,
    "transcludes": lambda r, v: _of(r, r.template.filter(F.col("template") == _capital(v.removeprefix("Template:")))),
    "search": _found,
    "interwiki": lambda r, v: r.page.join(r.language.join(_titled(r, v).select("page_id"), "page_id", "left_semi").select("title").union(_titled(r, v).select("title")).distinct(), "title", "left_semi"),
    "withoutinterwiki": lambda r, v: pages.without(r.page.filter("ns = 0"), r.language).limit(int(v)) if v else pages.without(r.page.filter("ns = 0"), r.language),
    "new": lambda r, v: _newest(r, v, 60),
    "newimages": lambda r, v: _of(r, r.log.filter("type = 'upload'").orderBy(F.desc("ts"), F.desc("page_id")).limit(int(v or 100))),
    "recentchanges": lambda r, v: _recent(r, v, True),
    "rc-nobots": lambda r, v: _recent(r, v, False),
    "unwatched": lambda r, v: pages.without(r.page, r.watch),
    "uncattemplates": lambda r, v: pages.without(r.page.filter("ns = 10"), r.category, other_key="member"),
    "randomredirect": lambda r, v: pages.random_pages(r.page.filter("is_redirect"), int(v or 10), seed=0),
    "prefixindex": lambda r, v: pages.all_pages(r.page, 0, prefix=v),
    "cat": lambda r, v: _members(r, v, False),
    "catr": lambda r, v: _members(r, v, True),
    "subcats": lambda r, v: _members(r, v, False, True),
    "subcatsr": lambda r, v: _members(r, v, True, True),
    "links": lambda r, v: _linked(r, v, False),
    "ref": lambda r, v: _linked(r, v, True),
    "uncat": lambda r, v: pages.without(r.page.filter("ns = 0"), r.category, other_key="member"),
    "uncatcat": lambda r, v: pages.without(r.page.filter("ns = 14"), r.category, other_key="member"),
    "uncatfiles": lambda r, v: pages.without(r.page.filter("ns = 6"), r.category, other_key="member"),
    "lonely": lambda r, v: pages.without(r.page.filter("ns = 0"), r.link, other_key="to_id"),
    "unusedfiles": lambda r, v: pages.without(r.page.filter("ns = 6"), r.link, other_key="to_id"),
    "deadend": lambda r, v: pages.without(r.page, r.link, other_key="from_id"),
    "long": lambda r, v: pages.longest(r.page, int(v or 100)).drop("rank"),
    "short": lambda r, v: pages.shortest(r.page, int(v or 100)).drop("rank"),
    "ancient": lambda r, v: r.page.join(pages.ancient(r.revision, int(v or 100)).select("page_id"), "page_id", "left_semi"),
    "usercontribs": _edited_by,
    "random": lambda r, v: pages.random_pages(r.page, int(v or 10), seed=0),
    "redirectonly": lambda r, v: _from(r, v, None),
    "weblink": lambda r, v: r.page.join(r.url.filter(F.col("url").rlike(rf"^[a-z]+://(?:[^/]*\.)?{v}(?:[/:?#]|$)")).select("page_id").distinct(), "page_id", "left_semi"),
    "page": _titled,
}


def pages_of_sql(tables: dict[str, DataFrame], text: str) -> DataFrame:
    """(ns, title) of a SQL text; {name} in it stands for one of the tables."""
    spark = next(iter(tables.values())).sparkSession
    return spark.sql(text, **tables).select("ns", "title")
