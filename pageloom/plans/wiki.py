"""Queries of the page operators over the test tables, each with the same question in SQL.

Pages, links, categories and redirects are projected from the star schema; wikitext comes from
documents, contributions from revertbot, blocks from apispec, file history from catimages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pageloom.functions import cleaning, language, rewriting, scalars, titles, wikitext
from pageloom.operators import blocks, graph, history, pages, watching
from pageloom.plans.generators import Relations, page_query
from pageloom.session import table
from pageloom.sources import dumps

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


# ---- projection -------------------------------------------------------------------------------

PAGE = """page AS (SELECT CAST(p_partkey AS BIGINT) AS page_id, 0 AS ns, p_name || ' ' || p_partkey AS title, p_partkey % 10 IN (1, 2) OR p_partkey % 97 = 0 AS is_redirect, CAST(p_size AS BIGINT) * 100 + length(p_name) AS length FROM part
 UNION ALL SELECT 20000000 + CAST(c_custkey AS BIGINT), 2, 'User:' || c_name, FALSE, CAST(length(c_name) AS BIGINT) FROM customer
 UNION ALL SELECT 40000000 + CAST(s_suppkey AS BIGINT), 4, 'Project:' || s_name, FALSE, CAST(length(s_name) AS BIGINT) FROM supplier
 UNION ALL SELECT 140000000 + CAST(n_nationkey AS BIGINT), 14, 'Category:' || n_name, FALSE, CAST(length(n_name) AS BIGINT) FROM nation
 UNION ALL SELECT 141000000 + CAST(r_regionkey AS BIGINT), 14, 'Category:' || r_name, FALSE, CAST(length(r_name) AS BIGINT) FROM region)"""
REDIRECT = """redirect AS (SELECT CAST(p_partkey AS BIGINT) AS page_id, CASE WHEN p_partkey % 97 = 0 THEN -1 - CAST(p_partkey AS BIGINT) WHEN p_partkey = 12 THEN CAST(11 AS BIGINT) ELSE CAST(p_partkey AS BIGINT) + 1 END AS target_id
 FROM part WHERE p_partkey % 10 IN (1, 2) OR p_partkey % 97 = 0)"""
LINK = """link AS (SELECT 20000000 + CAST(o_custkey AS BIGINT) AS from_id, CAST(l_partkey AS BIGINT) AS to_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_partkey % 7 <> 0 AND o_custkey % 13 <> 0)"""
CATEGORY = """catlink AS (SELECT 20000000 + CAST(c_custkey AS BIGINT) AS member, 140000000 + CAST(c_nationkey AS BIGINT) AS category FROM customer WHERE c_custkey % 11 <> 0
 UNION ALL SELECT 40000000 + CAST(s_suppkey AS BIGINT), 140000000 + CAST(s_nationkey AS BIGINT) FROM supplier
 UNION ALL SELECT 40000000 + CAST(s_suppkey AS BIGINT), 141000000 + CAST(n_regionkey AS BIGINT) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 = 0
 UNION ALL SELECT 140000000 + CAST(n_nationkey AS BIGINT), 141000000 + CAST(n_regionkey AS BIGINT) FROM nation)"""


def page(s: SparkSession, d: str) -> DataFrame:
    def one(name: str, key: str, base: int, ns: int, prefix: str, label: str) -> DataFrame:
        t = table(s, d, name)
        return t.select((F.lit(base) + F.col(key).cast("bigint")).alias("page_id"), F.lit(ns).alias("ns"), F.concat(F.lit(prefix), F.col(label)).alias("title"), F.lit(False).alias("is_redirect"), F.length(label).cast("bigint").alias("length"))

    p, k = table(s, d, "part"), F.col("p_partkey")
    parts = p.select(k.cast("bigint").alias("page_id"), F.lit(0).alias("ns"), F.concat("p_name", F.lit(" "), k.cast("string")).alias("title"), ((k % 10).isin(1, 2) | (k % 97 == 0)).alias("is_redirect"), (F.col("p_size").cast("bigint") * 100 + F.length("p_name")).alias("length"))
    for rest in (("customer", "c_custkey", 20000000, 2, "User:", "c_name"), ("supplier", "s_suppkey", 40000000, 4, "Project:", "s_name"), ("nation", "n_nationkey", 140000000, 14, "Category:", "n_name"), ("region", "r_regionkey", 141000000, 14, "Category:", "r_name")):
        parts = parts.unionByName(one(*rest))
    return parts


def redirect(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey").cast("bigint")
    t = F.when(k % 97 == 0, -1 - k).when(k == 12, F.lit(11).cast("bigint")).otherwise(k + 1)
    return table(s, d, "part").filter((k % 10).isin(1, 2) | (k % 97 == 0)).select(k.alias("page_id"), t.alias("target_id"))


def link(s: SparkSession, d: str) -> DataFrame:
    o, l = table(s, d, "orders").filter("o_custkey % 13 <> 0"), table(s, d, "lineitem").filter("l_partkey % 7 <> 0")
    return o.select("o_orderkey", "o_custkey").join(l.select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey")).select((20000000 + F.col("o_custkey").cast("bigint")).alias("from_id"), F.col("l_partkey").cast("bigint").alias("to_id"))


def catlink(s: SparkSession, d: str) -> DataFrame:
    def pair(df: DataFrame, m: str, mbase: int, c: str, cbase: int) -> DataFrame:
        return df.select((mbase + F.col(m).cast("bigint")).alias("member"), (cbase + F.col(c).cast("bigint")).alias("category"))

    sup, nat = table(s, d, "supplier"), table(s, d, "nation")
    out = pair(table(s, d, "customer").filter("c_custkey % 11 <> 0"), "c_custkey", 20000000, "c_nationkey", 140000000)
    out = out.unionByName(pair(sup, "s_suppkey", 40000000, "s_nationkey", 140000000))
    out = out.unionByName(pair(sup.filter("s_suppkey % 3 = 0").join(nat, F.col("s_nationkey") == F.col("n_nationkey")), "s_suppkey", 40000000, "n_regionkey", 141000000))
    return out.unionByName(pair(nat, "n_nationkey", 140000000, "n_regionkey", 141000000))


def _text(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


TS = "strftime({} AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')"

# ---- scans and filters ------------------------------------------------------------------------


@query(f"WITH {PAGE} SELECT page_id, title FROM page WHERE ns = 14 AND title >= 'Category:C'")
def all_pages_ns(s, d):
    return pages.all_pages(page(s, d), 14, "Category:C").select("page_id", "title")


@query(f"WITH {PAGE} SELECT page_id, title FROM page WHERE ns = 0 AND NOT is_redirect AND starts_with(title, 'b')")
def prefix_pages(s, d):
    return pages.all_pages(page(s, d), 0, redirects=False, prefix="b").select("page_id", "title")


@query(f"WITH {PAGE} SELECT page_id, title FROM page WHERE ns = 0 AND is_redirect")
def redirect_pages(s, d):
    return pages.all_pages(page(s, d), 0, redirects=None).select("page_id", "title")


@query(f"WITH {PAGE} SELECT page_id, title FROM page WHERE regexp_matches(regexp_replace(title, '^[^:]+:', ''), '(?i)^(?:.*1\\d$|customer#0+9)')")
def title_regex_pages(s, d):
    return pages.titles_matching(page(s, d), [r".*1\d$", "customer#0+9"]).select("page_id", "title")


@query(f"WITH {PAGE} SELECT page_id, title FROM page WHERE NOT regexp_matches(regexp_replace(title, '^[^:]+:', ''), '(?i)^(?:[a-m])')")
def title_regex_inverse(s, d):
    return pages.titles_matching(page(s, d), ["[a-m]"], inverse=True).select("page_id", "title")


@query(f"""WITH {PAGE}, u AS (SELECT page_id, ns, title, min(source) AS source FROM (SELECT page_id, ns, title, 0 AS source FROM page WHERE ns = 14
 UNION ALL SELECT page_id, ns, title, 1 FROM page WHERE ns = 4 UNION ALL SELECT page_id, ns, title, 2 FROM page WHERE ns IN (4, 14)) GROUP BY ALL),
 l AS (SELECT * FROM u ORDER BY source, title, page_id LIMIT 60) SELECT page_id, title, source FROM l WHERE ns = 4""")
def ns_filter_after_limit(s, d):
    p = page(s, d)
    return pages.combined([p.filter("ns = 14"), p.filter("ns = 4"), p.filter("ns IN (4, 14)")], 60, [4]).select("page_id", "title", "source")


@query(f"WITH {PAGE} SELECT ns, count(*) AS pages, CAST(sum(length) AS BIGINT) AS length FROM page GROUP BY ns")
def site_statistics(s, d):
    return page(s, d).groupBy("ns").agg(F.count("*").alias("pages"), F.sum("length").alias("length"))


@query(f"WITH {PAGE} SELECT page_id, title, row_number() OVER (ORDER BY length DESC, page_id) AS rank FROM page WHERE ns = 0 ORDER BY rank LIMIT 50")
def long_pages(s, d):
    return pages.longest(page(s, d).filter("ns = 0"), 50).select("page_id", "title", "rank")


@query(f"WITH {PAGE} SELECT page_id, title, row_number() OVER (ORDER BY length, page_id) AS rank FROM page WHERE ns = 0 ORDER BY rank LIMIT 50")
def short_pages(s, d):
    return pages.shortest(page(s, d).filter("ns = 0"), 50).select("page_id", "title", "rank")


@query(f"WITH {PAGE} SELECT page_id, title FROM page ORDER BY md5('7:' || CAST(page_id AS VARCHAR)), page_id LIMIT 20")
def random_pages(s, d):
    return pages.random_pages(page(s, d), 20, seed=7).select("page_id", "title")


# ---- links, redirects, categories -------------------------------------------------------------


@query(f"WITH {PAGE}, {LINK} SELECT page_id, title FROM page WHERE ns = 0 AND page_id NOT IN (SELECT to_id FROM link)")
def lonely_pages(s, d):
    return pages.without(page(s, d).filter("ns = 0"), link(s, d), other_key="to_id").select("page_id", "title")


@query(f"WITH {PAGE}, {LINK} SELECT page_id, title FROM page WHERE ns = 2 AND page_id NOT IN (SELECT from_id FROM link)")
def deadend_pages(s, d):
    return pages.without(page(s, d).filter("ns = 2"), link(s, d), other_key="from_id").select("page_id", "title")


@query(f"WITH {PAGE}, {CATEGORY} SELECT page_id, title FROM page WHERE ns IN (2, 4, 14) AND page_id NOT IN (SELECT member FROM catlink)")
def uncategorized_pages(s, d):
    return pages.without(page(s, d).filter("ns IN (2, 4, 14)"), catlink(s, d), other_key="member").select("page_id", "title")


@query(f"""WITH {LINK}, {PAGE} SELECT CAST(to_id + 1500 AS BIGINT) AS target, count(*) AS links FROM link WHERE to_id + 1500 NOT IN (SELECT page_id FROM page) GROUP BY 1""")
def wanted_pages(s, d):
    targets = link(s, d).select((F.col("to_id") + 1500).alias("target"))
    return pages.wanted(targets, page(s, d).select(F.col("page_id").alias("title")), "target")


@query(f"WITH {REDIRECT}, {PAGE} SELECT page_id, target_id FROM redirect WHERE target_id NOT IN (SELECT page_id FROM page)")
def broken_redirects(s, d):
    return graph.broken_redirects(redirect(s, d), page(s, d))


@query(f"WITH {REDIRECT} SELECT page_id, target_id FROM redirect WHERE target_id IN (SELECT page_id FROM redirect)")
def double_redirects(s, d):
    return graph.double_redirects(redirect(s, d))


@query(f"""WITH RECURSIVE {REDIRECT}, {PAGE}, walk AS (SELECT page_id, target_id AS pos, 1 AS hops FROM redirect UNION ALL SELECT w.page_id, r.target_id, w.hops + 1 FROM walk w JOIN redirect r ON w.pos = r.page_id WHERE w.hops < 40),
 e AS (SELECT page_id, max_by(pos, hops) AS pos, max(hops) AS hops FROM walk GROUP BY page_id)
 SELECT page_id, CASE WHEN hops < 40 THEN pos END AS final_id, CASE WHEN hops < 40 THEN hops END AS hops, CASE WHEN hops = 40 THEN 'loop' WHEN pos IN (SELECT page_id FROM page) THEN 'ok' ELSE 'broken' END AS kind FROM e""")
def redirect_resolve(s, d):
    return graph.redirect_chains(redirect(s, d), page(s, d))


@query(f"""WITH {LINK}, {REDIRECT} SELECT to_id, count(DISTINCT from_id) AS pages, count(*) AS links FROM (SELECT DISTINCT to_id, from_id, NULL AS via FROM link
 UNION ALL SELECT DISTINCT r.target_id, l.from_id, r.page_id FROM link l JOIN redirect r ON l.to_id = r.page_id) GROUP BY to_id""")
def backlinks_via_redirect(s, d):
    b = pages.backlinks(link(s, d), redirect(s, d))
    return b.groupBy("to_id").agg(F.countDistinct("from_id").alias("pages"), F.count("*").alias("links"))


@query(f"""WITH RECURSIVE {CATEGORY}, tree AS (SELECT category AS root, member AS node, 1 AS depth FROM catlink WHERE category >= 141000000
 UNION ALL SELECT t.root, c.member, t.depth + 1 FROM tree t JOIN catlink c ON t.node = c.category)
 SELECT root, node, min(depth) AS depth FROM tree GROUP BY root, node UNION ALL SELECT DISTINCT category, category, 0 FROM catlink WHERE category >= 141000000""")
def category_tree(s, d):
    c = catlink(s, d)
    return graph.closure(c.select(F.col("category").alias("parent"), F.col("member").alias("child")), c.filter("category >= 141000000").select(F.col("category").alias("node")))


@query(f"""WITH {CATEGORY} SELECT DISTINCT a.member, a.category, t.category AS parent FROM catlink a JOIN catlink t ON a.category = t.member JOIN catlink b ON b.member = a.member AND b.category = t.category""")
def overcategorised(s, d):
    c = catlink(s, d)
    return pages.in_category_and_parent(c, c)


@query(f"WITH {CATEGORY} SELECT category, count(*) AS members, count(*) FILTER (member >= 140000000) AS subcategories FROM catlink GROUP BY category")
def category_members(s, d):
    return catlink(s, d).groupBy("category").agg(F.count("*").alias("members"), F.count_if(F.col("member") >= 140000000).alias("subcategories"))


@query("""WITH RECURSIVE e AS (SELECT CAST(n_nationkey AS BIGINT) AS a, CAST(100 + n_regionkey AS BIGINT) AS b FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT CAST(n_nationkey AS BIGINT), CAST(n_nationkey + 1 AS BIGINT) FROM nation WHERE n_nationkey % 5 = 0),
 n AS (SELECT a AS node FROM e UNION SELECT b FROM e), w AS (SELECT node, node AS seen FROM n UNION SELECT w.node, CASE WHEN e.a = w.seen THEN e.b ELSE e.a END FROM w JOIN e ON e.a = w.seen OR e.b = w.seen)
 SELECT node, min(seen) AS component FROM w GROUP BY node""")
def interwiki_closure(s, d):
    n = table(s, d, "nation")
    k = F.col("n_nationkey").cast("bigint")
    e = n.filter("n_nationkey % 2 = 0").select(k.alias("a"), (100 + F.col("n_regionkey")).cast("bigint").alias("b")).unionByName(n.filter("n_nationkey % 5 = 0").select(k.alias("a"), (k + 1).alias("b")))
    return graph.components(e)


@query("""WITH o AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'X' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 4 <> 0)
 SELECT coalesce(o.k, n.k) AS k, o.v AS old, n.v AS new, CASE WHEN o.v IS NULL THEN 'added' WHEN n.v IS NULL THEN 'removed' ELSE 'modified' END AS change FROM o FULL JOIN n ON o.k = n.k WHERE o.v IS DISTINCT FROM n.v""")
def language_link_diff(s, d):
    c = table(s, d, "customer")
    old = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    new = c.filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 5 == 0, "X").otherwise(F.col("c_mktsegment")).alias("v"))
    return pages.link_changes(old, new, ["k"], "v")


# ---- contributions ----------------------------------------------------------------------------

_REVS = """rev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY revid ORDER BY fetched_at NULLS LAST) AS n FROM revertbot) WHERE n = 1)"""


def _revs(s, d, *columns: str) -> DataFrame:
    """Each revision once; only these columns are read and shuffled."""
    return history.distinct_revisions(table(s, d, "revertbot").select("revid", "fetched_at", *columns))


@query(f"WITH {_REVS} SELECT revid, pageid, user_name, {TS.format('\"timestamp\"')} AS at, sizediff FROM rev")
def distinct_revisions(s, d):
    return _revs(s, d, "pageid", "user_name", "timestamp", "sizediff").select("revid", "pageid", "user_name", _text("timestamp").alias("at"), "sizediff")


@query(f"""WITH {_REVS} SELECT revid, pageid, CASE WHEN pageid IS NOT NULL THEN lag(revid) OVER (PARTITION BY pageid ORDER BY "timestamp" NULLS FIRST, revid) END AS previous_revid FROM rev""")
def previous_revision(s, d):
    return history.previous_revision(_revs(s, d, "pageid", "timestamp")).select("revid", "pageid", "previous_revid")


@query(f"""WITH {_REVS}, r AS (SELECT *, row_number() OVER (PARTITION BY pageid ORDER BY "timestamp", revid) AS f, row_number() OVER (PARTITION BY pageid ORDER BY "timestamp" DESC, revid DESC) AS l FROM rev WHERE pageid <> 0 AND "timestamp" IS NOT NULL)
 SELECT pageid, max(CASE WHEN f = 1 THEN user_name END) AS creator, {TS.format('min("timestamp")')} AS created, max(CASE WHEN f = 1 THEN revid END) AS first_revid, max(CASE WHEN l = 1 THEN user_name END) AS last_editor, max(CASE WHEN l = 1 THEN revid END) AS last_revid, count(*) AS revisions FROM r GROUP BY pageid""")
def creators(s, d):
    return history.creators(_revs(s, d, "pageid", "timestamp", "user_name")).withColumn("created", _text("created"))


@query(f"WITH {_REVS} SELECT pageid, user_name, count(*) AS edits FROM rev WHERE user_name IS NOT NULL GROUP BY pageid, user_name")
def page_editors(s, d):
    return history.editors(_revs(s, d, "pageid", "user_name"))


@query(f"""WITH {_REVS}, r AS (SELECT user_name, revid, row_number() OVER (PARTITION BY user_name ORDER BY "timestamp" DESC NULLS LAST, revid DESC) AS rank FROM rev WHERE user_name IS NOT NULL) SELECT * FROM r WHERE rank <= 10""")
def user_contributions(s, d):
    return pages.first_per_key(_revs(s, d, "user_name", "timestamp").filter("user_name IS NOT NULL").select("user_name", "revid", "timestamp"), ["user_name"], 10, F.desc_nulls_last("timestamp"), F.desc("revid")).drop("timestamp")


@query(f"""WITH {_REVS}, r AS (SELECT pageid, revid, row_number() OVER (PARTITION BY pageid ORDER BY "timestamp" DESC NULLS LAST, revid DESC) AS rank FROM rev WHERE pageid <> 0) SELECT * FROM r WHERE rank <= 5""")
def latest_editors(s, d):
    return pages.first_per_key(_revs(s, d, "pageid", "timestamp").filter("pageid <> 0").select("pageid", "revid", "timestamp"), ["pageid"], 5, F.desc_nulls_last("timestamp"), F.desc("revid")).drop("timestamp")


@query(f"""WITH {_REVS}, l AS (SELECT pageid, max("timestamp") AS last_edit FROM rev WHERE pageid <> 0 GROUP BY pageid) SELECT pageid AS page_id, {TS.format('last_edit')} AS last_edit, row_number() OVER (ORDER BY last_edit, pageid) AS rank FROM l WHERE last_edit IS NOT NULL ORDER BY rank LIMIT 100""")
def ancient_pages(s, d):
    r = _revs(s, d, "pageid", "timestamp").filter("pageid <> 0 AND timestamp IS NOT NULL").select(F.col("pageid").alias("page_id"), F.col("timestamp").alias("ts"))
    return pages.ancient(r, 100).withColumn("last_edit", _text("last_edit"))


@query(f"""WITH {_REVS} SELECT pageid, count(*) AS edits FROM rev WHERE "timestamp" > TIMESTAMPTZ '2010-01-01 00:00:00+00' AND "timestamp" < TIMESTAMPTZ '2011-01-01 00:00:00+00' GROUP BY pageid""")
def edit_time_filter(s, d):
    r = _revs(s, d, "pageid", "timestamp").filter((F.col("timestamp") > F.lit("2010-01-01").cast("timestamp")) & (F.col("timestamp") < F.lit("2011-01-01").cast("timestamp")))
    return r.groupBy("pageid").agg(F.count("*").alias("edits"))


@query(f"""WITH {_REVS}, u AS (SELECT user_name FROM rev WHERE user_name IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, user_name LIMIT 1),
 p AS (SELECT revid, pageid, user_name, "top", CASE WHEN pageid IS NOT NULL THEN lag(revid) OVER (PARTITION BY pageid ORDER BY "timestamp" NULLS FIRST, revid) END AS previous_revid FROM rev)
 SELECT pageid, revid, previous_revid FROM p WHERE "top" AND user_name IN (SELECT user_name FROM u)""")
def revert_targets(s, d):
    r = _revs(s, d, "pageid", "user_name", "timestamp", "top")
    user = r.filter("user_name IS NOT NULL").groupBy("user_name").count().orderBy(F.desc("count"), "user_name").limit(1).select(F.col("user_name").alias("who"))
    p = history.previous_revision(r)
    return p.join(F.broadcast(user), p["user_name"] == F.col("who"), "left_semi").filter("top").select("pageid", "revid", "previous_revid")


@query(f"""WITH {_REVS} SELECT strftime("timestamp" AT TIME ZONE 'UTC', '%Y-%m') AS month, ns, count(*) AS edits, count(DISTINCT user_name) AS users, CAST(sum(sizediff) AS BIGINT) AS growth FROM rev GROUP BY ALL""")
def edits_by_month(s, d):
    return _revs(s, d, "timestamp", "ns", "user_name", "sizediff").groupBy(F.date_format("timestamp", "yyyy-MM").alias("month"), "ns").agg(F.count("*").alias("edits"), F.countDistinct("user_name").alias("users"), F.sum("sizediff").alias("growth"))


@query("""SELECT user_id, count(*) AS n, CAST(max(event_id) AS BIGINT) AS last_event FROM events WHERE event_type <> 'view' AND user_id % 10 <> 0 GROUP BY user_id""")
def recent_changes(s, d):
    return table(s, d, "events").filter("event_type <> 'view' AND user_id % 10 <> 0").groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").cast("bigint").alias("last_event"))


@query("""WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rank FROM events) SELECT event_type, event_id, rank FROM r WHERE rank <= 100""")
def log_pages(s, d):
    return pages.first_per_key(table(s, d, "events").select("event_type", "event_id", "ts"), ["event_type"], 100, F.desc("ts"), F.desc("event_id")).drop("ts")


@query("""WITH e AS (SELECT CAST(event_id % 97 AS BIGINT) AS page, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events) SELECT page, min(t) AS first_seen, max(t) AS last_seen, count(DISTINCT t // 3600) AS slots, max(t) - min(t) > 7 * 86400 AS report FROM e GROUP BY page""")
def dead_link_report(s, d):
    """Counts hours by the clock, as the SQL does; dead_link_sightings counts by the reference's rule."""
    return history.first_and_last_seen(_sightings(s, d), "page", "ts").withColumns({c: F.unix_timestamp(c) for c in ("first_seen", "last_seen")})


def _sightings(s, d):
    return table(s, d, "events").select((F.col("event_id") % 97).cast("bigint").alias("page"), F.col("ts").cast("timestamp").alias("ts"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT CAST(event_id % 97 AS BIGINT) AS page, epoch_us(ts) AS t FROM events), nx AS (SELECT page, t, min(t) OVER (PARTITION BY page ORDER BY t RANGE BETWEEN 3600000001 FOLLOWING AND UNBOUNDED FOLLOWING) AS t2 FROM e),
 w AS (SELECT page, min(t) AS t FROM e GROUP BY page UNION ALL SELECT w.page, nx.t2 FROM w JOIN nx ON w.page = nx.page AND w.t = nx.t WHERE nx.t2 IS NOT NULL), m AS (SELECT page, min(t) AS lo, max(t) AS hi FROM e GROUP BY page)
 SELECT m.page, any_value(lo) // 1000000 AS first_seen, any_value(hi) // 1000000 AS last_seen, count(*) AS sightings, any_value(hi) - any_value(lo) > 604800000000 AS report FROM m JOIN w USING (page) GROUP BY m.page""")
def dead_link_sightings(s, d):
    return history.counted_sightings(_sightings(s, d), "page", "ts").withColumns({c: F.unix_timestamp(c) for c in ("first_seen", "last_seen")})


# ---- wikitext ---------------------------------------------------------------------------------

_docs = lambda s, d: table(s, d, "documents")


@query(r"""SELECT doc_id, target, count(*) AS links FROM (SELECT doc_id, trim(unnest(regexp_extract_all(text, '\[\[([^\[\]|<>{}#\n]+)(?:#[^\[\]|\n]*)?(?:\|[^\[\]]*)?\]\]', 1))) AS target FROM documents) GROUP BY ALL""")
def internal_links(s, d):
    return _docs(s, d).select("doc_id", F.explode(wikitext.link_targets(F.col("text"))).alias("target")).groupBy("doc_id", "target").agg(F.count("*").alias("links"))


@query(r"""SELECT doc_id, c AS category, coalesce(k, '') AS sort_key FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\[\[\s*Category\s*:\s*([^\[\]|\n]+?)\s*(?:\|([^\[\]\n]*))?\]\]', 1)) AS c, unnest(regexp_extract_all(text, '(?i)\[\[\s*Category\s*:\s*([^\[\]|\n]+?)\s*(?:\|([^\[\]\n]*))?\]\]', 2)) AS k FROM documents)""")
def category_links(s, d):
    return _docs(s, d).select("doc_id", F.inline(wikitext.category_links(F.col("text"))))


@query(r"""SELECT doc_id, regexp_extract(b, '^([^|]*)', 1) AS name, coalesce(nullif(regexp_extract(b, '\|name=([^|]*)', 1), ''), '-') AS p_name, coalesce(nullif(regexp_extract(b, '\|nr=([^|]*)', 1), ''), '-') AS p_nr FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\{\{([^{}]*)\}\}', 1)) AS b FROM documents)""")
def templates_params(s, d):
    t = _docs(s, d).select("doc_id", F.explode(wikitext.templates_and_params(F.col("text"))).alias("t"))
    get = lambda k: F.coalesce(F.try_element_at("t.params", F.lit(k)), F.lit("-"))
    return t.select("doc_id", F.col("t.name").alias("name"), get("name").alias("p_name"), get("nr").alias("p_nr"))


@query(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '\{\{([^{}|]*)', 1)) AS template FROM documents)
 SELECT coalesce(template, 'TOTAL') AS template, count(*) AS uses, count(DISTINCT doc_id) AS pages FROM t GROUP BY ROLLUP (template)""")
def template_count(s, d):
    t = _docs(s, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\{\{([^{}|]*)"), F.lit(1))).alias("template"))
    return pages.usage_counts(t, "template", "doc_id")


@query(r"""SELECT doc_id, length(m) AS level, h AS heading FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^(={1,6})[ \t]*([^=\n].*?)[ \t]*={1,6}[ \t]*$', 1)) AS m, unnest(regexp_extract_all(text, '(?m)^(={1,6})[ \t]*([^=\n].*?)[ \t]*={1,6}[ \t]*$', 2)) AS h FROM documents)""")
def page_sections(s, d):
    return _docs(s, d).select("doc_id", F.inline(wikitext.headings(F.col("text")))).select("doc_id", F.length("marks").cast("bigint").alias("level"), "heading")


@query(r"""SELECT doc_id, user_name, count(*) AS posts FROM (SELECT doc_id, unnest(regexp_extract_all(text, '-- ?\[\[User:([^\[\]|]*)\]\]', 1)) AS user_name FROM documents) GROUP BY ALL""")
def signatures(s, d):
    return _docs(s, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"-- ?\[\[User:([^\[\]|]*)\]\]"), F.lit(1))).alias("user_name")).groupBy("doc_id", "user_name").agg(F.count("*").alias("posts"))


@query(r"""SELECT doc_id, ref, count(*) AS uses FROM (SELECT doc_id, trim(unnest(regexp_extract_all(text, '(?is)<ref[^>/]*>(.*?)</ref>', 1))) AS ref FROM documents) GROUP BY ALL""")
def references_of_pages(s, d):
    return _docs(s, d).select("doc_id", F.explode(F.transform(F.regexp_extract_all("text", F.lit(r"(?is)<ref[^>/]*>(.*?)</ref>"), F.lit(1)), lambda x: F.trim(x))).alias("ref")).groupBy("doc_id", "ref").agg(F.count("*").alias("uses"))


@query(r"""SELECT host, count(*) AS urls, count(DISTINCT url) AS different FROM (SELECT url, regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) AS host FROM csv_ingestion WHERE url IS NOT NULL) GROUP BY host""")
def linksearch_hosts(s, d):
    u = table(s, d, "csv_ingestion").filter("url IS NOT NULL").select("url", F.regexp_extract("url", r"^[a-z]+://([^/:?#]*)", 1).alias("host"))
    return u.groupBy("host").agg(F.count("*").alias("urls"), F.countDistinct("url").alias("different"))


@query(r"""SELECT doc_id, md5(regexp_replace(text, '(?is)<!--.*?-->|<nowiki>.*?</nowiki>|<pre>.*?</pre>|<source\b[^>]*>.*?</source>|<includeonly>.*?</includeonly>', '', 'g')) AS h FROM documents""")
def remove_disabled_parts(s, d):
    return _docs(s, d).select("doc_id", F.md5(wikitext.without_disabled_parts(F.col("text"))).alias("h"))


@query(r"""SELECT doc_id, md5(regexp_replace(text, '(?i)\[\[\s*Category\s*:[^\[\]\n]*\]\][ \t]*\n?', '', 'g')) AS h FROM documents""")
def remove_category_links(s, d):
    return _docs(s, d).select("doc_id", F.md5(wikitext.without_categories(F.col("text"))).alias("h"))


@query(r"""SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&apos;', ''''), '&quot;', '"'), '&amp;', '&')) AS h FROM documents""")
def html_unescape(s, d):
    return _docs(s, d).select("doc_id", F.md5(wikitext.unescape(F.col("text"))).alias("h"))


@query(r"""SELECT doc_id, md5(regexp_replace(text, '(?i)<br[ /]*>', '<br />', 'g')) AS br, md5(regexp_replace(text, '(?m)^(={1,6})[ \t]*([^=\n].*?)[ \t]*(={1,6})[ \t]*$', '\1 \2 \3', 'g')) AS heads, md5(regexp_replace(text, '(?m)^([*#:]+)([^\s*#:;''|{}\[\]=<>-])', '\1 \2', 'g')) AS lists FROM documents""")
def cosmetic_steps(s, d):
    t = F.col("text")
    return _docs(s, d).select("doc_id", F.md5(wikitext.valid_breaks(t)).alias("br"), F.md5(wikitext.spaced_headings(t)).alias("heads"), F.md5(wikitext.spaces_in_lists(t)).alias("lists"))


@query()
def cosmetic_changes(s, d):
    t = _docs(s, d).select("doc_id", "text", cleaning.cleaned(F.col("text")).alias("new"))
    return t.filter("text <> new").select("doc_id", F.md5("new").alias("h"))


@query()
def replace_except(s, d):
    """Years outside references, links and templates, in brackets."""
    f = wikitext.rewrite_udf(lambda t: wikitext.replace_except(t, r"\b(1[89]\d\d)\b", r"<\1>", ["ref", "template", "link", "comment", "nowiki"]))
    return _docs(s, d).select("doc_id", F.md5(f("text")).alias("h"))


@query()
def plain_texts(s, d):
    return _docs(s, d).select("doc_id", F.md5(wikitext.rewrite_udf(wikitext.plain_text)("text")).alias("h"))


@query("""SELECT sha1(text) AS sha1, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def duplicate_files(s, d):
    return pages.duplicates(_docs(s, d), F.col("text"), "doc_id")


@query("""WITH h AS (SELECT title, md5(text) AS h, saved_at, doc_id FROM documents WHERE title IS NOT NULL), p AS (SELECT *, lag(h) OVER (PARTITION BY title ORDER BY saved_at NULLS FIRST, doc_id) AS before FROM h)
 SELECT title, count(*) AS saved, count(*) FILTER (before IS NOT NULL AND before <> h) AS changed FROM p GROUP BY title""")
def section_changed(s, d):
    h = _docs(s, d).filter("title IS NOT NULL").select("title", "saved_at", "doc_id", F.md5("text").alias("h"))
    p = history.previous_value(h, "title", "saved_at", "doc_id", "h", "before")
    return p.groupBy("title").agg(F.count("*").alias("saved"), F.count_if(F.col("before").isNotNull() & (F.col("before") != F.col("h"))).alias("changed"))


@query("""SELECT title, max_by(doc_id, (saved_at, doc_id)) AS doc_id, count(*) AS versions FROM documents WHERE title IS NOT NULL GROUP BY title""")
def latest_per_title(s, d):
    g = _docs(s, d).filter("title IS NOT NULL").groupBy("title").agg(F.max(F.struct("saved_at", "doc_id")).alias("m"), F.count("*").alias("versions"))
    return g.select("title", "m.doc_id", "versions")


# ---- titles -----------------------------------------------------------------------------------

_NS_SQL = "CASE lower(replace(regexp_extract(title, '^([^:]*):', 1), '_', ' ')) " + " ".join(f"WHEN '{n}' THEN {k}" for n, k in titles.DEFAULT_RULES.names.items()) + " ELSE 0 END"


@query(f"""WITH t AS (SELECT page_id, title, {_NS_SQL} AS n FROM pagelist) SELECT page_id, CAST(n AS INT) AS namespace, CASE WHEN n <> 0 THEN regexp_replace(title, '^[^:]*:\\s*', '') ELSE title END AS bare,
 CAST(CASE WHEN n >= 0 THEN xor(n, 1) END AS INT) AS other_side, regexp_replace(title, '[:*?/\\\\]', '_', 'g') AS file_name FROM t""")
def title_algebra(s, d):
    t = F.col("title")
    n = titles.namespace(t)
    return table(s, d, "pagelist").select("page_id", n.alias("namespace"), titles.without_namespace(t).alias("bare"), titles.talk_namespace(n).alias("other_side"), titles.for_filename(t).alias("file_name"))


@query()
def normal_titles(s, d):
    return table(s, d, "revertbot").filter("title IS NOT NULL").select("title").distinct().select("title", titles.title_udf()("title").alias("normal"))


# ---- blocks -----------------------------------------------------------------------------------

_INSTANT = "CASE WHEN regexp_matches({0}, '^\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\dZ$') THEN try_cast({0} AS TIMESTAMPTZ) END"


@query("""SELECT kind, count(*) AS blocks, count(*) FILTER (lower(expiry) IN ('infinity', 'infinite', 'indefinite', 'never')) AS endless, count(*) FILTER (regexp_matches(trim(expiry), '^\\d')) AS finite FROM
 (SELECT expiry, CASE WHEN user_name IS NULL THEN 'auto' WHEN rangestart IS NOT NULL AND rangestart <> rangeend THEN 'range' WHEN userid = '0' THEN 'anon' ELSE 'user' END AS kind FROM apispec) GROUP BY kind""")
def block_lists(s, d):
    """finite holds what begins with a digit, as in the SQL; block_lists_all_forms has the rest."""
    a = table(s, d, "apispec")
    return a.withColumn("kind", blocks.kind(a)).groupBy("kind").agg(F.count("*").alias("blocks"), F.count_if(F.lower("expiry").isin(*blocks.ENDLESS)).alias("endless"), F.count_if(F.trim("expiry").rlike(r"^\d")).alias("finite"))


@query(f"""SELECT delivery_no, CAST(floor((epoch({_INSTANT.format('expiry')}) - epoch({_INSTANT.format('"timestamp"')})) / 86400) AS BIGINT) AS days FROM apispec WHERE {_INSTANT.format('expiry')} IS NOT NULL AND {_INSTANT.format('"timestamp"')} IS NOT NULL""")
def block_durations(s, d):
    """Only records whose times are written in the canonical form, as in the SQL; block_durations_all_forms has the rest."""
    return blocks.durations(table(s, d, "apispec"), blocks.instant(F.col("timestamp")), blocks.instant(F.col("expiry"))).select("delivery_no", "days")


@query(f"""SELECT by_name, count(*) AS blocks FROM apispec WHERE {_INSTANT.format('"timestamp"')} BETWEEN TIMESTAMPTZ '2009-01-01 00:00:00+00' AND TIMESTAMPTZ '2010-01-01 00:00:00+00' GROUP BY by_name""")
def blocks_between(s, d):
    """Only records whose time is written in the canonical form, as in the SQL; blocks_between_all_forms has the rest."""
    return blocks.between(table(s, d, "apispec"), blocks.instant(F.col("timestamp")), "2009-01-01", "2010-01-01").groupBy("by_name").agg(F.count("*").alias("blocks"))


def _timed_blocks(s, d, **columns):
    """Block records with the instants of text columns, in whatever form these are written."""
    a = table(s, d, "apispec")
    for out, column in columns.items():
        a = blocks.with_instant(a, column, table(s, d, "wiki_site"), out)
    return a


@query()
def block_lists_all_forms(s, d):
    a = _timed_blocks(s, d, ends="expiry")
    end = F.trim("expiry").rlike(r"^\d") | F.col("ends").isNotNull()
    return a.withColumn("kind", blocks.kind(a)).groupBy("kind").agg(F.count("*").alias("blocks"), F.count_if(F.lower("expiry").isin(*blocks.ENDLESS)).alias("endless"), F.count_if(end).alias("finite"))


@query()
def block_durations_all_forms(s, d):
    return blocks.durations(_timed_blocks(s, d, begins="timestamp", ends="expiry"), F.col("begins"), F.col("ends")).select("delivery_no", "days")


@query()
def blocks_between_all_forms(s, d):
    return blocks.between(_timed_blocks(s, d, at="timestamp"), F.col("at"), "2009-01-01", "2010-01-01").groupBy("by_name").agg(F.count("*").alias("blocks"))


@query("""SELECT flag, count(*) AS blocks FROM (SELECT unnest(flags) AS flag FROM apispec) GROUP BY flag""")
def block_flags(s, d):
    return table(s, d, "apispec").select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("blocks"))


_NUM = "(CAST(split_part({0}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({0}, '.', 2) AS BIGINT) * 65536 + CAST(split_part({0}, '.', 3) AS BIGINT) * 256 + CAST(split_part({0}, '.', 4) AS BIGINT))"


@query(rf"""WITH r AS MATERIALIZED (SELECT delivery_no, {_NUM.format('rangestart')} AS lo, {_NUM.format('rangeend')} AS hi FROM (SELECT * FROM apispec WHERE regexp_matches(rangestart, '^\d{{1,3}}(\.\d{{1,3}}){{3}}$') AND regexp_matches(rangeend, '^\d{{1,3}}(\.\d{{1,3}}){{3}}$') AND rangestart <> rangeend)),
 a AS MATERIALIZED (SELECT DISTINCT user_name AS ip, {_NUM.format('user_name')} AS n FROM (SELECT user_name FROM apispec WHERE regexp_matches(user_name, '^\d{{1,3}}(\.\d{{1,3}}){{3}}$')))
 SELECT ip, delivery_no FROM a JOIN r ON n BETWEEN lo AND hi""")
def blocks_covering_ip(s, d):
    a = table(s, d, "apispec")
    return blocks.covering(a.filter("rangestart <> rangeend"), a.select(F.col("user_name").alias("ip")))


# ---- scalars ----------------------------------------------------------------------------------

_K = "(100000000 + p_partkey * 7919) % 1000000000"
_SUM10 = " + ".join(f"CAST(substr(b, {i}, 1) AS INT) * {i}" for i in range(1, 10))
_SUM13 = " + ".join(f"CAST(substr('978' || b, {i}, 1) AS INT) * {3 if i % 2 == 0 else 1}" for i in range(1, 13))


@query(f"""WITH k AS (SELECT p_partkey, lpad(CAST({_K} AS VARCHAR), 9, '0') AS b FROM part), c AS (SELECT *, ({_SUM10}) % 11 AS c10, (10 - ({_SUM13}) % 10) % 10 AS c13 FROM k),
 i AS (SELECT *, b || CASE WHEN p_partkey % 3 = 0 THEN '5' WHEN c10 = 10 THEN 'X' ELSE CAST(c10 AS VARCHAR) END AS isbn FROM c)
 SELECT p_partkey, isbn, CAST(CASE WHEN substr(isbn, 10, 1) = 'X' THEN 10 ELSE CAST(substr(isbn, 10, 1) AS INT) END = c10 AS BOOLEAN) AS valid, CASE WHEN (CASE WHEN substr(isbn, 10, 1) = 'X' THEN 10 ELSE CAST(substr(isbn, 10, 1) AS INT) END) = c10 THEN '978' || b || CAST(c13 AS VARCHAR) END AS isbn13 FROM i""")
def isbn_check(s, d):
    b = F.lpad(((100000000 + F.col("p_partkey") * 7919) % 1000000000).cast("string"), 9, "0")
    check = scalars._weighted(F.col("b"), list(range(1, 10))) % 11
    t = table(s, d, "part").select("p_partkey", b.alias("b"))
    t = t.select("p_partkey", F.concat("b", F.when(F.col("p_partkey") % 3 == 0, "5").when(check == 10, "X").otherwise(check.cast("string"))).alias("isbn"))
    return t.select("p_partkey", "isbn", scalars.isbn10_valid(F.col("isbn")).alias("valid"), scalars.isbn10_to_13(F.col("isbn")).alias("isbn13"))


@query("""SELECT DISTINCT year(o_orderdate) AS year, CAST(floor(year(o_orderdate) / 10) * 10 AS INT) AS decade, CAST(floor((year(o_orderdate) - 1) / 100) + 1 AS INT) AS century, CASE WHEN year(o_orderdate) <= 2000 THEN 'XX' ELSE 'XXI' END AS roman FROM orders""")
def decade_century(s, d):
    y = table(s, d, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return y.select(F.col("year").cast("bigint").alias("year"), scalars.decade(F.col("year")).alias("decade"), scalars.century(F.col("year")).alias("century"), scalars.roman(scalars.century(F.col("year"))).alias("roman"))


@query("""WITH w AS (SELECT DISTINCT lower(word) AS word FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part)), p AS (SELECT a.word, b.word AS candidate, levenshtein(a.word, b.word) AS distance FROM w a, w b),
 r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, candidate) AS rank FROM p WHERE distance < 11) SELECT word, candidate, CAST(distance AS INT) AS distance, rank FROM r WHERE rank <= 30""")
def spell_suggest(s, d):
    w = table(s, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()
    return scalars.nearest_words(w, w)


@query("""WITH a AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 2 = 0), b AS (SELECT vec_id - 1 AS vec_id, embedding FROM embeddings WHERE vec_id % 2 = 1),
 x AS (SELECT a.vec_id, unnest([abs(v) FOR v IN a.embedding])::DOUBLE AS p, unnest([abs(v) FOR v IN b.embedding])::DOUBLE AS q FROM a JOIN b USING (vec_id)) SELECT vec_id, round(100 * sum(least(p, q)) / sum(greatest(p, q)), 4) AS match FROM x GROUP BY vec_id""")
def histogram_match(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.transform("embedding", F.abs).alias("h"))
    return pages.matching_histograms(e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 = 1").withColumn("vec_id", F.col("vec_id") - 1), "h", "vec_id")


@query(r"""SELECT user_name, regexp_matches(user_name, '^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)$') OR regexp_matches(user_name, '(?i)^[0-9a-f:]+:[0-9a-f:]+$') AS is_ip FROM (SELECT DISTINCT user_name FROM apispec WHERE user_name IS NOT NULL AND NOT contains(user_name, '/'))""")
def anonymous_users(s, d):
    u = table(s, d, "apispec").select("user_name").filter("user_name IS NOT NULL AND NOT contains(user_name, '/')").distinct()
    return u.select("user_name", scalars.is_ip(F.col("user_name")).alias("is_ip"))


# ---- ingestion --------------------------------------------------------------------------------


@query(r"""WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY rec_no) AS n FROM csv_ingestion WHERE url IS NOT NULL) WHERE n = 1)
 SELECT rec_no, url, regexp_extract(url, '([^/]*)$', 1) AS file_name, lower(regexp_extract(url, '\.([^./]*)$', 1)) AS ext, coalesce(name, '') || ' - ' || coalesce("set", '') || '.' || lower(regexp_extract(url, '\.([^./]*)$', 1)) AS title FROM c""")
def photo_records(s, d):
    """Each picture once, with its file name, extension and page title."""
    c = table(s, d, "csv_ingestion").filter("url IS NOT NULL")
    first = c.groupBy("url").agg(F.min(F.struct("rec_no", "name", F.col("set").alias("set_name"))).alias("r"))
    ext = F.lower(F.regexp_extract("url", r"\.([^./]*)$", 1))
    return first.select("r.rec_no", "url", F.regexp_extract("url", r"([^/]*)$", 1).alias("file_name"), ext.alias("ext"), F.concat(F.coalesce("r.name", F.lit("")), F.lit(" - "), F.coalesce("r.set_name", F.lit("")), F.lit("."), ext).alias("title"))


@query("""SELECT author, count(*) AS pictures FROM (SELECT trim(unnest(string_split(author, '|'))) AS author FROM csv_ingestion) WHERE author <> '' GROUP BY author""")
def authors(s, d):
    return table(s, d, "csv_ingestion").select(F.explode(F.transform(F.split("author", r"\|"), lambda x: F.trim(x))).alias("author")).filter("author <> ''").groupBy("author").agg(F.count("*").alias("pictures"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY id, hist_no) AS n FROM catimages) SELECT file_name, count(*) AS entries, max(CASE WHEN n = 1 THEN software END) AS first_software, count(DISTINCT action) AS actions FROM r GROUP BY file_name""")
def file_histories(s, d):
    g = table(s, d, "catimages").groupBy("file_name").agg(F.count("*").alias("entries"), F.min(F.struct("id", "hist_no", "software")).alias("m"), F.countDistinct("action").alias("actions"))
    return g.select("file_name", "entries", F.col("m.software").alias("first_software"), "actions")


# ---- watching ---------------------------------------------------------------------------------


@query(r"""SELECT title, unnest(regexp_extract_all(title, '[A-Za-z\x{0400}-\x{04FF}]*(?:[A-Za-z][\x{0400}-\x{04FF}]|[\x{0400}-\x{04FF}][A-Za-z])[A-Za-z\x{0400}-\x{04FF}]*')) AS word FROM (SELECT DISTINCT title FROM revertbot WHERE title IS NOT NULL)""")
def mixed_script_words(s, d):
    t = table(s, d, "revertbot").select("title").filter("title IS NOT NULL").distinct()
    return t.select("title", F.explode(watching.mixed_script_words(F.col("title"))).alias("word"))


_WHITE = "w AS (SELECT DISTINCT user_name, CASE WHEN length(user_name) % 3 = 0 THEN '' ELSE 'Talk:' END AS prefix FROM revertbot WHERE user_name LIKE '%Badger%')"


@query(f"WITH {_WHITE}, {_REVS} SELECT revid FROM rev WHERE EXISTS (SELECT 1 FROM w WHERE w.user_name = rev.user_name AND starts_with(rev.title, w.prefix))")
def whitelisted_edits(s, d):
    u = table(s, d, "revertbot").filter("user_name LIKE '%Badger%'").select("user_name", F.when(F.length("user_name") % 3 == 0, "").otherwise("Talk:").alias("prefix")).distinct()
    return watching.whitelisted(_revs(s, d, "user_name", "title"), u).select("revid")


_RULES = [("copyright", "contains", "copyright"), ("vandal", "matches", "(?i)^vandal"), ("proxy", "equals", "Open proxy"), ("link", "matches", r"\[\[")]


@query("""SELECT rule, count(*) AS blocks FROM (SELECT CASE WHEN contains(lower(reason), 'copyright') THEN 'copyright' WHEN regexp_matches(reason, '(?i)^vandal') THEN 'vandal' WHEN trim(reason) = 'Open proxy' THEN 'proxy' WHEN contains(reason, '[[') THEN 'link' END AS rule FROM apispec) GROUP BY rule""")
def block_reason_rules(s, d):
    return table(s, d, "apispec").select(watching.first_rule(F.col("reason"), _RULES).alias("rule")).groupBy("rule").agg(F.count("*").alias("blocks"))


_AT = "TIMESTAMPTZ '2010-06-30 00:00:00+00'"


@query(f"""WITH {_REVS}, n AS (SELECT pageid, arg_max(revid, ("timestamp", revid)) AS r FROM rev WHERE pageid IS NOT NULL AND "timestamp" IS NOT NULL GROUP BY pageid), b AS (SELECT pageid, arg_max(revid, ("timestamp", revid)) AS r FROM rev WHERE pageid IS NOT NULL AND "timestamp" <= {_AT} GROUP BY pageid)
 SELECT coalesce(n.pageid, b.pageid) AS pageid, CASE WHEN b.pageid IS NULL THEN 'new' WHEN n.pageid IS NULL THEN 'closed' WHEN n.r = b.r THEN 'unchanged' ELSE 'changed' END AS status FROM n FULL JOIN b ON n.pageid = b.pageid""")
def page_news(s, d):
    log = _revs(s, d, "pageid", "timestamp").filter("pageid IS NOT NULL AND timestamp IS NOT NULL").select("pageid", "timestamp", "revid")
    before = watching.state_as_of(log, "pageid", "timestamp", F.lit("2010-06-30").cast("timestamp"), "revid")
    return watching.news(history.latest_per_key(log, "pageid", "timestamp", "revid"), before, "pageid", "revid")


@query(f"""WITH {_REVS}, g AS (SELECT user_name, "timestamp" AS t, CASE WHEN epoch_us("timestamp") - epoch_us(lag("timestamp") OVER (PARTITION BY user_name ORDER BY "timestamp")) < 86400000000 THEN 0 ELSE 1 END AS b FROM rev WHERE user_name IS NOT NULL AND "timestamp" IS NOT NULL),
 n AS (SELECT *, sum(b) OVER (PARTITION BY user_name ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_name, {TS.format('min(t)')} AS begin, {TS.format('max(t)')} AS "end", count(*) AS edits FROM n GROUP BY user_name, k""")
def edit_sessions(s, d):
    return watching.sessions(_revs(s, d, "user_name", "timestamp").select("user_name", "timestamp"), "user_name", "timestamp", 86400).withColumns({c: _text(c) for c in ("begin", "end")})


@query(r"""SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1""")
def json_values(s, d):
    return table(s, d, "events").select(F.get_json_object("props", "$.k").cast("bigint").alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query()
def json_trees(s, d):
    """Text leaves of the archive's raw responses, by joined name."""
    raw = table(s, d, "anefo").filter("raw IS NOT NULL").select(F.explode(dumps.json_flat("raw")).alias("name", "value"))
    return raw.groupBy("name").agg(F.count("*").alias("n"))


@query()
def transliterated_titles(s, d):
    f = wikitext.rewrite_udf(language.transliterated)
    return table(s, d, "pagelist").select("page_id", f("title").alias("latin"))


@query()
def fixed_texts(s, d):
    """Texts changed by the fix sets that need no supervision."""
    steps = tuple(x for name, fix in cleaning.FIX_SETS.items() if name not in cleaning.SUPERVISED for x in fix)
    return _docs(s, d).select("doc_id", "text", cleaning.cleaned(F.col("text"), steps).alias("new")).filter("text <> new").select("doc_id", F.md5("new").alias("h"))


@query(r"""SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)</ref>') AND NOT regexp_matches(text, '(?i)<references\s*/?>|\{\{\s*(?:Reflist|References)\s*[|}]')""")
def pages_lacking_references(s, d):
    return _docs(s, d).filter(rewriting.references_lacking(F.col("text"))).select("doc_id")


@query(f"""WITH {PAGE}, {CATEGORY}, u AS (SELECT page_id, ns, title, min(source) AS source FROM (SELECT page_id, ns, title, 0 AS source FROM page WHERE ns <> 14 AND page_id IN (SELECT member FROM catlink WHERE category = (SELECT page_id FROM page WHERE title = 'Category:ASIA'))
 UNION ALL SELECT page_id, ns, title, 1 FROM page WHERE ns = 0 AND is_redirect) GROUP BY ALL), l AS (SELECT * FROM u ORDER BY source, title, page_id LIMIT 40) SELECT page_id, title FROM l WHERE ns = 0""")
def page_generator(s, d):
    r = Relations(page(s, d), link(s, d), catlink(s, d))
    return page_query(r, "-cat:ASIA", "-redirectonly:", "-limit:40", "-ns:0").select("page_id", "title")
