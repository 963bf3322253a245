"""Queries about records of pages, users, files, log entries, items, categories and language links,
over the star schema, contributions, blocks and documents, each with the same question in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pageloom.functions import titles
from pageloom.operators import graph, history, pages, records, watching
from pageloom.plans.wiki import _REVS, CATEGORY, LINK, PAGE, REDIRECT, TS, _revs, _text, catlink, link, page, redirect
from pageloom.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


_BOTS = "bots AS (SELECT DISTINCT user_name FROM revertbot WHERE lower(user_name) LIKE '%bot')"


def _bots(s, d):
    return table(s, d, "revertbot").filter("lower(user_name) LIKE '%bot'").select("user_name").distinct()


# ---- feeds ------------------------------------------------------------------------------------


@query(f"""WITH {_REVS}, {_BOTS}, n AS (SELECT pageid, min("timestamp") AS t, arg_min(revid, ("timestamp", revid)) AS revid, arg_min(user_name, ("timestamp", revid)) AS user_name FROM rev WHERE pageid <> 0 AND "timestamp" IS NOT NULL AND ns = 0 GROUP BY pageid),
 h AS (SELECT * FROM n WHERE user_name IS NULL OR user_name NOT IN (SELECT user_name FROM bots)) SELECT pageid, revid, {TS.format('t')} AS created, CAST(row_number() OVER (ORDER BY t DESC, pageid) AS INT) AS rank FROM h ORDER BY rank LIMIT 50""")
def new_pages(s, d):
    """The newest pages that no robot made."""
    r = _revs(s, d, "pageid", "timestamp", "user_name", "ns").filter("pageid <> 0 AND timestamp IS NOT NULL AND ns = 0")
    n = records.first_versions(r, "pageid", "timestamp", "revid", "user_name").join(_bots(s, d), "user_name", "left_anti")
    return pages.top(n, 50, F.desc("timestamp"), F.col("pageid")).select("pageid", "revid", _text("timestamp").alias("created"), F.col("rank").cast("int").alias("rank"))


@query("""WITH f AS (SELECT event_id, user_id, event_type, ts FROM events WHERE event_type IN ('signup', 'error') AND ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00' AND user_id NOT IN (SELECT DISTINCT user_id FROM events WHERE user_id % 10 = 0))
 SELECT event_id, user_id, event_type FROM f""")
def change_feed(s, d):
    """Changes of two kinds in two days that no robot made."""
    e = table(s, d, "events")
    return records.changes(e, "ts", "2024-01-10", "2024-01-12", ["signup", "error"], "event_type", e.filter("user_id % 10 = 0").select("user_id"), "user_id").select("event_id", "user_id", "event_type")


@query("""SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE user_id <> 8 GROUP BY ALL""")
def changes_of_others(s, d):
    """Changes by day that somebody else made."""
    own = s.createDataFrame([(8,)], "user_id bigint")
    e = records.changes(table(s, d, "events"), user="user_id", without_users=own)
    return e.groupBy("event_type", F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("""WITH u AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events WHERE event_type = 'purchase') SELECT user_id, event_id, rank FROM u WHERE rank <= 3""")
def uploads_of_users(s, d):
    """The last uploads of each user."""
    e = records.changes(table(s, d, "events"), kinds=["purchase"], kind="event_type").select("user_id", "event_id", "ts")
    return pages.first_per_key(e, ["user_id"], 3, F.desc("ts"), F.desc("event_id")).drop("ts")


@query("""SELECT event_id, CAST(row_number() OVER (ORDER BY ts DESC, event_id DESC) AS INT) AS rank FROM events WHERE event_type = 'purchase' AND ts < TIMESTAMP '2024-01-20 00:00:00' ORDER BY rank LIMIT 30""")
def new_images(s, d):
    e = records.changes(table(s, d, "events"), until="2024-01-20", kinds=["purchase"], kind="event_type")
    return pages.top(e, 30, F.desc("ts"), F.desc("event_id")).select("event_id", F.col("rank").cast("int").alias("rank"))


@query("""SELECT event_id FROM events WHERE event_type = 'purchase' AND date_trunc('day', ts) = TIMESTAMP '2024-01-14 00:00:00'""")
def uploaded_yesterday(s, d):
    """Uploads of the day before a given one, by the calendar."""
    return watching.on_day_before(table(s, d, "events").filter("event_type = 'purchase'"), "ts", "2024-01-15").select("event_id")


_MOVES = "moves AS (SELECT CAST(event_id % 97 AS BIGINT) AS old_page, CAST(1000 + event_id % 89 AS BIGINT) AS new_page, ts, event_id FROM events WHERE event_type = 'click')"


def _moves(s, d):
    e = table(s, d, "events").filter("event_type = 'click'")
    return e.select((F.col("event_id") % 97).cast("bigint").alias("old_page"), (1000 + F.col("event_id") % 89).cast("bigint").alias("new_page"), "ts", "event_id")


@query(f"WITH {_MOVES} SELECT old_page, arg_max(new_page, (ts, event_id)) AS new_page, count(*) AS moves FROM moves GROUP BY old_page")
def moved_targets(s, d):
    """Where each page was moved to last."""
    m = _moves(s, d)
    return records.latest_by(m, "old_page", ["ts", "event_id"], "new_page").join(m.groupBy("old_page").agg(F.count("*").alias("moves")), "old_page")


@query(f"""WITH {_MOVES}, {REDIRECT}, m AS (SELECT old_page, new_page FROM moves WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-15 00:00:00') SELECT DISTINCT r.page_id, m.new_page FROM redirect r JOIN m ON r.target_id = m.old_page""")
def redirects_to_moved_pages(s, d):
    """Redirects to a title that was moved in a time, with the new titles."""
    m = records.changes(_moves(s, d), since="2024-01-05", until="2024-01-15").select(F.col("old_page").alias("target_id"), "new_page").distinct()
    return redirect(s, d).join(m, "target_id").select("page_id", "new_page").distinct()


# ---- revisions and users ----------------------------------------------------------------------


@query(f"""WITH {_REVS}, {_BOTS}, h AS (SELECT * FROM rev WHERE pageid <> 0 AND user_name IS NOT NULL AND user_name NOT IN (SELECT user_name FROM bots)) SELECT pageid, arg_max(user_name, (coalesce(epoch_us("timestamp"), -9e18), revid)) AS human FROM h GROUP BY pageid""")
def last_human_editors(s, d):
    """The newest editor of each page that is no robot."""
    r = _revs(s, d, "pageid", "user_name", "timestamp").filter("pageid <> 0 AND user_name IS NOT NULL").join(_bots(s, d), "user_name", "left_anti")
    return records.latest_by(r, "pageid", ["timestamp", "revid"], "user_name").withColumnRenamed("user_name", "human")


@query(f"""WITH {_REVS} SELECT pageid, arg_max(coalesce(comment, '(none)'), (coalesce(epoch_us("timestamp"), -9e18), revid)) AS comment FROM rev WHERE pageid <> 0 GROUP BY pageid""")
def last_comments(s, d):
    r = _revs(s, d, "pageid", "comment", "timestamp").filter("pageid <> 0").withColumn("comment", F.coalesce("comment", F.lit("(none)")))
    return records.latest_by(r, "pageid", ["timestamp", "revid"], "comment")


@query(f"""WITH {_REVS}, n AS (SELECT pageid, revid, row_number() OVER (PARTITION BY pageid ORDER BY "timestamp" DESC NULLS LAST, revid DESC) AS k FROM rev WHERE pageid <> 0), w AS (SELECT revid FROM n WHERE k = 2) SELECT revid, pageid, title, sizediff FROM rev WHERE revid IN (SELECT revid FROM w)""")
def old_versions(s, d):
    """Revisions asked for by their numbers: here those before the last of each page."""
    asked = pages.first_per_key(_revs(s, d, "pageid", "timestamp").filter("pageid <> 0").select("pageid", "revid", "timestamp"), ["pageid"], 2, F.desc_nulls_last("timestamp"), F.desc("revid")).filter("rank = 2").select("revid")
    return _revs(s, d, "pageid", "title", "sizediff").join(asked, "revid", "left_semi").select("revid", "pageid", "title", "sizediff")


@query(f"""WITH {_REVS}, n AS (SELECT pageid, user_name, row_number() OVER (PARTITION BY pageid ORDER BY "timestamp" DESC NULLS LAST, revid DESC) AS k FROM rev WHERE pageid <> 0) SELECT DISTINCT pageid FROM n WHERE k <= 100 AND user_name LIKE 'Salt%'""")
def pages_edited_by(s, d):
    """Pages with one of some users among their last hundred editors."""
    r = _revs(s, d, "pageid", "user_name", "timestamp").filter("pageid <> 0")
    return records.edited_by(r, r.filter("user_name LIKE 'Salt%'"), 100, "pageid", "user_name", "timestamp", "revid")


@query(f"""WITH {_REVS} SELECT DISTINCT pageid FROM rev WHERE pageid <> 0 AND pageid NOT IN (SELECT pageid FROM (SELECT pageid, user_name, row_number() OVER (PARTITION BY pageid ORDER BY "timestamp" DESC NULLS LAST, revid DESC) AS k FROM rev WHERE pageid <> 0) WHERE k <= 100 AND user_name LIKE 'S%')""")
def pages_not_edited_by(s, d):
    r = _revs(s, d, "pageid", "user_name", "timestamp").filter("pageid <> 0")
    return records.edited_by(r, r.filter("user_name LIKE 'S%'"), 100, "pageid", "user_name", "timestamp", "revid", skip=True)


@query(f"""WITH {_REVS}, r AS (SELECT pageid, revid, '|-' || chr(10) || '| ' || {TS.format('"timestamp"')} || ' || ' || coalesce(user_name, '') || ' || ' || coalesce(comment, '') AS row FROM rev WHERE pageid <> 0 AND "timestamp" IS NOT NULL) SELECT pageid, revid, row FROM r""")
def history_table_rows(s, d):
    """Rows of the wikitables of page histories."""
    from pageloom.sources.sinks import table_row

    r = _revs(s, d, "pageid", "user_name", "comment", "timestamp").filter("pageid <> 0 AND timestamp IS NOT NULL")
    return r.select("pageid", "revid", table_row(_text("timestamp"), F.coalesce("user_name", F.lit("")), F.coalesce("comment", F.lit(""))).alias("row"))


@query(f"""WITH {_REVS}, e AS (SELECT user_name, count(*) AS edits, min("timestamp") AS first_edit FROM rev WHERE user_name IS NOT NULL GROUP BY user_name), b AS (SELECT user_name, count(*) AS blocks, bool_or(lower(expiry) IN ('infinity', 'infinite', 'indefinite', 'never')) AS endless, bool_and(userid = '0') AS anonymous FROM apispec WHERE user_name IS NOT NULL GROUP BY user_name)
 SELECT coalesce(e.user_name, b.user_name) AS user_name, coalesce(edits, 0) AS edits, coalesce(blocks, 0) AS blocks, coalesce(endless, FALSE) AS endless, {TS.format('first_edit')} AS first_edit, edits IS NOT NULL OR NOT coalesce(anonymous, FALSE) AS registered FROM e FULL JOIN b ON e.user_name = b.user_name""")
def user_records(s, d):
    """Each user's edits, blocks, first edit and whether it is registered."""
    e = _revs(s, d, "user_name", "timestamp").filter("user_name IS NOT NULL").groupBy("user_name").agg(F.count("*").alias("edits"), F.min("timestamp").alias("first_edit"))
    b = table(s, d, "apispec").filter("user_name IS NOT NULL").groupBy("user_name").agg(F.count("*").alias("blocks"), F.bool_or(F.lower("expiry").isin("infinity", "infinite", "indefinite", "never")).alias("endless"), F.bool_and(F.col("userid") == "0").alias("anonymous"))
    j = e.join(b, "user_name", "full")
    none = F.lit(0).cast("bigint")
    return j.select("user_name", F.coalesce("edits", none).alias("edits"), F.coalesce("blocks", none).alias("blocks"), F.coalesce("endless", F.lit(False)).alias("endless"), _text("first_edit").alias("first_edit"), (F.col("edits").isNotNull() | ~F.coalesce("anonymous", F.lit(False))).alias("registered"))


@query("""SELECT user_name, CASE WHEN contains(user_name, ' ') THEN regexp_extract(user_name, '(\\S+)$', 1) || ', ' || regexp_extract(user_name, '^(.*) \\S+$', 1) ELSE user_name END AS sort_key FROM (SELECT DISTINCT user_name FROM revertbot WHERE user_name IS NOT NULL)""")
def names_by_last_name(s, d):
    u = table(s, d, "revertbot").select("user_name").filter("user_name IS NOT NULL").distinct()
    return u.select("user_name", titles.last_name_first(F.col("user_name")).alias("sort_key"))


# ---- blocks -----------------------------------------------------------------------------------


@query("""WITH b AS (SELECT DISTINCT user_name FROM apispec WHERE user_name IS NOT NULL AND userid <> '0' AND (rangestart IS NULL OR rangestart = rangeend)) SELECT user_name, row_number() OVER (ORDER BY user_name) AS n FROM b""")
def blocked_user_names(s, d):
    """Names of blocked users in order, numbered."""
    b = table(s, d, "apispec").filter("user_name IS NOT NULL AND userid <> '0' AND (rangestart IS NULL OR rangestart = rangeend)").select("user_name").distinct()
    return records.numbered(b, F.col("user_name"))


@query("""WITH b AS (SELECT user_name, min(received_at) AS t FROM apispec WHERE user_name IS NOT NULL AND userid <> '0' GROUP BY user_name) SELECT user_name, row_number() OVER (ORDER BY t, user_name) AS n FROM b""")
def blocked_users_by_time(s, d):
    b = table(s, d, "apispec").filter("user_name IS NOT NULL AND userid <> '0'").groupBy("user_name").agg(F.min("received_at").alias("t"))
    return records.numbered(b, F.col("t"), F.col("user_name")).select("user_name", "n")


@query("""SELECT delivery_no, contains(user_name, 'Kettle') AS fragment, regexp_matches(user_name, '^(Tin|Paper) ') AS pattern, contains(reason, 'spam') AS reason_fragment, regexp_matches(reason, '(?i)several|open') AS reason_pattern, by_name = 'Paper Compass' AS by_admin FROM apispec WHERE user_name IS NOT NULL AND reason IS NOT NULL AND by_name IS NOT NULL""")
def block_filters(s, d):
    """Blocks by part or pattern of user or reason, and by admin."""
    a = table(s, d, "apispec").filter("user_name IS NOT NULL AND reason IS NOT NULL AND by_name IS NOT NULL")
    return a.select("delivery_no", F.contains("user_name", F.lit("Kettle")).alias("fragment"), F.col("user_name").rlike("^(Tin|Paper) ").alias("pattern"), F.contains("reason", F.lit("spam")).alias("reason_fragment"), F.col("reason").rlike("(?i)several|open").alias("reason_pattern"), (F.col("by_name") == "Paper Compass").alias("by_admin"))


@query(r"""SELECT DISTINCT user_name, array_to_string(list_transform(string_split(user_name, '.'), lambda o: lpad(o, 3, '0')), '.') AS sort_key FROM apispec WHERE regexp_matches(user_name, '^\d{1,3}(\.\d{1,3}){3}$')""")
def blocked_addresses(s, d):
    """Blocked addresses with the key that sorts them as numbers."""
    from pageloom.functions import scalars

    a = table(s, d, "apispec").filter(F.col("user_name").rlike(r"^\d{1,3}(\.\d{1,3}){3}$")).select("user_name").distinct()
    return a.select("user_name", scalars.ip_sort_key(F.col("user_name")).alias("sort_key"))


@query(r"""SELECT DISTINCT rangestart, rangeend, array_to_string(list_transform(string_split(rangestart, '.'), lambda o: lpad(o, 3, '0')), '.') AS sort_key FROM apispec WHERE rangestart <> rangeend AND regexp_matches(rangestart, '^\d{1,3}(\.\d{1,3}){3}$')""")
def blocked_ranges(s, d):
    from pageloom.functions import scalars

    a = table(s, d, "apispec").filter(F.col("rangestart").rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & (F.col("rangestart") != F.col("rangeend")))
    return a.select("rangestart", "rangeend").distinct().withColumn("sort_key", scalars.ip_sort_key(F.col("rangestart")))


# ---- files ------------------------------------------------------------------------------------


@query("""WITH v AS (SELECT title, username, sha1(text) AS sha1, length(text) AS size, saved_at, doc_id FROM documents WHERE title IS NOT NULL AND text IS NOT NULL AND saved_at IS NOT NULL)
 SELECT title, arg_min(coalesce(username, '-'), (saved_at, doc_id)) AS first_uploader, arg_max(coalesce(username, '-'), (saved_at, doc_id)) AS latest_uploader, arg_max(sha1, (saved_at, doc_id)) AS sha1, count(*) AS versions FROM v GROUP BY title""")
def file_versions(s, d):
    """Of each file its first and latest uploader and the hash of its latest version."""
    v = table(s, d, "documents").filter("title IS NOT NULL AND text IS NOT NULL AND saved_at IS NOT NULL").select("title", "saved_at", "doc_id", F.coalesce("username", F.lit("-")).alias("who"), F.sha1("text").alias("sha1"))
    first = F.min(F.struct("saved_at", "doc_id", "who"))
    last = F.max(F.struct("saved_at", "doc_id", "who", "sha1"))
    g = v.groupBy("title").agg(first.alias("f"), last.alias("l"), F.count("*").alias("versions"))
    return g.select("title", F.col("f.who").alias("first_uploader"), F.col("l.who").alias("latest_uploader"), F.col("l.sha1").alias("sha1"), "versions")


@query("""WITH l AS (SELECT doc_id, sha1(text) AS sha1 FROM documents WHERE source = 'caption' AND text IS NOT NULL), r AS (SELECT sha1(text) AS sha1, min(doc_id) AS shared_doc_id FROM documents WHERE source <> 'caption' AND text IS NOT NULL GROUP BY 1) SELECT doc_id, l.sha1, shared_doc_id FROM l JOIN r ON l.sha1 = r.sha1""")
def files_also_shared(s, d):
    """Local files with the same content in the shared collection."""
    f = table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", "source", F.sha1("text").alias("sha1"))
    return records.in_both(f.filter("source = 'caption'").drop("source"), f.filter("source <> 'caption'"), "sha1", "doc_id")


@query("""WITH l AS (SELECT doc_id, title FROM documents WHERE source = 'caption' AND title IS NOT NULL), r AS (SELECT title, min(doc_id) AS shared_doc_id FROM documents WHERE source = 'article' AND title IS NOT NULL GROUP BY 1) SELECT doc_id, l.title, shared_doc_id FROM l JOIN r ON l.title = r.title""")
def names_also_shared(s, d):
    f = table(s, d, "documents").filter("title IS NOT NULL").select("doc_id", "source", "title")
    return records.in_both(f.filter("source = 'caption'").drop("source"), f.filter("source = 'article'"), "title", "doc_id")


@query("""WITH f AS (SELECT sha1(text) AS sha1, title, min(saved_at) AS saved_at FROM documents WHERE text IS NOT NULL AND title IS NOT NULL AND saved_at IS NOT NULL GROUP BY ALL), u AS (SELECT title, count(*) AS uses FROM revertbot WHERE title IS NOT NULL GROUP BY title),
 j AS (SELECT f.*, coalesce(uses, 0) AS uses FROM f LEFT JOIN u ON f.title = u.title), r AS (SELECT *, row_number() OVER (PARTITION BY sha1 ORDER BY uses DESC, saved_at, title) AS k, count(*) OVER (PARTITION BY sha1) AS copies FROM j) SELECT sha1, title AS kept, copies, uses FROM r WHERE k = 1 AND copies > 1""")
def duplicate_to_keep(s, d):
    """Of files of the same content the most used, or the oldest, one."""
    f = table(s, d, "documents").filter("text IS NOT NULL AND title IS NOT NULL AND saved_at IS NOT NULL").groupBy(F.sha1("text").alias("sha1"), "title").agg(F.min("saved_at").alias("saved_at"))
    return records.copy_to_keep(f, table(s, d, "revertbot").filter("title IS NOT NULL").select("title"), ts="saved_at")


# ---- titles and items -------------------------------------------------------------------------


@query(f"WITH {PAGE} SELECT page_id, ns, FALSE AS talk FROM page WHERE ns % 2 = 0 UNION ALL SELECT page_id, ns + 1, TRUE FROM page WHERE ns % 2 = 0")
def pages_with_talk_pages(s, d):
    return records.with_talk_pages(page(s, d).select("page_id", "ns"))


@query(f"WITH {PAGE} SELECT DISTINCT title, site, CASE WHEN name = '' THEN title ELSE name END AS candidate FROM page, (VALUES ('de', ''), ('fr', ''), ('nl', ''), ('es', ''), ('de', 'Haupt'), ('it', '')) AS h(site, name) WHERE ns = 14")
def hinted_titles(s, d):
    """Titles to look for on other sites, by hints."""
    return records.hinted(page(s, d).filter("ns = 14"), ["all:", "2:", "de:Haupt", "it:"], ["de", "fr", "nl", "es"])


@query(f"""WITH {PAGE}, p AS (SELECT CASE WHEN ns = 0 THEN 'en' ELSE 'de' END AS site, title FROM page WHERE ns IN (0, 14)) SELECT site, title, row_number() OVER (ORDER BY site, title) AS n FROM p""")
def pages_in_order(s, d):
    """Pages by site and title, numbered."""
    p = page(s, d).filter("ns IN (0, 14)").select(F.when(F.col("ns") == 0, "en").otherwise("de").alias("site"), "title")
    return records.numbered(p, F.col("site"), F.col("title"))


@query(f"""WITH {PAGE}, n AS (SELECT title, row_number() OVER (ORDER BY title) AS n FROM page WHERE ns = 0) SELECT title, CAST(floor((n - 1) / 60) AS BIGINT) AS chunk FROM n""")
def title_chunks(s, d):
    """Titles in batches of sixty."""
    return records.chunks(page(s, d).filter("ns = 0").select("title"), 60, F.col("title"))


@query("""WITH w AS (SELECT DISTINCT p_name, string_split(p_name || ' ' || lower(p_type), ' ') AS w FROM part), x AS (SELECT p_name, w, unnest(range(1, 4)) AS i FROM w), y AS (SELECT p_name, w, i, unnest(range(i + 1, 4)) AS j FROM x WHERE i < 3) SELECT DISTINCT p_name, w[i] AS a, w[j] AS b FROM y""")
def word_pairs(s, d):
    """All pairs of the words of each name."""
    w = table(s, d, "part").select("p_name", F.split(F.concat("p_name", F.lit(" "), F.lower("p_type")), " ").alias("w")).distinct()
    return w.select("p_name", F.explode(records.combinations(F.col("w"), 2)).alias("p")).select("p_name", F.col("p")[0].alias("a"), F.col("p")[1].alias("b")).distinct()


_ITEMS = "item AS (SELECT 'Q' || CAST(p_partkey AS VARCHAR) AS item_id, p_name AS en, lower(p_type) AS de, 'Teil ' || CAST(p_partkey % 25 AS VARCHAR) AS dewiki FROM part)"


def _items(s, d):
    j = F.to_json(F.struct(F.struct(F.col("p_name").alias("en"), F.lower("p_type").alias("de")).alias("labels"), F.struct(F.concat("p_name", F.lit("")).alias("enwiki"), F.concat(F.lit("Teil "), (F.col("p_partkey") % 25).cast("string")).alias("dewiki")).alias("sitelinks")))
    raw = table(s, d, "part").select(F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("item_id"), j.alias("json"))
    parsed = F.from_json("json", "labels map<string,string>, sitelinks map<string,string>")
    return raw.select("item_id", parsed.alias("p")).select("item_id", "p.labels", "p.sitelinks")


@query(f"WITH {_ITEMS} SELECT item_id, 'en' AS lang, en AS label FROM item WHERE contains(lower(en), 'ring') UNION ALL SELECT item_id, 'de', de FROM item WHERE contains(de, 'ring')")
def items_by_label(s, d):
    """Items found by a part of a label."""
    return records.items_with_label(_items(s, d), "Ring")


@query(f"WITH {_ITEMS} SELECT item_id, 'enwiki' AS site, en AS title FROM item UNION ALL SELECT item_id, 'dewiki', dewiki FROM item")
def item_site_links(s, d):
    return _items(s, d).select("item_id", F.explode("sitelinks").alias("site", "title"))


@query(f"""WITH {_ITEMS}, w AS (SELECT DISTINCT 'Q' || CAST(l_partkey AS VARCHAR) AS item_id FROM lineitem WHERE l_quantity > 45) SELECT item_id, en AS label FROM item WHERE item_id IN (SELECT item_id FROM w)""")
def items_by_id(s, d):
    asked = table(s, d, "lineitem").filter("l_quantity > 45").select(F.concat(F.lit("Q"), F.col("l_partkey").cast("string")).alias("item_id")).distinct()
    return _items(s, d).join(asked, "item_id", "left_semi").select("item_id", F.col("labels")["en"].alias("label"))


@query("""SELECT CAST(p_partkey AS BIGINT) AS page_id, CASE WHEN p_size > 40 THEN 'sysop' ELSE 'autoconfirmed' END AS level FROM part WHERE p_size > 30""")
def protected_pages(s, d):
    """Pages with an edit restriction, from the dump's notation."""
    from pageloom.sources.dumps import restrictions

    r = F.when(F.col("p_size") > 40, "edit=sysop:move=sysop").when(F.col("p_size") > 30, "autoconfirmed").otherwise("move=sysop")
    p = table(s, d, "part").select(F.col("p_partkey").cast("bigint").alias("page_id"), r.alias("r"))
    return p.select("page_id", restrictions(F.col("r"))[0].alias("level")).filter("level IS NOT NULL")


# ---- categories -------------------------------------------------------------------------------


@query(f"WITH {CATEGORY} SELECT DISTINCT member, category FROM catlink WHERE member >= 140000000")
def supercategories(s, d):
    """The categories above each category."""
    return catlink(s, d).filter("member >= 140000000").distinct()


@query(f"WITH {CATEGORY}, {PAGE} SELECT p.title, count(DISTINCT c.category) AS parents, min(q.title) AS first_parent FROM catlink c JOIN page p ON c.member = p.page_id JOIN page q ON c.category = q.page_id WHERE c.member >= 140000000 GROUP BY p.title")
def supercategory_lists(s, d):
    p = page(s, d).select("page_id", "title")
    c = catlink(s, d).filter("member >= 140000000").distinct()
    j = c.join(p.withColumnRenamed("page_id", "member"), "member").join(p.select(F.col("page_id").alias("category"), F.col("title").alias("parent")), "category")
    return j.groupBy("title").agg(F.countDistinct("category").alias("parents"), F.min("parent").alias("first_parent"))


@query(f"""WITH RECURSIVE {CATEGORY}, tree AS (SELECT category AS root, member AS node, 1 AS depth FROM catlink UNION ALL SELECT t.root, c.member, t.depth + 1 FROM tree t JOIN catlink c ON t.node = c.category)
 SELECT root, count(DISTINCT node) FILTER (node >= 140000000) AS subcategories, count(DISTINCT node) FILTER (node < 140000000) AS articles FROM tree GROUP BY root""")
def category_tree_counts(s, d):
    """Of each category all subcategories and pages below it."""
    c = catlink(s, d)
    t = graph.closure(c.select(F.col("category").alias("parent"), F.col("member").alias("child")), c.select(F.col("category").alias("node")).distinct()).filter("depth > 0")
    return t.groupBy("root").agg(F.count_if(F.col("node") >= 140000000).alias("subcategories"), F.count_if(F.col("node") < 140000000).alias("articles"))


@query(f"""WITH {CATEGORY} SELECT DISTINCT a.member, a.category FROM catlink a WHERE a.member < 140000000 AND NOT EXISTS (SELECT 1 FROM catlink b JOIN catlink t ON b.category = t.member WHERE b.member = a.member AND t.category = a.category)""")
def categories_without_ancestors(s, d):
    """Categories of pages without those above another of theirs."""
    c = catlink(s, d)
    tree = graph.closure(c.filter("member >= 140000000").select(F.col("category").alias("parent"), F.col("member").alias("child")), c.select(F.col("category").alias("node")).distinct())
    return records.without_ancestors(c.filter("member < 140000000"), tree)


@query(f"""WITH {CATEGORY}, {PAGE}, black AS (SELECT page_id FROM page WHERE title IN ('Category:ASIA', 'Category:FRANCE')) SELECT DISTINCT member, category FROM catlink WHERE category NOT IN (SELECT page_id FROM black)""")
def categories_not_blacklisted(s, d):
    black = page(s, d).filter("title IN ('Category:ASIA', 'Category:FRANCE')").select(F.col("page_id").alias("category"))
    return catlink(s, d).distinct().join(F.broadcast(black), "category", "left_anti").select("member", "category")


@query(f"""WITH {CATEGORY} SELECT category + 5 AS to_category, category, count(*) AS moved FROM catlink WHERE category >= 140000000 AND category < 140000010 GROUP BY category""")
def category_redirect_moves(s, d):
    """Members that a redirected category passes on, by category."""
    redirects = s.range(140000000, 140000010).select(F.col("id").alias("category"), (F.col("id") + 5).alias("to_category"))
    return catlink(s, d).join(F.broadcast(redirects), "category").groupBy("to_category", "category").agg(F.count("*").alias("moved"))


@query(f"""WITH {LINK}, r AS (SELECT to_id, from_id FROM (SELECT DISTINCT to_id, from_id FROM link) WHERE from_id NOT IN (SELECT 20000000 + CAST(c_custkey AS BIGINT) FROM customer WHERE c_mktsegment = 'BUILDING')), n AS (SELECT to_id, count(*) AS n FROM r GROUP BY to_id HAVING count(*) >= 5) SELECT r.to_id, r.from_id FROM r JOIN n ON r.to_id = n.to_id""")
def backlinks_unless_few(s, d):
    """Pages that link to a page, without ignored ones; nothing where fewer than five are left."""
    ignored = table(s, d, "customer").filter("c_mktsegment = 'BUILDING'").select((20000000 + F.col("c_custkey").cast("bigint")).alias("from_id"))
    r = link(s, d).distinct().join(ignored, "from_id", "left_anti")
    return r.join(r.groupBy("to_id").agg(F.count("*").alias("n")).filter("n >= 5").select("to_id"), "to_id", "left_semi").select("to_id", "from_id")


# ---- language links ---------------------------------------------------------------------------

_LL = """ll AS (SELECT 'en' AS site, CAST(p_partkey AS BIGINT) AS page, 'de' AS to_site, CAST(p_partkey % 150 AS BIGINT) AS to_page FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT 'de', CAST(p_partkey % 150 AS BIGINT), 'en', CAST(p_partkey AS BIGINT) FROM part WHERE p_partkey % 3 = 1
 UNION ALL SELECT 'en', CAST(p_partkey AS BIGINT), 'fr', CAST(p_partkey AS BIGINT) FROM part WHERE p_partkey % 5 = 0)"""


def _ll(s, d):
    p, k = table(s, d, "part"), F.col("p_partkey").cast("bigint")
    row = lambda f, a, b, c, e: p.filter(f).select(F.lit(a).alias("site"), b.alias("page"), F.lit(c).alias("to_site"), e.alias("to_page"))
    return row("p_partkey % 2 = 1", "en", k, "de", k % 150).unionByName(row("p_partkey % 3 = 1", "de", k % 150, "en", k)).unionByName(row("p_partkey % 5 = 0", "en", k, "fr", k))


@query(f"WITH {_LL} SELECT DISTINCT a.site, a.page, a.to_site, a.to_page FROM ll a JOIN ll b ON a.site = b.to_site AND a.page = b.to_page AND a.to_site = b.site AND a.to_page = b.page")
def mutual_language_links(s, d):
    """Language links whose other page links back."""
    return records.mutual_links(_ll(s, d))


@query(f"WITH {_LL} SELECT DISTINCT a.site, a.page, a.to_site, a.to_page FROM ll a WHERE NOT EXISTS (SELECT 1 FROM ll b WHERE a.site = b.to_site AND a.page = b.to_page AND a.to_site = b.site AND a.to_page = b.page)")
def missing_backlinks(s, d):
    """Pages that fail to link back."""
    return records.without_backlink(_ll(s, d))


@query(f"""WITH {_LL}, e AS (SELECT site || ':' || CAST(page AS VARCHAR) AS a, to_site || ':' || CAST(to_page AS VARCHAR) AS b FROM ll), m AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, a <= b AS up FROM e) SELECT a, b, count(*) > 1 AS "both" FROM m GROUP BY a, b""")
def link_graph_edges(s, d):
    """Edges of the graph of language links, each once."""
    e = _ll(s, d).select(F.concat_ws(":", "site", F.col("page").cast("string")).alias("a"), F.concat_ws(":", "to_site", F.col("to_page").cast("string")).alias("b"))
    return records.merged_edges(e)


@query(f"""WITH {_LL}, {REDIRECT}, n AS (SELECT site, page FROM ll UNION SELECT to_site, to_page FROM ll), c AS (SELECT site, page, count(DISTINCT to_page) AS out FROM ll GROUP BY site, page, to_site) SELECT n.site, n.page, CASE WHEN n.site = 'en' AND r.page_id IS NOT NULL THEN 'redirect' ELSE 'page' END AS kind, coalesce(max(c.out), 0) > 1 AS several FROM n LEFT JOIN redirect r ON n.page = r.page_id LEFT JOIN c ON n.site = c.site AND n.page = c.page GROUP BY ALL""")
def link_graph_nodes(s, d):
    """Nodes of the graph: redirects, and pages with several links to one site."""
    l = _ll(s, d)
    nodes = l.select("site", "page").union(l.select("to_site", "to_page")).distinct()
    several = l.distinct().groupBy("site", "page", "to_site").agg(F.count("*").alias("n")).groupBy("site", "page").agg((F.max("n") > 1).alias("several"))
    r = redirect(s, d).select(F.col("page_id").alias("page"), F.lit("en").alias("site"), F.lit("redirect").alias("kind"))
    return nodes.join(several, ["site", "page"], "left").join(r, ["site", "page"], "left").select("site", "page", F.coalesce("kind", F.lit("page")).alias("kind"), F.coalesce("several", F.lit(False)).alias("several"))


@query(f"""WITH {_LL} SELECT DISTINCT page, to_page, CAST(page % 4 AS INT) AS kind, CAST(to_page % 4 AS INT) AS to_kind FROM ll WHERE site = 'en' AND to_site = 'de' AND page % 4 <> to_page % 4 AND NOT (page % 4 = 1 AND to_page % 4 = 3)""")
def namespace_mismatches(s, d):
    """Language links between pages of different namespaces, but for allowed pairs."""
    l = _ll(s, d).filter("site = 'en' AND to_site = 'de'").select("page", "to_page").distinct()
    left = l.select("page", (F.col("page") % 4).cast("int").alias("kind")).distinct()
    right = l.select("to_page", (F.col("to_page") % 4).cast("int").alias("to_kind")).distinct()
    return records.mismatched(l, left, right, [(1, 3)])


@query(f"""WITH {_LL}, n AS (SELECT site, page, to_site, min(to_page) AS new FROM ll GROUP BY ALL), o AS (SELECT site, page, to_site, max(to_page) AS old FROM ll WHERE page % 7 <> 0 GROUP BY ALL) SELECT coalesce(n.site, o.site) AS site, coalesce(n.page, o.page) AS page, coalesce(n.to_site, o.to_site) AS to_site, old, new, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'modified' END AS change FROM n FULL JOIN o ON n.site = o.site AND n.page = o.page AND n.to_site = o.to_site WHERE old IS DISTINCT FROM new""")
def language_link_changes(s, d):
    """What changes on each page when it gets its new language links."""
    l = _ll(s, d)
    new = l.groupBy("site", "page", "to_site").agg(F.min("to_page").alias("v"))
    old = l.filter("page % 7 <> 0").groupBy("site", "page", "to_site").agg(F.max("to_page").alias("v"))
    return pages.link_changes(old, new, ["site", "page", "to_site"], "v")


@query(f"""WITH {_LL}, c AS (SELECT to_site AS site, count(*) AS pending FROM ll GROUP BY to_site) SELECT site, pending, pending = (SELECT max(pending) FROM c) AS most FROM c""")
def pending_by_site(s, d):
    """Open pages of each site, and the site with most."""
    c = _ll(s, d).groupBy(F.col("to_site").alias("site")).agg(F.count("*").alias("pending"))
    most = c.agg(F.max("pending").alias("m"))
    return c.join(F.broadcast(most), F.col("pending") == F.col("m"), "left").select("site", "pending", F.col("m").isNotNull().alias("most"))


# ---- state over time --------------------------------------------------------------------------


@query("""WITH e AS (SELECT CAST(event_id % 97 AS BIGINT) AS page, event_type, ts, event_id FROM events), l AS (SELECT page, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS last_ts, count(*) AS entries FROM e GROUP BY page) SELECT page, state, CAST(floor(epoch(last_ts)) AS BIGINT) AS last_at, entries FROM l""")
def compressed_history(s, d):
    """A log folded to the last state of each page."""
    e = table(s, d, "events").select((F.col("event_id") % 97).cast("bigint").alias("page"), "event_type", "ts", "event_id")
    return watching.compressed(e, "page", ["ts", "event_id"], "event_type").select("page", F.col("event_type").alias("state"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("last_at"), "entries")


@query("""WITH e AS (SELECT CAST(event_id % 97 AS BIGINT) AS page, event_type AS kind, max(ts) AS ts FROM events GROUP BY ALL), p AS (SELECT page, max(ts) FILTER (kind = 'view') AS seen, max(ts) FILTER (kind IN ('purchase', 'signup')) AS changed FROM e GROUP BY page) SELECT page, CASE WHEN changed IS NULL THEN 'hist' WHEN seen IS NULL OR changed > seen THEN 'news' ELSE 'hist' END AS shelf FROM p""")
def promoted_pages(s, d):
    """Pages with a change since they were last seen are news, others history."""
    e = table(s, d, "events").select((F.col("event_id") % 97).cast("bigint").alias("page"), "event_type", "ts")
    return watching.shelves(e, "page", "ts", F.col("event_type") == "view", F.col("event_type").isin("purchase", "signup"))


@query("""SELECT hist_no, coalesce(nullif(trim("timestamp"), '-'), '') AS cleaned FROM catimages""")
def clean_dates(s, d):
    """'-' stands for no date."""
    return table(s, d, "catimages").select("hist_no", F.coalesce(F.nullif(F.trim("timestamp"), F.lit("-")), F.lit("")).alias("cleaned"))
