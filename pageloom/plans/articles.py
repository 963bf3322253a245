"""Queries about wikitext, over articles planted from the rows of ``part``.

Each article is a row's pieces of markup put together by the same expression in Spark and in SQL; which
pieces it has depends on its key. The SQL of a rewriting query puts the rewritten pieces together, so
that it says what must come out without doing the rewriting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pageloom.functions import articles, cleaning, rewriting, wikitext
from pageloom.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
LANGUAGES = ("de", "fr", "nl", "es")


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


# ---- articles ---------------------------------------------------------------------------------


def _quoted(s: str) -> str:
    """A text as an expression of both dialects, without escapes."""
    out, plain = [], ""
    for ch in s:
        if ch in "\n'\\":
            out += ([f"'{plain}'"] if plain else []) + [f"chr({ord(ch)})"]
            plain = ""
        else:
            plain += ch
    return " || ".join(out + ([f"'{plain}'"] if plain or not out else []))


def _put(*parts: str) -> str:
    """Texts and, in braces of the form <<expr>>, expressions over the row."""
    import re

    tokens = [t for p in parts for t in re.split(r"(<<.*?>>)", p) if t]
    return " || ".join(f"CAST({t[2:-2]} AS STRING)" if t.startswith("<<") else _quoted(t) for t in tokens)


K = "p_partkey"
TITLE = "p_name || ' ' || CAST(p_partkey AS STRING)"
#: name: (condition, text)
PIECES: dict[str, tuple[str, str]] = {
    "redirect": (f"{K} % 10 = 1", f"#REDIRECT [[Target <<{K} % 30>>]]\n"),
    "static": (f"{K} % 20 = 1", "__STATICREDIRECT__\n"),
    "infobox": (f"{K} % 10 <> 1", "{{Infobox part|name=<<p_name>>|size=<<p_size>>|type={{Kind|<<p_type>>}}}}\n"),
    "intro": (f"{K} % 10 <> 1", f"'''<<{TITLE}>>''' is a [[<<p_brand>>|part]] of [[set <<{K} % 50>>]] and [[Set <<{K} % 50>>#Use|the set]].\n"),
    "file": (f"{K} % 3 = 0", f"[[File:Part_<<{K} % 40>>.jpg|thumb|A [[caption]] here]]\n"),
    "heading": (f"{K} % 4 = 0", "==History==\nOld.\n"),
    "heading2": (f"{K} % 4 = 1", "===  Later use ===\n"),
    "list": (f"{K} % 5 = 0", "*first\n* second\n#:third\n"),
    "comment": (f"{K} % 5 = 1", "<!-- [[Hidden]] [[Category:Hidden]] <b>x</b> 5&nbsp;% -->\n"),
    "nowiki": (f"{K} % 7 = 0", "<nowiki>[[Not a link]] {{Not}} <i>x</i></nowiki>\n"),
    "ref": (f"{K} % 2 = 0", f"Said so.<ref>Book <<{K} % 20>>, p. 3</ref> Again.<ref>Book <<{K} % 20>>, p. 3</ref>\n"),
    "badref": (f"{K} % 11 = 0", "One<ref name =\"a\">A</ref> two<ref></ref> three<ref />.\n"),
    "html": (f"{K} % 6 = 0", "<b>bold</b> and <em>thin</em><br>\n<hr>\n <h2> Head </h2>\n"),
    "link": (f"{K} % 3 = 1", f"See [http://www.example.org/<<{K} % 30>> Site], https://host<<{K} % 13>>.example.net/p?q=1.\n"),
    "badlink": (f"{K} % 13 = 3", "[[http://www.example.com/a|Name]] and [http://www.example.com/b.html|File].\n"),
    "stub": (f"{K} % 9 = 0", "{{stub}}\n"),
    "disambig": (f"{K} % 29 = 0", "{{Disambig}}\n"),
    "delete": (f"{K} % 31 = 0", "{{Delete|no use}}\n"),
    "licence": (f"{K} % 3 = 2", "{{License|CC}}\n"),
    "old": (f"{K} % 16 = 0", "{{oldtemplate|a=1}}{{gone}}\n"),
    "bots": (f"{K} % 37 = 0", "{{bots|deny=all}}\n"),
    "nobots": (f"{K} % 41 = 0", "{{nobots}}\n"),
    "function": (f"{K} % 15 = 0", "{{#if:x|{{#if:y|a|b}}|c}}\n"),
    "protected": (f"{K} % 18 = 0", "{{Protected}}\n"),
    "halfprotected": (f"{K} % 18 = 3", "{{Semi-protected}}\n"),
    "self": (f"{K} % 8 = 0", f"Here: [[<<{TITLE}>>]], [[<<{TITLE}>>|this]].\n"),
    "isbn": (f"{K} % 12 = 0", "ISBN 0306406152 and ISBN 3125785006.\n"),
    "table": (f"{K} % 53 = 0", "<table border=1><tr><th>a</th><td>b</td></tr></table>\n"),
    "gallery": (f"{K} % 17 = 0", f"<gallery>\nFile:Part <<{K}>>.jpg|one\nImage:other.png\n</gallery>\n"),
    "units": (f"{K} % 14 = 0", "It holds 20 ccm, 5&nbsp;% at 30 ºC  or so.\n"),
    "math": (f"{K} % 19 = 0", "<math>x  [[y]] <b>z</b></math>\n"),
    "pre": (f"{K} % 23 = 0", "<pre>\n==no heading==\n[[File:No.jpg]]\n</pre>\n"),
    "entity": (f"{K} % 22 = 0", "Caf&eacute; &amp; bar &lt;3\n"),
    "hidden": (f"{K} % 47 = 0", "__HIDDENCAT__\n"),
    "summary": (f"{K} % 21 = 0", "== Summary ==\n|source = own work\n|author = me\n| Permission = see below\n== Licensing ==\n__NOTOC__{{ImageUpload|full}}\n"),
    "references": (f"{K} % 4 = 2", "<references />\n"),
    "category": (f"{K} % 10 <> 1 AND {K} % 25 <> 0", "[[Category:<<p_type>>]]\n[[category:<<p_brand>>|key]]\n"),
    "german": (f"{K} % 2 = 1", f"[[de:Teil <<{K} % 25>>]]\n"),
    "french": (f"{K} % 3 = 0", f"[[fr:Partie <<{K} % 25>>]]\n"),
}


def text_of(**other: str) -> str:
    """The expression of the article's text, with other texts for some pieces."""
    return " || ".join(f"CASE WHEN {c} THEN {_put(other.get(n, t)) if other.get(n, t) else chr(39) * 2} ELSE '' END" for n, (c, t) in PIECES.items())


ARTICLE = f"article AS (SELECT CAST(p_partkey AS BIGINT) AS page_id, {TITLE} AS title, {text_of()} AS text FROM part)"


def article(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.expr("CAST(p_partkey AS BIGINT)").alias("page_id"), F.expr(TITLE).alias("title"), F.expr(text_of()).alias("text"))


def _md5_of(**other: str) -> str:
    return f"SELECT CAST(p_partkey AS BIGINT) AS page_id, md5({text_of(**other)}) AS h FROM part"


def _rewritten(s, d, new) -> DataFrame:
    return article(s, d).select("page_id", F.md5(new).alias("h"))


_DISABLED = r"(?is)<!--.*?-->|<nowiki>.*?</nowiki>|<pre>.*?</pre>|<source\b[^>]*>.*?</source>|<includeonly>.*?</includeonly>"
_LIVE = f"live AS (SELECT page_id, title, text, regexp_replace(text, '{_DISABLED}', '', 'g') AS t FROM article)"
_CAP = "upper(substr({0}, 1, 1)) || substr({0}, 2)"
_WITH = f"WITH {ARTICLE}, {_LIVE}"

# ---- extraction -------------------------------------------------------------------------------

_IMAGES = rf""", found AS (SELECT page_id, unnest(regexp_extract_all(t, '{articles.FILE_LINK}', 1)) AS n FROM live
 UNION ALL SELECT page_id, unnest(regexp_extract_all(array_to_string(regexp_extract_all(t, '{articles.GALLERY}', 1), chr(10)), '{articles.GALLERY_LINE}', 1)) FROM live),
 used AS (SELECT DISTINCT page_id, upper(substr(replace(n, '_', ' '), 1, 1)) || substr(replace(n, '_', ' '), 2) AS file FROM found)"""


def _image_use(s, d):
    return article(s, d).select("page_id", F.explode(articles.image_links(F.col("text"))).alias("file"))


@query(_WITH + _IMAGES + " SELECT file, page_id FROM used")
def image_links(s, d):
    """Which pages show which images (links and galleries)."""
    return _image_use(s, d)


@query(_WITH + _IMAGES + " SELECT file, 'site ' || CAST(page_id % 8 AS VARCHAR) AS site, count(*) AS pages, min(page_id) AS first_page FROM used GROUP BY ALL")
def global_image_usage(s, d):
    """Use of images by site."""
    return _image_use(s, d).groupBy("file", F.concat(F.lit("site "), (F.col("page_id") % 8).cast("string")).alias("site")).agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


_FILES = ", files AS (SELECT DISTINCT 'Part ' || CAST(p_partkey % 60 AS VARCHAR) || '.jpg' AS file FROM part WHERE p_partkey % 2 = 0)"


def _files(s, d):
    return table(s, d, "part").filter("p_partkey % 2 = 0").select(F.concat(F.lit("Part "), (F.col("p_partkey") % 60).cast("string"), F.lit(".jpg")).alias("file")).distinct()


@query(_WITH + _IMAGES + _FILES + " SELECT file, count(*) AS pages FROM used WHERE file NOT IN (SELECT file FROM files) GROUP BY file")
def missing_images(s, d):
    """Images in use that are no local file, with the number of pages."""
    return _image_use(s, d).groupBy("file").agg(F.count("*").alias("pages")).join(_files(s, d), "file", "left_anti")


@query(_WITH + _IMAGES + _FILES + " SELECT file FROM files WHERE file NOT IN (SELECT file FROM used)")
def unused_images(s, d):
    return _files(s, d).join(_image_use(s, d).select("file").distinct(), "file", "left_anti")


_LANG_SQL = rf""", pairs AS (SELECT page_id, unnest(regexp_extract_all(t, '{articles.LANGUAGE_LINK}', 1)) AS lang, unnest(regexp_extract_all(t, '{articles.LANGUAGE_LINK}', 2)) AS title FROM live), langs AS (SELECT * FROM pairs WHERE lang IN ('de', 'fr', 'nl', 'es'))"""


def _language_links(s, d):
    return article(s, d).select("page_id", F.inline(articles.language_link_pairs(F.col("text"), LANGUAGES)))


@query(_WITH + _LANG_SQL + " SELECT page_id, lang, title FROM langs UNION ALL SELECT page_id, 'en', title FROM live")
def pages_with_language_links(s, d):
    """Each page and then its pages in other languages."""
    return article(s, d).select("page_id", F.lit("en").alias("lang"), "title").unionByName(_language_links(s, d))


@query(_WITH + _LANG_SQL + " SELECT page_id, title FROM live WHERE page_id NOT IN (SELECT page_id FROM langs)")
def pages_without_language_links(s, d):
    return article(s, d).filter(F.size(articles.language_link_pairs(F.col("text"), LANGUAGES)) == 0).select("page_id", "title")


_LINKED = rf""", found AS (SELECT page_id, trim(replace(unnest(regexp_extract_all(t, '{wikitext.LINK}', 1)), '_', ' ')) AS n FROM live),
 linked AS (SELECT DISTINCT page_id, {_CAP.format('n')} AS target FROM found WHERE n <> '' AND NOT regexp_matches({_CAP.format('n')}, '(?i)^(?:category|file|image|de|fr|nl|es)\s*:'))"""


@query(_WITH + _LINKED + " SELECT page_id, target FROM linked")
def linked_pages(s, d):
    return article(s, d).select("page_id", F.explode(articles.linked_pages(F.col("text"), LANGUAGES)).alias("target"))


_TEMPLATES = rf""", found AS (SELECT page_id, unnest(regexp_extract_all(t, '{articles.TEMPLATE_NAME}', 1)) AS n FROM live), used AS (SELECT DISTINCT page_id, {_CAP.format("replace(n, '_', ' ')")} AS template FROM found)"""


@query(_WITH + _TEMPLATES + " SELECT template, page_id, count(*) OVER (PARTITION BY template) AS pages FROM used")
def template_pages(s, d):
    """The pages of each template, with their number; counted first, so that a template of most pages is no hot spot."""
    use = articles.template_uses(article(s, d))
    return use.join(use.groupBy("template").agg(F.count("*").alias("pages")), "template")


@query(_WITH + _TEMPLATES + " SELECT page_id, title FROM article WHERE page_id IN (SELECT page_id FROM used WHERE template IN ('Stub', 'Delete'))")
def pages_transcluding(s, d):
    return article(s, d).filter(articles.uses_template(F.col("text"), ["stub", "Delete"])).select("page_id", "title")


@query(_WITH + _TEMPLATES + " SELECT page_id FROM article WHERE page_id NOT IN (SELECT page_id FROM used WHERE template IN ('License', 'Own'))")
def pages_without_licence(s, d):
    return article(s, d).filter(~articles.uses_template(F.col("text"), ["License", "Own"])).select("page_id")


@query(_WITH + r""", c AS (SELECT page_id, len(regexp_extract_all(t, '\{\{\s*#(\w+):', 1)) AS n FROM live WHERE regexp_matches(t, '\{\{\s*#if:')) SELECT page_id, CAST(n AS INT) AS calls, CAST(row_number() OVER (ORDER BY n DESC, page_id) AS INT) AS rank FROM c ORDER BY rank LIMIT 40""")
def parser_function_counts(s, d):
    from pageloom.operators.pages import top

    t = wikitext.without_disabled_parts(F.col("text"))
    c = article(s, d).select("page_id", articles.function_calls(t, "if").alias("calls")).filter("calls > 0")
    return top(c, 40, F.desc("calls"), F.col("page_id")).select("page_id", "calls", F.col("rank").cast("int").alias("rank"))


@query(_WITH + r""" SELECT page_id, contains(text, '#REDIRECT') AS redirect, contains(text, '#REDIRECT') AND contains(text, '__STATICREDIRECT__') AS static_redirect, contains(text, '__HIDDENCAT__') AS hidden_category,
 contains(t, '{{Disambig}}') AS disambiguation, regexp_matches(text, '=+[ '']*History[ '']*=+') AS history, regexp_matches(text, '=+[ '']*Later[ _]use[ '']*=+') AS later_use, contains(text, '<table') AS html_table,
 length(trim(regexp_replace(regexp_replace(text, '(?i)\[\[\s*(?:category|de|fr|nl|es)\s*:[^\[\]]*\]\]', '', 'g'), '\s+', ' ', 'g'))) < 4 AS empty, NOT (contains(text, '{{bots|deny=all}}') OR contains(text, '{{nobots}}')) AS robots FROM live""")
def page_kinds(s, d):
    t = F.col("text")
    return article(s, d).select(
        "page_id", articles.redirect_target(t).isNotNull().alias("redirect"), articles.is_static_redirect(t).alias("static_redirect"), articles.is_hidden_category(t).alias("hidden_category"), articles.uses_template(t, ["Disambig"]).alias("disambiguation"),
        articles.has_section(t, "History").alias("history"), articles.has_section(t, "Later use").alias("later_use"), articles.has_html_table(t).alias("html_table"), articles.is_empty_page(t, LANGUAGES).alias("empty"), rewriting.robots_allowed(t, "anybot").alias("robots"),
    )


@query(_WITH + r""" SELECT page_id FROM article WHERE NOT (regexp_matches(title, 'widget') OR NOT regexp_matches(title, '[0-9]')) AND NOT (contains(text, '{{Delete') OR contains(text, '{{stub')) AND regexp_matches(text, '\[\[set')""")
def text_and_title_exceptions(s, d):
    a = article(s, d)
    return a.filter(~articles.excepted(F.col("title"), ["widget"], ["[0-9]"]) & ~articles.excepted(F.col("text"), [r"\{\{Delete", r"\{\{stub"], [r"\[\[set"])).select("page_id")


@query(_WITH + r""", w AS (SELECT DISTINCT p_name || ' ' || CAST(p_partkey + 500 AS VARCHAR) AS title FROM part) SELECT w.title, CASE WHEN text IS NULL THEN 'missing' WHEN contains(text, '#REDIRECT') THEN 'redirect' WHEN trim(text) = '' THEN 'empty' ELSE 'ok' END AS status,
 nullif(trim(regexp_extract(text, '#REDIRECT \[\[([^\]]*)', 1)), '') AS target FROM w LEFT JOIN article a ON w.title = a.title""")
def page_states(s, d):
    """Whether wanted titles exist, and what they are."""
    wanted = table(s, d, "part").select(F.concat("p_name", F.lit(" "), (F.col("p_partkey") + 500).cast("string")).alias("title"))
    return articles.page_states(wanted, article(s, d))


_PROTECTION = [("sysop-total", [r"\{\{Protected\}\}"]), ("autoconfirmed-total", [r"\{\{Semi-protected\}\}"]), ("unique", [r"\{\{Locked\|"])]


@query(_WITH + r""", c AS (SELECT page_id, CASE WHEN contains(text, '{{Protected}}') THEN 'sysop-total' WHEN contains(text, '{{Semi-protected}}') THEN 'autoconfirmed-total' ELSE 'editable' END AS written,
 CASE page_id % 36 WHEN 0 THEN 'sysop-total' WHEN 3 THEN 'autoconfirmed-total' ELSE 'editable' END AS real FROM article) SELECT page_id, written, real, CASE WHEN real = 'editable' THEN 'drop' ELSE 'replace' END AS action FROM c WHERE written <> real""")
def protection_mismatches(s, d):
    """Pages whose protection template is not that of their protection."""
    real = F.when(F.col("page_id") % 36 == 0, "sysop-total").when(F.col("page_id") % 36 == 3, "autoconfirmed-total").otherwise("editable")
    c = article(s, d).select("page_id", articles.first_match(F.col("text"), _PROTECTION, "editable").alias("written"), real.alias("real"))
    return c.filter("written <> real").withColumn("action", F.when(F.col("real") == "editable", "drop").otherwise("replace"))


@query(_WITH + r""" SELECT page_id, length(text) AS size, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS BIGINT) AS words, substr(text, CAST(greatest(instr(lower(text), 'host7') - 20, 1) AS BIGINT), 40) AS snippet FROM article
 WHERE list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), 'host7') AND list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), 'category')""")
def search_texts(s, d):
    """Full-text search by words."""
    return articles.snippets(article(s, d), ["host7", "Category"])


@query(_WITH + r""" SELECT page_id, unnest(regexp_extract_all(text, '(?i)\[\[\s*(?:File|Image)\s*:\s*([^\[\]|\n]+?)\s*(?:\||\]\])', 1)) AS title FROM article WHERE contains(text, '<pre>')""")
def titles_in_pages(s, d):
    """Titles that a pattern finds in texts, code included."""
    return article(s, d).filter(F.contains("text", F.lit("<pre>"))).select("page_id", F.explode(F.regexp_extract_all("text", F.lit(articles.FILE_LINK), F.lit(1))).alias("title"))


@query(_WITH + rf""" SELECT page_id, url FROM (SELECT page_id, unnest(regexp_extract_all(text, '{wikitext.URL.replace("'", "''")}')) AS url FROM article)""")
def external_links(s, d):
    return article(s, d).select("page_id", F.explode(wikitext.external_urls(F.col("text"))).alias("url"))


@query(_WITH + r""", r AS (SELECT page_id, 'http://host' || unnest(regexp_extract_all(text, '://host(\d+\.example\.net)', 1)) AS host FROM article) SELECT host, count(*) AS links, count(DISTINCT page_id) AS pages FROM r GROUP BY host""")
def linksearch(s, d):
    """Links to a family of hosts."""
    u = article(s, d).select("page_id", F.explode(wikitext.external_urls(F.col("text"))).alias("url")).withColumn("host", F.regexp_extract("url", r"^[a-z]+://([^/:?#]*)", 1))
    return u.filter(F.col("host").rlike(r"^host\d+\.example\.net$")).groupBy(F.concat(F.lit("http://"), "host").alias("host")).agg(F.count("*").alias("links"), F.countDistinct("page_id").alias("pages"))


@query(f"SELECT CAST(p_partkey AS BIGINT) AS page_id, {TITLE} AS title FROM part WHERE p_partkey % 8 = 0")
def self_links(s, d):
    """Pages that link to themselves, whatever the case of the first letter, outside code."""
    same = F.array_contains(articles.linked_pages(F.col("text"), LANGUAGES), F.concat(F.upper(F.substring("title", 1, 1)), F.substring("title", 2, 1 << 30)))
    return article(s, d).filter(same).select("page_id", "title")


@query(f"""WITH {ARTICLE} SELECT CAST(p_partkey AS BIGINT) AS page_id FROM part WHERE (p_partkey % 2 = 0 OR p_partkey % 11 = 0) AND p_partkey % 4 <> 2""")
def articles_lacking_references(s, d):
    return article(s, d).filter(rewriting.references_lacking(F.col("text"))).select("page_id")


@query(_WITH + r""", p AS (SELECT page_id, regexp_extract(t, '\|size=(\d+)', 1) AS size, regexp_extract(t, '\|name=([^|]*)', 1) AS name FROM live WHERE contains(t, '{{Infobox part')), l AS (SELECT page_id, {cap} AS target FROM (SELECT page_id, 'set ' || CAST(page_id % 50 AS VARCHAR) AS n FROM p) x(page_id, n))
 SELECT p.page_id, name, CAST(size AS INT) AS size, target FROM p JOIN l USING (page_id) WHERE p.page_id % 4 <> 3""".replace("{cap}", _CAP.format("n")))
def harvested_fields(s, d):
    """Fields of a template with the page that the text links to, for pages without such a claim yet."""
    a = article(s, d)
    box = a.select("page_id", F.explode(wikitext.templates_and_params(F.col("text"))).alias("t"), articles.linked_pages(F.col("text"), LANGUAGES).alias("links")).filter("t.name = 'Infobox part'")
    claims = a.filter("page_id % 4 = 3").select("page_id")
    got = box.select("page_id", F.col("t.params")["name"].alias("name"), F.col("t.params")["size"].cast("int").alias("size"), F.filter("links", lambda x: x.startswith("Set "))[0].alias("target"))
    return got.join(claims, "page_id", "left_anti")


@query(_WITH + rf""", c AS (SELECT DISTINCT unnest(regexp_extract_all(t, '{wikitext.CATEGORY}', 1)) AS category FROM live), k AS (SELECT DISTINCT 'Brand#' || CAST(p_size AS VARCHAR) AS category FROM part) SELECT category FROM k WHERE category NOT IN (SELECT category FROM c)""")
def unused_categories(s, d):
    """Category pages that no page is in."""
    from pageloom.operators.pages import without

    known = table(s, d, "part").select(F.concat(F.lit("Brand#"), F.col("p_size").cast("string")).alias("category")).distinct()
    used = article(s, d).select(F.inline(wikitext.category_links(wikitext.without_disabled_parts(F.col("text"))))).select("category")
    return without(known, used, key="category", other_key="category")


@query(_WITH + rf""" SELECT page_id, unnest(regexp_extract_all(t, '{wikitext.CATEGORY}', 1)) AS category, coalesce(unnest(regexp_extract_all(t, '{wikitext.CATEGORY}', 2)), '') AS sort_key FROM live""")
def article_categories(s, d):
    """Categories with their sort keys, outside comments and code."""
    return article(s, d).select("page_id", F.inline(wikitext.category_links(wikitext.without_disabled_parts(F.col("text")))))


_ARGUMENTS = ["-transcludes:stub", "-filelinks:part_6.jpg", "-search:host7 category", "-withoutinterwiki", "-imageused:Part 9.jpg", "-weblink:host3.example.net", "-redirectonly:b", "-start:s"]


@query(_WITH + _IMAGES.replace(" used AS", " used_i AS").replace("found AS", "found_i AS").replace("FROM found)", "FROM found_i)") + _TEMPLATES.replace("found AS", "found_t AS").replace("FROM found)", "FROM found_t)") + _LANG_SQL + r""",
 r AS (SELECT '-transcludes:stub' AS argument, page_id FROM used WHERE template = 'Stub' UNION ALL SELECT '-filelinks:part_6.jpg', page_id FROM used_i WHERE file = 'Part 6.jpg' UNION ALL SELECT '-imageused:Part 9.jpg', page_id FROM used_i WHERE file = 'Part 9.jpg'
 UNION ALL SELECT '-search:host7 category', page_id FROM article WHERE list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), 'host7') AND list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), 'category')
 UNION ALL SELECT '-withoutinterwiki', page_id FROM article WHERE page_id NOT IN (SELECT page_id FROM langs) UNION ALL SELECT '-weblink:host3.example.net', page_id FROM article WHERE contains(text, '://host3.example.net/')
 UNION ALL SELECT '-redirectonly:b', page_id FROM article WHERE contains(text, '#REDIRECT') AND title >= 'b' UNION ALL SELECT '-start:s', page_id FROM article WHERE title >= 's') SELECT argument, page_id FROM r""")
def page_arguments(s, d):
    """Page lists by arguments, each with its pages."""
    from pageloom.plans.generators import Relations, page_query

    a = article(s, d)
    r = Relations(
        a.select("page_id", F.lit(0).alias("ns"), "title", articles.redirect_target(F.col("text")).isNotNull().alias("is_redirect"), F.length("text").alias("length")), text=a, image=_image_use(s, d), template=articles.template_uses(a), language=_language_links(s, d),
        url=a.select("page_id", F.explode(wikitext.external_urls(F.col("text"))).alias("url")),
    )
    out = None
    for argument in _ARGUMENTS:
        one = page_query(r, argument).select(F.lit(argument).alias("argument"), "page_id")
        out = one if out is None else out.unionByName(one)
    return out


# ---- rewriting: the SQL puts the rewritten pieces together --------------------------------------

_HTML_DONE = "'''bold''' and ''thin''<br>\n----\n== Head ==\n"


@query(_md5_of(html=_HTML_DONE))
def fix_html(s, d):
    """Tags as wikitext; comments, nowiki and math stay."""
    return _rewritten(s, d, cleaning.cleaned(F.col("text"), cleaning.FIX_SETS["HTML"]))


@query(_md5_of(ref=PIECES["ref"][1].replace("Again", "<Again>")))
def replaced_outside_references(s, d):
    f = wikitext.rewrite_udf(lambda t: wikitext.replace_except(t, r"\b(Book|Again)\b", r"<\1>", ["ref", "template", "link", "comment", "nowiki"]))
    return _rewritten(s, d, f("text"))


@query(_md5_of(badlink="[http://www.example.com/a|Name] and [http://www.example.com/b.html File].\n"))
def fix_syntax_safe(s, d):
    return _rewritten(s, d, cleaning.cleaned(F.col("text"), cleaning.FIX_SETS["syntax-safe"]))


@query(_md5_of(badref='One<ref name="a">A</ref> two three.\n'))
def fix_references(s, d):
    return _rewritten(s, d, cleaning.cleaned(F.col("text"), cleaning.FIX_SETS["references"]))


@query(_md5_of(summary="== {{int:filedesc}} ==\n|source = {{own}}\n|author = me\n| Permission =\n== {{int:license-header}} ==\n\n"))
def fix_file_descriptions(s, d):
    return _rewritten(s, d, cleaning.cleaned(F.col("text"), cleaning.FIX_SETS["file-description"]))


@query(_md5_of(
    html="'''bold''' and ''thin''<br />\n----\n <h2> Head </h2>\n", heading="== History ==\nOld.\n", heading2="=== Later use ===\n", list="* first\n* second\n#: third\n", badref='One<ref name="a">A</ref> two three.\n',
    units="It holds 20&nbsp;cm³, 5 % at 30&nbsp;°C or so.\n", comment=PIECES["comment"][1].replace("&nbsp;%", " %"),
))
def clean_articles(s, d):
    """All cosmetic steps, in order, beside protected regions."""
    return _rewritten(s, d, cleaning.cleaned(F.col("text")))


@query(_md5_of(entity="Café &amp; bar &lt;3\n", comment=PIECES["comment"][1]))
def resolved_entities(s, d):
    return _rewritten(s, d, wikitext.rewrite_udf(cleaning.resolve_entities)("text"))


@query(_md5_of(old="{{New template|a=1}}\n"))
def deprecated_templates(s, d):
    f = wikitext.rewrite_udf(lambda t: cleaning.replace_deprecated(t, {"oldtemplate": "New template", "gone": None}))
    return _rewritten(s, d, F.coalesce(f(F.when(F.col("text").rlike(r"(?i)\{\{(oldtemplate|gone)"), F.col("text"))), F.col("text")))


@query(_md5_of(delete=""))
def without_discussion_templates(s, d):
    f = wikitext.rewrite_udf(lambda t: rewriting.change_template(t, "Delete", None))
    return _rewritten(s, d, f("text"))


@query(_md5_of(stub="{{Short page}}\n"))
def renamed_templates(s, d):
    f = wikitext.rewrite_udf(lambda t: rewriting.change_template(t, "Stub", "Short page"))
    return _rewritten(s, d, f("text"))


@query(_md5_of(intro=f"'''<<{TITLE}>>''' is a [[<<p_brand>>|part]] of [[Series <<{K} % 50>>|set <<{K} % 50>>]] and [[Series <<{K} % 50>>#Use|the set]].\n"))
def links_to_redirect_targets(s, d):
    """Links to redirects lead to the redirects' targets. The map of a page holds only the links of that page."""
    a = article(s, d)
    redirects = s.range(50).select(F.concat(F.lit("Set "), "id").alias("old"), F.concat(F.lit("Series "), "id").alias("new"))
    links = a.select("page_id", F.explode(articles.linked_pages(F.col("text"), LANGUAGES)).alias("old")).join(redirects, "old")
    return a.join(rewriting.maps_of(links, "page_id"), "page_id", "left").select("page_id", F.md5(rewriting.with_map(cleaning.redirected_links)("text", "map")).alias("h"))


@query(_md5_of(self=f"Here: <<{TITLE}>>, this.\n"))
def without_self_links(s, d):
    f = rewriting.with_title(wikitext.unlinked)
    return _rewritten(s, d, f("text", "title"))


@query(_md5_of(category=PIECES["category"][1].replace("[[category:<<p_brand>>|key]]", "[[Category:<<CASE WHEN p_brand = 'Brand#1' THEN 'First brand' ELSE p_brand END>>|key]]").replace("[[Category:<<CASE", "[[<<CASE WHEN p_brand = 'Brand#1' THEN 'Category' ELSE 'category' END>>:<<CASE")))
def renamed_categories(s, d):
    f = wikitext.rewrite_udf(lambda t: wikitext.replace_category(t, "Brand#1", "First brand"))
    return _rewritten(s, d, F.coalesce(f(F.when(F.contains(F.lower("text"), F.lit("brand#1")), F.col("text"))), F.col("text")))


@query(_md5_of(file=f"<<CASE WHEN {K} % 40 = 6 THEN '[[File:Six.jpg|thumb|A [[caption]] here]]' ELSE '[[File:Part_' || CAST({K} % 40 AS STRING) || '.jpg|thumb|A [[caption]] here]]' END>>\n"))
def replaced_images(s, d):
    f = wikitext.rewrite_udf(lambda t: rewriting.replace_image(t, "Part 6.jpg", "Six.jpg"))
    return article(s, d).select("page_id", F.md5(F.when(F.col("page_id") == 6, F.replace("text", F.lit("Part_6.jpg"), F.lit("Six.jpg"))).otherwise(f("text"))).alias("h"))


@query(_md5_of(ref=f'Said so.<ref name="ref1">Book <<{K} % 20>>, p. 3</ref> Again.<ref name="ref1" />\n'))
def merged_references(s, d):
    return _rewritten(s, d, wikitext.rewrite_udf(wikitext.merged_references)("text"))


@query(_md5_of(table="{| border=1\n|-\n! a\n| b\n|}\n"))
def tables_as_wikitext(s, d):
    f = wikitext.rewrite_udf(wikitext.table_to_wiki)
    return _rewritten(s, d, F.coalesce(f(F.when(articles.has_html_table(F.col("text")), F.col("text"))), F.col("text")).alias("t"))


@query(_md5_of(isbn="ISBN 978-0-306-40615-7 and ISBN 978-3-12-578500-7.\n"))
def isbn_to_thirteen(s, d):
    from pageloom.functions import scalars

    f = wikitext.rewrite_udf(lambda t: scalars.rewrite_isbns(t, lambda n: scalars.COMMON_RANGES.hyphenated(scalars.thirteen(n))))
    return _rewritten(s, d, F.coalesce(f(F.when(F.contains("text", F.lit("ISBN ")), F.col("text"))), F.col("text")))


@query(_md5_of(category="", comment=PIECES["comment"][1]))
def without_live_categories(s, d):
    """Texts without their categories; those in comments stay."""
    return _rewritten(s, d, wikitext.rewrite_udf(wikitext.without_live_categories)("text"))


@query(_md5_of(german="", french="") + " WHERE p_partkey % 10 <> 1")
def without_language_links(s, d):
    f = wikitext.rewrite_udf(lambda t: wikitext.without_language_links(t, frozenset(LANGUAGES)) + "\n")
    return _rewritten(s, d, f("text")).filter("page_id % 10 <> 1")
