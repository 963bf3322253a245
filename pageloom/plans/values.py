"""Queries about values (dates, numbers, ISBNs, parameters, words), talk pages, dictionary pages, and sources
that are written to the shared folder and read again, each with the same question in SQL where SQL can put it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from pageloom.functions import dates, language, scalars, texts, threads, titles, wikitext
from pageloom.operators.timestamps import form, parsed_instants
from pageloom.session import shared_path, table
from pageloom.sources import dumps, sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


# ---- dates ------------------------------------------------------------------------------------

_ROMAN = "['" + "', '".join(dates._ROMANS) + "']"


def _sql_text(kind: str, lang: str) -> str:
    ordinal = "CAST(n AS VARCHAR) || CASE WHEN n % 100 BETWEEN 11 AND 13 THEN 'th' WHEN n % 10 = 1 THEN 'st' WHEN n % 10 = 2 THEN 'nd' WHEN n % 10 = 3 THEN 'rd' ELSE 'th' END"
    shown = {"%d": "CAST(n AS VARCHAR)", "%n": "CAST(n + 9 AS VARCHAR)", "%R": f"{_ROMAN}[n]", "%F": f"{_ROMAN}[n] || CASE WHEN n = 1 THEN 'er' ELSE 'e' END", "%o": ordinal, "%P": "translate(CAST(n AS VARCHAR), '0123456789', '۰۱۲۳۴۵۶۷۸۹')"}
    return " || ".join(f"({shown[p]})" if p in shown else "'" + p + "'" for p in dates._pieces(dates.PATTERNS[kind, lang]))


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, '{l}' AS lang, CAST(n AS INT) AS n, {_sql_text(k, l)} AS title, CAST(n AS INT) AS decoded FROM (SELECT unnest(range({dates.RANGES[k][0]}, {dates.RANGES[k][1] + 1}, {dates.RANGES[k][2]})) AS n)" for k, l in dates.PATTERNS))
def date_titles(s, d):
    """Every number of every family of date titles as text and back."""
    out = None
    for (k, l) in dates.PATTERNS:
        lo, hi, step = dates.RANGES[k]
        n = s.range(lo, hi + 1, step).select(F.lit(k).alias("kind"), F.lit(l).alias("lang"), F.col("id").cast("int").alias("n"))
        one = n.withColumn("title", dates.encode(k, l, F.col("n")))
        one = one.withColumn("decoded", dates.decode(k, l, F.col("title")))
        out = one if out is None else out.unionByName(one)
    return out


_DAYS = [(m, x) for m, n in enumerate([31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31], 1) for x in range(1, n + 1)]


def _day_sql(lang: str) -> str:
    names = "['" + "', '".join(dates.MONTHS[lang].split()) + "']"
    day = "CASE WHEN x = 1 THEN '1er' ELSE CAST(x AS VARCHAR) END" if lang == "fr" else "CAST(x AS VARCHAR)"
    text = dates.DAY_PATTERNS[lang]
    return " || ".join(f"{names}[m]" if p == "%B" else f"({day})" if p == "%d" else f"'{p}'" for p in __import__("re").split("(%[Bd])", text) if p)


@query("WITH m AS (SELECT unnest(range(1, 13)) AS m), y AS (SELECT m, unnest(range(1, 1 + [31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][m])) AS x FROM m) " + " UNION ALL ".join(f"SELECT '{l}' AS lang, CAST(m AS INT) AS month, CAST(x AS INT) AS day, {_day_sql(l)} AS title FROM y" for l in dates.DAY_PATTERNS))
def day_titles(s, d):
    """Titles of all days of the year."""
    y = s.range(1, 13).select(F.col("id").cast("int").alias("month"), F.explode(F.sequence(F.lit(1), F.lit(31))).alias("day"))
    out = None
    for l in dates.DAY_PATTERNS:
        one = y.select(F.lit(l).alias("lang"), "month", "day", dates.day_of_month(l, F.col("month"), F.col("day")).alias("title")).filter("title IS NOT NULL")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT DISTINCT month(o_orderdate) AS month, year(o_orderdate) AS year, ['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December'][month(o_orderdate)] || ' ' || CAST(year(o_orderdate) AS VARCHAR) AS en, ['enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', 'septiembre', 'octubre', 'noviembre', 'diciembre'][month(o_orderdate)] || ' de ' || CAST(year(o_orderdate) AS VARCHAR) AS es FROM orders")
def months_of_years(s, d):
    m = table(s, d, "orders").select(F.month("o_orderdate").alias("month"), F.year("o_orderdate").alias("year")).distinct()
    got = m.select("month", "year", dates.month_of_year("en", F.col("month"), F.col("year")).alias("en"), dates.month_of_year("es", F.col("month"), F.col("year")).alias("es"))
    return got.filter(dates.month_number("en", F.substring_index("en", " ", 1)) == F.col("month")).select(F.col("month").cast("bigint").alias("month"), F.col("year").cast("bigint").alias("year"), "en", "es")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST((((year(t2) * 12 + month(t2)) * 30 + day(t2)) * 24 + hour(t2)) * 60 + minute(t2) - ((((year(ts) * 12 + month(ts)) * 30 + day(ts)) * 24 + hour(ts)) * 60 + minute(ts)) AS BIGINT) AS minutes FROM (SELECT event_id, ts, ts + INTERVAL 40 DAY AS t2 FROM events)")
def rough_times(s, d):
    """Times as ISO text and back, and minutes by months of thirty days."""
    e = table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    back = texts.from_iso(texts.iso(F.col("ts")))
    return e.filter(back == F.date_trunc("second", "ts")).select("event_id", texts.iso(F.col("ts")).alias("iso"), texts.rough_minutes(F.col("ts"), F.col("ts") + F.expr("INTERVAL 40 DAYS")).alias("minutes"))


@query(r"""SELECT field, regexp_replace(regexp_replace(trim(value), '\pL+', 'A', 'g'), '[0-9]', '9', 'g') AS form, count(*) AS n FROM (SELECT 'timestamp' AS field, "timestamp" AS value FROM apispec UNION ALL SELECT 'expiry', expiry FROM apispec) WHERE value IS NOT NULL GROUP BY ALL""")
def p3_forms(s, d):
    """The forms in which times are written, and how often."""
    a = table(s, d, "apispec")
    v = a.select(F.lit("timestamp").alias("field"), F.col("timestamp").alias("value")).unionByName(a.select(F.lit("expiry").alias("field"), F.col("expiry").alias("value")))
    return v.filter("value IS NOT NULL").select("field", form(F.col("value")).alias("form")).groupBy("field", "form").agg(F.count("*").alias("n"))


@query()
def p3_status(s, d):
    """What became of the written times: parsed, ambiguous, no real time, no zone, or a form not understood."""
    a = table(s, d, "apispec").select("site", "timestamp")
    p = parsed_instants(a, F.col("timestamp"), F.col("site"), table(s, d, "wiki_site"))
    return p.groupBy(F.coalesce("parsed.status", F.lit("null")).alias("status")).agg(F.count("*").alias("n"), F.min("parsed.at").alias("first"), F.max("parsed.at").alias("last"))


# ---- ISBN and numbers -------------------------------------------------------------------------

_BODY = "lpad(CAST((100000000 + p_partkey * 7919) % 400000000 AS VARCHAR), 9, '0')"
_CHECK = " + ".join(f"CAST(substr(b, {i}, 1) AS INT) * {i}" for i in range(1, 10))


def _hyphen_sql() -> str:
    cases = []
    for group, ranges in scalars.COMMON_RANGES.groups.items():
        for lo, hi in ranges:
            k = 1 + len(lo)
            cases.append(f"WHEN substr(b, 1, 1) = '{group}' AND substr(b, 2, {len(lo)}) BETWEEN '{lo}' AND '{hi}' THEN '{group}-' || substr(b, 2, {len(lo)}) || '-' || substr(b, {k + 1}, {9 - k}) || '-' || c")
    return "CASE " + " ".join(cases) + " END"


@query(f"WITH k AS (SELECT p_partkey, {_BODY} AS b FROM part), x AS (SELECT *, CASE ({_CHECK}) % 11 WHEN 10 THEN 'X' ELSE CAST(({_CHECK}) % 11 AS VARCHAR) END AS c FROM k) SELECT p_partkey, b || c AS isbn, {_hyphen_sql()} AS hyphenated FROM x")
def isbn_hyphens(s, d):
    """ISBNs with their hyphens, by publishers' ranges."""
    b = F.lpad(((100000000 + F.col("p_partkey") * 7919) % 400000000).cast("string"), 9, "0")
    t = table(s, d, "part").select("p_partkey", b.alias("b"))
    c = scalars._weighted(F.col("b"), list(range(1, 10))) % 11
    t = t.select("p_partkey", F.concat("b", F.when(c == 10, "X").otherwise(c.cast("string"))).alias("isbn"))
    f = wikitext.rewrite_udf(scalars.COMMON_RANGES.hyphenated)
    return t.select("p_partkey", "isbn", f("isbn").alias("hyphenated"))


@query(f"SELECT CAST(n AS INT) AS n, {_ROMAN}[n] AS roman, CAST(n AS INT) AS back, translate(CAST(n * 137 AS VARCHAR), '0123456789', '۰۱۲۳۴۵۶۷۸۹') AS persian, CAST(n * 137 AS INT) AS number FROM (SELECT unnest(range(1, 31)) AS n)")
def written_numbers(s, d):
    """Roman and Persian numbers and back."""
    n = s.range(1, 31).select(F.col("id").cast("int").alias("n"))
    r = n.withColumns({"roman": dates.roman_text(F.col("n")), "persian": dates.persian_digits((F.col("n") * 137).cast("string"))})
    return r.withColumns({"back": dates.roman_number(F.col("roman")), "number": dates.latin_digits(F.col("persian")).cast("int")})


_XS = [("cx", "ĉ"), ("gx", "ĝ"), ("sx", "ŝ"), ("ux", "ŭ")]


@query("SELECT CAST(p_partkey AS BIGINT) AS page_id, 'ĉu ' || p_name || ' ŝajnas ŭo ' || CAST(p_partkey AS VARCHAR) AS read, 'cxu ' || p_name || ' sxajnas uxo ' || CAST(p_partkey AS VARCHAR) AS written FROM part")
def esperanto_texts(s, d):
    t = table(s, d, "part").select(F.col("p_partkey").cast("bigint").alias("page_id"), F.concat(F.lit("cxu "), "p_name", F.lit(" sxajnas uxo "), F.col("p_partkey").cast("string")).alias("w"))
    read, write = wikitext.rewrite_udf(scalars.esperanto_decode), wikitext.rewrite_udf(scalars.esperanto_encode)
    return t.withColumn("read", read("w")).select("page_id", "read", write("read").alias("written"))


# ---- parameters, URLs, words ------------------------------------------------------------------


@query("""WITH a AS (SELECT rec_no, string_split(coalesce(author, ''), ' | ') AS l, "set" AS st FROM csv_ingestion) SELECT rec_no, CASE WHEN len(list_filter(l, lambda x: contains(x, '|'))) = 0 THEN array_to_string(l, '|') END AS param, CASE WHEN st IS NULL THEN 0 ELSE 1 END AS listed FROM a""")
def list_params(s, d):
    a = table(s, d, "csv_ingestion").select("rec_no", F.split(F.coalesce("author", F.lit("")), r" \| ").alias("l"), "set")
    return a.select("rec_no", texts.list_to_param(F.col("l")).alias("param"), F.size(texts.as_list(F.col("set"))).alias("listed"))


@query("""SELECT p_partkey, 'a=' || p_name || CASE WHEN p_partkey % 2 = 0 THEN '|' || p_brand ELSE '' END || ';b=' || p_type || CASE WHEN p_partkey % 2 = 1 THEN ';c=' || p_brand ELSE '' END AS params FROM part""")
def combined_params(s, d):
    """Two maps of parameters in one."""
    p = table(s, d, "part")
    a = F.create_map(F.lit("a"), F.col("p_name"), F.lit("b"), F.col("p_type"))
    b = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("a"), F.col("p_brand"))).otherwise(F.create_map(F.lit("c"), F.col("p_brand")))
    entries = F.array_sort(F.map_entries(texts.combined_params(a, b)))
    return p.select("p_partkey", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("params"))


@query("""SELECT p_partkey, p_name AS url, CASE WHEN p_partkey % 3 = 0 THEN 'last' ELSE p_brand END AS value, 2 AS n FROM part""")
def settings_blocks(s, d):
    """|key=value lines of a text as a map."""
    t = F.concat(F.lit("<pre>\n|url= "), "p_name", F.lit(" \n|value="), "p_brand", F.when(F.col("p_partkey") % 3 == 0, "\n|value =last").otherwise(""), F.lit("\n</pre>"))
    p = table(s, d, "part").select("p_partkey", texts.settings_of(t).alias("m"))
    return p.select("p_partkey", F.col("m")["url"].alias("url"), F.col("m")["value"].alias("value"), F.size("m").alias("n"))


@query("""SELECT rec_no, regexp_replace(url, '^[a-z]+://', '') AS short, trim(split_part(author, '|', 1)) AS first_author FROM csv_ingestion WHERE url IS NOT NULL AND author IS NOT NULL""")
def short_urls(s, d):
    c = table(s, d, "csv_ingestion").filter("url IS NOT NULL AND author IS NOT NULL")
    return c.select("rec_no", texts.without_scheme(F.col("url")).alias("short"), texts.before_bar(F.col("author")).alias("first_author"))


@query("""SELECT page_id, title, url_decode(url_encode(title)) AS decoded FROM pagelist""")
def url_titles(s, d):
    """Titles as parts of URLs and back."""
    p = table(s, d, "pagelist").select("page_id", "title", titles.url_name(F.col("title")).alias("u"))
    return p.select("page_id", "title", texts.url_title(F.col("u")).alias("decoded"))


@query("""SELECT page_id, 'https://wiki.example.org/w/index.php?title=' || replace(replace(url_encode(replace(title, ' ', '_')), '%3A', ':'), '%20', '+') || '&oldid=' || CAST(page_id * 7 AS VARCHAR) AS url FROM pagelist WHERE regexp_matches(title, '^[A-Za-z0-9 ]+$')""")
def permalinks(s, d):
    p = table(s, d, "pagelist").filter(F.col("title").rlike("^[A-Za-z0-9 ]+$"))
    return p.select("page_id", texts.permalink("https://wiki.example.org/w/index.php", F.col("title"), F.col("page_id") * 7).alias("url"))


@query("""WITH w AS (SELECT page_id, string_split(title, ' ') AS p FROM pagelist) SELECT page_id, array_to_string(p[1:2], ' ') AS first_piece, CAST(ceil(len(p) / 2) AS INT) AS pieces, CASE WHEN len(p) > 2 THEN CAST(length(array_to_string(p[1:2], ' ')) + 1 AS INT) ELSE 0 END AS second_space FROM w""")
def pieces_of_titles(s, d):
    """Titles cut at every second space, and where the second space is."""
    p = table(s, d, "pagelist").select("page_id", texts.split_every(F.col("title"), " ", 2).alias("p"), texts.place_of(F.col("title"), " ", 2).alias("second_space"))
    return p.select("page_id", F.col("p")[0].alias("first_piece"), F.size("p").alias("pieces"), "second_space")


_WORDS = r"SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda w: w <> '')) AS word FROM"


@query(f"""WITH n AS (SELECT word, count(*) AS n FROM ({_WORDS} documents WHERE text IS NOT NULL) GROUP BY word), k AS (SELECT DISTINCT word FROM ({_WORDS} subject_item) UNION SELECT DISTINCT word FROM ({_WORDS} eval_item)) SELECT word, n FROM n WHERE word NOT IN (SELECT word FROM k)""")
def unknown_words(s, d):
    """Words of all texts that a dictionary lacks, with their numbers."""
    known = table(s, d, "subject_item").select("text").unionByName(table(s, d, "eval_item").select("text")).select(F.explode(texts.words(F.col("text"))).alias("word"))
    return texts.unknown_words(table(s, d, "documents").filter("text IS NOT NULL"), known)


@query("""SELECT DISTINCT p_name, p_brand, CASE WHEN p_brand LIKE '%1%' THEN upper(p_name) WHEN p_brand LIKE '%2%' THEN upper(substr(p_name, 1, 1)) || substr(p_name, 2) ELSE p_name END AS cased FROM part""")
def cased_words(s, d):
    """Corrections in the case of the word they stand for."""
    like = F.when(F.contains("p_brand", F.lit("1")), "WORD").when(F.contains("p_brand", F.lit("2")), "Word").otherwise("word")
    return table(s, d, "part").select("p_name", "p_brand", texts.as_written(F.col("p_name"), like).alias("cased")).distinct()


@query("""WITH l AS (SELECT CAST(floor(p_partkey / 10) AS BIGINT) AS page, p_partkey % 10 AS line, CASE WHEN p_partkey % 10 IN (0, 4, 7) THEN p_size END AS age FROM part), f AS (SELECT page, line, last_value(age IGNORE NULLS) OVER (PARTITION BY page ORDER BY line ROWS UNBOUNDED PRECEDING) AS age FROM l) SELECT page, CAST(line AS INT) AS line, CAST(age AS INT) AS age FROM f WHERE age <= 25""")
def recent_lines(s, d):
    """Lines of dated blocks that are not too old; lines without a date have that of the line above."""
    k = F.col("p_partkey")
    l = table(s, d, "part").select(F.floor(k / 10).alias("page"), (k % 10).cast("int").alias("line"), F.when((k % 10).isin(0, 4, 7), F.col("p_size")).cast("int").alias("own"))
    return texts.filled_down(l, "page", "line", "own", "age").filter("age <= 25").select("page", "line", "age")


@query("""WITH n AS (SELECT title, row_number() OVER (ORDER BY title) AS n FROM pagelist) SELECT title, n, n % 100 = 0 AS split FROM n""")
def split_markers(s, d):
    """A mark after each hundredth title."""
    from pageloom.operators.records import numbered

    return numbered(table(s, d, "pagelist").select("title"), F.col("title")).withColumn("split", F.col("n") % 100 == 0)


# ---- ingestion --------------------------------------------------------------------------------


@query(r"""WITH c AS (SELECT rec_no, url, coalesce(name, '') AS name, coalesce("set", '') AS st, regexp_extract(url, '\.([^./]*)$', 1) AS ext, author, license FROM csv_ingestion WHERE url IS NOT NULL AND author IS NOT NULL AND license IS NOT NULL)
 SELECT rec_no, name || ' - ' || st || '.' || ext AS title, '{{Photo' || chr(10) || '|author=' || replace(author, '|', '{{!}}') || chr(10) || '|license=' || replace(license, '|', '{{!}}') || chr(10) || '}}' AS description FROM c""")
def ingested_pages(s, d):
    """Page titles and descriptions of picture records."""
    c = table(s, d, "csv_ingestion").filter("url IS NOT NULL AND author IS NOT NULL AND license IS NOT NULL")
    meta = F.create_map(*[x for k in ("name", "set") for x in (F.lit(k), F.coalesce(k, F.lit("")))])
    p = dumps.with_derived(c.select("rec_no", "url", "author", "license", meta.alias("metadata")))
    own = F.create_map(F.lit("author"), F.col("author"), F.lit("license"), F.col("license"))
    return p.select("rec_no", dumps.formatted("%(name)s - %(set)s.%(_ext)s", F.col("metadata")).alias("title"), dumps.description("Photo", own).alias("description"))


# ---- dumps ------------------------------------------------------------------------------------

def _dump(s, d) -> str:
    """An export of generated pages in the shared folder, written as XML."""
    path, k = shared_path(s, "dump"), F.col("p_partkey").cast("bigint")
    none = F.lit(None).cast("string")

    def revision(rid, at, ip, name, uid, minor, comment, text):
        who = F.struct(ip.alias("ip"), name.alias("username"), uid.cast("bigint").alias("id"))
        return F.struct(rid.alias("id"), F.lit(at).alias("timestamp"), who.alias("contributor"), minor.alias("minor"), comment.alias("comment"), F.struct(text.alias("_VALUE"), F.lit("preserve").alias("_space")).alias("text"))

    first = revision(k * 10, "2010-01-02T03:04:05Z", F.lit("192.0.2.1"), none, none, none, F.lit("one"), F.concat(F.lit("First of [["), "p_brand", F.lit("]] & more")))
    second = revision(k * 10 + 1, "2011-01-02T03:04:05Z", none, F.col("p_type"), F.lit("7"), F.lit(""), none, F.lit("#REDIRECT [[Other page]]"))
    pages = table(s, d, "part").select(
        F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("title"), F.lit(0).alias("ns"), k.alias("id"), F.when(k % 6 == 0, "edit=sysop:move=autoconfirmed").alias("restrictions"),
        F.when(k % 5 == 1, F.struct(F.lit("x").alias("_title"))).alias("redirect"), F.when(k % 2 == 0, F.array(first, second)).otherwise(F.array(first)).alias("revision"),
    )
    pages.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(path)
    return path


@query("""WITH r AS (SELECT *, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS title FROM part) SELECT title, CAST(p_partkey AS BIGINT) AS page_id, CAST(p_partkey * 10 AS BIGINT) AS revisionid, 'First of [[' || p_brand || ']] & more' AS text, '192.0.2.1' AS username, TRUE AS ipedit, '2010-01-02 03:04:05' AS at, CASE WHEN p_partkey % 6 = 0 THEN 'sysop' END AS edit_restriction, CASE WHEN p_partkey % 6 = 0 THEN 'autoconfirmed' END AS move_restriction, p_partkey % 5 = 1 AS isredirect, 0 AS seq FROM r
 UNION ALL SELECT title, CAST(p_partkey AS BIGINT), CAST(p_partkey * 10 + 1 AS BIGINT), '#REDIRECT [[Other page]]', p_type, FALSE, '2011-01-02 03:04:05', CASE WHEN p_partkey % 6 = 0 THEN 'sysop' END, CASE WHEN p_partkey % 6 = 0 THEN 'autoconfirmed' END, TRUE, 1 FROM r WHERE p_partkey % 2 = 0""")
def dump_revisions(s, d):
    """All revisions of an XML export."""
    r = dumps.xml_dump(s, _dump(s, d), all_revisions=True)
    return r.select("title", "page_id", "revisionid", "text", "username", "ipedit", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), "edit_restriction", "move_restriction", "isredirect", "seq")


@query("""SELECT p_name || ' ' || CAST(p_partkey AS VARCHAR) AS title, CAST(p_partkey * 10 AS BIGINT) AS revisionid FROM part""")
def dump_first_revisions(s, d):
    return dumps.xml_dump(s, _dump(s, d)).select("title", "revisionid")


@query("""SELECT p_name || ' ' || CAST(p_partkey AS VARCHAR) AS title, 'Other page' AS target FROM part WHERE p_partkey % 2 = 0""")
def dump_redirects(s, d):
    return dumps.redirects_of(dumps.xml_dump(s, _dump(s, d), all_revisions=True))


@query("""SELECT p_name || ' ' || CAST(p_partkey AS VARCHAR) AS title FROM part WHERE p_name || ' ' || CAST(p_partkey AS VARCHAR) >= 'red' AND p_brand LIKE '%1%'""")
def dump_pages_from(s, d):
    """Pages of an export from a title on whose text holds something."""
    r = dumps.xml_dump(s, _dump(s, d))
    return r.filter((F.col("title") >= "red") & F.col("text").rlike(r"\[\[Brand#\d*1\d*\]\]")).select("title")


@query("""SELECT p_name || ' ' || CAST(p_partkey AS VARCHAR) AS title, 'Size ' || CAST(p_size AS VARCHAR) AS line FROM part""")
def pages_from_marked_files(s, d):
    """Pages written with markers and read again."""
    p = table(s, d, "part").select(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("title"), F.concat(F.lit("Size "), F.col("p_size").cast("string")).alias("text"))
    path = shared_path(s, "marked")
    sinks.marked_pages(p).write.text(path)
    got = dumps.pages_in_text(s, path)
    return got.select("title", F.regexp_extract("contents", r"(Size \d+)", 1).alias("line"))


@query("""SELECT DISTINCT p_name AS title FROM part""")
def titles_from_files(s, d):
    path = shared_path(s, "titles")
    table(s, d, "part").select(F.concat(F.lit("* [[:"), "p_name", F.lit("|x]] text")).alias("value")).write.text(path)
    return dumps.titles_in_text(s, path).select(F.regexp_replace("title", "^:", "").alias("title")).distinct()


@query("""SELECT p_name AS page, CASE WHEN p_partkey % 2 = 0 THEN 'add' ELSE 'remove' END AS action, 'de' AS lang, 'Teil ' || CAST(p_partkey AS VARCHAR) AS title FROM part""")
def hints_from_warnings(s, d):
    path = shared_path(s, "log")
    line = F.concat(F.lit("WARNING: [[en:"), "p_name", F.lit("]] "), F.when(F.col("p_partkey") % 2 == 0, "does not link to").otherwise("links to incorrect"), F.lit(" [[de:Teil "), F.col("p_partkey").cast("string"), F.lit("]]"))
    table(s, d, "part").select(line.alias("value")).write.text(path)
    return dumps.hints_in_log(s, path)


@query("""SELECT n_name AS category, count(*) AS members, CAST(sum(length('* [[:' || c_name || ']]') + 1) AS BIGINT) - 1 AS length FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def category_listings(s, d):
    """Listings of categories in parts, put together again by their lengths."""
    m = table(s, d, "customer").join(F.broadcast(table(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("category"), F.col("c_name").alias("title"))
    parts = sinks.category_listing(m, part_rows=20)
    return parts.groupBy("category").agg(F.sum(F.size(F.split("text", "\n"))).cast("bigint").alias("members"), (F.sum(F.length("text") + 1) - 1).alias("length"))


# ---- talk pages -------------------------------------------------------------------------------

_STAMPS = [("10:15, 3 January 2012 (UTC)", 1), ("23:59, 30 June 2012 (UTC)", 2), ("08:00, 1 March 2013 (UTC)", 3)]


def _talk(s, d) -> DataFrame:
    """Talk pages with a header and threads, planted from customers."""
    k, text = F.col("c_custkey"), F.lit("{{Archive|algo=old(90d)|counter=3}}\nHello.\n")
    for i, (stamp, m) in enumerate(_STAMPS):
        text = F.concat(text, F.when(k % (m + 1) == 0, F.lit(f"== Topic {i} ==\nQuestion. [[User:A]] 09:00, 1 January 2012 (UTC)\n:Answer. [[User:B]] {stamp}\n")).otherwise(""))
    return table(s, d, "customer").select(k.cast("bigint").alias("page_id"), text.alias("text"))


_LASTS = ["2012-01-03 10:15:00", "2012-06-30 23:59:00", "2013-03-01 08:00:00"]


@query(" UNION ALL ".join(f"SELECT CAST(c_custkey AS BIGINT) AS page_id, 'Topic {i}' AS topic, '{_LASTS[i]}' AS last_post, {'TRUE' if i < 2 else 'FALSE'} AS old FROM customer WHERE c_custkey % {m + 1} = 0" for i, (_, m) in enumerate(_STAMPS)))
def talk_threads(s, d):
    """Threads with their last post, and whether they are older than half a year."""
    from datetime import datetime, timedelta

    kind = T.ArrayType(T.StructType([T.StructField("topic", T.StringType()), T.StructField("last_post", T.StringType()), T.StructField("old", T.BooleanType())]))
    f = threads.threads_udf(kind, datetime(2013, 3, 2), timedelta(days=180))
    return _talk(s, d).select("page_id", F.inline(f("text")))


@query("SELECT CAST(c_custkey AS BIGINT) AS page_id, CAST(CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS INT) AS moved, '{{Archive|algo=old(90d)|counter=3}}' || chr(10) || 'Hello.' || CASE WHEN c_custkey % 4 = 0 THEN chr(10) || '== Topic 2 ==' || chr(10) || 'Question. [[User:A]] 09:00, 1 January 2012 (UTC)' || chr(10) || ':Answer. [[User:B]] 08:00, 1 March 2013 (UTC)' ELSE '' END AS rest, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 = 0 THEN 'Archive 3' END AS archive FROM customer")
def archived_talk_pages(s, d):
    """Talk pages without their old threads, and the archive that their settings name."""
    from datetime import datetime

    kind = T.StructType([T.StructField("moved", T.IntegerType()), T.StructField("rest", T.StringType()), T.StructField("archive", T.StringType())])
    return _talk(s, d).select("page_id", threads.archiving_udf(kind, datetime(2013, 3, 2))("text").alias("a")).select("page_id", "a.moved", "a.rest", "a.archive")


# ---- dictionary pages -------------------------------------------------------------------------


@query("""SELECT CAST(p_partkey AS BIGINT) AS page_id, 'en' AS language, 'noun' AS part_of_speech, NULL AS section, 'A kind of ' || p_type AS line FROM part UNION ALL SELECT CAST(p_partkey AS BIGINT), 'en', 'noun', 'translations', 'nl:ding:n' FROM part WHERE p_partkey % 2 = 0
 UNION ALL SELECT CAST(p_partkey AS BIGINT), 'nl', 'verb', NULL, 'to ' || p_name FROM part WHERE p_partkey % 3 = 0""")
def dictionary_entries(s, d):
    """Entries of dictionary pages: language, part of speech, meaning, translations."""
    from pageloom.functions import dictionary

    k = F.col("p_partkey")
    text = F.concat(F.lit("== English ==\n=== Noun ===\n# A kind of "), "p_type", F.lit("\n"), F.when(k % 2 == 0, "==== Translations ====\n* Dutch: [[ding]] {{n}}\n").otherwise(""), F.when(k % 3 == 0, F.concat(F.lit("== Dutch ==\n=== Verb ===\n# to "), "p_name", F.lit("\n"))).otherwise(""))
    t = table(s, d, "part").select(k.cast("bigint").alias("page_id"), text.alias("text"))
    e = t.select("page_id", F.inline(dictionary.entries_of("text")))
    return e.select("page_id", "language", "part_of_speech", "section", F.coalesce(F.col("definitions")[0], F.concat_ws(":", "term_language", "term", "gender")).alias("line"))


# ---- languages --------------------------------------------------------------------------------

@query("SELECT n, CASE WHEN n = 1 THEN CAST(n AS VARCHAR) || ' page' ELSE CAST(n AS VARCHAR) || ' pages' END AS en, CASE WHEN n < 2 THEN CAST(n AS VARCHAR) || ' article' ELSE CAST(n AS VARCHAR) || ' articles' END AS fr FROM (SELECT unnest(range(0, 200)) AS n)")
def plural_messages(s, d):
    """Messages with the plural form of their language."""
    messages = {"en": "%(n)s {{PLURAL:n|page|pages}}", "fr": "%(n)s {{PLURAL:n|article|articles}}"}
    f = {l: wikitext.rewrite_udf(lambda v, l=l: language.translated(messages, l, n=v)) for l in messages}
    return s.range(200).select(F.col("id").alias("n"), *[f[l](F.col("id").cast("string")).alias(l) for l in messages])


# ---- rules and small parsers ------------------------------------------------------------------


@query("SELECT p_partkey, 'See File:' || p_name || '.jpg, Category talk:x and {{ns:99}} or {{n:6}}' AS text FROM part")
def namespace_words(s, d):
    t = F.concat(F.lit("See {{ns:6}}:"), "p_name", F.lit(".jpg, {{NS:category_talk}}:x and {{ns:99}} or {{n:6}}"))
    return table(s, d, "part").select("p_partkey", titles.expand_namespace_words(t).alias("text"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'de:' || p_name WHEN 1 THEN 'wiktionary:be-x-old:' || p_name ELSE 'x:' || p_name END AS link FROM part")
def database_links(s, d):
    k = F.col("p_partkey") % 3
    t = F.concat(F.when(k == 0, "dewiki:").when(k == 1, "be_x_oldwiktionary:").otherwise("x:"), "p_name")
    return table(s, d, "part").select("p_partkey", titles.from_database_name(t).alias("link"))


@query("SELECT rec_no, contains(url, 'files.') OR contains(url, '.svg') AS excluded FROM csv_ingestion WHERE url IS NOT NULL")
def excluded_urls(s, d):
    return table(s, d, "csv_ingestion").filter("url IS NOT NULL").select("rec_no", texts.holds_any(F.col("url"), ["files.", ".svg"]).alias("excluded"))


@query("SELECT page_id, len(string_split(title, ',')) < 3 AND length(regexp_replace(title, '[^0-9]', '', 'g')) * 2 < length(title) AS worth FROM pagelist")
def searched_titles(s, d):
    return table(s, d, "pagelist").select("page_id", texts.worth_searching(F.col("title")).alias("worth"))


@query("SELECT CAST(c_custkey AS BIGINT) AS page_id, c_name AS user_name, 'Page ' || CAST(c_custkey % 9 AS VARCHAR) AS page FROM customer UNION ALL SELECT CAST(c_custkey AS BIGINT), c_name, 'Other' FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT CAST(c_custkey AS BIGINT), 'Second', 'Last' FROM customer")
def whitelist_pages(s, d):
    """Users and their pages on whitelist pages."""
    k = F.col("c_custkey")
    t = F.concat(F.lit("Intro [[No one]]\n* [[User:"), "c_name", F.lit("|x]]: [[Page "), (k % 9).cast("string"), F.lit("]]\n"), F.when(k % 2 == 0, "** [[Other|o]]\n").otherwise(""), F.lit("*[[Special:Contributions/Second]]\n**[[Last]]"))
    return table(s, d, "customer").select(k.cast("bigint").alias("page_id"), F.inline(texts.listed_users(t))).select("page_id", F.col("user").alias("user_name"), "page")


@query("SELECT p_partkey, repeat('@', CAST(p_partkey % 4 AS INT) + 1) AS marker FROM part")
def free_markers(s, d):
    return table(s, d, "part").select("p_partkey", texts.free_marker(F.concat("p_name", F.expr("repeat('@', CAST(p_partkey % 4 AS INT))"))).alias("marker"))


@query("SELECT 0 AS ns, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS title FROM part WHERE p_size > 45")
def pages_by_sql(s, d):
    """Pages by a SQL text over named tables."""
    from pageloom.plans.generators import pages_of_sql

    return pages_of_sql({"part": table(s, d, "part")}, "SELECT 0 AS ns, p_name || ' ' || CAST(p_partkey AS STRING) AS title FROM {part} WHERE p_size > 45")
