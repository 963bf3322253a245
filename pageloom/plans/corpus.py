"""Queries of problems 1 to 3 (deliveries, nested responses, timestamps) over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pageloom.operators.deliveries import first_deliveries, later_deliveries
from pageloom.operators.nested import FLAGS, child_table, flat_table, unreadable
from pageloom.operators.timestamps import day_text, normalised_instants
from pageloom.session import table


def utc_text(c: str) -> Column:
    """A timestamp as text, to compare equal whatever type a reader of the result gives it."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return later_deliveries(table(spark, d, "apispec"), columns=["delivery_no"])


def p1_first_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """The block records with each block once, all columns."""
    return first_deliveries(table(spark, d, "apispec")).withColumns({"flags": F.array_join("flags", ","), "received_at": utc_text("received_at")})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return flat_table(table(spark, d, "anefo"), "links")


def p2_responses(spark: SparkSession, d: str) -> DataFrame:
    return flat_table(table(spark, d, "anefo"), "responses")


def p2_documents(spark: SparkSession, d: str) -> DataFrame:
    return flat_table(table(spark, d, "anefo"), "documents").withColumns({c: F.col(c).cast("string") for c in FLAGS})


def p2_items(spark: SparkSession, d: str) -> DataFrame:
    return flat_table(table(spark, d, "anefo"), "items")


def p2_images(spark: SparkSession, d: str) -> DataFrame:
    return flat_table(table(spark, d, "anefo"), "images")


def p2_unreadable(spark: SparkSession, d: str) -> DataFrame:
    """Responses that give no rows, with the reason and the length of their text."""
    return unreadable(table(spark, d, "anefo")).select("req_id", "reason", F.length("raw").cast("bigint").alias("length"))


def p2_typed_files(spark: SparkSession, d: str) -> DataFrame:
    """Image files of the typed responses, by the column's own schema."""
    files = child_table(table(spark, d, "anefo"), "req_id", "response", "docs[].images[]")
    return files.select("req_id", F.col("pos_1").alias("doc_pos"), F.col("pos_3").alias("file_pos"), "url", "width", "height")


def _other_days(spark: SparkSession, d: str) -> DataFrame:
    docs = flat_table(table(spark, d, "anefo"), "documents").select("doc_id", "Datering")
    other = docs.filter(F.col("doc_id").isNotNull() & ~F.col("Datering").rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z")).distinct()
    return other.select(F.lit("anefo").alias("src"), F.lit("Datering").alias("field"), F.col("doc_id").alias("rec_id"), day_text("Datering").alias("norm"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    sites = table(spark, d, "wiki_site")
    blocks, images = table(spark, d, "apispec"), table(spark, d, "catimages")
    values = blocks.select(
        F.lit("apispec").alias("src"), F.col("delivery_no").cast("string").alias("rec_id"), "site",
        F.explode(F.create_map(F.lit("timestamp"), F.col("timestamp"), F.lit("expiry"), F.col("expiry"))).alias("field", "value"),
    ).unionByName(images.select(F.lit("catimages").alias("src"), F.col("hist_no").cast("string").alias("rec_id"), "site", F.lit("timestamp").alias("field"), F.col("timestamp").alias("value")))
    found = normalised_instants(values, F.col("value"), F.col("site"), sites, only_other_forms=True)
    return found.select("src", "field", "rec_id", "norm").unionByName(_other_days(spark, d)).filter("norm IS NOT NULL")


def p3_block_times(spark: SparkSession, d: str) -> DataFrame:
    """Every block record's time as one UTC timestamp, where it has one."""
    blocks = table(spark, d, "apispec").select("delivery_no", "site", F.col("timestamp").alias("written"))
    out = normalised_instants(blocks, F.col("written"), F.col("site"), table(spark, d, "wiki_site"))
    return out.select("delivery_no", F.to_timestamp("norm", "yyyy-MM-dd'T'HH:mm:ssX").alias("at"))


QUERIES = {f.__name__: f for f in (p1_found, p1_first_deliveries, p2_found, p2_responses, p2_documents, p2_items, p2_images, p2_unreadable, p2_typed_files, p3_found, p3_block_times)}

_BLOCK = r"""WITH d AS (SELECT *, regexp_extract(trim(id, E' \t\n\r'), '^[+]?0*([0-9]+)$', 1) AS k FROM apispec),
 r AS (SELECT *, CASE WHEN k IS NULL OR k = '' THEN 1 ELSE row_number() OVER (PARTITION BY k ORDER BY received_at, delivery_no) END AS n FROM d)"""

# JSON text in any of its shapes, opened once; the rest is JSON paths.
_RESP = r"""WITH a AS (SELECT req_id, CASE WHEN response IS NOT NULL THEN to_json(response) WHEN json_valid(raw) THEN CASE WHEN json_type(raw) = 'VARCHAR' THEN json_extract_string(raw, '$') ELSE raw END END AS j,
   CASE WHEN response IS NOT NULL THEN 'typed' ELSE 'raw' END AS origin FROM anefo),
 b AS (SELECT req_id, origin, j::JSON AS j FROM a WHERE json_valid(j)),
 r AS (SELECT req_id, origin, CASE WHEN origin = 'typed' THEN j ELSE coalesce(j->'result'->'response', j->'response') END AS r FROM b),
 dd AS (SELECT req_id, unnest(CASE json_type(r->'docs') WHEN 'ARRAY' THEN json_extract(r, '$.docs[*]') WHEN 'OBJECT' THEN [r->'docs'] ELSE CAST([] AS JSON[]) END) AS doc,
   unnest(range(CAST(CASE json_type(r->'docs') WHEN 'ARRAY' THEN json_array_length(r->'docs') WHEN 'OBJECT' THEN 1 ELSE 0 END AS BIGINT))) AS doc_pos FROM r),
 i AS (SELECT req_id, doc_pos, doc->>'id' AS doc_id, f.field AS field,
   unnest(CASE json_type(doc->f.field) WHEN 'ARRAY' THEN CAST(doc->f.field AS VARCHAR[]) WHEN 'VARCHAR' THEN [doc->>f.field] ELSE CAST([] AS VARCHAR[]) END) AS value,
   unnest(range(CAST(CASE json_type(doc->f.field) WHEN 'ARRAY' THEN json_array_length(doc->f.field) WHEN 'VARCHAR' THEN 1 ELSE 0 END AS BIGINT))) AS item_pos
   FROM dd, (VALUES ('Trefwoorden'), ('Geografisch_trefwoord'), ('Vervaardiger')) AS f(field))"""
_IMAGES = r""",
 k AS (SELECT req_id, doc_pos, doc->>'id' AS doc_id, doc->'images' AS im, unnest(json_keys(doc->'images')) AS image_key FROM dd WHERE json_type(doc->'images') = 'OBJECT'),
 kv AS (SELECT req_id, doc_pos, doc_id, image_key, json_extract(im, '$."' || image_key || '"') AS v FROM k
   UNION ALL SELECT req_id, doc_pos, doc_id, x->>'key', x->'files' FROM (SELECT req_id, doc_pos, doc->>'id' AS doc_id, unnest(json_extract(doc, '$.images[*]')) AS x FROM dd WHERE json_type(doc->'images') = 'ARRAY')),
 im AS (SELECT req_id, doc_pos, doc_id, image_key,
   unnest(CASE json_type(v) WHEN 'ARRAY' THEN json_extract(v, '$[*]') WHEN 'OBJECT' THEN [v] ELSE CAST([] AS JSON[]) END) AS f,
   unnest(range(CAST(CASE json_type(v) WHEN 'ARRAY' THEN json_array_length(v) WHEN 'OBJECT' THEN 1 ELSE 0 END AS BIGINT))) AS file_pos FROM kv)"""

SQL = {
    "p1_found": _BLOCK + " SELECT delivery_no FROM r WHERE n > 1",
    "p1_first_deliveries": _BLOCK + " SELECT * EXCLUDE (k, n) REPLACE (array_to_string(flags, ',') AS flags, strftime(received_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S.%f') AS received_at) FROM r WHERE n = 1",
    "p2_found": _RESP + _IMAGES + """
 SELECT req_id, '' AS doc_id, 'numFound' AS field, r->>'numFound' AS item FROM r WHERE r->>'numFound' IS NOT NULL
 UNION SELECT req_id, doc->>'id', 'docs', doc->>'id' FROM dd WHERE doc->>'id' <> ''
 UNION SELECT req_id, doc_id, field, value FROM i WHERE value <> ''
 UNION SELECT req_id, doc_id, 'images', f->>'url' FROM im WHERE f->>'url' <> ''""",
    "p2_responses": _RESP + """ SELECT req_id, CAST(r->>'numFound' AS BIGINT) AS num_found, CAST(r->>'start' AS BIGINT) AS start,
 CAST(CASE json_type(r->'docs') WHEN 'ARRAY' THEN json_array_length(r->'docs') WHEN 'OBJECT' THEN 1 ELSE 0 END AS INT) AS n_docs, origin FROM r WHERE r IS NOT NULL""",
    "p2_items": _RESP + " SELECT req_id, CAST(doc_pos AS INT) AS doc_pos, doc_id, field, CAST(item_pos AS INT) AS item_pos, value FROM i WHERE value <> ''",
    "p2_images": _RESP + _IMAGES + """ SELECT req_id, CAST(doc_pos AS INT) AS doc_pos, doc_id, image_key, CAST(file_pos AS INT) AS file_pos, f->>'url' AS url,
 CAST(f->>'width' AS BIGINT) AS width, CAST(f->>'height' AS BIGINT) AS height FROM im""",
    "p2_unreadable": _RESP + " SELECT req_id, CASE WHEN raw IS NULL THEN 'missing' ELSE 'unreadable' END AS reason, length(raw) AS length FROM anefo WHERE response IS NULL AND req_id NOT IN (SELECT req_id FROM r WHERE r IS NOT NULL)",
    "p2_typed_files": """WITH x AS (SELECT req_id, unnest(response.docs) AS doc, unnest(range(len(response.docs))) AS doc_pos FROM anefo WHERE response IS NOT NULL), m AS (SELECT req_id, doc_pos, unnest(map_values(doc.images)) AS files FROM x),
 f AS (SELECT req_id, doc_pos, unnest(files) AS f, unnest(range(len(files))) AS file_pos FROM m) SELECT req_id, CAST(doc_pos AS INT) AS doc_pos, CAST(file_pos AS INT) AS file_pos, f.url AS url, f.width AS width, f.height AS height FROM f""",
    "p2_documents": _RESP + " SELECT req_id, CAST(doc_pos AS INT) AS doc_pos, doc->>'id' AS doc_id, "
    + ", ".join(f"doc->>'{c}' AS {c if c != 'timestamp' else chr(34) + c + chr(34)}" for c in ("Titel", "Inhoud", "hdl", "oldid", "timestamp", "Datering", "Inhoudsdatering", "Nummer_toegang"))
    + ", " + ", ".join(f"doc->>'{c}' AS {c}" for c in ("auteursrechten_voorwaarde_CC_BY_SA", "auteursrechten_voorwaarde_webdisplay")) + " FROM dd",
}
