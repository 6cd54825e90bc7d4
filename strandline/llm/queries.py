"""The registered queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import p1_repeated_lines as p1
from strandline.llm import p2_oversized as p2
from strandline.llm import p3_language as p3
from strandline.llm import p4_sentences as p4
from strandline.llm import p5_contributor_cap as p5
from strandline.llm import p6_truncated as p6
from strandline.llm import p7_boilerplate as p7
from strandline.llm import p8_packing as p8
from strandline.llm import p9_leakage as p9
from strandline.llm import p10_reading_level as p10
from strandline.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1.repeated_lines(table(spark, sf_dir, "rag_document"), table(spark, sf_dir, "raw_docs"))


def p1_clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1.without_repeated_lines(table(spark, sf_dir, "rag_document"), p1_found(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pieces(spark, sf_dir).select("doc_id", "field", "item_no", "cut").distinct()


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2.split_oversized(table(spark, sf_dir, "rag_document"))


def _language_model(spark: SparkSession, sf_dir: str) -> p3.Model:
    known = table(spark, sf_dir, "reading_items").select("lang", "text").unionByName(table(spark, sf_dir, "eval_items").select("lang", "text"))
    return p3.train(known, table(spark, sf_dir, "documents"))


def p3_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3.languages(table(spark, sf_dir, "rag_document"), _language_model(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3.mislabelled(p3_languages(spark, sf_dir), table(spark, sf_dir, "raw_docs"))


def p4_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    snippets = table(spark, sf_dir, "snippet_docs").select(F.lit("snippet_docs").alias("tbl"), "doc_id", F.col("text_snippet").alias("text"))
    texts = snippets.unionByName(table(spark, sf_dir, "rag_document").select(F.lit("rag_document").alias("tbl"), "doc_id", "text"))
    return p4.sentences(texts, p4.learn_edges(texts))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_sentences(spark, sf_dir).select("tbl", "doc_id", "end_char").distinct()


def p5_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5.capped(table(spark, sf_dir, "raw_docs"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_verdicts(spark, sf_dir).where("not keep").select("doc_id").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6.truncated(table(spark, sf_dir, "rag_document")).where("cut").select("doc_id")


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6.truncation_rates(p6.truncated(table(spark, sf_dir, "rag_document")), table(spark, sf_dir, "raw_docs"))


def p7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7.page_lines(table(spark, sf_dir, "rag_document"), table(spark, sf_dir, "raw_docs"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_lines(spark, sf_dir).where("not main").select("doc_id", "field", "line_no")


def p7_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7.main_bodies(table(spark, sf_dir, "rag_document"), p7_lines(spark, sf_dir))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8.containers(table(spark, sf_dir, "documents"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8.fill(p8_containers(spark, sf_dir))


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_leaks(spark, sf_dir).where("kind <> 'near'").select("doc_id", "item_id").distinct()


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    grader = p10.train(table(spark, sf_dir, "reading_items"))
    return p10.reading_levels(table(spark, sf_dir, "documents"), grader).select("doc_id", "reading_level").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query; ``pN_found`` has the columns TESTDATA.md gives."""
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:].split("_")[0].isdigit() and callable(f)}


P1_SQL = r"""
WITH src AS (SELECT DISTINCT doc_id, lower(trim(regexp_replace(source_name, '\s+', ' ', 'g'))) AS source FROM raw_docs WHERE source_name IS NOT NULL),
docs AS (SELECT DISTINCT doc_id, text FROM rag_document WHERE text IS NOT NULL),
ln AS (SELECT d.doc_id, s.source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM docs d JOIN src s USING (doc_id)),
k AS (SELECT *, lower(regexp_replace(line, '[^\p{L}\p{M}]+', '', 'g')) AS bare FROM ln),
n AS (SELECT source, count(DISTINCT doc_id) AS docs FROM ln GROUP BY 1),
hit AS (SELECT source, bare FROM k JOIN n USING (source) WHERE regexp_matches(bare, '\p{L}') GROUP BY source, bare, docs HAVING count(DISTINCT doc_id) >= 4 AND count(DISTINCT doc_id) * 100 >= 5 * docs)
SELECT DISTINCT doc_id, CAST(line_no AS INTEGER) AS line_no FROM k JOIN hit USING (source, bare)
"""

P2_SQL = r"""
WITH item AS (
SELECT doc_id, 'text' AS field, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS item_no, unnest(string_split(text, chr(10))) AS item FROM rag_document
UNION
SELECT doc_id, 'paragraphs', CAST(generate_subscripts(paragraphs, 1) AS INTEGER), unnest(paragraphs).text FROM rag_document)
SELECT DISTINCT doc_id, field, item_no, CASE WHEN list_max(list_transform(regexp_split_to_array(item, '[\s\p{Z}\p{P}]'), lambda x: length(x))) > 900 THEN 'forced' ELSE 'natural' END AS cut FROM item WHERE length(item) > 900
"""

P5_SQL = r"""
WITH r AS (SELECT coalesce(nullif(upper(trim(country)), ''), 'UNKNOWN') AS country, lower(trim(regexp_replace(source_name, '\s+', ' ', 'g'))) AS source, doc_id, max(coalesce(score, 0)) AS score FROM raw_docs GROUP BY 1, 2, 3),
c AS (SELECT country, greatest(1, count(DISTINCT doc_id) * 15 // 100) AS cap FROM r GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY country, source ORDER BY score DESC, doc_id) AS rank FROM r)
SELECT DISTINCT doc_id FROM k JOIN c USING (country) WHERE rank > cap
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB's equivalents of the queries that SQL can express."""
    return {"p1_found": P1_SQL, "p2_found": P2_SQL, "p5_found": P5_SQL}
