"""Passages and their grounding: paragraphs, snippets, topic gates, terms, citations, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import fixed, passages, text
from strandline.functions.keys import country_key
from strandline.operators.dedup import last_by
from strandline.plans.claims import _OVERLAP, QUESTION, TEXT_QUOTES, numbered_quotes
from strandline.sources.tables import table

def corrected(original: Column, translation: Column, rules: tuple = fixed.TERM_RULES) -> Column:
    """The translation with known mistranslations of the original's terms replaced."""
    return corrections(original, translation, rules)["text"]


def corrections(original: Column, translation: Column, rules: tuple = fixed.TERM_RULES) -> Column:
    """(text, terms): the translation with known wrong forms replaced, each only if the original holds its term,
    and the terms whose wrong form was there."""
    low, out, used = F.lower(original), translation, []
    for words, wrong, right in rules:
        term = F.coalesce(*[F.when(F.contains(low, F.lower(F.lit(w))), w) for w in words])
        applies = F.coalesce(term.isNotNull() & F.regexp_like(out, F.lit(wrong)), F.lit(False))
        used.append(F.when(applies, term))
        out = F.when(applies, F.regexp_replace(out, wrong, right)).otherwise(out)
    return F.struct(out.alias("text"), F.array_compact(F.array(*used)).alias("terms"))


def script_label(language: Column, country: Column) -> Column:
    """How a language is labelled for readers: Chinese by the place, other languages by their name, unknown ones as they are."""
    chinese = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in fixed.CHINESE_LABELS.items() for x in kv]), country), F.lit(fixed.CHINESE_LABEL))
    names = F.create_map(*[F.lit(x) for kv in fixed.SCRIPT_LABELS.items() for x in kv])
    return F.when(language == "zh", chinese).otherwise(F.coalesce(F.try_element_at(names, language), language, F.lit("")))


def route(question: Column, routes: tuple = fixed.TOPIC_ROUTES) -> Column:
    """The prepared topic a question is about, null for none."""
    return F.coalesce(*[F.when(F.regexp_like(question, F.lit(f"(?i){pattern}")), name) for name, pattern in routes])


def rebound(body: Column, old: Column, new: Column) -> Column:
    """``body`` with the id ``old`` replaced by ``new`` where it stands as a whole token."""
    return F.regexp_replace(body, F.concat(F.lit(r"(?<![\w-])\Q"), old, F.lit(r"\E(?![\w-])")), new)


def rebound_values(value: Column, ids: dict[str, str], schema: str) -> Column:
    """A nested value with old ids replaced by new ones wherever they stand as whole tokens, in keys of maps and
    texts of any depth; all ids at once, so that new ids are never replaced again."""
    tokens = sorted(ids, key=len, reverse=True)
    mark = lambda i: f"\u0002{i}\u0003"
    out = F.to_json(value)
    for i, old in enumerate(tokens):
        out = F.regexp_replace(out, rf"(?<![\w-])\Q{old}\E(?![\w-])", mark(i))
    for i, old in enumerate(tokens):
        out = F.replace(out, F.lit(mark(i)), F.lit(ids[old]))
    return F.from_json(out, schema)


def cooccurs(text: Column, words: list[str], size: int = 1500, stride: int = 750) -> Column:
    """Offset of the first window holding all words, null without one."""
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.length(text) - 1) / stride), F.lit(0)).cast("int") * stride, F.lit(stride))
    held = lambda i: F.forall(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.substring(text, i + 1, F.lit(size)), w))
    return F.try_element_at(F.filter(starts, held), F.lit(1))


def within_budget(df: DataFrame, group: str, score: str, cost: str, order: str, budget: int, most: int) -> DataFrame:
    """The best items of each group that still fit ``budget``, at most ``most``; one too large is passed over.

    The ranked array of a group is cut to ``48`` before the fold, as the lexical prefilter demands.
    """
    w = Window.partitionBy(group).orderBy(F.desc(score), order)
    ranked = df.withColumn("_r", F.row_number().over(w)).where("_r <= 48")
    items = ranked.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("_r", F.col(cost).cast("int").alias("cost"), F.col(order).cast("string").alias("o")))).alias("items"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("chosen"))
    fits = lambda acc, x: (acc["used"] + x["cost"] <= budget) & (F.size(acc["chosen"]) < most)
    step = lambda acc, x: F.when(fits(acc, x), F.struct((acc["used"] + x["cost"]).alias("used"), F.concat(acc["chosen"], F.array(x["o"])).alias("chosen"))).otherwise(acc)
    return items.select(group, F.aggregate("items", start, step).alias("a")).select(group, F.col("a.used").alias("used"), F.posexplode("a.chosen").alias("place", order))


def grounded(selected: DataFrame, quotes: DataFrame) -> DataFrame:
    """Selections (doc_id, quote_id, ...) with their exact quote; an unknown or repeated number is an error row."""
    seen = selected.groupBy("doc_id", "quote_id").agg(F.count("*").alias("times"))
    out = seen.join(quotes, ["doc_id", "quote_id"], "left")
    return out.withColumn("problem", F.when(F.col("quote").isNull(), "unknown").when(F.col("times") > 1, "repeated"))


def citation_problems(sentences: DataFrame, evidence: DataFrame, least: dict[str, int]) -> DataFrame:
    """(sentence_id, problem): citations of unknown evidence, repeated ones, and too few for the kind of statement."""
    long = sentences.select("sentence_id", "kind", F.explode_outer("citations").alias("evidence_id"))
    unknown = long.where("evidence_id is not null").join(evidence.select("evidence_id"), "evidence_id", "left_anti").select("sentence_id", F.lit("unknown").alias("problem"))
    repeated = sentences.where(F.size(F.array_distinct("citations")) < F.size("citations")).select("sentence_id", F.lit("repeated").alias("problem"))
    need = F.lit(0)
    for kind, n in least.items():
        need = F.when(F.col("kind") == kind, n).otherwise(need)
    few = sentences.where(F.coalesce(F.size(F.array_distinct("citations")), F.lit(0)) < need).select("sentence_id", F.lit("too_few").alias("problem"))
    return unknown.unionByName(repeated).unionByName(few).distinct()


# --- queries ---------------------------------------------------------------


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return last_by(table(spark, sf_dir, "rag_document").select("doc_id", "collected_at", *columns), ["doc_id"], "collected_at")


def grd_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "text").select("doc_id", F.posexplode(passages.paragraphs_of(F.col("text"))).alias("no", "paragraph"))


def grd_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "text", "title").select("doc_id", passages.snippet_of(F.col("text"), F.col("title")).alias("snippet"))


def grd_topic_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = _docs(spark, sf_dir, "text", "title").select(passages.topic_of(F.col("text"), F.col("title"), [["strait", "海峡", "海峽", "해협"]], True).alias("t"))
    return judged.groupBy(F.coalesce("t.reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("docs"))


def grd_script_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "language", "source_country").groupBy(script_label(F.col("language"), country_key(F.col("source_country"))).alias("script")).agg(F.count("*").alias("docs"))


#: Topics of the test tables: routing by words of a title.
ROUTES = (("sea", "strait|ship|navy|海|해협|항로|समुद्र|بحری"), ("air", "air|drone|flight|空|無人機|无人机|항공|무인기|ड्रोन|ڈرون"), ("border", "border|邊境|边境|国境|국경|सीमा|سرحد"))


def grd_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "title").select("doc_id", F.coalesce(route(F.col("title"), ROUTES), F.lit("general")).alias("route"))


def grd_rebinding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir, "event_id").select("doc_id", "event_id")
    body = F.concat(F.lit("see "), F.col("doc_id"), F.lit(", not x"), F.col("doc_id"), F.lit("."))
    return docs.select("doc_id", rebound(body, F.col("doc_id"), F.col("event_id")).alias("body"))


def grd_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "text").select("doc_id", cooccurs(F.lower("text"), ["exercise", "ferry"]).alias("offset")).where("offset is not null")


def grd_missing_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event the asked languages no document has."""
    have = _docs(spark, sf_dir, "event_id", "language").groupBy("event_id").agg(F.collect_set("language").alias("have"))
    asked = F.array(*[F.lit(x) for x in ("en", "ja", "ko", "fr")])
    return table(spark, sf_dir, "rag_event").join(have, "event_id", "left").select("event_id", F.array_join(F.array_sort(F.array_except(asked, F.coalesce("have", F.array().cast("array<string>")))), ",").alias("missing"))


def grd_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event the three documents that share most terms with the question and fit a model's input together."""
    shared = F.size(F.array_intersect(text.relevance_terms(F.col("text"), han=True), F.array(*map(F.lit, QUESTION))))
    docs = _docs(spark, sf_dir, "event_id", "text").select("event_id", "doc_id", text.text_cost(F.col("text")).alias("cost"), shared.alias("score"))
    return within_budget(docs, "event_id", "score", "cost", "doc_id", 2200, 3).select("event_id", "doc_id", "place")


def grd_selected_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections of the third quote of every document against the quotes there are."""
    docs = _docs(spark, sf_dir, "text")
    picked = grounded(docs.select("doc_id", F.lit(3).alias("quote_id")), numbered_quotes(docs))
    return picked.groupBy(F.coalesce("problem", F.lit("ok")).alias("problem")).agg(F.count("*").alias("selections"))


def grd_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as statements citing the parts of their lines, against the parts under a price."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sentence_id")).agg(F.collect_list("l_partkey").alias("citations"))
    kinds = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sentence_id"), F.when(F.col("o_orderstatus") == "F", "common").otherwise("judgment").alias("kind"))
    sentences = kinds.join(lines, "sentence_id", "left").select("sentence_id", "kind", F.coalesce("citations", F.array().cast("array<bigint>")).alias("citations"))
    evidence = table(spark, sf_dir, "part").where("p_size <= 48").select(F.col("p_partkey").alias("evidence_id"))
    return citation_problems(sentences, evidence, {"common": 2, "judgment": 1}).groupBy("problem").agg(F.count("*").alias("sentences"))


_L = "l AS (SELECT * FROM rag_document QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY collected_at DESC) = 1)"
_CK = "coalesce(nullif(upper(trim(source_country)), ''), 'UNKNOWN')"

QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("grd_")}
_COST = r"length(text) + 2 * length(regexp_replace(text, '[^\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]', '', 'g'))"
SQL = {
    "grd_budget": f"WITH RECURSIVE {_L}, c AS (SELECT event_id, doc_id, {_COST} AS cost, row_number() OVER (PARTITION BY event_id ORDER BY {_OVERLAP.replace('quote', 'text')} DESC, doc_id) AS k FROM l), r AS (SELECT event_id, k, doc_id, CASE WHEN cost <= 2200 THEN cost ELSE 0 END AS used, CASE WHEN cost <= 2200 THEN 1 ELSE 0 END AS held, cost <= 2200 AS ok FROM c WHERE k = 1 UNION ALL SELECT c.event_id, c.k, c.doc_id, CASE WHEN r.used + c.cost <= 2200 AND r.held < 3 THEN r.used + c.cost ELSE r.used END, CASE WHEN r.used + c.cost <= 2200 AND r.held < 3 THEN r.held + 1 ELSE r.held END, r.used + c.cost <= 2200 AND r.held < 3 FROM r JOIN c ON c.event_id = r.event_id AND c.k = r.k + 1 AND c.k <= 48) SELECT event_id, doc_id, held - 1 AS place FROM r WHERE ok",
    "grd_script_labels": f"WITH {_L} SELECT CASE WHEN language = 'zh' AND {_CK} IN ('TW', 'HK') THEN '번체' WHEN language = 'zh' THEN '간체' WHEN language = 'ja' THEN '일본어' WHEN language = 'en' THEN '영문' WHEN language = 'ko' THEN '한국어' WHEN language = 'hi' THEN '힌디어' WHEN language = 'ur' THEN '우르두어' ELSE coalesce(language, '') END AS script, count(*) AS docs FROM l GROUP BY 1",
    "grd_routes": f"WITH {_L} SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(title, '(?i){p}') THEN '{n}'" for n, p in ROUTES) + " ELSE 'general' END AS route FROM l",
    "grd_selected_quotes": f"WITH {TEXT_QUOTES}, n AS (SELECT l.doc_id, count(quote) AS n FROM l LEFT JOIN q ON q.doc_id = l.doc_id GROUP BY 1) SELECT CASE WHEN n >= 3 THEN 'ok' ELSE 'unknown' END AS problem, count(*) AS selections FROM n GROUP BY 1",
    "grd_rebinding": f"WITH {_L} SELECT doc_id, 'see ' || event_id || ', not x' || doc_id || '.' AS body FROM l",
    "grd_cooccurrence": f"WITH {_L}, w AS (SELECT doc_id, lower(text) AS t, unnest(range(0, length(text), 750)) AS i FROM l) SELECT doc_id, CAST(min(i) AS INTEGER) AS \"offset\" FROM w WHERE contains(substr(t, CAST(i + 1 AS BIGINT), 1500), 'exercise') AND contains(substr(t, CAST(i + 1 AS BIGINT), 1500), 'ferry') GROUP BY 1",
    "grd_missing_languages": f"WITH {_L}, a AS (SELECT event_id, x FROM rag_event, (VALUES ('en'), ('ja'), ('ko'), ('fr')) v(x)) SELECT e.event_id, coalesce(string_agg(a.x, ',' ORDER BY a.x), '') AS missing FROM rag_event e LEFT JOIN a ON a.event_id = e.event_id AND NOT EXISTS (SELECT 1 FROM l WHERE l.event_id = a.event_id AND l.language = a.x) GROUP BY 1",
    "grd_citations": """
WITH c AS (SELECT o_orderkey AS s, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS need, count(l_partkey) AS n, count(DISTINCT l_partkey) AS d, count(*) FILTER (l_partkey IS NOT NULL AND (p_size IS NULL OR p_size > 48)) AS bad FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
SELECT problem, count(*) AS sentences FROM (SELECT 'unknown' AS problem FROM c WHERE bad > 0 UNION ALL SELECT 'repeated' FROM c WHERE d < n UNION ALL SELECT 'too_few' FROM c WHERE d < need) GROUP BY 1""",
}
