"""Claims and their grounding: sentence units natively, rejection, representatives, packing, spans, cross-check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import dates, numbers, text
from strandline.operators.dedup import first_by, last_by
from strandline.operators.joins import containment_join, sized
from strandline.operators.windows import char_windows, greedy_pack, with_neighbours
from strandline.sources.tables import table

MAX_DRAFTS = 6
#: Terms of the question the test tables are asked.
QUESTION = ("ferry", "storm", "warning", "patrol", "海岸", "巡逻")


def numbered_quotes(docs: DataFrame, id_col: str = "doc_id", body: str = "text", longest: int | None = None) -> DataFrame:
    """(id, quote_id, quote): the sentences of each document, numbered from 1; with ``longest`` documents of
    which one is longer give none, as they cannot be cited."""
    cut = docs.select(id_col, text.quotes(F.col(body)).alias("quotes"))
    if longest is not None:
        cut = cut.where(~F.exists("quotes", lambda q: F.length(q) > longest))
    return cut.select(id_col, F.posexplode("quotes").alias("pos", "quote")).select(id_col, (F.col("pos") + 1).alias("quote_id"), "quote")


def representative(claims: DataFrame, question_terms: list[str]) -> DataFrame:
    """The claim of each document sharing most terms with the question, the first of equals."""
    asked = F.array(*[F.lit(t) for t in question_terms])
    scored = claims.withColumn("overlap", F.size(F.array_intersect(text.relevance_terms(F.col("quote"), han=True), asked)))
    return first_by(scored, ["doc_id"], [-F.col("overlap"), F.col("quote_id")])


def admitted(drafts: DataFrame, targets: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Drafts with the first ``reason`` that keeps them out, null for claims; then their ``normalized`` value.

    Only the first drafts of a source are looked at, before any of them is turned down.
    """
    w = Window.partitionBy("source_id").orderBy("ord")
    rows = drafts.withColumn("draft_no", F.row_number().over(w)).where(F.col("draft_no") <= MAX_DRAFTS)
    rows = rows.join(sized(targets.select(F.col("id").alias("target_id"), F.lit(True).alias("asked"))), "target_id", "left")
    rows = rows.join(paragraphs.select("source_id", F.col("id").alias("paragraph_id"), F.col("text").alias("paragraph")), ["source_id", "paragraph_id"], "left")
    folded = text.nfkc_fold(F.col("quote"))
    grounded = F.coalesce(F.expr("contains(_p, _q)"), F.lit(False))
    rows = rows.withColumns({"_p": text.comparable(F.col("paragraph")), "_q": text.comparable(F.col("quote")), "_f": folded})
    reason = (
        F.when(~F.coalesce("matches_event", F.lit(False)) | F.col("asked").isNull(), "not_asked")
        .when(F.col("paragraph").isNull() | ~grounded, "quote_not_found")
        .when(F.col("value_number").isNotNull() & ~numbers.states_number(F.col("_f"), F.col("value_number")), "number_not_found")
        .when(F.col("value_number").isNotNull() & ~numbers.states_unit(F.col("quote"), F.col("unit")), "unit_not_found")
        .when(F.col("time_local").isNotNull() & ~dates.has_clock(F.col("_f"), F.col("time_local")), "time_not_found")
    )
    utc = dates.utc_time(F.col("quote"), F.col("event_date"), F.col("time_local"), F.col("timezone"))
    value = F.when(F.col("time_local").isNotNull(), F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise(numbers.comparable_value(F.col("value_number"), F.col("unit")))
    return rows.withColumn("reason", reason).withColumn("normalized", F.when(F.col("reason").isNull(), value)).withColumn("claim_id", F.format_string("%s-C%d", "source_id", "draft_no")).drop("_p", "_q", "_f", "asked", "paragraph")


def crosscheck(targets: DataFrame, claims: DataFrame, groups: DataFrame) -> DataFrame:
    """A finding per target from its claims: status, confidence, publisher groups and claim ids.

    ``claims`` holds target_id, source_id, claim_id, subject, event_date, certainty, polarity,
    quantifier, revision_note, unit, time_local and normalized; ``groups`` source_id and publisher_group.
    """
    dimension = F.when(F.col("time_local").isNotNull(), "time").when(F.col("unit") == "km", "m").otherwise(F.coalesce("unit", F.lit("none")))
    state = F.concat_ws("\x01", "certainty", "polarity", "quantifier")

    def alike(*columns: str | Column) -> Column:
        row = F.struct(*columns)
        return F.min(row) == F.max(row)

    per = (
        claims.join(groups, "source_id", "left")
        .groupBy("target_id")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.coalesce("revision_note", F.lit("")) != "").alias("revised"),
            F.count_if(F.col("event_date").isNull() | F.col("normalized").isNull()).alias("unknown"),
            # All equal is least = greatest: six distinct counts would expand every row sevenfold.
            alike("event_date", "subject", state).alias("same_state"),
            alike(dimension).alias("same_dimension"),
            alike("normalized").alias("same_value"),
            # A target has few publishers; a set of them spares the expansion that a distinct count would bring.
            F.size(F.collect_set("publisher_group")).alias("publisher_groups"),
            F.min("quantifier").alias("quantifier"),
            F.sort_array(F.collect_list("claim_id")).alias("claim_ids"),
        )
    )
    found = targets.join(per, targets["id"] == per["target_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    status = (
        F.when(F.col("n") == 0, "insufficient")
        .when(F.col("revised") > 0, "revision_review")
        .when(F.col("n") < 2, "insufficient")
        .when((F.col("unknown") > 0) | ~F.col("same_state") | ~F.col("same_dimension"), "not_comparable")
        .when(F.col("same_value"), "aligned")
        .when(F.col("quantifier") != "exact", "not_comparable")
        .otherwise("conflict")
    )
    confidence = F.when(F.col("n") == 0, "unassessed").when((F.col("status") == "aligned") & (F.col("publisher_groups") >= 2), "medium").otherwise("low")
    out = found.withColumn("status", status).withColumn("confidence", confidence)
    return out.select("id", "status", "confidence", F.coalesce("publisher_groups", F.lit(0)).alias("publisher_groups"), "n", "claim_ids")


# --- queries ---------------------------------------------------------------


def _snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "snippet_docs").select("doc_id", F.col("text_snippet").alias("text"), "tier", "score").where("text is not null").distinct()


def _texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return last_by(table(spark, sf_dir, "rag_document").select("doc_id", "collected_at", *columns), ["doc_id"], "collected_at")


def clm_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered_quotes(_snippets(spark, sf_dir).select("doc_id", "text").distinct())


def clm_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes by the reason why they are no claims, and by whether they carry substance."""
    quotes = numbered_quotes(_texts(spark, sf_dir, "text"))
    reason = F.coalesce(text.claim_rejection(F.col("quote")), F.lit("claim"))
    return quotes.groupBy(reason.alias("reason"), text.is_substantive(F.col("quote")).alias("substantive")).agg(F.count("*").alias("quotes"))


def clm_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in focus: some acceptable quote names the place; the rest of their quotes stay with them."""
    quotes = numbered_quotes(_texts(spark, sf_dir, "text"))
    named = quotes.where(text.claim_rejection(F.col("quote")).isNull() & F.lower("quote").contains("strait")).select("doc_id").distinct()
    return quotes.join(named, "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("quotes"))


def clm_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = numbered_quotes(_snippets(spark, sf_dir).select("doc_id", "text").distinct())
    return representative(quotes, list(QUESTION)).select("doc_id", "quote_id", "overlap")


def clm_without(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of raw_docs without any quote: what a fallback has to look at."""
    quotes = numbered_quotes(_snippets(spark, sf_dir)).select("doc_id").distinct()
    return table(spark, sf_dir, "raw_docs").select("doc_id").distinct().join(quotes, "doc_id", "left_anti")


def clm_paragraph_of_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir, "paragraphs")
    quotes = numbered_quotes(_snippets(spark, sf_dir).select("doc_id", "text").distinct())
    para = docs.select("doc_id", F.posexplode("paragraphs").alias("pos", "p")).select("doc_id", (F.col("pos") + 1).alias("paragraph_no"), F.col("p.text").alias("paragraph"))
    return containment_join(quotes, para).groupBy("matches").agg(F.count("*").alias("quotes"))


def clm_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 6000 characters with a stride of 4400 over whole texts."""
    return _texts(spark, sf_dir, "text").select("doc_id", F.explode(char_windows(F.length("text"), 6000, 1600)).alias("w")).select("doc_id", "w.start_char", "w.end_char")


def clm_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = numbered_quotes(_snippets(spark, sf_dir).select("doc_id", "text").distinct()).withColumn("n", F.length("quote"))
    spans = quotes.withColumn("end", F.sum("n").over(Window.partitionBy("doc_id", "quote").orderBy("quote_id"))).select("doc_id", "quote_id", (F.col("quote_id") * 10).alias("start"), (F.col("quote_id") * 10 + 9).alias("end"))
    return with_neighbours(spans, ["doc_id"], "quote_id", "start", "end").select("doc_id", "quote_id", "context_start", "context_end")


def clm_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a document's paragraphs of at most 600 characters in order."""
    para = _texts(spark, sf_dir, "paragraphs").select("doc_id", F.posexplode("paragraphs").alias("pos", "p")).select("doc_id", "pos", F.length("p.text").alias("n"))
    return greedy_pack(para, "doc_id", "pos", "n", 600).groupBy("doc_id", "pack").agg(F.count("*").alias("paragraphs"), F.sum("n").alias("chars"))


def clm_text_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, "text").select("doc_id", text.text_cost(F.col("text")).alias("cost"))


def clm_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of all documents, each wording once by its first document."""
    quotes = numbered_quotes(_snippets(spark, sf_dir).select("doc_id", "text").distinct())
    return first_by(quotes, ["quote"], [F.col("doc_id"), F.col("quote_id")])


def clm_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the joined paragraphs are the whole text, white space aside; if not the text is a paragraph more."""
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    joined = F.coalesce(F.array_join(F.transform("paragraphs", lambda p: p["text"]), ""), F.lit(""))
    state = F.when(F.col("paragraphs").isNull() | (F.size("paragraphs") == 0), "none").when(bare(F.col("text")) == bare(joined), "complete").otherwise("supplement")
    return _texts(spark, sf_dir, "text", "paragraphs").groupBy(state.alias("state")).agg(F.count("*").alias("docs"))


def clm_crosscheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as targets and their lines as claims: the decision table over a large input."""
    claims = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("target_id"),
        F.col("l_suppkey").alias("source_id"),
        F.concat_ws("-", "l_suppkey", "l_linenumber").alias("claim_id"),
        F.col("l_linestatus").alias("subject"),
        F.when(F.col("l_tax") < 0.08, F.date_format("l_shipdate", "yyyy")).alias("event_date"),
        F.col("l_linestatus").alias("certainty"),
        F.lit("positive").alias("polarity"),
        F.when(F.col("l_discount") < 0.05, "exact").otherwise("at_least").alias("quantifier"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7), "revised").alias("revision_note"),
        F.lit("count").alias("unit"),
        F.lit(None).cast("string").alias("time_local"),
        F.concat(F.floor(F.col("l_quantity") / 25).cast("string"), F.lit(" count")).alias("normalized"),
    )
    groups = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_nationkey").alias("publisher_group"))
    targets = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return crosscheck(targets, claims, groups).groupBy("status", "confidence").agg(F.count("*").alias("targets"), F.sum("publisher_groups").alias("groups"))


_L = "l AS (SELECT * FROM rag_document QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY collected_at DESC) = 1)"
_GUARDED = r"regexp_replace(regexp_replace({x}, '(^|[^\p{L}\p{N}_])([A-Za-z])\.(\s*[A-Za-z]\.)', '\1\2' || chr(2) || '\3', 'g'), '(^|[^\p{L}\p{N}_])([A-Za-z])\.(\s*[A-Za-z]\.)', '\1\2' || chr(2) || '\3', 'g')"
_LETTERS = r"regexp_replace(" + _GUARDED.replace("{x}", "translate(text, chr(1) || chr(2), '  ')") + r", '(' || chr(2) || '\s*[A-Za-z])\.', '\1' || chr(2), 'g')"
_SHORT = r"regexp_replace(" + _LETTERS + r", '(?i)(^|[^\p{L}\p{N}_])(mr|mrs|ms|dr|prof|inc|corp|ltd|co|jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|nov|dec|vs|etc|no)\.', '\1\2' || chr(2), 'g')"
_MARKED = r"regexp_replace(regexp_replace(regexp_replace(" + _SHORT + r''', '([。！？۔؟।॥][」』”"]*)', '\1' || chr(1), 'g'), '([.!?][”’"\)\]]*)(\s|$)', '\1' || chr(1) || '\2', 'g'), '[\r\n]+', chr(1), 'g')'''
_UNITS = r"list_filter(list_transform(string_split(" + _MARKED + r", chr(1)), lambda x: regexp_replace(replace(x, chr(2), '.'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda x: x <> '')"
_SQ = f"s AS (SELECT DISTINCT doc_id, text_snippet AS text FROM snippet_docs WHERE text_snippet IS NOT NULL), q AS (SELECT doc_id, unnest({_UNITS}) AS quote, generate_subscripts({_UNITS}, 1) AS quote_id FROM s)"
TEXT_QUOTES = f"{_L}, q AS (SELECT doc_id, unnest({_UNITS}) AS quote, generate_subscripts({_UNITS}, 1) AS quote_id FROM l)"

_BAD = r"""CASE
WHEN regexp_matches(regexp_replace(v, '[」』”"'']+$', ''), '[?？]$') THEN 'question_without_assertion'
WHEN regexp_matches(v, 'と(?:いう|言う)(?:と|のは)$') THEN 'unfinished_introductory_clause'
WHEN regexp_matches(v, '何|どう|どっち') AND regexp_matches(v, '(?:これ|それ|あれ)です[。.]$') THEN 'deictic_answer_without_assertion'
WHEN regexp_matches(v, '(?i)^(?:關鍵字\s*[:：]|关键词\s*[:：]|Keywords?\s*[:：]|跳到主要內容|網站導覽|展開搜尋|調整頁面字體|分享至|複製連結|下載專區|下載檔案|Subscribe\b|로그인|구독\s*안내)') THEN 'navigation_or_download_text'
WHEN regexp_matches(v, '^第\s*\d+\s*[節章]\s') AND length(v) < 120 AND NOT regexp_matches(v, '(?:ている|される|した|する|です|ます|である)[。.]') THEN 'section_heading' END"""
_SUB = r"""NOT (regexp_matches(v, '(?i)^(?:(?:https?://|www\.)\S+|(?:com|org|net|cn|tw|hk|jp|kr|edu|gov|io)/\S+)$') OR regexp_matches(v, '^(?:[A-Za-z0-9-]+\.)+$') OR regexp_matches(v, '(?i)^[^.!?。]{1,100}\|\s*www\.$') OR regexp_matches(v, '(?i)^(?:References?|Sources?|참고\s*자료|출처|参考资料|參考資料)\s*[:：]'))"""
_VISIBLE = r"trim(regexp_replace(quote, '\[\d{1,2}:\d{2}(?::\d{2})?\]', '', 'g'))"
_OVERLAP = " + ".join(f"CAST(regexp_matches(lower(quote), '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INTEGER)" if t.isascii() else f"CAST(contains(quote, '{t}') AS INTEGER)" for t in QUESTION)

QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("clm_")}
SQL = {
    "clm_rejections": f"WITH {TEXT_QUOTES}, t AS (SELECT *, {_VISIBLE} AS v FROM q) SELECT coalesce({_BAD}, 'claim') AS reason, {_SUB} AS substantive, count(*) AS quotes FROM t GROUP BY 1, 2",
    "clm_representative": f"WITH {_SQ} SELECT doc_id, CAST(quote_id AS INTEGER) AS quote_id, {_OVERLAP} AS overlap FROM q QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY {_OVERLAP} DESC, quote_id) = 1",
    "clm_packs": f"WITH RECURSIVE {_L}, p AS (SELECT doc_id, generate_subscripts(paragraphs, 1) AS k, length(unnest(paragraphs).text) AS n FROM l), r AS (SELECT doc_id, k, n, CAST(1 AS INTEGER) AS pack, n AS used FROM p WHERE k = 1 UNION ALL SELECT p.doc_id, p.k, p.n, CASE WHEN r.used + p.n > 600 THEN r.pack + 1 ELSE r.pack END, CASE WHEN r.used + p.n > 600 THEN p.n ELSE r.used + p.n END FROM r JOIN p ON p.doc_id = r.doc_id AND p.k = r.k + 1) SELECT doc_id, pack, count(*) AS paragraphs, CAST(sum(n) AS BIGINT) AS chars FROM r GROUP BY 1, 2",
    "clm_quotes": f"WITH {_SQ} SELECT doc_id, CAST(quote_id AS INTEGER) AS quote_id, quote FROM q",
    "clm_focus": f"WITH {TEXT_QUOTES}, k AS (SELECT *, NOT regexp_matches(regexp_replace(quote, '[」』”\"'']+$', ''), '[?？]$') AS ok FROM q), f AS (SELECT DISTINCT doc_id FROM k WHERE ok AND contains(lower(quote), 'strait')) SELECT doc_id, count(*) AS quotes FROM q WHERE doc_id IN (SELECT doc_id FROM f) GROUP BY 1",
    "clm_without": f"WITH {_SQ} SELECT DISTINCT doc_id FROM raw_docs WHERE doc_id NOT IN (SELECT doc_id FROM q)",
    "clm_windows": f"WITH {_L}, n AS (SELECT doc_id, length(text) AS n, unnest(range(0, CAST(greatest(ceil((length(text) - 6000) / 4400.0), 0) AS BIGINT) + 1)) AS i FROM l WHERE length(text) > 0) SELECT doc_id, CAST(i * 4400 AS INTEGER) AS start_char, CAST(least(i * 4400 + 6000, n) AS INTEGER) AS end_char FROM n",
    "clm_neighbours": f"WITH {_SQ}, p AS (SELECT doc_id, quote_id, quote_id * 10 AS a, quote_id * 10 + 9 AS b FROM q) SELECT doc_id, quote_id, coalesce(lag(a) OVER w, a) AS context_start, coalesce(lead(b) OVER w, b) AS context_end FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY quote_id)",
    "clm_text_cost": f"WITH {_L} SELECT doc_id, CAST(length(text) + 2 * length(regexp_replace(text, '[^\\x{{3040}}-\\x{{30ff}}\\x{{3400}}-\\x{{9fff}}\\x{{ac00}}-\\x{{d7af}}]', '', 'g')) AS INTEGER) AS cost FROM l",
    "clm_distinct": f"WITH {_SQ} SELECT doc_id, CAST(quote_id AS INTEGER) AS quote_id, quote FROM q QUALIFY row_number() OVER (PARTITION BY quote ORDER BY doc_id, quote_id) = 1",
    "clm_completeness": f"WITH {_L} SELECT CASE WHEN paragraphs IS NULL OR len(paragraphs) = 0 THEN 'none' WHEN regexp_replace(text, '\\s+', '', 'g') = regexp_replace(array_to_string(list_transform(paragraphs, lambda p: p.text), ''), '\\s+', '', 'g') THEN 'complete' ELSE 'supplement' END AS state, count(*) AS docs FROM l GROUP BY 1",
    "clm_paragraph_of_quote": f"WITH {_SQ}, {_L}, p AS (SELECT doc_id, unnest(paragraphs).text AS paragraph FROM l), m AS (SELECT q.doc_id, q.quote_id, count(p.paragraph) AS matches FROM q LEFT JOIN p ON p.doc_id = q.doc_id AND contains(p.paragraph, q.quote) GROUP BY 1, 2) SELECT matches, count(*) AS quotes FROM m GROUP BY 1",
    "clm_crosscheck": """
WITH c AS (SELECT l_orderkey AS t, l_linestatus AS subject, CASE WHEN l_tax < 0.08 THEN year(l_shipdate) END AS d, CASE WHEN l_discount < 0.05 THEN 'exact' ELSE 'at_least' END AS quant, l_returnflag = 'R' AND l_linenumber = 7 AS rev, floor(l_quantity / 25) AS v, s_nationkey AS g FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey),
a AS (SELECT o_orderkey, count(t) AS n, count(*) FILTER (rev) AS revised, count(*) FILTER (t IS NOT NULL AND d IS NULL) AS undated, count(DISTINCT d) AS dates, count(DISTINCT subject) AS subjects, count(DISTINCT subject || quant) AS states, count(DISTINCT v) AS vals, count(DISTINCT g) AS groups, min(quant) AS quant FROM orders LEFT JOIN c ON t = o_orderkey GROUP BY 1),
s AS (SELECT *, CASE WHEN n = 0 THEN 'insufficient' WHEN revised > 0 THEN 'revision_review' WHEN n < 2 THEN 'insufficient' WHEN undated > 0 OR dates <> 1 OR subjects <> 1 OR states <> 1 THEN 'not_comparable' WHEN vals = 1 THEN 'aligned' WHEN quant <> 'exact' THEN 'not_comparable' ELSE 'conflict' END AS status FROM a)
SELECT status, CASE WHEN n = 0 THEN 'unassessed' WHEN status = 'aligned' AND groups >= 2 THEN 'medium' ELSE 'low' END AS confidence, count(*) AS targets, CAST(sum(groups) AS BIGINT) AS groups FROM s GROUP BY 1, 2""",
}
