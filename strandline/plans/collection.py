"""From search hits to a document set: normal forms, gates with reasons, duplicates, ranks and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import dates, fixed, text, urls
from strandline.functions.keys import country_key, source_key
from strandline.operators.dedup import added_by_key, greedy_dedup, last_by
from strandline.operators.joins import suffix_join
from strandline.operators.ranking import adaptive_top_k, balanced, country_quotas, round_robin_fill
from strandline.sources.tables import table

DEFAULTS = {"tier": 3, "country": "UNKNOWN", "weight": 0.5}
COUNTRIES = ["CN", "TW", "HK", "JP", "KR", "PK", "IN", "US"]
GREATER_CHINA = ["CN", "TW", "HK"]


def hits(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """raw_docs as provider rows, each document once (collected last), ordered by time and id;
    only the columns asked for are read and shuffled."""
    raw = last_by(table(spark, sf_dir, "raw_docs").select("doc_id", "collected_at", *columns), ["doc_id"], "collected_at")
    return raw.withColumn("ord", F.concat(F.date_format("collected_at", "yyyyMMddHHmmssSSSSSS"), F.col("doc_id")))


def time_range(days_back: int) -> str:
    """The coarse range a provider is asked for."""
    return "day" if days_back <= 1 else "week" if days_back <= 7 else "month"


def fetch_size(k: int) -> int:
    """How many rows a provider is asked for, to have ``k`` after the gates."""
    return min(max(2 * k, 10), 20)


def with_bodies(found: DataFrame, bodies: DataFrame) -> DataFrame:
    """Hits without a body take it from ``bodies`` (canonical_url, body); ``acquired`` says how it came."""
    missing = F.coalesce(F.trim("article_text"), F.lit("")) == ""
    joined = found.withColumn("canonical_url", urls.canonical_url(F.col("url"))).join(bodies, "canonical_url", "left")
    body = F.when(missing, F.col("body")).otherwise(F.col("article_text"))
    return joined.withColumn("acquired", F.when(~missing, "search").when(F.coalesce("body", F.lit("")) != "", "recovered").otherwise("failed")).withColumn("article_text", body).drop("body")


def registered(found: DataFrame, registry: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tier, country and weight of the source behind a URL by the first entry of the registry that matches, with defaults for unknown hosts."""
    placed = registry.select("domain", "tier", "country", "weight", F.monotonically_increasing_id().alias("place"))
    out = suffix_join(found, placed, key, order="place")
    return out.select(*found.columns, "matched_domain", *[F.coalesce(f"reg_{c}", F.lit(v)).alias(f"site_{c}") for c, v in DEFAULTS.items()])


def gate_reason(body: Column, language: Column, selected: list[str], published: Column, official: Column, as_of: str, days_back: int) -> Column:
    """The first gate a hit fails, null if none: body, language, then, for official sources, the date."""
    start, end = F.date_sub(F.lit(as_of).cast("date"), days_back), F.lit(as_of).cast("date")
    day = F.try_to_timestamp(published, F.lit("yyyy-MM-dd")).cast("date")
    return (
        F.when(F.length(F.trim(F.coalesce(body, F.lit("")))) < 40, "body_unavailable")
        .when(F.coalesce(language, F.lit("unknown")).isin("unknown", "und", ""), "language_uncertain")
        .when(~language.isin(*selected), "language_not_selected")
        .when(official & published.isNotNull() & day.isNull(), "invalid_published_date")
        .when(official & published.isNotNull() & ~day.between(start, end), "published_outside_window")
    )


def rejection_counts(rejected: DataFrame) -> DataFrame:
    """Distinct rejected URLs by reason, the last reason of a URL counting."""
    return last_by(rejected.select("url", "reason", "ord"), ["url"], "ord").groupBy("reason").agg(F.count("*").alias("urls"))


def missing_countries(docs: DataFrame, parties: DataFrame, official: Column) -> DataFrame:
    """Parties (country) of which no official document is there."""
    return parties.join(docs.where(official).select("country").distinct(), "country", "left_anti")


# --- queries ---------------------------------------------------------------


def col_canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_docs").select("doc_id", urls.canonical_url(F.col("url")).alias("canonical_url"), urls.is_article_url(F.col("url")).alias("is_article")).distinct()


def col_safe_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "rag_document").select("doc_id", urls.safe_link(F.col("url")).alias("link")).distinct()


def col_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_docs").select("doc_id", text.canonical_title(F.col("title")).alias("title")).distinct()


def col_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "rag_document").select("doc_id", text.fingerprint(F.col("text")).alias("fingerprint"), text.content_hash(F.col("text")).alias("content_hash")).distinct()


def col_site_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(spark, sf_dir, "url").select("doc_id", "url")
    return registered(found, table(spark, sf_dir, "source_registry")).select("doc_id", "matched_domain", "site_tier", "site_country", "site_weight")


def col_body_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = last_by(table(spark, sf_dir, "rag_document").where("url is not null").select(urls.canonical_url(F.col("url")).alias("canonical_url"), F.col("text").alias("body"), "collected_at"), ["canonical_url"], "collected_at").drop("collected_at")
    return with_bodies(hits(spark, sf_dir, "url", "article_text").select("doc_id", "url", "article_text"), bodies).groupBy("acquired").agg(F.count("*").alias("docs"))


def col_lenient_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = dates.lenient_date(F.col("published_date"))
    warning = F.when(F.col("published_date").isNull(), "missing").when(day.isNull(), "unreadable").otherwise("ok")
    return table(spark, sf_dir, "raw_docs").select("doc_id", day.cast("string").alias("published"), warning.alias("warning")).distinct()


def col_published_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir, "published_date", "url", "article_text").select("doc_id", dates.published_date(F.col("published_date"), F.col("url"), F.coalesce("article_text", F.lit(""))).alias("published"))


def col_gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(spark, sf_dir, "url", "article_text", "language", "published_date", "source_category")
    official = F.col("source_category") == "official_government"
    reason = gate_reason(F.col("article_text"), F.col("language"), ["en", "ko", "zh", "ja"], dates.lenient_date(F.col("published_date")).cast("string"), official, "2026-09-30", 30)
    return rejection_counts(found.select("url", "ord", F.coalesce(reason, F.lit("kept")).alias("reason")))


def col_title_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(spark, sf_dir, "title").select("doc_id", "ord", text.canonical_title(F.col("title")).alias("title_key"))
    return greedy_dedup(found, ["title_key"], "ord").select("doc_id")


def col_greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(spark, sf_dir, "url", "title", "article_text").select("doc_id", "ord", urls.canonical_url(F.col("url")).alias("url_key"), text.canonical_title(F.col("title")).alias("title_key"), text.fingerprint(F.col("article_text")).alias("body_key"))
    return greedy_dedup(found, ["url_key", "title_key", "body_key"], "ord").select("doc_id")


def col_adaptive_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(spark, sf_dir, "score", "country").select("doc_id", "score", country_key(F.col("country")).alias("country"))
    return adaptive_top_k(found, ["country"], 20, "doc_id").select("country", "doc_id", "rank", "backfilled")


def col_quota_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(spark, sf_dir, "score", "language", "country", "source_category").select("doc_id", "score", "language", country_key(F.col("country")).alias("country"), (F.col("source_category") == "official_government").alias("official")).where("language in ('en', 'ko', 'zh', 'zh-Hant', 'ja')")
    quotas = country_quotas(20, COUNTRIES, GREATER_CHINA)
    limit = F.lit(quotas["US"])
    for c in COUNTRIES:
        limit = F.when(F.col("country") == c, quotas[c]).otherwise(limit)
    grouped = found.withColumn("country", F.when(F.col("country").isin(*COUNTRIES), F.col("country")).otherwise("US"))
    return round_robin_fill(grouped, "country", "language", limit, max(quotas.values()), "doc_id", F.col("official")).select("country", "doc_id", "turn")


def col_quota_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, c, q) for n in (20, 1, 0) for c, q in country_quotas(n, COUNTRIES, GREATER_CHINA).items()], "request int, country string, quota int")


def col_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(spark, sf_dir, "source_name", "url").select("doc_id", source_key(F.col("source_name")).alias("source"), urls.canonical_url(F.col("url")).alias("url_key"), "ord")
    return balanced(found, "source", 3, 60, "url_key", "ord").select("doc_id", "source", "place")


def col_official_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    official = F.col("source_category") == "official_government"
    return hits(spark, sf_dir, "country", "source_category").groupBy(country_key(F.col("country")).alias("country")).agg(F.count("*").alias("docs"), F.count_if(official).alias("official_docs"))


def col_missing_official(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(spark, sf_dir, "country", "source_category").withColumn("country", country_key(F.col("country")))
    parties = table(spark, sf_dir, "source_registry").select("country").distinct()
    return missing_countries(found, parties, F.col("source_category") == "official_government")


def col_official_addition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first selection with official documents added whose URL it lacks."""
    found = hits(spark, sf_dir, "source_category", "score", "url").select("doc_id", "source_category", "score", urls.canonical_url(F.col("url")).alias("url_key"))
    base = found.where("score >= 0.7").dropDuplicates(["url_key"])
    return added_by_key(base, found.where("source_category = 'official_government'"), "url_key").select("url_key")


def col_language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected languages with their documents, zeros included."""
    chosen = spark.createDataFrame([(x,) for x in ("en", "ko", "zh", "zh-Hant", "ja", "hi", "ur", "fr")], "language string")
    counts = hits(spark, sf_dir, "language", "score").groupBy("language").agg(F.count("*").alias("candidates"), F.count_if(F.col("score") >= 0.7).alias("retained"))
    return chosen.join(F.broadcast(counts), "language", "left").select("language", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("retained", F.lit(0)).alias("retained"))


def col_body_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length(F.trim(F.coalesce("article_text", F.lit(""))))
    band = F.when(n < 40, "unusable").when(n < 80, "short").when(n < 200, "review").otherwise("full")
    return hits(spark, sf_dir, "article_text").groupBy(band.alias("band")).agg(F.count("*").alias("docs"), F.sum(n).cast("bigint").alias("chars"))


def col_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "rag_document").select("doc_id", text.attribution(F.col("text")).alias("quoted_source")).distinct()


def col_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign rows as retrieval documents: the best present body, clipped, and a stable id from the URL."""
    raw, rag = hits(spark, sf_dir, "url", "article_text"), last_by(table(spark, sf_dir, "rag_document").select("doc_id", "text", "raw_content", "collected_at"), ["doc_id"], "collected_at")
    some = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    joined = raw.select("doc_id", "url", "article_text").join(rag.select("doc_id", "text", "raw_content"), "doc_id", "left")
    origin = F.when(some("article_text"), "cleaned").when(some("raw_content"), "raw").when(some("text"), "paragraphs")
    body = F.substring(F.when(some("article_text"), F.col("article_text")).when(some("raw_content"), F.col("raw_content")).otherwise(F.col("text")), 1, 60000)
    return joined.select("doc_id", F.concat(F.lit("doc_"), F.substring(F.sha2("url", 256), 1, 8)).alias("stable_id"), origin.alias("text_origin"), F.coalesce(F.length(body), F.lit(0)).alias("n_chars"))


def col_search_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a domain-restricted search of the last 30 days finds, by domain."""
    found = table(spark, sf_dir, "raw_docs").where("collected_at >= timestamp'2026-06-01' - interval 30 days and collected_at < timestamp'2026-06-01'").select("doc_id", "url").distinct()
    return suffix_join(found, table(spark, sf_dir, "source_registry").select("domain", "tier"), "doc_id").where("matched_domain is not null").groupBy(F.col("matched_domain").alias("domain")).agg(F.count("*").alias("docs"))


_H = "h AS (SELECT * FROM raw_docs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY collected_at DESC) = 1)"
_HOST = r"lower(regexp_extract({u}, '^https?://([^/?#]+)', 1))"
_PATH = r"regexp_replace(regexp_extract({u}, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '')"
_QUERY = r"regexp_extract({u}, '\?([^#]*)', 1)"
_CANON = (
    r"regexp_replace(" + _HOST + r", '^www\.', '') || regexp_replace(" + _PATH + r", '/(news|article|articles|story)/(\d+)(/[^/]+)?$', '/\1/\2')"
    r" || coalesce('?' || nullif(array_to_string(list_filter(string_split(" + _QUERY + r", '&'), lambda p: regexp_matches(p, '^[^=]+=.+') AND NOT regexp_matches(lower(p), '^(utm_|fbclid|ref|source|spm|from|ncid)')), '&'), ''), '')"
)
_TITLE = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(title, '')), '\s*[-|–—]\s*(dawn\.com|newspaper|reuters|bbc|cnn|nhk|asahi|yomiuri|nikkei|kyodo|연합뉴스|동아일보|조선일보|중앙일보|cctv|global times).*$', ''), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))"
_CK = "coalesce(nullif(upper(trim(country)), ''), 'UNKNOWN')"
_LEN = r"CASE WHEN published_date IS NOT NULL AND regexp_matches(published_date, '^\d{4}-\d{2}-\d{2}$|^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}') THEN CAST(try_strptime(substr(published_date, 1, 10), '%Y-%m-%d') AS DATE) END"
_SUFFIX = f"""
f AS (SELECT doc_id, {_HOST.format(u='url')} AS host FROM h),
m AS (SELECT doc_id, domain, tier, country, weight, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS k FROM f JOIN (SELECT *, row_number() OVER () AS place FROM source_registry) r ON host = domain OR ends_with(host, '.' || domain))
"""




QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("col_")}
_ATTR = ", ".join(f"CASE WHEN length(trim(regexp_extract(substr(text, 1, 1000), '{p}', 1))) BETWEEN 2 AND 40 THEN trim(regexp_extract(substr(text, 1, 1000), '{p}', 1)) END" for p in fixed.ATTRIBUTIONS)
_DAY = r"CASE WHEN regexp_matches({x}, '{p}') THEN regexp_extract({x}, '{p}', 1) || '-' || lpad(regexp_extract({x}, '{p}', 2), 2, '0') || '-' || lpad(regexp_extract({x}, '{p}', 3), 2, '0') END"
_day = lambda x, p: _DAY.replace("{x}", x).replace("{p}", p)
_HEAD = "substr(coalesce(article_text, ''), 1, 400)"
_MON = "(?i)" + fixed.HEAD_MONTH_DATE
_NAMED = f"CASE WHEN regexp_matches({_HEAD}, '{_MON}') THEN regexp_extract({_HEAD}, '{_MON}', 3) || '-' || lpad(CAST(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(substr(regexp_extract({_HEAD}, '{_MON}', 1), 1, 3))) AS VARCHAR), 2, '0') || '-' || lpad(regexp_extract({_HEAD}, '{_MON}', 2), 2, '0') END"
SQL = {
    "col_published_dates": f"WITH {_H} SELECT doc_id, coalesce(CASE WHEN regexp_matches(published_date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN substr(published_date, 1, 10) END, {', '.join(_day('url', p) for p in fixed.URL_DATES)}, {_day(_HEAD, fixed.HEAD_DATE)}, {_NAMED}, {_day(_HEAD, fixed.HEAD_HAN_DATE)}) AS published FROM h",
    "col_greedy_dedup": f"WITH RECURSIVE {_H}, k AS (SELECT doc_id, row_number() OVER (ORDER BY collected_at, doc_id) AS k, list_filter(['u' || {_CANON.format(u='url')}, 't' || {_TITLE}, 'b' || regexp_replace(lower(coalesce(article_text, '')), '[^\\p{{L}}\\p{{N}}_]', '', 'g')], lambda x: length(x) > 1) AS ks FROM h), r AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS seen, false AS keep UNION ALL SELECT k.k, CASE WHEN list_has_any(seen, ks) THEN seen ELSE list_concat(seen, ks) END, NOT list_has_any(seen, ks) FROM r JOIN k ON k.k = r.k + 1) SELECT doc_id FROM k JOIN r ON r.k = k.k WHERE keep",
    "col_attribution": f"SELECT DISTINCT doc_id, coalesce({_ATTR}) AS quoted_source FROM rag_document",
    "col_canonical_urls": f"SELECT DISTINCT doc_id, {_CANON.format(u='url')} AS canonical_url, lower({_PATH.format(u='url')}) NOT IN ('', '/index.html', '/index.htm', '/home', '/default.aspx', '/index') AND NOT regexp_matches(lower({_PATH.format(u='url')}), '/index(_\\d+)?\\.(html?|php|jsp|aspx?)$|pageindex=\\d+|/overview(\\.html?|\\.aspx?)?$|/sitemap|/wzdt_|sakuin\\.pdf$|/category/|/channel/|/tag/|/topic/') AS is_article FROM raw_docs",
    "col_safe_links": r"SELECT DISTINCT doc_id, CASE WHEN regexp_matches(url, '^https://[^/?#:@]*\.[^/?#:@]*(:443)?([/?#]|$)') AND NOT regexp_matches(url, '^https://[\d.]+([/?#:]|$)') THEN 'https://' || lower(regexp_extract(url, '^https://([^/?#:]+)', 1)) || coalesce(nullif(regexp_extract(url, '^https://[^/?#]+([^?#]*)', 1), ''), '/') || coalesce('?' || nullif(regexp_extract(url, '\?([^#]*)', 1), ''), '') END AS link FROM rag_document",
    "col_titles": f"SELECT DISTINCT doc_id, {_TITLE} AS title FROM raw_docs",
    "col_fingerprints": r"SELECT DISTINCT doc_id, CASE WHEN regexp_replace(lower(text), '[^\p{L}\p{N}_]', '', 'g') = '' THEN '' ELSE sha256(regexp_replace(lower(text), '[^\p{L}\p{N}_]', '', 'g')) END AS fingerprint, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS content_hash FROM rag_document",
    "col_site_meta": f"WITH {_H}, {_SUFFIX} SELECT h.doc_id, m.domain AS matched_domain, coalesce(m.tier, 3) AS site_tier, coalesce(m.country, 'UNKNOWN') AS site_country, coalesce(m.weight, 0.5) AS site_weight FROM h LEFT JOIN m ON m.doc_id = h.doc_id AND k = 1",
    "col_body_recovery": f"WITH {_H}, b AS (SELECT {_CANON.format(u='url')} AS cu, text FROM rag_document WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_CANON.format(u='url')} ORDER BY collected_at DESC) = 1) SELECT CASE WHEN trim(coalesce(article_text, '')) <> '' THEN 'search' WHEN coalesce(b.text, '') <> '' THEN 'recovered' ELSE 'failed' END AS acquired, count(*) AS docs FROM h LEFT JOIN b ON cu = {_CANON.format(u='url')} GROUP BY 1",
    "col_lenient_dates": f"SELECT DISTINCT doc_id, CAST({_LEN} AS VARCHAR) AS published, CASE WHEN published_date IS NULL THEN 'missing' WHEN {_LEN} IS NULL THEN 'unreadable' ELSE 'ok' END AS warning FROM raw_docs",
    "col_gate_reasons": f"WITH {_H}, g AS (SELECT *, {_LEN} AS d FROM h), r AS (SELECT url, collected_at, doc_id, CASE WHEN length(trim(coalesce(article_text, ''))) < 40 THEN 'body_unavailable' WHEN coalesce(language, 'unknown') IN ('unknown', 'und', '') THEN 'language_uncertain' WHEN language NOT IN ('en', 'ko', 'zh', 'ja') THEN 'language_not_selected' WHEN source_category = 'official_government' AND d IS NOT NULL AND d NOT BETWEEN DATE '2026-08-31' AND DATE '2026-09-30' THEN 'published_outside_window' ELSE 'kept' END AS reason FROM g) SELECT reason, count(*) AS urls FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY url ORDER BY collected_at DESC, doc_id DESC) = 1) GROUP BY 1",
    "col_title_dedup": f"WITH {_H}, t AS (SELECT doc_id, collected_at, {_TITLE} AS k FROM h) SELECT doc_id FROM t QUALIFY k = '' OR row_number() OVER (PARTITION BY k ORDER BY collected_at, doc_id) = 1",
    "col_adaptive_top": f"WITH {_H}, s AS (SELECT {_CK} AS country, doc_id, coalesce(score, 0) AS score FROM h WHERE coalesce(score, 0) >= 0.35) SELECT country, doc_id, score < 0.7 AS backfilled, row_number() OVER (PARTITION BY country ORDER BY score < 0.7, score DESC, doc_id) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY country ORDER BY score < 0.7, score DESC, doc_id) <= 20",
    "col_quota_fill": f"""WITH {_H}, s AS (SELECT CASE WHEN {_CK} IN ('CN', 'TW', 'HK', 'JP', 'KR', 'PK', 'IN', 'US') THEN {_CK} ELSE 'US' END AS country, doc_id, language, coalesce(score, 0) AS score, source_category = 'official_government' AS official FROM h WHERE language IN ('en', 'ko', 'zh', 'zh-Hant', 'ja')),
b AS (SELECT *, first_value(score) OVER w AS best, first_value(doc_id) OVER w AS lead, official AND row_number() OVER (PARTITION BY country ORDER BY official DESC, score DESC, doc_id) = 1 AS kept FROM s WINDOW w AS (PARTITION BY country, language ORDER BY score DESC, doc_id)),
r AS (SELECT *, CASE WHEN kept THEN 0 ELSE row_number() OVER (PARTITION BY country, language ORDER BY kept, score DESC, doc_id) END AS round FROM b),
t AS (SELECT country, doc_id, row_number() OVER (PARTITION BY country ORDER BY round, best DESC, lead, doc_id) AS turn FROM r)
SELECT * FROM t WHERE turn <= CASE country WHEN 'CN' THEN 7 WHEN 'TW' THEN 7 WHEN 'HK' THEN 6 ELSE 20 END""",
    "col_quota_table": "SELECT n AS request, c AS country, CAST(CASE WHEN c = 'HK' THEN n // 3 WHEN c = 'CN' THEN (n + 2) // 3 WHEN c = 'TW' THEN (n + 1) // 3 ELSE n END AS INTEGER) AS quota FROM (VALUES (20), (1), (0)) a(n), (VALUES ('CN'), ('TW'), ('HK'), ('JP'), ('KR'), ('PK'), ('IN'), ('US')) b(c)",
    "col_balanced": f"WITH {_H}, s AS (SELECT doc_id, lower(trim(regexp_replace(source_name, '\\s+', ' ', 'g'))) AS source, {_CANON.format(u='url')} AS k, collected_at FROM h), p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY collected_at, doc_id) AS place FROM s), o AS (SELECT * FROM p WHERE place <= 3 QUALIFY row_number() OVER (PARTITION BY k ORDER BY place, source, collected_at, doc_id) = 1) SELECT doc_id, source, place FROM o ORDER BY place, source, collected_at, doc_id LIMIT 60",
    "col_official_coverage": f"WITH {_H} SELECT {_CK} AS country, count(*) AS docs, count(*) FILTER (source_category = 'official_government') AS official_docs FROM h GROUP BY 1",
    "col_missing_official": f"WITH {_H} SELECT DISTINCT country FROM source_registry WHERE country NOT IN (SELECT {_CK} FROM h WHERE source_category = 'official_government')",
    "col_official_addition": f"WITH {_H} SELECT DISTINCT {_CANON.format(u='url')} AS url_key FROM h WHERE score >= 0.7 OR source_category = 'official_government'",
    "col_language_counts": f"WITH {_H} SELECT l.language, count(doc_id) AS candidates, count(doc_id) FILTER (score >= 0.7) AS retained FROM (VALUES ('en'), ('ko'), ('zh'), ('zh-Hant'), ('ja'), ('hi'), ('ur'), ('fr')) l(language) LEFT JOIN h ON h.language = l.language GROUP BY 1",
    "col_body_gates": f"WITH {_H}, n AS (SELECT length(trim(coalesce(article_text, ''))) AS n FROM h) SELECT CASE WHEN n < 40 THEN 'unusable' WHEN n < 80 THEN 'short' WHEN n < 200 THEN 'review' ELSE 'full' END AS band, count(*) AS docs, CAST(sum(n) AS BIGINT) AS chars FROM n GROUP BY 1",
    "col_adapter": f"WITH {_H}, l AS (SELECT * FROM rag_document QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY collected_at DESC) = 1) SELECT h.doc_id, 'doc_' || substr(sha256(h.url), 1, 8) AS stable_id, CASE WHEN trim(coalesce(article_text, '')) <> '' THEN 'cleaned' WHEN trim(coalesce(raw_content, '')) <> '' THEN 'raw' WHEN trim(coalesce(text, '')) <> '' THEN 'paragraphs' END AS text_origin, coalesce(length(substr(CASE WHEN trim(coalesce(article_text, '')) <> '' THEN article_text WHEN trim(coalesce(raw_content, '')) <> '' THEN raw_content ELSE text END, 1, 60000)), 0) AS n_chars FROM h LEFT JOIN l ON l.doc_id = h.doc_id",
    "col_search_scan": f"WITH h AS (SELECT DISTINCT doc_id, url FROM raw_docs WHERE collected_at >= TIMESTAMP '2026-05-02' AND collected_at < TIMESTAMP '2026-06-01'), {_SUFFIX} SELECT domain, count(*) AS docs FROM m WHERE k = 1 GROUP BY 1",
}
