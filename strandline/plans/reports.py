"""Reports: binding of claims to sources, integrity checks, coverage, roll-ups and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.keys import country_key, source_key
from strandline.functions.numbers import haversine_km
from strandline.functions.text import body_display, strip_markup
from strandline.operators.dedup import last_by
from strandline.operators.joins import sized
from strandline.sources.tables import table

COUNTRY_ORDER = ("CN", "TW", "JP", "KR")
#: Capital positions (latitude, longitude) of the countries drawn.
CAPITALS = (("CN", 39.9, 116.4), ("TW", 25.03, 121.57), ("JP", 35.68, 139.69), ("KR", 37.57, 126.98), ("IN", 28.61, 77.21), ("PK", 33.68, 73.05), ("US", 38.9, -77.04), ("HK", 22.32, 114.17))


def tampered(expected: DataFrame, returned: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, problem): rows of ``returned`` that are unknown, repeated or changed, and expected rows that are missing."""
    counts = returned.groupBy(key).agg(F.count("*").alias("n"))
    repeated = counts.where("n > 1").select(key, F.lit("duplicate").alias("problem"))
    e, r = expected.select(key, F.struct(*fields).alias("e")), returned.select(key, F.struct(*fields).alias("r"))
    both = e.join(r, key, "full")
    changed = both.where(~F.col("e").eqNullSafe(F.col("r")))
    problem = F.when(F.col("e").isNull(), "unknown").when(F.col("r").isNull(), "missing").otherwise("changed")
    return changed.select(key, problem.alias("problem")).unionByName(repeated).distinct()


def consistent_summary(scored: DataFrame, summary: DataFrame, low: float, high: float) -> bool:
    """Whether stated label counts are those of the rows and the bounds are in order."""
    real = scored.groupBy("label").agg(F.count("*").alias("n"))
    wrong = summary.where("n is null or n < 0").isEmpty() and real.join(summary.where("n > 0"), ["label", "n"], "left_anti").isEmpty() and summary.where("n > 0").join(real, ["label", "n"], "left_anti").isEmpty()
    return 0 <= low < high <= 1 and wrong


def ranked_countries(docs: DataFrame) -> DataFrame:
    """Countries by number of documents, then a stated priority, then name."""
    place = F.array_position(F.array(*[F.lit(c) for c in COUNTRY_ORDER]), F.col("country"))
    counts = docs.groupBy("country").agg(F.count("*").alias("docs"))
    return counts.withColumn("priority", F.when(place > 0, place).otherwise(99).cast("int"))


def reprint_edges(docs: DataFrame) -> DataFrame:
    """(doc_id, origin_id): a reprint and the document of the publisher it quotes, the last of several."""
    origin = last_by(docs.where("not is_reprint_likely").select(F.col("publisher").alias("quoted"), F.col("doc_id").alias("origin_id"), "collected_at"), ["quoted"], "collected_at")
    return docs.where("is_reprint_likely").join(origin.select("quoted", "origin_id"), "quoted", "left").select("doc_id", "origin_id")


def grade(weight: Column) -> Column:
    return F.when(weight >= 0.7, "high").when(weight >= 0.4, "medium").otherwise("low")


def text_report(docs: DataFrame, group: str) -> DataFrame:
    """(group, report): numbered lines of one group's documents in order of title."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("title", "doc_id"))), lambda x, i: F.concat(F.lit("S"), (i + 1).cast("string"), F.lit(". "), x["title"], F.lit(" ["), x["doc_id"], F.lit("]")))
    return docs.groupBy(group).agg(F.array_join(lines, "\n").alias("report"))


def invariants(docs: DataFrame) -> DataFrame:
    """One row of counters that a sound table keeps at zero."""
    return docs.agg(
        F.count_if(F.col("doc_id").isNull()).alias("without_id"),
        F.count_if(~F.col("source_tier").between(1, 3)).alias("bad_tier"),
        F.count_if(F.isnan("credibility_weight") | ~F.col("credibility_weight").between(0, 1)).alias("bad_weight"),
        F.count_if(F.length("text") > 60000).alias("too_long"),
        (F.count("*") - F.countDistinct("doc_id")).alias("repeated"),
    )


# --- queries ---------------------------------------------------------------


def _docs(spark: SparkSession, sf_dir: str, *columns: str | Column) -> DataFrame:
    """The latest copy of each document; only the columns asked for are read and shuffled."""
    return last_by(table(spark, sf_dir, "rag_document").select("doc_id", "collected_at", *columns), ["doc_id"], "collected_at")


def rep_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after an upsert by key: the copy collected last."""
    return _docs(spark, sf_dir, "event_id", "language", F.length("text").alias("n_chars"), "source_tier").drop("collected_at")


def rep_tamper_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows delivered a second time against the first: every difference is named."""
    raw = table(spark, sf_dir, "raw_docs").select("doc_id", "title", "score", "tier", F.col("source_name"), "collected_at")
    first = raw.groupBy("doc_id").agg(F.min_by(F.struct("title", "score", "tier", "source_name"), "collected_at").alias("e")).select("doc_id", "e.*")
    return tampered(first, raw.drop("collected_at"), "doc_id", ["title", "score", "tier", "source_name"])


def rep_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir, country_key(F.col("source_country")).alias("country"))
    return ranked_countries(docs)


def rep_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "source_country", "language", "publisher_group", "is_reprint_likely").groupBy(country_key(F.col("source_country")).alias("country"), "language").agg(F.count("*").alias("docs"), F.countDistinct(source_key(F.col("publisher_group"))).alias("publishers"), F.count_if(~F.col("is_reprint_likely")).alias("originals"))


def rep_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.coalesce("credibility_weight", F.lit(0.5))
    return _docs(spark, sf_dir, "source_tier", "credibility_weight").groupBy("source_tier", grade(w).alias("grade")).agg(F.count("*").alias("docs"), F.round(F.avg(w), 4).alias("mean_weight"), F.min(w).alias("least"), F.max(w).alias("most"))


def rep_reprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir, "is_reprint_likely", source_key(F.col("publisher_group")).alias("publisher"), source_key(F.col("quoted_source")).alias("quoted"))
    edges = reprint_edges(docs)
    return edges.groupBy(F.col("origin_id").isNotNull().alias("resolved")).agg(F.count("*").alias("reprints"))


def rep_cross_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reprints that crossed a border, by pair of countries."""
    base = _docs(spark, sf_dir, "is_reprint_likely", "publisher_group", "quoted_source", "source_country")
    docs = base.select("doc_id", "is_reprint_likely", source_key(F.col("publisher_group")).alias("publisher"), source_key(F.col("quoted_source")).alias("quoted"), "collected_at")
    place = base.select("doc_id", country_key(F.col("source_country")).alias("country"))
    edges = reprint_edges(docs).where("origin_id is not null").join(place.withColumnRenamed("country", "to_country"), "doc_id").join(place.select(F.col("doc_id").alias("origin_id"), F.col("country").alias("from_country")), "origin_id")
    return edges.where("from_country <> to_country").groupBy("from_country", "to_country").agg(F.count("*").alias("reprints"))


def rep_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.createDataFrame(CAPITALS, "country string, lat double, lon double")
    o = c.select(F.col("country").alias("other"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return c.join(F.broadcast(o), F.col("country") < F.col("other")).select("country", "other", haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("km"))


def rep_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_report(_docs(spark, sf_dir, "event_id", "title"), "event_id")


def rep_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export projection, one row a document, with the source's registry weight."""
    docs = _docs(spark, sf_dir, "title", "url", "language", source_key(F.col("publisher_group")).alias("publisher"), "source_tier")
    reg = table(spark, sf_dir, "source_registry").where("source_name is not null").groupBy(source_key(F.col("source_name")).alias("publisher")).agg(F.max("weight").alias("weight"))
    return docs.join(sized(reg), "publisher", "left").select("doc_id", "title", "url", "language", "publisher", "source_tier", F.coalesce("weight", F.lit(0.5)).alias("weight"))


def rep_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event how many documents a map export holds, and the first; the rows themselves are ``flw_map_rows``."""
    docs = _docs(spark, sf_dir, "event_id")
    counts = docs.groupBy("event_id").agg(F.count("doc_id").alias("docs"), F.min("doc_id").alias("first_doc"))
    return table(spark, sf_dir, "rag_event").join(sized(counts), "event_id", "left").select("event_id", "label", F.coalesce("docs", F.lit(0)).alias("docs"), "first_doc")


def rep_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invariants(table(spark, sf_dir, "rag_document"))


def rep_body_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "text").select("doc_id", F.length(body_display(F.col("text"))).alias("shown"))


def rep_plain_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages as plain text by the simple mark-up strip."""
    return _docs(spark, sf_dir, "raw_content").where("raw_content is not null").select("doc_id", F.length(strip_markup(F.col("raw_content"))).alias("n_chars"))


def rep_pending_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose content has no cached result yet; results are keyed by a content digest."""
    docs = _docs(spark, sf_dir, F.sha2(F.to_json(F.struct("language", "text")), 256).alias("digest"), "source_tier")
    cached = docs.where("source_tier = 1").select("digest").distinct()
    return docs.join(cached, "digest", "left_anti").select("doc_id")


def rep_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review log of versioned appends: per user the latest event and the number of versions."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return e.groupBy("user_id").agg(F.count("*").alias("version"), F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))


def rep_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 rows collected last; each partition sends 30 at most."""
    return table(spark, sf_dir, "raw_docs").select("doc_id", "collected_at", "tier").distinct().orderBy(F.desc("collected_at"), "doc_id").limit(30).select("doc_id", "tier")


def rep_nation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by region and nation with subtotals and a total."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    per_supplier = lines.groupBy("l_suppkey").agg(F.sum("r").alias("r"), F.count("*").alias("n"))
    joined = per_supplier.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.rollup("r_name", "n_name").agg(F.round(F.sum("r"), 2).alias("revenue"), F.sum("n").alias("lines"))


_L = "l AS (SELECT * FROM rag_document QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY collected_at DESC) = 1)"
_SK = r"lower(trim(regexp_replace({c}, '\s+', ' ', 'g')))"
_CK = "coalesce(nullif(upper(trim(source_country)), ''), 'UNKNOWN')"
_EDGE = f"o AS (SELECT {_SK.format(c='publisher_group')} AS p, arg_max(doc_id, collected_at) AS origin_id FROM l WHERE NOT is_reprint_likely GROUP BY 1), e AS (SELECT doc_id, origin_id FROM l LEFT JOIN o ON p = {_SK.format(c='quoted_source')} WHERE is_reprint_likely)"

QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("rep_")}
SQL = {
    "rep_body_display": r"WITH l AS (SELECT * FROM rag_document QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY collected_at DESC) = 1), p AS (SELECT doc_id, regexp_replace(regexp_replace(text, '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '(?m)^[#>*\-\s]+|[*_`]', '', 'g') AS t FROM l), u AS (SELECT DISTINCT doc_id, trim(unnest(string_split(t, chr(10)))) AS x FROM p), n AS (SELECT doc_id, sum(length(x)) + 2 * (count(*) - 1) AS n FROM u WHERE x <> '' GROUP BY 1) SELECT l.doc_id, CAST(CASE WHEN n > 1600 THEN 1601 ELSE coalesce(n, 0) END AS INTEGER) AS shown FROM l LEFT JOIN n ON n.doc_id = l.doc_id",
    "rep_upsert": f"WITH {_L} SELECT doc_id, event_id, language, length(text) AS n_chars, source_tier FROM l",
    "rep_tamper_check": "WITH f AS (SELECT doc_id, arg_min(struct_pack(a := title, b := score, c := tier, d := source_name), collected_at) AS e FROM raw_docs GROUP BY 1) SELECT doc_id, 'duplicate' AS problem FROM raw_docs GROUP BY doc_id HAVING count(*) > 1 UNION SELECT r.doc_id, 'changed' FROM raw_docs r JOIN f ON f.doc_id = r.doc_id WHERE struct_pack(a := title, b := score, c := tier, d := source_name) IS DISTINCT FROM e",
    "rep_countries": f"WITH {_L} SELECT {_CK} AS country, count(*) AS docs, CAST(CASE {_CK} WHEN 'CN' THEN 1 WHEN 'TW' THEN 2 WHEN 'JP' THEN 3 WHEN 'KR' THEN 4 ELSE 99 END AS INTEGER) AS priority FROM l GROUP BY 1, 3",
    "rep_coverage": f"WITH {_L} SELECT {_CK} AS country, language, count(*) AS docs, count(DISTINCT {_SK.format(c='publisher_group')}) AS publishers, count(*) FILTER (NOT is_reprint_likely) AS originals FROM l GROUP BY 1, 2",
    "rep_grades": f"WITH {_L}, w AS (SELECT source_tier, coalesce(credibility_weight, 0.5) AS w FROM l) SELECT source_tier, CASE WHEN w >= 0.7 THEN 'high' WHEN w >= 0.4 THEN 'medium' ELSE 'low' END AS grade, count(*) AS docs, round(avg(w), 4) AS mean_weight, min(w) AS least, max(w) AS most FROM w GROUP BY 1, 2",
    "rep_reprints": f"WITH {_L}, {_EDGE} SELECT origin_id IS NOT NULL AS resolved, count(*) AS reprints FROM e GROUP BY 1",
    "rep_cross_country": f"WITH {_L}, {_EDGE}, c AS (SELECT doc_id, {_CK} AS country FROM l) SELECT b.country AS from_country, a.country AS to_country, count(*) AS reprints FROM e JOIN c a ON a.doc_id = e.doc_id JOIN c b ON b.doc_id = e.origin_id WHERE a.country <> b.country GROUP BY 1, 2",
    "rep_distances": "WITH c AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {a}, {b})" for c, a, b in CAPITALS) + ") v(country, lat, lon)) SELECT a.country, b.country AS other, CAST(round(2 * 6371 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS BIGINT) AS km FROM c a JOIN c b ON a.country < b.country",
    "rep_text": f"WITH {_L}, n AS (SELECT event_id, title, doc_id, row_number() OVER (PARTITION BY event_id ORDER BY title, doc_id) AS k FROM l) SELECT event_id, string_agg('S' || k || '. ' || title || ' [' || doc_id || ']', chr(10) ORDER BY k) AS report FROM n GROUP BY 1",
    "rep_export": f"WITH {_L}, r AS (SELECT {_SK.format(c='source_name')} AS publisher, max(weight) AS weight FROM source_registry WHERE source_name IS NOT NULL GROUP BY 1) SELECT doc_id, title, url, language, {_SK.format(c='publisher_group')} AS publisher, source_tier, coalesce(weight, 0.5) AS weight FROM l LEFT JOIN r ON publisher = {_SK.format(c='publisher_group')}",
    "rep_fusion": f"WITH {_L} SELECT e.event_id, e.label, CAST(count(l.doc_id) AS INTEGER) AS docs, min(l.doc_id) AS first_doc FROM rag_event e LEFT JOIN l ON l.event_id = e.event_id GROUP BY 1, 2",
    "rep_invariants": "SELECT count(*) FILTER (doc_id IS NULL) AS without_id, count(*) FILTER (source_tier NOT BETWEEN 1 AND 3) AS bad_tier, count(*) FILTER (isnan(credibility_weight) OR credibility_weight NOT BETWEEN 0 AND 1) AS bad_weight, count(*) FILTER (length(text) > 60000) AS too_long, count(*) - count(DISTINCT doc_id) AS repeated FROM rag_document",
    "rep_pending_cache": f"WITH {_L} SELECT doc_id FROM l WHERE NOT EXISTS (SELECT 1 FROM l c WHERE c.source_tier = 1 AND c.language = l.language AND c.text = l.text)",
    "rep_versions": "SELECT user_id, count(*) AS version, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY 1",
    "rep_recent": "SELECT doc_id, tier FROM (SELECT DISTINCT doc_id, collected_at, tier FROM raw_docs) ORDER BY collected_at DESC, doc_id LIMIT 30",
    "rep_nation_rollup": "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)",
}
