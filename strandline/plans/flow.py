"""Whole runs over the project's tables: a collection plan, the analysis of snippets, evidence packets and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import cleaning, dates, fixed, text, urls
from strandline.functions.keys import country_key, source_key
from strandline.operators.dedup import greedy_dedup, last_by
from strandline.operators.joins import containment_join, sized, suffix_join
from strandline.operators.ranking import adaptive_top_k, country_quotas
from strandline.operators.windows import greedy_pack
from strandline.plans import claims, collection, reliability, reports
from strandline.plans.collection import hits
from strandline.session import settled
from strandline.sources.sinks import unique_export
from strandline.sources.tables import table

LANGUAGES = ("en", "ko", "zh", "zh-Hant", "ja")
AS_OF, DAYS_BACK = "2026-09-30", 365
QUESTION = claims.QUESTION


def government_hosts(registry: DataFrame) -> dict[str, tuple[str, ...]]:
    """The official domains of each country: a registry is a short, fixed list, its size is checked."""
    rows = registry.where("source_category = 'official_government'" if "source_category" in registry.columns else "category = 'official_government'").select("country", "domain").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("a registry of more than 10,000 official domains is joined, not listed")
    out: dict[str, tuple[str, ...]] = {}
    for r in rows:
        out[r.country] = (*out.get(r.country, ()), r.domain)
    return out


def first_reason(reasons: dict[str, Column]) -> Column:
    """The name of the first condition that holds, null if none does."""
    return F.coalesce(*[F.when(holds, name) for name, holds in reasons.items()])


def collection_plan(found: DataFrame, official: dict[str, tuple[str, ...]], languages: tuple[str, ...], as_of: str, days_back: int, per_country: int) -> tuple[DataFrame, DataFrame]:
    """(chosen, rejected): hits through all gates in order, then duplicates, then the best of each country.

    ``found`` holds doc_id, ord, url, title, article_text, published_date, score and country. Rejected
    rows carry the first reason; duplicates of an accepted row by address, title or body are ``duplicate``.
    """
    body = F.coalesce("article_text", F.lit(""))
    told = found.withColumn("detected", text.body_language(body)).withColumn("published", dates.published_date(F.col("published_date"), F.col("url"), body))
    language, government = F.col("detected.language"), urls.is_official(F.col("url"), None, official)
    day = F.try_to_timestamp("published", F.lit("yyyy-MM-dd")).cast("date")
    dated = government & F.col("published").isNotNull()
    reason = first_reason(
        {
            "not_an_article": ~urls.is_article_url(F.col("url")),
            "body_unavailable": F.length(F.trim(body)) < 40,
            "language_uncertain": language == "unknown",
            "language_not_selected": ~language.isin(*languages),
            "invalid_published_date": dated & day.isNull(),
            "published_outside_window": dated & ~day.between(F.date_sub(F.lit(as_of).cast("date"), days_back), F.lit(as_of).cast("date")),
        }
    )
    judged = settled(
        told.select(
            "doc_id",
            "ord",
            "score",
            country_key(F.col("country")).alias("country"),
            reason.alias("reason"),
            urls.canonical_url(F.col("url")).alias("url_key"),
            text.canonical_title(F.col("title")).alias("title_key"),
            text.fingerprint(body).alias("body_key"),
        )
    )
    passed = judged.where("reason is null")
    kept = settled(greedy_dedup(passed, ["url_key", "title_key", "body_key"], "ord"))
    doubles = passed.join(kept.select("ord"), "ord", "left_anti").withColumn("reason", F.lit("duplicate"))
    chosen = adaptive_top_k(kept, ["country"], per_country, "doc_id").select("country", "doc_id", "rank", "backfilled")
    return chosen, judged.where("reason is not null").unionByName(doubles).select("doc_id", "reason")


def per_language(primary: DataFrame, fallback: DataFrame, asked: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(documents, attempts): the hits of each asked language, its full-query retry where no hit is in that language,
    duplicates of an earlier hit by address, title or body left out.

    Both tables hold lang_key (the language asked in), doc_id, ord, language and the three keys; languages
    come in the order asked, first searches before retries.
    """
    place = F.array_position(F.array(*map(F.lit, asked)), F.col("lang_key"))
    met = primary.where("language = lang_key").select("lang_key").distinct()
    retried = fallback.join(met, "lang_key", "left_anti")
    both = primary.withColumn("kind", F.lit("primary")).unionByName(retried.withColumn("kind", F.lit("full_query_retry"))).where(place > 0)
    both = settled(both.withColumn("turn", F.format_string("%03d-%d-%s-%s", place, F.when(F.col("kind") == "primary", 0).otherwise(1), F.col("ord"), F.col("doc_id"))))
    attempts = both.groupBy("lang_key", "kind").agg(F.count("*").alias("docs"), F.count_if(F.col("language") == F.col("lang_key")).alias("language_matches"))
    return greedy_dedup(both, ["url_key", "title_key", "body_key"], "turn").select("lang_key", "doc_id", "kind"), attempts


def search_queries(fragments: DataFrame, purposes: DataFrame, needed: list[str], event_date: str | None, most: int = 600) -> DataFrame:
    """(language, query, retrieval, problem): the texts a search of each language is made with.

    ``fragments`` (language, ord, text) are the translated parts of the question's meaning in order; ``purposes``
    (language, ord, key, text) the words for what is asked, of which ``needed`` are added. The query joins all parts
    once; the retrieval text joins the fragments once, letter case aside; a query over ``most`` characters is a
    problem and is not cut, a blank fragment is one too.
    """
    asked = purposes.where(F.col("key").isin(*needed)).select("language", (F.col("ord") + 1_000_000).alias("ord"), "text")
    date = [event_date] if event_date else []
    of = lambda rows: rows.groupBy("language").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: F.trim(x["text"])).alias("parts"))
    dated = F.array(*map(F.lit, date)).cast("array<string>")
    own = of(fragments).select("language", F.col("parts").alias("own"))
    out = own.join(of(fragments.select("language", "ord", "text").unionByName(asked)), "language")
    once = F.filter("own", lambda x, i: ~F.exists(F.slice("own", F.lit(1), i), lambda y: F.lower(y) == F.lower(x)))
    query = F.array_join(F.array_distinct(F.concat("parts", dated)), "; ")
    out = out.select("language", query.alias("query"), F.array_join(F.concat(once, dated), " ").alias("retrieval"), F.exists("own", lambda x: x == "").alias("blank"))
    return out.withColumn("problem", first_reason({"fragment_missing": F.col("blank"), "query_too_long": F.length("query") > most})).drop("blank")


def map_edges(countries: DataFrame, reprints: DataFrame) -> DataFrame:
    """(kind, from_country, to_country, n): an edge from every country to the event, and one from a reprint's country to its origin's."""
    hub = countries.select(F.lit("event").alias("kind"), F.col("country").alias("from_country"), F.lit(None).cast("string").alias("to_country"), F.col("docs").alias("n"))
    across = reprints.select(F.lit("reprint").alias("kind"), F.col("to_country").alias("from_country"), F.col("from_country").alias("to_country"), F.col("reprints").alias("n"))
    return hub.unionByName(across)


def question_focus(quotes: DataFrame, focus: str, required: bool) -> DataFrame:
    """Quotes with ``reason``: why one is no claim, else, with ``required``, that no acceptable quote of its document names the focus."""
    told = quotes.withColumn("reason", text.claim_rejection(F.col("quote")))
    if not required:
        return told
    named = F.coalesce(F.col("reason").isNull() & F.col("quote").rlike(f"(?i){focus}"), F.lit(False))
    docs = told.groupBy("doc_id").agg(F.bool_or(named).alias("in_focus"))
    return told.join(docs, "doc_id").withColumn("reason", F.coalesce("reason", F.when(~F.col("in_focus"), "question_focus_missing"))).drop("in_focus")


def snippet_analysis(docs: DataFrame, quotes: DataFrame, asked: tuple[str, ...]) -> DataFrame:
    """(doc_id, quotes, claims, claim_id, quote, state): per document its representative claim, or that it has to fall back on its body."""
    told = question_focus(quotes, fixed.TAIWAN_TERMS, False).withColumn("claim", F.col("reason").isNull() & text.is_substantive(F.col("quote")))
    per = told.groupBy("doc_id").agg(F.count("*").alias("quotes"), F.count_if("claim").alias("claims"))
    chosen = claims.representative(told.where("claim"), list(asked)).select("doc_id", "quote_id", "quote")
    out = docs.select("doc_id").distinct().join(per, "doc_id", "left").join(chosen, "doc_id", "left")
    state = F.when(F.coalesce("claims", F.lit(0)) > 0, "analyzed").when(F.coalesce("quotes", F.lit(0)) > 0, "fallback").otherwise("no_text")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("doc_id", zero("quotes"), zero("claims"), F.concat_ws("-C", "doc_id", "quote_id").alias("claim_id"), "quote", state.alias("state"))


def selection_summary(analysis: DataFrame) -> DataFrame:
    """One row: claims looked at, claims chosen, documents without any."""
    return analysis.agg(F.sum("claims").alias("analyzed_claims"), F.count_if(F.col("quote").isNotNull()).alias("exported_claims"), F.count_if(F.col("claims") == 0).alias("documents_without_claims"))


def evidence_packet(chosen: DataFrame, meta: DataFrame, paragraphs: DataFrame, scores: DataFrame) -> DataFrame:
    """Chosen claims with their document, the only paragraph that holds their quote and their score, missing ones told apart."""
    placed = containment_join(chosen.select("doc_id", "quote_id", "quote"), paragraphs)
    joined = placed.join(meta, "doc_id").join(scores, "doc_id", "left")
    warning = first_reason({"quote_not_found": F.col("matches") == 0, "quote_not_unique": F.col("matches") > 1, "score_missing": F.col("reliability").isNull()})
    return joined.withColumn("warning", F.coalesce(warning, F.lit("none")))


def run_checks(collected: DataFrame, exported: DataFrame, bodies: DataFrame, sims: DataFrame) -> DataFrame:
    """(check, broken): how many rows break each rule of a finished run; all zero for a sound one.

    ``collected`` holds doc_id, country, language and tier; ``exported`` one row a claim with doc_id, claim_id,
    country, language, tier, quote and event_date; ``bodies`` the texts a quote may stand in; ``sims`` the
    pairs (event, a, b, sim). Each rule is an aggregate or a join on ids.
    """
    ids = collected.select("doc_id").distinct()
    both = exported.join(collected.select("doc_id", *[F.col(c).alias(f"own_{c}") for c in ("country", "language", "tier")]), "doc_id")
    changed = lambda c: ~F.col(c).eqNullSafe(F.col(f"own_{c}"))
    stands = exported.select("doc_id", "claim_id", "quote").join(bodies, "doc_id", "left").groupBy("claim_id").agg(F.bool_or(F.coalesce(F.contains("text", "quote"), F.lit(False))).alias("ok"))
    mirrored = sims.select("event", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim")
    rules = {
        "collected_ids_unique": collected.groupBy("doc_id").count().where("count > 1"),
        "claims_of_collected_documents": exported.join(ids, "doc_id", "left_anti"),
        "one_claim_a_document": exported.groupBy("doc_id").count().where("count > 1"),
        "claim_ids_unique": exported.groupBy("claim_id").count().where("count > 1"),
        "country_preserved": both.where(changed("country")),
        "language_preserved": both.where(changed("language")),
        "tier_preserved": both.where(changed("tier")),
        "event_dates_iso": exported.where(F.col("event_date").isNotNull() & F.try_to_timestamp("event_date", F.lit("yyyy-MM-dd")).isNull()),
        "quotes_grounded": stands.where("not ok"),
        "no_similarity_with_itself": sims.where("a = b"),
        "similarities_in_range": sims.where("sim is null or isnan(sim) or sim < 0 or sim > 1"),
        "similarities_reciprocal": mirrored.groupBy("event", "a", "b").agg(F.min("sim").alias("x"), F.max("sim").alias("y")).where("x <> y"),
    }
    counts = [df.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("broken")) for name, df in rules.items()]
    return reduce(DataFrame.unionByName, counts)


def groups_for_publisher(groups: list[list[str]], country: str | None, parties: dict[str, str] = fixed.PARTY_NAMES) -> list[list[str]]:
    """The anchor groups a government's own page still has to name: its own party it satisfies as the publisher,
    if another group remains."""
    name = parties.get(country or "")
    rest = [g for g in groups if name not in text.name_variants(g)] if name else groups
    return rest or groups


# --- queries ---------------------------------------------------------------


EXPORT = ("doc_id", "title", "url", "score", "score_notice", "language", "tier", "source_name", "country", "published_date", "text_snippet", "source_category", "credibility_weight", "query", "status", "article_text")


def flw_collection_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixteen fields of a collection export, one row a document, its id asserted unique."""
    snippets = table(spark, sf_dir, "snippet_docs").groupBy("doc_id").agg(F.min("text_snippet").alias("text_snippet"))
    found = hits(spark, sf_dir, *[c for c in EXPORT if c not in ("doc_id", "text_snippet")]).join(snippets, "doc_id", "left")
    return unique_export(found, list(EXPORT), "doc_id")


def flw_run_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of a finished run over the collection as delivered, repeated rows and all."""
    raw = table(spark, sf_dir, "raw_docs")
    collected = raw.select("doc_id", country_key(F.col("country")).alias("country"), "language", "tier")
    claims_of = flw_verification_export(spark, sf_dir).select("doc_id", "claim_id", "country", "language", "quote")
    latest = hits(spark, sf_dir, "tier", "published_date").select("doc_id", "tier", F.col("published_date").alias("event_date"))
    bodies = raw.select("doc_id", F.col("article_text").alias("text")).unionByName(table(spark, sf_dir, "snippet_docs").select("doc_id", F.col("text_snippet").alias("text")))
    return run_checks(collected, settled(claims_of.join(latest, "doc_id")), bodies, reliability.rel_similar_pairs(spark, sf_dir))


def _latest(spark: SparkSession, sf_dir: str, *columns: str | Column) -> DataFrame:
    return last_by(table(spark, sf_dir, "rag_document").select("doc_id", "collected_at", *columns), ["doc_id"], "collected_at")


def _snippet_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.numbered_quotes(table(spark, sf_dir, "snippet_docs").select("doc_id", F.col("text_snippet").alias("text")).where("text is not null").distinct())


def _plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = hits(spark, sf_dir, "url", "title", "article_text", "published_date", "score", "country")
    return collection_plan(found, government_hosts(table(spark, sf_dir, "source_registry")), LANGUAGES, AS_OF, DAYS_BACK, 20)


def flw_plan_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)[0]


def flw_actor_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of one question over eight countries: sites count for their registered country, each country has its
    quota, three of them share one, and a document counts once over all countries."""
    registry = table(spark, sf_dir, "source_registry")
    found = collection.registered(hits(spark, sf_dir, "url", "title", "article_text", "published_date", "score"), registry).withColumn("country", F.col("site_country"))
    quotas = country_quotas(20, collection.COUNTRIES, collection.GREATER_CHINA)
    allowed = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    chosen, _ = collection_plan(found, government_hosts(registry), LANGUAGES, AS_OF, DAYS_BACK, max(quotas.values()))
    return chosen.where(F.col("rank") <= F.try_element_at(allowed, "country"))


def flw_plan_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)[1].groupBy("reason").agg(F.count("*").alias("docs"))


def flw_map_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_edges(reports.rep_countries(spark, sf_dir), reports.rep_cross_country(spark, sf_dir))


def flw_publisher_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The publisher group of each address: the first registered domain it lies in, else its host."""
    found = suffix_join(hits(spark, sf_dir, "url").select("doc_id", "url"), table(spark, sf_dir, "source_registry").select("domain", F.monotonically_increasing_id().alias("place")), "doc_id", order="place")
    return found.select("doc_id", F.coalesce("matched_domain", urls.host(F.col("url"))).alias("publisher_group"))


def _per_language(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents by the language asked in: reputable ones of languages as first searches, others as retries."""
    found = hits(spark, sf_dir, "url", "title", "article_text", "language", "tier", "source_category")
    asked_in = F.coalesce(F.element_at(F.split("source_category", "_"), 1), F.lit("none"))
    keyed = found.select(F.when(asked_in == "official", "ko").when(asked_in == "research", "fr").otherwise("en").alias("lang_key"), "doc_id", "ord", F.coalesce("language", F.lit("unknown")).alias("language"), "tier", urls.canonical_url(F.col("url")).alias("url_key"), text.canonical_title(F.col("title")).alias("title_key"), text.fingerprint(F.col("article_text")).alias("body_key"))
    return per_language(keyed.where("tier = 1").drop("tier"), keyed.where("tier > 1").drop("tier"), ("ko", "en", "fr"))


def flw_per_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_language(spark, sf_dir)[0]


def flw_language_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_language(spark, sf_dir)[1]


def flw_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir, "text").withColumn("d", text.body_language(F.col("text"))).select("doc_id", "d.language", "d.confidence")


def flw_clean_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages as article text, with how many kinds of page furniture were removed."""
    return _latest(spark, sf_dir, "raw_content").where("raw_content is not null").withColumn("c", cleaning.cleaned(F.col("raw_content"))).select("doc_id", "c.body", F.size("c.removed").alias("removed"))


def flw_review_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir, "raw_content", "text").withColumn("f", text.review_flags(F.col("raw_content"), F.col("text"))).select("doc_id", "f.paywall", "f.review")


def flw_official_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents on government domains, by country of the domain."""
    known = government_hosts(table(spark, sf_dir, "source_registry"))
    docs = hits(spark, sf_dir, "url").select("doc_id", "url")
    return docs.select("doc_id", F.coalesce(*[F.when(urls.is_official(F.col("url"), c, known), c) for c in sorted(known)]).alias("official")).where("official is not null")


QUESTIONS = ("양측 주장을 비교하고 일치와 불일치를 출처와 함께", "주요 보도의 입장만", "미확인 보도와 두 당사자의 모순", "확인되지 않은 주요 뉴스", "날씨")


def flw_question_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(q,) for q in QUESTIONS], "question string").unionByName(table(spark, sf_dir, "raw_docs").select(F.col("query").alias("question")).distinct())
    return asked.withColumn("f", text.question_flags(F.col("question"))).select("question", "f.*")


def flw_page_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of whole texts that are account or subscription furniture, and those that are claims, by document."""
    quotes = claims.numbered_quotes(_latest(spark, sf_dir, "text"))
    furniture = F.col("quote").rlike(f"(?i){fixed.CLAIM_BOILERPLATE}")
    return quotes.groupBy("doc_id").agg(F.count_if(furniture).alias("furniture"), F.count_if(~furniture).alias("others"))


def flw_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes by document and reason, documents out of the question's focus told apart."""
    told = question_focus(claims.numbered_quotes(_latest(spark, sf_dir, "text")), "strait|海峡|海峽|해협", True)
    return told.groupBy("doc_id", F.coalesce("reason", F.lit("claim")).alias("reason")).agg(F.count("*").alias("quotes"))


def flw_snippet_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snippet_analysis(table(spark, sf_dir, "raw_docs"), _snippet_quotes(spark, sf_dir), QUESTION)


def flw_selection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection_summary(flw_snippet_analysis(spark, sf_dir))


def flw_verification_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export of four document and six claim fields, one claim a document."""
    chosen = flw_snippet_analysis(spark, sf_dir).where("quote is not null")
    docs = hits(spark, sf_dir, "title", "country", "language").select("doc_id", "title", country_key(F.col("country")).alias("country"), "language")
    return chosen.join(docs, "doc_id").select("doc_id", "title", "country", "language", "claim_id", "quote", "quotes", "claims", "state")


def flw_scenario_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the range of scores, how many claims have one, and how many carry each label."""
    scored = reliability.rel_claim_scores(spark, sf_dir)
    labels = [F.count_if((F.col("label") == name) & F.col("reliability").isNotNull()).alias(column) for name, column in (("값 일치", "consistent"), ("개연성 있음", "plausible"), ("판단 보류", "withheld"))]
    return scored.agg(F.min("reliability").alias("least"), F.max("reliability").alias("most"), F.count("reliability").alias("evaluated"), F.count_if(F.col("reliability").isNull()).alias("unevaluated"), *labels)


def flw_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Representative claims of documents with their place and weight; a document without a weight has no score."""
    told = _snippet_quotes(spark, sf_dir).where(text.claim_rejection(F.col("quote")).isNull() & text.is_substantive(F.col("quote")))
    chosen = claims.representative(told, list(QUESTION))
    docs = _latest(spark, sf_dir, "title", "source_tier", "language", "source_country", "paragraphs", "credibility_weight")
    para = docs.select("doc_id", F.posexplode("paragraphs").alias("pos", "p")).select("doc_id", (F.col("pos") + 1).alias("paragraph_no"), F.col("p.text").alias("paragraph"))
    meta = docs.select("doc_id", "title", "language", country_key(F.col("source_country")).alias("country"))
    scores = docs.where("source_tier < 3").select("doc_id", F.round("credibility_weight", 4).alias("reliability"))
    return evidence_packet(chosen, meta, para, scores).select("doc_id", "quote_id", "title", "language", "country", "matches", "paragraph_no", "reliability", "warning")


def flw_evidence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of the evidence by country and language, with what is missing."""
    per = flw_evidence(spark, sf_dir).groupBy("country", "language")
    return per.agg(F.count("*").alias("claims"), F.count_if(F.col("reliability").isNull()).alias("without_score"), F.count_if(F.col("matches") == 0).alias("not_found"))


def flw_spike_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which much was collected, with the three sources most seen on them; days of low traffic have none."""
    days = table(spark, sf_dir, "raw_docs").select("doc_id", F.to_date("collected_at").alias("day"), source_key(F.col("source_name")).alias("source")).distinct()
    spikes = days.groupBy("day").agg(F.count("*").alias("docs")).where("docs >= 5")
    per = days.groupBy("day", "source").agg(F.count("*").alias("n"))
    w = Window.partitionBy("day").orderBy(F.desc("n"), "source")
    top = per.where("n >= 2").withColumn("k", F.row_number().over(w)).where("k <= 3").groupBy("day").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "source"))), lambda x: x["source"]), "|").alias("keywords"))
    return spikes.join(top, "day", "left").select(F.col("day").cast("string").alias("day"), "docs", F.coalesce("keywords", F.lit("")).alias("keywords"))


def flw_map_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a map export: documents that have an event, with their claims nested and a plain text of 1600 characters."""
    chosen = _snippet_quotes(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("claims"), F.min_by("quote", "quote_id").alias("first_claim"))
    docs = _latest(spark, sf_dir, "event_id", "title", "text", "source_tier")
    return docs.join(chosen, "doc_id", "left").select("doc_id", "event_id", "title", F.substring("text", 1, 1600).alias("original_text"), F.col("source_tier").cast("string").alias("tier"), F.coalesce("claims", F.lit(0)).alias("claims"), "first_claim")


def flw_pair_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of similar documents packed for comparison: at most 8 pairs and 18,000 characters a pack, in order."""
    pairs = reliability.rel_similar_pairs(spark, sf_dir).where("sim >= 0.3")
    size = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("a"), F.coalesce(F.length("text"), F.lit(0)).alias("na"))
    both = pairs.join(size, "a").join(size.select(F.col("a").alias("b"), F.col("na").alias("nb")), "b")
    rows = both.select("event", F.format_string("%012d-%012d", "a", "b").alias("ord"), (F.col("na") + F.col("nb")).alias("cost"))
    return greedy_pack(rows, "event", "ord", "cost", 18_000, 8).groupBy("event", "pack").agg(F.count("*").alias("pairs"), F.sum("cost").alias("chars"))


def flw_body_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the bodies of documents without a claim in their snippet, by exact offsets in the body."""
    without = flw_snippet_analysis(spark, sf_dir).where("state <> 'analyzed'").select("doc_id")
    bodies = _latest(spark, sf_dir, "text").join(sized(settled(without)), "doc_id", "left_semi")
    spans = bodies.select("doc_id", "text", F.explode(cleaning.candidates_of_body(F.col("text"))).alias("s"))
    return spans.select("doc_id", "s.start", "s.end", F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("quote"))


_L = "l AS (SELECT * FROM rag_document QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY collected_at DESC) = 1)"
_H = "h AS (SELECT * FROM raw_docs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY collected_at DESC) = 1)"
_HOST = "lower(regexp_extract(url, '^https?://([^/?#:]+)', 1))"
_N = lambda p: f"length(regexp_replace(text, '[^{p}]', '', 'g'))"
_SCRIPTS = f"""
n AS (SELECT doc_id, {_N(chr(92) + 'p{L}')} AS letters, {_N(chr(92) + 'p{Hangul}')} AS hangul, length(regexp_replace(regexp_replace(text, '[^\\p{{Hiragana}}\\p{{Katakana}}]', '', 'g'), '\\P{{L}}', '', 'g')) AS kana,
 length(regexp_replace(regexp_replace(text, '\\P{{Han}}', '', 'g'), '\\P{{L}}', '', 'g')) AS han, length(regexp_replace(regexp_replace(text, '\\P{{Latin}}', '', 'g'), '\\P{{L}}', '', 'g')) AS latin,
 length(regexp_replace(regexp_replace(text, '\\P{{Devanagari}}', '', 'g'), '\\P{{L}}', '', 'g')) AS deva, length(regexp_replace(regexp_replace(text, '\\P{{Arabic}}', '', 'g'), '\\P{{L}}', '', 'g')) AS arab,
 {_N(text.SIMPLIFIED_ONLY)} AS simp, {_N(text.TRADITIONAL_ONLY)} AS trad FROM l),
e AS (SELECT *, CASE WHEN hangul >= greatest(kana, han) THEN 'ko' WHEN kana > 0 AND kana * 10 >= han THEN 'ja' WHEN trad > simp THEN 'zh-Hant' ELSE 'zh' END AS east FROM n),
w AS (SELECT *, CASE east WHEN 'ko' THEN hangul + CASE WHEN hangul >= han THEN han ELSE 0 END WHEN 'ja' THEN kana + han ELSE han END AS east_n FROM e),
b AS (SELECT *, greatest(east_n, latin, deva, arab) AS best FROM w),
k AS (SELECT doc_id, CASE WHEN letters >= 40 THEN round(best / letters, 4) ELSE 0.0 END AS confidence, CASE WHEN arab = best AND (east_n < best OR 'ur' > east) THEN 'ur' WHEN east_n = best AND east > 'hi' THEN east WHEN deva = best THEN 'hi' WHEN latin = best THEN 'en' ELSE east END AS lang FROM b)
"""
_ANALYSIS = f"""{claims._SQ}, t AS (SELECT *, {claims._VISIBLE} AS v FROM q), t2 AS (SELECT *, {claims._BAD} AS reason, {claims._SUB} AS sub, {claims._OVERLAP} AS overlap FROM t),
per AS (SELECT doc_id, count(*) AS quotes, count(*) FILTER (reason IS NULL AND sub) AS claims FROM t2 GROUP BY 1),
ch AS (SELECT doc_id, quote_id, quote FROM t2 WHERE reason IS NULL AND sub QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, quote_id) = 1),
an AS (SELECT d.doc_id, coalesce(quotes, 0) AS quotes, coalesce(claims, 0) AS claims, CASE WHEN ch.quote_id IS NULL THEN d.doc_id ELSE d.doc_id || '-C' || ch.quote_id END AS claim_id, ch.quote, CASE WHEN coalesce(claims, 0) > 0 THEN 'analyzed' WHEN coalesce(quotes, 0) > 0 THEN 'fallback' ELSE 'no_text' END AS state FROM (SELECT DISTINCT doc_id FROM raw_docs) d LEFT JOIN per ON per.doc_id = d.doc_id LEFT JOIN ch ON ch.doc_id = d.doc_id)"""
_EVIDENCE = f"""{_ANALYSIS}, {_L},
p AS (SELECT doc_id, unnest(paragraphs).text AS paragraph, generate_subscripts(paragraphs, 1) AS no FROM l),
m AS (SELECT ch.doc_id, ch.quote_id, count(p.paragraph) AS matches, min(no) AS no FROM ch LEFT JOIN p ON p.doc_id = ch.doc_id AND contains(p.paragraph, ch.quote) GROUP BY 1, 2),
ev AS (SELECT m.doc_id, CAST(m.quote_id AS INTEGER) AS quote_id, title, language, coalesce(nullif(upper(trim(source_country)), ''), 'UNKNOWN') AS country, matches, CASE WHEN matches = 1 THEN CAST(no AS INTEGER) END AS paragraph_no, CASE WHEN source_tier < 3 THEN round(credibility_weight, 4) END AS reliability FROM m JOIN l ON l.doc_id = m.doc_id)"""
_ASKED = """
la AS (SELECT * EXCLUDE (language), CASE split_part(source_category, '_', 1) WHEN 'official' THEN 'ko' WHEN 'research' THEN 'fr' ELSE 'en' END AS lang_key, coalesce(language, 'unknown') AS language FROM h),
bo AS (SELECT *, CASE WHEN tier = 1 THEN 'primary' ELSE 'full_query_retry' END AS kind FROM la WHERE tier = 1 OR lang_key NOT IN (SELECT lang_key FROM la WHERE tier = 1 AND language = lang_key))
"""
_OWN = "coalesce(nullif(upper(trim(h.country)), ''), 'UNKNOWN') AS country"
_SITE = f"coalesce((SELECT upper(arg_min(r.country, r.place)) FROM (SELECT *, row_number() OVER () AS place FROM source_registry) r WHERE {_HOST.replace('url', 'h.url')} = r.domain OR ends_with({_HOST.replace('url', 'h.url')}, '.' || r.domain)), 'UNKNOWN') AS country"
_PLAN = f"""{_H}, l AS (SELECT doc_id, coalesce(article_text, '') AS text FROM h), {_SCRIPTS.replace('k AS (', 'kk AS (')},
pd AS ({collection.SQL['col_published_dates']}), cu AS ({collection.SQL['col_canonical_urls']}),
gv AS (SELECT DISTINCT doc_id FROM h JOIN source_registry r ON r.category = 'official_government' AND ({_HOST} = r.domain OR ends_with({_HOST}, '.' || r.domain))),
j AS (SELECT h.doc_id, collected_at, score, coalesce(nullif(upper(trim(h.country)), ''), 'UNKNOWN') AS country,
 list_filter(['u' || canonical_url, 't' || {collection._TITLE}, 'b' || regexp_replace(lower(coalesce(article_text, '')), '[^\\p{{L}}\\p{{N}}_]', '', 'g')], lambda x: length(x) > 1) AS ks,
 CASE WHEN NOT is_article THEN 'not_an_article' WHEN length(trim(coalesce(article_text, ''))) < 40 THEN 'body_unavailable' WHEN confidence < 0.8 THEN 'language_uncertain' WHEN lang NOT IN ({', '.join(f"'{x}'" for x in LANGUAGES)}) THEN 'language_not_selected'
 WHEN gv.doc_id IS NOT NULL AND published IS NOT NULL AND try_strptime(published, '%Y-%m-%d') IS NULL THEN 'invalid_published_date'
 WHEN gv.doc_id IS NOT NULL AND published IS NOT NULL AND CAST(try_strptime(published, '%Y-%m-%d') AS DATE) NOT BETWEEN DATE '{AS_OF}' - {DAYS_BACK} AND DATE '{AS_OF}' THEN 'published_outside_window' END AS reason
 FROM h JOIN kk ON kk.doc_id = h.doc_id JOIN pd ON pd.doc_id = h.doc_id JOIN cu ON cu.doc_id = h.doc_id LEFT JOIN gv ON gv.doc_id = h.doc_id),
z AS (SELECT *, row_number() OVER (ORDER BY collected_at, doc_id) AS k FROM j WHERE reason IS NULL),
fo AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS seen, false AS keep UNION ALL SELECT z.k, CASE WHEN list_has_any(seen, ks) THEN seen ELSE list_concat(seen, ks) END, NOT list_has_any(seen, ks) FROM fo JOIN z ON z.k = fo.k + 1)"""
_FLAGS = ", ".join(f"regexp_matches({'replace(c, chr(48520) || chr(51068) || chr(52824), chr(0))' if n == 'matching' else 'c'}, '{p.replace('(?<!불)', '')}') AS {n}" for n, p in fixed.QUESTION_FLAGS.items())
_PAY = " OR ".join(f"contains(lower(coalesce(raw_content, '')), '{w}')" for w in fixed.PAYWALL)

QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("flw_")}
SQL = {
    "flw_language": f"WITH {_L}, {_SCRIPTS} SELECT doc_id, CASE WHEN confidence >= 0.8 THEN lang ELSE 'unknown' END AS language, confidence FROM k",
    "flw_review_flags": f"WITH {_L} SELECT doc_id, ({_PAY}) AND length(text) < 400 AS paywall, (({_PAY}) AND length(text) < 400) OR length(text) < 200 AS review FROM l",
    "flw_official_hosts": f"WITH {_H} SELECT doc_id, min(r.country) AS official FROM h JOIN source_registry r ON r.category = 'official_government' AND ({_HOST} = r.domain OR ends_with({_HOST}, '.' || r.domain)) GROUP BY 1",
    "flw_question_flags": "WITH a AS (SELECT unnest([" + ", ".join(f"'{q}'" for q in QUESTIONS) + f"]) AS question UNION ALL SELECT DISTINCT query FROM raw_docs), b AS (SELECT question, regexp_replace(question, '\\s+', '', 'g') AS c FROM a) SELECT question, {_FLAGS} FROM b",
    "flw_page_quotes": f"WITH {claims.TEXT_QUOTES} SELECT doc_id, count(*) FILTER (f) AS furniture, count(*) FILTER (NOT f) AS others FROM (SELECT doc_id, regexp_matches(quote, '(?i){fixed.CLAIM_BOILERPLATE.replace(chr(39), chr(39) * 2)}') AS f FROM q) GROUP BY 1",
    "flw_rejections": f"WITH {claims.TEXT_QUOTES}, t AS (SELECT *, {claims._VISIBLE} AS v FROM q), t2 AS (SELECT *, {claims._BAD} AS reason FROM t), d AS (SELECT doc_id, bool_or(reason IS NULL AND regexp_matches(quote, '(?i)strait|海峡|海峽|해협')) AS f FROM t2 GROUP BY 1) SELECT doc_id, coalesce(reason, CASE WHEN f THEN 'claim' ELSE 'question_focus_missing' END) AS reason, count(*) AS quotes FROM t2 JOIN d USING (doc_id) GROUP BY 1, 2",
    "flw_snippet_analysis": f"WITH {_ANALYSIS} SELECT * FROM an",
    "flw_selection_summary": f"WITH {_ANALYSIS} SELECT CAST(sum(claims) AS BIGINT) AS analyzed_claims, count(quote) AS exported_claims, count(*) FILTER (claims = 0) AS documents_without_claims FROM an",
    "flw_verification_export": f"WITH {_ANALYSIS}, {_H} SELECT an.doc_id, title, coalesce(nullif(upper(trim(country)), ''), 'UNKNOWN') AS country, language, claim_id, quote, quotes, claims, state FROM an JOIN h ON h.doc_id = an.doc_id WHERE quote IS NOT NULL",
    "flw_scenario_summary": f"WITH {reliability._BASE}, c AS (SELECT doc_id, reliability, lb.label FROM documents LEFT JOIN lb ON lb.id = doc_id) SELECT min(reliability) AS least, max(reliability) AS most, count(reliability) AS evaluated, count(*) - count(reliability) AS unevaluated, count(*) FILTER (label = '값 일치' AND reliability IS NOT NULL) AS consistent, count(*) FILTER (label = '개연성 있음' AND reliability IS NOT NULL) AS plausible, count(*) FILTER (label = '판단 보류' AND reliability IS NOT NULL) AS withheld FROM c",
    "flw_evidence": f"WITH {_EVIDENCE} SELECT *, CASE WHEN matches = 0 THEN 'quote_not_found' WHEN matches > 1 THEN 'quote_not_unique' WHEN reliability IS NULL THEN 'score_missing' ELSE 'none' END AS warning FROM ev",
    "flw_evidence_coverage": f"WITH {_EVIDENCE} SELECT country, language, count(*) AS claims, count(*) FILTER (reliability IS NULL) AS without_score, count(*) FILTER (matches = 0) AS not_found FROM ev GROUP BY 1, 2",
    "flw_pair_packs": f"WITH RECURSIVE {reliability._BASE}, z AS (SELECT p.event, row_number() OVER (PARTITION BY p.event ORDER BY p.a, p.b) AS k, coalesce(length(x.text), 0) + coalesce(length(y.text), 0) AS cost FROM p JOIN documents x ON x.doc_id = p.a JOIN documents y ON y.doc_id = p.b WHERE p.a < p.b AND sim >= 0.3), pk AS (SELECT event, k, cost, CAST(1 AS BIGINT) AS pack, cost AS used, 1 AS held FROM z WHERE k = 1 UNION ALL SELECT z.event, z.k, z.cost, CASE WHEN r.used + z.cost > 18000 OR r.held >= 8 THEN r.pack + 1 ELSE r.pack END, CASE WHEN r.used + z.cost > 18000 OR r.held >= 8 THEN z.cost ELSE r.used + z.cost END, CASE WHEN r.used + z.cost > 18000 OR r.held >= 8 THEN 1 ELSE r.held + 1 END FROM pk r JOIN z ON z.event = r.event AND z.k = r.k + 1) SELECT event, pack, count(*) AS pairs, CAST(sum(cost) AS BIGINT) AS chars FROM pk GROUP BY 1, 2",
    "flw_language_attempts": f"WITH {_H}, {_ASKED} SELECT lang_key, kind, count(*) AS docs, count(*) FILTER (language = lang_key) AS language_matches FROM bo GROUP BY 1, 2",
    "flw_per_language": f"WITH RECURSIVE {_H}, {_ASKED}, z AS (SELECT *, row_number() OVER (ORDER BY list_position(['ko', 'en', 'fr'], lang_key), kind = 'full_query_retry', collected_at, doc_id) AS k, list_filter(['u' || {collection._CANON.format(u='url')}, 't' || {collection._TITLE}, 'b' || regexp_replace(lower(coalesce(article_text, '')), '[^\\p{{L}}\\p{{N}}_]', '', 'g')], lambda x: length(x) > 1) AS ks FROM bo), r AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS seen, false AS keep UNION ALL SELECT z.k, CASE WHEN list_has_any(seen, ks) THEN seen ELSE list_concat(seen, ks) END, NOT list_has_any(seen, ks) FROM r JOIN z ON z.k = r.k + 1) SELECT lang_key, doc_id, kind FROM z JOIN r ON r.k = z.k WHERE keep",
    "flw_plan_chosen": f"WITH RECURSIVE {_PLAN} SELECT country, doc_id, row_number() OVER (PARTITION BY country ORDER BY coalesce(score, 0) < 0.7, coalesce(score, 0) DESC, doc_id) AS rank, coalesce(score, 0) < 0.7 AS backfilled FROM z JOIN fo ON fo.k = z.k WHERE keep AND coalesce(score, 0) >= 0.35 QUALIFY rank <= 20",
    "flw_actor_plan": f"WITH RECURSIVE {_PLAN.replace(_OWN, _SITE)} SELECT country, doc_id, row_number() OVER (PARTITION BY country ORDER BY coalesce(score, 0) < 0.7, coalesce(score, 0) DESC, doc_id) AS rank, coalesce(score, 0) < 0.7 AS backfilled FROM z JOIN fo ON fo.k = z.k WHERE keep AND coalesce(score, 0) >= 0.35 AND country IN ('CN', 'TW', 'HK', 'JP', 'KR', 'PK', 'IN', 'US') QUALIFY rank <= CASE WHEN country IN ('CN', 'TW') THEN 7 WHEN country = 'HK' THEN 6 ELSE 20 END",
    "flw_plan_rejected": f"WITH RECURSIVE {_PLAN} SELECT reason, count(*) AS docs FROM (SELECT reason FROM j WHERE reason IS NOT NULL UNION ALL SELECT 'duplicate' FROM z JOIN fo ON fo.k = z.k WHERE NOT keep) GROUP BY 1",
    "flw_map_edges": f"SELECT 'event' AS kind, country AS from_country, CAST(NULL AS VARCHAR) AS to_country, docs AS n FROM ({reports.SQL['rep_countries']}) UNION ALL SELECT 'reprint', to_country, from_country, reprints FROM ({reports.SQL['rep_cross_country']})",
    "flw_publisher_groups": f"WITH {_H}, m AS (SELECT doc_id, domain FROM h JOIN (SELECT *, row_number() OVER () AS place FROM source_registry) r ON {_HOST} = domain OR ends_with({_HOST}, '.' || domain) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY place) = 1) SELECT h.doc_id, coalesce(domain, {_HOST}) AS publisher_group FROM h LEFT JOIN m ON m.doc_id = h.doc_id",
    "flw_collection_export": f"WITH {_H}, s AS (SELECT doc_id, min(text_snippet) AS text_snippet FROM snippet_docs GROUP BY 1) SELECT {', '.join('h.' + c if c != 'text_snippet' else c for c in EXPORT)} FROM h LEFT JOIN s ON s.doc_id = h.doc_id",
    "flw_run_checks": f"""WITH {_ANALYSIS}, {_H},
co AS (SELECT doc_id, coalesce(nullif(upper(trim(country)), ''), 'UNKNOWN') AS country, language, tier FROM raw_docs),
x AS (SELECT an.doc_id, claim_id, coalesce(nullif(upper(trim(country)), ''), 'UNKNOWN') AS country, language, quote, tier, published_date AS event_date FROM an JOIN h ON h.doc_id = an.doc_id WHERE quote IS NOT NULL),
y AS (SELECT x.*, co.country AS c2, co.language AS l2, co.tier AS t2 FROM x JOIN co ON co.doc_id = x.doc_id),
pp AS (WITH {reliability._BASE} SELECT a, b, sim FROM p WHERE a < b AND sim >= 0.2)
SELECT 'collected_ids_unique' AS "check", count(*) AS broken FROM (SELECT doc_id FROM co GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'claims_of_collected_documents', count(*) FROM x WHERE doc_id NOT IN (SELECT doc_id FROM co)
UNION ALL SELECT 'one_claim_a_document', count(*) FROM (SELECT doc_id FROM x GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'claim_ids_unique', count(*) FROM (SELECT claim_id FROM x GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'country_preserved', count(*) FROM y WHERE country IS DISTINCT FROM c2
UNION ALL SELECT 'language_preserved', count(*) FROM y WHERE language IS DISTINCT FROM l2
UNION ALL SELECT 'tier_preserved', count(*) FROM y WHERE tier IS DISTINCT FROM t2
UNION ALL SELECT 'event_dates_iso', count(*) FROM x WHERE event_date IS NOT NULL AND try_strptime(event_date, '%Y-%m-%d') IS NULL
UNION ALL SELECT 'quotes_grounded', count(*) FROM x WHERE NOT EXISTS (SELECT 1 FROM raw_docs r WHERE r.doc_id = x.doc_id AND contains(coalesce(article_text, ''), quote)) AND NOT EXISTS (SELECT 1 FROM snippet_docs r WHERE r.doc_id = x.doc_id AND contains(coalesce(text_snippet, ''), quote))
UNION ALL SELECT 'no_similarity_with_itself', count(*) FROM pp WHERE a = b
UNION ALL SELECT 'similarities_in_range', count(*) FROM pp WHERE sim NOT BETWEEN 0 AND 1
UNION ALL SELECT 'similarities_reciprocal', count(*) FROM (SELECT least(a, b), greatest(a, b) FROM pp GROUP BY 1, 2 HAVING min(sim) <> max(sim))""",
    "flw_spike_keywords": r"WITH d AS (SELECT DISTINCT doc_id, CAST(collected_at AS DATE) AS day, lower(trim(regexp_replace(source_name, '\s+', ' ', 'g'))) AS source FROM raw_docs), s AS (SELECT day, count(*) AS docs FROM d GROUP BY 1 HAVING count(*) >= 5), p AS (SELECT day, source, count(*) AS n FROM d GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, source) AS k FROM p WHERE n >= 2) SELECT CAST(s.day AS VARCHAR) AS day, docs, coalesce((SELECT string_agg(source, '|' ORDER BY k) FROM t WHERE t.day = s.day AND k <= 3), '') AS keywords FROM s",
    "flw_map_rows": f"WITH {claims._SQ}, {_L}, c AS (SELECT doc_id, count(*) AS claims, arg_min(quote, quote_id) AS first_claim FROM q GROUP BY 1) SELECT l.doc_id, event_id, title, substr(text, 1, 1600) AS original_text, CAST(source_tier AS VARCHAR) AS tier, coalesce(claims, 0) AS claims, first_claim FROM l LEFT JOIN c ON c.doc_id = l.doc_id",
}
