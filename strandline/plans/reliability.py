"""How reliable each document is, repetition inside a country discounted.

A document's score is the weighted mean, over the other documents of its event, of the
probability that a pair of such similarity takes the same stance; a country's documents
weigh less the more they resemble each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.keys import source_key
from strandline.functions.numbers import LABELS, SAME_STANCE, clipped_cosine, label, unit_vector
from strandline.operators.joins import sized
from strandline.operators.search import nearest
from strandline.operators.pairs import pair_sums, similar_pairs
from strandline.session import settled
from strandline.sources.tables import table

SHRINKAGE = 3.0


def scored_documents(documents: DataFrame, embeddings: DataFrame, registry: DataFrame) -> DataFrame:
    """(event, id, country, weight, vec): documents with a vector; unknown weights take the default 0.5."""
    weight = registry.where("source_name is not null").groupBy(source_key(F.col("source_name")).alias("source")).agg(F.max("weight").alias("weight"))
    vectors = embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("event"), unit_vector(F.col("embedding")).alias("vec")).where("vec is not null")
    docs = documents.select(F.col("doc_id").alias("id"), F.coalesce("country", F.lit("UNKNOWN")).alias("country"), source_key(F.col("source")).alias("source"))
    return docs.join(vectors, "id").join(sized(weight), "source", "left").select("event", "id", "country", F.coalesce("weight", F.lit(0.5)).alias("weight"), "vec")


def country_discount(sums: DataFrame, docs: DataFrame, group: str, m: float = SHRINKAGE) -> DataFrame:
    """(group, country, n, rho_hat, n_eff, u): the mean similarity inside each country shrunk toward
    that of all same-country pairs, and what one of its documents weighs."""
    own = sums.where("country = partner_country").groupBy(group, "country").agg((F.sum("n") / 2).alias("pairs"), (F.sum("sims") / 2).alias("sims"))
    whole = own.groupBy(group).agg((F.sum("sims") / F.sum("pairs")).alias("rho_all"))
    sizes = docs.groupBy(group, "country").agg(F.count("*").alias("n"))
    out = sizes.join(own, [group, "country"], "left").join(whole, group, "left")
    rho = F.when(F.col("pairs") > 0, (F.col("sims") + m * F.col("rho_all")) / (F.col("pairs") + m))
    n_eff = F.when(rho.isNotNull(), F.col("n") / (1 + (F.col("n") - 1) * rho)).otherwise(F.lit(1.0))
    return out.select(group, "country", "n", rho.alias("rho_hat"), n_eff.alias("n_eff"), F.when(rho.isNotNull(), n_eff / F.col("n")).otherwise(F.lit(1.0)).alias("u"))


def reliability(docs: DataFrame, group: str = "event", m: float = SHRINKAGE, bands: tuple[tuple[float, float], ...] = SAME_STANCE) -> tuple[DataFrame, DataFrame]:
    """(scores, countries): a score per document, null where nothing can be compared."""
    docs = settled(docs)
    sums = settled(pair_sums(docs, group, bands))
    countries = country_discount(sums, docs, group, m)
    discount = sized(settled(countries.select(group, F.col("country").alias("partner_country"), "u")))
    total = sums.join(discount, [group, "partner_country"]).groupBy(group, "id").agg(F.sum(F.col("weighted") * F.col("u")).alias("num"), F.sum(F.col("weight") * F.col("u")).alias("den"))
    score = F.when(F.col("den") > 0, F.round(F.col("num") / F.col("den"), 4))
    scores = docs.select(group, "id", "country").join(total, [group, "id"], "left").select(group, "id", "country", score.alias("reliability"), label(score).alias("label"))
    return scores, countries


def attach_scores(claims: DataFrame, scores: DataFrame) -> DataFrame:
    """Claims with the score of their document; an unknown document leaves the label withheld."""
    known = scores.select(F.col("id").alias("document_id"), "reliability")
    return claims.join(known, "document_id", "left").withColumn("label", label(F.col("reliability")))


def label_counts(scored: DataFrame) -> DataFrame:
    """Every label with its count, zeros included."""
    every = scored.sparkSession.createDataFrame([(x,) for x in LABELS], "label string")
    return every.join(scored.groupBy("label").agg(F.count("*").alias("n")), "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "source_registry"))


def rel_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reliability(_docs(spark, sf_dir))[0]


def rel_country_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reliability(_docs(spark, sf_dir))[1]
    return out.select("event", "country", "n", *[F.round(c, 4).alias(c) for c in ("rho_hat", "n_eff", "u")])


def rel_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_counts(rel_scores(spark, sf_dir))


def rel_claim_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("-c1")).alias("claim_id"), F.col("doc_id").alias("document_id"))
    return attach_scores(claims, rel_scores(spark, sf_dir))


def rel_similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(_docs(spark, sf_dir), "event", 0.2)


def rel_question_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of a label held against the label's lowest id as the question."""
    docs = _docs(spark, sf_dir)
    question = sized(docs.groupBy("event").agg(F.min_by("vec", "id").alias("q")), 10_000)
    return docs.join(question, "event").select("event", "id", clipped_cosine(F.col("vec"), F.col("q")).alias("sim"))


def rel_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 as a query against all vectors."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return nearest(vectors, vectors.where("id % 100 = 0"))


_BASE = r"""
w AS (SELECT lower(trim(regexp_replace(source_name, '\s+', ' ', 'g'))) AS source, max(weight) AS weight FROM source_registry WHERE source_name IS NOT NULL GROUP BY 1),
e AS (SELECT vec_id AS id, label AS event, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
d AS (SELECT e.event, e.id, coalesce(country, 'UNKNOWN') AS country, coalesce(w.weight, 0.5) AS weight, vec FROM documents JOIN e ON e.id = doc_id LEFT JOIN w ON w.source = lower(trim(regexp_replace(documents.source, '\s+', ' ', 'g')))),
p AS (SELECT a.event, a.id AS a, b.id AS b, a.country AS ca, b.country AS cb, b.weight AS wb, round(least(1.0, greatest(0.0, list_cosine_similarity(a.vec, b.vec))), 6) AS sim FROM d a JOIN d b ON a.event = b.event AND a.id <> b.id),
s AS (SELECT event, ca AS country, count(*) / 2 AS pairs, sum(sim) / 2 AS sims FROM p WHERE ca = cb GROUP BY 1, 2),
g AS (SELECT event, sum(sims) / sum(pairs) AS rho_all FROM s GROUP BY 1),
n AS (SELECT event, country, count(*) AS n FROM d GROUP BY 1, 2),
r AS (SELECT n.event, n.country, n.n, CASE WHEN pairs > 0 THEN (sims + 3 * rho_all) / (pairs + 3) END AS rho FROM n LEFT JOIN s ON s.event = n.event AND s.country = n.country LEFT JOIN g ON g.event = n.event),
u AS (SELECT event, country, n, rho AS rho_hat, CASE WHEN rho IS NULL THEN 1.0 ELSE n / (1 + (n - 1) * rho) END AS n_eff, CASE WHEN rho IS NULL THEN 1.0 ELSE 1 / (1 + (n - 1) * rho) END AS u FROM r),
q AS (SELECT p.event, a, sum(wb * u * CASE WHEN sim < 0.5 THEN 0.17 WHEN sim < 0.55 THEN 0.22 WHEN sim < 0.6 THEN 0.27 WHEN sim < 0.65 THEN 0.38 WHEN sim < 0.7 THEN 0.4 WHEN sim < 0.75 THEN 0.42 WHEN sim < 0.8 THEN 0.61 WHEN sim < 0.85 THEN 0.85 WHEN sim < 0.9 THEN 0.95 ELSE 0.99 END) AS num, sum(wb * u) AS den FROM p JOIN u ON u.event = p.event AND u.country = p.cb GROUP BY 1, 2),
sc AS (SELECT d.event, d.id, d.country, CASE WHEN den > 0 THEN round(num / den, 4) END AS reliability FROM d LEFT JOIN q ON q.event = d.event AND q.a = d.id),
lb AS (SELECT *, CASE WHEN reliability >= 0.7 THEN '값 일치' WHEN reliability >= 0.6 THEN '개연성 있음' ELSE '판단 보류' END AS label FROM sc)
"""

QUERIES = {f.__name__: f for f in (rel_scores, rel_country_discount, rel_label_counts, rel_claim_scores, rel_similar_pairs, rel_question_similarity, rel_vector_search)}
SQL = {
    "rel_scores": f"WITH {_BASE} SELECT event, id, country, reliability, label FROM lb",
    "rel_country_discount": f"WITH {_BASE} SELECT event, country, n, round(rho_hat, 4) AS rho_hat, round(n_eff, 4) AS n_eff, round(u, 4) AS u FROM u",
    "rel_label_counts": f"WITH {_BASE} SELECT l.label, count(lb.label) AS n FROM (VALUES ('값 일치'), ('개연성 있음'), ('판단 보류')) l(label) LEFT JOIN lb ON lb.label = l.label GROUP BY 1",
    "rel_claim_scores": f"WITH {_BASE} SELECT doc_id AS document_id, doc_id || '-c1' AS claim_id, reliability, coalesce(lb.label, '판단 보류') AS label FROM documents LEFT JOIN lb ON lb.id = doc_id",
    "rel_similar_pairs": f"WITH {_BASE} SELECT event, a, b, sim FROM p WHERE a < b AND sim >= 0.2",
    "rel_vector_search": "WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings), s AS (SELECT a.id AS query_id, b.id, round(least(1.0, greatest(0.0, list_cosine_similarity(a.vec, b.vec))), 6) AS sim FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s QUALIFY rank <= 10",
    "rel_question_similarity": f"WITH {_BASE} SELECT d.event, d.id, round(least(1.0, greatest(0.0, list_cosine_similarity(d.vec, f.vec))), 6) AS sim FROM d JOIN (SELECT event, arg_min(vec, id) AS vec FROM d GROUP BY 1) f ON f.event = d.event",
}
