"""Joins the engine adds to the built-in ones: by host suffix, by interval, by containment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.urls import host, host_suffixes

BROADCAST_ROWS = 100_000


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, else left to a shuffle join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def suffix_join(docs: DataFrame, registry: DataFrame, key: str, url: str = "url", order: str | None = None) -> DataFrame:
    """Each document's registry row: the first, by ``order`` (a column of the registry, of least value first), whose
    domain is the host or a parent of it; without ``order`` the longest such domain.

    The theta join becomes an equi join on exploded host suffixes, reduced to one row per
    ``key``; unmatched documents keep nulls. ``registry`` holds ``domain`` and its columns.
    """
    hosts = docs.select(key, host(F.col(url)).alias("_h")).where("_h is not null").distinct()
    long = hosts.select(key, F.explode(host_suffixes(F.col("_h"))).alias("domain"))
    rest = [c for c in registry.columns if c != "domain"]
    match = long.join(sized(registry), "domain").groupBy(key).agg((F.min_by(F.struct("domain", *rest), order) if order else F.max_by(F.struct("domain", *rest), F.struct(F.length("domain"), "domain"))).alias("m")).select(key, F.col("m.domain").alias("matched_domain"), *[F.col(f"m.{c}").alias(f"reg_{c}") for c in rest])
    return docs.join(match, key, "left")


def first_interval(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, order: str) -> DataFrame:
    """Each point with the first span (by ``order``) that holds it, both ends included; else nulls.

    A span without an end goes on. Spans are cut into months, as far as there are points, so that
    the range join is an equi join with a residual filter.
    """
    last = points.agg(F.max(at).alias("_last"))  # one row
    rest = spans.columns
    stop = F.least(F.coalesce(F.col(end), F.col("_last")), F.col("_last"))
    months = F.explode(F.sequence(F.trunc(start, "month"), F.trunc("_stop", "month"), F.expr("interval 1 month"))).alias("_m")
    long = spans.crossJoin(F.broadcast(last)).withColumn("_stop", stop).where(F.col(start) <= F.col("_stop")).select(*rest, months)
    held = points.select(F.col(at)).distinct().withColumn("_m", F.trunc(at, "month")).join(sized(long), "_m").where((F.col(at) >= F.col(start)) & (F.col(end).isNull() | (F.col(at) <= F.col(end))))
    first = held.groupBy(at).agg(F.min_by(F.struct(*rest), order).alias("s")).select(at, "s.*")
    return points.join(first, at, "left")


def containment_join(quotes: DataFrame, paragraphs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Quotes (doc, quote_id, quote) with the only paragraph (doc, paragraph_no, paragraph) of their
    document that holds them; ``matches`` counts them and only a single match gives a number."""
    hits = quotes.join(paragraphs, doc).where(F.expr("contains(paragraph, quote)"))
    one = hits.groupBy(doc, "quote_id").agg(F.count("*").alias("matches"), F.min("paragraph_no").alias("paragraph_no"))
    out = quotes.join(one, [doc, "quote_id"], "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return out.withColumn("paragraph_no", F.when(F.col("matches") == 1, F.col("paragraph_no")))
