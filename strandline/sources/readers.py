"""Readers of collections in JSON and series in CSV, and adapters to the document form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.dates import lenient_date

DOCUMENT = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.StringType()), ("title", T.StringType()), ("url", T.StringType()), ("country", T.StringType()), ("language", T.StringType()), ("text_snippet", T.StringType()), ("article_text", T.StringType()), ("raw_content", T.StringType()), ("content", T.StringType()), ("published_date", T.StringType()), ("score", T.DoubleType()), ("tier", T.IntegerType()))]
)
LISTS = ("documents", "all_documents", "results")


def _shape() -> T.StructType:
    docs = T.ArrayType(DOCUMENT)
    inner = [T.StructField("question", T.StringType()), T.StructField("by_country", T.MapType(T.StringType(), docs)), *[T.StructField(n, docs) for n in LISTS]]
    return T.StructType([*inner, T.StructField("output", T.StructType(inner))])


def collection_json(spark: SparkSession, path: str) -> DataFrame:
    """(question, ord, document columns) of collection files.

    The documents stand under ``by_country``, ``documents``, ``all_documents`` or ``results``,
    all of it perhaps inside ``output``; a document without a country takes its group's name.
    A file of another shape gives no rows.
    """
    read = spark.read.schema(_shape()).option("multiLine", True).json(path)
    pick = lambda name: F.coalesce(F.col(f"output.{name}"), F.col(name))
    grouped = F.flatten(F.transform(F.map_entries(pick("by_country")), lambda e: F.transform(e["value"], lambda d: F.struct(e["key"].alias("g"), d.alias("d")))))
    plain = F.transform(F.coalesce(*[pick(n) for n in LISTS]), lambda d: F.struct(F.lit(None).cast("string").alias("g"), d.alias("d")))
    rows = read.select(pick("question").alias("question"), F.posexplode(F.coalesce(grouped, plain)).alias("ord", "r"))
    return rows.select("question", "ord", *[F.coalesce("r.d.country", "r.g").alias("country") if f.name == "country" else F.col(f"r.d.{f.name}") for f in DOCUMENT])


def retrieval_form(rows: DataFrame, clip: int = 60_000) -> DataFrame:
    """Collected rows as retrieval documents: article text before raw content before content,
    clipped, with its origin, kind and a date or a warning; rows without any text go."""
    some: list[tuple[str, str]] = [("article_text", "cleaned"), ("raw_content", "raw"), ("content", "paragraphs")]
    full = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    body, origin = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, kind in reversed(some):
        body, origin = F.when(full(name), F.col(name)).otherwise(body), F.when(full(name), F.lit(kind)).otherwise(origin)
    day = lenient_date(F.col("published_date"))
    kind: Column = F.when(F.length(body) > clip, "truncated").when(origin == "paragraphs", "snippet").otherwise("full")
    out = rows.select(
        F.coalesce("doc_id", F.concat(F.lit("doc_"), F.substring(F.sha2("url", 256), 1, 8))).alias("doc_id"),
        "title", "url", "language", F.col("country").alias("source_country"),
        F.substring(body, 1, clip).alias("text"), origin.alias("text_origin"), kind.alias("content_kind"), day.alias("published_date"),
        F.when(F.col("published_date").isNotNull() & day.isNull(), F.array(F.lit("published_date_unreadable"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )
    return out.where("text is not null")


def report_documents(reports: DataFrame) -> DataFrame:
    """(report_id, ord, title, text): the non-empty sources of nested reports, their parts joined."""
    rows = reports.select(F.col("id").alias("report_id"), F.posexplode("sources").alias("ord", "s"))
    return rows.select("report_id", "ord", F.col("s.title").alias("title"), F.concat_ws("\n", F.transform("s.paragraphs", lambda p: p["text"])).alias("text")).where("trim(text) <> ''")


def daily_series(spark: SparkSession, path: str) -> DataFrame:
    """(date, views) of a headed CSV; of repeated dates the last line counts."""
    rows = spark.read.option("header", True).schema("date string, views bigint").csv(path).withColumn("line", F.monotonically_increasing_id())
    return rows.groupBy(F.try_to_timestamp("date", F.lit("yyyy-MM-dd")).cast("date").alias("date")).agg(F.max_by("views", "line").alias("views")).where("date is not null")


def validated_json(rows: DataFrame, body: str, schema: T.StructType | str, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows with ``parsed`` where ``body`` has the schema and every check holds, and the
    others with their first ``problem``: ``unreadable`` or the name of a check. A null check fails."""
    parsed = rows.withColumn("parsed", F.from_json(body, schema, {"mode": "PERMISSIVE"}))
    problem = F.when(F.col("parsed").isNull() | F.to_json("parsed").isin("{}"), "unreadable")
    for name, check in checks.items():
        problem = problem.when(~F.coalesce(check, F.lit(False)), name)
    judged = parsed.withColumn("problem", problem)
    return judged.where("problem is null").drop("problem"), judged.where("problem is not null").drop("parsed")
