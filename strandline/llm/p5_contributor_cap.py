"""Capping what each contributor of a group supplies, the better records staying.

A histogram of the scores per contributor, merged by addition, shows in which bin the cap
is met. Records in better bins stay and those in worse bins go without being sorted; only
the records of that one bin are ranked, by a range-partitioned sort whose partitions stay
bounded even if one contributor holds most of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.keys import country_key, source_key
from strandline.operators.joins import sized
from strandline.session import settled

BINS = 4096


def capped(docs: DataFrame, percent: int = 15, least: int = 1, bins: int = BINS) -> DataFrame:
    """(country, source, doc_id, score, keep): every record with the verdict.

    Each source keeps at most ``percent`` per cent, rounded down, but at least ``least``, of
    its country's distinct ids. A null or NaN score counts as 0, null and blank countries are
    ``UNKNOWN``, a null source is a source of its own (the empty name), null ids give no
    row, an id counts once with its best score, ties go to the smaller id; other columns are
    ignored.
    """
    score = F.when(F.isnan("score"), 0.0).otherwise(F.coalesce("score", F.lit(0.0)))
    rows = settled(
        docs.select(country_key(F.col("country")).alias("country"), F.coalesce(source_key(F.col("source_name")), F.lit("")).alias("source"), "doc_id", score.cast("double").alias("score"))
        .where("doc_id is not null")
        .groupBy("country", "source", "doc_id")
        .agg(F.max("score").alias("score"))
    )
    key = ["country", "source"]
    low, high = rows.agg(F.min("score"), F.max("score")).first()
    width = ((high - low) / bins if low is not None else 0.0) or 1.0
    low = low or 0.0
    rows = rows.withColumn("bin", F.least(F.floor((F.col("score") - low) / width), F.lit(bins - 1)).cast("int"))
    hist = rows.groupBy(*key, "bin").agg(F.count("*").alias("n"))
    whole = rows.groupBy("country", "doc_id").agg(F.lit(1)).groupBy("country").agg(F.greatest(F.lit(least).cast("bigint"), F.expr(f"count(*) * {percent} div 100")).alias("cap"))
    best = Window.partitionBy(*key).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (
        hist.withColumn("upto", F.sum("n").over(best))
        .join(whole, "country")
        .where("upto >= cap")
        .groupBy(*key)
        .agg(F.max(F.struct("bin", (F.col("cap") - F.col("upto") + F.col("n")).alias("room"), (F.col("upto") > F.col("cap")).alias("split"))).alias("at"))
        .select(*key, F.col("at.bin").alias("cut"), "at.room", "at.split")
    )
    judged = rows.join(sized(settled(cut)), key, "left")
    clear = judged.where("cut is null or bin <> cut or not split").withColumn("keep", F.coalesce(F.col("bin") >= F.col("cut"), F.lit(True)))
    edge = judged.where("bin = cut and split")
    out = clear.select(*key, "doc_id", "score", "keep").unionByName(globally_ranked(edge, key, [F.desc("score"), F.asc("doc_id")]).withColumn("keep", F.col("rank") <= F.col("room")).select(*key, "doc_id", "score", "keep"))
    return out


def globally_ranked(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """``rows`` with the exact ``rank`` in their group, by ``order``, no group ever being one task's work."""
    placed = settled(rows.repartitionByRange(*key, *order).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = placed.groupBy("part", *key).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("part", *key).orderBy(*order)
    return placed.withColumn("at", F.row_number().over(inside)).join(offset, ["part", *key]).withColumn("rank", F.col("before") + F.col("at"))
