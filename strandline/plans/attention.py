"""Attention series: dense daily counts, medians, spikes and the spans and words that explain them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators.joins import first_interval, sized
from strandline.operators.ranking import upper_median
from strandline.sources.tables import table


def daily_counts(events: DataFrame, kind: str, at: str) -> DataFrame:
    """(kind, day, views): every day of a kind's range, zeros included."""
    days = events.groupBy(kind, F.to_date(at).alias("day")).agg(F.count("*").alias("views"))
    span = days.groupBy(kind).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    every = span.select(kind, F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))
    return every.join(days, [kind, "day"], "left").select(kind, "day", F.coalesce("views", F.lit(0)).alias("views"))


def peaks(daily: DataFrame, kind: str, k: int = 5) -> DataFrame:
    """The ``k`` days of each kind with most views and their ratio to the median of live days (1 without one)."""
    median = upper_median(daily, [kind], "views")
    w = Window.partitionBy(kind).orderBy(F.desc("views"), "day")
    top = daily.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.join(sized(median), kind, "left").withColumn("ratio", F.when(F.coalesce("median", F.lit(0)) > 0, F.round(F.col("views") / F.col("median"), 4)).otherwise(F.lit(1.0)))


def jumps(daily: DataFrame, kind: str, least: float = 1.5) -> DataFrame:
    """Days whose views are ``least`` times those of the day before."""
    w = Window.partitionBy(kind).orderBy("day")
    prev = F.lag("views").over(w)
    return daily.withColumn("prev", prev).where("prev > 0").withColumn("ratio", F.round(F.col("views") / F.col("prev"), 4)).where(F.col("ratio") >= least)


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_counts(table(spark, sf_dir, "events").select("event_type", "ts"), "event_type", "ts")


def att_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(spark, sf_dir).withColumn("day", F.col("day").cast("string"))


def att_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upper_median(_daily(spark, sf_dir), ["event_type"], "views")


def att_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks(_daily(spark, sf_dir), "event_type").select("event_type", F.col("day").cast("string").alias("day"), "views", "rank", "ratio")


def att_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jumps(_daily(spark, sf_dir), "event_type").select("event_type", F.col("day").cast("string").alias("day"), "views", "prev", "ratio")


def att_event_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of collected documents with the first news event whose span holds them."""
    days = table(spark, sf_dir, "raw_docs").select(F.to_date("collected_at").alias("day")).groupBy("day").agg(F.count("*").alias("docs"))
    spans = table(spark, sf_dir, "rag_event").select("event_id", "start_date", "end_date")
    return first_interval(days, spans, "day", "start_date", "end_date", "event_id").select(F.col("day").cast("string").alias("day"), "docs", "event_id")


def att_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events less than 30 minutes apart, as batch form of a session window."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    new = F.coalesce(F.col("ts") - F.lag("ts").over(w) > F.expr("interval 30 minutes"), F.lit(True)).cast("int")
    runs = e.withColumn("new", new).withColumn("session", F.sum("new").over(w))
    return runs.groupBy("user_id", "session").agg(F.count("*").alias("events"))


def att_stage_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind the count, sum and median of the 20 latest values."""
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    last = table(spark, sf_dir, "events").withColumn("k", F.row_number().over(w)).where("k <= 20")
    return last.groupBy("event_type").agg(F.count("*").alias("runs"), F.round(F.sum("value"), 4).alias("total"), F.round(F.median("value"), 4).alias("median"))


_D = """
c AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS views FROM events GROUP BY 1, 2),
s AS (SELECT event_type, min(day) AS a, max(day) AS b FROM c GROUP BY 1),
v AS (SELECT event_type, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM s),
d AS (SELECT v.event_type, v.day, coalesce(views, 0) AS views FROM v LEFT JOIN c ON c.event_type = v.event_type AND c.day = v.day),
o AS (SELECT event_type, views, row_number() OVER (PARTITION BY event_type ORDER BY views) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM d WHERE views > 0),
m AS (SELECT event_type, views AS median FROM o WHERE k = n // 2 + 1)
"""

QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("att_")}
SQL = {
    "att_daily": f"WITH {_D} SELECT event_type, CAST(day AS VARCHAR) AS day, views FROM d",
    "att_upper_median": f"WITH {_D} SELECT event_type, median FROM m",
    "att_peaks": f"WITH {_D} SELECT d.event_type, CAST(day AS VARCHAR) AS day, d.views, row_number() OVER (PARTITION BY d.event_type ORDER BY d.views DESC, day) AS rank, CASE WHEN median > 0 THEN round(d.views / median, 4) ELSE 1.0 END AS ratio FROM d LEFT JOIN m ON m.event_type = d.event_type QUALIFY rank <= 5",
    "att_jumps": f"WITH {_D}, j AS (SELECT *, lag(views) OVER (PARTITION BY event_type ORDER BY day) AS prev FROM d) SELECT event_type, CAST(day AS VARCHAR) AS day, views, prev, round(views / prev, 4) AS ratio FROM j WHERE prev > 0 AND round(views / prev, 4) >= 1.5",
    "att_event_of_day": "WITH d AS (SELECT CAST(collected_at AS DATE) AS day, count(*) AS docs FROM raw_docs GROUP BY 1) SELECT CAST(day AS VARCHAR) AS day, docs, (SELECT min(event_id) FROM rag_event WHERE day >= start_date AND (end_date IS NULL OR day <= end_date)) AS event_id FROM d",
    "att_sessions": "WITH n AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM n) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events FROM s GROUP BY 1, 2",
    "att_stage_timings": "WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 20) SELECT event_type, count(*) AS runs, round(sum(value), 4) AS total, round(median(value), 4) AS median FROM l GROUP BY 1",
}
