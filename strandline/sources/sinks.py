"""Writing: committed files, upserts, guarded ingest, versions, keyed results and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.dedup import last_by


class Conflict(RuntimeError):
    """A write that another one has overtaken or that breaks a stated limit."""


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``old`` with the rows of ``new``; of each key the row with the greatest ``order``."""
    return last_by(old.unionByName(new, allowMissingColumns=True), keys, order)


def ingest(documents: DataFrame, new: DataFrame, most: int = 500) -> DataFrame:
    """Documents of events with those of ``new`` in place of their older copies; an event over ``most`` ids refuses all."""
    kept = documents.join(new.select("event_id", "doc_id").distinct(), ["event_id", "doc_id"], "left_anti")
    out = kept.unionByName(new.dropDuplicates(["event_id", "doc_id"]), allowMissingColumns=True)
    if not out.groupBy("event_id").count().where(F.col("count") > most).isEmpty():
        raise Conflict(f"an event would hold more than {most} documents")
    return out


def append_version(log: DataFrame, change: DataFrame, key: str, expected: int, refused: tuple[str, ...] = ("running", "failed")) -> DataFrame:
    """``log`` with ``change`` as the next version of its key, refused if the latest is not ``expected`` or, where the
    log has a ``state``, is in one of the states ``refused``.

    The check reads the log as it is; writers of one key are to be serialized by the table format or the driver.
    """
    one = change.select(key).distinct()
    state = F.max_by("state", "version") if "state" in log.columns else F.lit(None)
    latest, now = log.join(one, key, "left_semi").agg(F.coalesce(F.max("version"), F.lit(0)), state).first()
    if latest != expected:
        raise Conflict(f"version {expected} is not the latest; {latest} is")
    if now in refused:
        raise Conflict(f"a change of state {now} is refused")
    return log.unionByName(change.withColumn("version", F.lit(expected + 1)), allowMissingColumns=True)


def with_digest(df: DataFrame, fields: list[str], model: str) -> DataFrame:
    """``digest``: the key of a row's content under a model, by fields in stated order."""
    return df.withColumn("digest", F.sha2(F.concat(F.lit(model), F.to_json(F.struct(*fields))), 256))


def cached(work: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(done, pending): rows of ``work`` with their result by digest, and those without one."""
    usable = results.where("result is not null").dropDuplicates(["digest"])
    return work.join(usable, "digest"), work.join(usable.select("digest"), "digest", "left_anti")


def unique_export(df: DataFrame, fields: list[str], key: str) -> DataFrame:
    """The projection to ``fields``; a repeated key is an error, not a silent choice."""
    if not df.groupBy(key).count().where("count > 1").isEmpty():
        raise Conflict(f"{key} is not unique")
    return df.select(*fields)


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Parquet by ``by``, each value's rows clustered so that no task opens every partition;
    large values still split over tasks."""
    df.repartition(by, F.pmod(F.xxhash64(*[c for c in df.columns if c != by][:1]), F.lit(8))).write.mode("overwrite").partitionBy(by).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines under the commit protocol: readers see all of it or nothing."""
    df.write.mode("overwrite").json(path)


def markdown_report(sections: DataFrame) -> DataFrame:
    """(report_id, markdown) of sections (report_id, ord, heading, body, sources array<string>)."""
    part = F.concat(F.lit("## "), F.col("heading"), F.lit("\n\n"), F.col("body"), F.when(F.size("sources") > 0, F.concat(F.lit("\n\n"), F.array_join(F.transform("sources", lambda s: F.concat(F.lit("["), s, F.lit("]"))), " "))).otherwise(""))
    rows = sections.withColumn("part", part).groupBy("report_id").agg(F.sort_array(F.collect_list(F.struct("ord", "part"))).alias("parts"))
    return rows.select("report_id", F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n").alias("markdown"))
