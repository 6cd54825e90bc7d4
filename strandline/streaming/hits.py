"""Streams of search hits: windowed counts, duplicate removal within a watermark, upserts by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.dedup import last_by


def hit_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of hits as they arrive, with the columns of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def fresh(hits: DataFrame, keys: list[str], at: str, late: str = "2 days") -> DataFrame:
    """Each key once inside the watermark; state older than ``late`` is dropped."""
    return hits.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed(hits: DataFrame, at: str, by: list[str], width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts per window, late rows counted until the watermark passes."""
    out = hits.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), *by, "n")


def upsert_batches(target: str, keys: list[str], order: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function keeping ``target`` at the latest row of each key.

    Rows live in ``buckets`` by the hash of their keys. A batch reads the newest versions of the
    buckets it touches, older than itself, and writes these buckets only, as the folder of its
    number; so a batch that is run again after a failure reads what it read before. Folders of
    buckets that two later versions have replaced are removed.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        known = _versions(spark, target)
        old = {b: max((n for n in known.get(b, {}) if n < number), default=None) for b in touched}
        paths = [known[b][n] for b, n in old.items() if n is not None]
        both = new if not paths else spark.read.option("basePath", f"{target}").parquet(*paths).drop("version").unionByName(new, allowMissingColumns=True)
        last_by(both, keys, order).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/version={number:012d}")
        for bucket in touched:
            for n in sorted(n for n in known.get(bucket, {}) if n < number)[:-1]:
                _remove(spark, known[bucket][n])

    return write


def current(spark: SparkSession, target: str) -> DataFrame | None:
    """The table as of the newest complete version of each bucket, null before the first batch."""
    paths = [folders[max(folders)] for folders in _versions(spark, target).values()]
    return spark.read.option("basePath", target).parquet(*paths).drop("version", "bucket") if paths else None


def _files(spark: SparkSession, path: str) -> tuple:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, target: str) -> dict[int, dict[int, str]]:
    """For each bucket the folder of every complete version."""
    jvm, folder, fs = _files(spark, target)
    out: dict[int, dict[int, str]] = {}
    for version in fs.listStatus(folder) if fs.exists(folder) else ():
        name = version.getPath().getName()
        if name.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(version.getPath(), "_SUCCESS")):
            for bucket in fs.listStatus(version.getPath()):
                if bucket.getPath().getName().startswith("bucket="):
                    out.setdefault(int(bucket.getPath().getName()[7:]), {})[int(name[8:])] = str(bucket.getPath())
    return out


def _remove(spark: SparkSession, path: str) -> None:
    _, folder, fs = _files(spark, path)
    fs.delete(folder, True)


def latest_version(spark: SparkSession, target: str) -> str | None:
    """Path of the newest complete version under ``target``: the buckets its batch touched."""
    done = {n: path.rpartition("/")[0] for folders in _versions(spark, target).values() for n, path in folders.items()}
    return done[max(done)] if done else None
