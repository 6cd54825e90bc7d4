"""Session construction and the cutting of lineage through shared storage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 4, shuffle_partitions: int = 8, app: str = "strandline") -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def settled(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` into the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting (tests, a laptop) gets a temporary folder; on a
    cluster that would be another disk on every node, so there the setting is required.
    Reliable checkpoints survive the loss of executors, unlike local ones.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables that all executors see."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="strandline-", dir=os.environ.get("TMPDIR")))
    return sc.getCheckpointDir()
