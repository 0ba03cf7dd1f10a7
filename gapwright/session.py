"""Session settings the jobs are written for."""

from __future__ import annotations

import tempfile
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # runtime re-planning: join choice by measured size, skewed partitions
    # split, small partitions merged
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(
    cores: int = 8, partitions: int | None = None, memory: str = "8g", settings: Mapping[str, str] | None = None
) -> SparkSession:
    """Single-machine session for tests and measurements. On a cluster use the
    session given there; shuffle partitions are then set for its size."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gapwright")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
    )
    for key, value in {**SETTINGS, **(settings or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints: the one the session names. A session of a
    single machine that names none gets a new temporary one; on a cluster a
    machine's own folder would be of no use to the others, so one must be named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = tempfile.mkdtemp(prefix="gapwright-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def settled(df: DataFrame) -> DataFrame:
    """Compute a frame once and go on from the stored result.

    For results that are small next to their inputs and used several times:
    district scores, rename maps, batches of actions. It is a reliable
    checkpoint in the shared folder, so losing executors does no harm.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
