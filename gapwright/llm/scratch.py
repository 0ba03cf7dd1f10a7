"""Written intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``. Where none is named, a
    temporary folder is used if the session is local; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    named = tempfile.mkdtemp(prefix="gapwright-llm-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def new_folder(spark: SparkSession, name: str) -> str:
    """Path for files of this session; they go when the session ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the file: lineage is
    cut, and lost executors cost nothing but their running tasks."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
