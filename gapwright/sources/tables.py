"""Table scans, alias files, writing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwright.functions.keys import match_key


def load(spark: SparkSession, source: str, *names: str) -> dict[str, DataFrame]:
    """Tables of a source: a folder of Parquet files, or a catalog namespace."""
    return {n: load_one(spark, source, n) for n in names}


def load_one(spark: SparkSession, source: str, name: str) -> DataFrame:
    if "/" in source:
        return spark.read.parquet(f"{source}/{name}.parquet")
    return spark.table(f"{source}.{name}")


def alias_table(df: DataFrame, alias: str, values: Sequence[str], also: Sequence[str] = ()) -> DataFrame:
    """One row per alias, whatever its case and padding, with a column
    ``alias_key`` to join on. Of several spellings the smallest values win.
    ``also`` names further columns that are part of the key."""
    keyed = df.select(match_key(F.col(alias)).alias("alias_key"), *also, *values)
    first = keyed.filter(F.col("alias_key").isNotNull()).groupBy("alias_key", *also)
    return first.agg(F.min(F.struct(*values)).alias("__v")).select(
        "alias_key", *also, *[F.col("__v")[v].alias(v) for v in values]
    )


def load_aliases(
    spark: SparkSession, path: str, alias: str, values: Sequence[str], also: Sequence[str] = ()
) -> DataFrame:
    """Alias dictionary from a CSV file with a header; all columns are text."""
    return alias_table(spark.read.option("header", True).csv(path), alias, values, also)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def write_table(df: DataFrame, target: str, mode: str = "overwrite") -> None:
    """Write to a folder (name with a slash) or to a catalog table."""
    if "/" in target:
        df.write.mode(mode).parquet(target)
    else:
        df.write.mode(mode).format("parquet").saveAsTable(target)
