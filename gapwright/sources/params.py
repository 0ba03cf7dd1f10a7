"""Relations and predicates that come in as parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwright.functions.fixed import SCENARIO_JSON
from gapwright.functions.keys import match_key
from gapwright.operators.joins import contains_any


def inline_values(spark: SparkSession, rows: Sequence[tuple], schema: str, where: Column | None = None) -> DataFrame:
    """Relation of literal rows; small and of fixed size, so it may be broadcast."""
    df = spark.createDataFrame(rows, schema)
    return df if where is None else df.filter(where)


def run_sql(spark: SparkSession, text: str, args: Mapping | None = None, **frames: DataFrame) -> DataFrame:
    """SQL with ``:name`` parameters bound by Spark and ``{name}`` for frames."""
    return spark.sql(text, args=dict(args or {}), **frames)


def scenario_items(docs: DataFrame, json_col: str) -> DataFrame:
    """One row per facility of scenario documents (JSON array of objects)."""
    return docs.select(F.explode(F.from_json(F.col(json_col), SCENARIO_JSON)).alias("f")).select("f.*")


def scenario_frame(spark: SparkSession, text: str) -> DataFrame:
    """One scenario document given as a parameter."""
    return scenario_items(spark.createDataFrame([(text,)], "doc string"), "doc")


def scenario_rows(items: DataFrame, strict_labels: DataFrame | None = None, category: str | None = None) -> DataFrame:
    """Normalised scenario facilities: ``district_key, state_key, capability,
    capacity, is_match``. Capacity is at least 0. A facility counts for the
    category when it names any capability; with ``strict_labels`` (one column of
    label texts) only when its capability contains one of them or the name of
    the ``category``; for the category ``ALL`` any capability will do."""
    capability = F.trim(F.coalesce("capability", F.lit("")))
    rows = items.select(
        match_key(F.col("district_name")).alias("district_key"),
        match_key(F.col("state_ut")).alias("state_key"),
        capability.alias("capability"),
        F.greatest(F.coalesce("capacity", F.lit(0)), F.lit(0)).alias("capacity"),
    )
    if strict_labels is None or category == "ALL":
        return rows.withColumn("is_match", F.when(F.col("capability") == "", 0).otherwise(1))
    column = strict_labels.columns[0]
    # matched on distinct capabilities, so repeated ones are searched once
    texts = rows.select("capability").distinct()
    hits = contains_any(texts, "capability", strict_labels, column)
    marked = rows.join(hits.withColumn("__hit", F.lit(1)), "capability", "left")
    return marked.select(
        "district_key", "state_key", "capability", "capacity",
        F.when(_names(F.col("capability"), category), 1).otherwise(F.coalesce("__hit", F.lit(0))).alias("is_match"),
    )


def _names(capability: Column, category: str | None) -> Column:
    """Whether a capability names the category itself."""
    name = (category or "").strip().lower()
    return F.contains(F.lower(capability), F.lit(name)) if name else F.lit(False)
