"""The whole curation run, from raw tables to the published model."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwright.functions.fixed import (
    BRIDGE_SCHEMA,
    CORRECTION_SCHEMA,
    GAP_SCHEMA,
    INDICATOR_BRIDGE_SCHEMA,
    INDICATOR_CATEGORY_SEED,
)
from gapwright.functions.text import is_label
from gapwright.operators.reshape import resolve_columns
from gapwright.operators.upsert import backfill_bridge, delete_where, merge_gaps
from gapwright.plans import curation, quality, vocabulary
from gapwright.sources.publish import publish, recover_tables, replace_table
from gapwright.sources.tables import empty, load, load_aliases


@dataclass(frozen=True)
class Sources:
    """Raw tables, and alias tables with one row per ``alias_key``. ``mapping``
    is the label-category table to start from; a published one goes before it."""

    facilities: DataFrame
    indicators: DataFrame
    postal: DataFrame
    states: DataFrame
    districts: DataFrame
    mapping: DataFrame


# columns of the label-category table, by the words in their names
MAPPING_COLUMNS = {"category": r"categor", "specialties": r"special|label"}


def load_sources(spark: SparkSession, source: str, aliases: str) -> Sources:
    """Sources out of a folder of Parquet files or a catalog namespace: tables
    ``facilities``, ``indicators``, ``postal`` and ``mapping``, whose columns
    may be named in several ways; and alias dictionaries ``states.csv`` and
    ``districts.csv`` out of the folder ``aliases``."""
    raw = load(spark, source, "facilities", "indicators", "postal", "mapping")
    found = resolve_columns(raw["mapping"], MAPPING_COLUMNS)
    return Sources(
        facilities=raw["facilities"],
        indicators=raw["indicators"],
        postal=raw["postal"],
        states=load_aliases(spark, f"{aliases}/states.csv", "alias", ["canonical_state_ut"]),
        districts=load_aliases(spark, f"{aliases}/districts.csv", "alias", ["canonical_district"], also=["canonical_state_ut"]),
        mapping=raw["mapping"].select(*[F.col(found[c]).alias(c) for c in ("specialties", "category")]),
    )


# all tables that a run replaces as a whole
TABLES = (
    "facility", "health_indicator", "facility_specialty", "health_indicator_specialty", "specialty_category_mapping",
    "facility_correction", "dq_metrics",
)


def curate(
    spark: SparkSession,
    src: Sources,
    target: str,
    now: Column,
    demo: Mapping[str, object] | None = None,
    demo_pincode: str = "737101",
    thresholds: quality.Thresholds = quality.Thresholds(),
) -> quality.Model:
    """Build or refresh the model tables in the namespace ``target``.

    Each table is written when a later step reads it more than once, so no step
    is computed twice and a lost executor costs only the running step. Bridges,
    corrections and gaps that are there already are kept and built upon.
    """

    def name(table: str) -> str:
        return f"{target}.{table}"

    recover_tables(spark, [name(table) for table in TABLES])

    def there(table: str, schema: str) -> DataFrame:
        return spark.table(name(table)) if spark.catalog.tableExists(name(table)) else empty(spark, schema)

    def put(table: str, df: DataFrame) -> DataFrame:
        return replace_table(spark, name(table), df)

    corrections = there("facility_correction", CORRECTION_SCHEMA)
    directory = curation.geo_directory(src.postal, src.states, src.districts)
    places = curation.geography(src.indicators, src.states)
    facility = put("facility", curation.curate_facility(src.facilities, directory, src.states, places, corrections))
    long = put("health_indicator", curation.health_indicator(src.indicators, src.states))

    bridge = put("facility_specialty", curation.seed_bridge(facility, there("facility_specialty", BRIDGE_SCHEMA)))
    seed = spark.createDataFrame(INDICATOR_CATEGORY_SEED, INDICATOR_BRIDGE_SCHEMA)
    indicators = curation.seed_indicator_bridge(there("health_indicator_specialty", INDICATOR_BRIDGE_SCHEMA), seed)
    kept = name("specialty_category_mapping")
    mapping = spark.table(kept) if spark.catalog.tableExists(kept) else src.mapping

    for step in (vocabulary.clean_markup, vocabulary.correct_typos, vocabulary.normalize_case):
        changed, _ = step(vocabulary.Vocabulary(bridge, mapping, facility))
        mapping = put("specialty_category_mapping", changed.mapping)
        bridge = put("facility_specialty", changed.bridge)
    facility = put("facility", vocabulary.resync_lists(facility, bridge))

    indicators = put(
        "health_indicator_specialty", indicators.unionByName(vocabulary.map_unmapped_indicators(long, indicators))
    )
    mapping = put("specialty_category_mapping", mapping.unionByName(vocabulary.map_unmapped_labels(bridge, mapping)))

    bare = [] if demo is None else [str(demo["facility_id"])]
    bridge = delete_where(bridge, ~is_label(F.col("specialty")) | F.col("facility_id").isin(*bare))
    bridge = put("facility_specialty", backfill_bridge(bridge, facility, bare))
    if demo is not None:
        facility = put("facility", curation.anchor_row(facility, long, demo, demo_pincode))

    raw = src.facilities.select(F.trim("unique_id").alias("facility_id"), F.trim("description").alias("description"))
    # one description per id, so that a repeated source row gives no second gap
    described = raw.groupBy("facility_id").agg(F.min("description").alias("description"))
    model = quality.Model(facility, long, bridge, mapping, indicators, described, corrections)
    put("dq_metrics", quality.dq_metrics(model, now, thresholds))
    publish(
        spark, name("dq_gap"), quality.dq_gaps(model), lambda old, found: merge_gaps(old, found, now), GAP_SCHEMA, ["gap_id"]
    )
    return model
