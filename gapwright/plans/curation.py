"""From raw tables to the curated model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwright.functions.fixed import INDICATOR_KEY_FIXES, OPERATOR_TYPES
from gapwright.functions.jsontext import json_list, unwrap_json_pair
from gapwright.functions.keys import match_key, surrogate_key
from gapwright.functions.numbers import Box, coord_repair, extract_int, postal_code
from gapwright.functions.text import nullify, populated, standardize_enum, valid_id
from gapwright.operators.aggregates import dedupe, first_per_key
from gapwright.operators.filters import apply_gate, drop_sparse, facility_gate, gate_audit
from gapwright.operators.reshape import union_all, unpivot
from gapwright.operators.upsert import overlay, seed_if_empty, update_where


def _canonical_state(df: DataFrame, states: DataFrame, raw: str, fallback: Column) -> DataFrame:
    """Add ``state_ut`` through the alias table (one row per ``alias_key``)."""
    found = states.select("alias_key", "canonical_state_ut")
    joined = df.join(found, match_key(F.col(raw)) == F.col("alias_key"), "left")
    return joined.withColumn("state_ut", F.coalesce("canonical_state_ut", fallback)).drop(
        "alias_key", "canonical_state_ut"
    )


def geo_directory(postal: DataFrame, states: DataFrame, districts: DataFrame) -> DataFrame:
    """``pincode, district_name, state_ut, pincode_is_ambiguous``: one canonical
    district per postal code. A code is ambiguous when its directory rows name
    more than one district."""
    places = (
        postal.filter(F.col("pincode").isNotNull())
        .select(
            F.col("pincode").cast("string").alias("pincode"),
            F.trim("district").alias("district_raw"),
            F.trim("statename").alias("state_raw"),
        )
        .distinct()
    )
    named = _canonical_state(places, states, "state_raw", F.initcap(F.lower("state_raw")))
    alias = districts.select(
        F.col("alias_key").alias("__alias"),
        F.col("canonical_state_ut").alias("__state"),
        "canonical_district",
    )
    resolved = named.join(
        alias,
        (match_key(F.col("district_raw")) == F.col("__alias")) & (F.col("state_ut") == F.col("__state")),
        "left",
    ).withColumn("district_name", F.coalesce("canonical_district", "district_raw"))
    return first_per_key(
        resolved, "pincode", ["district_name", "state_ut", "district_raw"], "pincode_is_ambiguous", "district_raw"
    ).drop("district_raw")


def geography(wide: DataFrame, states: DataFrame) -> DataFrame:
    """Distinct ``district_id, district_name, state_ut`` of the survey."""
    places = wide.select(F.trim("district_name").alias("district_name"), F.trim("state_ut").alias("state_raw"))
    named = _canonical_state(places.distinct(), states, "state_raw", F.col("state_raw"))
    return named.select(
        surrogate_key(F.col("district_name"), F.col("state_ut")).alias("district_id"),
        "district_name",
        "state_ut",
    ).distinct()


def match_confidence(hit: Column, ambiguous: Column, state_hit: Column) -> Column:
    """How far the joins got: high, medium (ambiguous code), low (state only), unmatched."""
    return (
        F.when(hit & ~F.coalesce(ambiguous, F.lit(False)), "high")
        .when(hit, "medium")
        .when(state_hit, "low")
        .otherwise("unmatched")
    )


def geo_bridge(df: DataFrame, directory: DataFrame, states: DataFrame, places: DataFrame) -> DataFrame:
    """Add ``district_id, district_name, state_ut, join_confidence`` to rows with
    ``pincode`` and ``state_ut_raw``.

    A code gives district and state; where its state is unknown, the row's own
    state stands in, so places are joined last, on district and that state.
    """
    geo = places.groupBy(match_key(F.col("district_name")).alias("__dkey"), F.col("state_ut").alias("__skey")).agg(
        F.min(F.struct("district_id", "district_name", "state_ut")).alias("__geo")
    )
    codes = directory.select(
        F.col("pincode").alias("__pin"),
        "pincode_is_ambiguous",
        match_key(F.col("district_name")).alias("__district"),
        F.col("state_ut").alias("__state"),
    )
    known = states.select(F.col("alias_key").alias("__alias"), F.col("canonical_state_ut").alias("__own"))
    coded = df.join(codes, F.col("pincode") == F.col("__pin"), "left").join(
        known, match_key(F.col("state_ut_raw")) == F.col("__alias"), "left"
    )
    joined = coded.join(
        geo, (F.col("__district") == F.col("__dkey")) & (F.coalesce("__state", "__own") == F.col("__skey")), "left"
    )
    return joined.select(
        *df.columns,
        F.col("__geo.district_id").alias("district_id"),
        F.col("__geo.district_name").alias("district_name"),
        F.col("__geo.state_ut").alias("state_ut"),
        match_confidence(
            F.col("__geo").isNotNull(), F.col("pincode_is_ambiguous"), F.col("__alias").isNotNull()
        ).alias("join_confidence"),
    )


SCORED = ("operatorTypeId", "numberDoctors", "capacity", "address_zipOrPostcode", "specialties")


def completeness(cols: Sequence[str] = SCORED) -> Column:
    """How many of eight source fields are filled."""
    score = populated(F.col("name"), tokens=("",))
    for c in cols:
        score = score + populated(F.col(c))
    for c in ("latitude", "longitude"):
        score = score + F.when(F.col(c).isNotNull(), 1).otherwise(0)
    return score


def clean_rows(raw: DataFrame, box: Box = Box()) -> DataFrame:
    """Standardised columns of raw rows that carry a valid id."""
    c = F.col
    point = coord_repair(c("latitude"), c("longitude"), box)
    return raw.filter(valid_id(c("unique_id"))).select(
        F.trim("unique_id").alias("facility_id"),
        F.trim("name").alias("facility_name"),
        F.trim("address_stateOrRegion").alias("state_ut_raw"),
        postal_code(c("address_zipOrPostcode")).alias("pincode"),
        F.trim("operatorTypeId").alias("operator_type_raw"),
        standardize_enum(c("operatorTypeId"), OPERATOR_TYPES, "unknown").alias("operator_type"),
        extract_int(c("numberDoctors")).alias("doctors_count"),
        extract_int(c("capacity")).alias("bed_count"),
        point["lat"].alias("lat"),
        point["lon"].alias("lon"),
        point["valid"].alias("coord_valid"),
        F.trim("facilityTypeId").alias("facility_type"),
        F.trim("specialties").alias("specialties_raw"),
        F.trim("cluster_id").alias("cluster_id"),
        completeness().alias("completeness_score"),
    )


FACILITY_COLUMNS = (
    "facility_id", "facility_name", "state_ut_raw", "state_ut", "district_id", "district_name",
    "pincode", "operator_type_raw", "operator_type", "doctors_count", "bed_count", "lat", "lon",
    "coord_valid", "facility_type", "specialties_raw", "join_confidence",
)
CORRECTED = {
    "facility_name": "facility_name",
    "pincode": "pincode",
    "operator_type": "operator_type",
    "operator_type_raw": "operator_type",
    "facility_type": "facility_type",
    "doctors_count": "doctors_count",
    "bed_count": "bed_count",
    "specialties_raw": "specialties_raw",
    "state_ut": "state_ut",
    "district_name": "district_name",
}


def resolved_rows(raw: DataFrame, directory: DataFrame, states: DataFrame, places: DataFrame) -> DataFrame:
    """Cleaned rows, the most complete one per cluster, placed on the map.
    Deduplication comes before the joins: it needs none of their columns."""
    cleaned = clean_rows(drop_sparse(raw))
    cluster = F.coalesce(F.nullif(F.trim("cluster_id"), F.lit("")), F.col("facility_id"))
    best = dedupe(cleaned, cluster, [F.desc("completeness_score"), F.asc("facility_id")])
    return geo_bridge(best.drop("cluster_id", "completeness_score"), directory, states, places)


def curate_facility(
    raw: DataFrame,
    directory: DataFrame,
    states: DataFrame,
    places: DataFrame,
    corrections: DataFrame | None = None,
) -> DataFrame:
    """One curated row per facility."""
    rows = resolved_rows(raw, directory, states, places)
    facility = apply_gate(rows, facility_gate()).select(*FACILITY_COLUMNS)
    return facility if corrections is None else overlay(facility, corrections, "facility_id", CORRECTED)


def curation_audit(raw: DataFrame, directory: DataFrame, states: DataFrame, places: DataFrame) -> DataFrame:
    """``rule, failed, total``: rows dropped as sparse, and by each gate rule,
    measured on the rows the gate itself sees."""
    tests = {"sparse": F.col("__sparse") >= 2}
    counted = raw.withColumn("__sparse", _populated_in(raw))
    sparse = gate_audit(counted, tests).filter("rule = 'sparse'")
    return union_all(sparse, gate_audit(resolved_rows(raw, directory, states, places), facility_gate()))


def _populated_in(raw: DataFrame) -> Column:
    total = F.lit(0)
    for c in raw.columns:
        total = total + populated(raw[c])
    return total


def health_indicator(wide: DataFrame, states: DataFrame) -> DataFrame:
    """Long form of the survey with canonical geography; survey sizes stay as rows."""
    named = _canonical_state(
        wide.withColumn("district_name", F.trim("district_name")).withColumnRenamed("state_ut", "state_raw"),
        states,
        "state_raw",
        F.trim("state_raw"),
    ).drop("state_raw")
    keyed = named.withColumn("district_id", surrogate_key(F.col("district_name"), F.col("state_ut")))
    return unpivot(keyed, ["district_id", "district_name", "state_ut"])


def seed_bridge(facility: DataFrame, bridge: DataFrame) -> DataFrame:
    """Facility-label bridge, filled from the label lists when it is empty;
    labels stored as one-pair JSON objects are unwrapped."""
    items = facility.select("facility_id", F.explode(json_list(F.col("specialties_raw"))).alias("specialty"))
    seed = items.filter(nullify(F.col("specialty"), tokens=("",)).isNotNull()).distinct()
    filled = seed_if_empty(bridge, seed)
    return filled.withColumn("specialty", unwrap_json_pair(F.col("specialty")))


def seed_indicator_bridge(
    bridge: DataFrame, seed: DataFrame, fixes: Mapping[str, str] = INDICATOR_KEY_FIXES
) -> DataFrame:
    """Indicator-category bridge, seeded when empty, with wrong keys put right."""
    filled = seed_if_empty(bridge, seed)
    for wrong, right in fixes.items():
        filled = update_where(filled, F.col("indicator_key") == wrong, {"indicator_key": F.lit(right)})
    return filled


def anchor_row(facility: DataFrame, long: DataFrame, defaults: Mapping[str, object], pincode: str) -> DataFrame:
    """Add one given facility, if it is absent, in the first district by (state,
    district); its postal code is the smallest one known there, else the default."""
    anchor = (
        long.filter(F.col("district_name").isNotNull() & F.col("state_ut").isNotNull())
        .select(F.struct("state_ut", "district_name", "district_id").alias("a"))
        .agg(F.min("a").alias("a"))
        .select("a.*")
    )
    codes = facility.groupBy("district_id").agg(F.min("pincode").alias("__pin"))
    placed = anchor.join(codes, "district_id", "left")
    types = dict(facility.dtypes)
    given = {
        **{k: F.lit(v) for k, v in defaults.items()},
        "state_ut": F.col("state_ut"),
        "state_ut_raw": F.col("state_ut"),
        "district_id": F.col("district_id"),
        "district_name": F.col("district_name"),
        "pincode": F.coalesce("__pin", F.lit(pincode)),
    }
    row = placed.select(*[given.get(c, F.lit(None)).cast(types[c]).alias(c) for c in facility.columns])
    known = facility.filter(F.col("facility_id") == str(defaults["facility_id"])).limit(1)
    return facility.unionByName(row.filter(known.agg(F.count(F.lit(1))).scalar() == 0))
