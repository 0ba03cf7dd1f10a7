"""Listings for the mapping screens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwright.functions.text import is_label
from gapwright.operators.reshape import distinct_union


def mapping_view(bridge: DataFrame, facility: DataFrame, mapping: DataFrame) -> DataFrame:
    """All bridge rows with facility name and category, by name."""
    names = facility.select("facility_id", "facility_name")
    cats = mapping.select(F.col("specialties").alias("specialty"), F.col("category").alias("specialty_category"))
    rows = bridge.join(names, "facility_id", "left").join(cats, "specialty", "left")
    rows = rows.select("facility_id", "facility_name", "specialty", "specialty_category")
    order = [F.asc_nulls_last("facility_name"), F.asc("specialty"), F.asc("facility_id")]
    return rows.orderBy(*order)


def label_options(bridge: DataFrame, mapping: DataFrame) -> DataFrame:
    """Distinct labels of both tables for a choice list."""
    both = distinct_union(
        mapping.select(F.trim("specialties").alias("specialty")),
        bridge.select(F.trim("specialty").alias("specialty")),
    )
    return both.filter(is_label(F.col("specialty"))).orderBy("specialty")


def district_options(long: DataFrame) -> DataFrame:
    return (
        long.select(F.col("district_id").alias("district_key"), "district_name", "state_ut")
        .distinct()
        .orderBy("state_ut", "district_name")
    )


def category_options(mapping: DataFrame) -> DataFrame:
    named = mapping.filter(F.trim("category") != "")
    return named.select(F.col("category").alias("specialty_category")).distinct().orderBy("specialty_category")
