"""Cleaning of the label vocabulary: the bridge, the label-category table and
the facilities' label lists change together. Rename maps have one row per
label and are settled before they are applied to the three tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gapwright.functions.fixed import (
    DEFAULT_CATEGORY,
    DISTINCT_SPELLINGS,
    INDICATOR_CATEGORY_RULES,
    LABEL_CATEGORY_RULES,
    SPELLING_RULES,
)
from gapwright.functions.text import apply_rules, classify, is_label, strip_markup
from gapwright.operators.aggregates import canonical_spelling, list_json, majority_vote
from gapwright.operators.fuzzy import near_pairs
from gapwright.operators.joins import without_match
from gapwright.operators.reshape import distinct_union
from gapwright.operators.upsert import apply_string_map, merge_update
from gapwright.session import settled


@dataclass(frozen=True)
class Vocabulary:
    """``bridge``(facility_id, specialty), ``mapping``(specialties, category) and
    ``facility``(facility_id, specialties_raw, …)."""

    bridge: DataFrame
    mapping: DataFrame
    facility: DataFrame

    def rewritten(self, renames: DataFrame) -> Vocabulary:
        """Apply a ``raw, canonical`` map everywhere: bridge rows stay distinct,
        a label keeps its majority category, label lists follow the bridge."""
        bridge = apply_string_map(self.bridge, "specialty", renames)
        votes = _relabelled(self.mapping, renames)
        mapping = majority_vote(votes, "specialties", "category", "n")
        return Vocabulary(bridge, mapping, resync_lists(self.facility, bridge))


def _relabelled(mapping: DataFrame, renames: DataFrame) -> DataFrame:
    """``specialties, category, n``: category votes under the new labels. Equal
    rows are counted before the join; each stays one vote."""
    rows = mapping.filter(is_label(F.col("specialties")))
    counted = rows.groupBy(F.trim("specialties").alias("__old"), "category").agg(F.count(F.lit(1)).alias("n"))
    m = renames.select(F.col("raw").alias("__raw"), F.col("canonical").alias("__new"))
    joined = counted.join(m, F.col("__old") == F.col("__raw"), "left")
    return joined.select(F.coalesce("__new", "__old").alias("specialties"), "category", "n")


def resync_lists(facility: DataFrame, bridge: DataFrame) -> DataFrame:
    lists = list_json(bridge, "facility_id", "specialty", "specialties_raw")
    return merge_update(facility, lists, "facility_id", ["specialties_raw"])


def all_labels(bridge: DataFrame, mapping: DataFrame) -> DataFrame:
    """Distinct trimmed labels of both tables, JSON fragments left out."""
    both = distinct_union(
        bridge.filter(is_label(F.col("specialty"))).select(F.trim("specialty").alias("raw")),
        mapping.filter(is_label(F.col("specialties"))).select(F.trim("specialties").alias("raw")),
    )
    return both


def markup_map(labels: DataFrame) -> DataFrame:
    cleaned = labels.withColumn("canonical", strip_markup(F.col("raw")))
    return cleaned.filter((F.col("canonical") != F.col("raw")) & (F.col("canonical") != ""))


def clean_markup(v: Vocabulary) -> tuple[Vocabulary, DataFrame]:
    renames = settled(markup_map(all_labels(v.bridge, v.mapping)))
    return v.rewritten(renames), renames


def typo_map(
    bridge: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str]] = SPELLING_RULES,
    rare: int = 20,
    factor: int = 5,
    keep_apart: Sequence[tuple[str, str]] = DISTINCT_SPELLINGS,
) -> DataFrame:
    """``raw, canonical`` for misspelt labels.

    Rules fix known misspellings. Then a label used at most ``rare`` times is
    mapped to one at edit distance 1 used at least ``factor`` times as often;
    of several targets the one used most is taken, then the smallest. Spellings
    listed in ``keep_apart`` are not merged with each other.
    """
    usage = bridge.groupBy(F.trim("specialty").alias("raw")).agg(F.count(F.lit(1)).alias("n"))
    fixed = (
        labels.withColumn("fixed", apply_rules(F.col("raw"), rules))
        .join(usage, "raw", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
    )
    fixed = settled(fixed)  # one row per label; everything after is vocabulary-sized
    # spellings that became equal by a rule are seen with each of their counts
    spellings = fixed.select(F.col("fixed").alias("s"), "n").distinct()
    pairs = near_pairs(spellings, "s", "n")
    a_rarer = F.col("a_cnt") < F.col("b_cnt")
    low, high = F.least("a_cnt", "b_cnt"), F.greatest("a_cnt", "b_cnt")
    apart = F.lit(False)
    for x, y in keep_apart:
        a, b = F.lower("a"), F.lower("b")
        apart = apart | (a.contains(x) & b.contains(y)) | (a.contains(y) & b.contains(x))
    found = pairs.filter((low <= rare) & (high >= low * factor) & ~apart).select(
        F.when(a_rarer, F.col("a")).otherwise(F.col("b")).alias("fixed"),
        F.when(a_rarer, F.col("b")).otherwise(F.col("a")).alias("target"),
        high.alias("__n"),
    )
    best = (
        found.withColumn(
            "__rn",
            F.row_number().over(Window.partitionBy("fixed").orderBy(F.desc("__n"), F.asc("target"))),
        )
        .filter("__rn = 1")
        .select("fixed", "target")
    )
    mapped = fixed.join(best, "fixed", "left")
    return mapped.select("raw", F.coalesce("target", "fixed").alias("canonical")).filter("raw != canonical")


def correct_typos(v: Vocabulary) -> tuple[Vocabulary, DataFrame]:
    renames = settled(typo_map(v.bridge, all_labels(v.bridge, v.mapping)))
    return v.rewritten(renames), renames


def normalize_case(v: Vocabulary) -> tuple[Vocabulary, DataFrame]:
    renames = settled(canonical_spelling(v.bridge.select("specialty"), v.mapping.select("specialties")))
    return v.rewritten(renames), renames


def map_unmapped_labels(
    bridge: DataFrame,
    mapping: DataFrame,
    rules: Sequence[tuple[str, str]] = LABEL_CATEGORY_RULES,
    default: str = DEFAULT_CATEGORY,
) -> DataFrame:
    """Category rows for labels that have none: the category of the same label in
    another case, else the first keyword rule that matches."""
    labels = bridge.filter(is_label(F.col("specialty"))).select("specialty").distinct()
    missing = (
        without_match(labels, mapping, {"specialty": "specialties"})
        .select(F.trim("specialty").alias("specialties"))
        .distinct()
    )
    known = mapping.groupBy(F.lower(F.trim("specialties")).alias("__key")).agg(
        F.min("category").alias("__category")
    )
    joined = missing.join(known, F.lower("specialties") == F.col("__key"), "left")
    by_rule = classify(F.col("specialties"), rules, default)
    return joined.select("specialties", F.coalesce("__category", by_rule).alias("category"))


def map_unmapped_indicators(
    long: DataFrame,
    bridge: DataFrame,
    rules: Sequence[tuple[str, str]] = INDICATOR_CATEGORY_RULES,
    default: str = DEFAULT_CATEGORY,
) -> DataFrame:
    """Category rows for indicators that have none, by keyword rule."""
    missing = without_match(long.select("indicator_key").distinct(), bridge, ["indicator_key"])
    return missing.withColumn("specialty_category", classify(F.col("indicator_key"), rules, default))
