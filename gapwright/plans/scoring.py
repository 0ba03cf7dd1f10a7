"""Demand against supply per district: scores, flags, rankings, scenarios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwright.functions.fixed import (
    CARDIAC_CAPABILITY_PATTERN,
    CARDIAC_SUBSTRINGS,
    HOUSEHOLDS_KEY,
    SURVEY_SIZE_KEYS,
)
from gapwright.functions.keys import match_key, state_key
from gapwright.functions.numbers import percent, stable_round
from gapwright.functions.text import any_substring
from gapwright.operators.aggregates import attach_stats, top_json, topk
from gapwright.operators.joins import filter_category

DEFAULT_BEDS = 25
BEDS_PER_BURDEN = 5.0
WIDE_GAP = 0.3


def is_demand() -> Column:
    """Rows of the long table that measure demand."""
    return (
        ~F.coalesce("is_suppressed", F.lit(False))
        & ~F.col("indicator_key").isin(*SURVEY_SIZE_KEYS)
        & F.col("indicator_value").isNotNull()
    )


def category_demand(long: DataFrame, imap: DataFrame, category: str = "ALL") -> DataFrame:
    """``district_name, state_ut, demand_pct``: mean of the indicators mapped to
    the category; an indicator mapped twice counts once."""
    wanted = filter_category(imap, "specialty_category", category)
    rows = long.filter(is_demand()).join(wanted, "indicator_key", "left_semi")
    return rows.groupBy(F.trim("district_name").alias("district_name"), F.trim("state_ut").alias("state_ut")).agg(
        stable_round(F.avg("indicator_value"), 2).alias("demand_pct")
    )


def district_demand(long: DataFrame, imap: DataFrame, category: str = "ALL") -> DataFrame:
    """Demand and surveyed households per district, out of one pass over the
    long table: mapped indicators are flagged, both measures are aggregated
    together."""
    keys = filter_category(imap, "specialty_category", category).select("indicator_key").distinct()
    flagged = long.join(keys.withColumn("__mapped", F.lit(True)), "indicator_key", "left")
    counts = is_demand() & F.coalesce("__mapped", F.lit(False))
    grouped = flagged.groupBy(
        F.trim("district_name").alias("district_name"), F.trim("state_ut").alias("state_ut")
    ).agg(
        stable_round(F.avg(F.when(counts, F.col("indicator_value"))), 2).alias("demand_pct"),
        F.max(F.when(F.col("indicator_key") == HOUSEHOLDS_KEY, F.col("indicator_value"))).alias("households_surveyed"),
    )
    return grouped.filter(F.col("demand_pct").isNotNull()).withColumn(
        "households_surveyed", F.coalesce("households_surveyed", F.lit(0.0))
    )


def facility_categories(facility: DataFrame, bridge: DataFrame, mapping: DataFrame, category: str = "ALL") -> DataFrame:
    """``facility_id, specialty, category`` rows of facilities in the category."""
    wanted = filter_category(mapping, "category", category)
    labelled = bridge.join(wanted, F.col("specialty") == F.col("specialties")).select(
        "facility_id", "specialty", "category"
    )
    return facility.select("facility_id").join(labelled, "facility_id")


def _placed(facility: DataFrame) -> DataFrame:
    named = (F.trim("district_name") != "") & (F.trim("state_ut") != "")
    return facility.filter(named).select(
        match_key(F.col("district_name")).alias("district_key"),
        match_key(F.col("state_ut")).alias("state_key"),
        "facility_id",
        "bed_count",
    )


def _in_category(bridge: DataFrame, mapping: DataFrame, category: str) -> DataFrame:
    labels = filter_category(mapping, "category", category).select(F.col("specialties").alias("specialty"))
    return bridge.join(labels, "specialty", "left_semi").select("facility_id").distinct()


def bed_supply(
    facility: DataFrame, bridge: DataFrame, mapping: DataFrame, category: str = "ALL", default: int = DEFAULT_BEDS
) -> DataFrame:
    """``district_key, state_key, total_facilities, category_facilities,
    category_bed_capacity``. Beds are the largest count per facility, with a
    default for unknown or zero, then summed. The first grouping keeps the
    facility in its key, so a crowded district is spread over tasks."""
    ids = _in_category(bridge, mapping, category).withColumn("__hit", F.lit(1))
    rows = _placed(facility).join(ids, "facility_id", "left")
    per_facility = rows.groupBy("district_key", "state_key", "facility_id").agg(
        F.max(F.coalesce(F.nullif("bed_count", F.lit(0)), F.lit(default))).alias("beds"),
        F.max(F.coalesce("__hit", F.lit(0))).alias("hit"),
    )
    return per_facility.groupBy("district_key", "state_key").agg(
        F.count(F.lit(1)).alias("total_facilities"),
        F.sum("hit").alias("category_facilities"),
        F.sum(F.col("beds") * F.col("hit")).alias("category_bed_capacity"),
    )


SUPPLY = ("total_facilities", "category_facilities", "category_bed_capacity")


def scenario_supply(rows: DataFrame) -> DataFrame:
    """Supply that scenario facilities add, in the columns of ``bed_supply``."""
    beds = F.when(F.col("is_match") > 0, F.greatest("capacity", F.lit(1))).otherwise(0)
    return rows.groupBy("district_key", "state_key").agg(
        F.count(F.lit(1)).alias("total_facilities"),
        F.sum("is_match").alias("category_facilities"),
        F.sum(beds).alias("category_bed_capacity"),
    )


def gap_base(demand: DataFrame, supply: DataFrame) -> DataFrame:
    """Demand districts with their supply, 0 where there is none."""
    keyed = demand.withColumn("district_key", match_key(F.col("district_name"))).withColumn(
        "state_key", match_key(F.col("state_ut"))
    )
    joined = keyed.join(supply, ["district_key", "state_key"], "left")
    return joined.select(
        "district_key", "state_key", "district_name", "state_ut", "demand_pct", "households_surveyed",
        *[F.coalesce(m, F.lit(0)).alias(m) for m in SUPPLY],
    )


def _every_column(df: DataFrame) -> Column:
    """An aggregate that looks at all columns. Without it the optimizer would
    cut down a statistic's copy of a frame to the columns it needs, and the two
    copies would no longer be one exchange."""
    return F.max(F.xxhash64(*df.columns)).alias("__every")


def _with_burden(base: DataFrame) -> DataFrame:
    """What the scores take from demand alone, so that no supply changes it.

    Maxima and the median are one one-row aggregate over the districts, used as
    a scalar subquery. The districts are a bounded set (administrative units),
    so the exact percentile is safe here. The district table is dealt by its
    key once: the subquery and the rows read that one exchange, so the facts
    behind it are aggregated once, and nothing runs before the query does.
    """
    base = base.repartition("district_key", "state_key")
    households = F.col("households_surveyed")
    burden = F.col("demand_pct") / 100.0 * F.greatest(households, F.lit(1.0))
    burdened = base.withColumn("demand_burden", burden)
    stats = burdened.agg(
        F.max("demand_burden").alias("max_burden"),
        F.max("households_surveyed").alias("max_households"),
        F.percentile("demand_burden", 0.5).alias("median_burden"),
        _every_column(base),
    )
    s = attach_stats(burdened, stats, "__s")
    return s.select(
        *base.columns,
        "demand_burden",
        F.try_divide("demand_burden", F.nullif(F.col("__s.max_burden"), F.lit(0.0))).alias("demand_norm"),
        F.greatest(F.col("demand_burden") * BEDS_PER_BURDEN, F.lit(1.0)).alias("expected_beds"),
        F.try_divide(households, F.nullif(F.col("__s.max_households"), F.lit(0.0))).alias("__sample"),
        (F.col("demand_burden") > F.col("__s.median_burden")).alias("__over"),
    )


def _supply_norm(beds: Column) -> Column:
    return F.least(F.lit(1.0), F.try_divide(beds.cast("double"), F.col("expected_beds")))


def _scored(state: DataFrame) -> DataFrame:
    """Scores and flags by the supply that the rows have."""
    beds = F.col("category_bed_capacity")
    scored = state.withColumn("supply_norm", _supply_norm(beds))
    diff = stable_round(F.col("demand_norm") - F.col("supply_norm"), 8)
    n = F.col("total_facilities")
    depth = F.when(n >= 10, 1.0).when(n >= 3, 0.75).when(n > 0, 0.5).otherwise(0.15)
    return scored.select(
        *BASE,
        "demand_burden",
        "demand_norm",
        "supply_norm",
        "expected_beds",
        stable_round(F.col("demand_norm") - F.col("supply_norm"), 4).alias("gap_score"),
        stable_round(F.col("demand_norm") * (1 - F.col("supply_norm")), 4).alias("desert_risk_score"),
        stable_round(F.col("supply_norm") - F.col("demand_norm"), 4).alias("balance_ratio"),
        F.when((beds == 0) & F.col("__over"), "no_supply")
        .when(diff > WIDE_GAP, "high_gap")
        .when(diff < -WIDE_GAP, "low_demand_high_supply")
        .otherwise("balanced")
        .alias("gap_flag"),
        stable_round(F.col("demand_norm"), 3).alias("demand_score"),
        stable_round(F.col("supply_norm"), 3).alias("supply_score"),
        stable_round(F.col("__sample") * 0.6 + depth * 0.4, 3).alias("confidence_score"),
    )


BASE = ("district_key", "state_key", "district_name", "state_ut", "demand_pct", "households_surveyed", *SUPPLY)


def gap_core(
    long: DataFrame,
    imap: DataFrame,
    facility: DataFrame,
    bridge: DataFrame,
    mapping: DataFrame,
    category: str = "ALL",
    scenario: DataFrame | None = None,
) -> DataFrame:
    """Scores per district, with the supply that a scenario adds."""
    state = gap_state(long, imap, facility, bridge, mapping, category)
    return _scored(state if scenario is None else with_scenario(state, scenario))


def gap_state(
    long: DataFrame, imap: DataFrame, facility: DataFrame, bridge: DataFrame, mapping: DataFrame, category: str = "ALL"
) -> DataFrame:
    """Districts with demand, supply and what the scores need of all districts:
    the state from which scenarios are scored without looking at facts again."""
    demand = district_demand(long, imap, category)
    return _with_burden(gap_base(demand, bed_supply(facility, bridge, mapping, category)))


def _added(state: DataFrame, scenario: DataFrame) -> DataFrame:
    """The state with what a scenario adds to each district's supply."""
    added = scenario_supply(scenario).withColumnsRenamed({m: f"__more_{m}" for m in SUPPLY})
    return state.join(added, ["district_key", "state_key"], "left")


def with_scenario(state: DataFrame, scenario: DataFrame) -> DataFrame:
    """The state after a scenario. Demand and its statistics stay; only the
    supply of the districts that it touches grows."""
    more = {m: F.col(m) + F.coalesce(f"__more_{m}", F.lit(0)) for m in SUPPLY}
    return _added(state, scenario).select(*[more.get(c, F.col(c)).alias(c) for c in state.columns])


GAP_TABLE = (
    "district_name", "state_ut", "demand_pct", "households_surveyed", "total_facilities",
    "category_facilities", "category_bed_capacity", "expected_beds", "gap_score",
    "desert_risk_score", "gap_flag", "demand_score", "supply_score", "confidence_score",
)


def gap_table(core: DataFrame, k: int = 25) -> DataFrame:
    """Districts with the highest desert risk."""
    order = [F.desc("desert_risk_score"), F.asc("state_ut"), F.asc("district_name")]
    return topk(core.select(*GAP_TABLE), order, k)


def gap_summary(core: DataFrame, k: int = 10) -> DataFrame:
    """One row: districts, districts without supply, median demand, flagged
    districts and the ``k`` widest gaps as JSON."""
    top = top_json(
        core.select("district_name", "state_ut", "demand_pct", "category_facilities", "gap_score", "gap_flag"),
        [F.desc("gap_score"), F.asc("state_ut"), F.asc("district_name")],
        k,
        ["district_name", "state_ut", "demand_pct", "category_facilities", "gap_score", "gap_flag"],
        f"top_{k}_high_gap_districts",
    )
    totals = core.agg(
        F.count(F.lit(1)).alias("districts_analyzed"),
        F.count_if(F.col("category_bed_capacity") == 0).alias("districts_with_zero_category_supply"),
        stable_round(F.percentile("demand_pct", 0.5), 2).alias("median_demand_pct"),
        F.count_if(F.col("gap_flag").isin("high_gap", "no_supply")).alias("districts_high_gap_or_no_supply"),
    )
    return totals.withColumn(f"top_{k}_high_gap_districts", top.scalar())


def centroids(postal: DataFrame, lat: tuple[float, float] = (6, 38), lon: tuple[float, float] = (68, 98)) -> DataFrame:
    """``district_key, state_key, pincode_count, latitude, longitude``: mean point
    of the postal codes of a district, one directory row per code."""
    columns = ["district", "statename", "latitude", "longitude"]
    first = postal.groupBy("pincode").agg(F.min(F.struct(*columns)).alias("p")).select("pincode", "p.*")
    point = first.select(
        "pincode",
        match_key(F.col("district")).alias("district_key"),
        state_key(F.col("statename")).alias("state_key"),
        F.col("latitude").try_cast("double").alias("lat"),
        F.col("longitude").try_cast("double").alias("lon"),
    ).filter(F.col("lat").between(*lat) & F.col("lon").between(*lon))
    return point.groupBy("district_key", "state_key").agg(
        F.count("pincode").alias("pincode_count"),
        F.avg("lat").alias("latitude"),
        F.avg("lon").alias("longitude"),
    )


GAP_GEO = (
    "district_name", "state_ut", "demand_pct", "households_surveyed", "category_facilities",
    "category_bed_capacity", "expected_beds", "total_facilities", "demand_norm", "supply_norm",
    "balance_ratio", "confidence_score",
)


def gap_geo(core: DataFrame, points: DataFrame) -> DataFrame:
    """Scored districts that can be put on the map, with their centroids."""
    keyed = core.withColumn("state_key", state_key(F.col("state_ut")))
    joined = keyed.join(points, ["district_key", "state_key"])
    return joined.select(*GAP_GEO, "pincode_count", "latitude", "longitude")


def pincode_one(postal: DataFrame) -> DataFrame:
    """One district per postal code: the first by name."""
    return postal.groupBy("pincode").agg(F.min(F.struct("district", "statename")).alias("p")).select(
        "pincode", "p.district", "p.statename"
    )


def _raw_pincode(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "").try_cast("bigint")


def raw_district(raw: DataFrame, postal: DataFrame, *cols: str) -> DataFrame:
    """Raw rows that have a known postal code, with ``district_key, state_key``."""
    coded = raw.select(_raw_pincode(F.col("address_zipOrPostcode")).alias("pincode"), *cols)
    codes = pincode_one(postal).select(
        F.col("pincode").cast("bigint").alias("pincode"),
        match_key(F.col("district")).alias("district_key"),
        state_key(F.col("statename")).alias("state_key"),
    )
    return coded.join(codes, "pincode").drop("pincode")


def gap_v1(raw: DataFrame, postal: DataFrame, wide: DataFrame, indicator: str, patterns: Sequence[str] = CARDIAC_SUBSTRINGS) -> DataFrame:
    """Single-indicator gap: the indicator's percentage against the share of
    facilities whose label text has one of the patterns."""
    supply = (
        raw_district(raw, postal, "specialties")
        .groupBy("district_key", "state_key")
        .agg(
            F.count(F.lit(1)).alias("total_facilities"),
            F.sum(any_substring(F.col("specialties"), patterns)).alias("cardiac_facilities"),
        )
    )
    districts = wide.select(
        F.trim("district_name").alias("district_name"),
        F.trim("state_ut").alias("state_ut"),
        match_key(F.col("district_name")).alias("district_key"),
        state_key(F.col("state_ut")).alias("state_key"),
        F.col(indicator).cast("double").alias("hypertension_pct"),
    )
    joined = districts.join(supply, ["district_key", "state_key"], "left").select(
        "district_name",
        "state_ut",
        "hypertension_pct",
        F.coalesce("total_facilities", F.lit(0)).alias("total_facilities"),
        F.coalesce("cardiac_facilities", F.lit(0)).alias("cardiac_facilities"),
    )
    stats = joined.agg(
        F.max("cardiac_facilities").alias("top"), F.percentile("hypertension_pct", 0.5).alias("med")
    )
    s = attach_stats(joined, stats, "__s")
    share = F.coalesce(
        F.try_divide(F.col("cardiac_facilities").cast("double"), F.nullif(F.col("__s.top"), F.lit(0)).cast("double")),
        F.lit(0.0),
    )
    gap = F.col("hypertension_pct") / 100.0 - share
    diff = stable_round(gap, 8)
    return s.select(
        *joined.columns,
        gap.alias("raw_gap"),
        stable_round(gap, 4).alias("gap_score"),
        F.when((F.col("cardiac_facilities") == 0) & (F.col("hypertension_pct") > F.col("__s.med")), "no_supply")
        .when(diff > WIDE_GAP, "high_gap")
        .when(diff < -WIDE_GAP, "low_demand_high_supply")
        .otherwise("balanced")
        .alias("gap_flag"),
    )


def gap_top(v1: DataFrame, k: int = 15) -> DataFrame:
    """Widest single-indicator gaps with a label; the score is not rounded."""
    rows = v1.select(
        F.concat_ws(", ", "district_name", "state_ut").alias("district_label"),
        F.col("raw_gap").alias("gap_score"),
        "hypertension_pct",
        "cardiac_facilities",
    )
    return topk(rows, [F.desc(stable_round(F.col("gap_score"), 8)), F.asc("district_label")], k)


def dq_coverage(raw: DataFrame, postal: DataFrame, wide: DataFrame) -> DataFrame:
    """One row: how much of the raw data and of the survey meets the postal map."""
    located = raw_district(raw, postal, "unique_id")
    facilities = raw.agg(F.count(F.lit(1)).alias("n"))
    matched = located.agg(F.count_distinct("unique_id").alias("n"))
    supplied = located.select("district_key", "state_key").distinct().withColumn("hit", F.lit(1))
    districts = wide.select(
        match_key(F.col("district_name")).alias("district_key"), state_key(F.col("state_ut")).alias("state_key")
    )
    hits = districts.join(supplied, ["district_key", "state_key"], "left").agg(
        F.count(F.lit(1)).alias("n"), F.count("hit").alias("hit")
    )
    row = hits.select(
        facilities.scalar().alias("facilities_total"),
        matched.scalar().alias("facilities_matched_to_pincode"),
        F.col("n").alias("nfhs_districts_total"),
        F.col("hit").alias("nfhs_districts_with_facilities"),
    )
    return row.select(
        "facilities_total",
        "facilities_matched_to_pincode",
        stable_round(percent(F.col("facilities_matched_to_pincode"), F.col("facilities_total")), 1).alias("facilities_pincode_match_pct"),
        "nfhs_districts_total",
        "nfhs_districts_with_facilities",
        stable_round(percent(F.col("nfhs_districts_with_facilities"), F.col("nfhs_districts_total")), 1).alias("nfhs_districts_with_facilities_pct"),
        (F.col("nfhs_districts_total") - F.col("nfhs_districts_with_facilities")).alias("nfhs_districts_unmatched"),
    )


def scenario_impact(
    long: DataFrame,
    facility: DataFrame,
    bridge: DataFrame,
    mapping: DataFrame,
    items: DataFrame,
    demand_key: str,
    second_key: str,
    category: str,
    weight: float = 8.0,
    pattern: str = CARDIAC_CAPABILITY_PATTERN,
) -> DataFrame:
    """Baseline against scenario per district a scenario touches: facilities,
    facilities of the category, beds and ``demand - weight * facilities``."""

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("d", F.lower(F.trim("district_name"))).withColumn("s", F.lower(F.trim("state_ut")))

    def value(k: str) -> Column:
        return F.max(F.when(F.col("indicator_key") == k, F.col("indicator_value")))

    demand = keyed(long).groupBy("d", "s").agg(
        value(HOUSEHOLDS_KEY).alias("households"), value(demand_key).alias("p1"), value(second_key).alias("p2")
    )
    wanted = mapping.filter(F.col("category").contains(category)).select(F.col("specialties").alias("specialty"))
    ids = bridge.join(wanted, "specialty", "left_semi").select("facility_id").distinct().withColumn("hit", F.lit(1))
    rows = keyed(facility.select("facility_id", "district_name", "state_ut", "bed_count")).join(ids, "facility_id", "left")
    # facilities of the category are counted once each, rows are counted as they are
    per_facility = rows.groupBy("d", "s", "facility_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce("bed_count", F.lit(0))).alias("beds"),
        F.max(F.coalesce("hit", F.lit(0))).alias("hit"),
    )
    base = per_facility.groupBy("d", "s").agg(
        F.sum("n").alias("facilities"), F.sum("hit").alias("cardiac"), F.sum("beds").alias("beds")
    )
    added = items.select(
        F.trim("district_name").alias("district_name"),
        F.trim("state_ut").alias("state_ut"),
        F.greatest(F.col("capacity").cast("int"), F.lit(0)).alias("capacity"),
        F.when(F.lower("capability").rlike(pattern), 1).otherwise(0).alias("is_cardiac"),
    )
    added = keyed(added).groupBy("d", "s", "district_name", "state_ut").agg(
        F.count(F.lit(1)).alias("add_n"), F.sum("is_cardiac").alias("add_cardiac"), F.sum("capacity").alias("add_beds")
    )
    j = added.join(demand, ["d", "s"]).join(base, ["d", "s"], "left")
    zero = F.lit(0)
    n, card, beds = (F.coalesce(c, zero) for c in ("facilities", "cardiac", "beds"))
    gap_before = F.col("p1") - card * weight
    gap_after = F.col("p1") - (card + F.col("add_cardiac")) * weight
    return j.select(
        "district_name",
        "state_ut",
        stable_round(F.col("p1"), 2).alias("baseline_hypertension_demand_pct"),
        stable_round(F.col("p1"), 2).alias("scenario_hypertension_demand_pct"),
        stable_round(F.col("p2"), 2).alias("baseline_diabetes_demand_pct"),
        stable_round(F.col("p2"), 2).alias("scenario_diabetes_demand_pct"),
        n.alias("baseline_facility_count"),
        (n + F.col("add_n")).alias("scenario_facility_count"),
        F.col("add_n").alias("delta_facility_count"),
        card.alias("baseline_cardiac_facility_count"),
        (card + F.col("add_cardiac")).alias("scenario_cardiac_facility_count"),
        F.col("add_cardiac").alias("delta_cardiac_facility_count"),
        beds.alias("baseline_bed_capacity"),
        (beds + F.col("add_beds")).alias("scenario_bed_capacity"),
        F.col("add_beds").alias("delta_bed_capacity"),
        stable_round(gap_before, 2).alias("baseline_supply_demand_gap"),
        stable_round(gap_after, 2).alias("scenario_supply_demand_gap"),
        stable_round(gap_after - gap_before, 2).alias("delta_supply_demand_gap"),
        stable_round(F.col("households"), 0).alias("nfhs_households_surveyed"),
    ).orderBy("state_ut", "district_name")


def desert_risk(core: DataFrame) -> DataFrame:
    return core.withColumn("desert_risk", F.col("demand_norm") * (1 - F.col("supply_norm")))


def risk_range(core: DataFrame) -> DataFrame:
    """``lo, hi`` of the desert risk, 0 and 1 when there are no rows."""
    return desert_risk(core).agg(
        F.coalesce(F.min("desert_risk"), F.lit(0.0)).alias("lo"),
        F.coalesce(F.max("desert_risk"), F.lit(1.0)).alias("hi"),
    )


def normalized_risk(risk: Column, bounds: Column) -> Column:
    """Risk on the 0..1 range of the bounds; 0 when the range is empty."""
    lo, hi = bounds["lo"], bounds["hi"]
    return F.when(hi <= lo, 0.0).otherwise((risk - lo) / F.nullif(hi - lo, F.lit(0.0)))


def confidence_level(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.5, "medium").otherwise("low")


def risk_tiers(core: DataFrame) -> DataFrame:
    """Desert risk, its place in the range of all districts, the tier and the
    confidence bucket. Districts without supply are marked as such."""
    s = attach_stats(desert_risk(core), risk_range(core), "__r")
    norm = normalized_risk(F.col("desert_risk"), F.col("__r"))
    at = stable_round(norm, 8)
    tier = F.when(at >= 0.66, "high").when(at >= 0.33, "moderate").otherwise("low")
    return s.select(
        "district_name",
        "state_ut",
        "desert_risk",
        norm.alias("desert_risk_norm"),
        F.when(F.col("category_bed_capacity") == 0, "no_supply").otherwise(tier).alias("risk_tier"),
        confidence_level(F.col("confidence_score")).alias("confidence_level"),
    )


def scenario_delta(state: DataFrame, scenario: DataFrame) -> DataFrame:
    """What ``scenario_compare`` gives for a state and the same after a
    scenario, from the state alone: both supplies stand in one row, so nothing
    is aggregated or scored twice and no two results are joined."""
    risk = lambda beds: F.col("demand_norm") * (1 - _supply_norm(beds))
    beds = F.col("category_bed_capacity")
    more = F.coalesce("__more_category_bed_capacity", F.lit(0))
    risks = state.agg(
        F.coalesce(F.min(risk(beds)), F.lit(0.0)).alias("lo"), F.coalesce(F.max(risk(beds)), F.lit(1.0)).alias("hi"), _every_column(state)
    )
    s = attach_stats(_added(state, scenario), risks, "__r")
    before, after = (normalized_risk(risk(b), F.col("__r")) for b in (beds, beds + more))
    return s.select(
        "district_name",
        "state_ut",
        beds.alias("baseline_beds"),
        (beds + more).alias("scenario_beds"),
        more.alias("delta_beds"),
        before.alias("baseline_risk_norm"),
        after.alias("scenario_risk_norm"),
        # the same sum where nothing was added
        F.when(more == 0, F.when(before.isNotNull(), 0.0)).otherwise(after - before).alias("delta_risk"),
    )


def scenario_compare(base: DataFrame, scen: DataFrame) -> DataFrame:
    """Per scenario district: beds and risk before and after, on the baseline's
    risk range. A district the baseline lacks shows no change."""
    b = desert_risk(base).select(
        "district_key", "state_key",
        F.col("category_bed_capacity").alias("b_beds"),
        F.col("desert_risk").alias("b_risk"),
    )
    joined = desert_risk(scen).join(b, ["district_key", "state_key"], "left")
    s = attach_stats(joined, risk_range(base), "__r")
    after = normalized_risk(F.col("desert_risk"), F.col("__r"))
    before = normalized_risk(F.coalesce("b_risk", "desert_risk"), F.col("__r"))
    beds = F.col("category_bed_capacity")
    return s.select(
        "district_name",
        "state_ut",
        F.coalesce("b_beds", beds).alias("baseline_beds"),
        beds.alias("scenario_beds"),
        (beds - F.coalesce("b_beds", beds)).alias("delta_beds"),
        before.alias("baseline_risk_norm"),
        after.alias("scenario_risk_norm"),
        (after - before).alias("delta_risk"),
    )


def delta_extent(compared: DataFrame, col: str = "delta_risk") -> DataFrame:
    """Symmetric colour span for the changes."""
    peak = compared.agg(F.max(F.abs(F.col(col))).alias("peak"))
    p = F.coalesce("peak", F.lit(0.0))
    span = F.when(p > 1e-9, F.greatest(p * 0.85, F.lit(0.001))).otherwise(0.01)
    return peak.select((-span).alias("min_extent"), span.alias("max_extent"))


def geo_stats(core: DataFrame) -> DataFrame:
    """``total_beds, top_label, top_score``: all beds and the district at most risk."""
    label = F.concat_ws(", ", "district_name", "state_ut")
    score = stable_round(F.col("desert_risk"), 8)
    rows = desert_risk(core).select(
        "category_bed_capacity", label.alias("label"), score.alias("score")
    )
    best = rows.orderBy(F.desc("score"), F.asc("label")).limit(1).select(F.struct("label", "score")).scalar()
    totals = rows.agg(F.sum("category_bed_capacity").alias("total_beds")).withColumn("__b", best)
    return totals.select(
        "total_beds", F.col("__b.label").alias("top_label"), F.col("__b.score").alias("top_score")
    )


CARDS = {
    "total_beds": False,
    "zero_supply_districts": True,
    "high_risk_districts": True,
}


def summary_cards(base: DataFrame, scen: DataFrame) -> DataFrame:
    """``card, baseline, scenario, delta, improved`` for the headline figures of
    two scored frames; ``improved`` is NULL when nothing changed."""

    def figures(core: DataFrame) -> DataFrame:
        return core.agg(
            F.sum("category_bed_capacity").alias("total_beds"),
            F.count_if(F.col("category_bed_capacity") == 0).alias("zero_supply_districts"),
            F.count_if(F.col("gap_flag").isin("high_gap", "no_supply")).alias("high_risk_districts"),
        )

    both = figures(base).withColumn("__s", figures(scen).select(F.struct(*CARDS)).scalar())
    rows = [
        F.struct(
            F.lit(card).alias("card"),
            F.col(card).cast("bigint").alias("baseline"),
            F.col("__s")[card].cast("bigint").alias("scenario"),
            F.lit(lower).alias("lower_is_better"),
        )
        for card, lower in CARDS.items()
    ]
    delta = F.col("scenario") - F.col("baseline")
    better = F.when(F.col("lower_is_better"), delta < 0).otherwise(delta > 0)
    return (
        both.select(F.inline(F.array(*rows)))
        .withColumn("delta", delta)
        .withColumn("improved", F.when(delta != 0, better))
        .drop("lower_is_better")
    )
