"""Model tables built from the stand-ins, for Spark and for the oracles."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwright.bindings.catalog import DERIVED, r
from gapwright.bindings.standins import standin
from gapwright.operators.aggregates import majority_vote
from gapwright.operators.upsert import overlay
from gapwright.plans import curation, quality, scoring
from gapwright.sources.params import scenario_items, scenario_rows
from gapwright.sources.tables import alias_table



def kept(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Build the plan of a model table once per session and source."""
    known: dict[tuple[str, str], DataFrame] = {}

    @functools.wraps(fn)
    def build(spark: SparkSession, d: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, d)
        if key not in known:
            known[key] = fn(spark, d)
        return known[key]

    return build


NOW = "2024-02-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


@kept
def states(spark: SparkSession, d: str) -> DataFrame:
    return alias_table(standin(spark, d, "states"), "alias", ["canonical_state_ut"])


@kept
def districts(spark: SparkSession, d: str) -> DataFrame:
    return alias_table(
        standin(spark, d, "districts"), "alias", ["canonical_district"], also=["canonical_state_ut"]
    )


@kept
def directory(spark: SparkSession, d: str) -> DataFrame:
    return curation.geo_directory(standin(spark, d, "postal"), states(spark, d), districts(spark, d))


@kept
def places(spark: SparkSession, d: str) -> DataFrame:
    return curation.geography(standin(spark, d, "wide"), states(spark, d))


@kept
def long(spark: SparkSession, d: str) -> DataFrame:
    return curation.health_indicator(standin(spark, d, "wide"), states(spark, d))


@kept
def mapping(spark: SparkSession, d: str) -> DataFrame:
    # labels that end so are left without a category
    label = F.when(F.col("p_name").endswith("ring"), F.concat("p_name", F.lit(" (old)"))).otherwise(F.col("p_name"))
    part = standin(spark, d, "part")
    return majority_vote(part.select(label.alias("specialties"), F.col("p_type").alias("category")), "specialties", "category")


@kept
def descriptions(spark: SparkSession, d: str) -> DataFrame:
    return standin(spark, d, "raw").select(
        F.nullif(F.trim("name"), F.lit("null")).alias("facility_id"), "description"
    )


def model(spark: SparkSession, d: str) -> quality.Model:
    return quality.Model(
        facility=standin(spark, d, "facility"),
        long=long(spark, d),
        bridge=standin(spark, d, "bridge"),
        mapping=mapping(spark, d),
        indicator_bridge=standin(spark, d, "imap"),
        raw=descriptions(spark, d),
        corrections=standin(spark, d, "corrections").withColumn("updated_at", now().cast("timestamp_ntz")),
    )


def corrected_model(spark: SparkSession, d: str) -> quality.Model:
    m = model(spark, d)
    facility = overlay(m.facility, standin(spark, d, "corrections"), "facility_id", curation.CORRECTED)
    return replace(m, facility=facility)


@kept
def prior_gaps(spark: SparkSession, d: str) -> DataFrame:
    """An earlier gap table: found before corrections, with statuses given since."""
    first = F.substring("gap_id", 1, 1)
    status = (
        F.when(first < "4", "open").when(first < "8", "resolved").when(first < "c", "dismissed").otherwise("auto_resolved")
    )
    return quality.dq_gaps(model(spark, d)).select(
        "*",
        status.alias("status"),
        F.when(first >= "8", "seen").alias("resolution_notes"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("updated_at"),
    )


@kept
def scenario(spark: SparkSession, d: str) -> DataFrame:
    return scenario_rows(scenario_items(standin(spark, d, "scenarios"), "doc"))


def core(spark: SparkSession, d: str, category: str = "ECONOMY", with_scenario: bool = False) -> DataFrame:
    m = model(spark, d)
    added = scenario(spark, d) if with_scenario else None
    return scoring.gap_core(m.long, m.indicator_bridge, m.facility, m.bridge, m.mapping, category, added)


def state(spark: SparkSession, d: str, category: str = "ECONOMY") -> DataFrame:
    m = model(spark, d)
    return scoring.gap_state(m.long, m.indicator_bridge, m.facility, m.bridge, m.mapping, category)


# ---------------------------------------------------------------- oracle side

DERIVED["state_key"] = "SELECT upper(trim(alias)) AS k, min(canonical_state_ut) AS canonical FROM @states GROUP BY 1"
DERIVED["district_key"] = (
    "SELECT upper(trim(alias)) AS k, canonical_state_ut AS st, min(canonical_district) AS canonical FROM @districts GROUP BY 1, 2"
)

TEXT_COLUMNS = ("w15_with_high_bp_pct", "child_12_23m_vaccinated_pct", "births_csection_pct", "respiratory_infection_pct")
NUMBER_COLUMNS = (
    "households_surveyed", "women_15_49_interviewed", "men_15_54_interviewed",
    "high_blood_sugar_pct", "all_anaemic_pct", "tobacco_use_pct", "electricity_pct",
)
SIZES = "('households_surveyed', 'women_15_49_interviewed', 'men_15_54_interviewed')"

DERIVED["named_wide"] = """
    SELECT w.* EXCLUDE (district_name, state_ut), trim(w.district_name) AS district_name,
           coalesce(s.canonical, trim(w.state_ut)) AS state_ut
    FROM @wide w LEFT JOIN @state_key s ON upper(trim(w.state_ut)) = s.k"""


def _long_part(c: str) -> str:
    if c in TEXT_COLUMNS:
        value = f"CASE WHEN trim({c}) = '*' THEN NULL ELSE TRY_CAST(regexp_replace(trim({c}), '[()]', '', 'g') AS DOUBLE) END"
        flag = f"coalesce(trim({c}) = '*', false)"
    else:
        value, flag = f"CAST({c} AS DOUBLE)", "false"
    return (
        f"SELECT md5(concat_ws('|', district_name, state_ut)) AS district_id, district_name, state_ut, "
        f"'{c}' AS indicator_key, {value} AS indicator_value, {flag} AS is_suppressed, CAST({c} AS VARCHAR) AS indicator_raw FROM @named_wide"
    )


DERIVED["long"] = " UNION ALL ".join(_long_part(c) for c in TEXT_COLUMNS + NUMBER_COLUMNS)
DERIVED["mapping"] = """
    SELECT specialties, category FROM (
        SELECT label AS specialties, p_type AS category,
               row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, p_type) AS rn
        FROM (SELECT *, CASE WHEN p_name LIKE '%ring' THEN p_name || ' (old)' ELSE p_name END AS label FROM @part) p
        GROUP BY label, p_type) v WHERE rn = 1"""
DERIVED["descriptions"] = "SELECT nullif(trim(name), 'null') AS facility_id, description FROM @raw"


def gaps_sql(facility: str, bridge: str = "@bridge", mapping: str = "@mapping", imap: str = "@imap") -> str:
    """All detectors, written as one select per gap type; without the payload."""
    keys = "(SELECT DISTINCT indicator_key FROM @long)"
    bad_type = "(facility_type IS NULL OR trim(facility_type) IN ('', 'null') OR regexp_matches(facility_type, '^[0-9.]+$'))"
    rows = f"""
        SELECT DISTINCT 'unmapped_specialty' AS gap_type, 'warn' AS severity, 'specialty' AS entity_type, specialty AS entity_key,
               specialty AS entity_label, 'category' AS field_name, CAST(NULL AS VARCHAR) AS current_value,
               'Choose a category for the label' AS suggested_fix, 'add_specialty_category_mapping' AS fix_action
        FROM {bridge} b WHERE NOT EXISTS (SELECT 1 FROM {mapping} m WHERE m.specialties = b.specialty)
        UNION ALL
        SELECT DISTINCT 'orphan_indicator_mapping', 'critical', 'indicator', indicator_key, indicator_key, 'indicator_key', indicator_key,
               'Correct the indicator or take it out', 'delete_health_indicator_specialty'
        FROM {imap} i WHERE indicator_key NOT IN (SELECT indicator_key FROM @long)
        UNION ALL
        SELECT 'unmapped_indicator', 'warn', 'indicator', indicator_key, indicator_key, 'specialty_category', NULL,
               'Choose a category for the indicator', 'add_health_indicator_specialty'
        FROM {keys} k WHERE indicator_key NOT IN (SELECT indicator_key FROM {imap})
        UNION ALL
        SELECT 'facility_without_specialty', 'warn', 'facility', f.facility_id,
               coalesce(nullif(nullif(trim(facility_name), ''), 'null'), nullif(trim(description), ''), f.facility_id),
               'specialties_raw', coalesce(specialties_raw, ''),
               'Let a label be inferred from the texts, or choose one', 'update_facility_field'
        FROM {facility} f LEFT JOIN @descriptions d ON d.facility_id = f.facility_id
        WHERE f.facility_id NOT IN (SELECT facility_id FROM {bridge})
        UNION ALL
        SELECT 'missing_pincode', 'warn', 'facility', facility_id, coalesce(facility_name, facility_id), 'pincode', '',
               'Enter the postal code, six digits', 'update_facility_field'
        FROM {facility} WHERE pincode IS NULL
        UNION ALL
        SELECT 'invalid_facility_type', 'warn', 'facility', facility_id, coalesce(facility_name, facility_id), 'facility_type',
               coalesce(facility_type, ''), 'Enter what kind of facility it is', 'update_facility_field'
        FROM {facility} WHERE {bad_type}"""
    return f"SELECT md5(concat_ws('|', gap_type, entity_type, entity_key, coalesce(field_name, ''))) AS gap_id, * FROM ({rows}) g"


DERIVED["gaps"] = gaps_sql("@facility")
DERIVED["corrected"] = """
    SELECT f.facility_id, coalesce(c.facility_name, f.facility_name) AS facility_name, f.state_ut_raw,
           coalesce(c.state_ut, f.state_ut) AS state_ut, f.district_id, coalesce(c.district_name, f.district_name) AS district_name,
           coalesce(c.pincode, f.pincode) AS pincode, coalesce(c.operator_type, f.operator_type_raw) AS operator_type_raw,
           coalesce(c.operator_type, f.operator_type) AS operator_type, coalesce(c.doctors_count, f.doctors_count) AS doctors_count,
           coalesce(c.bed_count, f.bed_count) AS bed_count, f.lat, f.lon, f.coord_valid,
           coalesce(c.facility_type, f.facility_type) AS facility_type, coalesce(c.specialties_raw, f.specialties_raw) AS specialties_raw,
           f.join_confidence
    FROM @facility f LEFT JOIN @corrections c ON f.facility_id = c.facility_id"""
DERIVED["new_gaps"] = gaps_sql("@corrected")
DERIVED["prior"] = """
    SELECT *, CASE WHEN gap_id < '4' THEN 'open' WHEN gap_id < '8' THEN 'resolved' WHEN gap_id < 'c' THEN 'dismissed'
           ELSE 'auto_resolved' END AS status, CASE WHEN gap_id >= '8' THEN 'seen' END AS resolution_notes
    FROM @gaps"""
AUTO_NOTE = "Not found again by the latest refresh"


def merged_sql(prior: str, found: str, touched: bool = False) -> str:
    """Reconciled gap table, one select per case of the state machine."""
    cols = "gap_type, severity, entity_type, entity_key, entity_label, field_name, current_value, suggested_fix, fix_action"
    new = ", ".join(f"s.{c.strip()}" for c in cols.split(","))
    return f"""
        SELECT s.gap_id, {new}, CASE WHEN p.status = 'resolved' THEN 'open' ELSE p.status END AS status, p.resolution_notes
        FROM {found} s JOIN {prior} p ON p.gap_id = s.gap_id
        UNION ALL SELECT gap_id, {cols}, 'open', NULL FROM {found} WHERE gap_id NOT IN (SELECT gap_id FROM {prior})
        UNION ALL SELECT gap_id, {cols}, 'auto_resolved', '{AUTO_NOTE}' FROM {prior}
            WHERE status IN ('open', 'resolved') AND gap_id NOT IN (SELECT gap_id FROM {found})
        UNION ALL SELECT gap_id, {cols}, status, resolution_notes FROM {prior}
            WHERE status NOT IN ('open', 'resolved') AND gap_id NOT IN (SELECT gap_id FROM {found})"""


DERIVED["scenario_item"] = """
    SELECT scenario_id, f.district_name AS district_name, f.state_ut AS state_ut, f.capability AS capability, f.capacity AS capacity FROM (
        SELECT scenario_id, unnest(from_json(doc, '[{"district_name":"VARCHAR","state_ut":"VARCHAR","capability":"VARCHAR","capacity":"INTEGER"}]')) AS f
        FROM @scenarios) x"""
DERIVED["scenario_row"] = """
    SELECT upper(trim(district_name)) AS district_key, upper(trim(state_ut)) AS state_key, trim(capability) AS capability,
           greatest(capacity, 0) AS capacity, CASE WHEN trim(capability) = '' THEN 0 ELSE 1 END AS is_match FROM @scenario_item"""


def core_sql(category: str, with_scenario: bool) -> str:
    """Scores per district, following the written formulas step by step."""
    imap = "@imap" if category == "ALL" else f"(SELECT * FROM @imap WHERE specialty_category = '{category}')"
    cats = "@mapping" if category == "ALL" else f"(SELECT * FROM @mapping WHERE category = '{category}')"
    added = (
        "SELECT district_key, state_key, count(*) AS n, sum(is_match) AS c, "
        "sum(CASE WHEN is_match > 0 THEN greatest(capacity, 1) ELSE 0 END) AS b FROM @scenario_row GROUP BY 1, 2"
        if with_scenario
        else "SELECT '' AS district_key, '' AS state_key, 0 AS n, 0 AS c, 0 AS b"
    )
    return f"""
        SELECT district_key, state_key, district_name, state_ut, demand_pct, households_surveyed, total_facilities, category_facilities,
               category_bed_capacity, demand_burden, demand_norm, supply_norm, expected_beds,
               {r('demand_norm - supply_norm', 4)} AS gap_score, {r('demand_norm * (1 - supply_norm)', 4)} AS desert_risk_score,
               {r('supply_norm - demand_norm', 4)} AS balance_ratio,
               CASE WHEN category_bed_capacity = 0 AND demand_burden > med THEN 'no_supply'
                    WHEN {r('demand_norm - supply_norm', 8)} > 0.3 THEN 'high_gap'
                    WHEN {r('supply_norm - demand_norm', 8)} > 0.3 THEN 'low_demand_high_supply' ELSE 'balanced' END AS gap_flag,
               {r('demand_norm', 3)} AS demand_score, {r('supply_norm', 3)} AS supply_score,
               {r('''0.6::DOUBLE * households_surveyed / max_h + 0.4::DOUBLE * CASE WHEN total_facilities >= 10 THEN 1.0::DOUBLE WHEN total_facilities >= 3
                    THEN 0.75::DOUBLE WHEN total_facilities > 0 THEN 0.5::DOUBLE ELSE 0.15::DOUBLE END''', 3)} AS confidence_score
        FROM (
          SELECT *, demand_burden / max(demand_burden) OVER () AS demand_norm, greatest(demand_burden * 5, 1) AS expected_beds,
                 least(1, category_bed_capacity / greatest(demand_burden * 5, 1)) AS supply_norm,
                 max(households_surveyed) OVER () AS max_h, quantile_cont(demand_burden, 0.5) OVER () AS med
          FROM (
            SELECT d.*, demand_pct / 100.0::DOUBLE * greatest(households_surveyed, 1) AS demand_burden,
                   CAST(coalesce(a.n, 0) + coalesce(x.n, 0) AS BIGINT) AS total_facilities,
                   CAST(coalesce(c.n, 0) + coalesce(x.c, 0) AS BIGINT) AS category_facilities,
                   CAST(coalesce(c.b, 0) + coalesce(x.b, 0) AS BIGINT) AS category_bed_capacity
            FROM (SELECT upper(district_name) AS district_key, upper(state_ut) AS state_key, district_name, state_ut,
                         {r('''avg(CASE WHEN NOT is_suppressed AND indicator_key IN (SELECT indicator_key FROM ''' + imap + f''') AND indicator_key NOT IN {SIZES}
                             THEN indicator_value END)''', 2)} AS demand_pct,
                         max(CASE WHEN indicator_key = 'households_surveyed' THEN indicator_value END) AS households_surveyed
                  FROM @long GROUP BY ALL) d
            LEFT JOIN (SELECT upper(district_name) AS dk, upper(state_ut) AS sk, count(DISTINCT facility_id) AS n
                       FROM @facility WHERE state_ut IS NOT NULL GROUP BY 1, 2) a ON a.dk = d.district_key AND a.sk = d.state_key
            LEFT JOIN (SELECT dk, sk, count(*) AS n, sum(beds) AS b FROM (
                         SELECT upper(f.district_name) AS dk, upper(f.state_ut) AS sk, f.facility_id,
                                max(coalesce(nullif(bed_count, 0), 25)) AS beds
                         FROM @facility f JOIN @bridge b ON b.facility_id = f.facility_id JOIN {cats} m ON m.specialties = b.specialty
                         WHERE f.state_ut IS NOT NULL GROUP BY 1, 2, 3) p GROUP BY 1, 2) c ON c.dk = d.district_key AND c.sk = d.state_key
            LEFT JOIN ({added}) x ON x.district_key = d.district_key AND x.state_key = d.state_key
            WHERE demand_pct IS NOT NULL) j) s"""


DERIVED["core"] = core_sql("ECONOMY", False)
DERIVED["core_scenario"] = core_sql("ECONOMY", True)
DERIVED["core_all"] = core_sql("ALL", False)
DERIVED["risk"] = "SELECT *, demand_norm * (1 - supply_norm) AS risk FROM @core"


# postal directory and placed raw rows, written out join by join
DERIVED["directory"] = """
    SELECT pincode, first_place.a AS district_name, first_place.b AS state_ut, ambiguous FROM (
        SELECT pincode, min({'a': district_name, 'b': state_ut, 'c': district_raw}) AS first_place, count(DISTINCT district_raw) > 1 AS ambiguous FROM (
            SELECT p.pincode, p.district_raw, p.state AS state_ut, coalesce(k.canonical, p.district_raw) AS district_name FROM (
                SELECT CAST(pincode AS VARCHAR) AS pincode, trim(district) AS district_raw,
                       coalesce(s.canonical, trim(statename)) AS state
                FROM @postal LEFT JOIN @state_key s ON upper(trim(statename)) = s.k) p
            LEFT JOIN @district_key k ON upper(p.district_raw) = k.k AND p.state = k.st) n
        GROUP BY 1) g"""
DERIVED["places"] = """
    SELECT DISTINCT md5(concat_ws('|', district_name, state_ut)) AS district_id, district_name, state_ut FROM @named_wide"""
DERIVED["bridged"] = """
    SELECT b.unique_id, b.pincode, b.state_ut_raw, g.district_id, g.district_name, g.state_ut,
           CASE WHEN g.district_id IS NOT NULL AND NOT coalesce(p.ambiguous, false) THEN 'high' WHEN g.district_id IS NOT NULL THEN 'medium'
                WHEN s.canonical IS NOT NULL THEN 'low' ELSE 'unmatched' END AS join_confidence
    FROM (SELECT unique_id, trim(address_stateOrRegion) AS state_ut_raw, CASE WHEN regexp_full_match(z, '[1-9][0-9]{5}') THEN z END AS pincode
          FROM (SELECT *, regexp_replace(address_zipOrPostcode, '[^0-9]', '', 'g') AS z FROM @raw) r) b
    LEFT JOIN @directory p ON p.pincode = b.pincode
    LEFT JOIN @state_key s ON s.k = upper(b.state_ut_raw)
    LEFT JOIN @places g ON upper(coalesce(p.district_name, '')) = upper(g.district_name) AND coalesce(p.state_ut, s.canonical) = g.state_ut"""
