"""Jobs and reports on the synthetic tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapwright.bindings import cleaning, inputs
from gapwright.bindings.catalog import DERIVED, bind, is_label, r, rounded, strip
from gapwright.bindings.cleaning import LAT_SQL, LON_SQL, NOT_SPARSE, OPERATOR_SQL, STRAIGHT, SWAPPED, UUID_SQL, int_sql
from gapwright.bindings.inputs import SIZES
from gapwright.bindings.relational import EXPLORED
from gapwright.bindings.standins import standin
from gapwright.functions import numbers
from gapwright.operators.filters import apply_gate, facility_gate, gate_audit
from gapwright.operators.upsert import overlay
from gapwright.plans import curation, exploration, inference, quality, scoring, views, vocabulary

c = F.col

# ---------------------------------------------------------------- curation

bind("geo_directory", inputs.directory, "SELECT pincode, district_name, state_ut, ambiguous AS pincode_is_ambiguous FROM @directory")
bind("geography_dim", inputs.places, "SELECT * FROM @places")

DERIVED["best"] = f"""
    SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(trim(cluster_id), ''), trim(unique_id)) ORDER BY {cleaning.COMPLETE} DESC, trim(unique_id)) AS rn
        FROM @raw WHERE ({NOT_SPARSE}) AND {UUID_SQL}) x WHERE rn = 1"""
DERIVED["pre_gate"] = f"""
    SELECT trim(b.unique_id) AS facility_id, trim(name) AS facility_name, g.state_ut_raw, g.state_ut, g.district_id, g.district_name, g.pincode,
           trim(operatorTypeId) AS operator_type_raw, {OPERATOR_SQL} AS operator_type, {int_sql('numberDoctors')} AS doctors_count,
           {int_sql('capacity')} AS bed_count, {LAT_SQL} AS lat, {LON_SQL} AS lon, {STRAIGHT} OR {SWAPPED} AS coord_valid,
           trim(facilityTypeId) AS facility_type, trim(specialties) AS specialties_raw, g.join_confidence
    FROM @best b JOIN @bridged g ON g.unique_id = b.unique_id"""
RULES = {
    "postal_code": "pincode IS NOT NULL",
    "confidence": "join_confidence IN ('high', 'medium')",
    "coordinates": "coord_valid",
    "type": "coalesce(facility_type NOT IN ('', 'null') AND NOT regexp_full_match(facility_type, '[0-9.]+'), false)",
    "operator": "NOT (operator_type = 'unknown' AND coalesce(operator_type_raw NOT IN ('', 'null'), false))",
    "labels": "coalesce(specialties_raw NOT IN ('', 'null') AND specialties_raw LIKE '[%', false)",
}
ALL_RULES = " AND ".join(f"({x})" for x in RULES.values())
bind(
    "quality_gate",
    lambda s, d: apply_gate(cleaning.resolved(s, d), facility_gate()).select("facility_id", "pincode", "facility_type"),
    f"SELECT facility_id, pincode, facility_type FROM @pre_gate WHERE {ALL_RULES}",
)
AUDIT_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS rule, count(*) FILTER (NOT ({rule})) AS failed, count(*) AS total FROM @pre_gate" for name, rule in RULES.items()
) + f" UNION ALL SELECT 'any', count(*) FILTER (NOT ({ALL_RULES})), count(*) FROM @pre_gate"
bind("gate_audit", lambda s, d: gate_audit(cleaning.resolved(s, d), facility_gate()), AUDIT_SQL)


def audited(s, d):
    return curation.curation_audit(standin(s, d, "raw"), inputs.directory(s, d), inputs.states(s, d), inputs.places(s, d))


bind("curation_audit", audited, AUDIT_SQL + f" UNION ALL SELECT 'sparse', count(*) FILTER (NOT ({NOT_SPARSE})), count(*) FROM @raw")


def fixes(s, d):
    """Corrections keyed by the curated facilities' ids."""
    ids = standin(s, d, "raw").select(F.trim("unique_id").alias("facility_id"), F.trim("name").alias("__name"))
    old = standin(s, d, "corrections").withColumnRenamed("facility_id", "__name")
    return ids.join(old, "__name").drop("__name")


def curated(s, d):
    return curation.curate_facility(
        standin(s, d, "raw"), inputs.directory(s, d), inputs.states(s, d), inputs.places(s, d), fixes(s, d)
    )


bind("curate_facility", lambda s, d: rounded(curated(s, d)), f"""
    SELECT g.facility_id, coalesce(x.facility_name, g.facility_name) AS facility_name, g.state_ut_raw, g.state_ut, g.district_id, g.district_name,
           coalesce(x.pincode, g.pincode) AS pincode, coalesce(x.operator_type, g.operator_type_raw) AS operator_type_raw,
           coalesce(x.operator_type, g.operator_type) AS operator_type, g.doctors_count, coalesce(x.bed_count, g.bed_count) AS bed_count,
           {r('g.lat')} AS lat, {r('g.lon')} AS lon, g.coord_valid, coalesce(x.facility_type, g.facility_type) AS facility_type, g.specialties_raw, g.join_confidence
    FROM (SELECT * FROM @pre_gate WHERE {ALL_RULES}) g
    LEFT JOIN (SELECT trim(unique_id) AS id, c.* FROM @raw JOIN @corrections c ON trim(name) = c.facility_id) x ON x.id = g.facility_id""")
bind("health_indicator", inputs.long, "SELECT * FROM @long")


def seeded_bridge(s, d):
    raw = standin(s, d, "raw").select(c("unique_id").alias("facility_id"), c("specialties").alias("specialties_raw"))
    none = standin(s, d, "bridge").filter(c("specialty") == "none")
    return curation.seed_bridge(raw, none)


bind("bridge_seed", seeded_bridge, """
    SELECT DISTINCT unique_id AS facility_id, item AS specialty FROM (
        SELECT unique_id, unnest(from_json(specialties, '["VARCHAR"]')) AS item FROM @raw WHERE specialties LIKE '[%') x WHERE trim(item) <> ''""")
bind(
    "indicator_seed",
    lambda s, d: curation.seed_indicator_bridge(
        standin(s, d, "imap").filter(c("indicator_key") == "none"),
        inputs.long(s, d).select("indicator_key", F.lit("SEED").alias("specialty_category")).distinct(),
        {"tobacco_use_pct": "tobacco_pct"},
    ),
    """SELECT DISTINCT CASE WHEN indicator_key = 'tobacco_use_pct' THEN 'tobacco_pct' ELSE indicator_key END AS indicator_key,
              'SEED' AS specialty_category FROM @long""",
)
DEMO = {
    "facility_id": "demo-1", "facility_name": "Demo clinic", "operator_type_raw": "private", "operator_type": "private",
    "doctors_count": 0, "bed_count": 5, "lat": 27.33, "lon": 88.61, "coord_valid": True, "facility_type": "clinic",
    "specialties_raw": "[]", "join_confidence": "high",
}


def anchored(s, d):
    """The demonstration row added once; adding it again changes nothing."""
    once = curation.anchor_row(standin(s, d, "facility"), inputs.long(s, d), DEMO, "737101")
    twice = curation.anchor_row(once, inputs.long(s, d), DEMO, "737101")
    return rounded(twice.select("facility_id", "facility_name", "state_ut", "district_name", "pincode", "bed_count", "lat", "specialties_raw"))


bind("scenario_demo_row", anchored, """
    SELECT facility_id, facility_name, state_ut, district_name, pincode, bed_count, lat, specialties_raw FROM @facility
    UNION ALL SELECT 'demo-1', 'Demo clinic', a.state_ut, a.district_name,
        coalesce((SELECT min(pincode) FROM @facility f WHERE f.district_id = a.district_id), '737101'), 5, 27.33::DOUBLE, '[]'
    FROM (SELECT DISTINCT state_ut, district_name, district_id FROM @long ORDER BY 1, 2 LIMIT 1) a""")

# -------------------------------------------------------------- vocabulary


def vocab(s, d):
    return vocabulary.Vocabulary(
        standin(s, d, "dirty_bridge"), standin(s, d, "dirty_mapping"), standin(s, d, "facility").select("facility_id", "specialties_raw")
    )


def vocab_rows(result):
    """The rename map and the three tables it was applied to, stacked."""
    v, renames = result
    parts = [
        renames.select(F.lit("rename").alias("part"), c("raw").alias("key"), c("canonical").alias("value")),
        v.bridge.select(F.lit("bridge"), "facility_id", "specialty"),
        v.mapping.select(F.lit("mapping"), "specialties", "category"),
        v.facility.select(F.lit("facility"), "facility_id", "specialties_raw"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def vocab_sql(name: str, renames: str) -> str:
    """The same four parts from a rename relation (raw, canonical)."""
    DERIVED[f"{name}_map"] = renames
    label = f"coalesce((SELECT canonical FROM @{name}_map r WHERE r.raw = trim({{0}})), trim({{0}}))"
    DERIVED[f"{name}_bridge"] = f"""
        SELECT DISTINCT facility_id, {label.format('specialty')} AS specialty FROM @dirty_bridge WHERE {is_label('specialty')}"""
    DERIVED[f"{name}_vote"] = f"""
        SELECT {label.format('specialties')} AS specialties, category FROM @dirty_mapping WHERE {is_label('specialties')}"""
    return f"""
        SELECT 'rename' AS part, raw AS key, canonical AS value FROM @{name}_map
        UNION ALL SELECT 'bridge', facility_id, specialty FROM @{name}_bridge
        UNION ALL SELECT 'mapping', specialties, category FROM (
            SELECT specialties, category, row_number() OVER (PARTITION BY specialties ORDER BY count(*) DESC, category) AS rn
            FROM @{name}_vote GROUP BY 1, 2) v WHERE rn = 1
        UNION ALL SELECT 'facility', f.facility_id, coalesce(l.j, f.specialties_raw) FROM @facility f
            LEFT JOIN (SELECT facility_id, '["' || string_agg(DISTINCT specialty, '","' ORDER BY specialty) || '"]' AS j
                       FROM @{name}_bridge GROUP BY 1) l ON l.facility_id = f.facility_id"""


bind("clean_markup", lambda s, d: vocab_rows(vocabulary.clean_markup(vocab(s, d))), vocab_sql(
    "markup", f"SELECT raw, {strip('raw')} AS canonical FROM @label_use WHERE {strip('raw')} NOT IN (raw, '')"
))
bind("normalize_case", lambda s, d: vocab_rows(vocabulary.normalize_case(vocab(s, d))), vocab_sql(
    "case",
    "SELECT raw, (SELECT y.raw FROM @label_use y WHERE lower(y.raw) = lower(x.raw) ORDER BY y.n DESC, y.raw LIMIT 1) AS canonical FROM @label_use x",
))
DERIVED["fixed_label"] = f"""
    SELECT raw, {cleaning.rules_sql('raw')} AS fixed,
           (SELECT count(*) FROM @dirty_bridge b WHERE trim(b.specialty) = u.raw) AS n FROM @label_use u"""
APART = " OR ".join(
    f"(contains(lower(a.fixed), '{x}') AND contains(lower(b.fixed), '{y}')) OR (contains(lower(a.fixed), '{y}') AND contains(lower(b.fixed), '{x}'))"
    for x, y in cleaning.fixed.DISTINCT_SPELLINGS
)
DERIVED["near_label"] = f"""
    SELECT a.fixed AS a, b.fixed AS b, a.n AS a_n, b.n AS b_n FROM @fixed_label a JOIN @fixed_label b ON a.fixed < b.fixed
    WHERE levenshtein(replace(replace(lower(a.fixed), ' ', ''), '-', ''), replace(replace(lower(b.fixed), ' ', ''), '-', '')) = 1
      AND least(a.n, b.n) <= 20 AND greatest(a.n, b.n) >= 5 * least(a.n, b.n) AND NOT ({APART})"""
DERIVED["near_target"] = """
    SELECT fixed, target FROM (
        SELECT *, row_number() OVER (PARTITION BY fixed ORDER BY n DESC, target) AS rn FROM (
            SELECT DISTINCT CASE WHEN a_n < b_n THEN a ELSE b END AS fixed, CASE WHEN a_n < b_n THEN b ELSE a END AS target, greatest(a_n, b_n) AS n
            FROM @near_label) p) q WHERE rn = 1"""
bind("correct_typos", lambda s, d: vocab_rows(vocabulary.correct_typos(vocab(s, d))), vocab_sql(
    "typo",
    """SELECT * FROM (SELECT l.raw, coalesce(t.target, l.fixed) AS canonical FROM @fixed_label l LEFT JOIN @near_target t ON t.fixed = l.fixed) z
       WHERE raw <> canonical""",
))

# ----------------------------------------------------------------- quality


def metrics_sql(facility: str = "@facility", bridge: str = "@bridge", mapping: str = "@mapping", imap: str = "@imap") -> str:
    f = f"(SELECT count(*) FROM {facility})"

    def pct(part: str, whole: str) -> str:
        return f"100.0::DOUBLE * ({part}) / nullif({whole}, 0)"

    match = pct(f"SELECT count(district_id) FROM {facility}", f)
    high = pct(f"SELECT count(*) FROM {facility} WHERE join_confidence = 'high'", f)
    districts = "(SELECT count(DISTINCT district_id) FROM @long)"
    zero = f"(SELECT count(DISTINCT district_id) FROM @long WHERE district_id NOT IN (SELECT district_id FROM {facility} WHERE district_id IS NOT NULL))"
    unmapped = f"(SELECT count(DISTINCT specialty) FROM {bridge} WHERE specialty NOT IN (SELECT specialties FROM {mapping}))"
    orphans = f"(SELECT count(*) FROM {imap} WHERE indicator_key NOT IN (SELECT indicator_key FROM @long))"
    keys = f"(SELECT count(DISTINCT indicator_key) FROM @long WHERE indicator_key NOT IN (SELECT indicator_key FROM {imap}))"
    bare = f"(SELECT count(*) FROM {facility} WHERE facility_id NOT IN (SELECT facility_id FROM {bridge}))"
    twice = f"(SELECT count(*) - count(DISTINCT facility_id) FROM {facility})"
    rows = [
        ("facility_rows", "inventory", "Facility rows", f, "10000", "count", f"{f} BETWEEN 9500 AND 10500", "warn", "warn", "Facilities left once duplicates are merged"),
        ("facility_duplicate_ids", "facility", "Repeated facility ids", twice, "0", "count", f"{twice} = 0", "critical", "fail", "Ids that more than one facility has"),
        ("facility_district_match_pct", "facility", "Placed in a district", r(match, 1), "90", "percent", f"{match} >= 75", "warn", "warn", "Facilities whose district is known"),
        ("facility_doctors_populated_pct", "facility", "Doctors known", r(pct(f"SELECT count(doctors_count) FROM {facility}", f), 1), "NULL", "percent", "false", "warn", "warn", "Facilities with a number of doctors"),
        ("facility_beds_populated_pct", "facility", "Beds known", r(pct(f"SELECT count(bed_count) FROM {facility}", f), 1), "NULL", "percent", "false", "warn", "warn", "Facilities with a number of beds"),
        ("facility_join_high_pct", "facility", "Placed with high confidence", r(high, 1), "NULL", "percent", f"{high} >= 70", "warn", "warn", "Facilities placed by an unambiguous postal code"),
        ("health_indicator_districts", "health_indicator", "Survey districts", districts, "706", "count", "true", "warn", "warn", "Districts the survey covers"),
        ("health_indicator_populated_pct", "health_indicator", "Survey cells filled", r(pct("SELECT count(indicator_value) FROM @long", "(SELECT count(*) FROM @long)"), 1), "NULL", "percent", "true", "warn", "warn", "Survey cells that hold a number"),
        ("districts_zero_facilities", "geographic_gap", "Districts without facility", zero, "NULL", "count", "false", "warn", "warn", "Surveyed districts where no facility was placed; the source may have missed some"),
        ("districts_zero_facilities_pct", "geographic_gap", "Share of districts without facility", r(pct(f"SELECT {zero}", districts), 1), "NULL", "percent", "false", "warn", "warn", "Part of the surveyed districts where no facility was placed"),
        ("unmapped_specialties", "mapping", "Labels without category", unmapped, "0", "count", f"{unmapped} = 0", "warn", "warn", "Labels in use that have no category"),
        ("orphan_indicator_mappings", "mapping", "Categorised indicators not surveyed", orphans, "0", "count", f"{orphans} = 0", "critical", "fail", "Categorised indicators that the survey does not have"),
        ("unmapped_indicators", "mapping", "Indicators without category", keys, "0", "count", "false", "warn", "warn", "Survey indicators that count for no category"),
        ("facilities_without_specialty", "mapping", "Facilities without label", bare, "0", "count", f"{bare} = 0", "warn", "warn", "Facilities that have no label"),
    ]
    return " UNION ALL ".join(
        f"SELECT '{k}' AS metric_key, '{g}' AS metric_group, '{label}' AS metric_label, CAST({v} AS DOUBLE) AS actual_value, "
        f"CAST({e} AS DOUBLE) AS expected_value, '{u}' AS unit, CASE WHEN {ok} THEN 'good' ELSE '{bad}' END AS severity, "
        f"CASE WHEN {ok} THEN 'pass' ELSE '{st}' END AS status, '{text}' AS description"
        for k, g, label, v, e, u, ok, bad, st, text in rows
    )


bind("dq_metrics", lambda s, d: quality.ordered_metrics(quality.dq_metrics(inputs.model(s, d), inputs.now())).drop("measured_at"), metrics_sql())

GAP_COLS = "gap_id, gap_type, severity, entity_type, entity_key, entity_label, field_name, current_value, suggested_fix, fix_action"
PAYLOAD_SQL = """CASE gap_type
    WHEN 'unmapped_specialty' THEN '{"specialty":"' || entity_key || '"}'
    WHEN 'orphan_indicator_mapping' THEN '{"indicator_key":"' || entity_key || '","specialty_category":"'
         || (SELECT min(specialty_category) FROM @imap i WHERE i.indicator_key = entity_key) || '"}'
    WHEN 'unmapped_indicator' THEN '{"indicator_key":"' || entity_key || '"}'
    ELSE '{"facility_id":"' || entity_key || '","field_name":"' || field_name || '","current_value":"' || replace(current_value, '"', '\\"') || '"'
         || coalesce(',"facility_name":"' || f.facility_name || '"', '')
         || CASE WHEN gap_type = 'facility_without_specialty' THEN coalesce(',"facility_type":"' || f.facility_type || '"', '')
                 || coalesce(',"description":"' || d.description || '"', '') ELSE '' END || '}' END"""
bind("dq_gaps", lambda s, d: quality.dq_gaps(inputs.model(s, d)), f"""
    SELECT {GAP_COLS}, {PAYLOAD_SQL} AS fix_payload FROM @gaps LEFT JOIN @facility f ON f.facility_id = entity_key
    LEFT JOIN @descriptions d ON d.facility_id = entity_key""")
bind(
    "dq_gaps_open",
    lambda s, d: quality.open_gaps(inputs.prior_gaps(s, d)).drop("fix_payload", "updated_at"),
    f"SELECT {GAP_COLS}, status, resolution_notes FROM @prior WHERE status = 'open'",
)
bind(
    "dq_gaps_of_type",
    lambda s, d: quality.open_gaps(inputs.prior_gaps(s, d), "missing_pincode").select("gap_id", "entity_label"),
    "SELECT gap_id, entity_label FROM @prior WHERE status = 'open' AND gap_type = 'missing_pincode'",
)
bind(
    "gap_counts",
    lambda s, d: quality.gap_counts(inputs.prior_gaps(s, d), ["gap_type", "severity", "status"]),
    "SELECT gap_type, severity, status, count(*) AS gap_count FROM @prior GROUP BY 1, 2, 3",
)
bind(
    "open_gap_summary",
    lambda s, d: quality.gap_counts(inputs.prior_gaps(s, d), ["gap_type", "severity"], only_open=True),
    "SELECT gap_type, severity, count(*) AS open_gap_count FROM @prior WHERE status = 'open' GROUP BY 1, 2",
)

DERIVED["pin_one"] = """
    SELECT pincode, upper(trim(district)) AS dk, upper(trim(statename)) AS sk FROM (
        SELECT *, row_number() OVER (PARTITION BY pincode ORDER BY district, statename) AS rn FROM @postal) p WHERE rn = 1"""
DERIVED["located"] = """
    SELECT r.unique_id, r.specialties, p.dk, p.sk FROM @raw r
    JOIN @pin_one p ON p.pincode = TRY_CAST(nullif(regexp_replace(r.address_zipOrPostcode, '[^0-9]', '', 'g'), '') AS BIGINT)"""
DERIVED["survey_hit"] = """
    SELECT EXISTS (SELECT 1 FROM @located l WHERE l.dk = upper(trim(district_name)) AND l.sk = upper(trim(w.state_ut))) AS hit FROM @wide w"""
bind("dq_coverage", lambda s, d: scoring.dq_coverage(standin(s, d, "raw"), standin(s, d, "postal"), standin(s, d, "wide")), f"""
    SELECT facilities_total, facilities_matched_to_pincode, {r('100.0::DOUBLE * facilities_matched_to_pincode / facilities_total', 1)} AS facilities_pincode_match_pct,
           nfhs_districts_total, nfhs_districts_with_facilities,
           {r('100.0::DOUBLE * nfhs_districts_with_facilities / nfhs_districts_total', 1)} AS nfhs_districts_with_facilities_pct,
           nfhs_districts_total - nfhs_districts_with_facilities AS nfhs_districts_unmatched
    FROM (SELECT (SELECT count(*) FROM @raw) AS facilities_total, (SELECT count(DISTINCT unique_id) FROM @located) AS facilities_matched_to_pincode,
                 (SELECT count(*) FROM @survey_hit) AS nfhs_districts_total, (SELECT count(*) FROM @survey_hit WHERE hit) AS nfhs_districts_with_facilities) x""")

# ----------------------------------------------------------------- scoring

PATTERNS = ["widget", "gizmo", "hot"]


def v1(s, d):
    return scoring.gap_v1(standin(s, d, "raw"), standin(s, d, "postal"), standin(s, d, "wide"), "high_blood_sugar_pct", PATTERNS)


HIT = " OR ".join(f"contains(lower(coalesce(specialties, '')), '{p}')" for p in PATTERNS)
DERIVED["v1"] = f"""
    SELECT *, hypertension_pct / 100.0::DOUBLE - coalesce(cardiac_facilities / nullif(max(cardiac_facilities) OVER (), 0), 0) AS gap,
           quantile_cont(hypertension_pct, 0.5) OVER () AS med FROM (
        SELECT trim(w.district_name) AS district_name, trim(w.state_ut) AS state_ut, high_blood_sugar_pct AS hypertension_pct,
               coalesce(total, 0) AS total_facilities, CAST(coalesce(hits, 0) AS BIGINT) AS cardiac_facilities
        FROM @wide w LEFT JOIN (SELECT dk, sk, count(*) AS total, count(*) FILTER ({HIT}) AS hits FROM @located GROUP BY 1, 2) l
          ON l.dk = upper(trim(w.district_name)) AND l.sk = upper(trim(w.state_ut))) j"""
bind("gap_by_district_v1", lambda s, d: rounded(v1(s, d).drop("raw_gap")), f"""
    SELECT district_name, state_ut, hypertension_pct, total_facilities, cardiac_facilities, {r('gap', 4)} AS gap_score,
           CASE WHEN cardiac_facilities = 0 AND hypertension_pct > med THEN 'no_supply' WHEN {r('gap', 8)} > 0.3 THEN 'high_gap'
                WHEN {r('gap', 8)} < -0.3 THEN 'low_demand_high_supply' ELSE 'balanced' END AS gap_flag FROM @v1""")
bind("gap_top_v1", lambda s, d: rounded(scoring.gap_top(v1(s, d))), f"""
    SELECT district_name || ', ' || state_ut AS district_label, {r('gap')} AS gap_score, hypertension_pct, cardiac_facilities FROM @v1
    ORDER BY {r('gap', 8)} DESC, 1 LIMIT 15""")

CORE_COLS = """district_name, state_ut, demand_pct, households_surveyed, total_facilities, category_facilities, category_bed_capacity,
    """ + r("expected_beds") + " AS expected_beds, gap_score, desert_risk_score, gap_flag, demand_score, supply_score, confidence_score"


def table_sql(core: str) -> str:
    return f"SELECT {CORE_COLS} FROM @{core} ORDER BY desert_risk_score DESC, state_ut, district_name LIMIT 25"


bind("gap_table", lambda s, d: rounded(scoring.gap_table(inputs.core(s, d))), table_sql("core"))
bind("gap_table_all", lambda s, d: rounded(scoring.gap_table(inputs.core(s, d, "ALL"))), table_sql("core_all"))
bind("gap_table_scenario", lambda s, d: rounded(scoring.gap_table(inputs.core(s, d, with_scenario=True))), table_sql("core_scenario"))
bind("gap_core", lambda s, d: rounded(inputs.core(s, d).select(*scoring.GAP_TABLE)), f"SELECT {CORE_COLS} FROM @core")


def summary(s, d):
    """The one-row summary with its JSON list taken apart into columns."""
    row = scoring.gap_summary(inputs.core(s, d))
    items = F.from_json("top_10_high_gap_districts", "array<struct<district_name:string,gap_score:double,gap_flag:string>>")
    return row.select(*row.columns[:-1], F.posexplode(items).alias("place", "t")).select(
        *row.columns[:-1], "place", "t.district_name", "t.gap_score", "t.gap_flag"
    )


bind("gap_summary", summary, f"""
    SELECT (SELECT count(*) FROM @core) AS districts_analyzed,
           (SELECT count(*) FROM @core WHERE category_bed_capacity = 0) AS districts_with_zero_category_supply,
           {r('(SELECT quantile_cont(demand_pct, 0.5) FROM @core)', 2)} AS median_demand_pct,
           (SELECT count(*) FROM @core WHERE gap_flag IN ('high_gap', 'no_supply')) AS districts_high_gap_or_no_supply,
           CAST(row_number() OVER (ORDER BY gap_score DESC, state_ut, district_name) - 1 AS INTEGER) AS place, district_name, gap_score, gap_flag
    FROM (SELECT * FROM @core ORDER BY gap_score DESC, state_ut, district_name LIMIT 10) t""")
bind("gap_geo", lambda s, d: rounded(scoring.gap_geo(inputs.core(s, d), scoring.centroids(standin(s, d, "postal")))), f"""
    SELECT c.district_name, c.state_ut, demand_pct, households_surveyed, category_facilities, category_bed_capacity, {r('expected_beds')} AS expected_beds,
           total_facilities, {r('demand_norm')} AS demand_norm, {r('supply_norm')} AS supply_norm, balance_ratio, confidence_score, pincode_count,
           {r('latitude')} AS latitude, {r('longitude')} AS longitude
    FROM @core c JOIN @centroid g ON g.district_key = c.district_key AND g.state_key = c.state_key""")
bind(
    "scenario_impact",
    lambda s, d: rounded(scoring.scenario_impact(
        inputs.long(s, d), standin(s, d, "facility"), standin(s, d, "bridge"), inputs.mapping(s, d),
        inputs.scenario_items(standin(s, d, "scenarios"), "doc"), "high_blood_sugar_pct", "all_anaemic_pct", "ECONOMY",
    )),
    f"""SELECT district_name, state_ut, {r('p1', 2)} AS baseline_hypertension_demand_pct, {r('p1', 2)} AS scenario_hypertension_demand_pct,
               {r('p2', 2)} AS baseline_diabetes_demand_pct, {r('p2', 2)} AS scenario_diabetes_demand_pct,
               n AS baseline_facility_count, n + an AS scenario_facility_count, an AS delta_facility_count,
               k AS baseline_cardiac_facility_count, k + ak AS scenario_cardiac_facility_count, ak AS delta_cardiac_facility_count,
               b AS baseline_bed_capacity, b + ab AS scenario_bed_capacity, ab AS delta_bed_capacity,
               {r('p1 - k * 8', 2)} AS baseline_supply_demand_gap, {r('p1 - (k + ak) * 8', 2)} AS scenario_supply_demand_gap,
               {r('-8.0::DOUBLE * ak', 2)} AS delta_supply_demand_gap, {r('h', 0)} AS nfhs_households_surveyed
        FROM (SELECT a.*, p1, p2, h, coalesce(f.n, 0) AS n, CAST(coalesce(f.k, 0) AS BIGINT) AS k, CAST(coalesce(f.b, 0) AS BIGINT) AS b
              FROM (SELECT trim(district_name) AS district_name, trim(state_ut) AS state_ut, count(*) AS an,
                           count(*) FILTER (regexp_matches(lower(capability), 'cardio|cardiac|heart|cardiology')) AS ak,
                           CAST(sum(greatest(capacity, 0)) AS BIGINT) AS ab FROM @scenario_item GROUP BY 1, 2) a
              JOIN (SELECT lower(district_name) AS d, lower(state_ut) AS s, max(indicator_value) FILTER (indicator_key = 'high_blood_sugar_pct') AS p1,
                           max(indicator_value) FILTER (indicator_key = 'all_anaemic_pct') AS p2,
                           max(indicator_value) FILTER (indicator_key = 'households_surveyed') AS h FROM @long GROUP BY 1, 2) l
                ON l.d = lower(a.district_name) AND l.s = lower(a.state_ut)
              LEFT JOIN (SELECT lower(district_name) AS d, lower(state_ut) AS s, count(*) AS n, sum(coalesce(bed_count, 0)) AS b,
                                count(*) FILTER (facility_id IN (SELECT b.facility_id FROM @bridge b JOIN @mapping m ON m.specialties = b.specialty
                                                                 WHERE m.category = 'ECONOMY')) AS k
                         FROM @facility WHERE state_ut IS NOT NULL GROUP BY 1, 2) f ON f.d = l.d AND f.s = l.s) j""",
)
bind("mapping_view", lambda s, d: views.mapping_view(standin(s, d, "bridge"), standin(s, d, "facility"), inputs.mapping(s, d)), """
    SELECT b.facility_id, f.facility_name, b.specialty, m.category AS specialty_category FROM @bridge b
    LEFT JOIN @facility f ON f.facility_id = b.facility_id LEFT JOIN @mapping m ON m.specialties = b.specialty
    ORDER BY f.facility_name NULLS LAST, b.specialty, b.facility_id""")


def all_details(s, d):
    return rounded(exploration.demand_detail(inputs.long(s, d), standin(s, d, "explored_imap"), EXPLORED), 2)


DERIVED["detail"] = f"""
    SELECT district_name, state_ut, specialty_category AS category, l.indicator_key, indicator_raw, {r('indicator_value', 2)} AS demand_pct, is_suppressed
    FROM @long l JOIN @explored i ON i.indicator_key = l.indicator_key"""
bind("category_exploration", all_details, "SELECT * FROM @detail")


def one_detail(s, d):
    """The drill-down into the first district of the survey: its indicators and its ranked categories."""
    long, imap = inputs.long(s, d), standin(s, d, "explored_imap")
    first = long.agg(F.min(F.struct("state_ut", "district_name")).alias("x"))
    district, state = (first.select(f"x.{n}").scalar() for n in ("district_name", "state_ut"))
    shown = exploration.district_detail(long, imap, district, state, EXPLORED)
    own = long.filter((c("district_name") == district) & (c("state_ut") == state))
    ranks = exploration.ranked_profile(own, imap, EXPLORED).select("category", "category_rank_in_district")
    return rounded(shown.join(ranks, "category"), 2)


bind("district_detail", one_detail, """
    SELECT d.category, indicator_key, indicator_raw, demand_pct, is_suppressed, category_rank_in_district FROM @detail d
    JOIN @ranked k ON k.category = d.category AND k.district_name = d.district_name AND k.state_ut = d.state_ut
    WHERE d.state_ut = (SELECT min(state_ut) FROM @long) AND d.district_name = (SELECT min(district_name) FROM @long WHERE state_ut = (SELECT min(state_ut) FROM @long))""")
RISK_NORM = "(risk - (SELECT min(risk) FROM @risk)) / ((SELECT max(risk) FROM @risk) - (SELECT min(risk) FROM @risk))"
bind("risk_tiers", lambda s, d: rounded(scoring.risk_tiers(inputs.core(s, d))), f"""
    SELECT district_name, state_ut, {r('risk')} AS desert_risk, {r('n')} AS desert_risk_norm,
           CASE WHEN category_bed_capacity = 0 THEN 'no_supply' WHEN {r('n', 8)} >= 0.66 THEN 'high' WHEN {r('n', 8)} >= 0.33 THEN 'moderate' ELSE 'low' END AS risk_tier,
           CASE WHEN confidence_score >= 0.75 THEN 'high' WHEN confidence_score >= 0.5 THEN 'medium' ELSE 'low' END AS confidence_level
    FROM (SELECT *, {RISK_NORM} AS n FROM @risk) x""")
DERIVED["change"] = """
    SELECT s.district_name, s.state_ut, b.category_bed_capacity AS bb, s.category_bed_capacity AS sb,
           (b.risk - lo) / (hi - lo) AS bn, (s.demand_norm * (1 - s.supply_norm) - lo) / (hi - lo) AS sn
    FROM @core_scenario s JOIN @risk b ON b.district_name = s.district_name AND b.state_ut = s.state_ut
    CROSS JOIN (SELECT min(risk) AS lo, max(risk) AS hi FROM @risk) g"""


def compared(s, d):
    return scoring.scenario_delta(inputs.state(s, d), inputs.scenario(s, d))


bind("scenario_compare", lambda s, d: rounded(compared(s, d)), f"""
    SELECT district_name, state_ut, bb AS baseline_beds, sb AS scenario_beds, sb - bb AS delta_beds, {r('bn')} AS baseline_risk_norm,
           {r('sn')} AS scenario_risk_norm, {r('sn - bn')} AS delta_risk FROM @change""")
bind("delta_extent", lambda s, d: rounded(scoring.delta_extent(compared(s, d))), f"""
    SELECT {r('-m')} AS min_extent, {r('m')} AS max_extent FROM (
        SELECT CASE WHEN max(abs(sn - bn)) > 1e-9 THEN greatest(0.85::DOUBLE * max(abs(sn - bn)), 0.001) ELSE 0.01 END AS m FROM @change) x""")
bind("summary_cards", lambda s, d: scoring.summary_cards(inputs.core(s, d), inputs.core(s, d, with_scenario=True)), """
    SELECT card, baseline, scenario, scenario - baseline AS delta,
           CASE WHEN scenario <> baseline THEN (scenario < baseline) = (card <> 'total_beds') END AS improved FROM (
        SELECT 'total_beds' AS card, CAST((SELECT sum(category_bed_capacity) FROM @core) AS BIGINT) AS baseline,
               CAST((SELECT sum(category_bed_capacity) FROM @core_scenario) AS BIGINT) AS scenario
        UNION ALL SELECT 'zero_supply_districts', (SELECT count(*) FROM @core WHERE category_bed_capacity = 0),
                         (SELECT count(*) FROM @core_scenario WHERE category_bed_capacity = 0)
        UNION ALL SELECT 'high_risk_districts', (SELECT count(*) FROM @core WHERE gap_flag IN ('high_gap', 'no_supply')),
                         (SELECT count(*) FROM @core_scenario WHERE gap_flag IN ('high_gap', 'no_supply'))) x""")


def profiled(s, d):
    """Needs as text; only districts with high or medium confidence show measures."""
    ranked = exploration.demand_ranked(inputs.long(s, d), standin(s, d, "imap"))
    rows = exploration.district_profile(ranked, inputs.core(s, d), ["high", "medium"])
    needs = F.array_join(F.transform("ranked_needs", lambda x: F.concat_ws(":", x["category_rank_in_district"], x["category"])), ",")
    return rounded(rows.withColumn("ranked_needs", needs))


DERIVED["need_list"] = """
    SELECT district_name, state_ut, string_agg(category_rank_in_district || ':' || category, ',' ORDER BY category_rank_in_district) AS needs FROM @need GROUP BY 1, 2"""
bind("district_profile", profiled, f"""
    SELECT upper(coalesce(n.district_name, g.district_name)) || '__' || upper(coalesce(n.state_ut, g.state_ut)) AS region_key,
           coalesce(n.district_name, g.district_name) AS district_name, coalesce(n.state_ut, g.state_ut) AS state_ut, coalesce(needs, '') AS ranked_needs,
           {r('risk')} AS desert_risk, {r('norm')} AS desert_risk_norm, category_facilities, category_bed_capacity, {r('expected_beds')} AS expected_beds, confidence_score
    FROM @need_list n FULL JOIN (SELECT * FROM (SELECT *, {RISK_NORM} AS norm FROM @risk) x WHERE confidence_score >= 0.5) g
      ON g.district_name = n.district_name AND g.state_ut = n.state_ut""")


def map_features(s, d):
    """Features of a map: places of suppliers, some without a district."""
    geo = standin(s, d, "nation").join(standin(s, d, "region"), c("n_regionkey") == c("r_regionkey"))
    rows = standin(s, d, "supplier").join(geo, c("s_nationkey") == c("n_nationkey"))
    return rows.select(
        F.when(c("s_acctbal") < 0, " ").when(c("s_acctbal") > 8000, F.concat("n_name", F.lit(" Harbour")))
        .otherwise(F.concat(F.lower("n_name"), F.lit("  civil."))).alias("district"),
        F.lower("r_name").alias("state"),
    )


bind("region_match", lambda s, d: exploration.region_match(map_features(s, d), inputs.core(s, d)), """
    SELECT coalesce(f.k, g.k) AS region_key, CASE WHEN g.k IS NULL THEN 'feature_only' WHEN f.k IS NULL THEN 'district_only' ELSE 'matched' END AS side
    FROM (SELECT DISTINCT upper(n_name) || CASE WHEN s_acctbal > 8000 THEN ' HARBOUR' ELSE ' CIVIL' END || '__' || r_name AS k
          FROM @supplier JOIN @nation ON s_nationkey = n_nationkey JOIN @region ON n_regionkey = r_regionkey WHERE s_acctbal >= 0) f
    FULL JOIN (SELECT upper(district_name) || '__' || upper(state_ut) AS k FROM @core) g ON f.k = g.k""")

# --------------------------------------------------------------- inference


def missing_docs(s, d):
    return standin(s, d, "unlabelled").select(
        "doc_id", inference.facility_context(c("source"), c("lang"), c("text")).alias("context_text")
    )


def doc_labels(s, d):
    return standin(s, d, "documents").select(F.concat_ws(" ", "source", "lang").alias("label"))


def inferred(s, d):
    found = inference.infer_labels(missing_docs(s, d), doc_labels(s, d), "doc_id")
    return found.select("doc_id", F.md5("context_text").alias("context_md5"), "inferred_label")


WORDS = "SELECT DISTINCT {k}, unnest(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM {t}"
DERIVED["doc_context"] = f"SELECT doc_id, {cleaning.CONTEXT_SQL.format('source', 'lang', 'text')} AS x FROM @unlabelled"
DERIVED["doc_label"] = "SELECT DISTINCT source || ' ' || lang AS label FROM @documents"
DERIVED["label_hit"] = f"""
    SELECT c.doc_id, l.label, row_number() OVER (PARTITION BY c.doc_id ORDER BY count(*) DESC, l.label) AS rn
    FROM ({WORDS.format(k='doc_id', x='x', t='@doc_context')}) c JOIN ({WORDS.format(k='label', x='label', t='@doc_label')}) l ON l.w = c.w
    WHERE c.w <> '' GROUP BY 1, 2"""
bind("infer_labels", inferred, """
    SELECT c.doc_id, md5(c.x) AS context_md5, h.label AS inferred_label FROM @doc_context c
    LEFT JOIN (SELECT * FROM @label_hit WHERE rn = 1) h ON h.doc_id = c.doc_id""")


def written_back(s, d):
    """Inferred labels as corrections laid over the facilities that lack one."""
    m = inputs.model(s, d)
    bare = quality.missing_labels(m).select(
        "facility_id", inference.facility_context(c("facility_name"), c("facility_type"), c("description")).alias("context_text")
    )
    labels = standin(s, d, "nation").select(F.lower(F.concat_ws(" ", "n_name", F.lit("clinic"))).alias("label"))
    found = inference.infer_labels(bare, labels, "facility_id")
    fix = inference.corrections_from_labels(found, "facility_id", inputs.now())
    return overlay(m.facility, fix, "facility_id", ["specialties_raw"]).select("facility_id", "specialties_raw")


DERIVED["bare"] = f"""
    SELECT f.facility_id, {cleaning.CONTEXT_SQL.format('facility_name', 'facility_type', 'description')} AS x FROM @facility f
    LEFT JOIN @descriptions d ON d.facility_id = f.facility_id WHERE f.facility_id NOT IN (SELECT facility_id FROM @bridge)"""
DERIVED["nation_label"] = "SELECT DISTINCT lower(n_name) || ' clinic' AS label FROM @nation"
bind("inference_writeback", written_back, f"""
    SELECT f.facility_id, coalesce('["' || h.label || '"]', f.specialties_raw) AS specialties_raw FROM @facility f LEFT JOIN (
        SELECT c.facility_id, l.label, row_number() OVER (PARTITION BY c.facility_id ORDER BY count(*) DESC, l.label) AS rn
        FROM ({WORDS.format(k='facility_id', x='x', t='@bare')}) c JOIN ({WORDS.format(k='label', x='label', t='@nation_label')}) l ON l.w = c.w
        WHERE c.w <> '' GROUP BY 1, 2) h ON h.facility_id = f.facility_id AND h.rn = 1""")


def suggested(s, d):
    """Languages as labels for documents without one; documents that name none
    are asked about, and the answer stands in for a model's."""
    labels = standin(s, d, "documents").where("lang <> 'en'").select(F.concat("lang", F.lit(" archive")).alias("label")).distinct()
    answer = lambda p: F.concat(F.lit("```text\n"), F.element_at(F.array(*map(F.lit, ("maybe the DE ARCHIVE", "none of them", "FR archive"))), (F.length(p) % 3 + 1).cast("int")), F.lit("\n```"))
    found = inference.suggest_labels(missing_docs(s, d), labels, "doc_id", answer)
    return found.select("doc_id", F.md5("context_text").alias("context_md5"), "suggested_label", "source")


DERIVED["lang_label"] = "SELECT DISTINCT lang || ' archive' AS label FROM @documents WHERE lang <> 'en'"
DERIVED["lang_hit"] = f"""
    SELECT c.doc_id, l.label, row_number() OVER (PARTITION BY c.doc_id ORDER BY count(*) DESC, l.label) AS rn
    FROM ({WORDS.format(k='doc_id', x='x', t='@doc_context')}) c JOIN ({WORDS.format(k='label', x='label', t='@lang_label')}) l ON l.w = c.w
    WHERE c.w <> '' GROUP BY 1, 2"""
DERIVED["lang_prompt"] = "SELECT '" + inference.PROMPT_HEAD.replace("\n", "' || chr(10) || '") + f"""' || chr(10) || string_agg(label, ', ' ORDER BY label) || chr(10) || chr(10)
    || '{inference.PROMPT_RECORD}' || chr(10) AS head FROM @lang_label"""
DERIVED["asked_model"] = """
    SELECT doc_id, x, ['maybe the DE ARCHIVE', 'none of them', 'FR archive'][CAST(length(head || x) % 3 AS INTEGER) + 1] AS said FROM @doc_context, @lang_prompt"""
bind("suggest_labels", suggested, """
    SELECT a.doc_id, md5(a.x) AS context_md5, coalesce(h.label, (SELECT min(label) FROM @lang_label l WHERE lower(a.said) = lower(l.label)),
               (SELECT min(label) FROM @lang_label l WHERE contains(lower(a.said), lower(l.label))), a.said) AS suggested_label,
           CASE WHEN h.label IS NULL THEN 'query' ELSE 'classify' END AS source
    FROM @asked_model a LEFT JOIN (SELECT * FROM @lang_hit WHERE rn = 1) h ON h.doc_id = a.doc_id""")


def parsed(s, d):
    """Survey values as they are parsed, each under both names that a caller may use."""
    rows = standin(s, d, "wide").select("district_name", numbers.suppressed_number(c("births_csection_pct")).alias("b"))
    value, suppressed = c("b.value"), c("b.suppressed")
    return rows.select("district_name", value.alias("udf_value"), suppressed.alias("udf_suppressed"), value.alias("value"), suppressed.alias("suppressed"))


VALUE_SQL = "TRY_CAST(replace(replace(nullif(trim(births_csection_pct), '*'), '(', ''), ')', '') AS DOUBLE)"
bind("udf_parse", parsed, f"""
    SELECT district_name, {VALUE_SQL} AS udf_value, trim(births_csection_pct) = '*' AS udf_suppressed,
           {VALUE_SQL} AS value, trim(births_csection_pct) = '*' AS suppressed FROM @wide""")
TOPICS = ("nation_1 ", "nation_2 ", "machinery", "furniture")



def topic_model():
    """Loader of a classifier that names the first topic a text holds. Functions
    within travel to the tasks by value, so they need not have this package."""

    def load():
        def first_named(texts, labels):
            return [next((x for x in labels if x in t), None) for t in texts]

        return first_named

    return load


bind(
    "udf_classify",
    lambda s, d: standin(s, d, "raw").select(
        "unique_id", inference.classify_udf(topic_model(), TOPICS, "first topic")(F.lower("description")).alias("label")
    ),
    "SELECT unique_id, CASE " + " ".join(f"WHEN contains(lower(description), '{t}') THEN '{t}'" for t in TOPICS) + " END AS label FROM @raw",
)


def asked(s, d):
    """Prompt per facility lacking a label, and the reading of a made-up answer."""
    bare = missing_docs(s, d)
    labels = F.array(*[F.lit(x) for x in ("src1 en", "src1", "src2 de")])
    answer = F.concat(F.lit("```text\nIt is SRC"), (c("doc_id") % 4).cast("string"), F.lit("\n```"))
    return bare.select(
        "doc_id", F.md5(inference.prompt(c("context_text"), labels)).alias("prompt_md5"), inference.parse_answer(answer, labels).alias("label")
    )


PROMPT_SQL = "'" + inference.PROMPT_HEAD.replace("\n", "' || chr(10) || '") + "' || chr(10) || 'src1 en, src1, src2 de' || chr(10) || chr(10) || '" + inference.PROMPT_RECORD + "' || chr(10) || x"
bind("udf_query", asked, f"""
    SELECT doc_id, md5({PROMPT_SQL}) AS prompt_md5, CASE WHEN doc_id % 4 = 1 THEN 'src1' ELSE 'It is SRC' || (doc_id % 4) END AS label FROM @doc_context""")

