"""Sources, cleaning functions and row filters on the synthetic tables."""

from __future__ import annotations

import calendar

from pyspark.sql import functions as F

from gapwright.bindings import inputs
from gapwright.bindings.catalog import bind, is_label, r, rounded, strip
from gapwright.bindings.standins import standin
from gapwright.functions import fixed, jsontext, keys, numbers, text
from gapwright.operators import filters, reshape, upsert
from gapwright.plans import curation, inference, quality
from gapwright.sources import params

c = F.col

# ------------------------------------------------------------------ sources

# a plan for each month: what is to be sold and spent, and to how many customers
MONTHLY_PLAN = [(calendar.month_name[n], n, 10_000 + 500 * n, 6_000 + 400 * n, 100 + n * n) for n in range(1, 13)]
MONTHS_SQL = ", ".join(f"('{m}', {n}, {a}, {b}, {k})" for m, n, a, b, k in MONTHLY_PLAN)


def monthly_sales(spark, d, last=9):
    """Literal monthly figures up to a month, next to the orders of that month."""
    months = params.inline_values(
        spark, MONTHLY_PLAN, "month string, month_num int, revenue int, expenses int, customers int",
        c("month_num") <= F.lit(last),
    )
    orders = standin(spark, d, "orders").groupBy(F.month("o_orderdate").alias("month_num")).agg(
        F.count(F.lit(1)).alias("order_count"), F.sum("o_totalprice").alias("order_value")
    )
    return rounded(orders.join(F.broadcast(months), "month_num"), 2)


bind("inline_values", monthly_sales, f"""
    SELECT m.*, o.order_count, {r('o.order_value', 2)} AS order_value
    FROM (VALUES {MONTHS_SQL}) m(month, month_num, revenue, expenses, customers)
    JOIN (SELECT month(o_orderdate) AS month_num, count(*) AS order_count, sum(o_totalprice) AS order_value FROM @orders GROUP BY 1) o
      ON o.month_num = m.month_num WHERE m.month_num <= 9""")

bind(
    "param_echo",
    lambda s, d: params.run_sql(
        s,
        "SELECT :message AS message, o_orderpriority, count(*) AS order_count FROM {orders} "
        "WHERE o_totalprice >= :least AND coalesce(:run, '') = coalesce(:run, '') GROUP BY o_orderpriority",
        {"message": "hello", "least": 250000.0, "run": "7"},
        orders=standin(s, d, "orders"),
    ),
    """SELECT 'hello' AS message, o_orderpriority, count(*) AS order_count FROM @orders
       WHERE o_totalprice >= 250000.0 GROUP BY o_orderpriority""",
)

bind("scenario_rows", inputs.scenario, "SELECT * FROM @scenario_row")


def strict_scenario(s, d):
    items = params.scenario_items(standin(s, d, "scenarios"), "doc")
    return params.scenario_rows(items, standin(s, d, "part").select("p_name"))


bind("scenario_rows_strict", strict_scenario, """
    SELECT district_key, state_key, capability, capacity,
           CASE WHEN EXISTS (SELECT 1 FROM @part WHERE contains(lower(capability), lower(p_name))) THEN 1 ELSE 0 END AS is_match
    FROM @scenario_row""")

bind(
    "json_array_explode",
    lambda s, d: reshape.explode_json_list(standin(s, d, "raw"), "specialties", "item").select("unique_id", "item"),
    """SELECT unique_id, unnest(from_json(specialties, '["VARCHAR"]')) AS item FROM @raw WHERE specialties LIKE '[%'""",
)


def seeded(s, d):
    """A filled table keeps its rows, an empty one takes the seed."""
    imap = standin(s, d, "imap")
    seed = inputs.long(s, d).select("indicator_key", F.lit("SEED").alias("specialty_category")).distinct()
    kept = upsert.seed_if_empty(imap, seed).withColumn("case", F.lit("filled"))
    taken = upsert.seed_if_empty(imap.filter(c("specialty_category") == "NONE"), seed).withColumn("case", F.lit("empty"))
    return kept.unionByName(taken)


bind("seed_if_empty", seeded, """
    SELECT *, 'filled' AS "case" FROM @imap UNION ALL SELECT DISTINCT indicator_key, 'SEED', 'empty' FROM @long""")


def counted(s, d):
    m = inputs.model(s, d)
    return reshape.table_counts({
        "facility": m.facility, "health_indicator": m.long, "specialty_category_mapping": m.mapping,
        "facility_specialty": m.bridge, "health_indicator_specialty": m.indicator_bridge,
        "dq_metrics": quality.dq_metrics(m, inputs.now()), "dq_gap": quality.dq_gaps(m),
    })


bind("table_counts", counted, """
    SELECT 'facility' AS table_name, count(*) AS row_count FROM @facility
    UNION ALL SELECT 'health_indicator', count(*) FROM @long
    UNION ALL SELECT 'specialty_category_mapping', count(*) FROM @mapping
    UNION ALL SELECT 'facility_specialty', count(*) FROM @bridge
    UNION ALL SELECT 'health_indicator_specialty', count(*) FROM @imap
    UNION ALL SELECT 'dq_metrics', 14
    UNION ALL SELECT 'dq_gap', count(*) FROM @gaps""")

bind(
    "dq_counts",
    lambda s, d: quality.dq_counts(quality.dq_metrics(inputs.model(s, d), inputs.now()), inputs.prior_gaps(s, d)),
    """SELECT CAST(14 AS BIGINT) AS metric_count, count(*) FILTER (status = 'open') AS open_gaps,
              count(*) FILTER (status = 'dismissed') AS dismissed_gaps FROM @prior""",
)

# ----------------------------------------------------------------- cleaning


def projected(source, /, **cols):
    """A query that shows some columns of a stand-in and computed ones."""
    return lambda s, d: standin(s, d, source).select(*[e().alias(n) for n, e in cols.items()])


bind(
    "null_tokens",
    projected("raw", unique_id=lambda: c("unique_id"), name=lambda: text.nullify(c("name")), beds=lambda: text.nullify(c("capacity"))),
    "SELECT unique_id, nullif(nullif(trim(name), ''), 'null') AS name, nullif(nullif(trim(capacity), ''), 'null') AS beds FROM @raw",
)

RAW_COLUMNS = (
    "unique_id", "name", "description", "cluster_id", "address_stateOrRegion", "address_city", "address_zipOrPostcode",
    "operatorTypeId", "facilityTypeId", "numberDoctors", "capacity", "latitude", "longitude", "specialties",
)


def _filled(col: str) -> str:
    return f"CASE WHEN nullif(nullif(trim(CAST({col} AS VARCHAR)), ''), 'null') IS NOT NULL THEN 1 ELSE 0 END"


NOT_SPARSE = " + ".join(_filled(x) for x in RAW_COLUMNS) + " >= 2"
COMPLETE = " + ".join(
    ["CASE WHEN trim(name) <> '' THEN 1 ELSE 0 END"]
    + [_filled(x) for x in ("operatorTypeId", "numberDoctors", "capacity", "address_zipOrPostcode", "specialties")]
    + [f"CASE WHEN {x} IS NOT NULL THEN 1 ELSE 0 END" for x in ("latitude", "longitude")]
)

bind(
    "sparse_row_filter",
    lambda s, d: filters.drop_sparse(standin(s, d, "raw")).select("unique_id", "name", "specialties"),
    f"SELECT unique_id, name, specialties FROM @raw WHERE {NOT_SPARSE}",
)
bind(
    "completeness_score",
    lambda s, d: standin(s, d, "raw").select("unique_id", "name", curation.completeness().alias("score")),
    f"SELECT unique_id, name, {COMPLETE} AS score FROM @raw",
)
UUID_SQL = f"regexp_full_match(trim(unique_id), '{text.UUID_PATTERN[1:-1]}')"
bind(
    "id_format_filter",
    lambda s, d: standin(s, d, "raw").filter(text.valid_id(c("unique_id"))).select("unique_id", "name"),
    f"SELECT unique_id, name FROM @raw WHERE {UUID_SQL}",
)


def postal_sql(x: str) -> str:
    digits = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    return f"CASE WHEN regexp_full_match({digits}, '[1-9][0-9]{{5}}') THEN {digits} END"


bind(
    "postal_code",
    projected("raw", unique_id=lambda: c("unique_id"), given=lambda: c("address_zipOrPostcode"), pincode=lambda: numbers.postal_code(c("address_zipOrPostcode"))),
    f"SELECT unique_id, address_zipOrPostcode AS given, {postal_sql('address_zipOrPostcode')} AS pincode FROM @raw",
)

OPERATOR_SQL = """CASE lower(trim(operatorTypeId)) WHEN 'public' THEN 'public' WHEN 'government' THEN 'public'
    WHEN 'private' THEN 'private' ELSE 'unknown' END"""
bind(
    "standardize_enum",
    projected(
        "raw", unique_id=lambda: c("unique_id"), given=lambda: c("operatorTypeId"),
        operator_type=lambda: text.standardize_enum(c("operatorTypeId"), fixed.OPERATOR_TYPES, "unknown"),
    ),
    f"SELECT unique_id, operatorTypeId AS given, {OPERATOR_SQL} AS operator_type FROM @raw",
)


def int_sql(x: str) -> str:
    kept = f"regexp_replace({x}, '[^0-9.]', '', 'g')"
    return f"CASE WHEN regexp_full_match({kept}, '[0-9]+') THEN CAST({kept} AS INTEGER) END"


bind(
    "extract_int",
    projected(
        "raw", unique_id=lambda: c("unique_id"), doctors=lambda: numbers.extract_int(c("numberDoctors")),
        beds=lambda: numbers.extract_int(c("capacity")),
    ),
    f"SELECT unique_id, {int_sql('numberDoctors')} AS doctors, {int_sql('capacity')} AS beds FROM @raw",
)

STRAIGHT = "coalesce(latitude BETWEEN 6 AND 38 AND longitude BETWEEN 68 AND 98, false)"
SWAPPED = "coalesce(longitude BETWEEN 6 AND 38 AND latitude BETWEEN 68 AND 98, false)"
LAT_SQL = f"CASE WHEN {STRAIGHT} THEN latitude WHEN {SWAPPED} THEN longitude END"
LON_SQL = f"CASE WHEN {STRAIGHT} THEN longitude WHEN {SWAPPED} THEN latitude END"
bind(
    "coord_repair",
    lambda s, d: standin(s, d, "raw").select("unique_id", numbers.coord_repair(c("latitude"), c("longitude")).alias("p")).select("unique_id", "p.*"),
    f"SELECT unique_id, {LAT_SQL} AS lat, {LON_SQL} AS lon, {STRAIGHT} OR {SWAPPED} AS valid FROM @raw",
)
bind(
    "suppressed_number",
    lambda s, d: standin(s, d, "wide").select(
        "district_name", c("w15_with_high_bp_pct").alias("given"), numbers.suppressed_number(c("w15_with_high_bp_pct")).alias("n")
    ).select("district_name", "given", "n.*"),
    """SELECT district_name, w15_with_high_bp_pct AS given, trim(w15_with_high_bp_pct) = '*' AS suppressed,
              TRY_CAST(replace(replace(nullif(trim(w15_with_high_bp_pct), '*'), '(', ''), ')', '') AS DOUBLE) AS value FROM @wide""",
)


def resolved(s, d):
    return curation.resolved_rows(standin(s, d, "raw"), inputs.directory(s, d), inputs.states(s, d), inputs.places(s, d))


bind("strip_markup", lambda s, d: standin(s, d, "dirty_label").select("p_partkey", text.strip_markup(c("label")).alias("label")),
     f"SELECT p_partkey, {strip('label')} AS label FROM @dirty_label")


def rules_sql(x: str) -> str:
    for pattern, new in fixed.SPELLING_RULES:
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return x


bind("regex_corrections", lambda s, d: standin(s, d, "dirty_label").select("p_partkey", text.apply_rules(c("label"), fixed.SPELLING_RULES).alias("label")),
     f"SELECT p_partkey, {rules_sql('label')} AS label FROM @dirty_label")


def pairs(s, d):
    part = standin(s, d, "part")
    shown = F.when(c("p_size") % 2 == 0, F.concat(F.lit('{"'), "p_name", F.lit('": "'), "p_name", F.lit('"}'))).otherwise(
        F.concat(F.lit('{"'), "p_name", F.lit('": "'), "p_brand", F.lit('"}'))
    )
    return part.select("p_partkey", jsontext.unwrap_json_pair(shown).alias("label"))


bind("unwrap_json_pair", pairs, """
    SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '{"' || p_name || '": "' || p_brand || '"}' END AS label FROM @part""")


def no_garbage(s, d):
    labels = standin(s, d, "dirty_label").select(c("p_partkey").alias("k"), "label")
    props = standin(s, d, "events").select(
        c("event_id").alias("k"), F.when(c("event_type") == "view", c("props")).otherwise(c("event_type")).alias("label")
    )
    return filters.drop_json_garbage(labels.unionByName(props), "label")


bind("drop_json_garbage", no_garbage, f"""
    SELECT * FROM (SELECT p_partkey AS k, label FROM @dirty_label
                   UNION ALL SELECT event_id, CASE WHEN event_type = 'view' THEN props ELSE event_type END FROM @events) x
    WHERE {is_label('label')}""")


def classify_sql(x: str, rules, default: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{cat.replace(chr(39), chr(39) * 2)}'" for p, cat in rules)
    return f"CASE {whens} ELSE '{default}' END"


bind(
    "keyword_category",
    lambda s, d: standin(s, d, "documents").select("doc_id", text.classify(c("text"), fixed.LABEL_CATEGORY_RULES, fixed.DEFAULT_CATEGORY).alias("category")),
    f"SELECT doc_id, {classify_sql('lower(text)', fixed.LABEL_CATEGORY_RULES, fixed.DEFAULT_CATEGORY)} AS category FROM @documents",
)
bind(
    "indicator_category",
    lambda s, d: inputs.long(s, d).select("indicator_key").distinct().select(
        "indicator_key", text.classify(c("indicator_key"), fixed.INDICATOR_CATEGORY_RULES, fixed.DEFAULT_CATEGORY).alias("category")
    ),
    f"""SELECT indicator_key, {classify_sql('indicator_key', fixed.INDICATOR_CATEGORY_RULES, fixed.DEFAULT_CATEGORY)} AS category
        FROM (SELECT DISTINCT indicator_key FROM @long) k""",
)

D_ALIAS = {"NATION 3 CIVIL": "NATION THREE CIVIL", "NATION 7 CIVIL": "NATION SEVEN CIVIL"}
S_ALIAS = {"MIDDLE EAST": "NEAR EAST"}


def dotted(s, d):
    """Districts written with dots and extra blanks, states with AND."""
    return standin(s, d, "facility").select(
        "facility_id",
        F.concat(F.lit(" "), F.regexp_replace("district_name", "_", ".  ")).alias("district"),
        F.concat(F.lower("state_ut_raw"), F.lit("  and  ISLES ")).alias("isles"),
        F.lower("state_ut_raw").alias("state"),
    )


bind(
    "region_key",
    lambda s, d: dotted(s, d).select(
        "facility_id",
        keys.region_key(c("district"), c("state"), D_ALIAS, S_ALIAS).alias("region_key"),
        keys.state_key(c("isles")).alias("isles_key"),
    ),
    """SELECT facility_id, replace(replace(d, 'NATION 3 CIVIL', 'NATION THREE CIVIL'), 'NATION 7 CIVIL', 'NATION SEVEN CIVIL')
              || '__' || CASE WHEN s = 'MIDDLE EAST' THEN 'NEAR EAST' ELSE s END AS region_key, s || ' & ISLES' AS isles_key
       FROM (SELECT facility_id, upper(replace(district_name, '_', ' ')) AS d, upper(state_ut_raw) AS s FROM @facility) x""",
)
bind(
    "region_label",
    lambda s, d: dotted(s, d).select(
        "facility_id", keys.region_label(F.concat(keys.district_key(c("district")), F.lit(" OF NCT__"), keys.state_key(c("state")))).alias("l")
    ).select("facility_id", "l.*"),
    """SELECT facility_id, list_aggregate(list_transform(string_split(lower(replace(district_name, '_', ' ')), ' '),
                  lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') || ' of NCT' AS district,
              list_aggregate(list_transform(string_split(lower(state_ut_raw), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS state
       FROM @facility""",
)
bind(
    "normalize_quotes",
    lambda s, d: standin(s, d, "part").select("p_partkey", text.normalize_quotes(F.concat(F.lit(" "), c("p_type"), F.lit("’s "), c("p_name"))).alias("label")),
    "SELECT p_partkey, p_type || '''s ' || p_name AS label FROM @part",
)
bind(
    "surrogate_key",
    lambda s, d: standin(s, d, "facility").select("facility_id", keys.surrogate_key(c("district_name"), c("state_ut"), c("facility_name")).alias("id")),
    "SELECT facility_id, md5(concat_ws('|', district_name, state_ut, facility_name)) AS id FROM @facility",
)
bind(
    "label_fallback",
    lambda s, d: standin(s, d, "unlabelled").select(
        "doc_id", text.label_fallback(F.when(c("lang") == "en", F.lit(" null ")).when(c("lang") == "de", c("source")), c("text"), c("doc_id").cast("string")).alias("label")
    ),
    """SELECT doc_id, CASE WHEN lang = 'de' THEN source
              ELSE coalesce(nullif(trim(text), ''), CAST(doc_id AS VARCHAR)) END AS label FROM @unlabelled""",
)
NEEDLES = ["thing", "onth", "eaux", "ción", "ung"]
bind(
    "substring_flag",
    lambda s, d: standin(s, d, "documents").select("doc_id", text.any_substring(c("text"), NEEDLES).alias("flag")),
    "SELECT doc_id, CASE WHEN " + " OR ".join(f"contains(lower(text), '{n}')" for n in NEEDLES) + " THEN 1 ELSE 0 END AS flag FROM @documents",
)


def payloads(s, d):
    """Payloads built with a field left out where NULL, then read back."""
    built = standin(s, d, "facility").select(
        "facility_id",
        jsontext.payload(facility_id=c("facility_id"), facility_name=c("facility_name"), facility_type=c("facility_type")).alias("p"),
    )
    back = jsontext.parse_payload(c("p"))
    return built.select(
        "facility_id", "p", F.size(back).alias("fields"), F.try_element_at(back, F.lit("facility_name")).alias("name_back")
    )


bind("payload_json", payloads, """
    SELECT facility_id, '{"facility_id":"' || facility_id || '"' || coalesce(',"facility_name":"' || facility_name || '"', '')
              || coalesce(',"facility_type":"' || facility_type || '"', '') || '}' AS p,
           1 + CASE WHEN facility_name IS NULL THEN 0 ELSE 1 END + CASE WHEN facility_type IS NULL THEN 0 ELSE 1 END AS fields,
           facility_name AS name_back FROM @facility""")

CONTEXT_SQL = """'Facility name:' || chr(10) || coalesce(nullif(nullif(trim({0}), ''), 'null'), 'Unknown') || chr(10) || 'Facility type:'
    || chr(10) || coalesce(nullif(nullif(trim({1}), ''), 'null'), 'unknown') || chr(10) || 'Description:' || chr(10) || coalesce(nullif(trim({2}), ''), 'none')"""
bind(
    "context_text",
    lambda s, d: standin(s, d, "unlabelled").select("doc_id", F.md5(inference.facility_context(c("source"), c("lang"), c("text"))).alias("context_md5")),
    f"SELECT doc_id, md5({CONTEXT_SQL.format('source', 'lang', 'text')}) AS context_md5 FROM @unlabelled",
)

# edits: normalised value and error, as the rules say them
EDIT_LIST = f"""CASE WHEN g = '' THEN '[]' WHEN g LIKE '[%' THEN g ELSE '[' || coalesce(list_aggregate(list_transform(
    list_filter(list_transform(string_split(g, ','), lambda x: {strip('x')}), lambda x: x <> ''), lambda x: '"' || x || '"'), 'string_agg', ','), '') || ']' END"""
CHECKED_SQL = f"""
    SELECT edit_id, made_at, facility_id, field_name, value,
           CASE WHEN field_name NOT IN ('facility_name', 'pincode', 'operator_type', 'facility_type', 'doctors_count', 'bed_count',
                                        'specialties_raw', 'state_ut', 'district_name') THEN 'field cannot be edited: ' || field_name
                WHEN field_name = 'operator_type' AND value NOT IN ('public', 'private', 'unknown') THEN 'operator_type is none of the choices'
                WHEN field_name = 'pincode' AND NOT regexp_full_match(value, '[1-9][0-9]{{5}}') THEN 'pincode is not six digits'
                WHEN field_name = 'bed_count' AND value IS NULL THEN 'bed_count is no whole number'
                WHEN field_name = 'facility_name' AND value = '' THEN 'facility_name is blank'
                WHEN field_name = 'specialties_raw' AND value = '[]' THEN 'no specialty given' END AS error
    FROM (SELECT *, CASE WHEN field_name = 'specialties_raw' THEN {EDIT_LIST}
                         WHEN field_name = 'bed_count' THEN CAST(TRY_CAST(nullif(regexp_extract(g, '^([+-]?[0-9]+)', 1), '') AS BIGINT) AS VARCHAR)
                         ELSE g END AS value
          FROM (SELECT *, trim(corrected_value) AS g FROM @edits) e) v"""
from gapwright.bindings.catalog import DERIVED  # noqa: E402

DERIVED["checked_edit"] = CHECKED_SQL


def validated(s, d):
    ok, bad = quality.validate_edits(standin(s, d, "edits"))
    cols = ["edit_id", "facility_id", "field_name", "value"]
    return ok.select(*cols, F.lit(None).cast("string").alias("error")).unionByName(bad.select(*cols, "error"))


bind("edit_validate", validated, "SELECT edit_id, facility_id, field_name, value, error FROM @checked_edit")


def label_input(s, d):
    given = standin(s, d, "edits").filter(c("field_name") == "specialties_raw")
    listed = jsontext.text_to_list(c("corrected_value"))
    return given.select("edit_id", listed.alias("as_list"), jsontext.list_text(listed).alias("as_text"))


bind("specialty_input", label_input, f"""
    SELECT edit_id, as_list, replace(replace(replace(replace(as_list, '","', ', '), '["', ''), '"]', ''), '[]', '') AS as_text
    FROM (SELECT edit_id, {EDIT_LIST} AS as_list FROM (SELECT *, trim(corrected_value) AS g FROM @edits WHERE field_name = 'specialties_raw') x) y""")


def displayed(s, d):
    """Objects with a text value, with a number, with two entries, and plain text."""
    e = standin(s, d, "events")
    given = (
        F.when(c("event_type") == "view", c("props"))
        .when(c("event_type") == "click", F.concat(F.lit('{"name": "'), c("event_type"), F.lit('"}')))
        .when(c("event_type") == "error", F.concat(F.lit('{"a": "1", "b": '), c("user_id"), F.lit("}")))
        .when(c("event_type") == "signup", c("event_type"))
    )
    return e.select("event_id", jsontext.display_text(given).alias("shown"))


bind("text_display", displayed, """
    SELECT event_id, CASE event_type WHEN 'view' THEN 'k' WHEN 'click' THEN 'click' WHEN 'error' THEN '{"a": "1", "b": ' || user_id || '}'
           WHEN 'signup' THEN 'signup' ELSE '' END AS shown FROM @events""")
