"""Domain-shaped inputs derived from the synthetic tables.

Each is plain SQL that Spark and DuckDB both read, so that an operator and its
oracle start from the same rows. ``@name`` stands for a table or for another
stand-in. Everything is derived row by row from the given tables and grows with
them; values are made dirty on purpose by rules on the key.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

UUID = (
    "substr(md5(c_name), 1, 8) || '-' || substr(md5(c_name), 9, 4) || '-' || substr(md5(c_name), 13, 4) "
    "|| '-' || substr(md5(c_name), 17, 4) || '-' || substr(md5(c_name), 21, 12)"
)


def _pct(test: str) -> str:
    return f"CAST(floor(1000.0 * sum(CASE WHEN {test} THEN 1 ELSE 0 END) / count(*)) AS BIGINT)"


def _text(t: str) -> str:
    """Tenths of a percent as text, some suppressed and some in parentheses."""
    plain = f"CAST(CAST(floor({t} / 10) AS BIGINT) AS STRING) || '.' || CAST({t} % 10 AS STRING)"
    return (
        f"CASE WHEN {t} % 9 = 0 THEN ' * ' WHEN {t} % 7 = 0 THEN '(' || {plain} || ')' "
        f"WHEN {t} % 31 = 0 THEN '' ELSE {plain} END"
    )


SQL = {
    # customers with their district and postal code
    "place": """
        SELECT c.c_custkey, c.c_name, c.c_acctbal, c.c_nationkey, c.c_mktsegment, n.n_name, r.r_name,
               upper(substr(r.r_name, 1, 1)) || lower(substr(r.r_name, 2)) AS state,
               n.n_name || ' ' || CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'CIVIL' ELSE c.c_mktsegment END AS district,
               CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2
                    WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END AS seg,
               560000 + CASE WHEN c.c_custkey % 8 = 7 THEN c.c_nationkey * 40 + 7
                    ELSE c.c_nationkey * 40 + CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 8
                         WHEN 'FURNITURE' THEN 16 WHEN 'HOUSEHOLD' THEN 24 ELSE 32 END + c.c_custkey % 8 END AS pin
        FROM @customer c JOIN @nation n ON c.c_nationkey = n.n_nationkey
        JOIN @region r ON n.n_regionkey = r.r_regionkey""",
    "postal": """
        SELECT CAST(pin AS BIGINT) AS pincode, ' ' || n_name || ' ' || c_mktsegment || ' ' AS district,
               CASE WHEN c_nationkey % 11 = 3 THEN NULL WHEN c_nationkey % 2 = 0 THEN lower(r_name) ELSE r_name || ' ' END AS statename,
               CASE WHEN c_custkey % 17 = 0 THEN 'NA'
                    ELSE CAST(8 + c_nationkey AS STRING) || '.' || lpad(CAST(c_custkey % 100 AS STRING), 2, '0') END AS latitude,
               CASE WHEN c_custkey % 23 = 0 THEN '7.5' ELSE CAST(70 + seg AS STRING) || '.5' END AS longitude
        FROM @place""",
    "states": """
        SELECT alias, upper(substr(r_name, 1, 1)) || lower(substr(r_name, 2)) AS canonical_state_ut FROM (
            SELECT r_name, r_name AS alias FROM @region
            UNION ALL SELECT r_name, lower(r_name) FROM @region
            UNION ALL SELECT r_name, 'Region ' || r_name FROM @region) a""",
    "districts": """
        SELECT n_name || ' Building' AS alias, n_name || ' CIVIL' AS canonical_district,
               upper(substr(r_name, 1, 1)) || lower(substr(r_name, 2)) AS canonical_state_ut
        FROM @nation JOIN @region ON n_regionkey = r_regionkey""",
    # dirty source rows of facilities
    "raw": f"""
        SELECT CASE WHEN c_custkey % 11 = 0 THEN 'row-' || CAST(c_custkey AS STRING) ELSE ' ' || {UUID} || ' ' END AS unique_id,
               CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'null' ELSE ' ' || c_name END AS name,
               CASE WHEN c_custkey % 19 = 0 THEN 'null' ELSE 'Site of ' || n_name || ' for ' || lower(c_mktsegment) END AS description,
               CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN ' '
                    ELSE 'cl' || CAST(CAST(floor(c_custkey / 3) AS BIGINT) AS STRING) END AS cluster_id,
               CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN r_name
                    WHEN c_custkey % 3 = 1 THEN lower(r_name) || ' ' ELSE 'Somewhere' END AS address_stateOrRegion,
               CASE WHEN c_custkey % 19 = 0 THEN '' ELSE n_name END AS address_city,
               CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 'PIN-' || CAST(pin AS STRING)
                    WHEN c_custkey % 7 = 0 THEN substr(CAST(pin AS STRING), 1, 3) || ' ' || substr(CAST(pin AS STRING), 4, 3)
                    WHEN c_custkey % 37 = 0 THEN '056001' WHEN c_custkey % 41 = 0 THEN 'null'
                    WHEN c_custkey % 43 = 0 THEN '999999' ELSE CAST(pin AS STRING) END AS address_zipOrPostcode,
               CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 29 = 0 THEN 'trust' WHEN c_custkey % 5 = 1 THEN ' Government '
                    WHEN c_custkey % 5 = 2 THEN 'PRIVATE' WHEN c_custkey % 5 = 3 THEN '' ELSE 'public' END AS operatorTypeId,
               CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 16 = 0 THEN '12.5' WHEN c_custkey % 16 = 3 THEN 'null'
                    WHEN c_custkey % 2 = 0 THEN 'hospital' ELSE ' clinic' END AS facilityTypeId,
               CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 'null' WHEN c_custkey % 5 = 1 THEN '3.5'
                    WHEN c_custkey % 5 = 2 THEN 'about ' || CAST(c_custkey % 90 AS STRING) || ' doctors'
                    ELSE CAST(c_custkey % 50 AS STRING) END AS numberDoctors,
               CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 6 = 0 THEN '' WHEN c_custkey % 6 = 1 THEN 'beds: ' || CAST(c_custkey % 300 AS STRING)
                    ELSE CAST(c_custkey % 120 AS STRING) END AS capacity,
               CASE WHEN c_custkey % 19 = 0 OR c_custkey % 47 = 0 THEN NULL WHEN c_custkey % 53 = 0 THEN CAST(0 AS DOUBLE)
                    WHEN c_custkey % 7 = 0 THEN CAST(70.5 + seg AS DOUBLE) ELSE CAST(8.25 + c_nationkey AS DOUBLE) END AS latitude,
               CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 53 = 0 THEN CAST(0 AS DOUBLE)
                    WHEN c_custkey % 7 = 0 THEN CAST(8.25 + c_nationkey AS DOUBLE) ELSE CAST(70.5 + seg AS DOUBLE) END AS longitude,
               CASE WHEN c_custkey % 19 = 0 OR p_name IS NULL THEN NULL WHEN c_custkey % 14 = 0 THEN p_name
                    WHEN c_custkey % 3 = 0 THEN '["' || p_name || '","*__' || p_name || '__*","hot rod"]'
                    ELSE '["' || p_name || '"]' END AS specialties
        FROM @place LEFT JOIN @part ON p_partkey = c_custkey""",
    # survey table, one row per district
    "wide": f"""
        SELECT ' ' || district AS district_name, upper(state) || ' ' AS state_ut,
               CAST(count(DISTINCT c_custkey) AS DOUBLE) AS households_surveyed,
               CAST(count(*) AS DOUBLE) AS women_15_49_interviewed,
               CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS DOUBLE) AS men_15_54_interviewed,
               {_text(_pct("o_orderpriority = '1-URGENT'"))} AS w15_with_high_bp_pct,
               CAST({_pct("o_orderstatus = 'F'")} AS DOUBLE) / 10 AS high_blood_sugar_pct,
               {_text(_pct("o_orderpriority = '2-HIGH'"))} AS child_12_23m_vaccinated_pct,
               CAST({_pct("o_orderstatus = 'O'")} AS DOUBLE) / 10 AS all_anaemic_pct,
               {_text(_pct("o_totalprice > 400000"))} AS births_csection_pct,
               CAST({_pct("o_totalprice < 100000")} AS DOUBLE) / 10 AS tobacco_use_pct,
               {_text(_pct("o_orderpriority = '5-LOW'"))} AS respiratory_infection_pct,
               CAST({_pct("o_totalprice > 250000")} AS DOUBLE) / 10 AS electricity_pct
        FROM @place JOIN @orders ON o_custkey = c_custkey GROUP BY district, state""",
    "imap": """
        SELECT k AS indicator_key, c AS specialty_category FROM (VALUES
            ('w15_with_high_bp_pct', 'ECONOMY'), ('child_12_23m_vaccinated_pct', 'ECONOMY'),
            ('child_12_23m_vaccinated_pct', 'LARGE'), ('high_blood_sugar_pct', 'SMALL'),
            ('all_anaemic_pct', 'MEDIUM'), ('births_csection_pct', 'PROMO'), ('tobacco_use_pct', 'STANDARD'),
            ('retired_key_pct', 'SMALL'), ('retired_key_pct', 'PROMO')) t(k, c)""",
    # as above with spellings to clean and categories that are none of the list
    "explored_imap": """
        SELECT indicator_key, CASE indicator_key WHEN 'all_anaemic_pct' THEN ' ' || specialty_category || ' ' ELSE specialty_category END AS specialty_category
        FROM @imap
        UNION ALL SELECT k, c FROM (VALUES ('w15_with_high_bp_pct', 'OUTSIDE'), ('tobacco_use_pct', 'OUTSIDE'), ('tobacco_use_pct', 'STANDARD'),
            ('high_blood_sugar_pct', 'economy'), ('births_csection_pct', ' ')) t(k, c)""",
    # clean facilities
    "facility": """
        SELECT c_name AS facility_id,
               CASE WHEN c_custkey % 23 = 0 THEN 'null' WHEN c_custkey % 29 = 0 THEN NULL ELSE 'Clinic ' || c_name END AS facility_name,
               r_name AS state_ut_raw, CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE state END AS state_ut,
               CASE WHEN c_acctbal < -800 THEN NULL ELSE md5(district || '|' || state) END AS district_id,
               district AS district_name, CASE WHEN c_acctbal < -600 THEN NULL ELSE CAST(pin AS STRING) END AS pincode,
               'private' AS operator_type_raw, CASE WHEN c_custkey % 3 = 0 THEN 'public' ELSE 'private' END AS operator_type,
               CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(CAST(floor(c_acctbal) AS BIGINT) % 20 AS INT) END AS doctors_count,
               CASE WHEN c_acctbal < -200 THEN NULL ELSE CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) % 60 AS INT) END AS bed_count,
               CAST(8.25 + c_nationkey AS DOUBLE) AS lat, CAST(70.5 + seg AS DOUBLE) AS lon, c_custkey % 59 <> 0 AS coord_valid,
               CASE WHEN c_custkey % 61 = 0 THEN '7' WHEN c_custkey % 67 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'hospital' ELSE 'clinic' END AS facility_type,
               CASE WHEN c_acctbal < -700 THEN NULL WHEN p_name IS NULL THEN '[]' ELSE '["' || p_name || '"]' END AS specialties_raw,
               CASE WHEN c_custkey % 8 = 7 THEN 'medium' ELSE 'high' END AS join_confidence
        FROM @place LEFT JOIN @part ON p_partkey = c_custkey""",
    "bridge": """
        SELECT CASE WHEN c_acctbal < 0 THEN 'gone ' || c_name ELSE c_name END AS facility_id, p_name AS specialty
        FROM @customer JOIN @part ON p_partkey = c_custkey
        UNION SELECT CASE WHEN c_acctbal <= 5000 THEN 'gone ' || c_name ELSE c_name END, p_name
        FROM @customer JOIN @part ON p_partkey = c_custkey + 1""",
    # corrections kept from before
    "corrections": """
        SELECT 'Customer#' || lpad(CAST(s_suppkey AS STRING), 9, '0') AS facility_id,
               CASE WHEN s_nationkey % 3 = 0 THEN 'Kept ' || s_name ELSE NULL END AS facility_name,
               CASE WHEN s_acctbal > 2000 THEN '560001' ELSE NULL END AS pincode,
               CASE WHEN s_nationkey % 2 = 0 THEN 'public' ELSE NULL END AS operator_type,
               CASE WHEN s_nationkey % 5 = 0 THEN '12' WHEN s_nationkey % 5 = 1 THEN 'hospital' ELSE NULL END AS facility_type,
               CAST(NULL AS INT) AS doctors_count,
               CASE WHEN s_acctbal < 0 THEN NULL ELSE CAST(CAST(floor(s_acctbal) AS BIGINT) % 80 AS INT) END AS bed_count,
               CAST(NULL AS STRING) AS specialties_raw, CAST(NULL AS STRING) AS state_ut, CAST(NULL AS STRING) AS district_name
        FROM @supplier""",
    # edits of facility fields as they came in
    "edits": """
        SELECT event_id AS edit_id, ts AS made_at, 'Customer#' || lpad(CAST(user_id AS STRING), 9, '0') AS facility_id,
               CASE event_type WHEN 'signup' THEN 'facility_name' WHEN 'error' THEN 'pincode' WHEN 'view' THEN 'operator_type'
                    WHEN 'click' THEN 'bed_count' ELSE CASE WHEN event_id % 13 = 0 THEN 'owner' ELSE 'specialties_raw' END END AS field_name,
               CASE event_type
                    WHEN 'signup' THEN CASE WHEN event_id % 20 = 0 THEN ' ' ELSE ' Renamed ' || CAST(event_id AS STRING) END
                    WHEN 'error' THEN CASE WHEN event_id % 4 = 0 THEN '012345' ELSE CAST(560000 + event_id % 1000 AS STRING) END
                    WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'public' WHEN event_id % 3 = 1 THEN 'ngo' ELSE 'private' END
                    WHEN 'click' THEN CASE WHEN event_id % 6 = 0 THEN 'many' ELSE CAST(CAST(floor(value) AS BIGINT) AS STRING) || 'x' END
                    ELSE CASE WHEN event_id % 4 = 0 THEN ' , ' WHEN event_id % 4 = 1 THEN 'red rod, **blue bolt**'
                         WHEN event_id % 4 = 2 THEN '["hot gear","cold ring"]' ELSE ' _old plate_ ' END
               END AS corrected_value
        FROM @events""",
    # status edits of documents' gaps: events of one user and type concern one gap
    "status_feed": """
        SELECT event_id AS edit_id, ts AS made_at, md5('gap|' || event_type || '|' || CAST(user_id AS STRING)) AS gap_id,
               CASE event_id % 4 WHEN 0 THEN 'dismissed' WHEN 1 THEN 'resolved' ELSE 'open' END AS status,
               CASE WHEN event_id % 3 = 0 THEN ' seen by ' || event_type || ' ' END AS resolution_notes
        FROM @events""",
    # label tables before cleaning
    "dirty_label": """
        SELECT p_partkey, p_type, CASE WHEN p_partkey % 10 = 0 THEN '*__' || p_name || '__*' WHEN p_partkey % 10 = 1 THEN upper(p_name)
                    WHEN p_partkey % 10 = 2 THEN 'optham ' || p_name WHEN p_partkey % 50 = 3 THEN p_name || 's'
                    WHEN p_partkey % 50 = 4 THEN '{"x":"y"}' WHEN p_partkey % 50 = 5 THEN ' ' WHEN p_partkey % 50 = 6 THEN '[' || p_name
                    WHEN p_partkey % 50 = 7 THEN 'hemat ' || p_name WHEN p_partkey % 50 = 8 THEN 'haemat ' || p_name ELSE p_name END AS label
        FROM @part""",
    "dirty_bridge": """
        SELECT DISTINCT c_name AS facility_id, label AS specialty FROM @customer JOIN @dirty_label ON p_partkey = c_custkey
        UNION SELECT c_name, label FROM @customer JOIN @dirty_label ON p_partkey = c_custkey + 1""",
    "dirty_mapping": "SELECT label AS specialties, p_type AS category FROM @dirty_label",
    # stored scenarios, one JSON document each
    "scenarios": """
        SELECT c_custkey AS scenario_id,
               '[{"district_name":" ' || district || ' ","state_ut":"' || state || '","capability":"'
               || CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN 'Red Widget unit' ELSE 'Cardio wing' END
               || '","capacity":' || CAST(c_custkey % 90 AS STRING) || '},{"district_name":"' || n_name || ' MACHINERY","state_ut":"'
               || state || '","capability":"heart centre","capacity":-5}]' AS doc
        FROM @place""",
    "unlabelled": """
        SELECT d.doc_id, d.source, d.lang, d.text FROM @documents d
        WHERE NOT EXISTS (SELECT 1 FROM @labels l WHERE l.doc_id = d.doc_id)""",
    # parents and ordered children
    "parents": """
        SELECT conv_id, 'Conversation ' || CAST(conv_id AS STRING) AS name, max(role) AS description
        FROM @conversations GROUP BY conv_id""",
    "children": "SELECT conv_id, turn AS sort_order, text AS item FROM @conversations",
}


def _used(text: str) -> list[str]:
    return re.findall(r"@(\w+)", text)


def ordered(names: list[str]) -> list[str]:
    """The given stand-ins and all they need, needed ones first."""
    out: list[str] = []

    def add(name: str) -> None:
        if name in SQL and name not in out:
            for dep in _used(SQL[name]):
                add(dep)
            out.append(name)

    for name in names:
        add(name)
    return out


_KNOWN: dict[tuple[str, str, str], DataFrame] = {}


def standin(spark: SparkSession, source: str, name: str) -> DataFrame:
    """A synthetic table or a stand-in as a DataFrame. Only the plan is kept
    between calls, so that files are listed and text is parsed once."""
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _KNOWN:
        _KNOWN[key] = _read(spark, source, name)
    return _KNOWN[key]


def text_of(name: str) -> str:
    """A stand-in's SQL, the relations it reads in braces."""
    # braces of JSON in the text are doubled, those around names are not
    escaped = SQL[name].replace("{", "{{").replace("}", "}}")
    return re.sub(r"@(\w+)", r"{\1}", escaped)


def _read(spark: SparkSession, source: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{source}/{name}.parquet")
    frames = {dep: standin(spark, source, dep) for dep in sorted(set(_used(SQL[name])))}
    df = spark.sql(text_of(name), **frames)
    return _as_stored(df) if name in STORED else df


# wide stand-ins whose computed columns should look like those of a stored table
STORED = ("raw",)


def _as_stored(df: DataFrame) -> DataFrame:
    """Keep the optimizer from moving filters into the expressions that make the
    values up: with many such columns it would try all their combinations."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))
