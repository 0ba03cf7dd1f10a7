"""Joins, aggregations, rankings and set operations on the synthetic tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapwright.bindings import inputs
from gapwright.bindings.catalog import DERIVED, bind, is_label, r, rounded
from gapwright.bindings.inputs import SIZES
from gapwright.bindings.standins import standin
from gapwright.functions import numbers, text
from gapwright.operators import aggregates, fuzzy, joins, reshape
from gapwright.plans import curation, exploration, scoring, views

c = F.col

# -------------------------------------------------------------------- joins

bind(
    "join_inner",
    lambda s, d: scoring.facility_categories(standin(s, d, "facility"), standin(s, d, "bridge"), inputs.mapping(s, d), "ECONOMY"),
    """SELECT f.facility_id, b.specialty, m.category FROM @facility f JOIN @bridge b ON b.facility_id = f.facility_id
       JOIN @mapping m ON m.specialties = b.specialty WHERE m.category = 'ECONOMY'""",
)


def looked_up(s, d):
    facility = standin(s, d, "facility").withColumn("raw_key", F.upper(F.when(c("bed_count") > 50, F.lit("elsewhere")).otherwise(c("state_ut_raw"))))
    out = joins.lookup(facility, inputs.states(s, d), "raw_key", "alias_key", "canonical_state_ut", "state")
    return out.select("facility_id", "raw_key", "state")


bind("join_left_lookup", looked_up, """
    SELECT facility_id, raw_key, coalesce(canonical, raw_key) AS state
    FROM (SELECT facility_id, upper(CASE WHEN bed_count > 50 THEN 'elsewhere' ELSE state_ut_raw END) AS raw_key FROM @facility) f
    LEFT JOIN @state_key ON k = raw_key""")


def merged(s, d):
    base = scoring.bed_supply(standin(s, d, "facility"), standin(s, d, "bridge"), inputs.mapping(s, d), "ECONOMY")
    added = scoring.scenario_supply(inputs.scenario(s, d).filter(c("capability") != ""))
    return joins.merge_measures(base, added, ["district_key", "state_key"], list(scoring.SUPPLY))


DERIVED["supply"] = """
    SELECT dk AS district_key, sk AS state_key, count(*) AS total_facilities, CAST(sum(hit) AS BIGINT) AS category_facilities,
           CAST(sum(hit * beds) AS BIGINT) AS category_bed_capacity
    FROM (SELECT upper(district_name) AS dk, upper(state_ut) AS sk, facility_id, max(coalesce(nullif(bed_count, 0), 25)) AS beds,
                 max(CASE WHEN facility_id IN (SELECT b.facility_id FROM @bridge b JOIN @mapping m ON m.specialties = b.specialty
                          WHERE m.category = 'ECONOMY') THEN 1 ELSE 0 END) AS hit
          FROM @facility WHERE state_ut IS NOT NULL GROUP BY 1, 2, 3) p GROUP BY 1, 2"""
bind("join_full_outer", merged, """
    SELECT coalesce(a.district_key, x.district_key) AS district_key, coalesce(a.state_key, x.state_key) AS state_key,
           CAST(coalesce(total_facilities, 0) + coalesce(n, 0) AS BIGINT) AS total_facilities,
           CAST(coalesce(category_facilities, 0) + coalesce(k, 0) AS BIGINT) AS category_facilities,
           CAST(coalesce(category_bed_capacity, 0) + coalesce(b, 0) AS BIGINT) AS category_bed_capacity
    FROM @supply a FULL JOIN (SELECT district_key, state_key, count(*) AS n, sum(is_match) AS k, sum(greatest(capacity, 1)) AS b
                              FROM @scenario_row WHERE capability <> '' GROUP BY 1, 2) x
      ON a.district_key = x.district_key AND a.state_key = x.state_key""")

bind(
    "join_anti",
    lambda s, d: joins.without_match(standin(s, d, "documents"), standin(s, d, "labels"), ["doc_id"]).select("doc_id", "source", "lang"),
    "SELECT doc_id, source, lang FROM @documents d WHERE NOT EXISTS (SELECT 1 FROM @labels l WHERE l.doc_id = d.doc_id)",
)


def semi(s, d):
    wanted = joins.filter_category(standin(s, d, "imap"), "specialty_category", "ECONOMY")
    return joins.with_match(inputs.long(s, d), wanted, ["indicator_key"]).select("district_id", "indicator_key", "indicator_value")


bind("join_semi", semi, """
    SELECT district_id, indicator_key, indicator_value FROM @long l
    WHERE EXISTS (SELECT 1 FROM @imap i WHERE i.indicator_key = l.indicator_key AND i.specialty_category = 'ECONOMY')""")


def scalar_attached(s, d):
    docs = standin(s, d, "documents").select("doc_id", "source")
    names = docs.select(F.concat("source", F.lit("!")).alias("source"))
    labels = aggregates.label_list(names, "source").select(F.array_join("labels", ",").alias("all_labels"), F.size("labels").alias("n"))
    return joins.attach_scalar(docs, labels)


bind("join_cross_scalar", scalar_attached, """
    SELECT doc_id, source, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT source || '!' AS x FROM @documents) l) AS all_labels,
           CAST((SELECT count(DISTINCT source) FROM @documents) AS INTEGER) AS n FROM @documents""")


def name_usage(s, d):
    names = standin(s, d, "customer").select(c("c_name").alias("name")).unionAll(standin(s, d, "part").select("p_name"))
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


bind("fuzzy_pairs", lambda s, d: fuzzy.near_pairs(name_usage(s, d), "name", "n"), """
    SELECT x.name AS a, y.name AS b, x.n AS a_cnt, y.n AS b_cnt FROM u x JOIN u y ON x.name < y.name
    WHERE levenshtein(replace(replace(lower(x.name), ' ', ''), '-', ''), replace(replace(lower(y.name), ' ', ''), '-', '')) = 1""".replace(
    "FROM u x JOIN u y",
    "FROM @name_usage x JOIN @name_usage y",
))
DERIVED["name_usage"] = """
    SELECT name, count(*) AS n FROM (SELECT c_name AS name FROM @customer UNION ALL SELECT p_name FROM @part) z GROUP BY name"""


def colour_words(s, d):
    return standin(s, d, "part").select(F.split("p_name", " ")[0].alias("word")).distinct()


bind(
    "contains_join",
    lambda s, d: joins.contains_any(standin(s, d, "documents"), "text", colour_words(s, d), "word").select("doc_id", "source"),
    """SELECT doc_id, source FROM @documents d WHERE EXISTS (
           SELECT 1 FROM (SELECT DISTINCT string_split(p_name, ' ')[1] AS w FROM @part) p WHERE contains(lower(d.text), w))""",
)


def normalized(s, d):
    raw = standin(s, d, "raw").select("unique_id", "address_city", c("address_stateOrRegion").alias("st"))
    geo = standin(s, d, "nation").join(standin(s, d, "region"), c("n_regionkey") == c("r_regionkey")).select(
        "n_nationkey", F.concat(F.lit(" "), F.lower("n_name")).alias("n_name"), F.lower("r_name").alias("r_name")
    )
    return joins.join_normalized(raw, geo, {"address_city": "n_name", "st": "r_name"})


bind("join_ci_keys", normalized, """
    SELECT unique_id, address_city, address_stateOrRegion AS st, n_nationkey FROM @raw
    JOIN @nation ON upper(trim(address_city)) = upper(n_name)
    JOIN @region ON n_regionkey = r_regionkey AND upper(trim(address_stateOrRegion)) = upper(r_name)""")


def categories(s, d):
    m = inputs.mapping(s, d)
    return joins.filter_category(m, "category", "ALL").withColumn("choice", F.lit("ALL")).unionByName(
        joins.filter_category(m, "category", "SMALL").withColumn("choice", F.lit("SMALL"))
    )


bind("param_category_filter", categories, """
    SELECT *, 'ALL' AS choice FROM @mapping UNION ALL SELECT *, 'SMALL' FROM @mapping WHERE category = 'SMALL'""")


def bridged(s, d):
    rows = standin(s, d, "raw").select(
        "unique_id", numbers.postal_code(c("address_zipOrPostcode")).alias("pincode"), F.trim("address_stateOrRegion").alias("state_ut_raw")
    )
    return curation.geo_bridge(rows, inputs.directory(s, d), inputs.states(s, d), inputs.places(s, d))


bind("geo_bridge", bridged, "SELECT unique_id, pincode, state_ut_raw, district_id, district_name, state_ut, join_confidence FROM @bridged")
bind(
    "match_confidence",
    lambda s, d: bridged(s, d).groupBy("join_confidence").agg(F.count(F.lit(1)).alias("n")),
    "SELECT join_confidence, count(*) AS n FROM @bridged GROUP BY 1",
)


def ratios(s, d):
    docs, labels = standin(s, d, "documents"), standin(s, d, "labels")
    n = F.count(F.lit(1))
    row = joins.ratio_row(
        s,
        documents=docs.agg(n),
        labelled=joins.with_match(docs, labels, ["doc_id"]).agg(n),
        postal_codes=standin(s, d, "postal").agg(F.count_distinct("pincode")),
        first_code=standin(s, d, "facility").agg(F.min("pincode")),
    )
    return row.withColumn("labelled_pct", numbers.stable_round(numbers.percent(c("labelled"), c("documents")), 1))


bind("scalar_subquery", ratios, f"""
    SELECT documents, labelled, {r('100.0::DOUBLE * labelled / documents', 1)} AS labelled_pct, postal_codes, first_code
    FROM (SELECT (SELECT count(*) FROM @documents) AS documents,
                 (SELECT count(*) FROM @documents WHERE doc_id IN (SELECT doc_id FROM @labels)) AS labelled,
                 (SELECT count(DISTINCT pincode) FROM @postal) AS postal_codes, (SELECT min(pincode) FROM @facility) AS first_code) x""")

bind(
    "self_compare",
    lambda s, d: rounded(joins.compare(
        inputs.core(s, d), inputs.core(s, d, with_scenario=True), ["district_name", "state_ut"], ["category_bed_capacity", "gap_score"]
    )),
    f"""SELECT b.district_name, b.state_ut, b.category_bed_capacity AS baseline_category_bed_capacity,
               s.category_bed_capacity AS scenario_category_bed_capacity, s.category_bed_capacity - b.category_bed_capacity AS delta_category_bed_capacity,
               {r('b.gap_score')} AS baseline_gap_score, {r('s.gap_score')} AS scenario_gap_score, {r('s.gap_score - b.gap_score')} AS delta_gap_score
        FROM @core b JOIN @core_scenario s ON b.district_name = s.district_name AND b.state_ut = s.state_ut""",
)

# ------------------------------------------------------------- aggregations

bind(
    "facilities_by_state",
    lambda s, d: aggregates.count_by(standin(s, d, "facility"), F.coalesce("state_ut", "state_ut_raw"), "state", "facility_count"),
    "SELECT coalesce(state_ut, state_ut_raw) AS state, count(*) AS facility_count FROM @facility GROUP BY 1 ORDER BY 2 DESC, 1",
)
bind(
    "facilities_by_type",
    lambda s, d: aggregates.count_by(standin(s, d, "facility"), c("facility_type"), "facility_type", "facility_count"),
    "SELECT facility_type, count(*) AS facility_count FROM @facility WHERE facility_type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1",
)
bind(
    "group_count",
    lambda s, d: aggregates.count_by(standin(s, d, "lineitem"), F.concat_ws("/", "l_returnflag", "l_linestatus"), "state", "row_count"),
    "SELECT l_returnflag || '/' || l_linestatus AS state, count(*) AS row_count FROM @lineitem GROUP BY 1",
)
bind(
    "distinct_counts",
    lambda s, d: aggregates.distinct_counts(
        standin(s, d, "facility"), "total_facilities", {"states_covered": "state_ut", "facility_types": "facility_type"}
    ),
    """SELECT count(*) AS total_facilities, count(DISTINCT state_ut) AS states_covered, count(DISTINCT facility_type) AS facility_types
       FROM @facility""",
)
bind(
    "conditional_sums",
    lambda s, d: aggregates.conditional_sums(
        standin(s, d, "lineitem"),
        {"returned": c("l_returnflag") == "R", "large": c("l_quantity") > 40, "discounted": c("l_discount") >= 0.05, "open": c("l_linestatus") == "O"},
        ["l_suppkey"],
    ),
    """SELECT l_suppkey, count(*) AS total, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_quantity > 40) AS large,
              count(*) FILTER (l_discount >= 0.05) AS discounted, count(*) FILTER (l_linestatus = 'O') AS open FROM @lineitem GROUP BY 1""",
)
WANTED = {"households": "households_surveyed", "bp_pct": "w15_with_high_bp_pct", "sugar_pct": "high_blood_sugar_pct"}
bind(
    "pivot_max",
    lambda s, d: reshape.pivot_max(inputs.long(s, d), ["district_name", "state_ut"], WANTED, "indicator_key", "indicator_value"),
    "SELECT district_name, state_ut, "
    + ", ".join(f"max(indicator_value) FILTER (indicator_key = '{k}') AS {o}" for o, k in WANTED.items())
    + " FROM @long GROUP BY 1, 2",
)
bind(
    "unpivot",
    lambda s, d: reshape.unpivot(standin(s, d, "wide"), ["district_name", "state_ut"]),
    """SELECT w.district_name, w.state_ut, l.indicator_key, l.indicator_value, l.is_suppressed, l.indicator_raw
       FROM @wide w JOIN @long l ON l.district_name = trim(w.district_name) AND upper(l.state_ut) = upper(trim(w.state_ut))""",
)
bind(
    "category_demand",
    lambda s, d: scoring.category_demand(inputs.long(s, d), standin(s, d, "imap"), "ECONOMY"),
    f"""SELECT district_name, state_ut, {r('avg(indicator_value)', 2)} AS demand_pct FROM @long
        WHERE indicator_key IN (SELECT indicator_key FROM @imap WHERE specialty_category = 'ECONOMY') AND NOT is_suppressed
          AND indicator_key NOT IN {SIZES} AND indicator_value IS NOT NULL GROUP BY 1, 2""",
)
bind(
    "two_level_beds",
    lambda s, d: scoring.bed_supply(standin(s, d, "facility"), standin(s, d, "bridge"), inputs.mapping(s, d), "ECONOMY"),
    "SELECT * FROM @supply",
)


def medians(s, d):
    price = aggregates.median(standin(s, d, "lineitem"), "l_extendedprice", ["l_returnflag"])
    whole = aggregates.median(standin(s, d, "lineitem"), "l_extendedprice").select(F.lit("all").alias("grp"), "median")
    keyed = aggregates.median(inputs.long(s, d), "indicator_value", ["indicator_key"])
    return rounded(
        price.select(c("l_returnflag").alias("grp"), "median").unionByName(whole).unionByName(
            keyed.select(c("indicator_key").alias("grp"), "median")
        )
    )


bind("median_exact", medians, f"""
    SELECT grp, {r('m')} AS median FROM (
        SELECT l_returnflag AS grp, quantile_cont(l_extendedprice, 0.5) AS m FROM @lineitem GROUP BY 1
        UNION ALL SELECT 'all', quantile_cont(l_extendedprice, 0.5) FROM @lineitem
        UNION ALL SELECT indicator_key, quantile_cont(indicator_value, 0.5) FROM @long WHERE indicator_value IS NOT NULL GROUP BY 1) x""")


def top_rows_json(s, d):
    core = inputs.core(s, d).select("district_name", "state_ut", "category_facilities", "gap_flag", "gap_score")
    order = [F.desc("gap_score"), F.asc("state_ut"), F.asc("district_name")]
    return aggregates.top_json(core, order, 10, ["district_name", "state_ut", "category_facilities", "gap_flag"], "top")


TOP_JSON = """'[' || string_agg('{"district_name":"' || district_name || '","state_ut":"' || state_ut || '","category_facilities":'
    || category_facilities || ',"gap_flag":"' || gap_flag || '"}', ',' ORDER BY gap_score DESC, state_ut, district_name) || ']'"""
bind("collect_list_json", top_rows_json, f"""
    SELECT {TOP_JSON} AS top FROM (SELECT * FROM @core ORDER BY gap_score DESC, state_ut, district_name LIMIT 10) t""")

LIST_SQL = """'["' || string_agg(DISTINCT {0}, '","' ORDER BY {0}) || '"]'"""
bind(
    "collect_set_json",
    lambda s, d: aggregates.list_json(standin(s, d, "bridge"), "facility_id", "specialty", "specialties_raw"),
    f"SELECT facility_id, {LIST_SQL.format('specialty')} AS specialties_raw FROM @bridge GROUP BY 1",
)
bind(
    "majority_vote",
    lambda s, d: aggregates.majority_vote(standin(s, d, "part"), "p_name", "p_type"),
    """SELECT p_name, p_type FROM (SELECT p_name, p_type, row_number() OVER (PARTITION BY p_name ORDER BY count(*) DESC, p_type) AS rn
       FROM @part GROUP BY 1, 2) v WHERE rn = 1""",
)
DERIVED["label_use"] = f"""
    SELECT trim(label) AS raw, count(*) AS n FROM (SELECT specialty AS label FROM @dirty_bridge UNION ALL SELECT specialties FROM @dirty_mapping) u
    WHERE {is_label('label')} GROUP BY 1"""
bind(
    "canonical_spelling",
    lambda s, d: aggregates.canonical_spelling(standin(s, d, "dirty_bridge").select("specialty"), standin(s, d, "dirty_mapping").select("specialties")),
    """SELECT raw, (SELECT y.raw FROM @label_use y WHERE lower(y.raw) = lower(x.raw) ORDER BY y.n DESC, y.raw LIMIT 1) AS canonical
       FROM @label_use x""",
)


# the categories of the synthetic tables; the mapping to explore has others as well
EXPLORED = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
DERIVED["explored"] = f"""
    SELECT DISTINCT trim(indicator_key) AS indicator_key, trim(specialty_category) AS specialty_category FROM @explored_imap
    WHERE trim(specialty_category) IN {EXPLORED}"""


def profile(s, d):
    return exploration.category_profile(inputs.long(s, d), standin(s, d, "explored_imap"), EXPLORED)


def ranked(s, d):
    return exploration.ranked_profile(inputs.long(s, d), standin(s, d, "explored_imap"), EXPLORED)


DERIVED["profile"] = f"""
    SELECT l.district_name, l.state_ut, i.specialty_category AS category, avg(indicator_value) AS avg_demand_pct,
           max(indicator_value) AS max_demand_pct, quantile_cont(indicator_value, 0.5) AS median_demand_pct,
           count(indicator_value) AS indicator_count, count(*) FILTER (is_suppressed) AS suppressed_indicator_count,
           any_value(h.households) AS households_surveyed
    FROM @long l JOIN @explored i ON i.indicator_key = l.indicator_key
    JOIN (SELECT district_name, state_ut, max(indicator_value) AS households FROM @long WHERE indicator_key = 'households_surveyed' GROUP BY 1, 2) h
      ON h.district_name = l.district_name AND h.state_ut = l.state_ut
    GROUP BY 1, 2, 3"""
DERIVED["ranked"] = f"""
    SELECT *, CAST(dense_rank() OVER (PARTITION BY district_name, state_ut ORDER BY {r('avg_demand_pct', 8)} DESC NULLS LAST, indicator_count DESC) AS INTEGER)
               AS category_rank_in_district,
           avg_demand_pct / nullif(sum(avg_demand_pct) OVER (PARTITION BY district_name, state_ut), 0) AS demand_share_in_district
    FROM @profile"""
PROFILE_SQL = f"""district_name, state_ut, category, {r('avg_demand_pct')} AS avg_demand_pct, {r('max_demand_pct')} AS max_demand_pct,
    {r('median_demand_pct')} AS median_demand_pct, indicator_count, suppressed_indicator_count, households_surveyed"""
bind("category_profile", lambda s, d: rounded(profile(s, d)), f"SELECT {PROFILE_SQL} FROM @profile")
bind("dense_rank_share", lambda s, d: rounded(ranked(s, d)), f"""
    SELECT {PROFILE_SQL}, category_rank_in_district, {r('demand_share_in_district')} AS demand_share_in_district FROM @ranked""")
bind("top_frequency", lambda s, d: exploration.top_frequency(ranked(s, d)), f"""
    SELECT category AS top_demand_category, count(*) AS districts_where_top, {r('avg(avg_demand_pct)', 2)} AS avg_top_demand_pct
    FROM @ranked WHERE category_rank_in_district = 1 GROUP BY 1""")
bind("rollup_state", lambda s, d: exploration.rollup_state(ranked(s, d)), f"""
    SELECT state_ut, category, count(DISTINCT district_name) AS district_count, {r('avg(avg_demand_pct)', 2)} AS avg_demand_pct,
           {r('max(avg_demand_pct)', 2)} AS max_district_avg_demand_pct FROM @ranked GROUP BY 1, 2""")
TOP_LABEL = f"category || ' (' || {r('avg_demand_pct', 1)} || '%)'"
bind("pivot_top3", lambda s, d: exploration.top_categories(ranked(s, d)), f"""
    SELECT state_ut, district_name, min({TOP_LABEL}) FILTER (category_rank_in_district = 1) AS top_1,
           min({TOP_LABEL}) FILTER (category_rank_in_district = 2) AS top_2, min({TOP_LABEL}) FILTER (category_rank_in_district = 3) AS top_3
    FROM @ranked WHERE category_rank_in_district <= 3 GROUP BY 1, 2""")
bind("top_category_list", lambda s, d: exploration.top_list(ranked(s, d)), f"""
    SELECT state_ut, district_name, category_rank_in_district, category, indicator_count, households_surveyed, {r('avg_demand_pct', 2)} AS avg_demand_pct
    FROM @ranked WHERE category_rank_in_district <= 3""")
bind("suppression_stats", lambda s, d: rounded(exploration.suppression_stats(inputs.long(s, d))), f"""
    SELECT is_suppressed, count(*) AS row_count, {r('avg(indicator_value)')} AS avg_demand_pct FROM @long
    WHERE indicator_key NOT IN {SIZES} GROUP BY 1""")
DERIVED["centroid"] = """
    SELECT upper(trim(district)) AS district_key, upper(trim(statename)) AS state_key, count(DISTINCT pincode) AS pincode_count,
           avg(lat) AS latitude, avg(lon) AS longitude
    FROM (SELECT *, TRY_CAST(latitude AS DOUBLE) AS lat, TRY_CAST(longitude AS DOUBLE) AS lon FROM (
            SELECT *, row_number() OVER (PARTITION BY pincode ORDER BY district, statename, latitude, longitude) AS rn FROM @postal) p WHERE rn = 1) q
    WHERE lat BETWEEN 6 AND 38 AND lon BETWEEN 68 AND 98 GROUP BY 1, 2"""
bind("district_centroid", lambda s, d: rounded(scoring.centroids(standin(s, d, "postal"))), f"""
    SELECT district_key, state_key, pincode_count, {r('latitude')} AS latitude, {r('longitude')} AS longitude FROM @centroid""")
bind(
    "minmax_range",
    lambda s, d: rounded(aggregates.score_range(scoring.desert_risk(inputs.core(s, d)), "desert_risk").withColumn("part", F.lit("all")).unionByName(
        aggregates.score_range(scoring.desert_risk(inputs.core(s, d)).filter("gap_flag = 'none'"), "desert_risk").withColumn("part", F.lit("none")))),
    f"SELECT {r('min(risk)')} AS min_score, {r('max(risk)')} AS max_score, 'all' AS part FROM @risk UNION ALL SELECT 0.0::DOUBLE, 1.0::DOUBLE, 'none'",
)
bind("geo_stats", lambda s, d: rounded(scoring.geo_stats(inputs.core(s, d))), f"""
    SELECT CAST((SELECT sum(category_bed_capacity) FROM @risk) AS BIGINT) AS total_beds, top_label, {r('top_score')} AS top_score FROM (
        SELECT district_name || ', ' || state_ut AS top_label, {r('risk', 8)} AS top_score FROM @risk ORDER BY 2 DESC, 1 LIMIT 1) t""")

# ------------------------------------------------------ windows, sorts, sets


def clusters(s, d):
    rows = standin(s, d, "raw").withColumn("score", curation.completeness())
    cluster = F.coalesce(text.nullify(c("cluster_id"), ("",)), c("unique_id"))
    best = aggregates.dedupe(rows, cluster, [F.desc("score"), F.asc("unique_id"), F.asc("numberDoctors")])
    return best.select("unique_id", "cluster_id", "score")


from gapwright.bindings.cleaning import COMPLETE  # noqa: E402

bind("dedupe_cluster", clusters, f"""
    SELECT unique_id, cluster_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(trim(cluster_id), ''), unique_id)
                                     ORDER BY score DESC, unique_id, numberDoctors NULLS FIRST) AS rn
        FROM (SELECT *, {COMPLETE} AS score FROM @raw) x) y WHERE rn = 1""")
bind(
    "first_per_key",
    lambda s, d: aggregates.first_per_key(standin(s, d, "postal"), "pincode", ["district", "statename"], "ambiguous", "district"),
    """SELECT pincode, (min({'a': district, 'b': statename})).a AS district, (min({'a': district, 'b': statename})).b AS statename,
              count(DISTINCT district) > 1 AS ambiguous FROM @postal GROUP BY 1""",
)
DERIVED["need"] = f"""
    SELECT district_name, state_ut, category, {r('score', 1)} AS demand_score,
           CAST(row_number() OVER (PARTITION BY district_name, state_ut ORDER BY {r('score', 8)} DESC NULLS LAST, category) AS INTEGER) AS category_rank_in_district
    FROM (SELECT district_name, state_ut, specialty_category AS category, avg(indicator_value) AS score
          FROM @long l JOIN @imap i ON i.indicator_key = l.indicator_key
          WHERE NOT is_suppressed AND l.indicator_key NOT IN {SIZES} AND indicator_value IS NOT NULL GROUP BY 1, 2, 3) x"""
bind("demand_ranked", lambda s, d: exploration.demand_ranked(inputs.long(s, d), standin(s, d, "imap")), "SELECT * FROM @need")
def priorities(s, d):
    """Order priorities of each customer, urgent ones without a score."""
    score = F.when(c("o_orderpriority") != "1-URGENT", F.max("o_totalprice"))
    rows = standin(s, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(score.alias("score"))
    return aggregates.rank_in_group(rows, ["o_custkey"], [F.desc_nulls_last("score"), F.asc("o_orderpriority")], "rank")


bind("rank_in_group", priorities, """
    SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC NULLS LAST, o_orderpriority) AS INTEGER) AS rank FROM (
        SELECT o_custkey, o_orderpriority, CASE WHEN o_orderpriority <> '1-URGENT' THEN max(o_totalprice) END AS score
        FROM @orders GROUP BY 1, 2) x""")
bind(
    "global_max_norm",
    lambda s, d: rounded(aggregates.normalize_by_max(standin(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "norm")),
    f"SELECT o_orderkey, {r('o_totalprice')} AS o_totalprice, {r('o_totalprice / (SELECT max(o_totalprice) FROM @orders)')} AS norm FROM @orders",
)
bind(
    "window_over_agg",
    lambda s, d: aggregates.rank_groups(standin(s, d, "part"), "p_type", "p_name", "rank"),
    """SELECT p_name, p_type, count(*) AS n, CAST(row_number() OVER (PARTITION BY p_name ORDER BY count(*) DESC, p_type) AS INTEGER) AS rank FROM @part GROUP BY 1, 2""",
)
bind(
    "topk",
    lambda s, d: aggregates.topk(standin(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 25),
    "SELECT o_orderkey, o_custkey, o_totalprice FROM @orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
)
bind(
    "custom_order",
    lambda s, d: aggregates.order_by_rank(
        standin(s, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")), "o_orderpriority", ["3-MEDIUM", "1-URGENT"], "o_orderpriority"
    ).withColumn("sort_key", aggregates.by_ranking("o_orderpriority", ["3-MEDIUM", "1-URGENT"])),
    """SELECT o_orderpriority, count(*) AS n, CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END AS sort_key
       FROM @orders GROUP BY 1""",
)
bind(
    "ordered_labels",
    lambda s, d: aggregates.label_list(standin(s, d, "dirty_label"), "label").select(F.array_join("labels", "|").alias("labels")),
    f"""SELECT string_agg(x, '|' ORDER BY x) AS labels FROM (
            SELECT DISTINCT trim(label) AS x FROM @dirty_label WHERE {is_label('label')} ORDER BY 1 LIMIT 400) l""",
)
bind("district_options", lambda s, d: views.district_options(inputs.long(s, d)), "SELECT DISTINCT district_id AS district_key, district_name, state_ut FROM @long")
bind("category_options", lambda s, d: views.category_options(inputs.mapping(s, d)), "SELECT DISTINCT category AS specialty_category FROM @mapping")
bind(
    "specialty_options",
    lambda s, d: views.label_options(standin(s, d, "dirty_bridge"), standin(s, d, "dirty_mapping")),
    "SELECT DISTINCT raw AS specialty FROM @label_use",
)
bind(
    "distinct_options",
    lambda s, d: aggregates.options(standin(s, d, "facility").filter(c("state_ut").isNotNull()), ["state_ut", "district_name"]),
    "SELECT DISTINCT state_ut, district_name FROM @facility WHERE state_ut IS NOT NULL",
)


def stacked(s, d):
    """Rows of one relation from several branches."""
    f = standin(s, d, "facility").select(c("facility_id").alias("key"), c("pincode").alias("value"), F.lit("facility").alias("part"))
    b = standin(s, d, "bridge").select(c("facility_id").alias("key"), c("specialty").alias("value"), F.lit("bridge").alias("part"))
    return reshape.union_all(f, b)


bind("union_all", stacked, """
    SELECT facility_id AS key, pincode AS value, 'facility' AS part FROM @facility UNION ALL SELECT facility_id, specialty, 'bridge' FROM @bridge""")


def stacked_stats(s, d):
    one = standin(s, d, "orders").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("k"))
    return reshape.stack_rows(one, [
        {"metric": F.lit("rows"), "value": c("n")}, {"metric": F.lit("customers"), "value": c("k")},
        {"metric": F.lit("repeat"), "value": c("n") - c("k")},
    ])


bind("stack_rows", stacked_stats, """
    SELECT 'rows' AS metric, count(*) AS value FROM @orders UNION ALL SELECT 'customers', count(DISTINCT o_custkey) FROM @orders
    UNION ALL SELECT 'repeat', count(*) - count(DISTINCT o_custkey) FROM @orders""")
bind(
    "union_distinct",
    lambda s, d: reshape.distinct_union(standin(s, d, "part").select(c("p_name").alias("v")), standin(s, d, "bridge").select(c("specialty").alias("v"))),
    "SELECT p_name AS v FROM @part UNION SELECT specialty FROM @bridge",
)
bind(
    "set_difference",
    lambda s, d: reshape.set_difference(
        standin(s, d, "part").select(c("p_name").alias("v")), standin(s, d, "dirty_bridge").select(c("specialty").alias("v")), "v"
    ),
    """(SELECT p_name AS value, 'missing' AS side FROM @part WHERE p_name NOT IN (SELECT specialty FROM @dirty_bridge) GROUP BY 1)
       UNION ALL SELECT specialty, 'unexpected' FROM @dirty_bridge WHERE specialty NOT IN (SELECT p_name FROM @part) GROUP BY 1""",
)
