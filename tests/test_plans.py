"""Jobs on small frames: the decisions that are easy to get wrong."""

from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from gapwright.functions.fixed import BRIDGE_SCHEMA, FACILITY_SCHEMA, GAP_SCHEMA
from gapwright.plans import curation, exploration, inference, quality, scoring, vocabulary
from gapwright.sources.params import scenario_frame, scenario_rows
from gapwright.sources.tables import alias_table, empty

LONG = "district_id string, district_name string, state_ut string, indicator_key string, indicator_value double, is_suppressed boolean"


@pytest.fixture(scope="module")
def states(spark):
    df = spark.createDataFrame([("GOA", "Goa"), ("Goa", "Goa"), ("Kerala", "Kerala")], "alias string, canonical_state_ut string")
    return alias_table(df, "alias", ["canonical_state_ut"])


@pytest.fixture(scope="module")
def directory(spark, states):
    postal = spark.createDataFrame(
        [(500001, " North ", "GOA"), (500001, "North", "Goa"), (500002, "North", "GOA"), (500002, "South", "GOA"), (500003, "Old", "Kerala"), (None, "X", "GOA")],
        "pincode bigint, district string, statename string")
    alias = alias_table(
        spark.createDataFrame([("OLD", "New", "Kerala")], "alias string, canonical_district string, canonical_state_ut string"),
        "alias", ["canonical_district"], also=["canonical_state_ut"])
    return curation.geo_directory(postal, states, alias)


def test_directory_flags_ambiguous_codes(directory):
    assert {tuple(r) for r in directory.collect()} == {
        ("500001", "North", "Goa", False), ("500002", "North", "Goa", True), ("500003", "New", "Kerala", False)}


def test_match_confidence_reaches_every_tier(spark, directory, states):
    places = curation.geography(spark.createDataFrame([("North", "GOA"), ("New", "Kerala")], "district_name string, state_ut string"), states)
    rows = spark.createDataFrame(
        [("a", "500001", "goa"), ("b", "500002", None), ("c", None, " GOA"), ("d", "999999", "nowhere"), ("e", "500003", None)],
        "facility_id string, pincode string, state_ut_raw string")
    out = {r["facility_id"]: (r["join_confidence"], r["district_name"]) for r in curation.geo_bridge(rows, directory, states, places).collect()}
    assert out == {"a": ("high", "North"), "b": ("medium", "North"), "c": ("low", None), "d": ("unmatched", None), "e": ("high", "New")}


def test_survey_sizes_stay_in_the_long_table(spark, states):
    wide = spark.createDataFrame([(" North", "GOA", 40.0, "*")], "district_name string, state_ut string, households_surveyed double, x_pct string")
    rows = {r["indicator_key"]: (r["indicator_value"], r["is_suppressed"], r["state_ut"]) for r in curation.health_indicator(wide, states).collect()}
    assert rows == {"households_surveyed": (40.0, False, "Goa"), "x_pct": (None, True, "Goa")}


@pytest.fixture(scope="module")
def tables(spark):
    long = spark.createDataFrame(
        [("i1", "A", "S", "households_surveyed", 100.0, False), ("i1", "A", "S", "p", 50.0, False), ("i1", "A", "S", "q", 20.0, False),
         ("i2", "B", "S", "households_surveyed", 50.0, False), ("i2", "B", "S", "p", 10.0, False), ("i2", "B", "S", "q", None, True),
         ("i3", "C", "S", "households_surveyed", 10.0, False), ("i3", "C", "S", "p", None, True), ("i3", "C", "S", "r", 99.0, False)],
        LONG)
    imap = spark.createDataFrame([("p", "Heart"), ("q", "Heart"), ("q", "Skin"), ("r", "Skin")], "indicator_key string, specialty_category string")
    facility = spark.createDataFrame(
        [("f1", " b ", "s", 0), ("f2", "B", "S", 30), ("f3", "A", "S", 10), ("f4", None, "S", 9)],
        "facility_id string, district_name string, state_ut string, bed_count int")
    bridge = spark.createDataFrame([("f1", "ecg"), ("f1", "echo"), ("f2", "skin"), ("f3", "skin"), ("f4", "ecg")], "facility_id string, specialty string")
    mapping = spark.createDataFrame([("ecg", "Heart"), ("echo", "Heart"), ("skin", "Skin")], "specialties string, category string")
    return long, imap, facility, bridge, mapping


def by_district(df):
    return {r["district_name"]: r.asDict() for r in df.collect()}


def test_gap_core_formulas(tables):
    out = by_district(scoring.gap_core(*tables, "Heart"))
    assert set(out) == {"A", "B"}  # C has no usable demand
    a, b = out["A"], out["B"]
    assert (a["demand_pct"], a["demand_burden"], a["demand_norm"], a["expected_beds"]) == (35.0, 35.0, 1.0, 175.0)
    assert (a["category_bed_capacity"], a["total_facilities"], a["gap_flag"]) == (0, 1, "no_supply")
    assert (a["gap_score"], a["desert_risk_score"], a["confidence_score"]) == (1.0, 1.0, 0.8)
    # the default of 25 beds once per facility, however many labels match
    assert (b["category_bed_capacity"], b["category_facilities"], b["total_facilities"]) == (25, 1, 2)
    assert b["supply_norm"] == 1.0 and b["gap_flag"] == "low_demand_high_supply"
    assert b["confidence_score"] == 0.5


def test_empty_scenario_is_the_baseline(spark, tables):
    base = scoring.gap_core(*tables, "Heart")
    none = scoring.gap_core(*tables, "Heart", scenario_rows(scenario_frame(spark, "[]")))
    assert sorted(map(repr, base.collect())) == sorted(map(repr, none.select(*base.columns).collect()))
    assert all(r["delta_beds"] == 0 and r["delta_risk"] == 0 for r in scoring.scenario_compare(base, none).collect())
    extent = scoring.delta_extent(scoring.scenario_compare(base, none)).first()
    assert tuple(extent) == (-0.01, 0.01)
    assert all(r["improved"] is None for r in scoring.summary_cards(base, none).collect())


def test_scenario_delta_is_the_comparison(spark, tables):
    texts = ["[]", '[{"district_name":"a","state_ut":"S","capability":"heart","capacity":0},{"district_name":"B","state_ut":"S","capability":"x","capacity":50},{"district_name":"zz","state_ut":"S","capability":"x","capacity":5}]']
    for text in texts:
        rows = scenario_rows(scenario_frame(spark, text))
        for category in ("Heart", "ALL"):
            state = scoring.gap_state(*tables, category)
            want = scoring.scenario_compare(scoring.gap_core(*tables, category), scoring.gap_core(*tables, category, rows))
            got = scoring.scenario_delta(state, rows)
            assert got.columns == want.columns
            assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_scores_read_the_facts_once_and_run_nothing_early(spark, tables, tmp_path):
    stored = []
    for k, t in enumerate(tables):
        t.write.parquet(str(tmp_path / f"t{k}"))
        stored.append(spark.read.parquet(str(tmp_path / f"t{k}")))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "")
    rows = scenario_rows(scenario_frame(spark, "[]"))
    core, delta = scoring.gap_core(*stored, "Heart"), scoring.scenario_delta(scoring.gap_state(*stored, "Heart"), rows)
    table = scoring.gap_table(core)
    assert not tracker.getJobIdsForGroup("building")
    spark.sparkContext.setJobGroup("other", "")
    for df in (table, delta):
        df.collect()
        skip, scans = None, 0
        for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
            depth = len(line) - len(line.lstrip(" :+-|"))
            skip = None if skip is not None and depth < skip else skip
            if skip is None and "== Initial Plan ==" in line:
                skip = depth - 3  # what was planned at first stands a level deeper
            scans += skip is None and "FileScan" in line and "bed_count" in line
        assert scans == 1


def test_scenario_adds_supply(spark, tables):
    text = '[{"district_name":"a","state_ut":"S","capability":"heart","capacity":0},{"district_name":"A","state_ut":"S","capability":"","capacity":50}]'
    scen = scoring.gap_core(*tables, "Heart", scenario_rows(scenario_frame(spark, text)))
    a = by_district(scen)["A"]
    assert (a["total_facilities"], a["category_facilities"], a["category_bed_capacity"]) == (3, 1, 1)


def test_all_categories(tables):
    out = by_district(scoring.gap_core(*tables))
    assert set(out) == {"A", "B", "C"}
    assert out["A"]["demand_pct"] == 35.0  # q is mapped twice and counts once
    assert out["B"]["category_bed_capacity"] == 55


def test_risk_tiers_when_all_are_equal(tables):
    core = scoring.gap_core(*tables, "Heart").filter("district_name = 'B'")
    row = scoring.risk_tiers(core).first()
    assert (row["desert_risk_norm"], row["risk_tier"], row["confidence_level"]) == (0.0, "low", "medium")


def test_delta_extent_scales_the_peak(spark):
    df = spark.createDataFrame([(0.4,), (-0.1,)], "delta_risk double")
    assert scoring.delta_extent(df).first()["max_extent"] == pytest.approx(0.34)


def test_demand_is_ranked_with_ties_by_name(tables):
    rows = exploration.demand_ranked(tables[0], tables[1]).collect()
    assert [(r["district_name"], r["category"], r["category_rank_in_district"]) for r in rows if r["district_name"] == "A"] and {
        (r["district_name"], r["category"], r["category_rank_in_district"]) for r in rows
    } == {("A", "Heart", 1), ("A", "Skin", 2), ("B", "Heart", 1), ("C", "Skin", 1)}


def vocab(spark, labels, mapping=()):
    bridge = spark.createDataFrame([(f"f{i}", x) for i, x in enumerate(labels)], BRIDGE_SCHEMA)
    m = spark.createDataFrame(list(mapping), "specialties string, category string")
    facility = bridge.select("facility_id").distinct().withColumn("specialties_raw", F.lit("[]"))
    return vocabulary.Vocabulary(bridge, m, facility)


@pytest.mark.parametrize("counts, expected", [
    ({"cardiolgy": 3, "cardiology": 40}, {"cardiolgy": "cardiology"}),
    ({"cardiolgy": 30, "cardiology": 400}, {}),
    ({"cardiolgy": 10, "cardiology": 40}, {}),
    ({"hematology": 1, "hepatology": 40}, {}),
    ({"pedology": 1, "paedology": 40}, {}),
    ({"gymx": 1, "gym": 10, "gymxx": 30}, {"gymx": "gymxx"}),
    ({"Opthalmology": 2}, {"Opthalmology": "ophthalmology"})])
def test_typo_map(spark, counts, expected):
    v = vocab(spark, [x for x, n in counts.items() for _ in range(n)])
    rows = vocabulary.typo_map(v.bridge, vocabulary.all_labels(v.bridge, v.mapping)).collect()
    assert {r["raw"]: r["canonical"] for r in rows} == expected


def test_vocabulary_rewrites_all_three_tables(spark):
    v = vocab(spark, ["**ent**", "ent", "{x", "skin"], [("__ent__", "A"), ("ent", "B"), ("*ent*", "A"), ("[z", "C")])
    new, renames = vocabulary.clean_markup(v)
    assert {r["raw"] for r in renames.collect()} == {"**ent**", "__ent__", "*ent*"}
    assert {tuple(r) for r in new.bridge.collect()} == {("f0", "ent"), ("f1", "ent"), ("f3", "skin")}
    assert {tuple(r) for r in new.mapping.collect()} == {("ent", "A")}
    assert dict(map(tuple, new.facility.collect()))["f0"] == '["ent"]' and dict(map(tuple, new.facility.collect()))["f2"] == "[]"


def test_case_variants_take_the_commonest(spark):
    v = vocab(spark, ["Lab", "lab", "lab", "ENT", "Ent"])
    _, renames = vocabulary.normalize_case(v)
    assert {tuple(r) for r in renames.collect()} == {("Lab", "lab"), ("lab", "lab"), ("ENT", "ENT"), ("Ent", "ENT")}


def test_unmapped_labels_reuse_categories(spark):
    v = vocab(spark, ["ENT", "cardiology", "zzz", "{x", "known"], [("ent", "Ears"), ("known", "K")])
    rows = vocabulary.map_unmapped_labels(v.bridge, v.mapping).collect()
    assert {tuple(r) for r in rows} == {("ENT", "Ears"), ("cardiology", "Cardiovascular Care"), ("zzz", "Primary Care & General Medicine")}


@pytest.fixture(scope="module")
def model(spark, tables):
    long, imap, _, bridge, mapping = tables
    none = {"operator_type": "private", "join_confidence": "high", "coord_valid": True}
    rows = [("f1", "One", "i1", "500001", "clinic"), ("f2", None, "i2", None, "7"), ("f9", "null", None, "500001", "clinic")]
    facility = spark.createDataFrame(rows, "facility_id string, facility_name string, district_id string, pincode string, facility_type string")
    full = empty(spark, FACILITY_SCHEMA).unionByName(
        facility.select("*", *[F.lit(v).alias(k) for k, v in none.items()]), allowMissingColumns=True)
    raw = spark.createDataFrame([("f9", " Place nine ")], "facility_id string, description string")
    orphans = imap.unionByName(spark.createDataFrame([("gone", "B"), ("gone", "A")], "indicator_key string, specialty_category string"))
    return quality.Model(full, long, bridge, mapping.filter("specialties <> 'echo'"), orphans, raw)


def now():
    return F.lit("2024-01-01").cast("timestamp")


def test_gaps_have_unique_ids_and_labels(model):
    rows = quality.dq_gaps(model).collect()
    assert len({r["gap_id"] for r in rows}) == len(rows)
    found = {(r["gap_type"], r["entity_key"], r["entity_label"]) for r in rows}
    assert found == {
        ("unmapped_specialty", "echo", "echo"), ("orphan_indicator_mapping", "gone", "gone"),
        ("unmapped_indicator", "households_surveyed", "households_surveyed"),
        ("facility_without_specialty", "f9", "Place nine"), ("missing_pincode", "f2", "f2"), ("invalid_facility_type", "f2", "f2")}
    bodies = {r["gap_type"]: r["fix_payload"] for r in rows}
    assert bodies["missing_pincode"] == '{"facility_id":"f2","field_name":"pincode","current_value":""}'


def test_metrics_of_empty_tables_do_not_fail(spark, model):
    m = quality.Model(*[df.limit(0) for df in (model.facility, model.long, model.bridge, model.mapping, model.indicator_bridge)])
    rows = {r["metric_key"]: r for r in quality.dq_metrics(m, now()).collect()}
    assert len(rows) == 14 and rows["facility_district_match_pct"]["actual_value"] is None
    assert rows["facility_district_match_pct"]["status"] == "warn" and rows["facility_duplicate_ids"]["status"] == "pass"


def test_refresh_settles_what_it_can(spark, model):
    new, metrics, gaps = quality.dq_refresh(model, empty(spark, GAP_SCHEMA), now())
    kinds = {r["gap_type"] for r in gaps.collect()}
    assert kinds == {"orphan_indicator_mapping", "facility_without_specialty", "missing_pincode", "invalid_facility_type"}
    assert {r["metric_key"]: r["actual_value"] for r in metrics.collect()}["unmapped_specialties"] == 0
    again = quality.dq_refresh(new, gaps, now())[2]
    assert sorted(map(repr, again.collect())) == sorted(map(repr, gaps.collect()))


@pytest.mark.parametrize("field, given, value, ok", [
    ("pincode", "012345", "012345", False), ("pincode", " 560001 ", "560001", True), ("operator_type", "ngo", "ngo", False),
    ("bed_count", "12x", "12", True), ("bed_count", "x", None, False), ("facility_name", "  ", "", False),
    ("specialties_raw", "a, **b**", '["a","b"]', True), ("specialties_raw", " ", "[]", False), ("owner", "x", "x", False)])
def test_edit_validation(spark, field, given, value, ok):
    df = spark.createDataFrame([("f", field, given)], "facility_id string, field_name string, corrected_value string")
    row = quality.checked_edits(df).first()
    assert (row["value"], row["error"] is None) == (value, ok)


def test_resolutions(spark, model):
    gaps = quality.dq_gaps(model).select("*", F.lit("open").alias("status"), F.lit(None).cast("string").alias("resolution_notes"), now().alias("updated_at"))
    ids = {r["gap_type"]: r["gap_id"] for r in gaps.collect()}
    rows = [
        (1, ids["unmapped_specialty"], "add_specialty_category_mapping", '{"specialty":"echo","category":"Heart"}'),
        (2, ids["unmapped_specialty"], "add_specialty_category_mapping", '{"specialty":"echo","category":"Later"}'),
        (3, ids["orphan_indicator_mapping"], "delete_health_indicator_specialty", '{"indicator_key":"gone","specialty_category":"A"}'),
        (4, "?", "add_health_indicator_specialty", '{"indicator_key":"gone","specialty_category":"A"}'),
        (5, "?", "delete_health_indicator_specialty", '{"indicator_key":"gone","specialty_category":"A"}'),
        (6, ids["facility_without_specialty"], "add_facility_specialty", '{"facility_id":"f1","specialty":"skin, *ecg*"}'),
        (7, ids["missing_pincode"], "update_facility_field", '{"field_name":"pincode","corrected_value":"560001"}'),
        (8, "?", "update_facility_field", '{"facility_id":"nobody","field_name":"pincode","corrected_value":"560001"}'),
        (9, ids["invalid_facility_type"], "dismiss_only", "{}"),
        (10, "?", "explode", "{}"), (11, "?", "add_specialty_category_mapping", "broken")]
    actions = spark.createDataFrame(rows, "action_id int, gap_id string, fix_action string, payload string").withColumn("made_at", now())
    new, after, rejected = quality.resolve_actions(model, gaps, actions, now())
    assert ("echo", "Heart") in {tuple(r) for r in new.mapping.collect()} and new.mapping.filter("specialties = 'echo'").count() == 1
    assert {r["specialty_category"] for r in new.indicator_bridge.filter("indicator_key = 'gone'").collect()} == {"B"}
    assert {r["specialty"] for r in new.bridge.filter("facility_id = 'f9'").collect()} == {"skin", "ecg"}
    assert {r["specialty"] for r in new.bridge.filter("facility_id = 'f1'").collect()} == {"ecg", "echo"}
    assert new.facility.filter("facility_id = 'f2'").first()["pincode"] == "560001"
    assert after.filter("status = 'dismissed'").first()["gap_id"] == ids["invalid_facility_type"]
    assert {(r["action_id"], r["error"]) for r in rejected.collect()} == {
        (8, "facility not found"), (10, "unsupported fix_action"), (11, "specialty and category are required")}


def test_edits_last_one_wins(spark, model):
    edits = spark.createDataFrame(
        [(1, "f1", "facility_name", "A", "2024-01-01"), (2, "f1", "facility_name", "B", "2024-01-02"), (3, "f1", "bed_count", "7", "2024-01-01"),
         (4, "zz", "bed_count", "7", "2024-01-01")],
        "edit_id int, facility_id string, field_name string, value string, made_at string")
    corrections = spark.createDataFrame([("f1", "old", 3), ("f5", "keep", 4)], "facility_id string, facility_name string, doctors_count int")
    out = quality.apply_edits(replace(model, corrections=corrections), edits)
    row = out.facility.filter("facility_id = 'f1'").first()
    assert (row["facility_name"], row["bed_count"]) == ("B", 7)
    assert {tuple(r) for r in out.corrections.collect()} == {("f1", "B", 3), ("f5", "keep", 4)}


def test_token_overlap_picks_the_best_label(spark):
    missing = spark.createDataFrame([(1, "the heart and skin, heart"), (2, "skin care"), (3, "none at all")], "k int, context_text string")
    labels = spark.createDataFrame([("heart care",), ("skin care",), ("{x",)], "label string")
    rows = inference.infer_labels(missing, labels, "k").collect()
    assert {(r["k"], r["inferred_label"]) for r in rows} == {(1, "heart care"), (2, "skin care"), (3, None)}


def test_no_label_is_cut_off(spark):
    labels = spark.createDataFrame([(f"a{k:04d} kind",) for k in range(900)] + [("zebra care",)], "label string")
    missing = spark.createDataFrame([(1, "the zebra"), (1, "the zebra"), (2, "A0899 kind"), (None, None)], "k int, context_text string")
    rows = [(r["k"], r["inferred_label"]) for r in inference.infer_labels(missing, labels, "k").collect()]
    assert sorted(rows, key=str) == sorted([(1, "zebra care"), (1, "zebra care"), (2, "a0899 kind"), (None, None)], key=str)


def test_suggestions_ask_only_where_the_classifier_has_none(spark):
    missing = spark.createDataFrame([(1, "heart here"), (2, "nothing"), (3, "quiet")], "k int, context_text string")
    labels = spark.createDataFrame([("heart care",), ("skin care",)], "label string")

    def answer(prompt):
        return F.when(prompt.endswith("nothing"), "```\nSKIN CARE\n```").when(prompt.endswith("here"), "wrong")

    rows = inference.suggest_labels(missing, labels, "k", answer).collect()
    assert {(r["k"], r["suggested_label"], r["source"]) for r in rows} == {(1, "heart care", "classify"), (2, "skin care", "query"), (3, None, None)}


def test_words_are_those_of_any_alphabet(spark):
    missing = spark.createDataFrame([(1, "Müller, Zahnärztin"), (2, "клиника зрения"), (3, "眼科 病院"), (4, "rztin")], "k int, context_text string")
    labels = spark.createDataFrame([("zahnärztin",), ("зрения",), ("病院",), ("m",)], "label string")
    rows = inference.infer_labels(missing, labels, "k").collect()
    assert {(r["k"], r["inferred_label"]) for r in rows} == {(1, "zahnärztin"), (2, "зрения"), (3, "病院"), (4, None)}


def test_a_model_is_loaded_once_and_asked_once_per_text(spark, tmp_path):
    log = str(tmp_path / "log")

    def load():
        open(log, "a").write("load\n")

        def model(texts, labels):
            open(log, "a").write(f"ask {len(texts)}\n")
            return [labels[len(t) % len(labels)] if t else None for t in texts]

        return model

    texts = [("aa",), ("b",), (None,), ("aa",), ("",)] * 200
    df = spark.createDataFrame(texts, "t string").coalesce(1)
    label = inference.classify_udf(load, ["even", "odd"], f"test {log}")
    for _ in range(2):
        got = [r[0] for r in df.select(label("t")).collect()]
        assert got == ["even", "odd", None, "even", None] * 200
    lines = open(log).read().split()
    assert lines.count("load") == 1 and lines == ["load", "ask", "3", "ask", "3"]


def test_each_context_is_asked_about_once(spark):
    missing = spark.createDataFrame([(k, f"nothing {k % 3}") for k in range(30)] + [(99, None)], "k int, context_text string")
    labels = spark.createDataFrame([(f"kind {k:03d}",) for k in range(600)], "label string")
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def answer(prompt):
        asked.add(1)
        return "Kind 007" if prompt.endswith("0") and "kind 399" in prompt and "kind 400" not in prompt else "kind 500 " + prompt[-1]

    rows = inference.suggest_labels(missing, labels, "k", answer).collect()
    said = {r["k"]: (r["suggested_label"], r["source"]) for r in rows}
    assert asked.value == 3 and len(rows) == 31 and said[99] == (None, None)
    assert said[0] == ("kind 007", "query") and said[1] == ("kind 500 1", "query")


def test_rows_that_ask_nothing_do_not_meet_in_one_task(spark):
    missing = spark.createDataFrame([(k, "heart here") for k in range(400)] + [(k, None) for k in range(400, 800)] + [(800, "quiet")], "k int, context_text string")
    labels = spark.createDataFrame([("heart care",)], "label string")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = inference.suggest_labels(missing, labels, "k", lambda p: F.lit("heart care")).withColumn("at", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(r["k"], r["source"]) for r in found} == {(k, "classify" if k < 400 else "query" if k == 800 else None) for k in range(801)}
    assert max(Counter(r["at"] for r in found).values()) < 250


def test_demo_row_is_added_once(spark, model):
    once = curation.anchor_row(model.facility, model.long, {"facility_id": "demo"}, "737101")
    assert once.count() == 4 and once.filter("facility_id = 'demo'").first()["pincode"] == "500001"
    assert curation.anchor_row(once, model.long, {"facility_id": "demo"}, "737101").count() == 4


def test_one_category_has_one_spelling(spark):
    imap = spark.createDataFrame([("a ", "Women’s Health"), ("a", "Women's Health"), (" ", "x"), ("b", None)], "indicator_key string, specialty_category string")
    assert [tuple(r) for r in exploration.clean_mapping(imap).collect()] == [("a", "Women's Health")]


def test_a_code_without_state_takes_the_state_of_the_row(spark):
    directory = spark.createDataFrame([("500001", "North", None, False), ("500002", "North", "Goa", True)], "pincode string, district_name string, state_ut string, pincode_is_ambiguous boolean")
    states = spark.createDataFrame([("GOA", "Goa"), ("KERALA", "Kerala")], "alias_key string, canonical_state_ut string")
    places = spark.createDataFrame([("d1", "North", "Goa")], "district_id string, district_name string, state_ut string")
    rows = spark.createDataFrame([(1, "500001", "goa"), (2, "500001", "Kerala"), (3, "500001", "?"), (4, "500002", "?"), (5, None, "Goa")], "k int, pincode string, state_ut_raw string")
    found = curation.geo_bridge(rows, directory, states, places).orderBy("k").collect()
    assert [(r["district_id"], r["join_confidence"]) for r in found] == [("d1", "high"), (None, "low"), (None, "unmatched"), ("d1", "medium"), (None, "low")]
