"""Vectors for the column functions."""

import pytest
from pyspark.sql import functions as F

from gapwright.functions import fixed, jsontext, keys, numbers, text
from gapwright.plans import inference


def test_strip_markup(apply):
    given = ["*__ophthalmology__*", "**cardiology**", "**__pediatrics__**", "*__**neurology__**__*", "internalMedicine",
             "anesthesia_pain_management", "", None, " * x * "]
    assert apply(text.strip_markup, given) == [
        "ophthalmology", "cardiology", "pediatrics", "neurology", "internalMedicine", "anesthesia_pain_management", "", None, "x"]


def test_nullify(apply):
    assert apply(text.nullify, [" a ", "", "  ", "null", None, "NULL"]) == ["a", None, None, None, None, "NULL"]


def test_postal_code(apply):
    given = ["560001", "560 001", "056001", "56001", "PIN-110011", None, "", "5600012"]
    assert apply(numbers.postal_code, given) == ["560001", "560001", None, None, "110011", None, None, None]


def test_extract_int(apply):
    assert apply(numbers.extract_int, ["12", "about 40 beds", "3.5", "", None, "none"]) == [12, 40, None, None, None, None]


def test_standardize_enum(apply):
    out = apply(lambda c: text.standardize_enum(c, fixed.OPERATOR_TYPES, "unknown"), [" Government ", "PRIVATE", "trust", None, "public"])
    assert out == ["public", "private", "unknown", "unknown", "public"]


def test_suppressed_number(apply):
    out = apply(numbers.suppressed_number, ["*", " * ", "(12.3)", "45.6", "", None, "n/a"])
    assert [tuple(x) for x in out] == [
        (None, True), (None, True), (12.3, False), (45.6, False), (None, False), (None, False), (None, False)]


def test_udf_twin_agrees(spark):
    df = spark.createDataFrame([("*",), ("(12.3)",), ("45.6",), ("",), (None,), ("x",), (" 7 ",)], "x string")
    rows = df.select(inference.parse_udf()("x").alias("u"), numbers.suppressed_number(F.col("x")).alias("b")).collect()
    assert all(row["u"] == row["b"] for row in rows)


@pytest.mark.parametrize("given, expected", [
    ((19.0, 72.8), (19.0, 72.8, True)), ((72.8, 19.0), (19.0, 72.8, True)), ((0.0, 0.0), (None, None, False)),
    ((None, 72.8), (None, None, False))])
def test_coord_repair(spark, given, expected):
    df = spark.createDataFrame([given], "lat double, lon double")
    assert tuple(df.select(numbers.coord_repair(F.col("lat"), F.col("lon")).alias("p")).first()["p"]) == expected


def test_unwrap_json_pair(apply):
    given = ['{"cardiology":"cardiology"}', '{"a":"b"}', "ent", None, '{"a" : "a"}']
    assert apply(jsontext.unwrap_json_pair, given) == ["cardiology", '{"a":"b"}', "ent", None, "a"]


def test_keyword_category(apply):
    rules = lambda c: text.classify(c, fixed.LABEL_CATEGORY_RULES, fixed.DEFAULT_CATEGORY)
    out = apply(rules, ["orthodontics", "xyz", "Cardiology", "tb clinic", "Orthopedics", "Women"])
    assert out == ["Dental & Oral Health", fixed.DEFAULT_CATEGORY, "Cardiovascular Care", "Respiratory & Pulmonary Care",
                   "Orthopedics & Musculoskeletal Care", "Women's Health"]


def test_plain_alternatives_are_the_regular_expression(spark):
    words = ["hemato", "cardiac heart", "ent", "lab x", "tb", "tb ", "implant", "pain management", "fp_x", "anc_visits", "zzz"]
    df = spark.createDataFrame([(w,) for w in words], "x string")
    for pattern, _ in fixed.LABEL_CATEGORY_RULES + fixed.INDICATOR_CATEGORY_RULES:
        rows = df.select(text.matches(F.col("x"), pattern).alias("a"), F.col("x").rlike(pattern).alias("b")).collect()
        assert all(row["a"] == row["b"] for row in rows), pattern


def test_indicator_category(apply):
    rules = lambda c: text.classify(c, fixed.INDICATOR_CATEGORY_RULES, fixed.DEFAULT_CATEGORY)
    out = apply(rules, ["child_u5_overweight_pct", "w15_high_bp_pct", "fp_any_method", "alcohol_use", "w_obese_pct", "roads"])
    assert out == ["Pediatrics & Child Health", "Cardiovascular Care", "Women's Health", "Mental Health & Behavioral Health",
                   "Endocrine & Metabolic Care", fixed.DEFAULT_CATEGORY]


def test_spelling_rules(apply):
    out = apply(lambda c: text.apply_rules(c, fixed.SPELLING_RULES), ["Opthamology", "opthalmology", "PERIDONTICS", "laproscopy", "ent"])
    assert out == ["ophthalmology", "ophthalmology", "periodontics", "laparoscopy", "ent"]


@pytest.mark.parametrize("district, state, key", [
    ("Bangalore", "Karnataka", "BENGALURU URBAN__KARNATAKA"), ("St. X", "Jammu and Kashmir", "ST X__JAMMU & KASHMIR"),
    (" Muktsar ", "Punjab", "SRI MUKTSAR SAHIB__PUNJAB"), ("New  Delhi", "Delhi", "NEW DELHI__NCT OF DELHI")])
def test_region_key(spark, district, state, key):
    df = spark.createDataFrame([(district, state)], "d string, s string")
    assert df.select(keys.region_key(F.col("d"), F.col("s"))).first()[0] == key


def test_region_label(apply):
    out = apply(keys.region_label, ["NEW DELHI__NCT OF DELHI", "ALONE", "A B__C"])
    assert [tuple(x) for x in out] == [("New Delhi", "NCT of Delhi"), ("ALONE", ""), ("A B", "C")]


def test_display_text(apply):
    given = ['{"a":"x"}', '{"k": 69}', '{"a":" "}', '{"a":"1","b":"2"}', "plain", None, "[1]"]
    assert apply(jsontext.display_text, given) == ["x", "k", "a", '{"a":"1","b":"2"}', "plain", "", "[1]"]


def test_payload_keeps_ids_verbatim(apply):
    given = ['{"facility_id":"*  __Hematology","n":5}', "not json", None, "[1]"]
    out = apply(jsontext.parse_payload, given)
    assert out == [{"facility_id": "*  __Hematology", "n": "5"}, {}, {}, {}]


def test_text_to_list_and_back(apply):
    given = ["cardiology, **ent**", "", '["a"]', " , "]
    assert apply(jsontext.text_to_list, given) == ['["cardiology","ent"]', "[]", '["a"]', "[]"]
    assert apply(jsontext.list_text, ['["*__a__*","{x","b"]', "**c**", '{"a":"b"}', None, "[]"]) == ["a, b", "c", "", "", ""]


def test_label_fallback(spark):
    df = spark.createDataFrame(
        [(" A ", "d", "k"), ("null", " d ", "k"), (None, None, "k"), ("", " ", "k"), (None, "x" * 200, "k")],
        "n string, d string, k string")
    out = [r[0] for r in df.select(text.label_fallback(F.col("n"), F.col("d"), F.col("k"))).collect()]
    assert out == ["A", "d", "k", "k", "x" * 200]


def test_normalize_quotes(apply):
    assert apply(text.normalize_quotes, [" Women’s Health "]) == ["Women's Health"]


def test_stable_round(apply):
    assert apply(lambda c: numbers.stable_round(c, 2), [10.015, 10.014999999999999, -10.015, None], "double") == [10.02, 10.02, -10.02, None]


def test_parse_answer(spark):
    labels = F.array(F.lit("ENT"), F.lit("Cardiology"))
    df = spark.createDataFrame([("```text\ncardiology\n```",), ("I think ent fits",), ("other",), ("",)], "x string")
    assert [r[0] for r in df.select(inference.parse_answer(F.col("x"), labels)).collect()] == ["Cardiology", "ENT", "other", None]
