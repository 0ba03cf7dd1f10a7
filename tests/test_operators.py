"""Operators on small frames, against brute force where there is one."""

import random

import pytest
from pyspark.sql import functions as F

from gapwright.operators import aggregates, filters, fuzzy, joins, reshape, upsert
from gapwright.sources import params, publish, tables


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(60)}
    words |= {"a", "", "Ab", "a-b", "a b", "aab", "é", "éa", "aé"}
    rows = [(w, i) for i, w in enumerate(sorted(words))]
    found = fuzzy.near_pairs(spark.createDataFrame(rows, "s string, n int"), "s", "n").collect()
    form = {w: w.lower().replace(" ", "").replace("-", "") for w in words}
    wanted = sorted((a, b) for a in words for b in words if a < b and distance(form[a], form[b]) == 1)
    assert sorted((r["a"], r["b"]) for r in found) == wanted
    usage = dict(rows)
    assert all(r["a_cnt"] == usage[r["a"]] and r["b_cnt"] == usage[r["b"]] for r in found)


def test_near_pairs_plan_has_no_nested_loop(spark):
    df = spark.createDataFrame([("a", 1)], "s string, n int")
    plan = fuzzy.near_pairs(df, "s", "n")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_near_pairs_from_small_files_send_nothing_through_the_driver(spark, tmp_path):
    spark.createDataFrame([(f"name {n}", n) for n in range(50)], "s string, n int").write.parquet(str(tmp_path / "names"))
    found = fuzzy.near_pairs(spark.read.parquet(str(tmp_path / "names")), "s", "n")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_distinct_counts_multiply_no_rows(spark):
    rows = [(1, "a", None), (1, "b", None), (2, "b", None), (None, "b", None)] * 5
    found = aggregates.distinct_counts(spark.createDataFrame(rows, "x int, y string, z string"), "n", {"xs": "x", "ys": "y", "zs": "z"})
    assert found.columns == ["n", "xs", "ys", "zs"] and tuple(found.first()) == (20, 2, 2, 0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "Join" not in plan


def test_median_is_exact(spark):
    rng = random.Random(3)
    groups = {
        "one": [4.0], "two": [1.0, 2.0], "three": [5.0, 1.0, 9.0], "same": [7.0] * 10, "zeros": [0.0, -0.0, 0.0, -0.0],
        "hot": [1.0] * 900 + [2.0] * 450 + [3.0] * 450, "half": [1.0] * 50 + [2.0] * 50,
        "wide": [rng.uniform(-5, 5) for _ in range(2501)], "even": [rng.uniform(0, 1) for _ in range(2500)],
        "close": [1.0 + k * 2.0**-52 for k in range(9)], "powers": [2.0**k for k in range(-1074, 1024)], "negative": [-(2.0**k) * 1.1 for k in range(-1074, 1023)],
        "tiny": [5e-324 * k for k in range(40)], "ends": [float("inf"), 1.0, float("-inf"), -3.0, 1.7976931348623157e308], "any": [rng.gauss(0, 1) * 10 ** rng.randint(-300, 300) for _ in range(801)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("none", None), (None, 3.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    ours = {r["g"]: r["median"] for r in aggregates.median(df, "v", ["g"]).collect()}
    groups[None] = [3.0, 5.0]
    assert set(ours) == set(groups)
    for g, vs in groups.items():
        vs = sorted(vs)
        a, b = vs[(len(vs) - 1) // 2], vs[len(vs) // 2]
        assert ours[g] == (a if a == b else a + (b - a) * 0.5), g
    whole = aggregates.median(df, "v").first()["median"]
    assert whole == df.agg(F.percentile("v", 0.5)).first()[0]
    assert [tuple(r) for r in aggregates.median(df.limit(0), "v").collect()] == [(None,)] and aggregates.median(df.limit(0), "v", ["g"]).count() == 0


def test_scale_never_falls(spark):
    rng = random.Random(8)
    values = [rng.choice([-1, 1]) * rng.random() * 2.0 ** rng.randint(-1074, 1023) for _ in range(3000)]
    values += [s * 2.0**k * m for k in range(-1074, 1023) for s in (1, -1) for m in (1.0, 1 - 2**-53, 1 + 2**-52)] + [0.0, float("inf"), float("-inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", aggregates._scale(F.col("v")).alias("s"))
    got = [(r.v, r.s) for r in df.orderBy("v").collect()]
    assert all(a[1] <= b[1] for a, b in zip(got, got[1:])) and len({s for _, s in got}) < aggregates.CELLS
    for v, s in got:
        if abs(v) > 1e-300 and abs(v) != float("inf") and v == v:
            assert all(abs(w / v - 1) < 0.06 for w, z in got if z == s)


def test_median_orders_counts_only(spark):
    df = spark.createDataFrame([("a", 1.0)], "g string, v double")
    plan = aggregates.median(df, "v", ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") >= 4 and "percentile" not in plan and "Cartesian" not in plan
    # what a window sees has been counted by bucket before
    tree = plan.split("\n")
    for k, line in enumerate(tree):
        if "Window [" in line:
            assert any("Aggregate [" in x for x in tree[k + 1 :])


TEXTS = [
    (1, "a Red Widget unit"), (2, "nothing"), (3, ""), (4, None), (5, "bluebolt"), (6, "redwidget"), (7, "xxblue bo"), (1, "nothing"),
    (None, "red pear"), (2, "red apple"), (2, "red apple"), (3, "value 17 of many"), (8, "日本 ü 🙂🙂x"), (9, "ab\ncd"), (10, " Red"), (11, "q"),
]


@pytest.mark.parametrize("needles", [
    ["red widget", "Blue", " ", None, "a long value that is nowhere"], ["red"], ["e"], ["Q", "本 ü", "🙂🙂", "b\nc"], ["本"], ["zz", "z", ".*"], [], ["a red  w", "many of", "17 of", "d app"], ["o b", "nothing x"],
    [*(f"value {k} of" for k in range(10_000)), "red"],
])
def test_contains_any_equals_brute_force(spark, needles):
    df = spark.createDataFrame(TEXTS, "k int, t string")
    found = joins.contains_any(df, "t", spark.createDataFrame([(n,) for n in needles], "t string"), "t").collect()
    bare = [n.strip(" ").lower() for n in needles if n and n.strip(" ")]
    wanted = [t for t in TEXTS if t[1] is not None and any(n in t[1].lower().strip(" ") for n in bare)]
    assert sorted(map(tuple, found), key=str) == sorted(wanted, key=str)


def test_contains_any_property(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    texts = [(k, word(rng.randint(0, 40))) for k in range(400)]
    needles = {word(rng.randint(1, 9)).strip() for _ in range(60)} - {""}
    needles = {n for n in needles if sum(n in t for _, t in texts) < 60}
    df = spark.createDataFrame(texts, "k int, t string")
    found = {r["k"] for r in joins.contains_any(df, "t", spark.createDataFrame([(n,) for n in needles], "v string"), "v").collect()}
    assert found == {k for k, t in texts if any(n in t.strip() for n in needles)} and 0 < len(found) < 400


def test_contains_any_has_one_plan_of_equi_joins(spark, tmp_path):
    spark.createDataFrame(TEXTS, "k int, t string").write.parquet(str(tmp_path / "t"))
    plans = []
    for n in (1, 3000):
        spark.createDataFrame([(f"value {k} of",) for k in range(n)], "v string").write.parquet(str(tmp_path / f"v{n}"))
        found = joins.contains_any(spark.read.parquet(str(tmp_path / "t")), "t", spark.read.parquet(str(tmp_path / f"v{n}")), "v")
        plans.append(found._jdf.queryExecution().sparkPlan().toString())
    for plan in plans:
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "exists(" not in plan
    # the size of the value table changes which side is sent, not what is done
    assert plans[0].count("Join") == plans[1].count("Join") == 4 and plans[0].count("Generate") == plans[1].count("Generate")


def test_majority_vote_ties_are_alphabetical(spark):
    df = spark.createDataFrame([("s", "B"), ("s", "A"), ("s", "B"), ("s", "A"), ("t", "Z")], "k string, v string")
    assert {tuple(r) for r in aggregates.majority_vote(df, "k", "v").collect()} == {("s", "A"), ("t", "Z")}


def test_dedupe_keeps_the_best(spark):
    df = spark.createDataFrame([("b", "c1", 5), ("a", "c1", 7), ("d", "c2", 4), ("c", "c2", 4), ("e", None, 1)], "id string, cl string, n int")
    best = aggregates.dedupe(df, F.coalesce("cl", "id"), [F.desc("n"), F.asc("id")])
    assert sorted(r["id"] for r in best.collect()) == ["a", "c", "e"]
    assert best.columns == df.columns
    assert "WindowGroupLimit" in best._jdf.queryExecution().executedPlan().toString()


def test_unpivot_scans_once_and_keeps_values(spark, tmp_path):
    df = spark.createDataFrame([("d", "*", 1.5, None), ("e", "(2.5)", None, "x")], "id string, a string, b double, `c d` string")
    df.write.parquet(str(tmp_path / "w"))
    long = reshape.unpivot(spark.read.parquet(str(tmp_path / "w")), ["id"])
    rows = {(r["id"], r["indicator_key"]): (r["indicator_value"], r["is_suppressed"], r["indicator_raw"]) for r in long.collect()}
    assert rows == {
        ("d", "a"): (None, True, "*"), ("d", "b"): (1.5, False, "1.5"), ("d", "c d"): (None, False, None),
        ("e", "a"): (2.5, False, "(2.5)"), ("e", "b"): (None, False, None), ("e", "c d"): (None, False, "x")}
    assert long._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_resolve_columns(spark):
    roles = {"category": "category|specialt", "indicator": "indicator|metric|column"}
    ok = spark.createDataFrame([], "Indicator_Key string, Specialty_Category string, metric_category string")
    assert reshape.resolve_columns(ok, roles) == {"category": "Specialty_Category", "indicator": "Indicator_Key"}
    only = spark.createDataFrame([], "metric_category string")
    with pytest.raises(ValueError, match="indicator"):
        reshape.resolve_columns(only, roles)
    with pytest.raises(ValueError, match="category"):
        reshape.resolve_columns(spark.createDataFrame([], "a string"), roles)


def test_score_range_of_nothing(spark):
    df = spark.createDataFrame([], "x double")
    assert tuple(aggregates.score_range(df, "x").first()) == (0.0, 1.0)


def test_normalize_by_max_of_zeros(spark):
    df = spark.createDataFrame([(0.0,), (0.0,)], "x double")
    assert [r["y"] for r in aggregates.normalize_by_max(df, "x", "y").collect()] == [None, None]


def test_gate_audit_counts_nulls_as_failures(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "x int")
    rules = {"big": F.col("x") > 3, "set": F.col("x").isNotNull()}
    assert {tuple(r) for r in filters.gate_audit(df, rules).collect()} == {("big", 2, 3), ("set", 1, 3), ("any", 2, 3)}
    assert filters.apply_gate(df, rules).count() == 1


def test_drop_sparse(spark):
    df = spark.createDataFrame([("a", None, " "), ("a", "null", "b"), (None, None, None)], "x string, y string, z string")
    assert [tuple(r) for r in filters.drop_sparse(df).collect()] == [("a", "null", "b")]


GAP = "gap_id string, gap_type string, severity string, entity_type string, entity_key string, entity_label string, field_name string, current_value string, suggested_fix string, fix_action string, fix_payload string"


def gap(i, label="new"):
    return (i, "t", "warn", "e", i, label, "f", None, "s", "a", None)


def test_merge_gaps_state_machine(spark):
    target = spark.createDataFrame(
        [gap("g1", "old") + ("dismissed", "mine"), gap("g2", "old") + ("resolved", None), gap("g3", "old") + ("open", None),
         gap("g4", "old") + ("dismissed", None), gap("g5", "old") + ("auto_resolved", "x"), gap("g6", "old") + ("resolved", None)],
        GAP + ", status string, resolution_notes string",
    ).withColumn("updated_at", F.lit("2020-01-01").cast("timestamp"))
    staging = spark.createDataFrame([gap("g1"), gap("g2"), gap("g5"), gap("g9")], GAP)
    now = F.lit("2021-01-01").cast("timestamp")
    merged = upsert.merge_gaps(target, staging, now)
    out = {r["gap_id"]: (r["status"], r["resolution_notes"], r["entity_label"], r["updated_at"].year) for r in merged.collect()}
    note = upsert.AUTO_NOTE
    assert out == {
        "g1": ("dismissed", "mine", "new", 2021), "g2": ("open", None, "new", 2021), "g3": ("auto_resolved", note, "old", 2021),
        "g4": ("dismissed", None, "old", 2020), "g5": ("auto_resolved", "x", "new", 2021), "g6": ("auto_resolved", note, "old", 2021),
        "g9": ("open", None, "new", 2021)}
    again = upsert.merge_gaps(merged, staging, now)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, merged.collect()))
    reopened = upsert.merge_gaps(target, staging, now, reopen=("resolved", "auto_resolved"))
    assert reopened.filter("gap_id = 'g5'").first()["status"] == "open"


def test_overlay_and_update(spark):
    target = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "id string, name string, n int")
    change = spark.createDataFrame([("a", None, 5), ("z", "q", 9)], "id string, name string, n int")
    assert {tuple(r) for r in upsert.overlay(target, change, "id", ["name", "n"]).collect()} == {("a", "x", 5), ("b", "y", 2)}
    assert {tuple(r) for r in upsert.merge_update(target, change, "id", ["name"]).collect()} == {("a", None, 1), ("b", "y", 2)}


def test_seed_if_empty(spark):
    seed, full, none = (spark.createDataFrame(rows, "k string") for rows in ([("s",)], [("t",)], []))
    assert [r["k"] for r in upsert.seed_if_empty(full, seed).collect()] == ["t"]
    assert [r["k"] for r in upsert.seed_if_empty(none, seed).collect()] == ["s"]


def test_apply_string_map(spark):
    df = spark.createDataFrame([("f", " A "), ("f", "a"), ("f", "{x"), ("f", ""), ("f", None), ("g", "b")], "id string, s string")
    m = spark.createDataFrame([("A", "a")], "raw string, canonical string")
    assert {tuple(r) for r in upsert.apply_string_map(df, "s", m).collect()} == {("f", "a"), ("g", "b")}


def test_replace_children(spark):
    children = spark.createDataFrame([(1, 0, "x"), (2, 0, "y")], "p int, pos int, item string")
    asked = spark.createDataFrame([(1, [" a ", "b"]), (3, ["c"])], "p int, items array<string>")
    out = upsert.replace_children(children, asked, "p", "items", "item", "pos")
    assert {tuple(r) for r in out.collect()} == {(1, 0, "a"), (1, 1, "b"), (2, 0, "y"), (3, 0, "c")}


def test_aliases_are_unique_whatever_their_case(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("alias,canonical\nGOA,Goa\nGoa,Goa\n goa ,Goa x\nDelhi,NCT\n")
    rows = tables.load_aliases(spark, str(path), "alias", ["canonical"]).collect()
    assert {tuple(r) for r in rows} == {("GOA", "Goa"), ("DELHI", "NCT")}


def test_scenario_parameter(spark):
    text = '[{"district_name":" a ","state_ut":"s","capability":"x","capacity":-3},{"district_name":"b","state_ut":"s","capacity":null}]'
    rows = params.scenario_rows(params.scenario_frame(spark, text)).collect()
    assert {tuple(r) for r in rows} == {("A", "S", "x", 0, 1), ("B", "S", "", 0, 0)}
    assert params.scenario_frame(spark, "[]").count() == 0


def test_bound_parameters(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    out = params.run_sql(spark, "SELECT :m AS message, x FROM {t} WHERE x >= :least", {"m": "it's", "least": 2}, t=df)
    assert [tuple(r) for r in out.collect()] == [("it's", 2)]
    plan = params.run_sql(spark, "SELECT x FROM {t} WHERE coalesce(:r, '') = coalesce(:r, '')", {"r": "1"}, t=df)
    assert "coalesce" not in plan._jdf.queryExecution().optimizedPlan().toString()


class Stopped(Exception):
    pass


def stop_after(monkeypatch, n):
    """Let the next publish stop after ``n`` of its writes, switches and drops."""
    done = []
    write, switch, clean = publish.write_table, publish._switch, publish._clean

    def counted(step):
        def run(*args):
            if len(done) == n:
                raise Stopped
            done.append(step.__name__)
            return step(*args)

        return run

    monkeypatch.setattr(publish, "write_table", counted(write))
    monkeypatch.setattr(publish, "_switch", counted(switch))
    monkeypatch.setattr(publish, "_clean", counted(clean))
    return done


def tables_like(spark, name):
    return {r["tableName"] for r in spark.sql(f"SHOW TABLES LIKE '{name}*'").collect()}


def test_publish_stopped_at_each_step(spark, monkeypatch):
    def merge(target, staging):
        return upsert.insert_absent(target, staging, ["k"])

    def rows(*pairs):
        return spark.createDataFrame(list(pairs), "k string, v int")

    def seen():
        return {tuple(r) for r in spark.table("pub").collect()}

    publish.publish(spark, "pub", rows(("a", 1)), merge, "k string, v int")
    old = {("a", 1)}
    for n in range(6):
        new = old | {(f"k{n}", n)}
        reader = spark.table("pub")  # began before the refresh
        with monkeypatch.context() as m:
            done = stop_after(m, n)
            try:
                publish.publish(spark, "pub", rows(("a", 9), (f"k{n}", n)), merge, "k string, v int")
            except Stopped:
                pass
        # old or new as a whole, never nothing
        assert seen() == (new if "_switch" in done else old)
        assert {tuple(r) for r in reader.collect()} == old
        publish.recover(spark, "pub", merge)
        staged = "write_table" in done
        assert seen() == (new if staged else old)
        version = publish.current(spark, "pub")
        publish.recover(spark, "pub", merge)
        assert publish.current(spark, "pub") == version and seen() == (new if staged else old)
        assert not [t for t in tables_like(spark, "pub") if "staging" in t] and len(tables_like(spark, "pub")) <= 3
        old = seen()
    spark.sql("DROP VIEW pub")
    for t in tables_like(spark, "pub__v"):
        spark.sql(f"DROP TABLE {t}")


def test_replace_table_reads_itself_and_takes_a_plain_table_over(spark):
    tables.write_table(spark.range(3), "plain")
    for n in (4, 5, 6):
        out = publish.replace_table(spark, "plain", spark.table("plain").union(spark.range(n - 1, n)))
        assert out.count() == spark.table("plain").count() == n
    # a stop between renaming the plain table and showing it again
    tables.write_table(spark.range(2), "other")
    spark.sql("ALTER TABLE other RENAME TO other__v0")
    publish.recover_tables(spark, ["other"])
    assert spark.table("other").count() == 2
    for name in ("plain", "other"):
        spark.sql(f"DROP VIEW {name}")
        for t in tables_like(spark, f"{name}__v"):
            spark.sql(f"DROP TABLE {t}")


def test_write_and_load(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "x int")
    tables.write_table(df, str(tmp_path / "t.parquet"))
    tables.write_table(df, str(tmp_path / "t.parquet"), "append")
    assert tables.load(spark, str(tmp_path), "t")["t"].count() == 2


def test_strict_scenario_rules(spark):
    text = '[{"capability":"Heart centre"},{"capability":"the Cardiovascular Care wing"},{"capability":"x"},{"capability":" "}]'
    labels = spark.createDataFrame([("heart",)], "label string")
    for category, want in ((None, [1, 0, 0, 0]), ("Cardiovascular Care", [1, 1, 0, 0]), ("ALL", [1, 1, 1, 0])):
        rows = params.scenario_rows(params.scenario_frame(spark, text), labels, category).collect()
        hits = {r["capability"]: r["is_match"] for r in rows}
        assert [hits[c] for c in ("Heart centre", "the Cardiovascular Care wing", "x", "")] == want


def test_dedupe_ties_go_to_the_smallest_row(spark):
    rows = [("a", "c", 5, x) for x in ("q", "b", "z")]
    df = spark.createDataFrame(rows, "id string, cl string, n int, other string").repartition(3)
    assert aggregates.dedupe(df, F.col("cl"), [F.desc("n"), F.asc("id")]).first()["other"] == "b"
