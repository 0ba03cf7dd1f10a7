"""Edits as a stream, and tables published by buckets."""

import random

import pytest
from pyspark.sql import functions as F

from gapwright.bindings.standins import standin
from gapwright.functions.fixed import GAP_SCHEMA
from gapwright.operators import upsert
from gapwright.plans import quality
from gapwright.sources import publish
from gapwright.streaming import edits

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "edit_id long, made_at timestamp, facility_id string, field_name string, corrected_value string"


@pytest.fixture(autouse=True)
def clean(spark):
    yield
    for t in spark.sql("SHOW TABLES LIKE 'st_*'").collect():
        kind = "VIEW" if publish._told(spark, t.tableName) else "TABLE"
        spark.sql(f"DROP {kind} IF EXISTS {t.tableName}")


def feed(spark):
    return standin(spark, FOLDER, "edits").select("edit_id", F.col("made_at").cast("timestamp").alias("made_at"), "facility_id", "field_name", "corrected_value")


def wanted(spark, rows):
    ok, bad = quality.validate_edits(rows)
    last = upsert.last_edits(ok.select("facility_id", "field_name", "value", "made_at", "edit_id"), ["facility_id", "field_name"], [F.desc("made_at"), F.desc("edit_id")])
    return sorted(map(tuple, last.collect())), {r.edit_id for r in bad.collect()}


@pytest.mark.parametrize("files", [1, 7])
def test_any_split_gives_the_same_state(spark, tmp_path, files):
    rows = feed(spark)
    source, checkpoint, target = str(tmp_path / "in"), str(tmp_path / "check"), f"st_split{files}"
    # files in no order of time
    rows.repartition(files, F.xxhash64("edit_id")).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(source)
    edits.run(stream, target, checkpoint, quality.validate_edits).awaitTermination()
    state, refused = wanted(spark, rows)
    assert sorted(map(tuple, edits.latest(spark, target).collect())) == state
    assert {r.edit_id for r in spark.table(f"{target}_rejected").collect()} == refused and refused


def test_stop_between_and_inside_batches(spark, tmp_path, monkeypatch):
    """Stopped before each write, switch and drop of a batch, and run again."""
    rows = feed(spark).limit(120)
    source, checkpoint, target = str(tmp_path / "in"), str(tmp_path / "check"), "st_stopped"
    rows.repartition(4).write.parquet(source)

    def stream():
        frame = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        edits.run(frame, target, checkpoint, quality.validate_edits).awaitTermination()

    switch, clean, calls, stops = publish._switch, publish._clean, [], [1, 3, 4, 6, 9]

    def failing(step):
        def run(*args):
            calls.append(step.__name__)
            if stops and len(calls) == stops[0]:
                stops.pop(0)
                raise RuntimeError("stopped on purpose")
            return step(*args)

        return run

    monkeypatch.setattr(publish, "_switch", failing(switch))
    monkeypatch.setattr(publish, "_clean", failing(clean))
    seen = []
    for _ in range(8):
        try:
            stream()
            break
        except Exception as e:
            assert "stopped on purpose" in str(e)
            seen.append(spark.table(target).count() if spark.catalog.tableExists(target) else 0)
    assert not stops and len(seen) == 5 and seen == sorted(seen)
    state, refused = wanted(spark, rows)
    assert sorted(map(tuple, edits.latest(spark, target).collect())) == state
    assert {r.edit_id for r in spark.table(f"{target}_rejected").collect()} == refused


def test_a_batch_counts_once_and_late_edits_lose(spark):
    def batch(*rows):
        return spark.createDataFrame([(i, None, f, n, v) for i, _, f, n, v in rows], SCHEMA).withColumn(
            "made_at", F.element_at(F.create_map(*[F.lit(x) for i, t, *_ in rows for x in (i, t)]), F.col("edit_id")).cast("timestamp")
        )

    def state():
        return {(r.facility_id, r.field_name): r.value for r in spark.table("st_once").collect()}

    assert edits.absorb(batch((1, "2024-01-02", "a", "bed_count", "7"), (2, "2024-01-02", "b", "pincode", "12")), 0, "st_once", quality.validate_edits)
    assert edits.absorb(batch((3, "2024-01-01", "a", "bed_count", "5"), (4, "2024-01-02", "a", "bed_count", "9")), 1, "st_once", quality.validate_edits)
    assert state() == {("a", "bed_count"): "9"}
    version = publish.current(spark, "st_once")
    # run again under a number that was taken in
    assert not edits.absorb(batch((5, "2025-01-01", "a", "bed_count", "1")), 1, "st_once", quality.validate_edits)
    assert state() == {("a", "bed_count"): "9"} and publish.current(spark, "st_once") == version
    # the same edits under a new number write no file
    assert edits.absorb(batch((4, "2024-01-02", "a", "bed_count", "9")), 2, "st_once", quality.validate_edits)
    assert publish.current(spark, "st_once") == version and publish.mark(spark, "st_once", "edits") == "2"
    assert spark.table("st_once_rejected").count() == 1


def files(spark, target):
    return set(spark.table(target).inputFiles())


def test_only_changed_buckets_are_written(spark):
    rows = spark.range(400).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v"), F.when(F.col("id") % 3 == 0, F.lit("x")).alias("w"))
    assert publish.publish_changed(spark, "st_keyed", rows, ["k"], 8) == list(range(8))
    before = files(spark, "st_keyed")
    assert publish.publish_changed(spark, "st_keyed", spark.table("st_keyed"), ["k"], 8) == [] and files(spark, "st_keyed") == before
    moved = spark.table("st_keyed").withColumn("w", F.when(F.col("k") == "17", F.lit("new")).otherwise(F.col("w")))
    changed = publish.publish_changed(spark, "st_keyed", moved, ["k"], 8)
    assert len(changed) == 1
    after = files(spark, "st_keyed")
    assert len(before & after) == len({f for f in before if f"__bucket={changed[0]}/" not in f}) and after - before
    assert spark.table("st_keyed").where("w = 'new'").count() == 1 and spark.table("st_keyed").count() == 400
    # a value that moves to the next column is a change, and so are rows that go
    swapped = spark.table("st_keyed").select("k", "v", F.when(F.col("k") == "20", F.lit(None)).otherwise(F.col("w")).alias("w"))
    gone = swapped.where("k <> '33'")
    assert set(publish.publish_changed(spark, "st_keyed", gone, ["k"], 8)) and spark.table("st_keyed").count() == 399
    r = random.Random(1)
    for _ in range(4):  # any sequence of changes ends in the rows it says
        drop = {str(r.randrange(400)) for _ in range(3)}
        publish.publish_changed(spark, "st_keyed", spark.table("st_keyed").where(~F.col("k").isin(*drop)), ["k"], 8)
    left = sorted(map(tuple, spark.table("st_keyed").collect()))
    assert len(left) == len({k for k, *_ in left}) and len(tables_of(spark, "st_keyed")) <= 2 * 8


def tables_of(spark, name):
    return [t.tableName for t in spark.sql(f"SHOW TABLES LIKE '{name}__v*'").collect()]


def test_gap_replay_writes_nothing(spark):
    now = F.lit("2024-02-01").cast("timestamp")
    gaps = spark.range(300).select(
        F.md5(F.col("id").cast("string")).alias("gap_id"), *[F.lit(f).alias(f) for f in upsert.GAP_FIELDS]
    )

    def refresh(found, at):
        return publish.publish(spark, "st_gap", found, lambda old, new: upsert.merge_gaps(old, new, at), GAP_SCHEMA, ["gap_id"])

    assert refresh(gaps, now).count() == 300
    before = files(spark, "st_gap")
    refresh(gaps, now)
    assert files(spark, "st_gap") == before
    # one gap is found no more: its bucket alone is written
    first = gaps.orderBy("gap_id").first().gap_id
    refresh(gaps.where(F.col("gap_id") != first), now)
    after = files(spark, "st_gap")
    assert len({f.split("__bucket=")[1].split("/")[0] for f in after - before}) == 1
    assert spark.table("st_gap").where("status = 'auto_resolved'").count() == 1
