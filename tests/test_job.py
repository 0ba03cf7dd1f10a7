"""The curation run as a whole, on the smallest synthetic tables."""

import pytest
from pyspark.sql import functions as F

from gapwright.bindings import inputs
from gapwright.bindings.relational import EXPLORED
from gapwright.bindings.reports import DEMO
from gapwright.bindings.standins import standin
from gapwright.plans import exploration, job, quality
from gapwright.sources import publish
from gapwright.sources.publish import replace_table

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def curated(spark):
    spark.sql("CREATE DATABASE model")
    src = job.Sources(
        facilities=standin(spark, FOLDER, "raw"),
        indicators=standin(spark, FOLDER, "wide"),
        postal=standin(spark, FOLDER, "postal"),
        states=inputs.states(spark, FOLDER),
        districts=inputs.districts(spark, FOLDER),
        mapping=standin(spark, FOLDER, "dirty_mapping"),
    )

    def run():
        return job.curate(spark, src, "model", F.lit("2024-01-01").cast("timestamp"), DEMO)

    yield run
    spark.sql("DROP DATABASE model CASCADE")


def contents(spark):
    names = [t.name for t in spark.catalog.listTables("model") if t.tableType == "VIEW"]
    return {n: sorted(map(repr, spark.table(f"model.{n}").collect())) for n in names}


def test_run_and_rerun(spark, curated):
    curated()
    first = contents(spark)
    assert set(first) == {
        "facility", "health_indicator", "facility_specialty", "health_indicator_specialty", "specialty_category_mapping",
        "dq_metrics", "dq_gap"}
    assert all(first.values())
    gaps = spark.table("model.dq_gap")
    # everything was mapped and backfilled; the demonstration facility stays bare on purpose
    assert [r["entity_key"] for r in gaps.filter("gap_type = 'facility_without_specialty'").collect()] == ["demo-1"]
    assert gaps.filter("gap_type IN ('unmapped_specialty', 'unmapped_indicator')").count() == 0
    labels = [r[0] for r in spark.sql("SELECT DISTINCT specialty FROM model.facility_specialty").collect()]
    assert labels and not [x for x in labels if x.startswith(("*", "{", "[", "_")) or x != x.strip()]
    curated()
    again = contents(spark)
    # the category table is voted on anew each time, from one row per label: labels
    # that no facility uses may give way to another spelling
    assert set(again.pop("specialty_category_mapping")) <= set(first.pop("specialty_category_mapping"))
    assert again == first


def test_edits_and_unfinished_versions(spark, curated):
    if not spark.catalog.tableExists("model.dq_gap"):
        curated()
    edits = {
        "facility_specialty": spark.createDataFrame([("edited-1", "edited label")], "facility_id string, specialty string"),
        "specialty_category_mapping": spark.createDataFrame([("edited label", "edited category")], "specialties string, category string"),
    }
    for name, row in edits.items():
        replace_table(spark, f"model.{name}", spark.table(f"model.{name}").unionByName(row))
        # what is left when the driver stops while the next version is written
        spark.table(f"model.{name}").limit(1).write.saveAsTable(f"model.{name}__v{publish.current(spark, f'model.{name}') + 1}")
    curated()
    assert spark.table("model.facility_specialty").filter("facility_id = 'edited-1'").count() == 1
    assert spark.table("model.specialty_category_mapping").filter("category = 'edited category'").count() == 1
    for name in edits:
        assert len(publish._numbered(spark, f"model.{name}", "v")) <= 2


def test_sources_out_of_a_folder_and_a_namespace(spark, tmp_path):
    frames = {"facilities": "raw", "indicators": "wide", "postal": "postal", "mapping": "dirty_mapping"}
    spark.sql("CREATE DATABASE source")
    for name, own in frames.items():
        df = standin(spark, FOLDER, own)
        if name == "mapping":
            df = df.select(F.lit(1).alias("row"), F.col("category").alias("Specialty_Category"), F.col("specialties").alias("SPECIALTY"))
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
        df.write.saveAsTable(f"source.{name}")
    for name in ("states", "districts"):
        rows = standin(spark, FOLDER, name)
        (tmp_path / f"{name}.csv").write_text("\n".join([",".join(rows.columns), *(",".join(r) for r in rows.collect())]) + "\n")
    want = {
        "facilities": standin(spark, FOLDER, "raw"), "states": inputs.states(spark, FOLDER), "districts": inputs.districts(spark, FOLDER),
        "mapping": standin(spark, FOLDER, "dirty_mapping").select("specialties", "category"),
    }
    for source in (str(tmp_path), "source"):
        found = job.load_sources(spark, source, str(tmp_path))
        for name, df in want.items():
            got = getattr(found, name)
            assert sorted(map(repr, got.select(*df.columns).collect())) == sorted(map(repr, df.collect())), name
    spark.sql("DROP DATABASE source CASCADE")


def test_correction_settles_a_gap(spark, curated):
    if not spark.catalog.tableExists("model.dq_gap"):
        curated()
    broken = spark.table("model.facility").filter("facility_id <> 'demo-1'").orderBy("facility_id").first()["facility_id"]
    fix = spark.createDataFrame([(broken, "12", None)], "facility_id string, facility_type string, bed_count int")
    schema = quality.CORRECTED
    cols = [c for c in schema if c != "operator_type_raw"]
    rows = fix.select("facility_id", *[(F.col(c) if c in fix.columns else F.lit(None).cast("string")).alias(c) for c in cols])
    spark.sql("DROP TABLE IF EXISTS model.facility_correction")
    rows.withColumn("doctors_count", F.col("doctors_count").cast("int")).withColumn(
        "updated_at", F.lit("2024-01-01").cast("timestamp")
    ).write.saveAsTable("model.facility_correction")
    curated()
    gap = spark.table("model.dq_gap").filter((F.col("entity_key") == broken) & (F.col("gap_type") == "invalid_facility_type"))
    assert gap.first()["status"] == "open"
    replace_table(spark, "model.facility_correction", spark.table("model.facility_correction").withColumn("facility_type", F.lit("clinic")))
    curated()
    row = spark.table("model.dq_gap").filter((F.col("entity_key") == broken) & (F.col("gap_type") == "invalid_facility_type")).first()
    assert row["status"] == "auto_resolved"


def test_district_detail(spark):
    long, imap = inputs.long(spark, FOLDER), standin(spark, FOLDER, "imap")
    one = long.orderBy("state_ut", "district_name").first()
    rows = exploration.district_detail(long, imap, one["district_name"], one["state_ut"], EXPLORED).collect()
    assert rows and [r["demand_pct"] for r in rows if r["demand_pct"] is not None] == sorted(
        (r["demand_pct"] for r in rows if r["demand_pct"] is not None), reverse=True)
    assert exploration.district_detail(long, imap, one["district_name"], one["state_ut"]).count() == 0  # none of the usual categories
    ranked = exploration.ranked_profile(long, imap, EXPLORED)
    only = exploration.top_categories(ranked, [one["state_ut"]])
    assert {r["state_ut"] for r in only.collect()} == {one["state_ut"]}
