"""Keyed changes on the synthetic tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gapwright.bindings import inputs, standins
from gapwright.bindings.catalog import DERIVED, bind, is_label, strip
from gapwright.bindings.inputs import merged_sql
from gapwright.bindings.standins import standin
from gapwright.functions import jsontext, text
from gapwright.operators import aggregates, joins, upsert
from gapwright.plans import curation, quality, vocabulary
from gapwright.session import checkpoint_dir, settled
from gapwright.sources import publish
from gapwright.streaming import edits as stream

c = F.col

bind(
    "merge_overlay",
    lambda s, d: upsert.overlay(standin(s, d, "facility"), standin(s, d, "corrections"), "facility_id", curation.CORRECTED),
    "SELECT * FROM @corrected",
)
bind(
    "merge_update",
    lambda s, d: vocabulary.resync_lists(standin(s, d, "facility"), standin(s, d, "bridge")).select("facility_id", "specialties_raw"),
    """SELECT f.facility_id, coalesce(l.j, f.specialties_raw) AS specialties_raw FROM @facility f
       LEFT JOIN (SELECT facility_id, '["' || string_agg(DISTINCT specialty, '","' ORDER BY specialty) || '"]' AS j FROM @bridge GROUP BY 1) l
         ON l.facility_id = f.facility_id""",
)


def inserted(s, d):
    votes = standin(s, d, "part").select(c("p_name").alias("specialties"), c("p_type").alias("category"))
    every = aggregates.majority_vote(votes, "specialties", "category")
    return upsert.insert_absent(inputs.mapping(s, d), every.withColumn("category", F.lit("NEW")), ["specialties"])


bind("merge_insert_absent", inserted, """
    SELECT specialties, category FROM @mapping UNION ALL SELECT DISTINCT p_name, 'NEW' FROM @part
    WHERE p_name NOT IN (SELECT specialties FROM @mapping)""")

GAP_SHOWN = (
    "gap_id", "gap_type", "severity", "entity_type", "entity_key", "entity_label", "field_name", "current_value",
    "suggested_fix", "fix_action", "status", "resolution_notes",
)


def reconciled(s, d):
    """The newly found gaps, staged, and the gap table reconciled with them."""
    staging = settled(quality.dq_gaps(inputs.corrected_model(s, d)))
    return staging, upsert.merge_gaps(inputs.prior_gaps(s, d), staging, inputs.now())


DERIVED["merged"] = merged_sql("@prior", "@new_gaps")
bind("merge_gaps", lambda s, d: reconciled(s, d)[1].select(*GAP_SHOWN), "SELECT * FROM @merged")


def replayed(s, d):
    """Reconciling a second time with the same findings changes nothing."""
    staging, merged = reconciled(s, d)
    again = upsert.merge_gaps(merged, staging, inputs.now())
    return again.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


bind("merge_gaps_replay", replayed, "SELECT status, count(*) AS n FROM @merged GROUP BY 1")


def updated(s, d):
    rows = upsert.update_where(
        standin(s, d, "facility"), c("bed_count") == 0, {"bed_count": F.lit(25), "facility_type": F.lit("clinic")}
    )
    return rows.select("facility_id", "bed_count", "facility_type")


bind("conditional_update", updated, """
    SELECT facility_id, CASE WHEN bed_count = 0 THEN 25 ELSE bed_count END AS bed_count,
           CASE WHEN bed_count = 0 THEN 'clinic' ELSE facility_type END AS facility_type FROM @facility""")


def deleted(s, d):
    gone = inputs.mapping(s, d).filter(c("category") == "SMALL").select(c("specialties").alias("specialty"))
    return upsert.delete_where(standin(s, d, "dirty_bridge"), ~text.is_label(c("specialty")), gone)


bind("conditional_delete", deleted, f"""
    SELECT facility_id, specialty FROM @dirty_bridge WHERE {is_label('specialty')}
      AND specialty NOT IN (SELECT specialties FROM @mapping WHERE category = 'SMALL')""")

# --------------------------------------------------------------------- edits

DERIVED["accepted"] = "SELECT * FROM @checked_edit WHERE error IS NULL"
DERIVED["last_edit"] = """
    SELECT facility_id, field_name, value FROM (
        SELECT *, row_number() OVER (PARTITION BY facility_id, field_name ORDER BY made_at DESC, edit_id DESC) AS rn FROM @accepted) x WHERE rn = 1"""


def _last(field: str) -> str:
    return f"(SELECT value FROM @last_edit e WHERE e.facility_id = f.facility_id AND e.field_name = '{field}')"


DERIVED["edited"] = f"""
    SELECT facility_id, coalesce({_last('facility_name')}, facility_name) AS facility_name, coalesce({_last('pincode')}, pincode) AS pincode,
           coalesce({_last('operator_type')}, operator_type) AS operator_type, coalesce({_last('operator_type')}, operator_type_raw) AS operator_type_raw,
           coalesce(CAST({_last('bed_count')} AS INTEGER), bed_count) AS bed_count, coalesce({_last('specialties_raw')}, specialties_raw) AS specialties_raw
    FROM @facility f"""


def edited_model(s, d):
    ok, _ = quality.validate_edits(standin(s, d, "edits"))
    return quality.apply_edits(inputs.model(s, d), ok)


bind(
    "upsert_field",
    lambda s, d: edited_model(s, d).facility.select(
        "facility_id", "facility_name", "pincode", "operator_type", "operator_type_raw", "bed_count", "specialties_raw"
    ),
    "SELECT * FROM @edited",
)


def streamed(s, d):
    """Facilities after the edit feed is taken in as a stream, a file at a time."""
    source = s.readStream.schema(standin(s, d, "events").schema).option("maxFilesPerTrigger", 1)
    events = source.parquet(f"{d}/event[s].parquet")  # a pattern may name one file as well as a folder
    feed = s.sql(standins.text_of("edits"), events=events)
    name = f"edit_state_{uuid.uuid4().hex}"
    try:
        stream.run(feed, name, f"{checkpoint_dir(s)}/{name}", quality.validate_edits).awaitTermination()
        # the state is small next to the feed; settled, its tables can go
        state = settled(stream.latest(s, name))
    finally:
        for table in (name, f"{name}_rejected"):
            publish.drop(s, table)
    accepted = state.withColumn("corrected_value", c("value"))
    return quality.apply_edits(inputs.model(s, d), accepted).facility.select(
        "facility_id", "facility_name", "pincode", "operator_type", "operator_type_raw", "bed_count", "specialties_raw"
    )


bind("edit_stream", streamed, "SELECT * FROM @edited")


def last_status(s, d):
    """Gaps after a feed of status edits, several for each gap: the last one counts."""
    feed = standin(s, d, "status_feed").select("gap_id", "status", "resolution_notes", "made_at", "edit_id")
    return quality.latest_status(feed, "made_at", "edit_id")


DERIVED["last_status"] = """
    SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY gap_id ORDER BY made_at DESC, edit_id DESC) AS rn FROM @status_feed) x WHERE rn = 1"""
bind("latest_status", last_status, "SELECT gap_id, status, resolution_notes, made_at, edit_id FROM @last_status")


def edited_corrections(s, d):
    cols = ["facility_id", "facility_name", "pincode", "operator_type", "facility_type", "bed_count", "specialties_raw"]
    return edited_model(s, d).corrections.select(*cols)


bind("upsert_corrections", edited_corrections, f"""
    SELECT facility_id, coalesce({_last('facility_name')}, facility_name) AS facility_name, coalesce({_last('pincode')}, pincode) AS pincode,
           coalesce({_last('operator_type')}, operator_type) AS operator_type, facility_type,
           coalesce(CAST({_last('bed_count')} AS INTEGER), bed_count) AS bed_count, coalesce({_last('specialties_raw')}, specialties_raw) AS specialties_raw
    FROM (SELECT * FROM @corrections UNION ALL BY NAME SELECT DISTINCT facility_id FROM @last_edit
          WHERE facility_id NOT IN (SELECT facility_id FROM @corrections) AND facility_id IN (SELECT facility_id FROM @facility)) f""")


def list_rows_sql(source: str) -> str:
    """Cleaned distinct labels of a list column."""
    return f"""SELECT DISTINCT facility_id, {strip('x')} AS specialty FROM (
        SELECT facility_id, unnest(from_json(specialties_raw, '["VARCHAR"]')) AS x FROM {source} WHERE specialties_raw LIKE '[%') u
        WHERE {is_label('x')} AND {strip('x')} <> ''"""


DERIVED["edited_ids"] = "SELECT facility_id FROM @last_edit WHERE field_name = 'specialties_raw' AND facility_id IN (SELECT facility_id FROM @facility)"
bind("resync_bridge", lambda s, d: edited_model(s, d).bridge, f"""
    SELECT * FROM @bridge WHERE facility_id NOT IN (SELECT facility_id FROM @edited_ids)
    UNION ALL SELECT * FROM ({list_rows_sql('@edited')}) n WHERE facility_id IN (SELECT facility_id FROM @edited_ids)""")

bind(
    "backfill_bridge",
    lambda s, d: upsert.backfill_bridge(standin(s, d, "bridge"), standin(s, d, "facility"), ["Customer#000000001"]),
    f"""SELECT * FROM @bridge UNION ALL SELECT * FROM ({list_rows_sql('@facility')}) n
        WHERE facility_id NOT IN (SELECT facility_id FROM @bridge) AND facility_id <> 'Customer#000000001'""",
)
bind(
    "apply_string_map",
    lambda s, d: upsert.apply_string_map(
        standin(s, d, "dirty_bridge"), "specialty",
        vocabulary.markup_map(vocabulary.all_labels(standin(s, d, "dirty_bridge"), standin(s, d, "dirty_mapping"))),
    ),
    f"""SELECT DISTINCT facility_id, {strip('specialty')} AS specialty FROM @dirty_bridge
        WHERE {is_label('specialty')} AND {strip('specialty')} <> ''""",
)


def status_edits(s, d):
    """Last status given per gap; a third of the edits carry notes."""
    gaps = inputs.prior_gaps(s, d)
    given = gaps.filter(c("entity_type") == "facility").select(
        "gap_id",
        F.when(c("gap_type") == "missing_pincode", "dismissed").otherwise("resolved").alias("status"),
        F.when(c("gap_type") == "missing_pincode", " checked ").alias("resolution_notes"),
    )
    return upsert.apply_gap_status(gaps, given, inputs.now()).select(
        "gap_id", "status", "resolution_notes", F.date_format("updated_at", "yyyy-MM-dd").alias("updated")
    )


bind("gap_status_edits", status_edits, """
    SELECT gap_id, CASE WHEN entity_type <> 'facility' THEN status WHEN gap_type = 'missing_pincode' THEN 'dismissed' ELSE 'resolved' END AS status,
           CASE WHEN gap_type = 'missing_pincode' THEN 'checked' ELSE resolution_notes END AS resolution_notes,
           CASE WHEN entity_type = 'facility' THEN '2024-02-01' ELSE '2024-01-01' END AS updated FROM @prior""")


def actions(s, d):
    """One resolution per open gap of the model, some of them not possible."""
    g = quality.dq_gaps(inputs.model(s, d))
    kind, key = c("gap_type"), c("entity_key")
    act = (
        F.when(kind == "facility_without_specialty", "add_facility_specialty")
        .when((kind == "invalid_facility_type") & c("current_value").startswith("7"), "dismiss_only")
        .when(kind == "invalid_facility_type", "rebuild")
        .otherwise(c("fix_action"))
    )
    digit = F.substring("gap_id", 1, 1)
    body = (
        F.when(kind == "unmapped_specialty", jsontext.payload(specialty=key, category=F.when(~key.startswith("red"), F.lit("ADDED"))))
        .when(kind == "orphan_indicator_mapping", jsontext.payload(indicator_key=key, specialty_category=F.lit("PROMO")))
        .when(kind == "unmapped_indicator", jsontext.payload(indicator_key=key, specialty_category=F.lit("SMALL")))
        .when(kind == "facility_without_specialty", jsontext.payload(facility_id=F.lit("someone else"), specialty=F.lit("blue rod, *old gear*")))
        .when(kind == "missing_pincode", jsontext.payload(
            facility_id=F.lit("ignored"), field_name=F.lit("pincode"), corrected_value=F.when(digit < "8", "560099").otherwise("0560")))
        .otherwise(F.lit("{}"))
    )
    return g.select(
        c("gap_id").alias("action_id"), inputs.now().alias("made_at"), "gap_id", act.alias("fix_action"), body.alias("payload")
    )


def resolved(s, d):
    """What a batch of resolutions changed, part by part."""
    m = inputs.model(s, d)
    new, gaps, rejected = quality.resolve_actions(m, inputs.prior_gaps(s, d), actions(s, d), inputs.now())
    parts = [
        new.mapping.select(F.lit("mapping").alias("part"), c("specialties").alias("key"), c("category").alias("value")),
        new.indicator_bridge.select(F.lit("indicator"), "indicator_key", "specialty_category"),
        new.facility.select(F.lit("pincode"), "facility_id", "pincode"),
        new.bridge.select(F.lit("bridge"), "facility_id", "specialty"),
        gaps.select(F.lit("status"), "gap_id", "status"),
        rejected.select(F.lit("rejected"), "gap_id", "error"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


bind("resolve_actions", resolved, """
    SELECT 'mapping' AS part, specialties AS key, category AS value FROM @mapping
    UNION ALL SELECT 'mapping', entity_key, 'ADDED' FROM @gaps WHERE gap_type = 'unmapped_specialty' AND entity_key NOT LIKE 'red%'
    UNION ALL SELECT 'indicator', indicator_key, specialty_category FROM @imap WHERE NOT (indicator_key = 'retired_key_pct' AND specialty_category = 'PROMO')
    UNION ALL SELECT 'indicator', entity_key, 'SMALL' FROM @gaps WHERE gap_type = 'unmapped_indicator'
    UNION ALL SELECT 'pincode', facility_id, CASE WHEN pincode IS NULL AND md5('missing_pincode|facility|' || facility_id || '|pincode') < '8' THEN '560099' ELSE pincode END FROM @facility
    UNION ALL SELECT 'bridge', facility_id, specialty FROM @bridge
    UNION ALL SELECT 'bridge', facility_id, unnest(['blue rod', 'old gear']) FROM @facility WHERE facility_id NOT IN (SELECT facility_id FROM @bridge)
    UNION ALL SELECT 'status', gap_id, CASE WHEN gap_type = 'invalid_facility_type' AND current_value LIKE '7%' THEN 'dismissed' ELSE status END FROM @prior
    UNION ALL SELECT 'rejected', gap_id, CASE gap_type WHEN 'unmapped_specialty' THEN 'specialty and category are required'
                  WHEN 'invalid_facility_type' THEN 'unsupported fix_action' ELSE 'pincode is not six digits' END FROM @gaps
              WHERE (gap_type = 'unmapped_specialty' AND entity_key LIKE 'red%') OR (gap_type = 'invalid_facility_type' AND current_value NOT LIKE '7%')
                 OR (gap_type = 'missing_pincode' AND gap_id >= '8')""")

# ------------------------------------------------------ parents and children


def replaced(s, d):
    """Conversations with a system turn get its sentences as their children."""
    wanted = standin(s, d, "conversations").filter(c("role") == "system").select(
        "conv_id", F.split("text", r"\.").alias("items")
    )
    return upsert.replace_children(standin(s, d, "children"), wanted, "conv_id", "items", "item", "sort_order")


DERIVED["asked"] = "SELECT conv_id, string_split(text, '.') AS items FROM @conversations WHERE role = 'system'"
bind("scenario_replace", replaced, """
    SELECT conv_id, sort_order, item FROM @children WHERE conv_id NOT IN (SELECT conv_id FROM @asked)
    UNION ALL SELECT conv_id, CAST(i - 1 AS BIGINT), trim(items[i]) FROM (SELECT conv_id, items, unnest(range(1, len(items) + 1)) AS i FROM @asked) x""")


def copies(s, d):
    """Every conversation that has a system turn is copied under a new id."""
    top = standin(s, d, "parents").agg(F.max("conv_id")).scalar()
    wanted = standin(s, d, "conversations").filter(c("role") == "system").select("conv_id").distinct()
    return wanted.select("conv_id", (c("conv_id") + top + 1).alias("new_key"))


def duplicated(s, d):
    """Copied, then parents that lead with the user deleted and names overlaid."""
    parents, children = upsert.duplicate(standin(s, d, "parents"), standin(s, d, "children"), copies(s, d), "conv_id", "name")
    gone = standin(s, d, "conversations").filter((c("turn") == 0) & (c("role") == "user")).select("conv_id")
    parents, children = upsert.delete_parents(parents, children, gone, "conv_id")
    changes = parents.filter(c("name").endswith("0")).select(
        "conv_id", F.lit("  Renamed ").alias("name"), F.lit(None).cast("string").alias("description")
    )
    parents = upsert.update_parents(parents, changes, "conv_id", ["name", "description"])
    return parents, children


def duplicated_rows(s, d):
    parents, children = duplicated(s, d)
    return joins.lookup(
        children.withColumn("key", c("conv_id")), parents, "key", "conv_id", "name", "name", F.lit("none")
    ).select("conv_id", "sort_order", "item", "name")


DERIVED["copied_parent"] = """
    SELECT * FROM @parents UNION ALL
    SELECT conv_id + (SELECT max(conv_id) FROM @parents) + 1, name || ' (copy)', description FROM @parents WHERE conv_id IN (SELECT conv_id FROM @asked)"""
DERIVED["copied_child"] = """
    SELECT * FROM @children UNION ALL
    SELECT conv_id + (SELECT max(conv_id) FROM @parents) + 1, sort_order, item FROM @children WHERE conv_id IN (SELECT conv_id FROM @asked)"""
DERIVED["led_by_user"] = "SELECT conv_id FROM @conversations WHERE turn = 0 AND role = 'user'"
DERIVED["kept_parent"] = """
    SELECT conv_id, CASE WHEN name LIKE '%0' THEN 'Renamed' ELSE name END AS name, description FROM @copied_parent
    WHERE conv_id NOT IN (SELECT conv_id FROM @led_by_user)"""
DERIVED["kept_child"] = "SELECT * FROM @copied_child WHERE conv_id NOT IN (SELECT conv_id FROM @led_by_user)"
bind("scenario_duplicate", duplicated_rows, """
    SELECT c.conv_id, c.sort_order, c.item, p.name FROM @kept_child c JOIN @kept_parent p ON p.conv_id = c.conv_id""")


def summarised(s, d):
    parents = standin(s, d, "parents")
    children = standin(s, d, "children")
    return upsert.parent_summary(parents, children, "conv_id", [F.desc("conv_id")])


bind("scenario_summary", summarised, """
    SELECT p.*, (SELECT count(*) FROM @children c WHERE c.conv_id = p.conv_id) AS child_count FROM @parents p""")
bind(
    "scenario_children",
    lambda s, d: upsert.parent_children(standin(s, d, "parents"), standin(s, d, "children"), "conv_id", "sort_order"),
    """SELECT p.conv_id, p.name, p.description, c.sort_order, c.item FROM @parents p
       LEFT JOIN @children c ON c.conv_id = p.conv_id""",
)


def refreshed(s, d):
    """Whole refresh: statuses and metrics after mapping and backfilling."""
    m = inputs.corrected_model(s, d)
    _, metrics, gaps = quality.dq_refresh(m, inputs.prior_gaps(s, d), inputs.now())
    return gaps.groupBy("gap_type", "status").agg(F.count(F.lit(1)).alias("n")).unionByName(
        metrics.select(c("metric_key").alias("gap_type"), "status", c("actual_value").cast("bigint").alias("n"))
    )


from gapwright.bindings.cleaning import classify_sql  # noqa: E402
from gapwright.functions import fixed  # noqa: E402

DERIVED["full_bridge"] = f"""
    SELECT * FROM @bridge UNION ALL SELECT * FROM ({list_rows_sql('@corrected')}) n WHERE facility_id NOT IN (SELECT facility_id FROM @bridge)"""
DERIVED["new_labels"] = f"""
    SELECT specialty AS specialties, coalesce((SELECT min(category) FROM @mapping m WHERE lower(m.specialties) = lower(b.specialty)),
           {classify_sql('lower(specialty)', fixed.LABEL_CATEGORY_RULES, fixed.DEFAULT_CATEGORY)}) AS category
    FROM (SELECT DISTINCT specialty FROM @bridge WHERE specialty NOT IN (SELECT specialties FROM @mapping)) b"""
DERIVED["full_mapping"] = "SELECT * FROM @mapping UNION ALL SELECT * FROM @new_labels"
DERIVED["new_indicators"] = f"""
    SELECT indicator_key, {classify_sql('indicator_key', fixed.INDICATOR_CATEGORY_RULES, fixed.DEFAULT_CATEGORY)} AS specialty_category
    FROM (SELECT DISTINCT indicator_key FROM @long WHERE indicator_key NOT IN (SELECT indicator_key FROM @imap)) k"""
DERIVED["full_imap"] = "SELECT * FROM @imap UNION ALL SELECT * FROM @new_indicators"
DERIVED["refresh_gaps"] = inputs.gaps_sql("@corrected", "@full_bridge", "@full_mapping", "@full_imap")
DERIVED["refresh_merged"] = merged_sql("@prior", "@refresh_gaps")

from gapwright.bindings.reports import metrics_sql  # noqa: E402

DERIVED["refresh_metrics"] = metrics_sql("@corrected", "@full_bridge", "@full_mapping", "@full_imap")
bind("dq_refresh", refreshed, """
    SELECT gap_type, status, count(*) AS n FROM @refresh_merged GROUP BY 1, 2
    UNION ALL SELECT metric_key, status, CAST(trunc(actual_value) AS BIGINT) FROM @refresh_metrics""")
bind(
    "map_unmapped_specialties",
    lambda s, d: vocabulary.map_unmapped_labels(standin(s, d, "bridge"), inputs.mapping(s, d)),
    "SELECT * FROM @new_labels",
)
bind(
    "map_unmapped_indicators",
    lambda s, d: vocabulary.map_unmapped_indicators(inputs.long(s, d), standin(s, d, "imap")),
    "SELECT * FROM @new_indicators",
)

