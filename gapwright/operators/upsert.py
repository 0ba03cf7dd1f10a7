"""Keyed changes to immutable frames: each is a function from the old target
and a change set to the new target, built from joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gapwright.functions.jsontext import json_list
from gapwright.functions.text import is_label, strip_markup


def _suffixed(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    return df.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__new_{c}") for c in cols])


def overlay(target: DataFrame, corrections: DataFrame, key: str, cols: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Put non-NULL correction values over the target. ``cols`` may map a target
    column to the correction column it takes its value from. Corrections have
    one row per key."""
    pairs = cols if isinstance(cols, Mapping) else {c: c for c in cols}
    source = corrections.select(
        F.col(key).alias("__key"), *[F.col(s).alias(f"__new_{t}") for t, s in pairs.items()]
    )
    joined = target.join(source, F.col(key) == F.col("__key"), "left")
    return joined.select(
        *[F.coalesce(f"__new_{c}", c).alias(c) if c in pairs else F.col(c) for c in target.columns]
    )


def merge_update(target: DataFrame, source: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Replace columns of matched keys, also by NULL."""
    joined = target.join(_suffixed(source, key, cols), F.col(key) == F.col("__key"), "left")
    hit = F.col("__key").isNotNull()
    return joined.select(
        *[
            F.when(hit, F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
            for c in target.columns
        ]
    )


def insert_absent(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add source rows whose key the target does not have."""
    fresh = source.join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def seed_if_empty(target: DataFrame, seed: DataFrame) -> DataFrame:
    """The target, or the seed where the target has no rows; decided inside the
    plan from one row of the target."""
    rows = target.limit(1).agg(F.count(F.lit(1))).scalar()
    return target.unionByName(seed.select(*target.columns).filter(rows == 0))


def update_where(df: DataFrame, predicate: Column, assigns: Mapping[str, Column]) -> DataFrame:
    hit = F.coalesce(predicate, F.lit(False))
    return df.select(
        *[F.when(hit, assigns[c]).otherwise(F.col(c)).alias(c) if c in assigns else F.col(c) for c in df.columns]
    )


def delete_where(df: DataFrame, predicate: Column | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Remove rows by predicate, or those whose key columns are in ``keys``."""
    if predicate is not None:
        df = df.filter(~F.coalesce(predicate, F.lit(False)))
    if keys is not None:
        df = df.join(keys.distinct(), list(keys.columns), "left_anti")
    return df


def apply_string_map(df: DataFrame, col: str, mapping: DataFrame, raw: str = "raw", clean: str = "canonical") -> DataFrame:
    """Rewrite labels through a raw-to-clean map, drop blanks and JSON
    fragments, keep distinct rows."""
    m = mapping.select(F.col(raw).alias("__raw"), F.col(clean).alias("__clean"))
    joined = df.filter(is_label(F.col(col))).join(m, F.trim(F.col(col)) == F.col("__raw"), "left")
    label = F.coalesce("__clean", F.trim(F.col(col)))
    out = joined.select(*[label.alias(c) if c == col else F.col(c) for c in df.columns])
    return out.filter(F.trim(F.col(col)) != "").distinct()


def clean_labels(lists: Column) -> Column:
    """Cleaned different labels of a JSON list, blanks and fragments left out."""
    kept = F.filter(json_list(lists), is_label)
    return F.array_distinct(F.filter(F.transform(kept, strip_markup), lambda x: x != ""))


def bridge_rows(entities: DataFrame, key: str = "facility_id", lists: str = "specialties_raw", out: str = "specialty") -> DataFrame:
    """Distinct cleaned (entity, label) rows out of a JSON-list column."""
    rows = entities.select(key, F.explode(json_list(F.col(lists))).alias("__item"))
    return (
        rows.filter(is_label(F.col("__item")))
        .select(key, strip_markup(F.col("__item")).alias(out))
        .filter(F.col(out) != "")
        .distinct()
    )


def resync_bridge(bridge: DataFrame, entities: DataFrame, ids: DataFrame, key: str = "facility_id") -> DataFrame:
    """Rebuild the bridge rows of the given entities from their lists."""
    wanted = ids.select(key).distinct()
    fresh = bridge_rows(entities.join(wanted, key, "left_semi"), key)
    return bridge.join(wanted, key, "left_anti").unionByName(fresh)


def missing_bridge_rows(
    bridge: DataFrame, entities: DataFrame, exclude: Sequence[str] = (), key: str = "facility_id"
) -> DataFrame:
    """Bridge rows for entities that have none yet, excluded ids aside."""
    bare = entities.join(bridge.select(key).distinct(), key, "left_anti")
    if exclude:
        bare = bare.filter(~F.col(key).isin(*exclude))
    return bridge_rows(bare, key)


def backfill_bridge(
    bridge: DataFrame, entities: DataFrame, exclude: Sequence[str] = (), key: str = "facility_id"
) -> DataFrame:
    return bridge.unionByName(missing_bridge_rows(bridge, entities, exclude, key))


def last_edits(edits: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row per key; ``order`` sorts the last one first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return edits.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def edits_to_overlay(edits: DataFrame, key: str, fields: Mapping[str, str], time: str, tie: str) -> DataFrame:
    """One correction row per key out of (key, field_name, value, time) edits:
    the last edit of each field wins. ``fields`` maps field name to type."""
    known = edits.filter(F.col("field_name").isin(*fields))
    last = last_edits(known, [key, "field_name"], [F.desc(time), F.desc(tie)])
    return last.groupBy(key).agg(
        *[
            F.max(F.when(F.col("field_name") == f, F.col("value"))).try_cast(t).alias(f)
            for f, t in fields.items()
        ],
        F.max(time).alias("updated_at"),
    )


def upsert_corrections(corrections: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Merge new correction values into the correction table: values given
    replace, others stay, new keys are added."""
    c, n = corrections.alias("c"), changes.alias("n")
    both = c.join(n, F.col(f"c.{key}") == F.col(f"n.{key}"), "full")
    return both.select(
        *[
            (F.coalesce(F.col(f"n.{x}"), F.col(f"c.{x}")) if x in changes.columns else F.col(f"c.{x}")).alias(x)
            for x in corrections.columns
        ]
    )


GAP_FIELDS = (
    "gap_type", "severity", "entity_type", "entity_key", "entity_label", "field_name",
    "current_value", "suggested_fix", "fix_action", "fix_payload",
)
AUTO_NOTE = "Not found again by the latest refresh"
DISMISS_NOTE = "Put aside by hand, has no automatic fix"


def merge_gaps(
    target: DataFrame, staging: DataFrame, now: Column, reopen: Sequence[str] = ("resolved",)
) -> DataFrame:
    """Bring the gap table up to date with newly found gaps, in one outer join.

    Found again: fields are refreshed; a dismissed gap stays dismissed, one
    whose status is in ``reopen`` opens again, others keep their status. New:
    inserted as open. Not found any more: open and resolved gaps become
    auto_resolved, others stay as they are.
    """
    t, s = target.alias("t"), staging.alias("s")
    both = t.join(s, F.col("t.gap_id") == F.col("s.gap_id"), "full")
    found, known = F.col("s.gap_id").isNotNull(), F.col("t.gap_id").isNotNull()
    status = F.col("t.status")
    stale = ~found & status.isin("open", "resolved")
    reopened = F.when(status.isin(*reopen) & (status != "dismissed"), "open").otherwise(status)
    return both.select(
        F.coalesce("t.gap_id", "s.gap_id").alias("gap_id"),
        *[F.when(found, F.col(f"s.{f}")).otherwise(F.col(f"t.{f}")).alias(f) for f in GAP_FIELDS],
        F.when(~known, "open").when(found, reopened).when(stale, "auto_resolved").otherwise(status).alias("status"),
        F.when(stale, AUTO_NOTE).otherwise(F.col("t.resolution_notes")).alias("resolution_notes"),
        F.when(found | stale, now).otherwise(F.col("t.updated_at")).alias("updated_at"),
    )


def apply_gap_status(gaps: DataFrame, edits: DataFrame, now: Column) -> DataFrame:
    """Set status and notes of gaps from (gap_id, status, resolution_notes)
    rows, one per gap; without notes the old ones stay."""
    e = edits.select(
        F.col("gap_id").alias("__key"),
        F.col("status").alias("__status"),
        F.trim("resolution_notes").alias("__notes"),
    )
    joined = gaps.join(e, F.col("gap_id") == F.col("__key"), "left")
    hit = F.col("__key").isNotNull()
    new = {
        "status": F.when(hit, F.col("__status")).otherwise(F.col("status")),
        "resolution_notes": F.coalesce(F.nullif(F.col("__notes"), F.lit("")), F.col("resolution_notes")),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in gaps.columns])


def replace_children(
    children: DataFrame, requests: DataFrame, parent: str, items: str, value: str, position: str
) -> DataFrame:
    """Replace all children of the requested parents by an ordered list. A
    request row holds a parent and an array of items; blanks around items go,
    the position is the place in the array."""
    kept = children.join(requests.select(parent), parent, "left_anti").select(parent, position, value)
    fresh = requests.select(parent, F.posexplode(F.col(items)).alias(position, value))
    return kept.unionByName(
        fresh.select(parent, F.col(position).cast(dict(children.dtypes)[position]), F.trim(value).alias(value))
    )


def duplicate(
    parents: DataFrame, children: DataFrame, copies: DataFrame, key: str, name: str
) -> tuple[DataFrame, DataFrame]:
    """Copy parents, named ``… (copy)``, and their children under new ids.
    ``copies`` holds (key, new_key), one row per parent to copy."""
    ids = copies.select(F.col(key).alias("__old"), F.col("new_key").alias("__new"))

    def rekeyed(df: DataFrame) -> DataFrame:
        new = df.join(ids, F.col(key) == F.col("__old"))
        return new.select(*[F.col("__new").alias(c) if c == key else F.col(c) for c in df.columns])

    copy = rekeyed(parents).withColumn(name, F.concat(F.col(name), F.lit(" (copy)")))
    return parents.unionByName(copy), children.unionByName(rekeyed(children))


def delete_parents(parents: DataFrame, children: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Remove parents and, with them, their children."""
    gone = ids.select(key).distinct()
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def update_parents(parents: DataFrame, changes: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Overlay the given trimmed fields; fields not given stay."""
    trimmed = changes.select(key, *[F.trim(c).alias(c) for c in cols])
    return overlay(parents, trimmed, key, cols)


def parent_summary(parents: DataFrame, children: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Parents with their number of children, 0 where there are none."""
    counts = children.groupBy(key).agg(F.count(F.lit(1)).alias("child_count"))
    joined = parents.join(counts, key, "left")
    return joined.withColumn("child_count", F.coalesce("child_count", F.lit(0))).orderBy(*order)


def parent_children(parents: DataFrame, children: DataFrame, key: str, position: str) -> DataFrame:
    """Each parent's children as ordered flat rows; a parent without children
    gives one row. Rows, not one nested list per parent, and an inner join whose
    crowded side Spark can split, so that a parent of any size is spread over
    tasks."""
    full = parents.join(children, key)
    bare = parents.join(children.select(key).distinct(), key, "left_anti")
    return full.unionByName(bare, allowMissingColumns=True).orderBy(key, position)
