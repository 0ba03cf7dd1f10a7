"""Data-quality metrics, the list of actionable gaps, and their resolution."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gapwright.functions.fixed import OPERATOR_CHOICES
from gapwright.functions.jsontext import parse_payload, payload, text_to_list
from gapwright.functions.keys import surrogate_key
from gapwright.functions.numbers import percent, stable_round
from gapwright.functions.text import is_label, label_fallback, nullify
from gapwright.operators.aggregates import by_ranking
from gapwright.operators.joins import without_match
from gapwright.operators.reshape import stack_rows, union_all
from gapwright.operators.upsert import (
    DISMISS_NOTE,
    apply_gap_status,
    edits_to_overlay,
    clean_labels,
    insert_absent,
    last_edits,
    merge_gaps,
    overlay,
    resync_bridge,
    upsert_corrections,
)
from gapwright.plans.curation import CORRECTED
from gapwright.plans.vocabulary import map_unmapped_indicators, map_unmapped_labels
from gapwright.session import settled


@dataclass(frozen=True)
class Model:
    """The curated tables. ``raw`` holds (facility_id, description)."""

    facility: DataFrame
    long: DataFrame
    bridge: DataFrame
    mapping: DataFrame
    indicator_bridge: DataFrame
    raw: DataFrame | None = None
    corrections: DataFrame | None = None


@dataclass(frozen=True)
class Thresholds:
    facility_rows: tuple[int, int] = (9500, 10500)
    facility_rows_expected: int = 10000
    match_pct: float = 75.0
    match_pct_expected: float = 90.0
    high_pct: float = 70.0
    districts_expected: int = 706


@dataclass(frozen=True)
class Findings:
    """What one pass over each table of a model finds. Metrics and gaps are made
    from these and look at no table again, but for descriptions of facilities
    without label.

    ``cells``: rows and empty values by (district, indicator). ``keys`` and
    ``labels``: indicators and labels, and which tables have them. ``checked``:
    facilities with what counts for the metrics, and their gaps.
    """

    cells: DataFrame
    keys: DataFrame
    labels: DataFrame
    checked: DataFrame


def survey_cells(long: DataFrame) -> DataFrame:
    """Rows and empty values by (district, indicator); cells of several surveys
    add up."""
    return long.groupBy("district_id", "indicator_key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("indicator_value").isNull()).alias("nulls")
    )


def _presence(key: str, **sides: DataFrame) -> DataFrame:
    """Each value of ``key`` once, with a flag for each side that has it. The
    other columns of the sides are reduced to their least value."""
    frames = []
    for name, df in sides.items():
        frames.append(df.distinct().select("*", *[F.lit(s == name).alias(s) for s in sides]))
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    extra = [c for c in out.columns if c != key and c not in sides]
    return out.groupBy(key).agg(*[F.bool_or(s).alias(s) for s in sides], *[F.min(c).alias(c) for c in extra])


def _only(side: str, other: str, key: str) -> Column:
    """Whether just one side has the key; a null key is the same as no other."""
    return F.col(side) & (~F.col(other) | F.col(key).isNull())


def _keys(cells: DataFrame, indicator_bridge: DataFrame) -> DataFrame:
    categories = indicator_bridge.groupBy("indicator_key").agg(F.min("specialty_category").alias("specialty_category"), F.count(F.lit(1)).alias("mappings"))
    return _presence("indicator_key", surveyed=cells.select("indicator_key"), categorised=categories)


def _labels(bridge: DataFrame, mapping: DataFrame) -> DataFrame:
    return _presence("specialty", used=bridge.select("specialty"), mapped=mapping.select(F.col("specialties").alias("specialty")))


def _checked(facility: DataFrame, labelled: DataFrame, exclude: Sequence[str] | None) -> DataFrame:
    """Facilities with flags and gaps; ``exclude`` (None for: nobody) names those
    that take no labels from their own list. One scan, one join on the id."""
    c = F.col
    ids = labelled.select(c("facility_id").alias("__labelled")).distinct()
    bare = c("__labelled").isNull()
    takes = F.lit(False) if exclude is None else bare & (~c("facility_id").isin(*exclude) if exclude else F.lit(True))
    none = F.array().cast("array<string>")
    joined = facility.join(ids, c("facility_id") == c("__labelled"), "left")
    added = F.when(takes, clean_labels(c("specialties_raw"))).otherwise(none)
    told = joined.withColumn("added", F.coalesce(added, none)).withColumn("bare", bare & (F.size("added") == 0))
    return told.select(
        "facility_id", "district_id", "added", "bare",
        c("doctors_count").isNull().alias("no_doctors"), c("bed_count").isNull().alias("no_beds"), (c("join_confidence") == "high").alias("high"),
        *[F.when(c("bare"), c(x)).alias(x) for x in ("facility_name", "facility_type", "specialties_raw")],
        _field_gaps().alias("found"),
    )


def findings(m: Model, exclude: Sequence[str] | None = None) -> Findings:
    cells = survey_cells(m.long)
    return Findings(cells, _keys(cells, m.indicator_bridge), _labels(m.bridge, m.mapping), _checked(m.facility, m.bridge, exclude))


def dq_stats(f: Findings) -> DataFrame:
    """One row with every count the metrics need. Each part of the findings
    gives its counts in one aggregate; a row of counts for each part is added
    up to one row."""
    c = F.col
    districts = _presence(
        "district_id", surveyed=f.cells.select("district_id"), supplied=f.checked.select("district_id").where("district_id IS NOT NULL")
    ).where("surveyed")
    count, one = F.count_if, F.count(F.lit(1))
    parts = [
        f.checked.agg(
            one.alias("rows"), F.count_distinct("facility_id").alias("ids"), count(c("district_id").isNull()).alias("no_district"),
            count("no_doctors").alias("no_doctors"), count("no_beds").alias("no_beds"), count("high").alias("high"), count("bare").alias("bare"),
        ),
        f.cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cells"), F.count_distinct("district_id").alias("districts"), F.coalesce(F.sum("nulls"), F.lit(0)).alias("nulls")),
        districts.agg(one.alias("places"), count(~c("supplied")).alias("zero")),
        f.labels.agg(count(_only("used", "mapped", "specialty")).alias("unmapped_specialties")),
        f.keys.agg(
            F.coalesce(F.sum(F.when(_only("categorised", "surveyed", "indicator_key"), c("mappings"))), F.lit(0)).alias("orphans"),
            count(_only("surveyed", "categorised", "indicator_key")).alias("unmapped_indicators"),
        ),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.agg(*[F.sum(n).alias(n) for n in rows.columns])


def dq_metrics(m: Model | Findings, now: Column, t: Thresholds = Thresholds()) -> DataFrame:
    """Fourteen metrics with value, expectation and verdict."""
    f = findings(m) if isinstance(m, Model) else m
    c = F.col
    rows = c("rows")

    def share(part: Column, whole: Column) -> Column:
        return percent(part, whole)

    def row(key, group, label, value, expected, unit, ok, bad, text):
        severity, status = bad
        if ok is None:
            good, verdict = F.lit(severity), F.lit(status)
        else:
            held = F.coalesce(ok, F.lit(False))
            good = F.when(held, "good").otherwise(severity)
            verdict = F.when(held, "pass").otherwise(status)
        return {
            "metric_key": F.lit(key),
            "metric_group": F.lit(group),
            "metric_label": F.lit(label),
            "actual_value": value.cast("double"),
            "expected_value": F.lit(expected).cast("double"),
            "unit": F.lit(unit),
            "severity": good,
            "status": verdict,
            "description": F.lit(text),
        }

    warn, crit, fine = ("warn", "warn"), ("critical", "fail"), ("good", "pass")
    matched = share(rows - c("no_district"), rows)
    high = share(c("high"), rows)
    specs = [
        row("facility_rows", "inventory", "Facility rows", rows, t.facility_rows_expected, "count",
            rows.between(*t.facility_rows), warn, "Facilities left once duplicates are merged"),
        row("facility_duplicate_ids", "facility", "Repeated facility ids", rows - c("ids"), 0, "count",
            rows == c("ids"), crit, "Ids that more than one facility has"),
        row("facility_district_match_pct", "facility", "Placed in a district", stable_round(matched, 1),
            t.match_pct_expected, "percent", matched >= t.match_pct, warn,
            "Facilities whose district is known"),
        row("facility_doctors_populated_pct", "facility", "Doctors known",
            stable_round(share(rows - c("no_doctors"), rows), 1), None, "percent", None, warn,
            "Facilities with a number of doctors"),
        row("facility_beds_populated_pct", "facility", "Beds known",
            stable_round(share(rows - c("no_beds"), rows), 1), None, "percent", None, warn,
            "Facilities with a number of beds"),
        row("facility_join_high_pct", "facility", "Placed with high confidence", stable_round(high, 1),
            None, "percent", high >= t.high_pct, warn, "Facilities placed by an unambiguous postal code"),
        row("health_indicator_districts", "health_indicator", "Survey districts", c("districts"),
            t.districts_expected, "count", None, fine, "Districts the survey covers"),
        row("health_indicator_populated_pct", "health_indicator", "Survey cells filled",
            stable_round(share(c("cells") - c("nulls"), c("cells")), 1), None, "percent", None, fine,
            "Survey cells that hold a number"),
        row("districts_zero_facilities", "geographic_gap", "Districts without facility", c("zero"),
            None, "count", None, warn, "Surveyed districts where no facility was placed; the source may have missed some"),
        row("districts_zero_facilities_pct", "geographic_gap", "Share of districts without facility",
            stable_round(share(c("zero"), c("places")), 1), None, "percent", None, warn,
            "Part of the surveyed districts where no facility was placed"),
        row("unmapped_specialties", "mapping", "Labels without category", c("unmapped_specialties"), 0,
            "count", c("unmapped_specialties") == 0, warn,
            "Labels in use that have no category"),
        row("orphan_indicator_mappings", "mapping", "Categorised indicators not surveyed", c("orphans"), 0, "count",
            c("orphans") == 0, crit, "Categorised indicators that the survey does not have"),
        row("unmapped_indicators", "mapping", "Indicators without category", c("unmapped_indicators"), 0, "count",
            None, warn, "Survey indicators that count for no category"),
        row("facilities_without_specialty", "mapping", "Facilities without label", c("bare"), 0, "count",
            c("bare") == 0, warn, "Facilities that have no label"),
    ]
    return stack_rows(dq_stats(f), specs).withColumn("measured_at", now)


METRIC_GROUPS = ("inventory", "facility", "health_indicator", "mapping", "geographic_gap")
SEVERITIES = ("critical", "warn")


def ordered_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy(by_ranking("metric_group", METRIC_GROUPS), "metric_key")


def _gap(gap_type, severity, entity_type, key, label, field, current, fix, action, **fields) -> Column:
    return F.struct(
        F.lit(gap_type).alias("gap_type"),
        F.lit(severity).alias("severity"),
        F.lit(entity_type).alias("entity_type"),
        key.alias("entity_key"),
        label.alias("entity_label"),
        F.lit(field).alias("field_name"),
        current.cast("string").alias("current_value"),
        F.lit(fix).alias("suggested_fix"),
        F.lit(action).alias("fix_action"),
        payload(**fields).alias("fix_payload"),
    )


def _field_gaps() -> Column:
    """Field gaps of a facility, one for each test it fails."""
    c = F.col
    label = F.coalesce("facility_name", "facility_id")
    pin, kind = F.coalesce("pincode", F.lit("")), F.coalesce("facility_type", F.lit(""))
    bad_type = nullify(c("facility_type")).isNull() | c("facility_type").rlike("^[0-9.]+$")
    tests = [
        F.when(
            c("pincode").isNull(),
            _gap("missing_pincode", "warn", "facility", c("facility_id"), label, "pincode", pin,
                 "Enter the postal code, six digits", "update_facility_field",
                 facility_id=c("facility_id"), field_name=F.lit("pincode"), current_value=pin,
                 facility_name=c("facility_name")),
        ),
        F.when(
            bad_type,
            _gap("invalid_facility_type", "warn", "facility", c("facility_id"), label, "facility_type", kind,
                 "Enter what kind of facility it is", "update_facility_field",
                 facility_id=c("facility_id"), field_name=F.lit("facility_type"), current_value=kind,
                 facility_name=c("facility_name")),
        ),
    ]
    return F.filter(F.array(*tests), lambda g: g.isNotNull())


def missing_labels(m: Model) -> DataFrame:
    """Facilities without bridge rows, with the raw description where there is one."""
    bare = without_match(m.facility, m.bridge, ["facility_id"])
    if m.raw is None:
        return bare.withColumn("description", F.lit(None).cast("string"))
    return bare.join(m.raw.select("facility_id", "description"), "facility_id", "left")


def dq_gaps(m: Model, f: Findings | None = None) -> DataFrame:
    """All gaps the detectors find, each with a stable id and a payload for its
    fix. ``f`` are the findings of the model, where they are there already."""
    f = findings(m) if f is None else f
    c = F.col
    nothing = F.lit(None).cast("string")
    bare = f.checked.where("bare").select("facility_id", "facility_name", "facility_type", "specialties_raw")
    described = bare.withColumn("description", nothing) if m.raw is None else bare.join(m.raw.select("facility_id", "description"), "facility_id", "left")
    raw_list = F.coalesce("specialties_raw", F.lit(""))
    # an orphan key with several categories is one gap
    orphan = F.when(
        _only("categorised", "surveyed", "indicator_key"),
        _gap("orphan_indicator_mapping", "critical", "indicator", c("indicator_key"), c("indicator_key"),
             "indicator_key", c("indicator_key"), "Correct the indicator or take it out",
             "delete_health_indicator_specialty", indicator_key=c("indicator_key"),
             specialty_category=c("specialty_category")),
    )
    unmapped = F.when(
        _only("surveyed", "categorised", "indicator_key"),
        _gap("unmapped_indicator", "warn", "indicator", c("indicator_key"), c("indicator_key"),
             "specialty_category", nothing, "Choose a category for the indicator",
             "add_health_indicator_specialty", indicator_key=c("indicator_key")),
    )
    found = [
        f.labels.where(_only("used", "mapped", "specialty")).select(F.inline(F.array(
            _gap("unmapped_specialty", "warn", "specialty", c("specialty"), c("specialty"), "category", nothing,
                 "Choose a category for the label", "add_specialty_category_mapping", specialty=c("specialty"))
        ))),
        f.keys.select(F.inline(F.filter(F.array(orphan, unmapped), lambda g: g.isNotNull()))),
        described.select(F.inline(F.array(
            _gap("facility_without_specialty", "warn", "facility", c("facility_id"),
                 label_fallback(c("facility_name"), c("description"), c("facility_id")), "specialties_raw", raw_list,
                 "Let a label be inferred from the texts, or choose one",
                 "update_facility_field", facility_id=c("facility_id"), field_name=F.lit("specialties_raw"),
                 current_value=raw_list, facility_name=c("facility_name"), facility_type=c("facility_type"),
                 description=c("description"))
        ))),
        f.checked.where(F.size("found") > 0).select(F.inline("found")),
    ]
    gap_id = surrogate_key(c("gap_type"), c("entity_type"), c("entity_key"), F.coalesce("field_name", F.lit("")))
    stacked = union_all(*found)
    return stacked.select(gap_id.alias("gap_id"), *stacked.columns)


def dq_counts(metrics: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row: metrics, open gaps, dismissed gaps."""
    return gaps.agg(
        F.count_if(F.col("status") == "open").alias("open_gaps"),
        F.count_if(F.col("status") == "dismissed").alias("dismissed_gaps"),
    ).select(
        metrics.agg(F.count(F.lit(1))).scalar().alias("metric_count"), "open_gaps", "dismissed_gaps"
    )


def gap_counts(gaps: DataFrame, by: Sequence[str], only_open: bool = False) -> DataFrame:
    rows = gaps.filter(F.col("status") == "open") if only_open else gaps
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("open_gap_count" if only_open else "gap_count"))
    return counts.orderBy(by_ranking("severity", SEVERITIES), *by)


def open_gaps(gaps: DataFrame, gap_type: str | None = None) -> DataFrame:
    rows = gaps.filter(F.col("status") == "open")
    if gap_type is not None:
        rows = rows.filter(F.col("gap_type") == gap_type)
    return rows.orderBy(by_ranking("severity", SEVERITIES), "gap_type", "entity_label", "gap_id")


def dq_refresh(m: Model, prior: DataFrame, now: Column, t: Thresholds = Thresholds(), exclude: Sequence[str] = ()):
    """Whole refresh: take blank labels and JSON fragments out of the bridge, map
    what is unmapped, backfill the bridge, then measure and reconcile the gap
    list. Gives the new model, the metrics and the gaps.

    Survey and facilities are read once: the survey is counted by cell, and the
    facilities are checked and backfilled in the same pass. Both results are
    written; what follows adds them up.
    """
    m = replace(m, bridge=m.bridge.filter(is_label(F.col("specialty"))))
    seen = findings(m, exclude)
    cells, checked = settled(seen.cells), settled(seen.checked)
    indicators = settled(map_unmapped_indicators(cells, m.indicator_bridge))
    labels = settled(map_unmapped_labels(m.bridge, m.mapping))
    rows = checked.select("facility_id", F.explode("added").alias("specialty")).distinct()
    new = replace(
        m, indicator_bridge=m.indicator_bridge.unionByName(indicators), mapping=m.mapping.unionByName(labels), bridge=m.bridge.unionByName(rows)
    )
    f = Findings(cells, _keys(cells, new.indicator_bridge), _labels(new.bridge, new.mapping), checked)
    return new, dq_metrics(f, now, t), merge_gaps(prior, dq_gaps(new, f), now)


FIELD_TYPES = {
    "facility_name": "string",
    "pincode": "string",
    "operator_type": "string",
    "facility_type": "string",
    "doctors_count": "int",
    "bed_count": "int",
    "specialties_raw": "string",
    "state_ut": "string",
    "district_name": "string",
}


def checked_edits(edits: DataFrame) -> DataFrame:
    """Add ``value`` (the normalised new value) and ``error`` (NULL when valid) to
    (facility_id, field_name, corrected_value) rows."""
    field, given = F.col("field_name"), F.trim(F.coalesce("corrected_value", F.lit("")))
    whole = F.regexp_extract(given, r"^([+-]?[0-9]+)", 1).try_cast("bigint")
    is_int = field.isin("doctors_count", "bed_count")
    value = (
        F.when(field == "specialties_raw", text_to_list(given))
        .when(is_int, whole.cast("string"))
        .otherwise(given)
    )
    v = F.col("value")
    error = (
        F.when(nullify(F.col("facility_id"), ("",)).isNull(), "no facility_id given")
        .when(~field.isin(*FIELD_TYPES) | field.isNull(), F.concat(F.lit("field cannot be edited: "), F.coalesce(field, F.lit(""))))
        .when((field == "operator_type") & ~v.isin(*OPERATOR_CHOICES), "operator_type is none of the choices")
        .when((field == "pincode") & ~v.rlike("^[1-9][0-9]{5}$"), "pincode is not six digits")
        .when(is_int & v.isNull(), F.concat(field, F.lit(" is no whole number")))
        .when((field == "facility_name") & (v == ""), "facility_name is blank")
        .when((field == "specialties_raw") & (v == "[]"), "no specialty given")
    )
    return edits.withColumn("value", value).withColumn("error", error)


def validate_edits(edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted edits with normalised values, and rejected ones with the reason."""
    checked = checked_edits(edits)
    return checked.filter(F.col("error").isNull()).drop("error"), checked.filter(F.col("error").isNotNull())


def apply_edits(m: Model, accepted: DataFrame, time: str = "made_at", tie: str = "edit_id") -> Model:
    """Bring accepted edits into the corrections, the facilities and, for changed
    label lists, the bridge. The last edit per facility and field wins; edits of
    unknown facilities have no effect."""
    known = accepted.join(m.facility.select("facility_id"), "facility_id", "left_semi")
    changes = edits_to_overlay(known, "facility_id", FIELD_TYPES, time, tie)
    facility = overlay(m.facility, changes, "facility_id", CORRECTED)
    ids = changes.filter(F.col("specialties_raw").isNotNull()).select("facility_id")
    bridge = resync_bridge(m.bridge, facility, ids)
    corrections = None if m.corrections is None else upsert_corrections(m.corrections, changes, "facility_id")
    return replace(m, facility=facility, bridge=bridge, corrections=corrections)


ACTIONS = (
    "add_specialty_category_mapping", "add_health_indicator_specialty", "add_facility_specialty",
    "update_facility_field", "delete_health_indicator_specialty", "dismiss_only",
)


def routed_actions(m: Model, gaps: DataFrame, actions: DataFrame) -> DataFrame:
    """Actions (action_id, made_at, gap_id, fix_action, payload) with their fields
    taken apart and an ``error`` where one is missing. For facility actions the
    id comes from the gap row, and from the payload only when the gap has none."""
    ids = gaps.filter(F.col("entity_type") == "facility").select(
        F.col("gap_id").alias("__gap"), F.col("entity_key").alias("__entity")
    )
    a = actions.withColumn("p", parse_payload(F.col("payload"))).join(
        ids, F.trim("gap_id") == F.col("__gap"), "left"
    )

    def field(name: str) -> Column:
        return nullify(F.try_element_at("p", F.lit(name)), ("",))

    act = F.col("fix_action")
    adds = act == "add_facility_specialty"
    facility_id = F.coalesce("__entity", field("facility_id"))
    fields = a.select(
        "action_id", "made_at", "gap_id", "fix_action",
        F.coalesce(facility_id, F.lit("")).alias("facility_id"),
        F.when(adds, "specialties_raw").otherwise(field("field_name")).alias("field_name"),
        F.when(adds, field("specialty")).otherwise(F.try_element_at("p", F.lit("corrected_value"))).alias("corrected_value"),
        field("specialty").alias("specialty"),
        field("category").alias("category"),
        field("indicator_key").alias("indicator_key"),
        field("specialty_category").alias("specialty_category"),
    )
    checked = checked_edits(fields).withColumnRenamed("error", "edit_error")
    known = m.facility.select(F.col("facility_id").alias("__known")).distinct()
    checked = checked.join(known, F.col("facility_id") == F.col("__known"), "left")
    edits = act.isin("add_facility_specialty", "update_facility_field")
    pair = act.isin("add_health_indicator_specialty", "delete_health_indicator_specialty")
    error = (
        F.when(~act.isin(*ACTIONS) | act.isNull(), "unsupported fix_action")
        .when((act == ACTIONS[0]) & (F.col("specialty").isNull() | F.col("category").isNull()), "specialty and category are required")
        .when(pair & (F.col("indicator_key").isNull() | F.col("specialty_category").isNull()), "indicator_key and specialty_category are required")
        .when(adds & F.col("specialty").isNull(), "facility_id and specialty are required")
        .when(edits & F.col("edit_error").isNotNull(), F.col("edit_error"))
        .when(edits & F.col("__known").isNull(), "facility not found")
    )
    return checked.withColumn("error", error).drop("__known", "edit_error")


def resolve_actions(m: Model, gaps: DataFrame, actions: DataFrame, now: Column) -> tuple[Model, DataFrame, DataFrame]:
    """Apply a batch of resolutions: the new model, the new gaps, the rejects.

    Actions on one key take effect in time order, so the last one decides: for
    an indicator pair whether it is there, for a facility field its value; a new
    label keeps the category that was given first.
    """
    routed = settled(routed_actions(m, gaps, actions))
    good = routed.filter(F.col("error").isNull())
    rejected = routed.filter(F.col("error").isNotNull()).select("action_id", "gap_id", "fix_action", "error")
    latest = [F.desc("made_at"), F.desc("action_id")]

    def of(*kinds: str) -> DataFrame:
        return good.filter(F.col("fix_action").isin(*kinds))

    labels = of("add_specialty_category_mapping").select(
        F.col("specialty").alias("specialties"), "category", "made_at", "action_id"
    )
    first = last_edits(labels, ["specialties"], [F.asc("made_at"), F.asc("action_id")])
    mapping = insert_absent(m.mapping, first, ["specialties"])

    pair = ["indicator_key", "specialty_category"]
    last = last_edits(of("add_health_indicator_specialty", "delete_health_indicator_specialty"), pair, latest)
    gone = last.filter(F.col("fix_action").startswith("delete")).select(*pair)
    kept = m.indicator_bridge.join(gone, pair, "left_anti")
    added = last.filter(F.col("fix_action").startswith("add"))
    indicator_bridge = insert_absent(kept, added, pair)

    edits = of("add_facility_specialty", "update_facility_field")
    edited = apply_edits(replace(m, mapping=mapping, indicator_bridge=indicator_bridge), edits, "made_at", "action_id")

    dismissed = of("dismiss_only").select(F.trim("gap_id").alias("gap_id")).distinct()
    status = dismissed.select("gap_id", F.lit("dismissed").alias("status"), F.lit(DISMISS_NOTE).alias("resolution_notes"))
    return edited, apply_gap_status(gaps, status, now), rejected


def latest_status(edits: DataFrame, time: str, tie: str) -> DataFrame:
    """The last status edit per gap."""
    w = Window.partitionBy("gap_id").orderBy(F.desc(time), F.desc(tie))
    return edits.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
