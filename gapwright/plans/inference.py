"""Labels for entities that have none: context text, a pluggable classifier,
and reading of a model's answer."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwright.functions.text import context_text, nullify
from gapwright.operators.aggregates import attach_stats, label_list
from gapwright.operators.aggregates import labels as distinct_labels


def facility_context(name: Column, kind: Column, description: Column) -> Column:
    return context_text([
        ("Facility name:", nullify(name), "Unknown"),
        ("Facility type:", nullify(kind), "unknown"),
        ("Description:", nullify(description, ("",)), "none"),
    ])


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def by_token_overlap(contexts: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``inferred_label``: the label sharing the most words with the whole
    ``context_text``, ties to the smallest label, NULL where none shares a word.

    The default classifier: it needs no model, and there may be any number of
    labels. Words of different contexts are cut down to those that labels use.
    Contexts with the same words left have the same label, so each such set is
    matched once: its words meet the labels' in an equi join, shared words are
    counted per label, and the best label goes back to the contexts."""
    used = labels.select("label", F.explode(_words(F.col("label"))).alias("word"))
    texts = contexts.select("context_text").filter("context_text IS NOT NULL").distinct()
    words = texts.select(F.md5("context_text").alias("__text"), F.explode(_words(F.col("context_text"))).alias("word"))
    hits = words.join(used.select("word").distinct(), "word", "left_semi")
    sets = hits.groupBy("__text").agg(F.array_sort(F.collect_set("word")).alias("__set"))
    shared = sets.select("__set").distinct().select("__set", F.explode("__set").alias("word")).join(used, "word")
    counted = shared.groupBy("__set", "label").agg(F.count(F.lit(1)).alias("__n"))
    best = counted.groupBy("__set").agg(F.min(F.struct(-F.col("__n"), "label"))["label"].alias("inferred_label"))
    found = sets.join(best, "__set").select("__text", "inferred_label")
    return contexts.join(found, F.md5("context_text") == F.col("__text"), "left").drop("__text")


def infer_labels(
    missing: DataFrame,
    labels: DataFrame,
    key: str,
    classifier: Callable[[DataFrame, DataFrame], DataFrame] = by_token_overlap,
) -> DataFrame:
    """``key, context_text, inferred_label`` for rows with ``context_text``.
    ``labels`` has one text column; all its distinct labels are candidates. A
    classifier adds ``inferred_label`` to the rows; it may call a model through
    ``classify_udf``."""
    return classifier(missing, distinct_labels(labels, labels.columns[0])).select(key, "context_text", "inferred_label")


def corrections_from_labels(inferred: DataFrame, key: str, now: Column) -> DataFrame:
    """Inferred labels as correction rows, for writing back through an overlay."""
    return inferred.filter(nullify(F.col("inferred_label"), ("",)).isNotNull()).select(
        key, F.to_json(F.array("inferred_label")).alias("specialties_raw"), now.alias("updated_at")
    )


Classifier = Callable[[list[str], list[str]], Sequence[str | None]]


def classify_udf(load: Callable[[], Classifier], labels: Sequence[str], name: str | None = None):
    """A text classifier as a vectorised UDF over context text, for use where a
    model runs in the tasks. ``load`` gives a function from a list of texts and
    the labels to one label or None per text. Each batch asks it once, and once
    for each different text in it. A model with a ``name`` is loaded once per
    Python worker and serves its later tasks; without one, once per task."""
    fixed = list(labels)

    @F.pandas_udf("string")
    def classified(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = sys.__dict__.setdefault("_gapwright_models", {}) if name else {}
        if name not in held:
            held[name] = load()
        model = held[name]
        for texts in batches:
            asked = texts.dropna().unique().tolist()
            said = dict(zip(asked, model(asked, fixed), strict=True)) if asked else {}
            yield texts.map(said).astype(object).where(texts.notna(), None)

    return classified


PROMPT_HEAD = (
    "Read the record of a care provider below and name its field of medicine.\n"
    "Choose one of the labels listed here and write that label, nothing else.\n\n"
    "Labels to choose from:"
)
PROMPT_RECORD = "Record:"


def prompt(context: Column, labels: Column) -> Column:
    """Question for a language model about one context."""
    return F.concat_ws(
        "\n", F.lit(PROMPT_HEAD), F.array_join(labels, ", "), F.lit(""), F.lit(PROMPT_RECORD), context
    )


def parse_answer(answer: Column, labels: Column) -> Column:
    """Label meant by a model's answer: the first label equal to it but for case,
    else the first one it contains, else the answer itself; '' gives NULL. A code
    fence around the answer is taken off."""
    bare = F.regexp_replace(F.trim(answer), r"(?i)^```[a-z]*\n?", "")
    bare = F.trim(F.regexp_replace(bare, r"\n?```$", ""))
    low = F.lower(bare)
    equal = F.try_element_at(F.filter(labels, lambda x: F.lower(x) == low), F.lit(1))
    inside = F.try_element_at(F.filter(labels, lambda x: F.contains(low, F.lower(x))), F.lit(1))
    return F.nullif(F.coalesce(equal, inside, bare), F.lit(""))


def suggest_labels(
    missing: DataFrame,
    labels: DataFrame,
    key: str,
    answer: Callable[[Column], Column],
    classifier: Callable[[DataFrame, DataFrame], DataFrame] = by_token_overlap,
) -> DataFrame:
    """``key, context_text, suggested_label, source``: the classifier's label, and
    where it has none the label read from ``answer(prompt)``. ``answer`` maps a
    prompt column to a text column, for instance a vectorised UDF that calls a
    model; it is asked once for each different context without a label, and
    what it says goes back to all rows of that context. All labels are
    candidates of the classifier; a prompt lists the first ``MOST_LABELS``."""
    first = infer_labels(missing, labels, key, classifier)
    listed = label_list(labels, labels.columns[0])
    context = F.col("context_text")
    open_ = first.filter(F.col("inferred_label").isNull() & context.isNotNull()).select("context_text").distinct()
    asked = attach_stats(open_, listed, "__l").select(F.md5("context_text").alias("__asked"), answer(prompt(context, F.col("__l.labels"))).alias("__answer"), "__l")
    told = asked.select("__asked", parse_answer(F.col("__answer"), F.col("__l.labels")).alias("__said"))
    unlabelled = F.when(F.col("inferred_label").isNull(), F.md5("context_text"))
    # rows that ask nothing meet no answer; null keys would bring them, texts and all, to one task
    place = F.coalesce(unlabelled, F.concat_ws("-", F.lit(""), F.col(key).cast("string"), F.md5("context_text")))
    both = first.join(told, place == F.col("__asked"), "left")
    source = F.when(F.col("inferred_label").isNotNull(), "classify").when(F.col("__said").isNotNull(), "query")
    return both.select(key, "context_text", F.coalesce("inferred_label", "__said").alias("suggested_label"), source.alias("source"))


def parse_udf():
    """Vectorised twin of ``functions.numbers.suppressed_number``, kept to check
    that both give the same."""

    @F.pandas_udf("value double, suppressed boolean")
    def parsed(raw: pd.Series) -> pd.DataFrame:
        text = raw.str.strip()
        star = text.eq("*").fillna(False).astype(bool)
        bare = text.where(~star).str.replace(r"[()]", "", regex=True)
        return pd.DataFrame({"value": pd.to_numeric(bare, errors="coerce"), "suppressed": star})

    return parsed
