"""Joins. Only relations of fixed, literal size carry a broadcast hint; for all
others Spark decides at run time from the sizes it has measured."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwright.functions.keys import match_key


def lookup(
    df: DataFrame, dim: DataFrame, on: str, alias: str, value: str, out: str, fallback: Column | None = None
) -> DataFrame:
    """Left lookup of ``dim.value`` by ``dim.alias``; the fallback (by default
    the looked-up column) where there is no match. ``dim`` has one row per alias."""
    found = dim.select(F.col(alias).alias("__alias"), F.col(value).alias("__value"))
    joined = df.join(found, F.col(on) == F.col("__alias"), "left")
    other = F.col(on) if fallback is None else fallback
    return joined.withColumn(out, F.coalesce("__value", other)).drop("__alias", "__value")


def merge_measures(
    left: DataFrame, right: DataFrame, keys: Sequence[str], measures: Sequence[str]
) -> DataFrame:
    """Full outer join on the keys; each measure is the sum of both sides, a
    missing side counting 0."""
    l, r = left.alias("l"), right.alias("r")
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    both = l.join(r, on, "full")

    def side(frame: DataFrame, alias: str, m: str) -> Column:
        return F.coalesce(F.col(f"{alias}.{m}"), F.lit(0)) if m in frame.columns else F.lit(0)

    return both.select(
        *[F.coalesce(F.col(f"l.{k}"), F.col(f"r.{k}")).alias(k) for k in keys],
        *[(side(left, "l", m) + side(right, "r", m)).alias(m) for m in measures],
    )


def without_match(df: DataFrame, other: DataFrame, on: Mapping[str, str] | Sequence[str]) -> DataFrame:
    return _matched(df, other, on, "left_anti")


def with_match(df: DataFrame, other: DataFrame, on: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Rows with at least one match; each row once."""
    return _matched(df, other, on, "left_semi")


def _matched(df: DataFrame, other: DataFrame, on, how: str) -> DataFrame:
    pairs = on if isinstance(on, Mapping) else {c: c for c in on}
    # a key repeated many times on the other side is sent once per task
    keys = other.select(*[F.col(r).alias(f"__{i}") for i, r in enumerate(pairs.values())]).distinct()
    cond = [F.col(l) == F.col(f"__{i}") for i, l in enumerate(pairs)]
    return df.join(keys, cond, how)


def attach_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row, as a scalar
    subquery: no join, no shuffle of ``df``."""
    value = one_row.select(F.struct(*one_row.columns)).scalar()
    out = df.withColumn("__scalar", value)
    return out.select(*df.columns, *[F.col("__scalar")[c].alias(c) for c in one_row.columns])


def join_normalized(
    left: DataFrame, right: DataFrame, keys: Mapping[str, str], how: str = "inner"
) -> DataFrame:
    """Equi join on trimmed upper-case keys; the keys of the right side are dropped."""
    l, r = left, right
    cond = []
    for i, (a, b) in enumerate(keys.items()):
        l = l.withColumn(f"__l{i}", match_key(F.col(a)))
        r = r.withColumn(f"__r{i}", match_key(F.col(b)))
        cond.append(F.col(f"__l{i}") == F.col(f"__r{i}"))
    extra = [f"__l{i}" for i in range(len(keys))] + [f"__r{i}" for i in range(len(keys))]
    return l.join(r.drop(*keys.values()), cond, how).drop(*extra)


def filter_category(df: DataFrame, col: str, category: str) -> DataFrame:
    """Rows of one category; ``ALL`` keeps every row and leaves no predicate in the plan."""
    return df if category == "ALL" else df.filter(F.col(col) == category)


# characters of the pieces by which words and values meet; shorter ones are their own piece
GRAM = 3


def contains_any(df: DataFrame, text: str, dim: DataFrame, value: str) -> DataFrame:
    """Rows whose lower-cased text contains any dimension value as a substring.

    Values are cut at spaces. A text that contains a value has, for every part
    of it, a word that contains the part, so texts are looked at word by word
    and each different word of the corpus once: a value waits at the rarest run
    of ``GRAM`` characters of its parts, the one in the fewest texts, counted
    over all; words that hold the run meet the value, then texts that have such
    a word, and what meets is compared. The same plan serves one value and any
    number of them. A value with a run that no word has is given up at once;
    blank values and null texts never match. Repeats and other columns stay as
    they are.
    """
    needle = F.lower(F.trim(F.col(value)))
    values = dim.select(needle.alias("__needle")).filter(F.col("__needle") != "").distinct()
    low = F.lower(F.trim(F.col(text)))
    texts = df.select(low.alias("__low")).filter("__low IS NOT NULL")
    held = _words(texts).select("__hash", F.explode("__all").alias("__word"))
    words = _words(texts).select(F.explode("__all").alias("__word")).groupBy("__word").agg(F.count(F.lit(1)).alias("__n"))
    # counts add up in each task, so what moves is different words; kept for both uses
    words = words.filter("__n > 0")
    pairs = held.join(_meeting(values, words), "__word").select("__hash", "__needle").distinct()
    return df.join(pairs, (F.xxhash64(low) == F.col("__hash")) & F.contains(low, F.col("__needle")), "left_semi")


def _words(texts: DataFrame) -> DataFrame:
    """Hash of each text, and its different words. Texts of one hash are told
    apart when what meets is compared."""
    return texts.select(F.xxhash64("__low").alias("__hash"), F.array_distinct(F.split("__low", " ")).alias("__all"))


def _runs(word: str, size: int) -> Column:
    """Different runs of ``size`` characters, in one pass over the word."""
    return F.array_distinct(F.regexp_extract_all(word, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _meeting(values: DataFrame, words: DataFrame) -> DataFrame:
    """``__word, __needle``: words that hold the part of a value it waits at."""
    parts = values.select("__needle", F.explode(F.split("__needle", " ")).alias("__part")).filter("__part <> ''")
    size = F.least(F.length("__part"), F.lit(GRAM))
    own = F.when(size == GRAM, _runs("__part", GRAM)).otherwise(F.array("__part"))
    runs = parts.select("__needle", "__part", F.explode(own).alias("__run"))
    # runs shorter than GRAM are looked for only if there are parts as short
    sizes = [_runs("__word", GRAM)]
    for n in range(1, GRAM):
        there = parts.agg(F.coalesce(F.bool_or(F.length("__part") == n), F.lit(False))).scalar()
        sizes.append(F.when(there, _runs("__word", n)).otherwise(F.array().cast("array<string>")))
    cut = words.select("__word", "__n", F.explode(F.concat(*sizes)).alias("__run"))
    counted = cut.groupBy("__run").agg(F.sum("__n").alias("__n"))
    least = F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__run").alias("run"), F.col("__part").alias("part")))
    anchors = runs.join(counted, "__run", "left").groupBy("__needle").agg(least.alias("__l")).filter("__l.n > 0")
    waiting = anchors.select("__needle", F.col("__l.run").alias("__run"), F.col("__l.part").alias("__part"))
    return cut.join(waiting, "__run").filter(F.contains("__word", "__part")).select("__word", "__needle")


def compare(
    baseline: DataFrame, modified: DataFrame, keys: Sequence[str], measures: Sequence[str]
) -> DataFrame:
    """``baseline_m, scenario_m, delta_m`` per key of either frame."""
    b, s = baseline.alias("b"), modified.alias("s")
    both = b.join(s, [F.col(f"b.{k}") == F.col(f"s.{k}") for k in keys], "full")
    out = [F.coalesce(F.col(f"b.{k}"), F.col(f"s.{k}")).alias(k) for k in keys]
    for m in measures:
        before, after = F.col(f"b.{m}"), F.col(f"s.{m}")
        out += [
            before.alias(f"baseline_{m}"),
            after.alias(f"scenario_{m}"),
            (after - before).alias(f"delta_{m}"),
        ]
    return both.select(*out)


def ratio_row(spark, **scalars: DataFrame) -> DataFrame:
    """One row with a column per one-value frame."""
    return spark.range(1).select(*[df.scalar().alias(name) for name, df in scalars.items()])
