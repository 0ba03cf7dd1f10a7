"""Pairs of strings at edit distance 1, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spelling_form(c):
    """Form in which spellings are compared: lower case, no blanks or hyphens."""
    return F.regexp_replace(F.lower(c), "[ -]", "")


def near_forms(forms: DataFrame) -> DataFrame:
    """``a, b`` for all distinct strings ``form`` at Levenshtein distance 1.

    Two strings are at distance 1 in one of two ways, and each is an equality:

    * same length, one character differs: both give the same string when
      that position is cut out, and they do so at no other position;
    * one is the other plus a character: the shorter equals the longer with
      some character cut out.

    So two equi joins find every pair once and nothing else: there are no
    candidates to verify, and a bucket never holds more than the strings that
    differ in one given position. Each string gives as many rows as it has
    characters, which Spark's size estimates, made from the files, do not know;
    the joins ask for a merge, as neither side may be sent through the driver.
    """
    cut = F.expr(
        "transform(sequence(1, length(form)), "
        "i -> struct(i AS pos, concat(substring(form, 1, i - 1), substring(form, i + 1)) AS rest))"
    )
    cuts = forms.filter(F.length("form") > 0).select("form", F.inline(cut))
    left = cuts.select(F.col("form").alias("a"), "pos", "rest", F.length("form").alias("len"))
    right = cuts.select(F.col("form").alias("b"), "pos", "rest", F.length("form").alias("len"))
    swapped = left.join(right.hint("merge"), ["pos", "rest", "len"]).filter("a < b").select("a", "b")
    rests = F.expr(
        "array_distinct(transform(sequence(1, length(form)), "
        "i -> concat(substring(form, 1, i - 1), substring(form, i + 1))))"
    )
    longer = forms.filter(F.length("form") > 0).select(
        F.col("form").alias("__long"), F.explode(rests).alias("rest")
    )
    shorter = forms.select(F.col("form").alias("__short"))
    grown = shorter.join(longer.hint("merge"), F.col("__short") == F.col("rest")).select(
        F.least("__short", "__long").alias("a"), F.greatest("__short", "__long").alias("b")
    )
    return swapped.unionAll(grown)


def near_pairs(df: DataFrame, col: str, usage: str) -> DataFrame:
    """``a, b, a_cnt, b_cnt``: spellings ``a < b`` whose compared forms are at
    distance 1, with how often each is used. ``df`` has one row per spelling."""
    spellings = df.select(F.col(col).alias("s"), F.col(usage).alias("n")).withColumn(
        "form", spelling_form(F.col("s"))
    )
    pairs = near_forms(spellings.select("form").distinct())
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = spellings.select(F.col("form").alias("a_form"), F.col("s").alias("a"), F.col("n").alias("a_cnt"))
    second = spellings.select(F.col("form").alias("b_form"), F.col("s").alias("b"), F.col("n").alias("b_cnt"))
    linked = both.select(F.col("a").alias("a_form"), F.col("b").alias("b_form"))
    return (
        linked.join(first.hint("merge"), "a_form")
        .join(second.hint("merge"), "b_form")
        .filter("a < b")
        .select("a", "b", "a_cnt", "b_cnt")
    )
