"""Cleaning of text columns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_TOKENS = ("", "null")
UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def nullify(c: Column, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """Trimmed text, or NULL where it is one of the missing-value tokens."""
    t = F.trim(c)
    return F.when(~t.isin(*tokens), t)


def populated(c: Column, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """1 where the value, as text, is neither NULL nor a missing-value token.

    The trim names its character: as an expression it then differs from the
    plain ``trim(c)`` that cleaning projects right after, and the optimizer does
    not rewrite a filter on many such columns once per combination of them.
    """
    t = F.trim(c.cast("string"), F.lit(" "))
    return F.when(~t.isin(*tokens), 1).otherwise(0)


def populated_count(cols: Sequence[Column], tokens: Sequence[str] = NULL_TOKENS) -> Column:
    total = F.lit(0)
    for c in cols:
        total = total + populated(c, tokens)
    return total


def valid_id(c: Column, pattern: str = UUID_PATTERN) -> Column:
    return F.trim(c).rlike(pattern)


def standardize_enum(c: Column, mapping: Mapping[str, str], default: str) -> Column:
    """Canonical category for a raw value; matching ignores case and padding."""
    groups: dict[str, list[str]] = {}
    for raw, canonical in mapping.items():
        groups.setdefault(canonical, []).append(raw.lower())
    key = F.lower(F.trim(c))
    out = None
    for canonical, raws in groups.items():
        out = (F if out is None else out).when(key.isin(*raws), canonical)
    return out.otherwise(default) if out is not None else F.lit(default)


def strip_markup(c: Column) -> Column:
    """Drop leading and trailing runs of ``*`` and ``_`` around a label."""
    bare = F.regexp_replace(F.trim(c), "^[*_]+", "")
    return F.trim(F.regexp_replace(bare, "[*_]+$", ""))


def apply_rules(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Apply (pattern, replacement) spelling rules in order."""
    for pattern, replacement in rules:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def looks_like_json(c: Column) -> Column:
    t = F.trim(c)
    return t.startswith("{") | t.startswith("[")


def is_label(c: Column) -> Column:
    """True for real label text: not NULL, not blank, not a JSON fragment."""
    return F.coalesce((F.trim(c) != "") & ~looks_like_json(c), F.lit(False))


def _alternatives(pattern: str) -> list[str] | None:
    """The words of a pattern that is nothing but ``(word|word|…)``."""
    words = pattern.removeprefix("(").removesuffix(")").split("|")
    return words if all(re.fullmatch(r"[\w -]+", w) for w in words) else None


def matches(c: Column, pattern: str) -> Column:
    """Regular-expression match; plain alternatives are searched as substrings,
    which takes a fraction of the time on long texts."""
    words = _alternatives(pattern)
    if words is None:
        return c.rlike(pattern)
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def classify(c: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Category of the first (pattern, category) rule the lower-cased text matches."""
    key = F.lower(c)
    out = None
    for pattern, category in rules:
        out = (F if out is None else out).when(matches(key, pattern), category)
    return out.otherwise(default) if out is not None else F.lit(default)


def any_substring(c: Column, needles: Sequence[str]) -> Column:
    """1 where the lower-cased text contains any of the fixed needles."""
    key = F.lower(F.coalesce(c, F.lit("")))
    hit = F.lit(False)
    for needle in needles:
        hit = hit | key.contains(needle)
    return hit.cast("int")


def normalize_quotes(c: Column) -> Column:
    """Curly apostrophes become straight ones, so labels from two sources agree."""
    return F.regexp_replace(F.trim(c), "’", "'")


def label_fallback(name: Column, description: Column, key: Column) -> Column:
    """First usable of: name, description, the key itself."""
    return F.coalesce(
        nullify(name),
        nullify(F.trim(description), tokens=("",)),
        key,
    )


def context_text(fields: Sequence[tuple[str, Column, str]]) -> Column:
    """Multi-line text block of (heading, value, default) fields."""
    parts: list[Column] = []
    for heading, value, default in fields:
        parts += [F.lit(heading), F.coalesce(value, F.lit(default))]
    return F.concat_ws("\n", *parts)
