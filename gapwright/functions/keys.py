"""Surrogate keys and region keys."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from gapwright.functions.fixed import DISTRICT_KEY_ALIASES, STATE_KEY_ALIASES


def surrogate_key(*cols: Column, sep: str = "|") -> Column:
    return F.md5(F.concat_ws(sep, *cols).cast("binary"))


def _aliased(key: Column, aliases: Mapping[str, str]) -> Column:
    if not aliases:
        return key
    pairs = [F.lit(x) for kv in aliases.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), key)


def match_key(c: Column) -> Column:
    """Form of a name used on both sides of a join: trimmed and upper-case."""
    return F.upper(F.trim(c))


def state_key(state: Column, aliases: Mapping[str, str] = STATE_KEY_ALIASES) -> Column:
    key = F.regexp_replace(match_key(state), r"\s+AND\s+", " & ")
    return _aliased(F.regexp_replace(key, r"\s+", " "), aliases)


def district_key(district: Column, aliases: Mapping[str, str] = DISTRICT_KEY_ALIASES) -> Column:
    key = F.regexp_replace(match_key(district), r"\.", "")
    return _aliased(F.regexp_replace(key, r"\s+", " "), aliases)


def region_key(
    district: Column,
    state: Column,
    district_aliases: Mapping[str, str] = DISTRICT_KEY_ALIASES,
    state_aliases: Mapping[str, str] = STATE_KEY_ALIASES,
) -> Column:
    return F.concat(
        district_key(district, district_aliases), F.lit("__"), state_key(state, state_aliases)
    )


def _title(c: Column) -> Column:
    t = F.regexp_replace(F.initcap(c), r"\bNct\b", "NCT")
    return F.regexp_replace(t, r"\bOf\b", "of")


def region_label(key: Column) -> Column:
    """``struct<district, state>`` display names of a region key."""
    at = F.instr(key, "__")
    district = F.when(at > 0, F.left(key, at - 1)).otherwise(key)
    state = F.when(at > 0, F.substr(key, at + 2)).otherwise(F.lit(""))
    return F.struct(
        F.when(at > 0, _title(district)).otherwise(district).alias("district"),
        _title(state).alias("state"),
    )
