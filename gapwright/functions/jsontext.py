"""JSON kept in text columns: lists of labels, payloads, one-pair objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gapwright.functions.text import is_label, strip_markup


def json_list(c: Column) -> Column:
    """Array in a JSON-list text; NULL where the text is not a list."""
    return F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>"))


def unwrap_json_pair(c: Column) -> Column:
    """``{"x":"x"}`` becomes ``x``; any other text stays as it is."""
    name = F.regexp_extract(c, r'"([^"]+)"\s*:\s*"\1"', 1)
    return F.when(c.rlike(r"^\{.*\}$") & (name != ""), name).otherwise(c)


def payload(**cols: Column) -> Column:
    """JSON object of the given fields; NULL fields are left out."""
    return F.to_json(F.struct(*[c.alias(name) for name, c in cols.items()]))


def display_text(c: Column) -> Column:
    """One-entry JSON objects shown as their text value, or as their key when
    the value is no text; all other values as they are, NULL as ''."""
    entries = F.from_json(c, "map<string,string>")
    single = F.trim(c).startswith("{") & (F.size(entries) == 1)
    value = F.map_values(entries)[0]
    is_text = c.rlike(r'^\s*\{\s*"(?:[^"\\]|\\.)*"\s*:\s*"')
    shown = F.when(is_text & (F.trim(value) != ""), value).otherwise(F.map_keys(entries)[0])
    return F.coalesce(F.when(single, shown).otherwise(c), F.lit(""))


def parse_payload(c: Column) -> Column:
    """Payload text as a string map; text that is no JSON object gives an empty map."""
    fields = F.when(F.trim(c).startswith("{"), F.from_json(c, "map<string,string>"))
    shown = F.transform_values(fields, lambda _, v: display_text(v))
    return F.coalesce(shown, F.from_json(F.lit("{}"), "map<string,string>"))


def text_to_list(c: Column) -> Column:
    """Comma-separated input as a JSON list of cleaned labels."""
    t = F.trim(c)
    parts = F.filter(F.transform(F.split(t, ","), strip_markup), lambda x: x != "")
    return F.when(t == "", "[]").when(t.startswith("["), t).otherwise(F.to_json(parts))


def list_text(c: Column) -> Column:
    """JSON list as comma-separated text for editing; JSON fragments are skipped,
    text that is no list is cleaned, objects give ''."""
    cleaned = F.transform(json_list(c), strip_markup)
    joined = F.array_join(F.filter(cleaned, is_label), ", ")
    plain = F.when(is_label(c), strip_markup(c)).otherwise("")
    return F.coalesce(joined, plain, F.lit(""))
