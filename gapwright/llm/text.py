"""What counts as white space, a word and a line, for all operators here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def whole(text: Column | str) -> Column:
    """Text as a string, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def without_spaces(text: Column) -> Column:
    """``replace`` looks for one byte at a time and is far quicker here than
    ``translate``, which looks up every character."""
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is. ``lower`` does that for ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case."""
    return lower_ascii(F.trim(line, F.lit(SPACES)))
