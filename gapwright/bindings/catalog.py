"""Registry of bound queries and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwright.bindings import standins
from gapwright.functions.numbers import stable_round

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
# relations that only the oracles need, in DuckDB SQL
DERIVED: dict[str, str] = {}


def bind(key: str, query: Query, sql: str | None = None) -> None:
    if key in QUERIES:
        raise ValueError(f"{key} is bound twice")
    QUERIES[key] = query
    if sql is not None:
        ORACLE[key] = sql


def _definition(name: str) -> str | None:
    return DERIVED.get(name) or standins.SQL.get(name)


def oracle_text(sql: str) -> str:
    """Complete DuckDB statement: the relations the text names, then the text."""
    order: list[str] = []

    def add(name: str) -> None:
        text = _definition(name)
        if text is not None and name not in order:
            for dep in re.findall(r"@(\w+)", text):
                add(dep)
            order.append(name)

    for name in re.findall(r"@(\w+)", sql):
        add(name)

    def plain(text: str) -> str:
        return re.sub(r"@(\w+)", r"\1", text)

    parts = ", ".join(f"{n} AS ({plain(_definition(n))})" for n in order)
    return (f"WITH {parts} " if parts else "") + plain(sql)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles cut to what both engines agree on however they add up."""
    return df.select(
        *[stable_round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def r(expr: str, digits: int = 6) -> str:
    """The same rounding in DuckDB."""
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(38, 8)), {digits}) AS DOUBLE)"


def strip(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(trim({x}), '^[*_]+', ''), '[*_]+$', ''))"


def is_label(x: str) -> str:
    return f"({x} IS NOT NULL AND trim({x}) <> '' AND substr(trim({x}), 1, 1) NOT IN ('{{', '['))"

