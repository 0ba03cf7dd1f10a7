"""Long and wide forms, JSON lists to rows, stacking of rows."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwright.functions.jsontext import json_list
from gapwright.functions.numbers import suppressed_number


def unpivot(
    wide: DataFrame, ids: Sequence[str], key: str = "indicator_key", skip: Sequence[str] = ()
) -> DataFrame:
    """One row per (ids, column) with ``indicator_value, is_suppressed,
    indicator_raw``, all columns out of a single scan.

    Every cell goes through its text form, which keeps numbers exactly, so that
    text and numeric columns are parsed by one expression after the unpivot.
    (Unpivoting structs is no alternative: Spark takes their fields' nullability
    from the first column.)
    """
    names = [c for c in wide.columns if c not in ids and c not in skip]
    cells = wide.select(*ids, *[F.col(f"`{c}`").cast("string").alias(c) for c in names])
    long = cells.unpivot(list(ids), [f"`{c}`" for c in names], key, "indicator_raw")
    number = suppressed_number(F.col("indicator_raw"))
    return long.select(
        *ids,
        key,
        number["value"].alias("indicator_value"),
        number["suppressed"].alias("is_suppressed"),
        "indicator_raw",
    )


def pivot_max(long: DataFrame, by: Sequence[str], wanted: Mapping[str, str], key: str, value: str) -> DataFrame:
    """Wide form of the wanted keys, ``{output column: key}``, by one aggregation."""
    return (
        long.filter(F.col(key).isin(*wanted.values()))
        .groupBy(*by)
        .agg(*[F.max(F.when(F.col(key) == k, F.col(value))).alias(out) for out, k in wanted.items()])
    )


def explode_json_list(df: DataFrame, col: str, out: str) -> DataFrame:
    """One row per list element; rows whose text is no list give none."""
    return df.withColumn(out, F.explode(json_list(F.col(col))))


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


def distinct_union(*dfs: DataFrame) -> DataFrame:
    return union_all(*dfs).distinct()


def set_difference(expected: DataFrame, found: DataFrame, col: str) -> DataFrame:
    """``value, side``: expected but not found, and found but not expected."""
    a = expected.select(F.col(col).alias("value"))
    b = found.select(F.col(col).alias("value"))
    return union_all(
        a.subtract(b).withColumn("side", F.lit("missing")),
        b.subtract(a).withColumn("side", F.lit("unexpected")),
    )


def stack_rows(one_row: DataFrame, rows: Sequence[Mapping[str, Column]]) -> DataFrame:
    """Several output rows out of a one-row frame of statistics, without
    computing the statistics again per row."""
    structs = [F.struct(*[c.alias(n) for n, c in row.items()]) for row in rows]
    return one_row.select(F.inline(F.array(*structs)))


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table_name, row_count`` in name order, as one job."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return union_all(*counts).orderBy("table_name")


def pivot_top(ranked: DataFrame, by: Sequence[str], rank: str, label: Column, k: int = 3) -> DataFrame:
    """Labels of ranks 1..k as columns ``top_1 .. top_k``; among equal ranks the
    smallest label."""
    rows = ranked.filter(F.col(rank) <= k).withColumn("__label", label)
    wide = rows.groupBy(*by).pivot(rank, list(range(1, k + 1))).agg(F.min("__label"))
    return wide.select(*by, *[F.col(str(i)).alias(f"top_{i}") for i in range(1, k + 1)])


def resolve_columns(df: DataFrame, patterns: Mapping[str, str]) -> dict[str, str]:
    """Per role the first column, in the table's order, whose name matches the
    role's regular expression (any case). A column serves one role: roles choose
    in the order given. Looks at the schema only; raises where a role finds none."""
    free, found = list(df.columns), {}
    for role, pattern in patterns.items():
        match = next((c for c in free if re.search(pattern, c, re.IGNORECASE)), None)
        if match is None:
            raise ValueError(f"no column for {role} in {df.columns}")
        found[role] = match
        free.remove(match)
    return found
