"""Row filters and their audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwright.functions.text import is_label, nullify, populated_count


def drop_sparse(df: DataFrame, min_populated: int = 2, cols: Sequence[str] | None = None) -> DataFrame:
    """Keep rows with at least ``min_populated`` filled columns."""
    names = df.columns if cols is None else cols
    return df.filter(populated_count([df[c] for c in names]) >= min_populated)


def drop_json_garbage(df: DataFrame, col: str) -> DataFrame:
    """Keep rows whose text is a label: not blank and no JSON fragment."""
    return df.filter(is_label(F.col(col)))


def facility_gate() -> dict[str, Column]:
    """Named rules a curated facility row has to meet."""
    c = F.col
    has_operator = nullify(c("operator_type_raw")).isNotNull()
    return {
        "postal_code": c("pincode").isNotNull(),
        "confidence": c("join_confidence").isin("high", "medium"),
        "coordinates": c("coord_valid"),
        "type": nullify(c("facility_type")).isNotNull()
        & ~c("facility_type").rlike("^[0-9.]+$"),
        "operator": ~((c("operator_type") == "unknown") & has_operator),
        "labels": nullify(c("specialties_raw")).isNotNull()
        & c("specialties_raw").startswith("["),
    }


def _held(rule: Column) -> Column:
    return F.coalesce(rule, F.lit(False))


def apply_gate(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [_held(r) for r in rules.values()]))


def gate_audit(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """``rule, failed, total``: failures per rule, and of all rules together
    under ``any``. One pass over the data, one conditional sum per rule."""
    tests = {name: ~_held(rule) for name, rule in rules.items()}
    tests["any"] = reduce(lambda a, b: a | b, list(tests.values()))
    sums = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(t).alias(f"failed_{i}") for i, t in enumerate(tests.values())],
    )
    rows = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(f"failed_{i}").alias("failed"), F.col("total"))
        for i, name in enumerate(tests)
    ])
    return sums.select(F.inline(rows))
