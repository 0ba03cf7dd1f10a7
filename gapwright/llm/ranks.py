"""Ranks within groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapwright.llm.scratch import kept

SALTS = 16
PART, LINE, BEFORE = "_part", "_line", "_before"


def ranked(df: DataFrame, groups: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with each row's rank (from 1) in its group, by ``order``, nulls
    last. Rows are dealt by range of group and order, so a hot group lies in
    many partitions; a row's rank is its place in its partition plus the rows
    of its group in earlier partitions. Those counts are a row for each
    partition and group in it. The order must be total for repeatable ranks;
    the written rows fix one order for rows equal in all of it."""
    keys = [F.col(c).asc_nulls_last() for c in [*groups, *order]]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = kept(
        dealt.withColumn(PART, F.spark_partition_id()).withColumn(LINE, F.monotonically_increasing_id()), "ranked"
    )
    counts = rows.groupBy(PART, *groups).agg(F.count(F.lit(1)).alias("_n"), F.min(LINE).alias("_first"))
    earlier = Window.partitionBy(*groups).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")
    bases = counts.select(*[F.col(c).alias(f"_of{c}") for c in (PART, *groups)], base.alias(BEFORE))
    here = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in (PART, *groups)))
    return rows.join(bases, here).select(*df.columns, (F.col(LINE) + F.col(BEFORE) + 1).alias(name))


def salted_join(left: DataFrame, right: DataFrame, on: str, salts: int = SALTS) -> DataFrame:
    """Equi join on one column that ``left`` may hold very often and ``right``
    holds once: ``right`` goes out once for each salt, so a hot key of ``left``
    lies in as many tasks. Its rows are dealt by a hash of all their columns."""
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [on, "_salt"]).drop("_salt")
