"""Publishing of catalog tables by versions and a pointer.

The content of a table lies in version tables ``name__v1``, ``name__v2``, …,
each written once and never changed. ``name`` is a view of one of them and is
switched, in one catalog call, when the next version is complete: a reader sees
the old content or the new one, whenever it looks and wherever a run stops. The
version content before the current one is kept, so that readers that began with it can
end; what neither shows and what was left unfinished is dropped.

A keyed table can be published by buckets of its key: a version then holds only
the buckets that changed, and the view takes each bucket from the version that
wrote it last.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwright.sources.tables import write_table

Merge = Callable[[DataFrame, DataFrame], DataFrame]

# properties of the view
VERSION, PARTS, BEFORE, SPREAD = "gapwright.version", "gapwright.parts", "gapwright.before", "gapwright.buckets"
MARK = "gapwright.mark."

BUCKET = "__bucket"
BUCKETS = 32


def _numbered(spark: SparkSession, target: str, mark: str) -> list[int]:
    """Numbers of the tables ``target__<mark>N`` that there are."""
    space, _, name = target.rpartition(".")
    among = f"IN {space} " if space else ""
    names = [r["tableName"] for r in spark.sql(f"SHOW TABLES {among}LIKE '{name}__{mark}*'").collect()]
    ends = [n[len(name) + 2 + len(mark) :] for n in names if n.startswith(f"{name}__{mark}")]
    return sorted(int(e) for e in ends if e.isdigit())


def _told(spark: SparkSession, target: str) -> dict[str, str]:
    """What the view says of itself; nothing where ``target`` is no such view."""
    if not spark.catalog.tableExists(target):
        return {}
    told = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {target}").collect()}
    return told if VERSION in told else {}


def current(spark: SparkSession, target: str) -> int:
    """The newest version that ``target`` shows; 0 where it is no such view."""
    return int(_told(spark, target).get(VERSION, 0))


def mark(spark: SparkSession, target: str, name: str) -> str | None:
    """What was noted beside the content under this name."""
    return _told(spark, target).get(MARK + name)


def _next(spark: SparkSession, target: str) -> int:
    return max([current(spark, target), *_numbered(spark, target, "v")]) + 1


def _switch(
    spark: SparkSession, target: str, version: int, parts: Mapping[int, Sequence[int] | None] | None = None, spread: int = 0, marks: Mapping[str, str] | None = None
) -> None:
    """Let ``target`` show ``parts``: versions, with the buckets to take from
    each, or None for all rows. Marks not given stay as they are."""
    told = _told(spark, target)
    if not told and spark.catalog.tableExists(target):
        # a plain table of this name becomes the first version
        spark.sql(f"ALTER TABLE {target} RENAME TO {target}__v0")
    parts = {version: None} if parts is None else parts
    noted = {k: v for k, v in told.items() if k.startswith(MARK)} | {MARK + k: v for k, v in (marks or {}).items()}
    shown = {VERSION: str(version), PARTS: json.dumps({str(v): b for v, b in parts.items()}), BEFORE: json.dumps(_parts(told)), SPREAD: str(spread), **noted}
    columns = ", ".join(f"`{c}`" for c in spark.table(f"{target}__v{max(parts)}").columns if c != BUCKET)
    rows = [
        f"SELECT {columns} FROM {target}__v{v}" + ("" if b is None else f" WHERE {BUCKET} IN ({', '.join(map(str, b))})") for v, b in sorted(parts.items())
    ]
    said = ", ".join("'{}' = '{}'".format(k, v.replace("'", "\\'")) for k, v in shown.items())
    spark.sql(f"CREATE OR REPLACE VIEW {target} TBLPROPERTIES ({said}) AS {' UNION ALL '.join(rows)}")


def _parts(told: Mapping[str, str]) -> dict[str, list[int] | None]:
    return json.loads(told.get(PARTS, "{}"))


def _clean(spark: SparkSession, target: str) -> None:
    """Drop versions that neither the content nor the one before it shows."""
    told = _told(spark, target)
    kept = {int(v) for v in [*_parts(told), *json.loads(told.get(BEFORE, "{}"))]}
    if not json.loads(told.get(BEFORE, "{}")):
        kept.add(0)  # a plain table that was there before
    for n in _numbered(spark, target, "v"):
        if n not in kept:
            spark.sql(f"DROP TABLE IF EXISTS {target}__v{n}")


def replace_table(spark: SparkSession, target: str, df: DataFrame) -> DataFrame:
    """Put a new content in place of a table that ``df`` may itself read, and
    give the table as it is now. Frames read from the content before stay good
    until the table is replaced once more."""
    version = _next(spark, target)
    write_table(df, f"{target}__v{version}")
    _switch(spark, target, version)
    _clean(spark, target)
    return spark.table(f"{target}__v{version}")


def drop(spark: SparkSession, target: str) -> None:
    """Take the table away with all its versions."""
    spark.sql(f"DROP VIEW IF EXISTS {target}")
    for part in ("v", "staging"):
        for n in _numbered(spark, target, part):
            spark.sql(f"DROP TABLE IF EXISTS {target}__{part}{n}")


def _sums(df: DataFrame, bucket: Column) -> DataFrame:
    """Rows of each bucket, and the sum of their hashes: two contents of the
    same sums are taken for equal (64-bit hashes of whole rows)."""
    # hashing passes nulls over, so where they are is hashed as well
    empty = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in df.columns])
    row = F.xxhash64(empty, *[F.col(c) for c in df.columns]).cast("decimal(38,0)")
    return df.groupBy(bucket.alias(BUCKET)).agg(F.count(F.lit(1)).alias("n"), F.sum(row).alias("h"))


def publish_changed(
    spark: SparkSession, target: str, df: DataFrame, key: Sequence[str], buckets: int = BUCKETS, marks: Mapping[str, str] | None = None
) -> list[int]:
    """Put ``df``, which may read ``target`` itself, in its place, and write only
    those buckets of the key whose rows differ; the others keep their files.
    ``marks`` are noted with the same switch, so that content and mark change
    together. Gives the buckets written: none if all rows are there already."""
    told = _told(spark, target)
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    changed = list(range(buckets))
    same = told.get(SPREAD) == str(buckets) and spark.table(target).dtypes == df.dtypes
    if same:
        old, new = _sums(spark.table(target), bucket).alias("o"), _sums(df, bucket).alias("n")
        both = old.join(new, BUCKET, "full").where(~(F.col("o.n").eqNullSafe(F.col("n.n")) & F.col("o.h").eqNullSafe(F.col("n.h"))))
        changed = sorted(r[BUCKET] for r in both.select(BUCKET).collect())  # one row a bucket at most
    parts = {int(v): b for v, b in _parts(told).items()} if same else {}
    version = current(spark, target)
    if changed or not same:
        version = _next(spark, target)
        rows = df.withColumn(BUCKET, bucket).where(F.col(BUCKET).isin(changed)).hint("rebalance", BUCKET)
        rows.write.mode("overwrite").format("parquet").partitionBy(BUCKET).saveAsTable(f"{target}__v{version}")
        left = {v: [b for b in own if b not in changed] for v, own in parts.items()}
        parts = {v: own for v, own in left.items() if own} | {version: changed}
    elif all(mark(spark, target, k) == v for k, v in (marks or {}).items()):
        return []
    _switch(spark, target, version, parts, buckets, marks)
    _clean(spark, target)
    return changed


def recover_tables(spark: SparkSession, targets: Sequence[str]) -> None:
    """Take away what interrupted runs left behind. What ``target`` shows does
    not change, but for a plain table that was renamed and not yet shown again."""
    for target in targets:
        numbers = _numbered(spark, target, "v")
        if numbers and not spark.catalog.tableExists(target):
            _switch(spark, target, numbers[-1])
        if numbers:
            _clean(spark, target)


def recover(spark: SparkSession, target: str, merge: Merge, key: Sequence[str] | None = None) -> None:
    """Finish what an interrupted run left: rows that were staged and not
    merged are merged. Running it again changes nothing."""
    recover_tables(spark, [target])
    for staged in _numbered(spark, target, "staging"):
        # the content notes which staging table it took in last
        if staged > int(mark(spark, target, "staged") or 0):
            _merge_staging(spark, target, staged, merge, key)
        else:
            spark.sql(f"DROP TABLE IF EXISTS {target}__staging{staged}")


def _merge_staging(spark: SparkSession, target: str, version: int, merge: Merge, key: Sequence[str] | None) -> None:
    staging = f"{target}__staging{version}"
    merged = merge(spark.table(target), spark.table(staging))
    if key:
        publish_changed(spark, target, merged, key, marks={"staged": str(version)})
    else:
        write_table(merged, f"{target}__v{version}")
        _switch(spark, target, version, marks={"staged": str(version)})
    spark.sql(f"DROP TABLE IF EXISTS {staging}")
    _clean(spark, target)


def publish(spark: SparkSession, target: str, found: DataFrame, merge: Merge, schema: str, key: Sequence[str] | None = None) -> DataFrame:
    """Merge newly found rows into ``target``: write them to a staging table,
    merge into the next version, switch the view, drop the staging table. A run
    that stopped before is finished first. With a ``key`` only changed buckets
    of the key are written."""
    recover(spark, target, merge, key)
    if not spark.catalog.tableExists(target):
        replace_table(spark, target, spark.createDataFrame([], schema))
    version = max(_next(spark, target), int(mark(spark, target, "staged") or 0) + 1)
    write_table(found, f"{target}__staging{version}")
    _merge_staging(spark, target, version, merge, key)
    return spark.table(target)
