"""Exact deduplication by progressive refinement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwright.llm import membership
from gapwright.llm.ranks import SALTS
from gapwright.llm.scratch import kept
from gapwright.llm.text import whole, without_spaces

PREFIX = 64  # code points


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, carry: dict[str, Column] | None = None
) -> DataFrame:
    """One row per input row: its id, ``keep_id`` (id of the row that stays),
    ``group_size``, ``kept``, and the ``carry`` columns, which are computed in
    the scan from ``_norm``, the text without white space.

    Texts are the same if equal without white space. The first pass makes
    narrow rows: rows are counted by length, lengths held once are done; the
    rest are counted by length and hash of the first ``prefix`` code points.
    Only rows in groups that survive both have their full text hashed
    (SHA-256) in the last pass and are grouped by it. Texts never move: what
    survives comes to the next scan as a bitmap of fixed size, whose rare false
    positives only look at some texts in vain.

    Of a group the row with most code points in the original text stays, then
    the smallest id (null ids last). Null text is an empty text; all empty
    texts are one group. Rows repeated in full, id included, are copies like
    any others: one of them stays. An empty table gives no rows. Other columns
    of the input are not looked at.
    """
    norm = without_spaces(whole(text_col))
    scan = docs.select(F.col(id_col).alias("_id"), F.length(whole(text_col)).alias("_points"), norm.alias("_norm")).select(
        "*", F.length("_norm").alias("_len"), F.xxhash64(F.substring("_norm", 1, prefix)).alias("_head")
    )
    narrow = scan.select("_len", "_head")
    lengths = narrow.groupBy("_len").count().where("count > 1").select("_len")
    shared = membership.bitmap(lengths.select(F.col("_len").cast("long").alias("_key")), "_key")
    of_shared = membership.flagged(narrow.withColumn("_key", F.col("_len").cast("long")), "_key", shared, "_open").where("_open")
    heads = of_shared.groupBy("_len", "_head").count().where("count > 1")
    survivors = membership.bitmap(heads.select(F.xxhash64("_len", "_head").alias("_key")), "_key")
    marked = membership.flagged(scan.withColumn("_key", F.xxhash64("_len", "_head")), "_key", survivors, "_open")
    rows = kept(
        marked.select(
            "_id", "_points", "_len", "_head", F.when(F.col("_open"), F.unhex(F.sha2("_norm", 256))).alias("_full"),
            F.monotonically_increasing_id().alias("_row"), *[c.alias(n) for n, c in (carry or {}).items()],
        ),
        "exact",
    )
    group = ["_len", "_head", "_full"]
    alone, open_rows = rows.where("_full IS NULL"), rows.where("_full IS NOT NULL")
    best = F.max(F.struct("_points", (-F.col("_id")).alias("_minus"), (-F.col("_row")).alias("_back"), F.col("_id").alias("keep")))
    groups = open_rows.groupBy(*group).agg(best.alias("_best"), F.count(F.lit(1)).alias("_size")).where("_size > 1")
    # a group goes out once for each salt, so its copies lie in as many tasks
    told = groups.select(*[F.col(c).alias(f"_of{c}") for c in group], "_best", "_size", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    spread = open_rows.withColumn("_own", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))
    same = reduce(lambda x, y: x & y, (F.col(c) == F.col(f"_of{c}") for c in group)) & (F.col("_own") == F.col("_salt"))
    shared = F.col("_size").isNotNull()
    joined = spread.join(told, same, "left").select(
        F.col("_id"), F.when(shared, F.col("_best.keep")).otherwise(F.col("_id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("_row") == -F.col("_best._back"), F.lit(True)).alias("kept"), *(carry or {}),
    )
    single = alone.select(
        "_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *(carry or {})
    )
    return single.unionByName(joined).withColumnRenamed("_id", id_col)
