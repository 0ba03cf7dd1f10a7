"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapwright.llm.ranks import ranked
from gapwright.llm.scratch import kept

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SEED = 20


def offset(seed: int = SEED) -> float:
    """The random offset of the sampling grid, between 0 and 1."""
    return random.Random(seed).random()


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``. Sources in code point
    order, null last, take the weights in turn and share ``share`` times all
    sizes; a target stops at ``cap`` times its source's size and the excess
    goes to the others by weight. That is a water level: sources ordered by
    the level at which they stop, the first level that stops no later source
    is the one. One row for each source: windows over all of them are small.
    """
    everything = Window.partitionBy()
    in_order = everything.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int"))
    capped = sizes.withColumn("_weight", weight.cast("double")).withColumn("_cap", cap * F.col("source_size"))
    stop = everything.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = stop.rowsBetween(Window.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    )
    levels = capped.withColumn("_level", level)
    holds = F.col("_level") <= F.col("_cap") / F.col("_weight")
    final = F.min(F.when(holds, F.struct(F.col("_cap") / F.col("_weight"), F.col("_level").alias("v")))).over(everything)["v"]
    return levels.withColumn("_final", final).select(
        "source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_final") * F.col("_weight"), F.col("_cap"))).alias("target")
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size",
    weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED,
) -> DataFrame:
    """``docs`` with ``source_size``, ``target``, ``copies`` and ``taken``.

    Each document of a source is expected target / source size times. In the
    order of size, then id, these expectations are added up within the source;
    with one random offset added, a document is taken once for every integer
    its sum crosses. Its copies so differ from the expectation by less than
    one, and ordering by size keeps the words taken near the target. The same
    input and seed give the same mix.

    The prefix sums are ranks times the source's ratio; ranks come from range
    partitions, so no source has to fit in a task. Sources with null names are
    one source, ordered last. Empty documents take part; a source of nothing
    but empty documents has target 0 and gives no copies. Repeated rows are
    documents of their own. An empty table gives no rows. Other columns pass
    through; those named like a result are replaced. A very long document is one
    row as any other; being taken or not, it may carry its source off its
    target by up to its own size, so the largest document bounds the distance.
    Targets come from a window over one row per source, in one task.
    """
    rows = ranked(docs.drop("source_size", "target", "copies", "taken"), [source_col], [size_col, id_col], "_rank")
    sizes = kept(rows.groupBy(F.col(source_col).alias("source")).agg(F.sum(size_col).alias("source_size")), "sizes")
    plan = targets(sizes, weights, share, cap).withColumnRenamed("source", "_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    u = F.lit(offset(seed))
    copies = F.floor(F.col("_rank") * ratio + u) - F.floor((F.col("_rank") - 1) * ratio + u)
    out = rows.join(plan, rows[source_col].eqNullSafe(plan["_source"])).withColumn("copies", copies)
    return out.withColumn("taken", F.col("copies") * F.col(size_col)).drop("_rank", "_source")


def emitted(mixed: DataFrame, columns: list[Column]) -> DataFrame:
    """The mix itself: each document as often as it is taken."""
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*columns)
