"""Connected components of links between numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwright.llm.scratch import kept

MOST_ROUNDS = 60


def _settled(now: DataFrame) -> bool:
    """Whether every node with a smaller neighbour has one, and that has none."""
    ends = now.select(F.col("u").alias("w"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        now.select(F.col("v").alias("w"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    open_ = ends.groupBy("w").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1")
    return open_.agg(F.count(F.lit(1))).first()[0] == 0


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with a link: root is the smallest number
    that can be reached. In a round every node goes from its smallest smaller
    neighbour to that one's own, and hands it to its other smaller neighbours;
    a link becomes one link, so links never grow in number. Minima and repeats
    add up before the shuffle, and no node's links meet in one task but in equi
    joins that can be split. Each round is written and read again; rounds grow
    with the logarithm of the longest chain, none follows once all nodes hang
    on roots, and over ``MOST_ROUNDS`` of them are an error. Links of a node to
    itself, repeated ones and nulls add nothing."""
    there = links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    now = kept(there.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    for _ in range(MOST_ROUNDS):
        if _settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        least = now.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        after = least.select(F.col("w").alias("x"), F.col("m").alias("y"))
        to = least.join(after, F.col("m") == F.col("x"), "left").select("w", "m", F.coalesce("y", "m").alias("to"))
        moved = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
        now = kept(now.join(to, F.col("u") == F.col("w")).select(moved.alias("u"), F.col("to").alias("v")).distinct(), "links")
    raise RuntimeError("the components did not settle")
