"""A set of keys as a bitmap of fixed size that every task can hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_BITS = 32768  # of one row of bitmap_construct_agg
BITS = 1 << 24


def bit_of(key: Column, bits: int = BITS) -> Column:
    """From 1 on, as Spark's bitmap functions count."""
    return F.pmod(key, F.lit(bits)) + 1


def bitmap(keys: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """Rows (``_bucket``, ``_bits``): at most ``bits / 32768`` rows of 4 KB,
    2 MB by default, whatever the input. A bit is set if a key falls on it."""
    place = bit_of(F.col(key), bits)
    return (
        keys.select(F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place).alias("_place"))
        .groupBy("_bucket")
        .agg(F.bitmap_construct_agg("_place").alias("_bits"))
    )


def flagged(df: DataFrame, key: str, members: DataFrame, name: str, bits: int = BITS) -> DataFrame:
    """``df`` with whether its key falls on a set bit: true for every member,
    and for few others while members are few next to ``bits``; false only for
    rows that are no members. The bitmap is broadcast: its size is bounded."""
    place = bit_of(F.col(key), bits)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.expr("CAST(_place DIV 8 AS INT) + 1"), F.lit(1))), 16, 10)
    found = F.coalesce(byte.cast("int").bitwiseAND(F.expr("shiftleft(1, CAST(_place % 8 AS INT))")) != 0, F.lit(False))
    return (
        df.withColumn("_bucket", F.bitmap_bucket_number(place))
        .withColumn("_place", F.bitmap_bit_position(place))
        .join(F.broadcast(members), "_bucket", "left")
        .withColumn(name, found)
        .select(*df.columns, name)
    )
