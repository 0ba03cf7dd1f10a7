"""Token ids in directly addressable files."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gapwright.llm.scratch import kept
from gapwright.llm.text import whole
from gapwright.llm.tokens import encoder

CHUNK = 8  # bits of a chunk: one byte
RANKED = 512  # continuation bits between two entries of a rank directory
SEGMENT = 1 << 18  # ids in a segment, or one document where it is longer
SCHEMA = (
    "shard int, segment int, n_ids long, doc_ids array<bigint>, lengths array<bigint>, "
    "levels array<struct<chunks: binary, goes_on: binary, ranks: binary>>"
)
_ONES = np.array([bin(b).count("1") for b in range(256)], np.int64)


def encode(ids: np.ndarray) -> list[dict[str, bytes]]:
    """Directly addressable code of unsigned 32-bit ids. Level 0 holds the low
    chunk of every id and a bit for whether it goes on; level 1 the next chunk
    of those that do, and so on. The rank directory of a level counts the set
    bits before every 512th, so that an id's place in the next level is found
    with one look-up and at most 64 bytes of counting."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> CHUNK > 0
        bits = np.packbits(more, bitorder="little")
        before = np.concatenate([[0], np.cumsum(more)])[: len(rest) + 1 : RANKED].astype("<u4")
        levels.append({"chunks": (rest & 0xFF).astype(np.uint8).tobytes(), "goes_on": bits.tobytes(), "ranks": before.tobytes()})
        rest = rest[more] >> CHUNK
        if not len(rest):
            return levels


def decode(levels: list[dict[str, bytes]]) -> np.ndarray:
    """All ids, level by level from the last."""
    out = np.zeros(0, np.uint32)
    for level in reversed(levels):
        low = np.frombuffer(level["chunks"], np.uint8).astype("<u4")
        if len(out):
            more = np.unpackbits(np.frombuffer(level["goes_on"], np.uint8), count=len(low), bitorder="little").astype(bool)
            low[more] |= out << CHUNK
        out = low
    return out.astype("<u4")


def access(levels: list[dict[str, bytes]], at: int) -> int:
    """The id at one place, without decoding any other."""
    value = 0
    for n, level in enumerate(levels):
        value |= level["chunks"][at] << (CHUNK * n)
        bits = level["goes_on"]
        if not bits[at // 8] >> (at % 8) & 1:
            return value
        block = at // RANKED
        rank = int(np.frombuffer(level["ranks"], "<u4", 1, 4 * block)[0])
        first = block * RANKED // 8
        rank += int(_ONES[np.frombuffer(bits, np.uint8, at // 8 - first, first)].sum()) + int(_ONES[bits[at // 8] & ((1 << at % 8) - 1)])
        at = rank
    raise ValueError("the last level goes on")


def write(docs: DataFrame, path: str, tokenizer: str, end: int | None = 0, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> None:
    """Encode every whole text, append ``end``, and write the ids in ascending
    order of id (nulls last, rows of one id by text) to the folder ``path``.

    The files are Parquet without compression; a row is a segment: its shard
    (in the order of ids), its number in the shard, the ids and lengths of its
    documents, and the code of its tokens. Documents are not split: a segment
    ends with the first one that fills it. Null and empty texts are the end id
    alone (nothing, if ``end`` is None). Repeated rows are written as often as
    they occur. An empty table gives a folder without segments. Other columns
    are not looked at. A very long text is a segment of its own. Spark commits the files, so lost or repeated tasks
    leave nothing behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded, shard = encoder(tokenizer), TaskContext.get().partitionId()
        tail = b"" if end is None else end.to_bytes(4, "little")
        number, doc_ids, parts, size = 0, [], [], 0

        def closed() -> pa.RecordBatch:
            levels = encode(np.frombuffer(b"".join(parts), "<u4"))
            row = {"shard": shard, "segment": number, "n_ids": size, "doc_ids": doc_ids, "lengths": [len(p) // 4 for p in parts], "levels": levels}
            return pa.RecordBatch.from_pylist([row], _ARROW)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for doc, ids in zip(part["_id"].to_pylist(), encoded(part["_text"].to_pylist()), strict=True):
                    doc_ids.append(doc)
                    parts.append(ids + tail)
                    size += len(parts[-1]) // 4
                    if size >= segment:
                        yield closed()
                        number, doc_ids, parts, size = number + 1, [], [], 0
        if parts:
            yield closed()

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), whole(text_col).alias("_text"))
    order = [F.col("_id").asc_nulls_last(), F.col("_text")]
    dealt = rows.repartitionByRange(F.col("_id").asc_nulls_last()).sortWithinPartitions(*order)
    dealt.mapInArrow(run, SCHEMA).write.option("compression", "none").parquet(path)


_ARROW = pa.schema(
    [
        ("shard", pa.int32()), ("segment", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
        ("levels", pa.list_(pa.struct([("chunks", pa.binary()), ("goes_on", pa.binary()), ("ranks", pa.binary())]))),
    ]
)


def segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def starts(found: DataFrame) -> DataFrame:
    """(shard, segment, base): ids before each segment. A shard's segments are
    added up within the shard; over all shards there is a row for each."""
    sizes = found.select("shard", "segment", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    all_before = Window.partitionBy().orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select(F.col("shard").alias("_shard"), F.coalesce(F.sum("n").over(all_before), F.lit(0)).alias("_base"))
    before = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    inner = sizes.withColumn("_inner", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    return inner.join(bases, F.col("shard") == F.col("_shard")).select("shard", "segment", (F.col("_base") + F.col("_inner")).alias("base"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files:
    ids of all documents before it, its own, and their CRC-32 as little-endian
    unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                s = batch.slice(row, 1)
                ids = memoryview(decode(s["levels"].to_pylist()[0]).tobytes())
                lengths = np.asarray(s["lengths"][0].values, np.int64)
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, s["shard"][0].as_py(), np.int32)), pa.array(np.full(n, s["segment"][0].as_py(), np.int32)), s["doc_ids"][0].values,
                     pa.array(ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())],
                    ["shard", "segment", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    found = segments(spark, path)
    rows = kept(found.mapInArrow(run, "shard int, segment int, doc_id long, local long, n_tokens long, ids_crc32 long"), "read")
    bases = starts(found).withColumnsRenamed({"shard": "_s", "segment": "_g"})
    joined = rows.join(bases, (F.col("shard") == F.col("_s")) & (F.col("segment") == F.col("_g")))
    return joined.select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
