"""Near-duplicates by SimHash, compared in bit slices."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwright.llm import membership
from gapwright.llm.components import components
from gapwright.llm.scratch import kept
from gapwright.llm.text import whole

SHINGLE = 3
RADIUS = 2
SEED = 42
MANY = 2048  # fingerprints under one key before the key is made finer
SMALL = 64  # groups compared all together, neighbour by neighbour
LANES = 1 << 15


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64 bits; a bit is set if it is in over half of the shingles' hashes."""
    words = text.encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(0, len(words) - shingle)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: last + 1].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), LANES):
        part = hashes[at : at + LANES]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with ``fp``, the fingerprint as a signed long, in place of the text."""
    carried = [c for c in docs.columns if c not in (text_col, "fp")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch["_text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in carried), pa.array(found)], [*carried, "fp"])

    schema = docs.select(*carried).schema.add("fp", "long")
    return docs.select(*carried, whole(text_col).alias("_text")).mapInArrow(run, schema)


def planes(fps: np.ndarray) -> np.ndarray:
    """(64, n) bits: plane b holds bit b of every fingerprint."""
    return np.ascontiguousarray(np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T)


class Counters:
    """Distances of many lanes, kept as bit planes and counted up by carry."""

    def __init__(self, shape: tuple[int, ...], radius: int):
        self.radius = radius
        self.bits = [np.zeros(shape, np.uint8) for _ in range(max(1, radius.bit_length()))]
        self.over = np.zeros(shape, np.uint8)

    def add(self, differs: np.ndarray) -> None:
        for k, bit in enumerate(self.bits):
            self.bits[k], differs = bit ^ differs, bit & differs
        self.over |= differs

    def beyond(self) -> np.ndarray:
        above, level = self.over.copy(), ~np.zeros_like(self.over)
        for k in reversed(range(len(self.bits))):
            if self.radius >> k & 1:
                level &= self.bits[k]
            else:
                above |= level & self.bits[k]
                level &= ~self.bits[k]
        return above


def _near(differing, shape: tuple[int, ...], radius: int) -> np.ndarray:
    """Lanes (packed) within the radius; ``differing(b)`` gives plane b of the
    differences. Stops once every lane is beyond."""
    count = Counters(shape, radius)
    for b in range(64):
        count.add(differing(b))
        if b % 8 == 7 and np.all(count.beyond() == 0xFF):
            return np.zeros(shape, np.uint8)
    return ~count.beyond()


def near_pairs(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of one group within the radius. ``group`` ascends."""
    if len(fps) < 2:
        return
    begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(begins, len(group)))
    size_of = np.repeat(sizes, sizes)
    small = np.flatnonzero((size_of > 1) & (size_of <= SMALL))
    if len(small):
        bits = planes(fps[small])
        g = group[small]
        for d in range(1, SMALL):
            left = np.flatnonzero(g[:-d] == g[d:]) if d < len(g) else np.zeros(0, int)
            if not len(left):
                break
            for at in range(0, len(left), LANES):
                i = left[at : at + LANES]
                near = _near(lambda b: np.packbits(bits[b, i] ^ bits[b, i + d]), ((len(i) + 7) // 8,), radius)  # noqa: B023
                hit = i[np.unpackbits(near, count=len(i)).astype(bool)]
                yield small[hit], small[hit + d]
    for begin, size in zip(begins[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        own = planes(fps[begin : begin + size])
        packed = np.packbits(own, axis=1)
        queries = max(1, LANES * 8 // size)
        for at in range(0, size, queries):
            asked = np.where(own[:, at : at + queries], np.uint8(255), np.uint8(0))
            near = _near(lambda b: packed[b][None, :] ^ asked[b][:, None], (asked.shape[1], packed.shape[1]), radius)  # noqa: B023
            q, j = np.nonzero(np.unpackbits(near, axis=1, count=size))
            later = j > q + at
            yield begin + q[later] + at, begin + j[later]


def _stars(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the smallest place it is joined to by the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _compared(radius: int):
    def links(key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(np.concatenate([[0], np.any(key[1:] != key[:-1], axis=1)]))
        pairs = list(near_pairs(fps.view(np.uint64), group, radius))
        i = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, int)
        j = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, int)
        root = _stars(i, j, len(fps))
        moved = np.flatnonzero(root != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays([pa.array(fps[moved]), pa.array(fps[root[moved]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fps = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
        for batch in batches:
            key = np.concatenate([key, np.stack([np.asarray(batch["key"]), np.asarray(batch["sub"])], axis=1)])
            fps = np.concatenate([fps, np.asarray(batch["fp"])])
            if not len(fps):
                continue
            whole_until = int(np.flatnonzero(np.any(key != key[-1], axis=1))[-1]) + 1 if np.any(key != key[-1]) else 0
            if whole_until:  # the last group may go on in the next batch
                yield links(key[:whole_until], fps[:whole_until])
                key, fps = key[whole_until:], fps[whole_until:]
        if len(fps):
            yield links(key, fps)

    return run


def _block_keys(value: Column, bits: int, radius: int, equal: int) -> Column:
    """Keys of which two values of ``bits`` bits within the radius share one:
    of ``radius + equal`` blocks, at least ``equal`` agree."""
    cuts = np.linspace(0, bits, radius + equal + 1).round().astype(int).tolist()
    chosen = list(combinations(range(radius + equal), equal))
    keys = []
    for blocks in chosen:
        mask = sum(((1 << cuts[b + 1]) - 1) ^ ((1 << cuts[b]) - 1) for b in blocks)
        keys.append(value.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
    return F.array(*[F.struct(F.lit(n).alias("n"), key.alias("v")) for n, key in enumerate(keys)])


def linked(fps: DataFrame, radius: int = RADIUS, many: int = MANY) -> DataFrame:
    """(fp, root) for the different fingerprints ``fps`` that have a link.

    Two fingerprints within the radius agree in two of ``radius + 2`` blocks of
    bits, so each goes under a key for every two blocks. A key held by over
    ``many`` fingerprints is made finer: the other bits are cut again and three
    of ``radius + 3`` blocks must agree, which leaves 14 bits free at radius 2,
    so no group can grow beyond 16,384 fingerprints. Within a group distances
    are counted on bit planes. A group's links go on as stars, no pairs."""
    keyed = fps.select("fp", F.explode(_block_keys(F.col("fp"), 64, radius, 2)).alias("k")).select(
        "fp", (F.xxhash64("k.n", "k.v")).alias("key"), F.col("k.n").alias("n"), F.col("k.v").alias("v")
    )
    hot = membership.bitmap(keyed.groupBy("key").count().where(F.col("count") > many).select("key"), "key")
    marked = membership.flagged(keyed, "key", hot, "hot")
    finer = F.when(F.col("hot"), F.transform(_rest_keys(radius), lambda s: F.xxhash64(F.col("key"), s))).otherwise(F.array(F.lit(0).cast("long")))
    groups = marked.select("fp", "key", F.explode(finer).alias("sub"))
    dealt = groups.repartition("key", "sub").sortWithinPartitions("key", "sub", "fp")
    return components(dealt.select("key", "sub", "fp").mapInArrow(_compared(radius), "a long, b long")).select(F.col("node").alias("fp"), "root")


def _rest_keys(radius: int) -> Column:
    """Finer keys from the bits that the two blocks of key ``n`` leave."""
    cuts = np.linspace(0, 64, radius + 3).round().astype(int).tolist()
    chosen = list(combinations(range(radius + 2), 2))
    by_key = []
    for blocks in chosen:
        rest = [p for b in range(radius + 2) if b not in blocks for p in range(cuts[b], cuts[b + 1])]
        ends = np.linspace(0, len(rest), radius + 4).round().astype(int).tolist()
        parts = [rest[ends[i] : ends[i + 1]] for i in range(radius + 3)]
        keys = []
        for n, three in enumerate(combinations(parts, 3)):
            mask = sum(1 << p for part in three for p in part)
            keys.append(F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
        by_key.append(F.array(*keys))
    return F.element_at(F.array(*by_key), F.col("n") + 1)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without the text, with ``fp`` and ``component_id``.

    Words (lower case A-Z) in shingles of three, repeats included, vote on 64
    bits by XXH64. Documents whose fingerprints differ in ``radius`` bits or
    fewer are linked; ``component_id`` is the smallest id that links reach.
    Equal fingerprints are first made one, so a large group of copies is one
    row, however many documents it has.

    Null and empty texts have fingerprint 0 and link like others. Null ids
    count for nothing as ``component_id`` unless there is no other. Repeated
    rows keep each their row. An empty table gives no rows. Other columns pass
    through, those named like a result are replaced. A very long text is read
    shingle by shingle into 64 counts.
    """
    rows = kept(fingerprints(docs.drop("component_id"), text_col, shingle), "fingerprints")
    distinct = kept(rows.groupBy("fp").agg(F.min(id_col).alias("_least")), "distinct")
    roots = linked(distinct.select("fp"), radius)
    rooted = distinct.join(roots, "fp", "left").withColumn("_root", F.coalesce("root", "fp"))
    named = rooted.join(rooted.groupBy("_root").agg(F.min("_least").alias("component_id")), "_root").select("fp", "component_id")
    return rows.join(named, "fp").select(*[c for c in rows.columns if c != "fp"], "fp", "component_id")
