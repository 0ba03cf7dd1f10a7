"""Packing token sequences by patterns of few lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwright.llm.ranks import ranked
from gapwright.llm.scratch import kept
from gapwright.llm.text import whole
from gapwright.llm.tokens import encoder

CAPACITY = 1024
END = 2
STEPS = 200  # of the least-squares fit
WEIGHT = 2  # power of the length in the fit

Pattern = tuple[tuple[int, ...], int]  # lengths, largest first, and how often


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of up to three lengths (0 for none) that fill the capacity exactly."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    rows = [np.array([[capacity, 0, 0]])] if there[capacity] else []
    first = lengths[lengths * 2 <= capacity]
    two = first[there[capacity - first]]
    rows.append(np.stack([capacity - two, two, np.zeros_like(two)], axis=1))
    for a in lengths[lengths * 3 <= capacity]:
        b = lengths[(lengths >= a) & (lengths * 2 <= capacity - a)]
        b = b[there[capacity - a - b]]
        rows.append(np.stack([capacity - a - b, b, np.full_like(b, a)], axis=1))
    return np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)


def fit(counts: np.ndarray, found: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeats x >= 0 of the patterns with least squares ``|W (A x - counts)|``,
    by multiplicative updates; row p of ``found`` lists what column p of A
    holds. W weighs long lengths most: they find the fewest partners, and what
    is short fits anywhere. ``counts[0]`` stands for no length."""
    held = found > 0
    size = len(counts)
    weight = (np.arange(size) / size) ** WEIGHT

    def up(v: np.ndarray) -> np.ndarray:
        return ((v * weight)[found] * held).sum(axis=1)

    def down(x: np.ndarray) -> np.ndarray:
        return np.bincount(found.ravel(), weights=np.repeat(x, found.shape[1]), minlength=size) * (np.arange(size) > 0)

    goal = up(counts.astype(float))
    x = np.where(held, counts[found] / np.maximum(np.bincount(found.ravel(), minlength=size), 1)[found], np.inf).min(axis=1)
    for _ in range(steps):
        x *= goal / np.maximum(up(down(x)), 1e-12)
    return x


def residual(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit for what is left, by length: the largest length opens a
    sequence, which takes one or two lengths that fill it if there are such,
    else the largest that fits, and so on; the same sequence is repeated while
    its lengths last. Steps depend on the lengths there are, not on counts."""
    left, out = counts.copy(), []
    while left[1:].any():
        top = int(np.flatnonzero(left)[-1])
        taken = [top]
        left[top] -= 1
        room = capacity - top
        while room:
            if left[room]:
                taken.append(room)
                left[room] -= 1
                break
            a = np.arange(1, room // 2 + 1)
            fits = np.flatnonzero((left[a] > 0) & (left[room - a] > 0) & ((2 * a != room) | (left[a] > 1)))
            if len(fits):
                pair = [room - int(a[fits[0]]), int(a[fits[0]])]
                for n in pair:
                    left[n] -= 1
                taken += pair
                break
            below = np.flatnonzero(left[: room + 1])
            if not len(below):
                break
            taken.append(int(below[-1]))
            left[below[-1]] -= 1
            room -= int(below[-1])
        lengths, each = np.unique(taken, return_counts=True)
        more = int((left[lengths] // each).min())
        left[lengths] -= more * each
        out.append((tuple(sorted(taken, reverse=True)), 1 + more))
    return out


def plan(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Patterns and how often each is used, so that they hold exactly
    ``counts[n]`` pieces of each length n: a fit of the patterns of one length,
    of two and of three, each rounded and cut down to what there is, then best
    fit of the rest."""
    left = counts.copy()
    left[0] = 0
    out: list[Pattern] = []
    for documents in (1, 2, 3):
        found = patterns(np.flatnonzero(left), capacity)
        found = found[(found > 0).sum(axis=1) == documents]
        if not len(found):
            continue
        # rounded as a running total, so that many small repeats are not all lost
        repeats = np.diff(np.floor(np.cumsum(fit(left, found)) + 0.5), prepend=0).astype(np.int64)
        used = np.flatnonzero(repeats > 0)
        for p in used[np.lexsort((-repeats[used], -found[used, 0]))]:
            lengths, each = np.unique(found[p][found[p] > 0], return_counts=True)
            n = int(min(repeats[p], (left[lengths] // each).min()))
            if n > 0:
                left[lengths] -= n * each
                out.append((tuple(int(x) for x in found[p] if x), n))
    return out + residual(left, capacity)


def _slots(used: list[Pattern]) -> tuple[np.ndarray, ...]:
    """The plan by length and rank: (key, sequence, offset), ascending key.
    Pieces of a length with ranks from ``key``'s on, up to the next key, go to
    sequences from ``sequence`` on, at ``offset``."""
    rows, rank, sequence = [], {}, 0
    for lengths, n in used:
        offset = 0
        for length in lengths:
            at = rank.get(length, 0)
            rows.append(((length << 44) + at, sequence, offset))
            rank[length] = at + n
            offset += length
        sequence += n
    rows.sort()
    return tuple(np.array([r[k] for r in rows], np.int64) for k in range(3))


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end: int, id_col: str, text_col: str) -> DataFrame:
    """(id, piece, start, length, ids_crc32): ids of each text and ``end``;
    longer ones are cut so that all pieces but the first are full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded, tail = encoder(tokenizer), end.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: list[tuple] = []
                for doc, ids in zip(part["_id"].to_pylist(), encoded(part["_text"].to_pylist()), strict=True):
                    data = memoryview(ids + tail)
                    n = len(data) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    out += [(doc, k, a, b - a, zlib.crc32(data[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                columns = list(zip(*out, strict=True)) if out else [[]] * 5
                kinds = [batch.schema.field("_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text"))
    schema = rows.select("_id").schema
    for name, kind in (("piece", "integer"), ("start", "long"), ("length", "long"), ("ids_crc32", "long")):
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece with ``sequence_id`` and ``offset``; sequences hold at
    most ``capacity`` tokens and start at offset 0 without gaps.

    The histogram of piece lengths, at most ``capacity`` numbers, goes to the
    driver. There all patterns of one, two and three lengths that fill a
    sequence are listed, their repeats fitted to the histogram by non-negative
    least squares and rounded, and what is left packed by best fit. Pieces get their
    place by length and rank within it, from a plan whose size is bounded by
    the number of patterns. Ranks come from range partitions, so a length that
    holds most pieces lies in many tasks.

    Null and empty texts are the end id alone. Rows repeated in full are
    packed as often as they occur. An empty table gives no rows. Other columns
    are not looked at. A very long text becomes as many full pieces as it fills.
    """
    made = kept(pieces(docs, tokenizer, capacity, end, id_col, text_col), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in made.groupBy("length").count().collect():  # at most `capacity` rows
        counts[row["length"]] = row["count"]
    slots = made.sparkSession.sparkContext.broadcast(_slots(plan(counts, capacity)))
    places = ranked(made, ["length"], [id_col, "piece", "ids_crc32"], "_rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sequences, offsets = slots.value
        for batch in batches:
            key = (np.asarray(batch["length"]) << 44) + np.asarray(batch["_rank"]) - 1
            at = np.searchsorted(keys, key, "right") - 1
            columns = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in columns), pa.array(sequences[at] + key - keys[at]), pa.array(offsets[at])], [*columns, "sequence_id", "offset"]
            )

    schema = made.schema.add("sequence_id", "long").add("offset", "long")
    return places.mapInArrow(run, schema)
