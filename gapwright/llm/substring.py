"""Removal of long passages that occur in an earlier document."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwright.llm import membership, ngrams
from gapwright.llm.ranks import salted_join
from gapwright.llm.scratch import kept
from gapwright.llm.text import whole

WINDOW = 50  # words
GRAM = 12  # words of an anchor
BITS = 1 << 26  # of the bitmap of shared anchors: 8 MB
MOST_WORDS = 100_000  # in the automaton of one anchor

NO_ID = (1 << 63) - 1


class Automaton:
    """Suffix automaton of several sequences of words, built online."""

    def __init__(self):
        self.length, self.link = [0], [-1]
        self.moves: list[dict[bytes, int]] = [{}]

    def _state(self, length: int, link: int, moves: dict[bytes, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.moves.append(moves)
        return len(self.length) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """A copy of q for sequences that end one word after p."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.moves[q]))
        self.link[q] = copy
        while p >= 0 and self.moves[p].get(word) == q:
            self.moves[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[bytes]) -> None:
        last = 0
        for word in words:
            q = self.moves[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and word not in self.moves[p]:
                self.moves[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.moves[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
            last = new

    def matched(self, words: list[bytes], least: int) -> list[int]:
        """Windows of ``least`` words (by their first word) that occur in what
        was added: where the longest match that ends at a word is that long."""
        out, state, n = [], 0, 0
        for at, word in enumerate(words):
            while state and word not in self.moves[state]:
                state = self.link[state]
                n = self.length[state]
            to = self.moves[state].get(word)
            if to is None:
                continue
            state, n = to, n + 1
            if n >= least:
                out.append(at - least + 1)
        return out


def anchors(hashes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each window its anchor: the smallest hash of the word sequences of
    ``gram`` words in it. Equal windows have equal anchors."""
    n = len(hashes) - gram + 1
    grams = np.zeros(n, np.uint64)
    for k in range(gram):
        grams = ngrams._mixed(grams * ngrams._STEP + hashes[k : k + n])
    least, size, wanted = grams, 1, window - gram + 1
    while size < wanted:
        step = min(size, wanted - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    return least


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begins = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return begins, np.append(begins[1:], len(values))


def _anchor_rows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ngrams.parts(batches):
            ids, at = batch["_id"].to_numpy(), 0
            for group in ngrams.groups([t.encode() for t in batch["_text"].to_pylist()]):
                found = [np.unique(anchors(h, window, gram)) if len(h) >= window else np.zeros(0, np.uint64) for h in ngrams.word_hashes(group)]
                docs = np.repeat(ids[at : at + len(group)], [len(f) for f in found])
                at += len(group)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(docs)], ["anchor", "_id"])

    return run


def _segment_rows(window: int, gram: int, bits):
    """Maximal runs of windows with one anchor that is in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = bits.value
        for batch in ngrams.parts(batches):
            ids, marks, at = batch["_id"].to_pylist(), batch["_mark"].to_pylist(), 0
            for group in ngrams.groups([t.encode() for t in batch["_text"].to_pylist()]):
                rows: list[tuple] = []
                for text, hashes in zip(group, ngrams.word_hashes(group), strict=True):
                    doc, mark = ids[at], marks[at]
                    at += 1
                    if len(hashes) < window:
                        continue
                    found = anchors(hashes, window, gram)
                    begins, ends = _runs(found)
                    values = found[begins].view(np.int64)
                    place = np.mod(values, np.int64(8 * len(shared)))
                    hit = np.flatnonzero(shared[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                    if not len(hit):
                        continue
                    words = text.split()
                    for k in hit.tolist():
                        a, b = int(begins[k]), int(ends[k])
                        passage = b" ".join(words[a : b - 1 + window])
                        rows.append((int(values[k]), xxhash.xxh3_128_digest(passage), doc, mark, a, b - a, passage))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_SEGMENT)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SEGMENT.types, strict=True)], _SEGMENT.names)

    return run


_SEGMENT = pa.schema(
    [("anchor", pa.int64()), ("digest", pa.binary()), ("_id", pa.int64()), ("_mark", pa.int64()), ("pos", pa.int64()), ("n", pa.int64()), ("passage", pa.binary())]
)


def _by_automata(window: int):
    """Rows come sorted by anchor and first document. Each anchor's passages
    stream through the automaton of those of earlier documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(batch["anchor"].to_pylist(), batch["first"].to_pylist(), batch["digest"].to_pylist(), batch["passage"].to_pylist(), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 3
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True)], ["anchor", "digest", "gone"])

        for anchor, members in groupby(rows(batches), key=lambda r: r[0]):
            automaton, empty = Automaton(), True
            for _, of_doc in groupby(members, key=lambda r: r[1]):
                new = []
                for _, _, digest, passage in of_doc:
                    words = passage.split(b" ")
                    gone = [] if empty else automaton.matched(words, window)
                    if gone:
                        out.append((anchor, digest, gone))
                    if len(gone) < len(words) - window + 1:
                        new.append(words)
                for words in new:  # a document is not earlier than itself
                    automaton.add(words)
                    empty = False
            if len(out) >= 1000:
                yield made()
        yield made()

    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ngrams.parts(batches):
            for row in batch.to_pylist():
                words = row["passage"].split(b" ")
                ends = np.cumsum([len(w) + 1 for w in words]) - 1
                starts = np.concatenate([[0], ends[:-1] + 1])
                spans = zip(starts[: len(words) - window + 1].tolist(), ends[window - 1 :].tolist(), strict=True)
                hashes = [xxhash.xxh3_128_digest(row["passage"][a:b]) for a, b in spans]
                n = len(hashes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["anchor"]] * n, pa.int64()), pa.array([row["digest"]] * n, pa.binary()), pa.array([row["first"]] * n, pa.int64()),
                     pa.array(range(n), pa.int64()), pa.array(hashes, pa.binary())],
                    ["anchor", "digest", "first", "no", "window"],
                )

    return run


def _kept_words(window: int, carried: list[str], text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ngrams.parts(batches):
            texts, n_words, n_removed = [], [], []
            for text, spans in zip(batch["_text"].to_pylist(), batch["_spans"].to_pylist(), strict=True):
                words = text.encode().split()
                gone = np.zeros(len(words) + 1, np.int64)
                for span in spans or ():
                    gone[span["a"]] += 1
                    gone[span["b"]] -= 1
                stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                n_words.append(len(words))
                n_removed.append(len(words) - len(stay))
                texts.append(b" ".join([words[k] for k in stay.tolist()]).decode() if spans else b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in carried), pa.array(texts, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
                [*carried, text_col, "n_words", "n_removed"],
            )

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with the text reduced to its kept words, joined by one space,
    and ``n_words`` and ``n_removed``. A word goes if it lies in a window of
    ``window`` words that also occurs in a document with a smaller id; windows
    are judged on the input.

    Streaming every document through automata of all others would grow with
    the square of the corpus. So the reference is cut into shards that need
    not be broadcast to all: each window belongs to its anchor, the smallest
    hash of the ``gram``-word sequences in it, and equal windows share it. A
    first pass finds the anchors held by several documents; they reach the
    second pass as a bitmap of fixed size, and only passages (runs of windows
    of one anchor) under such an anchor go on. Equal passages are made one
    before they are dealt. Every anchor's different passages, in the order of
    their first document, stream through the suffix automaton of the earlier
    ones, whose matching statistics show the windows seen before; passages of
    later documents than the first that holds them go whole. An anchor with
    over ``MOST_WORDS`` words of different passages (a phrase in very many
    contexts) is done window by window, grouped by a 128-bit hash, instead.

    Null and empty texts have no words. Null ids come after all others and
    remove nothing from each other; neither do rows repeated under one id. An
    empty table gives no rows. Other columns pass through; those named like a
    result are replaced.
    """
    carried = [c for c in docs.columns if c not in (text_col, "n_words", "n_removed")]
    source = docs.select(
        *carried, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), whole(text_col).alias("_text"), F.xxhash64(whole(text_col)).alias("_mark")
    )
    spark = docs.sparkSession
    held = source.select("_id", "_text").mapInArrow(_anchor_rows(window, gram), "anchor long, _id long")
    shared = held.groupBy("anchor").agg(F.min("_id").alias("a"), F.max("_id").alias("b")).where("a < b").select("anchor")
    bits = np.zeros(BITS // 8, np.uint8)
    for row in membership.bitmap(shared, "anchor", BITS).collect():  # at most 8 MB
        at = (row["_bucket"] - 1) * (membership.BUCKET_BITS // 8)
        part = np.frombuffer(row["_bits"], np.uint8)
        bits[at : at + len(part)] |= part
    segments = kept(
        source.select("_id", "_mark", "_text").mapInArrow(
            _segment_rows(window, gram, spark.sparkContext.broadcast(bits)),
            "anchor long, digest binary, _id long, _mark long, pos long, n long, passage binary",
        ),
        "segments",
    )
    different = kept(segments.groupBy("anchor", "digest").agg(F.min("_id").alias("first"), F.min("passage").alias("passage"), F.min("n").alias("n")), "different")
    words = F.sum(F.col("n") + (window - 1))
    several = different.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), words.alias("w")).where("k > 1")
    sized = different.join(several, "anchor").select("anchor", "digest", "first", "passage", (F.col("w") > MOST_WORDS).alias("hot"))
    dealt = sized.where("NOT hot").select("anchor", "first", "digest", "passage").repartition("anchor").sortWithinPartitions("anchor", "first", "digest")
    cool = dealt.mapInArrow(_by_automata(window), "anchor long, digest binary, gone array<long>")
    windows = sized.where("hot").select("anchor", "digest", "first", "passage").mapInArrow(
        _windows(window), "anchor long, digest binary, first long, no long, window binary"
    )
    earliest = windows.groupBy("window").agg(F.min("first").alias("_e"))
    hot = salted_join(windows, earliest, "window").where("_e < first").groupBy("anchor", "digest").agg(F.collect_set("no").alias("gone"))
    verdicts = different.select("anchor", "digest", "first").join(cool.unionByName(hot), ["anchor", "digest"], "left")

    at = segments.select("anchor", "digest", "_id", "_mark", "pos", "n").join(verdicts, ["anchor", "digest"])
    whole_one = F.array(F.struct(F.col("pos").alias("a"), (F.col("pos") + F.col("n") + (window - 1)).alias("b")))
    some = F.transform(F.coalesce("gone", F.array().cast("array<long>")), lambda k: F.struct((F.col("pos") + k).alias("a"), (F.col("pos") + k + window).alias("b")))
    spans = (
        at.select("_id", "_mark", F.when(F.col("_id") > F.col("first"), whole_one).otherwise(some).alias("_s"))
        .where(F.size("_s") > 0)
        .groupBy(F.col("_id").alias("_i"), F.col("_mark").alias("_m"))
        .agg(F.flatten(F.collect_list("_s")).alias("_spans"))
    )
    joined = source.join(spans, (F.col("_id") == F.col("_i")) & (F.col("_mark") == F.col("_m")), "left").select(*carried, "_text", "_spans")
    schema = docs.select(*carried).schema.add(text_col, "string").add("n_words", "long").add("n_removed", "long")
    return joined.mapInArrow(_kept_words(window, carried, text_col), schema)
