"""Byte-level BPE encoding by guesses that are checked, and decoding."""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwright.llm.text import whole
from gapwright.llm.tokens import BYTES, Encoder

NONE = np.int64(1) << 40  # rank of what is never merged
SHORT = 64  # symbols of a piece that is merged without a heap
ROWS = 512  # texts looked at together


class Merges:
    """A vocabulary and its merges, as tables.

    ``rank`` is the number of the merge that makes a token, -1 for single
    bytes; ``left`` and ``right`` are what it merges. Every prefix of a token
    is a key of ``prefixes``, with the token's id where it is one.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, pairs = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        size = max(vocab.values()) + 1
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}  # pair to rank and token
        for n, (a, b) in enumerate(pairs):
            token, a, b = vocab[a + b], vocab[a], vocab[b]
            if self.left[token] >= 0 or max(self.rank[a], self.rank[b]) >= n:
                raise ValueError("every token must come from one merge, of tokens made before")
            self.rank[token], self.left[token], self.right[token] = n, a, b
            self.merged[a, b] = n, token
        self.made = np.array([token for _, token in self.merged.values()], np.int64)  # by rank
        if any(b not in vocab for b in BYTES) or any(self.left[i] < 0 and len(t) > 1 for t, i in vocab.items()):
            raise ValueError("all bytes must be tokens, and all other tokens merges")
        self.size = size
        keys = np.array([a * size + b for a, b in self.merged], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[order], np.iinfo(np.int64).max), np.append(np.array([r for r, _ in self.merged.values()], np.int64)[order], NONE)
        self.prefixes: dict[str, int] = {}
        for token in vocab:
            for end in range(len(token) - 1, 0, -1):
                if self.prefixes.setdefault(token[:end], -1) != -1:
                    break
        self.prefixes.update(vocab)

    def guess(self, piece: str) -> list[int]:
        """The longest token at the start, and so on."""
        prefixes, out, at, n = self.prefixes, [], 0, len(piece)
        while at < n:
            end, best, stop = at + 1, -1, at
            while end <= n:
                token = prefixes.get(piece[at:end])
                if token is None:
                    break
                if token >= 0:
                    best, stop = token, end
                end += 1
            out.append(best)
            at = stop
        return out

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves tokens ``a`` and ``b`` apart where they meet.

        Both are taken apart at their border, what was merged last first (of
        two equal merges the right one, as merging goes from the left). What
        lies at the border at some time must not merge before the earlier of
        the two merges that took these tokens in.
        """
        fine = np.ones(len(a), bool)
        at, a, b, limit = np.arange(len(a)), a.copy(), b.copy(), np.full(len(a), NONE)
        while len(at):
            clash = self.rank_of(a, b) < limit
            fine[at[clash]] = False
            first, second = self.rank[a], self.rank[b]
            open_ = ~clash & ((first >= 0) | (second >= 0))
            at, a, b, first, second = at[open_], a[open_], b[open_], first[open_], second[open_]
            by_left = first > second
            limit = np.where(by_left, first, second + 1)
            a, b = np.where(by_left, self.right[a], a), np.where(by_left, b, self.left[b])
        return fine

    def merge(self, pieces: list[str]) -> list[list[int]]:
        """Merges in the order of rank, from the left: the definition. All
        short pieces take their next merge together."""
        out: list = [None] * len(pieces)
        ids = [list(map(self.prefixes.__getitem__, p)) for p in pieces]
        long = {k for k, own in enumerate(ids) if len(own) > SHORT}
        for k in long:
            out[k] = self._merge_long(ids[k])
        at = np.array([k for k in range(len(pieces)) if k not in long], np.int64)
        lengths = np.array([len(ids[k]) for k in at.tolist()], np.int64)
        flat = np.fromiter((i for k in at.tolist() for i in ids[k]), np.int64, int(lengths.sum()))
        while len(at):
            of = np.repeat(np.arange(len(at)), lengths)
            rank = np.full(len(flat), NONE)
            rank[:-1] = np.where(of[1:] == of[:-1], self.rank_of(flat[:-1], flat[1:]), NONE)
            least = np.minimum.reduceat(rank, np.cumsum(lengths) - lengths)
            if (least == NONE).any():  # these are done
                done = np.flatnonzero(least == NONE)
                ends = np.cumsum(lengths)
                values = flat.tolist()
                for k, a, b in zip(at[done].tolist(), (ends - lengths)[done].tolist(), ends[done].tolist(), strict=True):
                    out[k] = values[a:b]
                on = least != NONE
                stay = on[of]
                flat, rank, of, least = flat[stay], rank[stay], (np.cumsum(on) - 1)[of[stay]], least[on]
                at, lengths = at[on], lengths[on]
                if not len(at):
                    break
            now = np.flatnonzero(rank == least[of])
            follows = np.diff(now, prepend=-2) == 1  # the same merge one symbol on: only every second can be
            if follows.any():
                begun = np.maximum.accumulate(np.where(follows, 0, np.arange(len(now))))
                now = now[(np.arange(len(now)) - begun) % 2 == 0]
            flat[now] = self.made[rank[now]]
            stay = np.ones(len(flat), bool)
            stay[now + 1] = False
            lengths = lengths - np.bincount(of[now], minlength=len(at))
            flat = flat[stay]
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        merged, n = self.merged, len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(merged[p][0], k, *p) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in merged]
        heapq.heapify(queue)
        while queue:
            _, k, a, b = heapq.heappop(queue)
            right = after[k]
            if ids[k] != a or right < 0 or ids[right] != b:
                continue
            ids[k], ids[right], after[k] = merged[a, b][1], -1, after[right]
            if after[k] >= 0:
                before[after[k]] = k
            for left, own in ((before[k], k), (k, after[k])):
                pair = (ids[left], ids[own]) if left >= 0 and own >= 0 else None
                if pair in merged:
                    heapq.heappush(queue, (merged[pair][0], left, *pair))
        return [i for i in ids if i >= 0]

    def encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids of all pieces in a row, where each begins (and the last ends),
        and how many failed the check and were merged exactly."""
        guesses = [self.guess(p) for p in pieces]
        lengths = np.fromiter(map(len, guesses), np.int64, len(guesses))
        ends = np.cumsum(lengths)
        flat = np.fromiter((i for g in guesses for i in g), np.int64, int(ends[-1]) if len(ends) else 0)
        of = np.repeat(np.arange(len(pieces)), lengths)
        inner = np.flatnonzero(of[1:] == of[:-1])
        pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        wrong = ~self.compatible(pairs // self.size, pairs % self.size)[back]
        failed = np.unique(of[inner[wrong]]).tolist()
        for k, own in zip(failed, self.merge([pieces[k] for k in failed]), strict=True):
            guesses[k] = own
        if failed:
            lengths = np.fromiter(map(len, guesses), np.int64, len(guesses))
            flat = np.fromiter((i for g in guesses for i in g), np.int64, int(lengths.sum()))
        return flat, np.concatenate([[0], np.cumsum(lengths)]), len(failed)


class Speculative(Encoder):
    """Cuts texts as ``Encoder`` does, but finds the ids of pieces itself:
    greedy longest matches are proposed, every neighbouring pair of them is
    checked, all different pairs of a batch at once, and only pieces with a
    pair that BPE would not leave are merged step by step. Tokens whose
    neighbours all pass the check are what BPE gives."""

    def __init__(self, path: str):
        super().__init__(path)
        self.merges, self.proposed, self.failed = Merges(path), 0, 0

    def encoded(self, pieces: list[str]) -> list[bytes]:
        flat, starts, failed = self.merges.encoded(pieces)
        self.proposed, self.failed = self.proposed + len(pieces), self.failed + failed
        data = flat.astype("<u4").tobytes()
        ends = (4 * starts).tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]


class Decoder:
    """Texts of ids. A token stands for the bytes its characters are written
    for, an added token with other characters for its own UTF-8. What is not
    UTF-8 becomes U+FFFD; ids beyond the vocabulary stand for nothing."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        tokens = {i: t for t, i in held["model"]["vocab"].items()} | {t["id"]: t["content"] for t in held["added_tokens"]}
        self.size = max(tokens) + 1
        self.tokens = pa.array([self._bytes(tokens.get(i, "")) for i in range(self.size)] + [b""], pa.large_binary())

    @staticmethod
    def _bytes(token: str) -> bytes:
        return bytes(BYTES[c] for c in token) if all(c in BYTES for c in token) else token.encode()

    def __call__(self, texts: list[bytes]) -> list[str]:
        ids = np.minimum(np.frombuffer(b"".join(texts), "<u4"), self.size)
        ends = np.cumsum([0] + [len(t) // 4 for t in texts])
        found = self.tokens.take(pa.array(ids))
        if not len(ids):
            return [""] * len(texts)
        cuts = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1)[ends].tolist()
        data = memoryview(found.buffers()[2])
        return [str(data[a:b], "utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Speculative:
    """One for each Python worker, so that its pieces serve later tasks."""
    return Speculative(path)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def _over(source: str, made: str, kind: pa.DataType, passed: list[str], load: Callable[[], Callable[[list], list]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = load()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in passed), pa.array(change(part[source].to_pylist()), kind)], [*passed, made])

    return run


def _schema(df: DataFrame, columns: list[str], name: str, kind: str):
    return df.select(*columns).schema.add(name, kind)


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the text replaced by its ids, as little-endian unsigned
    32-bit integers in ``ids_col``: those that the tokenizers library gives
    for the whole text without special tokens, truncation and padding.

    Null and empty texts have no ids. Names of added tokens in a text are
    those tokens. Repeated rows keep each their row, an empty table gives
    none; other columns pass through, one named ``ids_col`` is replaced. A
    very long text is one value; a piece without a cut is merged with a heap.
    """
    passed = [c for c in docs.columns if c not in (text_col, ids_col)]
    rows = docs.select(*passed, whole(text_col).alias("_text"))
    return rows.mapInArrow(_over("_text", ids_col, pa.binary(), passed, lambda: encoder(tokenizer)), _schema(rows, passed, ids_col, "binary"))


def decode(rows: DataFrame, tokenizer: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``rows``, ids included, with ``text_col``: the text the ids stand for,
    added tokens by their names. Null ids give the empty text; otherwise as
    ``encode``."""
    passed = [c for c in rows.columns if c != text_col]
    told = rows.select(*passed, F.coalesce(F.col(ids_col), F.lit(b"")).alias("_ids"))
    return told.mapInArrow(_over("_ids", text_col, pa.string(), passed, lambda: decoder(tokenizer)), _schema(told, passed, text_col, "string"))
