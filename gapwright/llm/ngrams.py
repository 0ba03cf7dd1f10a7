"""Counts and hashed n-grams of many texts at once, with numpy on their bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18  # bytes looked at together; longer texts go slice by slice
BITS = 14  # buckets of words, and as many of characters
BUCKETS = 1 << BITS
NGRAM = 3  # bytes
WINDOW = 5  # words

_RANDOM = np.random.default_rng(5)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@dataclass
class Slices:
    """Of consecutive slices of text: counts per slice, and all word hashes."""

    word_chars: np.ndarray
    symbols: np.ndarray
    words: np.ndarray  # per slice
    hashes: np.ndarray  # per word
    grams: np.ndarray  # bucket of each character n-gram
    gram_of: np.ndarray  # slice of each


def read(slices: list[bytes], characters: bool = True) -> Slices:
    n = len(slices)
    data = np.frombuffer(b" ".join([*slices, b""]), np.uint8)
    lengths = np.fromiter(map(len, slices), np.int64, n) + 1
    of = np.repeat(np.arange(n), lengths)
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    starts = np.flatnonzero(begins)

    def total(mask: np.ndarray) -> np.ndarray:
        return np.bincount(of[mask], minlength=n)

    if len(starts):
        tail = data[starts[0] :]
        at = starts - starts[0]
        runs = np.diff(np.append(at, len(tail)))
        place = np.arange(len(tail)) - np.repeat(at, runs)
        # runs of white space only lengthen `place` where the value is 0
        value = np.where(space[starts[0] :], np.uint64(0), _BYTE[tail])
        inside = int((np.flatnonzero(value) - np.repeat(at, runs)[np.flatnonzero(value)]).max()) + 1
        value *= _powers(inside)[np.minimum(place, inside - 1)]
        hashes = _mixed(np.add.reduceat(value, at))
    else:
        hashes = np.zeros(0, np.uint64)
    if characters and len(data) >= NGRAM:
        gram = np.zeros(len(data) - NGRAM + 1, np.uint64)
        for k in range(NGRAM):
            gram = gram * _STEP + _BYTE[data[k : k + len(gram)]]
        whole = of[: len(gram)] == of[NGRAM - 1 :]
        grams, gram_of = (_mixed(gram[whole]) >> np.uint64(64 - BITS)).astype(np.int32), of[: len(gram)][whole]
    else:
        grams, gram_of = np.zeros(0, np.int32), np.zeros(0, np.int64)
    return Slices(
        total(~space & ((data & 0xC0) != 0x80)), total(_SYMBOL[data]), np.bincount(of[starts], minlength=n), hashes, grams, gram_of
    )


def sliced(text: bytes, size: int = CHUNK) -> list[bytes]:
    """A text in slices of about ``size`` bytes that cut no word."""
    out, at = [], 0
    while len(text) - at > size:
        end = at + size
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def repeated(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Per text (``words`` each): words in windows found twice or more in it."""
    n = len(words)
    of = np.repeat(np.arange(n), words)
    if len(hashes) < WINDOW:
        return np.zeros(n, np.int64)
    last = len(hashes) - WINDOW + 1
    key = _mixed((of[:last].astype(np.uint64) + np.uint64(1)) * _MIX)
    for k in range(WINDOW):
        key = _mixed(key * _STEP + hashes[k : k + last])
    whole = np.flatnonzero(of[:last] == of[WINDOW - 1 :])
    _, inverse, counts = np.unique(key[whole], return_inverse=True, return_counts=True)
    again = whole[counts[inverse] > 1]
    covered = np.zeros(len(hashes), bool)
    for k in range(WINDOW):
        covered[again + k] = True
    return np.bincount(of[covered], minlength=n)


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Of one of ``groups``: 64-bit hashes of each text's words."""
    if len(texts) == 1:
        return [np.concatenate([read([x], False).hashes for x in sliced(texts[0])])]
    s = read(texts, False)
    return np.split(s.hashes, np.cumsum(s.words)[:-1])


def pair_buckets(hashes: np.ndarray) -> np.ndarray:
    return (_mixed(hashes[:-1] * _STEP + hashes[1:]) >> np.uint64(64 - BITS)).astype(np.int32)


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip():
            seen.add(line)
    return n


@dataclass
class Stats:
    words: np.ndarray
    word_chars: np.ndarray
    symbols: np.ndarray
    dup_lines: np.ndarray
    repeat_words: np.ndarray
    score: np.ndarray  # mean weight of words and pairs, plus mean weight of characters


def _means(of: np.ndarray, buckets: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.bincount(of, weights=weights[buckets], minlength=n), np.bincount(of, minlength=n)


def parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in short pieces, so that few texts are held as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > CHUNK:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def stats(texts: list[bytes], word_weights: np.ndarray, char_weights: np.ndarray) -> Stats:
    """Of one of ``groups``."""
    n = len(texts)
    parts, chars, char_n = [], np.zeros(n), np.zeros(n, np.int64)
    word_chars, symbols, words = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    todo = [texts] if n > 1 else [[x] for x in sliced(texts[0])]
    for part in todo:
        s = read(part)
        a, b = _means(s.gram_of, s.grams, char_weights, len(part))
        for total, x in ((chars, a), (char_n, b), (word_chars, s.word_chars), (symbols, s.symbols), (words, s.words)):
            total += x if n > 1 else x.sum()
        parts.append(s.hashes)
    hashes = np.concatenate(parts)
    of = np.repeat(np.arange(n), words)
    scores, count = _means(of, (hashes >> np.uint64(64 - BITS)).astype(np.int32), word_weights[:BUCKETS], n)
    if len(hashes) > 1:
        together = of[1:] == of[:-1]
        more, pairs = _means(of[1:][together], pair_buckets(hashes)[together], word_weights[BUCKETS:], n)
        scores, count = scores + more, count + pairs
    score = scores / np.maximum(count, 1) + chars / np.maximum(char_n, 1)
    lines = np.fromiter(map(dup_lines, texts), np.int64, n)
    return Stats(words, word_chars, symbols, lines, repeated(hashes, words), score)


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (words, pairs, characters) and the weight of each in the score."""
    parts = [read([x]) for x in sliced(text)]
    hashes = np.concatenate([p.hashes for p in parts])
    words = np.bincount((hashes >> np.uint64(64 - BITS)).astype(np.int32), minlength=BUCKETS)
    pairs = np.bincount(pair_buckets(hashes), minlength=BUCKETS) if len(hashes) > 1 else np.zeros(BUCKETS, np.int64)
    chars = sum(np.bincount(p.grams, minlength=BUCKETS) for p in parts)
    x = np.concatenate([words / max(1, words.sum() + pairs.sum()), pairs / max(1, words.sum() + pairs.sum()), chars / max(1, chars.sum())])
    at = np.flatnonzero(x)
    return at.astype(np.int32), x[at].astype(np.float32)
