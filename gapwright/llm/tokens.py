"""Token ids of whole texts, by the tokenizers library."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOGETHER = 1_500_000  # characters encoded together
FREQUENT = 150_000  # words looked up by Arrow, those met first
CACHED = 200_000  # pieces kept by a Python worker


# a space before white space or at the end
_UNCUT = re.compile(r" (?:[\s\x1c-\x1f\x85]|\Z)")


# letters below U+0250: the same in all versions of Unicode
_LETTERS = r"[a-zA-Z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+"
# a word, or two with a line end between: letters are one piece, and so are ASCII marks behind them
_PLAIN = rf"^(?P<a>{_LETTERS})(?P<b>[[:punct:]]*)(?:(?P<line>\n)(?P<c>{_LETTERS})(?P<d>[[:punct:]]*))?$"
# byte-level tokenizers write visible bytes as they are, others from U+0100 on
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHER = [b for b in range(256) if b not in _SEEN]
_TABLE = {b: chr(b) for b in _SEEN} | {b: chr(256 + n) for n, b in enumerate(_OTHER)}
BYTES = {c: b for b, c in _TABLE.items()}  # character to the byte it is written for


def _mapped(text: str) -> str:
    return text.encode().decode("latin-1").translate(_TABLE)


def _mapped_word(letters: str, space: str) -> str:
    return space + letters if letters.isascii() else space + _mapped(letters)


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit integers.

    A byte-level tokenizer cuts a text into pieces that it encodes each by
    itself, and a space before a visible character always begins a new piece.
    So texts are cut there. Words among those met first are looked up and put
    together by Arrow, a whole batch at once. Of the others, plain ones are cut
    by Arrow as well, into letters and marks, the rest by the library; pieces
    not held are encoded by the library, each different one once. A text with a
    space before white space or at its end is cut nowhere but by the library.
    So goes a text whole that holds the name of an added token, which the
    library looks for before it cuts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.library, self.added = tokenizer, [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.model, self.cut = tokenizer.model, tokenizer.pre_tokenizer.pre_tokenize_str
        if tokenizer.normalizer is not None or type(tokenizer.pre_tokenizer).__name__ != "ByteLevel":
            raise ValueError("a byte-level tokenizer without normalizer is needed")
        if tokenizer.pre_tokenizer.add_prefix_space:
            raise ValueError("a tokenizer that adds no space is needed")
        self.held: dict[str, bytes] = {"": b""}  # ids by piece
        self.bytes_of = [int(i).to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]
        # words are those after a space, held without it
        self.frequent, self.frequent_ids = pa.array([], pa.string()), pa.array([], pa.binary())

    def encoded(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces, their bytes written as the tokenizer does."""
        tokenize, bytes_of = self.model.tokenize, self.bytes_of
        return [b"".join([bytes_of[t.id] for t in tokenize(p)]) for p in pieces]

    def _ids(self, pieces: list[str]) -> list[bytes]:
        held = self.held
        missing = [p for p in dict.fromkeys(pieces) if p not in held]
        if missing:
            held.update(zip(missing, self.encoded(missing), strict=True))
        out = [held[p] for p in pieces]
        if len(held) > CACHED:
            self.held = {"": b""}
        return out

    def _cut(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that the library cuts."""
        pieces = [[mapped for mapped, _ in self.cut(text)] for text in texts]
        ids = iter(self._ids(list(chain.from_iterable(pieces))))
        return [b"".join(islice(ids, len(own))) for own in pieces]

    def _words(self, words: pa.Array) -> pa.Array:
        """Ids of different words after a space."""
        parts = pc.extract_regex(words, _PLAIN)
        plain = parts.is_valid()
        parts, at = parts.filter(plain), np.asarray(plain)
        made, space = [], _mapped(" ")
        for name in "a", "b", "line", "c", "d":
            coded = parts.field(name).dictionary_encode()
            pieces = coded.dictionary.to_pylist()
            if name == "line":
                pieces = [_mapped(p) for p in pieces]
            elif name in "ac":
                pieces = [_mapped_word(p, space if name == "a" else "") for p in pieces]
            made.append(pa.array(self._ids(pieces), pa.binary()).take(coded.indices))
        others = self._cut([" " + w for w in words.filter(pc.invert(plain)).to_pylist()])
        ids = pa.concat_arrays([pc.binary_join_element_wise(*made, pa.scalar(b"", pa.binary())), pa.array(others, pa.binary())])
        place = np.empty(len(words), np.int64)
        place[at], place[~at] = np.arange(len(parts)), np.arange(len(parts), len(words))
        return ids.take(pa.array(place))

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        out, group, size = [], [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= TOGETHER:
                out += self._together(group)
                group, size = [], 0
        return out + self._together(group)

    def _together(self, texts: list[str]) -> list[bytes]:
        firsts, rests, wholes = [], [], {}
        for k, text in enumerate(texts):
            first, rest = text, None
            if any(name in text for name in self.added):
                wholes[k], first = self._whole(text), ""
            elif not _UNCUT.search(text):
                first, space, rest = text.partition(" ")
                rest = rest if space else None
            firsts.append(first)
            rests.append(rest)
        heads = [wholes.get(k) or head for k, head in enumerate(self._cut(firsts))]
        lists = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        words = lists.flatten().cast(pa.string())
        at = pc.index_in(words, value_set=self.frequent)
        missing = words.filter(at.is_null()).dictionary_encode()
        ids = self._words(missing.dictionary)
        place = np.asarray(at.fill_null(0)).astype(np.int64)
        place[np.asarray(at.is_null())] = np.asarray(missing.indices) + len(self.frequent)
        all_ids = pa.concat_arrays([self.frequent_ids, ids]).cast(pa.large_binary())
        found = all_ids.take(pa.array(place))
        if len(self.frequent) < FREQUENT:
            self.frequent = pa.concat_arrays([self.frequent, missing.dictionary])
            self.frequent_ids = pa.concat_arrays([self.frequent_ids, ids])
        if not len(found):
            return heads
        data = memoryview(found.buffers()[2])
        ends = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1)
        bounds = ends[np.asarray(lists.offsets)].tolist()
        return [head + data[a:b] for head, a, b in zip(heads, bounds, bounds[1:], strict=False)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker, so that its caches serve later tasks."""
    return Encoder(path)
