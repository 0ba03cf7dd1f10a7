import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gapwright.llm import bpe, queries

from . import brute

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = list("abcdeéßñ日本한ABC.,;!?'\"()123  \n\n\t\r\x0b\x1c\x85  🙂ĉ_-sdmtlvre") + ["'s", "'ll", "ing", "tion", " the", " of", " and", "<|endoftext|>", "----", "aaaa"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(PATH)


def texts(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.choice([0, 1, 3, 20, 90]))) for _ in range(n)]


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_random_texts(library):
    many = texts(1, 3000)
    got = [np.frombuffer(ids, "<u4").tolist() for ids in bpe.Speculative(PATH)(many)]
    assert got == [ids_of(library, t) for t in many]
    back = bpe.Decoder(PATH)([np.array(ids, "<u4").tobytes() for ids in got])
    assert back == [library.decode(ids, skip_special_tokens=False) for ids in got] == many


def test_pair_check_is_what_the_library_does(library, merges):
    r, names = np.random.default_rng(2), {i: t for t, i in library.get_vocab().items()}
    # pairs that merge, pairs of halves of longer tokens, and any pairs
    made = np.flatnonzero(merges.rank >= 0)
    a = np.concatenate([merges.left[made[:2000]], r.integers(0, merges.size, 3000), merges.right[made[-2000:]]])
    b = np.concatenate([merges.right[made[:2000]], r.integers(0, merges.size, 3000), merges.left[r.permutation(made)[:2000]]])
    want = [[t.id for t in library.model.tokenize(names[x] + names[y])] == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert merges.compatible(a, b).tolist() == want and 0 < sum(want) < len(want)


def test_only_failing_pieces_are_merged(library, merges, monkeypatch):
    pieces = ["Ġthe", "Ġword", "Ġtheord", "Ġstan", "Ġthering", "a" * 300, "Ġ" * 70 + "x", "!?" * 40]
    seen = []
    merge = merges.merge
    monkeypatch.setattr(merges, "merge", lambda some: seen.extend(some) or merge(some))
    flat, starts, failed = merges.encoded(pieces)
    want = [[t.id for t in library.model.tokenize(p)] for p in pieces]
    assert [flat[x:y].tolist() for x, y in zip(starts, starts[1:])] == want
    assert failed == len(seen) < len(pieces) and set(seen) == {p for p, w in zip(pieces, want) if merges.guess(p) != w}
    assert merges.encoded([])[0].tolist() == []


def test_merging_by_definition(library, merges):
    r = random.Random(4)
    pieces = ["".join(r.choice("aābĠst!Ãing") for _ in range(r.randint(1, 150))) for _ in range(500)]
    pieces = [p for p in pieces if all(c in bpe.BYTES for c in p)] + ["ab" * 5000]
    assert merges.merge(pieces) == [[t.id for t in library.model.tokenize(p)] for p in pieces]


def test_decoding_of_any_ids(library):
    r = np.random.default_rng(3)
    lists = [r.integers(0, 50257, r.integers(0, 30)).tolist() for _ in range(2000)] + [[50256], []]
    got = bpe.Decoder(PATH)([np.array(x, "<u4").tobytes() for x in lists])
    assert got == [library.decode(x, skip_special_tokens=False) for x in lists]


def test_messy_table(spark, messy, no_docs, library):
    named = messy.withColumn("ids", F.lit("own"))
    coded = bpe.encode(named, PATH)
    assert coded.columns == ["doc_id", "source", "kept", "n_words", "ids"]
    back = bpe.decode(coded, PATH)
    assert back.columns == [*coded.columns, "text"]
    want = Counter((r.doc_id, r.n_words, np.array(ids_of(library, r.text or ""), "<u4").tobytes(), r.text or "") for r in messy.collect())
    assert Counter((r.doc_id, r.n_words, bytes(r.ids), r.text) for r in back.collect()) == want
    assert bpe.encode(no_docs, PATH).count() == 0 and bpe.decode(bpe.encode(no_docs, PATH), PATH).count() == 0
    assert bpe.decode(spark.sql("SELECT CAST(NULL AS BINARY) AS ids"), PATH).first().text == ""


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    want = []
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = ids_of(library, r.text or "")
        sha = brute.hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((r.doc_id, len(ids), sha, brute.sha256(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, queries.QUERIES["op12_bpe"](spark, folder).collect())) == sorted(want)
