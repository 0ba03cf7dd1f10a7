import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gapwright.llm import packing, scratch, token_files
from gapwright.llm.tokens import Encoder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["plain words first", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n  y ", "<|endoftext| > is none", "and plain words after", ""]


@pytest.fixture(scope="module")
def library():
    """As the tokenizer file has it, so names of added tokens are tokens."""
    return Tokenizer.from_file(TOKENIZER)


def test_names_of_added_tokens(library):
    assert library.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    got = [np.frombuffer(ids, "<u4").tolist() for ids in Encoder(TOKENIZER)(TEXTS)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_token_files_and_packing_of_added_tokens(spark, library):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)
    ids = [library.encode(t, add_special_tokens=False).ids for t in TEXTS]
    path = scratch.new_folder(spark, "test-added")
    token_files.write(docs, path, TOKENIZER)
    want, start = [], 0
    for k, own in enumerate(ids):
        want.append((k, start, len(own) + 1, zlib.crc32(np.array([*own, 0], "<u4").tobytes())))
        start += len(own) + 1
    assert sorted(map(tuple, token_files.documents(spark, path).collect())) == want
    found = packing.pack(docs, TOKENIZER).collect()
    assert Counter((r.doc_id, r.length, r.ids_crc32) for r in found) == Counter((k, len(own) + 1, zlib.crc32(np.array([*own, 2], "<u4").tobytes())) for k, own in enumerate(ids))
