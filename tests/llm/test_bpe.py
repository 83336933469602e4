import hashlib

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import bpe

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [(1, "Hello  world, it's 2024!\n\n  x"), (2, None), (3, ""), (4, "été naïve 東京 😀"), (4, "été naïve 東京 😀"), (None, "a <|endoftext|> b"), (6, "word " * 4000), (7, "x" * 3000), (8, "\x00\x01 \t\r\n")]


def expected(text):
    ids = np.array(bpe.encoder(VOCABULARY, public_tokenizers.PATTERN).encode_ordinary(text or ""), "<u4").tobytes()
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("block", [10, 1 << 20])
def test_equals_tiktoken(spark, block):
    docs = spark.createDataFrame([(i, t, "x") for i, t in TEXTS], "doc_id long, text string, block string")
    got = sorted(bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN, digests=True, block=block).collect(), key=str)
    assert [tuple(x) for x in got] == sorted(((i, *expected(t)) for i, t in TEXTS), key=lambda x: f"Row(doc_id={x[0]}, n_tokens={x[1]}, ids_sha256='{x[2]}'")


def test_round_trip_and_empty_table(spark):
    docs = spark.createDataFrame([(i, t) for i, t in TEXTS], "doc_id long, text string")
    full = bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN)
    assert all(a.decoded == b for a, b in zip(sorted(full.collect(), key=lambda x: (x.decoded, str(x.ident))), sorted((t or "").encode() for _, t in TEXTS)))
    again = bpe.decode(full.select("ident", "tokens"), VOCABULARY).collect()
    assert sorted(x.decoded for x in again) == sorted((t or "").encode() for _, t in TEXTS)
    assert bpe.encode(docs.filter("doc_id = 99"), VOCABULARY, public_tokenizers.PATTERN).count() == 0
