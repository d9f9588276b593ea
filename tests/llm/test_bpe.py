import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe


@pytest.fixture(scope="module")
def ranks():
    with open(bpe.VOCABULARY) as f:
        return bpe.parse_ranks(f.read())


@pytest.fixture(scope="module")
def reference(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", "a", "Hello world's end", "x" * 5000, " " * 3000 + "y", "日本語テキスト 한국어 \U0001f600", "tab\tnew\r\nline  \n\n", "<|endoftext|>", "\u0000\u0001", "ab" * 4000]


def test_matches_a_public_encoder(ranks, reference):
    enc = bpe.Encoder(ranks)
    for t in TEXTS:
        assert enc.encode(t) == reference.encode_ordinary(t)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_random_texts(t):
    with open(bpe.VOCABULARY) as f:
        ranks = bpe.parse_ranks(f.read()) if not hasattr(test_random_texts, "r") else test_random_texts.r
    test_random_texts.r = ranks
    tiktoken = pytest.importorskip("tiktoken")
    if not hasattr(test_random_texts, "e"):
        test_random_texts.e = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert bpe.Encoder(ranks).encode(t) == test_random_texts.e.encode_ordinary(t)


def test_leftmost_of_equal_ranks():
    ranks = {bytes([c]): c for c in range(256)} | {b"aa": 256}
    assert bpe.merge(b"aaa", ranks) == [256, 97]
    assert bpe.merge(b"", ranks) == []


def test_table(spark, ranks):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "hello hello", "x"), (3, "hello hello", "x")], "doc_id long, text string, ids string")
    rows = sorted((r["doc_id"], tuple(r["ids"])) for r in bpe.encode(df).collect())
    want = tuple(bpe.Encoder(ranks).encode("hello hello"))
    assert rows == [(1, ()), (2, ()), (3, want), (3, want)]
    assert bpe.encode(df.limit(0)).count() == 0
    raw = b"".join({v: k for k, v in ranks.items()}[i] for i in want)
    assert raw == b"hello hello" and base64
