"""Encoding a corpus with a public byte-level BPE vocabulary.

Every pretoken is merged with a segment tree over its adjacent pair ranks: a leaf holds ``rank << 32 | position``
of the pair that starts there, an inner node the minimum of its children, so the root is the leftmost pair of the lowest
rank. A merge changes three leaves, each in logarithmic time, until the root holds no mergeable pair. A pretoken of n bytes
costs O(n log n), which also holds for pretokens of millions of bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pretokenisation rule that belongs to the vocabulary (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pretokens of at most CACHE_BYTES bytes are remembered; the memory is emptied at CACHE_ENTRIES.
CACHE_ENTRIES, CACHE_BYTES = 300_000, 64
_NONE = 1 << 62


def parse_ranks(text: str) -> dict[bytes, int]:
    """The vocabulary file's lines ``base64 rank`` as a dictionary."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in text.splitlines() if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pretoken. An empty one has none; bytes without a rank raise KeyError."""
    n = len(piece)
    tok = [piece[i : i + 1] for i in range(n)]
    if n < 2:
        return [ranks[t] for t in tok]
    size = 1
    while size < n - 1:
        size *= 2
    tree = [_NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        r = get(tok[i] + tok[i + 1])
        if r is not None:
            tree[size + i] = r << 32 | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        while k > 1:
            k >>= 1
            a, b = tree[2 * k], tree[2 * k + 1]
            v = a if a < b else b
            if tree[k] == v:
                return
            tree[k] = v

    def rank_at(i: int) -> int:
        j = nxt[i]
        if j >= n:
            return _NONE
        r = get(tok[i] + tok[j])
        return _NONE if r is None else r << 32 | i

    while (root := tree[1]) != _NONE:
        i = root & 0xFFFFFFFF
        j = nxt[i]
        tok[i] += tok[j]
        after = nxt[j]
        nxt[i] = after
        if after < n:
            prv[after] = i
        if j < n - 1:
            put(j, _NONE)
        put(i, rank_at(i))
        if (p := prv[i]) >= 0:
            put(p, rank_at(p))
    out, i = [], 0
    while i < n:
        out.append(ranks[tok[i]])
        i = nxt[i]
    return out


class Encoder:
    """Encodes texts; special tokens' strings are ordinary text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.ranks, self.find, self.seen = ranks, regex.compile(pattern).findall, {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        seen, add = self.seen, out.extend
        for piece in self.find(text):
            ids = seen.get(piece)
            if ids is None:
                raw = piece.encode()
                ids = merge(raw, self.ranks)
                if len(raw) <= CACHE_BYTES:
                    if len(seen) >= CACHE_ENTRIES:
                        seen.clear()
                    seen[piece] = ids
            add(ids)
        return out


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``(id_col, ids)`` with the token ids of every row's whole text, without special tokens.

    Null and empty texts give an empty list; a null id stays null; repeated rows come out as often as they came in; an
    empty table gives no rows; other columns are ignored. The vocabulary file (under 1 MB) is read on the driver and broadcast.
    """
    import os

    if os.path.getsize(vocabulary) > 64 << 20:
        raise ValueError("a vocabulary of over 64 MB is not broadcast")
    with open(vocabulary, encoding="ascii") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(parse_ranks(shared.value), pattern)
        for b in batches:
            lists = [enc.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.int32()))], names=["id", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)
