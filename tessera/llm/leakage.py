"""Held-out passages inside a corpus, whole or in part, also slightly changed.

Windows of as many words as must be found run over items and documents. The CGK random walk (one random bit per step and word tells
whether to go on to the next word) embeds a window so that a small edit distance becomes a small Hamming distance; each
repetition draws another walk and a sample of embedded positions, whose hash is looked up among the items' hashes. Equal
windows meet in every repetition. Every candidate is then verified by its word edit distance from document windows of that
many words, fewer and more. Whole passages with edits all over are found by the runs of three words that they must still share.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialise

WINDOW = 10
#: Repetitions and sampled positions; measured recall at one edit is in the README.
REPETITIONS, SAMPLES, SEED = 8, 6, 20_260
#: Steps of the walk, in window lengths.
STRETCH = 2
#: Most item windows that are held (and broadcast) at once; those of more items are joined.
BLOCK_WINDOWS = 200_000
#: Share of a whole passage's words that may be edited; words in a run shared with it (an edit takes at most so many runs away).
PASSAGE_EDITS, RUN = 0.25, 3
#: Stands behind a document's last word; ids have 63 bits.
_END = np.uint64(0xFFFFFFFFFFFFFFFF)
_M = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Word to a 63-bit id by hash; bounded, since it is emptied when it grows too large."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        v = self[word] = xxhash.xxh64_intdigest(word) >> 1
        return v


def _tokenise(texts, find, ids: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of all texts in a row, and the number of words of each."""
    flat: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        if t:
            w = find(t.lower())
            counts[k] = len(w)
            flat.extend([ids[x] for x in w])
    return np.array(flat, np.uint64), counts


def _starts(counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every full window in the flat array, and the row it belongs to."""
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else np.zeros(0, np.int64)
    n = np.maximum(counts - window + 1, 0)
    row = np.repeat(np.arange(len(counts)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[row], row


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def embed_keys(flat: np.ndarray, starts: np.ndarray, window: int, rep: int, samples: int = SAMPLES, seed: int = SEED, ends: np.ndarray | None = None) -> np.ndarray:
    """One hash for each window: the sampled positions of its CGK walk in repetition ``rep``. ``ends`` cut windows short."""
    rng = np.random.default_rng(seed + rep)
    steps = STRETCH * window
    take = set(rng.choice(steps, size=min(samples, steps), replace=False).tolist())
    odd = rng.integers(1, 1 << 62, size=steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    pos = starts.copy()
    end = starts + window if ends is None else np.minimum(starts + window, ends)
    key = np.full(len(starts), np.uint64(rep + 1))
    ids = np.append(flat, np.uint64(0))
    for j in range(max(take) + 1):
        inside = pos < end
        w = np.where(inside, ids[np.minimum(pos, len(flat))], np.uint64(0))
        if j in take:
            key = _mix(key * _M + w)
        pos += ((w * odd[j]) >> np.uint64(63)).astype(np.int64) & inside
    return key


def edit_distance(a: np.ndarray, b: np.ndarray, loose: int = 0) -> np.ndarray:
    """Word edit distance of the rows of two integer matrices, all rows at once; the least with up to ``loose`` of the last words of ``b`` left out."""
    n, w = a.shape
    row = np.tile(np.arange(b.shape[1] + 1), (n, 1))
    for i in range(w):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        for j in range(b.shape[1]):
            new[:, j + 1] = np.minimum(np.minimum(new[:, j] + 1, row[:, j + 1] + 1), row[:, j] + (a[:, i] != b[:, j]))
        row = new
    return row[:, row.shape[1] - 1 - loose :].min(axis=1)


def passage_distance(passage: np.ndarray, doc: np.ndarray) -> int:
    """The least word edit distance of a passage from any stretch of a document."""
    at = np.arange(len(doc) + 1)
    row = np.zeros(len(doc) + 1, np.int64)
    for x in passage:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (doc != x))
        row = np.minimum.accumulate(new - at) + at
    return int(row.min())


def runs(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every RUN consecutive words of a row, and the row."""
    starts, row = _starts(counts, RUN)
    key = np.zeros(len(starts), np.uint64)
    for j in range(RUN):
        key = _mix(key * _M + flat[starts + j])
    return key, row


def word_masks(flat: np.ndarray, starts: np.ndarray, window: int, ends: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit set of each window's words: one edit takes at most one bit away, so masks rule out most pairs before any distance."""
    bit = np.left_shift(np.uint64(1), (flat * _M) >> np.uint64(58))
    mask = np.zeros(len(starts), np.uint64)
    for j in range(window):
        mask |= bit[starts + j] if ends is None else np.where(starts + j < ends, bit[np.minimum(starts + j, len(flat) - 1)], np.uint64(0))
    return mask


class Items:
    """The windows of a block of items and their keys in every repetition; whole passages and their runs of words."""

    def __init__(self, items: list[tuple[int, str, bool]], window: int, repetitions: int, samples: int):
        import re

        flat, counts = _tokenise([t for _, t, _ in items], re.compile(r"[^\W_]+").findall, Words())
        self.passages, self.passage_item = np.split(flat, np.cumsum(counts)[:-1]), [i for i, _, _ in items]
        self.edits = (counts * PASSAGE_EDITS).astype(np.int64)
        self.least = np.maximum(counts + 1 - RUN * (self.edits + 1), 1)  # runs that so many edits leave
        self.tiny = [i for i, p in enumerate(self.passages) if 0 < len(p) < RUN]
        key, row = runs(flat, counts)
        whole = np.array([w for _, _, w in items], bool)[row] if len(row) else np.zeros(0, bool)
        (self.run, self.run_row), self.run_n = np.zeros((2, 0), np.uint64), np.zeros(0, np.int64)
        if whole.any():
            pairs, self.run_n = np.unique(np.stack([key[whole], row[whole].astype(np.uint64)], 1), axis=0, return_counts=True)
            self.run, self.run_row = pairs[:, 0].copy(), pairs[:, 1].astype(np.int64)
        starts, row = _starts(counts, window)
        self.item = np.array([i for i, _, _ in items], np.int64)[row] if len(row) else np.zeros(0, np.int64)
        self.words = flat[starts[:, None] + np.arange(window)] if len(starts) else np.zeros((0, window), np.uint64)
        self.masks = word_masks(flat, starts, window)
        keys = [embed_keys(flat, starts, window, r, samples) for r in range(repetitions)]
        self.order = [np.argsort(k, kind="stable") for k in keys]
        self.keys = [k[o] for k, o in zip(keys, self.order, strict=True)]


def _blocks(items: DataFrame, window: int) -> Iterator[list[tuple[int, str, bool]]]:
    """Items and whether they are whole, at most BLOCK_WINDOWS windows at a time; they are streamed, never all collected. A longer passage comes in parts that overlap by a window."""
    import re

    block, n = [], 0
    for r in items.select("item_id", "passage").filter("item_id is not null and passage is not null").dropDuplicates().orderBy("item_id", "passage").toLocalIterator():
        words = re.findall(r"[^\W_]+", r["passage"].lower())
        step = max(BLOCK_WINDOWS, 1)
        if 0 < len(words) < window:
            block.append((r["item_id"], " ".join(words), True))
            n += 1
        for at in range(0, max(len(words) - window + 1, 0), step):
            part = words[at : at + step + window - 1]
            if block and n + len(part) - window + 1 > BLOCK_WINDOWS:
                yield block
                block, n = [], 0
            block.append((r["item_id"], " ".join(part), len(part) == len(words)))
            n += len(part) - window + 1
    if block:
        yield block


def _hits(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index into ``keys`` and place in ``sorted_keys`` of every equal pair."""
    lo = np.searchsorted(sorted_keys, keys, "left")
    lo_ok = np.flatnonzero(sorted_keys[np.minimum(lo, len(sorted_keys) - 1)] == keys)
    n = np.searchsorted(sorted_keys, keys[lo_ok], "right") - lo[lo_ok]
    return np.repeat(lo_ok, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[lo_ok], n)


def _whole(flat: np.ndarray, counts: np.ndarray, it: Items) -> Iterator[tuple[int, int, int]]:
    """Row, item and distance of every whole passage in a row with at most its number of edits; none is missed."""
    for x in it.tiny:  # a word or two are sought as they are
        p = it.passages[x]
        at = np.flatnonzero(flat[: len(flat) - len(p) + 1] == p[0]) if len(flat) >= len(p) else np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(counts)), counts)
        if len(p) == 2:
            at = at[(flat[at + 1] == p[1]) & (of[at + 1] == of[at])]
        yield from ((int(r), it.passage_item[x], 0) for r in np.unique(of[at]))
    key, row = runs(flat, counts)
    if not len(key) or not len(it.run):
        return
    at, place = _hits(it.run, key)
    pairs, back = np.unique(row[at] * len(it.passages) + it.run_row[place], return_inverse=True)
    shared = np.bincount(back, it.run_n[place], len(pairs))
    first = np.cumsum(counts) - counts
    for p in pairs[shared >= it.least[pairs % len(it.passages)]].tolist():
        r, x = divmod(p, len(it.passages))
        d = passage_distance(it.passages[x], flat[first[r] : first[r] + counts[r]])
        if d <= it.edits[x]:
            yield r, it.passage_item[x], d


#: Bits of the filter that says which keys some item has; a task holds it whole (16 MB).
FILTER_BITS = 27
_HITS = "doc_id long, item_id long, distance int, windows long, passage_distance int"


def _joined(texts: DataFrame, items: DataFrame, window: int, max_edits: int, repetitions: int, samples: int) -> DataFrame:
    """The windows of any number of items, in one pass over the corpus: ``doc_id, item_id, distance, windows``.

    Equal item windows are one class. A filter of fixed size tells a document task which of its keys some class has; only those are joined with the table of
    keys, verified, and spread to the classes' items. Nothing of it grows with the items but tables.
    """

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        find, ids = re.compile(r"[^\W_]+").findall, Words()
        for b in batches:
            flat, counts = _tokenise(b.column(1).to_pylist(), find, ids)
            starts, row = _starts(counts, window)
            raw = flat[starts[:, None] + np.arange(window)].tobytes() if len(starts) else b""
            item = b.column(0).to_numpy(zero_copy_only=False)[row] if len(row) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array([raw[i : i + 8 * window] for i in range(0, len(raw), 8 * window)], pa.binary())], names=["item_id", "words"])

    def class_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                flat = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64)
                for r in range(repetitions):
                    key = embed_keys(flat, np.arange(b.num_rows) * window, window, r, samples, ends=(np.arange(b.num_rows) + 1) * window)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(0)], names=["key", "words"])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        find, ids, bits = re.compile(r"[^\W_]+").findall, Words(), some.value
        for b in batches:
            doc = b.column(0).to_numpy(zero_copy_only=False)
            flat, counts = _tokenise(b.column(1).to_pylist(), find, ids)
            starts, row = _starts(counts, max(window - max_edits, 1))
            if not len(starts):
                continue
            ends, first = np.cumsum(counts)[row], (np.cumsum(counts) - counts)[row]
            for r in range(repetitions):
                key = embed_keys(flat, starts, window, r, samples, ends=ends)
                place = key & np.uint64((1 << FILTER_BITS) - 1)
                at = np.flatnonzero((bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1))
                where = starts[at][:, None] + np.arange(window + max_edits)
                raw = np.where(where < ends[at][:, None], flat[np.minimum(where, len(flat) - 1)], _END).tobytes()
                n = 8 * (window + max_edits)
                yield pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), pa.array(doc[row[at]], pa.int64()), pa.array(starts[at] - first[at]), pa.array([raw[i : i + n] for i in range(0, len(raw), n)], pa.binary())], names=["key", "doc_id", "start", "there"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                theirs = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64).reshape(b.num_rows, -1)
                d = edit_distance(np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint64).reshape(b.num_rows, window), theirs, 2 * max_edits)
                ok = pa.array(d <= max_edits)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok), b.column(3).filter(ok), pa.array(d[d <= max_edits], pa.int32())], names=["doc_id", "start", "words", "distance"])

    wanted = items.filter("item_id is not null and passage is not null").select(F.col("item_id").cast("long").alias("item_id"), "passage")
    members = materialise(wanted.mapInArrow(item_windows, "item_id long, words binary").distinct(), "members")
    keyed = materialise(members.select("words").distinct().mapInArrow(class_keys, "key long, words binary").distinct(), "keys")
    place = F.col("key").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    cells = keyed.select(F.shiftright(place, 6).alias("cell"), F.expr("shiftleft(1L, CAST(key & 63 AS INT))").alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits")).toPandas()  # at most 2**21 cells
    held = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    held[cells["cell"].to_numpy(np.int64)] = cells["bits"].to_numpy(np.int64).view(np.uint64)
    some = texts.sparkSession.sparkContext.broadcast(held)
    near = texts.mapInArrow(candidates, "key long, doc_id long, start long, there binary").join(keyed, "key").select("doc_id", "start", "there", "words").distinct()
    found = near.mapInArrow(verify, "doc_id long, start long, words binary, distance int").join(members, "words")
    return found.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.countDistinct("start").alias("windows"))


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_edits: int = 1, repetitions: int = REPETITIONS, samples: int = SAMPLES, passages: bool = True) -> DataFrame:
    """``doc_id, item_id, distance, windows, passage_distance``: documents that hold a window of an item with at most ``max_edits`` word edits, or all of it.

    ``distance`` is the smallest edit distance of any window pair found (a document window may be up to ``max_edits`` words shorter or longer),
    ``windows`` the number of document windows found; null and 0 where only the whole passage is found. ``passage_distance`` is the edit distance of
    the whole passage from some stretch of the document, null beyond ``PASSAGE_EDITS`` of its words; none is missed,
    but for passages of more than ``BLOCK_WINDOWS`` windows, which are sought by windows only; shorter passages than a window are sought whole. Without ``passages`` it isn't sought and is null.
    Equal windows (distance 0) are always found; changed ones with the recall of the repetitions. Words are runs of
    letters and digits in lower case. Null and empty texts and passages hold nothing; an item given twice counts once;
    rows of one ``doc_id`` are taken together. Documents are never shuffled or collected. Items of up to ``BLOCK_WINDOWS`` windows are
    broadcast and only hits are aggregated; the windows of more items are joined by their keys in one pass (:func:`_joined`), with the same rows, and only whole passages
    are sought in blocks.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    blocks = _blocks(items, window)
    start = [b for b in (next(blocks, None), next(blocks, None)) if b]
    hits, many = None, len(start) > 1
    if many:
        hits = _joined(texts, items, window, max_edits, repetitions, samples).withColumn("passage_distance", F.lit(None).cast("int"))
        repetitions = 0  # windows are done
    for block in itertools.chain(start, blocks) if passages or not many else ():
        shared = spark.sparkContext.broadcast(Items(block, window, repetitions, samples))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import re

            find, ids, it = re.compile(r"[^\W_]+").findall, Words(), shared.value
            schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("windows", pa.int64()), ("passage_distance", pa.int32())])
            for b in batches:
                doc = b.column(0).to_numpy(zero_copy_only=False)
                flat, counts = _tokenise(b.column(1).to_pylist(), find, ids)
                starts, row = _starts(counts, max(window - max_edits, 1))
                ends = np.cumsum(counts)[row]
                found: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
                seek = len(starts) and len(it.item)
                masks = word_masks(flat, starts, window, ends) if seek else None
                for r in range(repetitions if seek else 0):
                    at, rank = _hits(it.keys[r], embed_keys(flat, starts, window, r, samples, ends=ends))
                    item = it.order[r][rank]
                    a, b2 = masks[at], it.masks[item]
                    near = (np.bitwise_count(a & ~b2) <= max_edits) & (np.bitwise_count(b2 & ~a) <= max_edits)
                    found.append(np.stack([at[near], item[near]], 1))
                pairs = np.unique(np.concatenate(found), axis=0)
                best: dict[tuple[int, int], list] = {}
                for part in np.array_split(pairs, max(1, len(pairs) // 50_000)):
                    if not len(part):
                        continue
                    place = starts[part[:, 0]][:, None] + np.arange(window + max_edits)
                    there = np.where(place < ends[part[:, 0]][:, None], flat[np.minimum(place, len(flat) - 1)], _END)
                    d = edit_distance(it.words[part[:, 1]], there, 2 * max_edits)
                    for (w, x), dist in zip(part[d <= max_edits], d[d <= max_edits], strict=True):
                        k = (int(row[w]), int(it.item[x]))
                        e = best.setdefault(k, [window + 1, set(), None])
                        e[0] = min(e[0], int(dist))
                        e[1].add(int(w))
                for r, item, dist in _whole(flat, counts, it) if passages else ():
                    e = best.setdefault((r, item), [None, set(), None])
                    e[2] = dist if e[2] is None else min(e[2], dist)
                if best:
                    cols = [[doc[k[0]] for k in best], [k[1] for k in best], [e[0] for e in best.values()], [len(e[1]) for e in best.values()], [e[2] for e in best.values()]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        part = texts.mapInArrow(run, _HITS)
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        return spark.createDataFrame(pd.DataFrame(columns=["doc_id", "item_id", "distance", "windows", "passage_distance"]), _HITS)
    return hits.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.sum("windows").alias("windows"), F.min("passage_distance").alias("passage_distance"))
