"""Near-duplicate texts by a multi-index Hamming join over b-bit minwise signatures.

A signature has SYMBOLS symbols of b bits (minwise hashes of the word shingles); the distance of two signatures is the number of differing
symbols. It is split into CHUNKS chunks; by the pigeonhole principle two signatures at a distance below ``CHUNKS * (ERRORS + 1)`` agree in some
chunk up to ERRORS symbols. All ways to err are enumerated (each chunk is keyed once for every choice of symbols left out), so every pair
below that distance shares a key. Candidates are verified by exact Jaccard similarity of the whole shingle sets.

Equal texts form one class that takes part once. A key that more than MAX_RUN classes share isn't paired; its classes go through an exact
prefix-filter join instead (rarest shingles first), so nothing is lost.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import BROADCAST_ROWS, materialise, small

SHINGLE, THRESHOLD = 3, 0.7
SYMBOLS, CHUNKS, ERRORS, SYMBOL_BITS, SEED = 40, 8, 1, 16, 4321
MAX_RUN = 64
#: Stands before the classes of a key that is known to be shared by too many.
_MARK = -(1 << 63)
_WORD = re.compile(r"[a-z0-9_]+")
_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)


class _Ids(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        v = self[word] = xxhash.xxh64_intdigest(word)
        return v


def shingles(texts: list[str], ids: dict, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words of all texts in a row (repeats kept), and the number of runs of each text."""
    flat: list[int] = []
    n = np.zeros(len(texts), np.int64)
    get = ids.__getitem__
    for k, t in enumerate(texts):
        w = _WORD.findall(t.lower())
        n[k] = len(w)
        flat.extend(map(get, w))
    words = np.array(flat, np.uint64)
    runs = np.maximum(n - width + 1, 0)
    first = np.cumsum(n) - n
    at = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(first, runs)
    h = np.zeros(len(at), np.uint64)
    for j in range(width):
        h = (h ^ words[at + j]) * _P1
        h ^= h >> np.uint64(29)
    h *= _P3
    return h ^ (h >> np.uint64(32)), runs


def signatures(hashes: np.ndarray, runs: np.ndarray, symbols: int = SYMBOLS, bits: int = SYMBOL_BITS, seed: int = SEED) -> np.ndarray:
    """One row of b-bit symbols for each text that has a shingle (``runs > 0``)."""
    odd = np.random.default_rng(seed).integers(1, 1 << 62, size=symbols, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sizes = runs[runs > 0]
    start = np.cumsum(sizes) - sizes
    out = np.empty((len(start), symbols), np.uint64)
    for j in range(symbols):
        h = hashes * odd[j]
        out[:, j] = np.minimum.reduceat(h ^ (h >> np.uint64(31)), start) if len(start) else 0
    return (out * _P2) >> np.uint64(64 - bits)


def index_keys(sig: np.ndarray, chunks: int = CHUNKS, errors: int = ERRORS) -> np.ndarray:
    """The keys of every signature: for each chunk, one for every choice of ``errors`` symbols that may differ."""
    width = sig.shape[1] // chunks
    out = []
    for c in range(chunks):
        part = sig[:, c * width : (c + 1) * width]
        for kept in itertools.combinations(range(width), width - errors):
            h = np.full(len(sig), np.uint64(c * 1009 + sum(1 << k for k in kept)))
            for k in kept:
                h = (h ^ part[:, k]) * _P1
                h ^= h >> np.uint64(29)
            out.append(h)
    return np.stack(out, 1).view(np.int64)


def text_class(text: Column, clashes: tuple[int, ...] = ()) -> Column:
    """The class of equal texts: a 64-bit hash of text and length; texts whose hash is among ``clashes`` take another one."""
    cls = F.xxhash64(text, F.length(text))
    return F.when(cls.isin(*clashes), F.xxhash64(F.md5(text), F.lit("again"))).otherwise(cls) if clashes else cls


def clashes(chunks: DataFrame) -> tuple[int, ...]:
    """Class hashes that different texts share, found by their MD5: none are expected below a billion texts, some hundred at a hundred billion."""
    t = chunks.filter("text is not null").select(text_class(F.col("text")).alias("cls"), F.md5("text").alias("h"))
    return tuple(r[0] for r in t.groupBy("cls").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").select("cls").collect())


def _keys(texts: DataFrame, width: int) -> DataFrame:
    """``key, cls`` of every class with a shingle; a task emits a class once, so copies collapse before the shuffle.

    A key that more than MAX_RUN classes of one batch share is emitted once, as a mark, and each of its classes once with a marked key of its own: a key
    that a third of all texts share is a row a batch, not a row a text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, seen = _Ids(), set()
        for b in batches:
            cls = b.column(0).to_numpy()
            new = []
            for i, c in enumerate(cls.tolist()):
                if c not in seen:
                    seen.add(c)
                    new.append(i)
            if not new:
                continue
            hashes, runs = shingles(b.column(1).take(pa.array(new)).to_pylist(), ids, width)
            keys = index_keys(signatures(hashes, runs))
            own = np.repeat(cls[new][runs > 0], keys.shape[1])
            flat = keys.ravel()
            each, back, count = np.unique(flat, return_inverse=True, return_counts=True)
            hot = count[back] > MAX_RUN
            crowd = np.unique(own[hot])
            alone = (crowd.view(np.uint64) * _P2 ^ _P3).view(np.int64)
            out_key = [flat[~hot], each[count > MAX_RUN], alone, alone]
            out_cls = [own[~hot], np.full(int((count > MAX_RUN).sum()), _MARK), np.full(len(crowd), _MARK), crowd]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_key)), pa.array(np.concatenate(out_cls))], names=["key", "cls"])

    return texts.select("cls", "text").mapInArrow(run, "key long, cls long")


def _pair_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key and class: pairs of classes that share a key; of a key with over MAX_RUN classes or a mark each class with a null partner."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def emit(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)], schema=out)

    def solve(key: np.ndarray, cls: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(edge, len(key)))
        crowded = (size > MAX_RUN) | (cls[edge] == _MARK)
        big = np.repeat(crowded, size) & (cls != _MARK)
        if big.any():
            yield emit(np.unique(cls[big]), None)
        multi = np.repeat((size > 1) & ~crowded, size)
        key, cls = key[multi], cls[multi]
        found = []
        for step in range(1, MAX_RUN):
            same = np.flatnonzero(key[step:] == key[:-step]) if len(key) > step else np.zeros(0, np.int64)
            if not len(same):
                break
            found.append(np.stack([cls[same], cls[same + step]], 1))
        if found:
            p = np.unique(np.concatenate(found), axis=0)
            yield emit(np.ascontiguousarray(p[:, 0]), np.ascontiguousarray(p[:, 1]))

    key, cls, hot = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    for b in batches:
        k, c = b.column(0).to_numpy(), b.column(1).to_numpy()
        if hot is not None:
            n = int(np.searchsorted(k, hot, "right"))
            if n:
                yield emit(np.unique(c[:n]), None)
            if n < len(k):
                hot = None
            k, c = k[n:], c[n:]
        key, cls = np.concatenate([key, k]), np.concatenate([cls, c])
        if not len(key):
            continue
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])])
        key, cls = key[fresh], cls[fresh]
        tail = int(np.searchsorted(key, key[-1], "left"))
        if tail:
            yield from solve(key[:tail], cls[:tail])
        key, cls = key[tail:], cls[tail:]
        if len(key) > MAX_RUN or cls[0] == _MARK:
            yield emit(cls[cls != _MARK], None)
            hot, key, cls = int(key[0]), key[:0], cls[:0]
    if len(key):
        yield from solve(key, cls)


def _sets(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``cls, tokens`` (distinct shingle hashes) of the wanted classes, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, seen = _Ids(), set()
        for b in batches:
            cls = b.column(0).to_pylist()
            new = [i for i, c in enumerate(cls) if not (c in seen or seen.add(c))]
            if new:
                hashes, runs = shingles(b.column(1).take(pa.array(new)).to_pylist(), ids, width)
                lists = [np.unique(x).view(np.int64) for x in np.split(hashes, np.cumsum(runs)[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array([cls[i] for i in new], pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["cls", "tokens"])

    side = F.broadcast(wanted) if small(wanted, BROADCAST_ROWS) else wanted
    return texts.join(side, "cls", "left_semi").select("cls", "text").mapInArrow(run, "cls long, tokens array<long>").groupBy("cls").agg(F.first("tokens").alias("tokens"))


def _prefix_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """Exact candidates among ``sets``: pairs that share one of their rarest tokens and whose sizes allow the threshold."""
    tokens = sets.select("cls", F.size("tokens").alias("n"), F.explode("tokens").alias("t"))
    df = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(Window.partitionBy("cls").orderBy("df", "t"))
    keep = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    prefix = tokens.join(df, "t").withColumn("r", rank).filter(F.col("r") <= keep).select("t", "cls", "n")
    a, b = prefix.select("t", F.col("cls").alias("a"), F.col("n").alias("na")), prefix.select("t", F.col("cls").alias("b"), F.col("n").alias("nb"))
    fits = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9)
    return a.join(b, "t").filter(fits).select("a", "b").distinct()


def similar_classes(texts: DataFrame, width: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """``a, b, similarity``: pairs of different text classes (a < b) with Jaccard similarity of at least ``threshold``.

    ``texts`` has ``cls`` and a non-null ``text``. The result is a written table.
    """
    keyed = _keys(texts, width).repartition("key").sortWithinPartitions("key", "cls")
    found = materialise(keyed.mapInArrow(_pair_runs, "a long, b long").distinct(), "candidates")
    pairs = found.filter("b is not null")
    hot = found.filter("b is null").select(F.col("a").alias("cls"))
    if hot.limit(1).count():
        hot = materialise(hot.distinct(), "hot")
        pairs = pairs.unionByName(_prefix_pairs(materialise(_sets(texts, hot, width), "hotsets"), threshold)).distinct()
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    sets = _sets(texts, wanted, width)
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("cls").alias("b"), F.col("tokens").alias("tb")), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    scored = both.select("a", "b", F.size("ta").alias("na"), F.size("tb").alias("nb"), common.alias("c"))
    scored = scored.select("a", "b", (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("similarity"))
    return materialise(scored.filter(F.col("similarity") >= threshold - 1e-12), "similar")


def _texts(chunks: DataFrame, apart: tuple[int, ...]) -> DataFrame:
    return chunks.filter("text is not null and chunk_no is not null").select("chunk_no", "root", "path", "text", text_class(F.col("text"), apart).alias("cls"))


def _enough(text: Column, width: int) -> Column:
    return F.lower(text).rlike("[a-z0-9_]" + "[^a-z0-9_]+".join([r"+"] + [r"[a-z0-9_]+"] * (width - 2) + ["[a-z0-9_]"]) if width > 1 else "[a-z0-9_]")


def _members(texts: DataFrame, similar: DataFrame, width: int) -> DataFrame:
    """Chunks of classes with a link or several chunks, each chunk once: ``chunk_no, root, path, cls``."""
    rows = texts.filter(_enough(F.col("text"), width)).select("chunk_no", "root", "path", "cls").dropDuplicates(["chunk_no"])
    linked = similar.select(F.explode(F.array("a", "b")).alias("cls"))
    several = rows.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("cls")
    return materialise(rows.join(linked.union(several).distinct(), "cls", "left_semi"), "members")


def found_pairs(chunks: DataFrame, width: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """``chunk_a, chunk_b`` (smaller first): chunks of different files whose texts are similar enough.

    A file is known by root and path, null being a value of its own. Null texts and texts of fewer than ``width`` words take no part; a chunk delivered twice
    counts once, one without ``chunk_no`` not at all; an empty table gives no rows.
    """
    texts = _texts(chunks, clashes(chunks))
    similar = similar_classes(texts, width, threshold)
    m = _members(texts, similar, width)
    x = m.select(F.col("chunk_no").alias("x"), F.col("root").alias("xr"), F.col("path").alias("xp"), F.col("cls").alias("a"))
    y = m.select(F.col("chunk_no").alias("y"), F.col("root").alias("yr"), F.col("path").alias("yp"), F.col("cls").alias("b"))
    other = ~(F.col("xr").eqNullSafe(F.col("yr")) & F.col("xp").eqNullSafe(F.col("yp")))
    equal = x.join(y.withColumnRenamed("b", "a"), "a").filter((F.col("x") < F.col("y")) & other)
    near = similar.join(x, "a").join(y, "b").filter(other)
    both = equal.select("x", "y").unionByName(near.select("x", "y"))
    return both.select(F.least("x", "y").alias("chunk_a"), F.greatest("x", "y").alias("chunk_b"))


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node reachable over ``edges`` (a, b), by min-label steps with pointer doubling."""
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        step = labels.join(heard, "node").select("node", F.least("label", "heard").alias("new"), "label")
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        step = materialise(step.join(jump, "new").select("node", F.least("new", "far").alias("new"), "label"), "labels")
        labels = step.select("node", F.col("new").alias("label"))
        if not step.filter("new <> label").limit(1).count():
            return labels


def groups(chunks: DataFrame, width: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """``chunk_no, group_id, links`` of every chunk: the group is the smallest chunk number linked to it directly or over others.

    ``links`` counts the similar text classes, its own equal copies not included. A chunk without text or partner is its own group.
    """
    apart = clashes(chunks)
    similar = similar_classes(_texts(chunks, apart), width, threshold)
    label = components(similar).withColumnRenamed("node", "cls")
    links = similar.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("links"))
    cls = F.when(F.col("text").isNotNull() & _enough(F.col("text"), width), text_class(F.col("text"), apart)).otherwise(F.xxhash64(F.lit("alone"), F.col("chunk_no")))
    rows = chunks.filter("chunk_no is not null").select("chunk_no", cls.alias("cls")).dropDuplicates(["chunk_no"])
    rows = rows.join(label, "cls", "left").join(links, "cls", "left").select("chunk_no", F.coalesce("label", "cls").alias("label"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    ids = rows.groupBy("label").agg(F.min("chunk_no").alias("group_id"))
    return rows.join(ids, "label").select("chunk_no", "group_id", "links")
