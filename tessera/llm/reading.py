"""Reading level of documents from words' acquisition grades.

Fit: in a bounded sample of rated documents, a word's acquisition grade is the point of the level scale at which half of
its (per level normalised) use lies below. Calibration: quantiles of a document's known-word grades are mapped to the raters' scale
by monotone regressions (pool adjacent violators), whose mean is the level. Apply: whole texts of all documents, map side only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rated documents used in fitting (those of the smallest id hashes), all their words count; folds of cross-fitting.
FIT_DOCS, FOLDS = 6_000, 5
QUANTILES = (0.25, 0.5, 0.75, 0.9)
LEVELS = 5
MIN_DOCS = 3


def _patterns():
    import regex

    return regex.compile(r"\p{L}+"), regex.compile(r"[.!?](?=\s|\Z)"), regex.compile(r"\r\n|\n|\r")


def prose(text: str, newline=None) -> str:
    """The text without fenced code and without lines that start as headings, tables, lists, quotes or indented code.

    A fence that is never closed runs to the end. The order of the other lines is kept.
    """
    newline = newline or _patterns()[2]
    out, fenced = [], False
    for line in newline.split(text):
        if line.startswith("```"):
            fenced = not fenced
        elif not fenced and not line.startswith(("#", "|", "-", "*", ">", "\t", "    ")):
            out.append(line)
    return "\n".join(out)


def measures(text: str, pats) -> tuple[list[str], int, int]:
    """``(words, sentences, letters)`` of the prose; what has no word is no sentence."""
    word, stop, newline = pats
    p = prose(text, newline)
    words = word.findall(p)
    sentences = sum(1 for s in stop.split(p) if word.search(s)) if words else 0
    return words, sentences, sum(map(len, words))


def pava(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Monotone least-squares fit: knots x (ascending) and their values; empty input gives one knot at 0."""
    if not len(x):
        return np.zeros(1), np.full(1, (LEVELS + 1) / 2)
    ux, inv = np.unique(x, return_inverse=True)
    w = np.bincount(inv).astype(float)
    v = np.bincount(inv, weights=y) / w
    blocks: list[list[float]] = []
    for a, b in zip(v, w, strict=True):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            c, d = blocks.pop(), blocks[-1]
            d[0] = (d[0] * d[1] + c[0] * c[1]) / (d[1] + c[1])
            d[1] += c[1]
            d[2] += c[2]
    return ux, np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


@dataclass
class Model:
    """Word grades and, for each quantile, a monotone map to the level scale. Without ratings every level is the middle one."""

    grades: dict[str, float] = field(default_factory=dict)
    curves: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def quantiles(self, words: list[str]) -> np.ndarray | None:
        known = [g for g in map(self.grades.get, words) if g is not None]
        return np.quantile(known, QUANTILES) if known else None

    def level(self, q: np.ndarray | None) -> float:
        if q is None or not self.curves:
            return (LEVELS + 1) / 2
        return float(np.mean([np.interp(v, *c) for v, c in zip(q, self.curves, strict=True)]))


def doc_ratings(labels: DataFrame) -> DataFrame:
    """``(doc_id, rating)``: a rater's repeated levels are averaged first, then the raters; null levels don't count."""
    one = labels.filter(F.col("reading_level").between(1, LEVELS)).groupBy("doc_id", "rater").agg(F.avg("reading_level").alias("v"))
    return one.groupBy("doc_id").agg(F.avg("v").alias("rating"))


def _words(docs: DataFrame) -> DataFrame:
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pats = _patterns()
        for pdf in it:
            rows = [(i, r, w.lower()) for i, r, t in zip(pdf["doc_id"], pdf["rating"], pdf["text"], strict=True) for w in dict.fromkeys(x.lower() for x in measures(t, pats)[0])]
            yield pd.DataFrame(rows, columns=["doc_id", "rating", "word"])

    return docs.mapInPandas(run, "doc_id long, rating double, word string")


def _grades(rows: list, size: np.ndarray, without: int | None) -> dict[str, float]:
    """Acquisition grades from the words' uses by level and fold, a fold left out. ``size``: documents by level and fold."""
    keep = [f for f in range(FOLDS) if f != without]
    per_level = np.maximum(size[:, keep].sum(axis=1), 1)
    out = {}
    for r in rows:
        n = np.array(r["n"], float).reshape(LEVELS, FOLDS)[:, keep].sum(axis=1)
        if n.sum() >= MIN_DOCS:
            use = n / per_level
            share = np.concatenate([[0.0], np.cumsum(use)]) / max(use.sum(), 1e-12)
            out[r["word"]] = float(np.interp(0.5, share, np.arange(LEVELS + 1) + 0.5))
    return out


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """Fits on at most ``fit_docs`` rated documents and all their words; all else covers every document.

    Calibration is cross-fitted: the quantiles of a document that a curve is fitted to come from grades to which its fold didn't add.
    """
    rated = doc_ratings(labels).filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
    ratings = {r["doc_id"]: r["rating"] for r in rated.collect()}  # at most fit_docs pairs
    if not ratings:
        return Model()
    spark = docs.sparkSession
    known = spark.createDataFrame([(i, float(r), k % FOLDS) for k, (i, r) in enumerate(ratings.items())], "doc_id long, rating double, fold int")
    sample = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(known), "doc_id")
    cell = (F.round("rating").cast("int") - 1) * FOLDS + F.col("fold")
    words = _words(sample).join(F.broadcast(known.select("doc_id", "fold")), "doc_id").select("word", cell.alias("cell"))
    counts = words.groupBy("word").agg(F.array(*[F.sum((F.col("cell") == c).cast("int")) for c in range(LEVELS * FOLDS)]).alias("n"), F.count(F.lit(1)).alias("total"))
    rows = counts.filter(F.col("total") >= MIN_DOCS).select("word", "n").collect()  # the vocabulary of at most fit_docs documents
    size = np.zeros((LEVELS, FOLDS))
    for k, r in enumerate(ratings.values()):
        size[int(np.rint(r)) - 1, k % FOLDS] += 1
    model = Model(_grades(rows, size, None))
    shared = spark.sparkContext.broadcast([Model(_grades(rows, size, f)) for f in range(FOLDS)])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, pats = shared.value, _patterns()
        for pdf in it:
            q = [m[f].quantiles([w.lower() for w in measures(t, pats)[0]]) for t, f in zip(pdf["text"], pdf["fold"], strict=True)]
            yield pd.DataFrame({"rating": pdf["rating"], "q": q})

    pairs = [(r["q"], r["rating"]) for r in sample.mapInPandas(run, "rating double, q array<double>").collect() if r["q"] is not None]
    if not pairs:
        return model
    q, y = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    order = np.lexsort((y, *q.T))
    return Model(model.grades, [pava(q[order, k], y[order]) for k in range(len(QUANTILES))])


def heldout_error(docs: DataFrame, labels: DataFrame, share: int = 5) -> DataFrame:
    """``n, mean_error, median_error, correlation`` on a ``share``-th of the rated documents that the fit didn't see; ``median_error`` is that of giving all the same middle level."""
    held = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(share)) == 0
    truth = doc_ratings(labels.filter(held))
    scored = levels(docs.join(truth.select("doc_id"), "doc_id", "left_semi"), fit(docs, labels.filter(~held))).join(truth, "doc_id").filter("level is not null")
    mid = scored.agg(F.percentile_approx("rating", 0.5).alias("mid"))
    return scored.crossJoin(F.broadcast(mid)).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("level") - F.col("rating"))).alias("mean_error"), F.avg(F.abs(F.col("mid") - F.col("rating"))).alias("median_error"), F.corr("level", "rating").alias("correlation"))


def levels(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_words, n_sentences, words_per_sentence, letters_per_word, level, band`` of every document.

    Null, empty and wordless texts have 0 words, null means and a null level; a text without any graded word gets the middle level.
    Repeated rows come out as often as they came in; rows without ``doc_id`` don't.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the words of at most FIT_DOCS documents and as many knots

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, pats = shared.value, _patterns()
        for pdf in it:
            rows = []
            for t in pdf["text"]:
                words, sentences, letters = measures(t, pats) if t else ([], 0, 0)
                n = len(words)
                lv = m.level(m.quantiles([w.lower() for w in words])) if n else None
                rows.append((n, sentences, n / sentences if n else None, letters / n if n else None, lv, None if lv is None else int(min(LEVELS, max(1, round(lv))))))
            out = pd.DataFrame(rows, columns=["n_words", "n_sentences", "words_per_sentence", "letters_per_word", "level", "band"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out.astype({"band": "Int32"})

    return docs.filter("doc_id is not null").select("doc_id", "text").mapInPandas(run, "doc_id long, n_words int, n_sentences int, words_per_sentence double, letters_per_word double, level double, band int")


def demanding(scored: DataFrame, words: int = 40, per_sentence: float = 22.0, letters: float = 5.9) -> DataFrame:
    """Documents whose prose is long enough and exceeds both means; each ``doc_id`` once."""
    return scored.filter((F.col("n_words") >= words) & (F.col("words_per_sentence") >= per_sentence) & (F.col("letters_per_word") >= letters)).select("doc_id").distinct()
