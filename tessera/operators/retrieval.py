"""Lexical, cosine and fused retrieval, always for a batch of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import estimate_tokens, is_identifier_query, rank_prior, tokens
from tessera.session import BROADCAST_ROWS, materialise, small

#: BM25 and fusion constants (fixed values).
K1, B, HEADER_WEIGHT = 1.2, 0.75, 3
RRF_K, IDENTIFIER_WEIGHT = 60, 1.5
DUPLICATE, VECTOR_DEPTH = 0.90, 50
QUERY_BLOCK = 4096


def postings(docs: DataFrame, id_col: str, header: Column, text: Column, mark: bool = False) -> DataFrame:
    """``term, id, tf, dl``: weighted term frequencies and the weighted length of every record with a term.

    The header counts three times; null parts count as empty. ``id_col`` is unique; extra columns are ignored. With ``mark`` every record, also an
    empty one, has a row with the term '' and no frequency, so that the same pass gives the collection's statistics.
    """
    empty = F.array().cast("array<string>")
    t = docs.select(F.col(id_col).alias("id"), F.coalesce(tokens(header), empty).alias("h"), F.coalesce(tokens(text), empty).alias("b"))
    dl = F.size("h") * HEADER_WEIGHT + F.size("b")
    weighted = F.concat(F.transform("h", lambda x: F.struct(x.alias("term"), F.lit(HEADER_WEIGHT).alias("w"))), F.transform("b", lambda x: F.struct(x.alias("term"), F.lit(1).alias("w"))))
    if mark:
        weighted = F.concat(weighted, F.array(F.struct(F.lit("").alias("term"), F.lit(0).alias("w"))))
    e = t.select("id", dl.cast("long").alias("dl"), F.explode(weighted).alias("x"))
    return e.select("id", "dl", "x.term", "x.w").groupBy("id", "dl", "term").agg(F.sum("w").cast("long").alias("tf")).select("term", "id", "tf", "dl")


def lengths(docs: DataFrame, id_col: str, header: Column, text: Column) -> DataFrame:
    """``id, dl``: weighted token count of every record, 0 for empty ones."""
    n = lambda c: F.coalesce(F.size(tokens(c)), F.lit(0))
    return docs.select(F.col(id_col).alias("id"), (F.greatest(n(header), F.lit(0)) * HEADER_WEIGHT + F.greatest(n(text), F.lit(0))).cast("long").alias("dl"))


def idf(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``query_id, term``, each term of a query once."""
    return queries.select(F.col(id_col).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term"))


def bm25(docs: DataFrame, queries: DataFrame, id_col: str, header: Column, text: Column, query_id: str, query_text: str) -> DataFrame:
    """``query_id, id, score`` of every record that shares a term with a query, rounded to 6 places.

    The corpus is read and tokenised once. Only terms of the batch (and a mark for each record, which carries its length) leave the tokeniser: they are filtered
    by a join with the distinct query terms (broadcast behind a check of their number) before anything is aggregated, so the shuffle holds what can match
    and a row for each record, no more. An empty corpus or query batch gives no rows.
    """
    qt = materialise(query_terms(queries, query_id, query_text), "terms")
    few = small(qt, BROADCAST_ROWS)
    wanted = qt.select("term").distinct().unionByName(qt.sparkSession.createDataFrame([("",)], "term string"))
    marked = postings(docs, id_col, header, text, mark=True)
    post = materialise(marked.join(F.broadcast(wanted) if few else wanted, "term", "left_semi"), "postings")  # read for the statistics, the document frequencies and the scores
    s = post.filter("term = ''").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl")).first()
    return score_postings(post.filter("term <> ''"), qt, F.lit(s["n"]), F.lit(s["avgdl"] or 0.0), few)


def score_postings(post: DataFrame, qt: DataFrame, n: Column, avgdl: Column, few: bool | None = None) -> DataFrame:
    """``query_id, id, score`` from postings (term, id, tf, dl) of the terms in ``qt`` (query_id, term), the number of records and their mean length.

    ``few``: whether the query terms were found few enough to be broadcast; checked here if not given.
    """
    df = post.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    weighted = qt.join(df, "term").select("query_id", "term", idf(F.col("df"), n).alias("idf"), avgdl.alias("avgdl"))
    hit = post.join(F.broadcast(weighted) if (small(qt, BROADCAST_ROWS) if few is None else few) else weighted, "term")
    tf = F.col("tf").cast("double")
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1e-9))))
    return hit.groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"))


def top_k(scored: DataFrame, k: int, by: str = "query_id", score: str = "score", id_col: str = "id") -> DataFrame:
    """Adds ``rank`` (from 1) and keeps ranks up to k; ties go to the smaller id."""
    w = Window.partitionBy(by).orderBy(F.desc(score), id_col)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vec_col: str, query_id: str, query_vec: str, dim: int, least: float | None = None) -> DataFrame:
    """``query_id, id, score, rank``: the k vectors most similar to each query (all of at least ``least`` if k is 0); zero vectors score 0.

    The stated queries are held against all rows in blocks of about ``QUERY_BLOCK``, each a bounded broadcast; the vectors aren't shuffled. A task
    multiplies its batches with the block's matrix and passes on only what can be among the best k of the batch. Null vectors
    and vectors of another dimension take no part; ids are numbers; ties go to the smaller id.
    """
    ok = lambda c: (F.size(c) == dim) & ~F.exists(c, lambda e: e.isNull())
    q = queries.filter(ok(query_vec)).select(F.col(query_id).cast("long").alias("q"), F.col(query_vec).cast("array<double>").alias("v"))
    blocks = -(-q.count() // QUERY_BLOCK) or 1
    rows = vectors.filter(ok(vec_col)).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    found = None
    for b in range(blocks):
        part = q.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).toPandas()
        mat = np.array(part["v"].tolist(), float).reshape(-1, dim)
        shared = vectors.sparkSession.sparkContext.broadcast((part["q"].to_numpy(np.int64), _unit(mat)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qid, qm = shared.value
            for rb in batches:
                if not rb.num_rows or not len(qid):
                    continue
                ids = rb.column(0).to_numpy(zero_copy_only=False)
                s = np.round(_unit(rb.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)) @ qm.T, 6) + 0.0
                if k and len(ids) > k:
                    keep = s >= np.partition(s, len(ids) - k, axis=0)[len(ids) - k]
                else:
                    keep = np.ones_like(s, bool)
                if least is not None:
                    keep &= s > least
                r, c = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(qid[c]), pa.array(ids[r]), pa.array(s[r, c])], names=["query_id", "id", "score"])

        hit = rows.mapInArrow(run, "query_id long, id long, score double")
        found = hit if found is None else found.unionByName(hit)
    return top_k(found, k) if k else found


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(n > 0, x / np.where(n > 0, n, 1), x)


def apply_priors(ranked: DataFrame, meta: DataFrame, id_col: str = "id") -> DataFrame:
    """Scores times the prior of the record's kind of file; ids without metadata drop out. ``meta``: id, path, lang."""
    prior = rank_prior(F.col("path"), F.col("lang"))
    return ranked.join(meta.select(F.col(id_col).alias("id"), "path", "lang"), "id").withColumn("score", F.round(F.col("score") * prior, 7)).drop("path", "lang")


def rrf(*lists: tuple[DataFrame, Column | float]) -> DataFrame:
    """``query_id, id, score``: reciprocal rank fusion of rankings (query_id, id, rank from 1) with their weights.

    One union and one partial aggregation; a list that lacks an id adds nothing to it.
    """
    parts = [d.select("query_id", "id", ((w if isinstance(w, Column) else F.lit(float(w))) / (RRF_K + F.col("rank"))).alias("s")) for d, w in lists]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("query_id", "id").agg(F.round(F.sum("s"), 9).alias("score"))


def fetch_size(k: int) -> int:
    """How many candidates are taken before priors are applied."""
    return max(20, 2 * k)


def hybrid(lexical: DataFrame, vector: DataFrame, queries: DataFrame, meta: DataFrame, k: int, query_id: str, query_text: str) -> DataFrame:
    """Both rankings are cut to ``fetch_size(k)``, get priors and are fused; queries that name code weigh the lexical one by 1.5."""
    weight = queries.select(F.col(query_id).alias("query_id"), F.when(is_identifier_query(F.col(query_text)), IDENTIFIER_WEIGHT).otherwise(1.0).alias("weight"))
    n = fetch_size(k)
    lex = top_k(apply_priors(top_k(lexical, n).drop("rank"), meta), n).join(weight, "query_id")
    vec = top_k(apply_priors(top_k(vector, n).drop("rank"), meta), n)
    return top_k(rrf((lex, F.col("weight")), (vec, 1.0)), k)


def search(docs: DataFrame, queries: DataFrame, k: int = 8, mode: str = "lexical", vector: DataFrame | None = None) -> DataFrame:
    """The query driver: ``query_id, id, rank, score, degraded, reason`` over chunk records (id, path, lang, header, text).

    Modes: lexical, vector, hybrid. Vector and hybrid mode without vector scores fall back to lexical and say so with a reason; vector mode whose scores are
    empty gives no rows.
    """
    if mode not in ("lexical", "vector", "hybrid"):
        raise ValueError(f"unknown mode {mode}")
    meta = docs.select("id", "path", "lang")
    degraded = mode != "lexical" and vector is None
    if mode == "vector" and not degraded:
        out = top_k(apply_priors(top_k(vector, fetch_size(k)).drop("rank"), meta), k)
    else:
        lex = bm25(docs, queries, "id", F.col("header"), F.col("text"), "query_id", "query")
        if mode == "hybrid" and not degraded:
            out = hybrid(lex, vector, queries, meta, k, "query_id", "query")
        else:
            out = top_k(apply_priors(top_k(lex, fetch_size(k)).drop("rank"), meta), k)
    return out.select("query_id", "id", "rank", "score", F.lit(degraded).alias("degraded"), F.lit("no vectors" if degraded else None).cast("string").alias("reason"))


def ephemeral_search(files: DataFrame, queries: DataFrame, k: int = 8, most_files: int = 2000) -> DataFrame:
    """Search without a stored index: the files (path, lang, text) are chunked on the fly, the best 2k get priors; more than ``most_files`` files raise ValueError."""
    from tessera.operators import chunking

    if files.limit(most_files + 1).count() > most_files:
        raise ValueError(f"over {most_files} files: build an index first")
    chunks = materialise(chunking.chunk_files(files, chunking.extract_symbols(files)[0]), "chunks")
    lex = bm25(chunks, queries, "id", F.col("header"), F.col("text"), "query_id", "query")
    out = top_k(apply_priors(top_k(lex, 2 * k).drop("rank"), chunks), k)
    return out.select("query_id", "id", "rank", "score", F.lit(True).alias("degraded"), F.lit("no index").alias("reason"))


def decision_search(decisions: DataFrame, queries: DataFrame, k: int, vector: DataFrame | None = None) -> DataFrame:
    """``query_id, id, score, rank`` over decision records alone: BM25 with their own statistics, no priors, fused with equal weights with the vector hits among them.

    ``vector``: query_id, id, score of a search over all records, of which the best 50 of each query compete before others than decisions drop out; without it the
    lexical ranking stands. ``decisions``: id, header, text; ``queries``: query_id, query.
    """
    lex = top_k(bm25(decisions, queries, "id", F.col("header"), F.col("text"), "query_id", "query"), k)
    if vector is None:
        return lex.select("query_id", "id", "score", "rank")
    hits = top_k(vector, VECTOR_DEPTH).drop("rank").join(decisions.select("id").distinct(), "id", "left_semi")
    return top_k(rrf((lex, 1.0), (top_k(hits, k), 1.0)), k).select("query_id", "id", "score", "rank")


def result_rows(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Results as they are shown: ``query_id, rank, span, path, line_start, line_end, symbol, kind, score (4 places), header, source, tokens``.

    A span of one line names it once. Ids without a chunk drop out.
    """
    one = F.col("line_start") == F.col("line_end")
    span = F.concat(F.col("path"), F.lit(":L"), F.col("line_start"), F.when(one, "").otherwise(F.concat(F.lit("-L"), F.col("line_end"))))
    r = results.join(chunks.select("id", "path", "line_start", "line_end", "symbol", "kind", "header", "source", "text"), "id")
    return r.select("query_id", "rank", span.alias("span"), "path", "line_start", "line_end", "symbol", "kind", F.round("score", 4).alias("score"), "header", "source", estimate_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))


def check_prompts(history: DataFrame, prompts: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """``(duplicates, fresh)`` of a batch of prompts against the prompts so far, each with ``sha, prompt, when, vec``.

    Duplicates: ``sha, earlier, when, cosine`` (3 places) of more than ``DUPLICATE``, the most similar first within a prompt. Fresh: the rows to append, one
    for each content hash that the history lacks. The history isn't shuffled for the check.
    """
    num = lambda d, name: d.withColumn(name, F.xxhash64("sha"))
    h, q = num(history.dropDuplicates(["sha"]), "_h"), num(prompts.dropDuplicates(["sha"]), "_q")
    near = cosine_topk(h, q, 0, "_h", "vec", "_q", "vec", dim, DUPLICATE)
    found = near.join(q.select(F.col("_q").alias("query_id"), "sha"), "query_id").join(h.select(F.col("_h").alias("id"), F.col("prompt").alias("earlier"), "when"), "id")
    order = F.row_number().over(Window.partitionBy("sha").orderBy(F.desc("score"), "when", "earlier"))
    dups = found.select("sha", "earlier", "when", F.round("score", 3).alias("cosine"), order.alias("place"))
    return dups, q.drop("_q").join(history.select("sha"), "sha", "left_anti")


def result_tokens(results: DataFrame, chunks: DataFrame, file_tokens: DataFrame) -> DataFrame:
    """Per query: tokens of the returned chunks, and of their whole files, each file counted once."""
    r = results.join(chunks.select("id", "path", estimate_tokens(F.col("text")).alias("tokens")), "id")
    spans = r.groupBy("query_id").agg(F.sum("tokens").alias("chunk_tokens"))
    whole = r.select("query_id", "path").distinct().join(file_tokens, "path").groupBy("query_id").agg(F.sum("file_tokens").alias("whole_file_tokens"))
    return spans.join(whole, "query_id", "left")


def find_symbol(symbols: DataFrame, name: str, limit: int = 50) -> DataFrame:
    """Symbols of that name, or else those that contain it (case doesn't matter); a method also matches by its last part."""
    n, want = F.lower("name"), name.lower()
    exact = (n == want) | (F.element_at(F.split(n, r"\."), -1) == want)
    cls = F.when(exact, 0).when(F.contains(n, F.lit(want)), 1)
    ranked = symbols.withColumn("cls", cls).filter("cls is not null")
    best = ranked.agg(F.min("cls").alias("cls"))
    out = ranked.join(F.broadcast(best), "cls").withColumn("match", F.when(F.col("cls") == 0, "exact").otherwise("partial")).drop("cls")
    return out.orderBy("path", "line_start", "name").limit(limit)
