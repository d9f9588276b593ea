"""Retrieval queries: tokens, postings, BM25, cosine, fusion, priors, symbol search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import retrieval as R
from tessera.plans.common import DOCS_BM25, ONCE, PRIOR, bm25_sql, chunks, documents, header, postings_sql, tok
from tessera.session import read_table

GOLD = "golden_items"


def _bm25(spark: SparkSession, sf: str, queries: DataFrame | None = None) -> DataFrame:
    q = read_table(spark, sf, GOLD) if queries is None else queries
    return R.bm25(documents(spark, sf), q, "doc_id", header(), F.col("text"), "item_id", "query")


def _bm25_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return R.bm25(chunks(spark, sf, "header", "text"), read_table(spark, sf, GOLD), "chunk_no", F.col("header"), F.col("text"), "item_id", "query")


def _meta(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf, "path", "lang").withColumnRenamed("chunk_no", "id")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "chunk_vectors").filter("size(vec) = 64").groupBy("chunk_no").agg(F.max("vec").alias("vec"))


def tokenize_terms(spark, sf):
    return documents(spark, sf).select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def term_frequency(spark, sf):
    return R.postings(documents(spark, sf), "doc_id", header(), F.col("text")).select(F.col("id").alias("doc_id"), "term", "tf")


def doc_frequency_idf(spark, sf):
    d = documents(spark, sf)
    df = R.postings(d, "doc_id", header(), F.col("text")).groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    return df.crossJoin(F.broadcast(d.agg(F.count(F.lit(1)).cast("double").alias("n")))).select("term", "df", F.round(R.idf(F.col("df"), F.col("n")), 6).alias("idf"))


def doc_length_stats(spark, sf):
    return R.lengths(documents(spark, sf), "doc_id", header(), F.col("text")).agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("total"), F.round(F.avg("dl"), 6).alias("avgdl"))


def bm25_topk(spark, sf):
    one = spark.createDataFrame([(1, "where does the retry handler load the config")], "item_id long, query string")
    return R.top_k(_bm25(spark, sf, one), 10).join(documents(spark, sf).select(F.col("doc_id").alias("id"), "lang", "source"), "id").select("rank", F.col("id").alias("doc_id"), "score", "lang", "source")


def bm25_multi_query_topk(spark, sf):
    return R.top_k(_bm25(spark, sf), 8).select("query_id", F.col("id").alias("doc_id"), "score", "rank")


def bm25_with_priors(spark, sf):
    cut = R.top_k(_bm25_chunks(spark, sf), R.fetch_size(8)).drop("rank")
    return R.top_k(R.apply_priors(cut, _meta(spark, sf)), 8).select("query_id", F.col("id").alias("chunk_no"), "score", "rank")


def cosine_topk(spark, sf):
    v = _vectors(spark, sf)
    return R.cosine_topk(v, v.filter("chunk_no % 100 = 0"), 8, "chunk_no", "vec", "chunk_no", "vec", 64).select("query_id", F.col("id").alias("chunk_no"), "score", "rank")


def l2_normalize_check(spark, sf):
    e = read_table(spark, sf, "embeddings")
    return e.select("vec_id", F.round(V.norm(V.l2_normalise(F.col("embedding"))), 6).alias("length"), F.round(V.norm(F.col("embedding")), 4).alias("norm"))


def _two_rankings(spark, sf):
    lex = R.top_k(_bm25(spark, sf), 20)
    by_text = R.top_k(R.bm25(documents(spark, sf), read_table(spark, sf, GOLD), "doc_id", F.lit(""), F.col("text"), "item_id", "passage"), 20)
    return lex, by_text


def rrf_fusion(spark, sf):
    a, b = _two_rankings(spark, sf)
    return R.top_k(R.rrf((a, 1.0), (b, 1.0)), 8).select("query_id", F.col("id").alias("doc_id"), "score", "rank")


def rrf_identifier_boost(spark, sf):
    a, b = _two_rankings(spark, sf)
    w = read_table(spark, sf, GOLD).select(F.col("item_id").alias("query_id"), F.when(T.is_identifier_query(F.col("passage")), R.IDENTIFIER_WEIGHT).otherwise(1.0).alias("weight"))
    return R.top_k(R.rrf((a.join(w, "query_id"), F.col("weight")), (b, 1.0)), 8).select("query_id", F.col("id").alias("doc_id"), "score", "rank")


def identifier_queries(spark, sf):
    return read_table(spark, sf, GOLD).select("item_id", T.is_identifier_query(F.col("query")).alias("by_query"), T.is_identifier_query(F.col("passage")).alias("by_passage"))


def duplicate_prompts(spark, sf):
    e = read_table(spark, sf, "embeddings")
    return R.cosine_topk(e, e.filter("vec_id % 100 = 0"), 0, "vec_id", "embedding", "vec_id", "embedding", 64, R.DUPLICATE).select("query_id", "id", "score")


def prompt_hash_dedup(spark, sf):
    d = documents(spark, sf).filter("text is not null").select(T.short_sha(F.col("text")).alias("id"), "doc_id", "text")
    return d.groupBy("id").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n"))


def hash_embedding(spark, sf):
    return V.hash_embedding(documents(spark, sf), "doc_id", F.col("text"))


def filtered_vector_topk(spark, sf):
    """Decision search, reference order: the global top 50 first, then only Markdown chunks remain."""
    v = _vectors(spark, sf)
    hits = R.cosine_topk(v, v.filter("chunk_no % 100 = 0"), 50, "chunk_no", "vec", "chunk_no", "vec", 64)
    md = chunks(spark, sf, "lang").filter("lang = 'markdown'").select(F.col("chunk_no").alias("id"))
    return hits.join(md, "id", "left_semi").select("query_id", F.col("id").alias("chunk_no"), "score", "rank")


def prefiltered_vector_topk(spark, sf):
    """Decision search the other way round: only Markdown chunks compete."""
    v = _vectors(spark, sf)
    md = v.join(chunks(spark, sf, "lang").filter("lang = 'markdown'").select("chunk_no"), "chunk_no", "left_semi")
    return R.cosine_topk(md, v.filter("chunk_no % 100 = 0"), 8, "chunk_no", "vec", "chunk_no", "vec", 64).select("query_id", F.col("id").alias("chunk_no"), "score", "rank")


def subset_bm25(spark, sf):
    """Decision search by text: BM25 with the statistics of the Markdown subset alone, no priors."""
    c = chunks(spark, sf, "header", "text", "lang").filter("lang = 'markdown'")
    q = read_table(spark, sf, GOLD)
    return R.top_k(R.bm25(c, q, "chunk_no", F.col("header"), F.col("text"), "item_id", "query"), 5).select("query_id", F.col("id").alias("chunk_no"), "score", "rank")


def _hash_vector_hits(spark, sf, k: int) -> DataFrame:
    """``query_id, id, score``: the chunks nearest to each golden query by the registered hash backend."""
    dim, embed = V.get_backend("hash")
    c = chunks(spark, sf, "header", "text")
    vecs = embed(c, "chunk_no", V.embed_text(F.col("header"), F.col("text")))
    q = embed(read_table(spark, sf, GOLD), "item_id", F.col("query"))
    return R.cosine_topk(vecs, q, k, "id", "vec", "id", "vec", dim).drop("rank")


def _queries(spark, sf):
    return read_table(spark, sf, GOLD).select(F.col("item_id").alias("query_id"), "query")


def hybrid_search(spark, sf):
    """The default mode: BM25 and vector lists of every golden query over all chunks, priors, fusion."""
    docs = chunks(spark, sf, "path", "lang", "header", "text").withColumnRenamed("chunk_no", "id")
    return R.search(docs, _queries(spark, sf), 8, "hybrid", _hash_vector_hits(spark, sf, R.fetch_size(8))).select("query_id", F.col("id").alias("chunk_no"), "score", "rank", "degraded")


def decision_search(spark, sf):
    c = chunks(spark, sf, "header", "text", "source").filter("source = 'decisions'").withColumnRenamed("chunk_no", "id")
    out = R.decision_search(c, _queries(spark, sf), 5, _hash_vector_hits(spark, sf, R.VECTOR_DEPTH))
    return out.select("query_id", F.col("id").alias("chunk_no"), "score", "rank")


def result_rows(spark, sf):
    c = chunks(spark, sf, "path", "line_start", "line_end", "symbol", "kind", "header", "source", "text").withColumnRenamed("chunk_no", "id")
    return R.result_rows(R.top_k(_bm25_chunks(spark, sf), 8), c).select("query_id", "rank", "span", "symbol", "kind", "source", "tokens")


def _prompts(spark, sf):
    """Documents as prompts: those of ids divisible by 100 are asked, all others are the history."""
    d = documents(spark, sf).filter("text is not null").select("doc_id", "text", T.short_sha(F.col("text")).alias("sha"))
    dim, embed = V.get_backend("hash")
    rows = embed(d, "doc_id", F.col("text")).join(d.select(F.col("doc_id").alias("id"), "sha"), "id").select("id", "sha", F.col("sha").alias("prompt"), F.lit("2026-01-01").alias("when"), "vec")
    return R.check_prompts(rows.filter("id % 100 <> 0").drop("id"), rows.filter("id % 100 = 0").drop("id"), dim)


def prompt_duplicates(spark, sf):
    return _prompts(spark, sf)[0].select("sha", F.col("earlier").alias("earlier_sha"), "cosine")


def prompt_append(spark, sf):
    return _prompts(spark, sf)[1].select("sha")


def symbol_find(spark, sf):
    s = read_table(spark, sf, "codebase_map").select("root", "path", F.explode("symbols").alias("s")).select(F.concat_ws("/", "root", "path").alias("path"), F.col("s.name").alias("name"), F.col("s.kind").alias("kind"), F.col("s.line_start").alias("line_start")).distinct()
    return R.find_symbol(s, "order", 50).select("path", "name", "line_start", "match")


def rank_priors(spark, sf):
    p = read_table(spark, sf, "codebase_map").select("path", "lang").distinct()
    return p.select("path", "lang", T.rank_prior(F.col("path"), F.col("lang")).alias("prior"))


def span_savings(spark, sf):
    """Tokens of the returned chunks against those of their whole files (by size), for every golden query."""
    cut = R.top_k(_bm25_chunks(spark, sf), 8)
    c = chunks(spark, sf, "path", "text").withColumnRenamed("chunk_no", "id").withColumn("text", F.coalesce("text", F.lit("")))
    sizes = read_table(spark, sf, "codebase_map").groupBy("path").agg(F.max("size").alias("s")).select("path", F.expr("greatest(1, s div 4)").alias("file_tokens"))
    return R.result_tokens(cut, c, sizes).select("query_id", "chunk_tokens", F.col("whole_file_tokens").cast("long").alias("whole_file_tokens"))


def stored_index_search(spark, sf):
    """Builds a stored index of the documents and answers the batch from it: the same results as from the documents themselves."""
    import uuid

    from tessera.operators.store import IndexStore
    from tessera.session import shared_dir

    d = documents(spark, sf).select(F.col("doc_id").alias("id"), F.concat(F.lit("doc/"), F.col("doc_id")).alias("path"), "lang", header().alias("header"), "text", T.short_sha(F.col("text")).alias("sha"))
    store = IndexStore(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    store.build(d, d.select("path", "sha", F.lit(0).alias("mtime")))
    q = read_table(spark, sf, GOLD).select(F.col("item_id").alias("query_id"), "query")
    return store.search(q, 8, priors=False).select("query_id", F.col("id").alias("doc_id"), "score", "rank")


QUERIES = {f.__name__: f for f in (
    tokenize_terms, term_frequency, doc_frequency_idf, doc_length_stats, bm25_topk, bm25_multi_query_topk, bm25_with_priors, cosine_topk, l2_normalize_check, rrf_fusion, rrf_identifier_boost,
    identifier_queries, duplicate_prompts, prompt_hash_dedup, hash_embedding, filtered_vector_topk, prefiltered_vector_topk, subset_bm25, stored_index_search, symbol_find, rank_priors, span_savings, hybrid_search, decision_search, result_rows, prompt_duplicates, prompt_append,
)}

_IDENT = lambda c: rf"""(regexp_matches({c}, '\b[a-z0-9]+_[a-z0-9_]+\b') OR regexp_matches({c}, '\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+\b') OR regexp_matches({c}, '["''][^"'']+["'']') OR regexp_matches({c}, '\b\w+\.\w+\(\)'))"""
_VEC = """v AS (SELECT chunk_no, max(vec) AS vec FROM chunk_vectors WHERE len(vec) = 64 GROUP BY 1),
u AS (SELECT chunk_no, list_transform(vec, lambda x: x::DOUBLE) AS x, sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])) AS r FROM v)"""
_COS = "round(CASE WHEN a.r > 0 AND b.r > 0 THEN list_dot_product(a.x, b.x) / a.r / b.r ELSE 0 END, 6) + 0.0"
_POST = postings_sql("documents", "doc_id", "concat_ws(' ', lang, source)", "text")
_CH = f"{ONCE}, " + postings_sql("k", "chunk_no", "coalesce(header, '')", "text") + ", " + bm25_sql("golden_items", "item_id", "query")
_RRF = f"""WITH {DOCS_BM25},
a AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 20),
d2 AS (SELECT id, b FROM d), tf2 AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(b) AS term FROM d2) GROUP BY 1, 2), dl2 AS (SELECT id, len(b) AS dl FROM d2), st2 AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl2), df2 AS (SELECT term, count(*)::DOUBLE AS df FROM tf2 GROUP BY 1),
qt2 AS (SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest({tok("passage")}) AS term FROM golden_items)),
sc2 AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM qt2 JOIN df2 USING (term) JOIN tf2 USING (term) JOIN dl2 USING (id) CROSS JOIN st2 GROUP BY 1, 2),
b AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc2 QUALIFY rank <= 20),
w AS (SELECT item_id AS query_id, CASE WHEN {{ident}} THEN 1.5 ELSE 1.0 END AS weight FROM golden_items),
f AS (SELECT query_id, id, round(sum(s), 9) AS score FROM (SELECT query_id, id, weight / (60 + rank) AS s FROM a JOIN w USING (query_id) UNION ALL SELECT query_id, id, 1.0 / (60 + rank) FROM b) GROUP BY 1, 2)
SELECT query_id, id AS doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f QUALIFY rank <= 8"""

_HASH = f"""hx AS (SELECT id, ('0x' || h[1:2])::INTEGER AS bucket, sum(CASE WHEN ('0x' || h[10:10])::INTEGER % 2 = 1 THEN -1.0 ELSE 1.0 END)::DOUBLE AS v FROM (SELECT id, md5(term) AS h FROM (SELECT chunk_no AS id, unnest({tok("(coalesce(header, '') || chr(10) || coalesce(text, ''))")}) AS term FROM k)) GROUP BY 1, 2),
hn AS (SELECT id, sqrt(sum(v * v)) AS r FROM hx GROUP BY 1 HAVING r > 0),
qx AS (SELECT id, ('0x' || h[1:2])::INTEGER AS bucket, sum(CASE WHEN ('0x' || h[10:10])::INTEGER % 2 = 1 THEN -1.0 ELSE 1.0 END)::DOUBLE AS v FROM (SELECT id, md5(term) AS h FROM (SELECT item_id AS id, unnest({tok("query")}) AS term FROM golden_items)) GROUP BY 1, 2),
qn AS (SELECT id, sqrt(sum(v * v)) AS r FROM qx GROUP BY 1 HAVING r > 0),
vs AS (SELECT q.id AS query_id, h.id AS id, round(sum(q.v * h.v) / any_value(qn.r * hn.r), 6) + 0.0 AS score FROM qx q JOIN hx h USING (bucket) JOIN qn ON qn.id = q.id JOIN hn ON hn.id = h.id GROUP BY 1, 2)"""
_HYBRID = f"""WITH {_CH}, {_HASH},
lc AS (SELECT query_id, id, score FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20), vc AS (SELECT query_id, id, score FROM vs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20),
lp AS (SELECT query_id, lc.id AS id, row_number() OVER (PARTITION BY query_id ORDER BY round(score * {PRIOR}, 7) DESC, lc.id) AS rank FROM lc JOIN k ON k.chunk_no = lc.id), vp AS (SELECT query_id, vc.id AS id, row_number() OVER (PARTITION BY query_id ORDER BY round(score * {PRIOR}, 7) DESC, vc.id) AS rank FROM vc JOIN k ON k.chunk_no = vc.id),
w AS (SELECT item_id AS query_id, CASE WHEN {_IDENT("query")} THEN 1.5 ELSE 1.0 END AS weight FROM golden_items),
f AS (SELECT query_id, id, round(sum(s), 9) AS score FROM (SELECT query_id, id, weight / (60 + rank) AS s FROM lp JOIN w USING (query_id) UNION ALL SELECT query_id, id, 1.0 / (60 + rank) FROM vp) GROUP BY 1, 2)
SELECT query_id, id AS chunk_no, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, false AS degraded FROM f QUALIFY rank <= 8"""
_DECISIONS = f"""WITH {ONCE}, """ + postings_sql("k", "chunk_no", "coalesce(header, '')", "text", "WHERE source = 'decisions'") + ", " + bm25_sql("golden_items", "item_id", "query") + f""", {_HASH},
lr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 5),
v50 AS (SELECT query_id, id, score FROM vs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 50),
vr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM v50 WHERE id IN (SELECT chunk_no FROM k WHERE source = 'decisions') QUALIFY rank <= 5),
f AS (SELECT query_id, id, round(sum(s), 9) AS score FROM (SELECT query_id, id, 1.0::DOUBLE / (60 + rank) AS s FROM lr UNION ALL SELECT query_id, id, 1.0::DOUBLE / (60 + rank) FROM vr) GROUP BY 1, 2)
SELECT query_id, id AS chunk_no, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f QUALIFY rank <= 5"""
_PROMPTS = f"""WITH d AS (SELECT doc_id, sha256(text)[1:12] AS sha, text FROM documents WHERE text IS NOT NULL),
e AS (SELECT sha, ('0x' || h[1:2])::INTEGER AS bucket, sum(CASE WHEN ('0x' || h[10:10])::INTEGER % 2 = 1 THEN -1.0 ELSE 1.0 END)::DOUBLE AS v FROM (SELECT sha, md5(term) AS h FROM (SELECT sha, unnest({tok("text")}) AS term FROM (SELECT sha, any_value(text) AS text FROM d GROUP BY 1))) GROUP BY 1, 2),
n AS (SELECT sha, sqrt(sum(v * v)) AS r FROM e GROUP BY 1 HAVING r > 0), q AS (SELECT DISTINCT sha FROM d WHERE doc_id % 100 = 0), hi AS (SELECT DISTINCT sha FROM d WHERE doc_id % 100 <> 0),
s AS (SELECT a.sha AS sha, b.sha AS earlier_sha, round(sum(a.v * b.v) / any_value(na.r * nb.r), 6) AS c FROM e a JOIN e b USING (bucket) JOIN n na ON na.sha = a.sha JOIN n nb ON nb.sha = b.sha WHERE a.sha IN (SELECT sha FROM q) AND b.sha IN (SELECT sha FROM hi) GROUP BY 1, 2)"""

ORACLES = {
    "hybrid_search": _HYBRID,
    "decision_search": _DECISIONS,
    "result_rows": f"""WITH {_CH}, c AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 8)
SELECT query_id, rank, path || ':L' || line_start || CASE WHEN line_start = line_end THEN '' ELSE '-L' || line_end END AS span, symbol, kind, source, greatest(1, length(coalesce(text, '')) // 4) AS tokens FROM c JOIN k ON k.chunk_no = c.id""",
    "prompt_duplicates": f"{_PROMPTS} SELECT sha, earlier_sha, round(c, 3) AS cosine FROM s WHERE c > 0.9",
    "prompt_append": "SELECT DISTINCT sha256(text)[1:12] AS sha FROM documents WHERE text IS NOT NULL AND doc_id % 100 = 0 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE text IS NOT NULL AND doc_id % 100 <> 0)",
    "tokenize_terms": f"SELECT term, count(*) AS n FROM (SELECT unnest({tok('text')}) AS term FROM documents) GROUP BY term",
    "term_frequency": f"WITH {_POST} SELECT id AS doc_id, term, tf FROM tf",
    "doc_frequency_idf": f"WITH {_POST} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df CROSS JOIN st",
    "doc_length_stats": f"WITH {_POST} SELECT count(*) AS n, cast(sum(dl) AS BIGINT) AS total, round(avg(dl), 6) AS avgdl FROM dl",
    "bm25_topk": "WITH " + _POST + ", one AS (SELECT 1 AS item_id, 'where does the retry handler load the config' AS query), " + bm25_sql("one", "item_id", "query") + """,
r AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 10) SELECT rank, id AS doc_id, score, lang, source FROM r JOIN documents ON doc_id = id""",
    "bm25_multi_query_topk": f"WITH {DOCS_BM25} SELECT query_id, id AS doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 8",
    "stored_index_search": f"WITH {DOCS_BM25} SELECT query_id, id AS doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 8",
    "bm25_with_priors": f"""WITH {_CH},
c AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 20),
p AS (SELECT query_id, chunk_no, round(score * {PRIOR}, 7) AS score FROM c JOIN k ON k.chunk_no = c.id)
SELECT query_id, chunk_no, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_no) AS rank FROM p QUALIFY rank <= 8""",
    "cosine_topk": f"WITH {_VEC}, s AS (SELECT a.chunk_no AS query_id, b.chunk_no, {_COS} AS score FROM u a CROSS JOIN u b WHERE a.chunk_no % 100 = 0) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_no) AS rank FROM s QUALIFY rank <= 8",
    "l2_normalize_check": "SELECT vec_id, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS length, round(n, 4) AS norm FROM (SELECT vec_id, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)",
    "rrf_fusion": _RRF.replace("{ident}", "false"),
    "rrf_identifier_boost": _RRF.replace("{ident}", _IDENT("passage")),
    "identifier_queries": f"SELECT item_id, {_IDENT('query')} AS by_query, {_IDENT('passage')} AS by_passage FROM golden_items",
    "duplicate_prompts": """WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS x, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS r FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(CASE WHEN a.r > 0 AND b.r > 0 THEN list_dot_product(a.x, b.x) / a.r / b.r ELSE 0 END, 6) AS score FROM u a CROSS JOIN u b WHERE a.vec_id % 100 = 0) SELECT * FROM s WHERE score > 0.9""",
    "prompt_hash_dedup": "SELECT sha256(text)[1:12] AS id, min(doc_id) AS first_doc, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "hash_embedding": f"""WITH t AS (SELECT doc_id, md5(term) AS h FROM (SELECT doc_id, unnest({tok('text')}) AS term FROM documents))
SELECT doc_id, ('0x' || h[1:2])::INTEGER AS bucket, sum(CASE WHEN ('0x' || h[10:10])::INTEGER % 2 = 1 THEN -1.0 ELSE 1.0 END)::DOUBLE AS value FROM t GROUP BY 1, 2 HAVING value <> 0""",
    "filtered_vector_topk": f"""WITH {ONCE}, {_VEC}, s AS (SELECT a.chunk_no AS query_id, b.chunk_no, {_COS} AS score FROM u a CROSS JOIN u b WHERE a.chunk_no % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_no) AS rank FROM s QUALIFY rank <= 50)
SELECT r.* FROM r JOIN k USING (chunk_no) WHERE k.lang = 'markdown'""",
    "prefiltered_vector_topk": f"""WITH {ONCE}, {_VEC}, s AS (SELECT a.chunk_no AS query_id, b.chunk_no, {_COS} AS score FROM u a CROSS JOIN (SELECT u.* FROM u JOIN k USING (chunk_no) WHERE lang = 'markdown') b WHERE a.chunk_no % 100 = 0)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_no) AS rank FROM s QUALIFY rank <= 8""",
    "subset_bm25": f"WITH {ONCE}, " + postings_sql("k", "chunk_no", "coalesce(header, '')", "text", "WHERE lang = 'markdown'") + ", " + bm25_sql("golden_items", "item_id", "query") + " SELECT query_id, id AS chunk_no, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 5",
    "symbol_find": """WITH s AS (SELECT DISTINCT root || '/' || path AS path, s.name AS name, s.kind AS kind, s.line_start AS line_start FROM (SELECT root, path, unnest(symbols) AS s FROM codebase_map)),
c AS (SELECT *, CASE WHEN lower(name) = 'order' OR string_split(lower(name), '.')[-1] = 'order' THEN 0 WHEN contains(lower(name), 'order') THEN 1 END AS cls FROM s)
SELECT path, name, line_start, CASE WHEN cls = 0 THEN 'exact' ELSE 'partial' END AS match FROM c WHERE cls = (SELECT min(cls) FROM c) ORDER BY path, line_start, name LIMIT 50""",
    "rank_priors": f"SELECT DISTINCT path, lang, cast({PRIOR} AS DOUBLE) AS prior FROM codebase_map",
    "span_savings": f"""WITH {_CH},
c AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 8), j AS (SELECT query_id, path, greatest(1, length(coalesce(text, '')) // 4) AS tokens FROM c JOIN k ON k.chunk_no = c.id),
s AS (SELECT query_id, cast(sum(tokens) AS BIGINT) AS chunk_tokens FROM j GROUP BY 1), m AS (SELECT path, greatest(1, max(size) // 4) AS file_tokens FROM codebase_map GROUP BY 1),
w AS (SELECT query_id, cast(sum(file_tokens) AS BIGINT) AS whole_file_tokens FROM (SELECT DISTINCT query_id, path FROM j) JOIN m USING (path) GROUP BY 1) SELECT * FROM s LEFT JOIN w USING (query_id)""",
}
