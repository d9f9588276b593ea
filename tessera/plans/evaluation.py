"""Evaluation and A/B queries. Orders stand for A/B rows: the priority is the stratum, the status the arm, lineitem sums are token counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import estimate_tokens
from tessera.operators import abtest, evaluation
from tessera.operators import retrieval as R
from tessera.plans.common import ONCE, bm25_sql, chunks, postings_sql
from tessera.plans.retrieval import ORACLES as ORACLES_RETRIEVAL
from tessera.plans.retrieval import hybrid_search, span_savings
from tessera.session import read_table


def _judged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    g = read_table(spark, sf, "golden_items").select(F.col("item_id").alias("query_id"), F.col("query_type").alias("type"), "relevant", "query")
    c = chunks(spark, sf, "header", "text", "path", "symbol")
    top = R.top_k(R.bm25(c, g, "chunk_no", F.col("header"), F.col("text"), "query_id", "query"), evaluation.K)
    meta = c.select(F.col("chunk_no").alias("id"), "path", "symbol", estimate_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    return evaluation.relevant(top.join(meta, "id"), g), g


def query_scores(spark, sf):
    s = evaluation.score_queries(*_judged(spark, sf))
    return s.withColumn("mrr", F.round("mrr", 6))


def hit_at_k_mrr(spark, sf):
    a = evaluation.aggregate(evaluation.score_queries(*_judged(spark, sf)))
    return a.select("n", *[F.round(c, 6).alias(c) for c in ("hit1", "hit5", "mrr")])


def tokens_to_task(spark, sf):
    return evaluation.aggregate(evaluation.score_queries(*_judged(spark, sf))).select("tokens_to_task", "ctx_tokens_5")


def hit5_by_type(spark, sf):
    s = evaluation.score_queries(*_judged(spark, sf))
    p = s.groupBy().pivot("type", ["conceptual", "cross-file", "identifier"]).agg(F.avg(F.col("hit5").cast("double")))
    return p.select(*[F.round(c, 6).alias(c.replace("-", "_")) for c in p.columns])


def quality_gate(spark, sf):
    return evaluation.gate(evaluation.aggregate(evaluation.score_queries(*_judged(spark, sf)))).select(F.round("hit5", 6).alias("hit5"), "passed")


def latency_p50_p95(spark, sf):
    e = read_table(spark, sf, "events").select("event_type", F.round("value", 2).alias("ms"))
    return evaluation.positional_distributed(e, "event_type", "ms")


def _rows(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("item"), F.when(F.col("o_orderkey") % 2 == 0, "baseline").otherwise("treatment").alias("arm"), F.when(F.col("o_orderstatus") == "P", "failed").alias("error"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("cost"))
    q = read_table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").cast("long").alias("tokens"))
    resolved = (F.col("o_orderkey") % 3 == 0).cast("int").alias("resolved")
    return o.join(q, "o_orderkey").select("item", "arm", "error", "seq", "cost", "tokens", resolved)


def _pairs(spark, sf):
    return abtest.pair_arms(_rows(spark, sf), "item", "arm", ["tokens", "cost", "resolved"], "baseline", "treatment")


def paired_join(spark, sf):
    return _pairs(spark, sf).filter("complete").select("item", "tokens_a", "tokens_b", F.round("cost_a", 2).alias("cost_a"), F.round("cost_b", 2).alias("cost_b"))


def dropped_pairs(spark, sf):
    return _pairs(spark, sf).filter("not complete").select("item")


def token_reduction(spark, sf):
    return abtest.summary(_pairs(spark, sf)).select("n", "tokens_a", "tokens_b", F.round("reduction", 6).alias("reduction"))


def cost_per_resolved(spark, sf):
    return abtest.summary(_pairs(spark, sf)).select("resolved_a", "resolved_b", F.round("cost_per_resolved_a", 2).alias("cost_per_resolved_a"), F.round("cost_per_resolved_b", 2).alias("cost_per_resolved_b"))


def stratified_quota(spark, sf):
    return abtest.quotas(read_table(spark, sf, "orders"), "o_orderpriority", 75).select("o_orderpriority", "size", "quota")


def stratified_sample(spark, sf):
    return abtest.stratified_sample(read_table(spark, sf, "orders"), "o_orderkey", "o_orderpriority", 75)


def bootstrap_interval(spark, sf):
    p = _pairs(spark, sf).filter("complete").select("item", (F.col("tokens_a") - F.col("tokens_b")).alias("d"))
    return abtest.bootstrap_distributed(p, "d", "item")


def pairs_with_verdicts(spark, sf):
    """Complete pairs with both arms' verdicts: an item is resolved in an arm if some order of it there is urgent."""
    o = read_table(spark, sf, "orders").select(F.col("o_custkey").alias("item"), "o_orderkey", (F.col("o_orderpriority") == "1-URGENT").alias("resolved"))
    p = _pairs(spark, sf).filter("complete").drop("resolved_a", "resolved_b")
    return abtest.with_verdicts(p, o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1"), "item").select("item", "resolved_a", "resolved_b")


def runs_to_do(spark, sf):
    done = _rows(spark, sf).filter("error is null").select(F.col("item").alias("c_custkey"), "arm")
    return abtest.runs_to_do(read_table(spark, sf, "customer"), "c_custkey", ["baseline", "treatment"], done)


def sample_by_language(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", F.coalesce("lang", F.lit("unknown")).alias("language"))
    return abtest.stratified_sample(d, "doc_id", "language", 40, only=["en", "de", "fr"])


def eval_by_mode(spark, sf):
    """Golden queries in two modes over chunks without vectors: hybrid falls back to lexical and counts as degraded."""
    j, g = _judged(spark, sf)
    both = evaluation.by_mode(evaluation.score_queries(j, g), ["lexical", "hybrid"]).withColumn("degraded", F.col("mode") == "hybrid")
    return evaluation.aggregate(both, ["mode"]).select("mode", "n", F.round("hit5", 6).alias("hit5"), F.round("mrr", 6).alias("mrr"), "degraded")


def not_yet_done(spark, sf):
    """The anti join by which a resumed run finds what is left: customers without an order that didn't fail."""
    done = read_table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return read_table(spark, sf, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


def probe_benchmark(spark, sf):
    """Totals of a batch of questions: spans against whole files, their ratio and the dollars saved at the default input price."""
    from tessera.functions.usage import DEFAULT_PRICE

    s = span_savings(spark, sf).agg(F.count(F.lit(1)).alias("questions"), F.sum("chunk_tokens").alias("spans"), F.sum("whole_file_tokens").alias("whole_files"))
    saved = (F.col("whole_files") - F.col("spans")) / 1e6 * DEFAULT_PRICE[0]
    return s.select("*", F.round(F.try_divide(F.col("whole_files").cast("double"), F.col("spans").cast("double")), 4).alias("ratio"), F.round(saved, 6).alias("saved"))


def judge_context_rows(spark, sf):
    """The best five results of every golden query in both modes, as a judge gets them."""
    g = read_table(spark, sf, "golden_items").select(F.col("item_id").alias("query_id"), "query", "relevant")
    c = chunks(spark, sf, "header", "text", "path", "symbol")
    lex = R.top_k(R.bm25(c, g, "chunk_no", F.col("header"), F.col("text"), "query_id", "query"), 5).select("query_id", "id", "rank", F.lit("lexical").alias("mode"))
    both = hybrid_search(spark, sf).filter("rank <= 5").select("query_id", F.col("chunk_no").alias("id"), "rank", F.lit("hybrid").alias("mode"))
    r = lex.unionByName(both).join(c.select(F.col("chunk_no").alias("id"), "path", "symbol", "text"), "id")
    return evaluation.judge_rows(r, g).select("query_id", "mode", F.md5("context").alias("context"), "reference")


def golden_by_repo(spark, sf):
    """Golden items whose repository is in the map, and those that are skipped."""
    roots = read_table(spark, sf, "codebase_map").select(F.col("root").alias("repo")).distinct().withColumn("there", F.lit(True))
    return read_table(spark, sf, "golden_items").join(roots, "repo", "left").groupBy(F.coalesce("there", F.lit(False)).alias("available")).agg(F.count(F.lit(1)).alias("items"))


QUERIES = {f.__name__: f for f in (
    query_scores, hit_at_k_mrr, tokens_to_task, hit5_by_type, quality_gate, latency_p50_p95, paired_join, dropped_pairs, token_reduction, cost_per_resolved, stratified_quota, stratified_sample, sample_by_language, bootstrap_interval, pairs_with_verdicts, runs_to_do, eval_by_mode, not_yet_done, probe_benchmark, judge_context_rows, golden_by_repo,
)}

_S = f"""WITH {ONCE}, {postings_sql("k", "chunk_no", "coalesce(header, '')", "text")}, {bm25_sql("golden_items", "item_id", "query")},
top AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 10),
j AS (SELECT query_id, rank, path, symbol, greatest(1, length(coalesce(text, '')) // 4) AS tokens FROM top JOIN k ON k.chunk_no = top.id),
sp AS (SELECT query_id, s.path AS path, s.symbols AS symbols FROM (SELECT item_id AS query_id, unnest(relevant) AS s FROM golden_items)),
h AS (SELECT DISTINCT query_id, rank FROM j JOIN sp USING (query_id, path) WHERE coalesce(len(symbols), 0) = 0 OR len(list_filter(symbols, lambda x: contains(lower(symbol), lower(x)))) > 0),
r AS (SELECT query_id, rank, tokens, h.rank IS NOT NULL AS rel, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS upto FROM j LEFT JOIN h USING (query_id, rank)),
p AS (SELECT query_id, min(CASE WHEN rel THEN rank END) AS first_rank, cast(min_by(upto, rank) FILTER (WHERE rel) AS BIGINT) AS tokens_to_task, cast(sum(CASE WHEN rank <= 5 THEN tokens ELSE 0 END) AS BIGINT) AS ctx_tokens_5 FROM r GROUP BY 1),
q AS (SELECT item_id AS query_id, query_type AS type, first_rank, coalesce(first_rank = 1, false) AS hit1, coalesce(first_rank <= 5, false) AS hit5, coalesce(1.0::DOUBLE / first_rank, 0) AS mrr, tokens_to_task, coalesce(ctx_tokens_5, 0) AS ctx_tokens_5 FROM golden_items LEFT JOIN p ON p.query_id = item_id)"""
_A = """WITH w AS (SELECT o_orderkey, o_custkey AS item, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS arm, o_orderstatus = 'P' AS bad, o_totalprice AS cost, tokens, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS resolved
FROM orders JOIN (SELECT l_orderkey AS o_orderkey, cast(sum(l_quantity) AS BIGINT) AS tokens FROM lineitem GROUP BY 1) USING (o_orderkey)),
l AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY item, arm ORDER BY o_orderkey DESC) = 1), p AS (SELECT coalesce(a.item, b.item) AS item, a.tokens AS tokens_a, b.tokens AS tokens_b, a.cost AS cost_a, b.cost AS cost_b, a.resolved AS resolved_a, b.resolved AS resolved_b, coalesce(NOT a.bad AND NOT b.bad, false) AS complete
FROM (SELECT * FROM l WHERE arm = 'a') a FULL JOIN (SELECT * FROM l WHERE arm = 'b') b ON a.item = b.item)"""
_Q = "qs AS (SELECT o_orderpriority, count(*) AS size, greatest(1, round_even(75.0 * count(*) / (SELECT count(*) FROM orders), 0)::BIGINT) AS quota FROM orders GROUP BY 1)"

_SPANS = f"""WITH {ONCE}, {postings_sql("k", "chunk_no", "coalesce(header, '')", "text")}, {bm25_sql("golden_items", "item_id", "query")}"""

_CDF = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253]

ORACLES = {
    "pairs_with_verdicts": f"""{_A}, o AS (SELECT o_custkey AS item, o_orderkey % 2 = 0 AS first, bool_or(o_orderpriority = '1-URGENT') AS r FROM orders GROUP BY 1, 2)
SELECT p.item, coalesce(a.r, false) AS resolved_a, coalesce(b.r, false) AS resolved_b FROM p LEFT JOIN o a ON a.item = p.item AND a.first LEFT JOIN o b ON b.item = p.item AND NOT b.first WHERE complete""",
    "runs_to_do": f"{_A}, d AS (SELECT DISTINCT item, CASE WHEN arm = 'a' THEN 'baseline' ELSE 'treatment' END AS arm FROM w WHERE NOT bad) SELECT c_custkey, x.arm FROM customer CROSS JOIN (VALUES ('baseline'), ('treatment')) AS x(arm) WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.item = c_custkey AND d.arm = x.arm)",
    "sample_by_language": """WITH l AS (SELECT doc_id, coalesce(lang, 'unknown') AS language FROM documents), f AS (SELECT *, md5('7:' || doc_id) AS h FROM l WHERE language IN ('en', 'de', 'fr')),
q AS (SELECT language, greatest(1, round_even(40.0 * count(*) / (SELECT count(*) FROM f), 0)::BIGINT) AS quota FROM f GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY h, doc_id) AS r FROM f)
SELECT doc_id, language FROM r JOIN q USING (language) ORDER BY CASE WHEN r > quota THEN 1 ELSE 0 END, h, doc_id LIMIT 40""",
    "eval_by_mode": f"{_S} SELECT m.mode AS mode, count(*) AS n, round(avg(hit5::INTEGER), 6) AS hit5, round(avg(mrr), 6) AS mrr, cast(sum(CASE WHEN m.mode = 'hybrid' THEN 1 ELSE 0 END) AS BIGINT) AS degraded FROM q CROSS JOIN (VALUES ('lexical'), ('hybrid')) AS m(mode) GROUP BY 1",
    "bootstrap_interval": f"""{_A}, v AS (SELECT item, tokens_a - tokens_b AS d FROM p WHERE complete), e AS (SELECT r, d, ('0x' || md5('7:' || r || ':' || item)[1:8])::BIGINT / 4294967296.0::DOUBLE AS u FROM v CROSS JOIN range(2000) t(r)),
w2 AS (SELECT r, d, {" + ".join(f"CASE WHEN u > {c!r}::DOUBLE THEN 1 ELSE 0 END" for c in _CDF)} AS k FROM e), m AS (SELECT list_sort(list(m)) AS m FROM (SELECT r, sum(k * d)::DOUBLE / sum(k)::DOUBLE AS m FROM w2 GROUP BY 1))
SELECT m[floor(len(m) * 0.025::DOUBLE)::BIGINT + 1] AS low, m[floor(len(m) * 0.975::DOUBLE)::BIGINT + 1] AS high FROM m""",
    "probe_benchmark": f"""{_SPANS}, c AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 8), j AS (SELECT query_id, path, greatest(1, length(coalesce(text, '')) // 4) AS tokens FROM c JOIN k ON k.chunk_no = c.id),
s AS (SELECT query_id, cast(sum(tokens) AS BIGINT) AS a FROM j GROUP BY 1), m AS (SELECT path, greatest(1, max(size) // 4) AS file_tokens FROM codebase_map GROUP BY 1), w AS (SELECT query_id, cast(sum(file_tokens) AS BIGINT) AS b FROM (SELECT DISTINCT query_id, path FROM j) JOIN m USING (path) GROUP BY 1)
SELECT count(*) AS questions, cast(sum(a) AS BIGINT) AS spans, cast(sum(b) AS BIGINT) AS whole_files, round(sum(b)::DOUBLE / sum(a)::DOUBLE, 4) AS ratio, round((sum(b) - sum(a))::DOUBLE / 1e6 * 5, 6) AS saved FROM s LEFT JOIN w USING (query_id)""",
    "judge_context_rows": f"""WITH lex AS ({_SPANS} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, 'lexical' AS mode FROM sc QUALIFY rank <= 5), hyb AS (SELECT query_id, chunk_no AS id, rank, 'hybrid' AS mode FROM ({ORACLES_RETRIEVAL["hybrid_search"]}) WHERE rank <= 5),
c AS (SELECT * FROM lex UNION ALL SELECT * FROM hyb), {ONCE}
SELECT query_id, mode, md5(string_agg('--- ' || path || ' (' || symbol || ') ---' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY rank)) AS context,
any_value(array_to_string(list_transform(relevant, lambda s: s.path || CASE WHEN coalesce(len(s.symbols), 0) > 0 THEN ' (' || array_to_string(s.symbols, ', ') || ')' ELSE '' END), '; ')) AS reference FROM c JOIN k ON k.chunk_no = c.id JOIN golden_items ON item_id = query_id GROUP BY query_id, mode""",
    "golden_by_repo": "SELECT repo IS NOT NULL AND repo IN (SELECT root FROM codebase_map WHERE root IS NOT NULL) AS available, count(*) AS items FROM golden_items GROUP BY 1",
    "query_scores": f"{_S} SELECT query_id, type, first_rank, hit1, hit5, round(mrr, 6) AS mrr, tokens_to_task, ctx_tokens_5 FROM q",
    "hit_at_k_mrr": f"{_S} SELECT count(*) AS n, round(avg(hit1::INTEGER), 6) AS hit1, round(avg(hit5::INTEGER), 6) AS hit5, round(avg(mrr), 6) AS mrr FROM q",
    "tokens_to_task": f"{_S} SELECT round_even(avg(tokens_to_task), 0)::BIGINT AS tokens_to_task, round_even(avg(ctx_tokens_5), 0)::BIGINT AS ctx_tokens_5 FROM q",
    "hit5_by_type": f"{_S} SELECT round(avg(CASE WHEN type = 'conceptual' THEN hit5::INTEGER END), 6) AS conceptual, round(avg(CASE WHEN type = 'cross-file' THEN hit5::INTEGER END), 6) AS cross_file, round(avg(CASE WHEN type = 'identifier' THEN hit5::INTEGER END), 6) AS identifier FROM q",
    "quality_gate": f"{_S} SELECT round(avg(hit5::INTEGER), 6) AS hit5, avg(hit5::INTEGER) >= 0.8 AS passed FROM q",
    "latency_p50_p95": "WITH l AS (SELECT event_type, list_sort(list(round(value, 2))) AS v FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT event_type, v[len(v) // 2 + 1] AS p50, v[least(len(v) - 1, floor(len(v) * 0.95::DOUBLE)::BIGINT) + 1] AS p95 FROM l",
    "paired_join": f"{_A} SELECT item, tokens_a, tokens_b, round(cost_a, 2) AS cost_a, round(cost_b, 2) AS cost_b FROM p WHERE complete",
    "dropped_pairs": f"{_A} SELECT item FROM p WHERE NOT complete",
    "token_reduction": f"{_A} SELECT count(*) AS n, cast(sum(tokens_a) AS BIGINT) AS tokens_a, cast(sum(tokens_b) AS BIGINT) AS tokens_b, round(1 - sum(tokens_b)::DOUBLE / sum(tokens_a)::DOUBLE, 6) AS reduction FROM p WHERE complete",
    "cost_per_resolved": f"{_A} SELECT cast(sum(resolved_a) AS BIGINT) AS resolved_a, cast(sum(resolved_b) AS BIGINT) AS resolved_b, round(sum(cost_a) / sum(resolved_a), 2) AS cost_per_resolved_a, round(sum(cost_b) / sum(resolved_b), 2) AS cost_per_resolved_b FROM p WHERE complete",
    "stratified_quota": f"WITH {_Q} SELECT * FROM qs",
    "stratified_sample": f"WITH {_Q}, h AS (SELECT o_orderkey, o_orderpriority, md5('7:' || o_orderkey) AS h FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY h, o_orderkey) AS r FROM h) SELECT o_orderkey, o_orderpriority FROM r JOIN qs USING (o_orderpriority) ORDER BY CASE WHEN r > quota THEN 1 ELSE 0 END, h, o_orderkey LIMIT 75",
    "not_yet_done": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'P')",
}
