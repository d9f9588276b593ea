"""Queries of this subpackage over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, codefiles, conversations, distinctive, leakage, neardup, neighbours, reading, splitting
from tessera.session import read_spread, read_table


def p1_labels(spark: SparkSession, sf: str) -> DataFrame:
    return codefiles.label_files(read_table(spark, sf, "codebase_map"), read_table(spark, sf, "chunks"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return codefiles.not_handwritten(p1_labels(spark, sf))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    turns, opened = read_table(spark, sf, "turns"), read_table(spark, sf, "chat_sessions")
    return conversations.sessions(conversations.links(turns), opened, turns).filter("reason is not null").select("session_id")


def p2_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.conversations(read_table(spark, sf, "turns"), read_table(spark, sf, "chat_sessions"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.found_pairs(read_spread(spark, sf, "chunks"))


def p3_groups(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.groups(read_spread(spark, sf, "chunks"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.pieces(read_table(spark, sf, "chunks")).select("chunk_no").distinct()


def p5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.pieces(read_table(spark, sf, "chunks"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return distinctive.weights(read_table(spark, sf, "chunks"), min_count=3, max_chunks=5).select("chunk_no", "term")


def p6_weights(spark: SparkSession, sf: str) -> DataFrame:
    return distinctive.weights(read_table(spark, sf, "chunks"))


def p7_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.knn(read_table(spark, sf, "chunk_vectors"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.close_pairs(p7_neighbours(spark, sf))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode(read_spread(spark, sf, "documents"))


def p9_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(read_spread(spark, sf, "documents"), read_table(spark, sf, "golden_items"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    found = leakage.leaks(read_spread(spark, sf, "documents"), read_table(spark, sf, "golden_items"), passages=False)
    return found.filter("distance = 0").select("doc_id", "item_id")


def p10_levels(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_spread(spark, sf, "documents")
    return reading.levels(docs, reading.fit(docs, read_table(spark, sf, "reading_labels")))


def p10_heldout(spark: SparkSession, sf: str) -> DataFrame:
    return reading.heldout_error(read_spread(spark, sf, "documents"), read_table(spark, sf, "reading_labels"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return reading.demanding(p10_levels(spark, sf))


QUERIES = {f.__name__: f for f in (p1_found, p1_labels, p2_found, p2_conversations, p3_found, p3_groups, p5_found, p5_pieces, p6_found, p6_weights, p7_found, p7_neighbours, p8_ids, p9_found, p9_leaks, p10_found, p10_levels, p10_heldout)}

_CHUNKS_ONCE = "c AS (SELECT chunk_no, any_value(root) AS root, any_value(path) AS path, any_value(header) AS header, any_value(text) AS text FROM chunks GROUP BY chunk_no)"

_TERMS = f"""{_CHUNKS_ONCE},
w AS (SELECT chunk_no, unnest(regexp_extract_all(lower(regexp_replace(concat_ws(chr(10), header, text), '([a-z])([A-Z])', '\\1 \\2', 'g')), '[a-z]{{4,}}')) AS term FROM c),
tf AS (SELECT chunk_no, term, count(*) AS n FROM w GROUP BY ALL),
st AS (SELECT term, count(*) AS n_chunks, cast(sum(n) AS BIGINT) AS n_all FROM tf GROUP BY term),
sz AS (SELECT chunk_no, cast(sum(n) AS BIGINT) AS size FROM tf GROUP BY chunk_no),
tt AS (SELECT cast(sum(n) AS BIGINT) AS total FROM tf)"""

ORACLES = {
    "p2_found": r"""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY session_id, uuid ORDER BY received_at DESC, coalesce(ts, '') DESC, coalesce(kind, '') DESC) AS rn FROM turns WHERE session_id IS NOT NULL),
k AS (SELECT session_id, uuid, lower(trim(kind)) AS kind, trim(ts) AS ts, received_at FROM l WHERE rn = 1 AND lower(trim(kind)) IN ('user', 'assistant')
      AND (regexp_matches(coalesce(text, ''), '\S') OR coalesce(len(tool_calls), 0) > 0 OR coalesce(len(tool_results), 0) > 0)),
t AS (SELECT *, CASE WHEN regexp_matches(ts, '^\d{9,11}$') THEN try_cast(ts AS BIGINT) * 1000000 WHEN regexp_matches(ts, '^\d{12,14}$') THEN try_cast(ts AS BIGINT) * 1000
      WHEN regexp_matches(ts, '^\d{4}-\d{2}-\d{2}[T ][\d:.]+$') THEN epoch_us(try_cast(ts AS TIMESTAMP)) WHEN regexp_matches(ts, '^\d{4}-') THEN epoch_us(try_cast(ts AS TIMESTAMPTZ)) END AS us FROM k),
o AS (SELECT *, lag(kind) OVER w AS prev, row_number() OVER w AS p, count(*) OVER (PARTITION BY session_id) AS n FROM t WINDOW w AS (PARTITION BY session_id ORDER BY us NULLS FIRST, received_at, uuid)),
g AS (SELECT session_id, bool_or(us IS NULL) OR bool_or(p = 1 AND kind <> 'user') OR bool_or(p = n AND kind <> 'assistant') OR coalesce(bool_or(kind = 'user' AND prev = 'user'), false) AS bad FROM o GROUP BY 1),
s AS (SELECT session_id FROM chat_sessions WHERE session_id IS NOT NULL UNION SELECT session_id FROM turns WHERE session_id IS NOT NULL)
SELECT s.session_id FROM s LEFT JOIN g USING (session_id) WHERE coalesce(bad, true)""",
    "p3_found": f"""
WITH {_CHUNKS_ONCE},
w AS (SELECT chunk_no, root, path, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM c WHERE text IS NOT NULL),
s AS (SELECT DISTINCT chunk_no, root, path, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS x FROM w WHERE len(w) >= 3),
n AS (SELECT chunk_no, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.chunk_no AS chunk_a, b.chunk_no AS chunk_b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.chunk_no < b.chunk_no AND (a.root IS DISTINCT FROM b.root OR a.path IS DISTINCT FROM b.path) GROUP BY 1, 2)
SELECT chunk_a, chunk_b FROM p JOIN n na ON na.chunk_no = chunk_a JOIN n nb ON nb.chunk_no = chunk_b WHERE k / (na.n + nb.n - k) >= 0.7 - 1e-12""",
    "p5_found": "SELECT DISTINCT chunk_no FROM chunks WHERE length(text) > 2048",
    "p6_found": f"WITH {_TERMS} SELECT chunk_no, term FROM tf JOIN st USING (term) WHERE n >= 3 AND n_chunks <= 5",
    "p7_found": """
WITH u AS (SELECT chunk_no, any_value(vec)::DOUBLE[] AS v FROM chunk_vectors WHERE len(vec) = 64 GROUP BY 1),
n AS (SELECT chunk_no, v, sqrt(list_dot_product(v, v)) AS r FROM u WHERE list_dot_product(v, v) > 0),
p AS (SELECT a.chunk_no AS x, b.chunk_no AS y, list_dot_product(a.v, b.v) / (a.r * b.r) AS s FROM n a JOIN n b ON a.chunk_no <> b.chunk_no),
k AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY round(s, 12) DESC, y) AS rank FROM p)
SELECT DISTINCT least(x, y) AS chunk_a, greatest(x, y) AS chunk_b FROM k WHERE rank <= 5 AND s >= 0.9""",
    "p9_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS w FROM golden_items WHERE passage IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 8), lambda k: array_to_string(w[k:k + 9], ' '))) AS g FROM d WHERE len(w) >= 10),
ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 8), lambda k: array_to_string(w[k:k + 9], ' '))) AS g FROM i WHERE len(w) >= 10)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    "p10_found": r"""
WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|\n|\r')) AS line, generate_subscripts(regexp_split_to_array(text, '\r\n|\n|\r'), 1) AS k FROM documents WHERE text IS NOT NULL),
f AS (SELECT *, starts_with(line, '```') AS fence, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS nf FROM l),
p AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY k) AS t FROM f WHERE NOT fence AND nf % 2 = 0 AND NOT regexp_matches(line, '^([#|\-*>\t]|    )') GROUP BY 1),
m AS (SELECT doc_id, regexp_extract_all(t, '\p{L}+') AS w, regexp_split_to_array(regexp_replace(t, '[.!?](\s|$)', chr(1) || '\1', 'g'), chr(1)) AS s FROM p),
n AS (SELECT doc_id, len(w) AS words, len(list_filter(s, lambda x: regexp_matches(x, '\p{L}'))) AS sents, list_sum(list_transform(w, lambda x: length(x))) AS letters FROM m WHERE len(w) >= 40)
SELECT doc_id FROM n WHERE sents > 0 AND words / sents >= 22 AND letters / words >= 5.9""",
    "p6_weights": f"""
WITH {_TERMS},
j AS (SELECT chunk_no, term, n, n_chunks, n_all, n::DOUBLE AS a, (n_all - n)::DOUBLE AS b, (size - n)::DOUBLE AS c, (total - size - (n_all - n))::DOUBLE AS d FROM tf JOIN st USING (term) JOIN sz USING (chunk_no) CROSS JOIN tt)
SELECT chunk_no, term, n, n_chunks, n_all, round((CASE WHEN a * (b + d) >= b * (a + c) THEN 1 ELSE -1 END) * greatest(0, 2 * (
  {" + ".join(f"CASE WHEN {x} > 0 THEN ({x}) * ln({x}) ELSE 0 END" for x in ("a", "b", "c", "d"))}
  - {" - ".join(f"CASE WHEN {x} > 0 THEN ({x}) * ln({x}) ELSE 0 END" for x in ("a + b", "c + d", "a + c", "b + d"))}
  + (a + b + c + d) * ln(a + b + c + d))), 4) + 0.0 AS llr FROM j""",
}
