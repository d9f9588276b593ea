"""What the query modules share: tables, and SQL fragments for their counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import positioned, read_spread, read_table


def chunks(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """Chunks, each ``chunk_no`` once (rows delivered twice are equal)."""
    c = read_table(spark, sf, "chunks")
    return c.select("chunk_no", *cols).dropDuplicates(["chunk_no"])


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_spread(spark, sf, "documents")


def header():
    return F.concat_ws(" ", "lang", "source")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Delivered turns with a session, each (session, uuid) once as received last, ``seq`` by arrival."""
    t = read_table(spark, sf, "turns").filter("session_id is not null")
    row = F.struct("received_at", F.coalesce("ts", F.lit("")).alias("ts"), F.coalesce("text", F.lit("")).alias("t"), F.col("kind"), F.col("text"), F.col("tool_calls"), F.col("tool_results"))
    last = t.groupBy("session_id", "uuid").agg(F.max(row).alias("x")).select("session_id", "uuid", "x.received_at", F.lower(F.trim("x.kind")).alias("kind"), "x.text", "x.tool_calls", "x.tool_results")
    placed = positioned(last, ["session_id", "received_at", "uuid"])  # no window over a session, which may hold a third of all rows
    first = placed.groupBy("session_id").agg(F.min("g").alias("g0"))
    return placed.join(first, "session_id").withColumn("seq", (F.col("g") - F.col("g0") + 1).cast("int")).drop("g", "g0")


def tok(x: str) -> str:
    """SQL for the token list of ``x``."""
    sub = r"regexp_extract_all(regexp_replace(w, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|\p{Nd}+')"
    return rf"flatten(list_transform(regexp_extract_all({x}, '[A-Za-z_][A-Za-z0-9_]*|\p{{Nd}}+'), lambda w: CASE WHEN len({sub}) > 1 THEN list_concat([lower(w)], list_transform({sub}, lambda s: lower(s))) ELSE [lower(w)] END))"


ONCE = "k AS (SELECT chunk_no, any_value(id) AS id, any_value(root) AS root, any_value(path) AS path, any_value(symbol) AS symbol, any_value(kind) AS kind, any_value(line_start) AS line_start, any_value(line_end) AS line_end, any_value(header) AS header, any_value(text) AS text, any_value(sha) AS sha, any_value(lang) AS lang, any_value(source) AS source, any_value(run_id) AS run_id FROM chunks GROUP BY chunk_no)"

TURNS = """t0 AS (SELECT *, row_number() OVER (PARTITION BY session_id, uuid ORDER BY received_at DESC, coalesce(ts, '') DESC, coalesce(text, '') DESC) AS rn FROM turns WHERE session_id IS NOT NULL),
t AS (SELECT session_id, uuid, received_at, lower(trim(kind, ' ')) AS kind, text, tool_calls, tool_results, row_number() OVER (PARTITION BY session_id ORDER BY received_at, uuid) AS seq FROM t0 WHERE rn = 1)"""


def postings_sql(table: str, key: str, head: str, text: str, where: str = "") -> str:
    return f"""d AS (SELECT {key} AS id, {tok(head)} AS h, {tok(f"coalesce({text}, '')")} AS b FROM {table} {where}),
tf AS (SELECT id, term, cast(sum(w) AS BIGINT) AS tf FROM (SELECT id, unnest(h) AS term, 3 AS w FROM d UNION ALL SELECT id, unnest(b) AS term, 1 AS w FROM d) GROUP BY id, term),
dl AS (SELECT id, cast(3 * len(h) + len(b) AS BIGINT) AS dl FROM d),
st AS (SELECT cast(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, cast(count(*) AS DOUBLE) AS df FROM tf GROUP BY term)"""


def bm25_sql(queries: str, key: str, text: str) -> str:
    return f"""qt AS (SELECT DISTINCT query_id, term FROM (SELECT {key} AS query_id, unnest({tok(text)}) AS term FROM {queries})),
sc AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN df USING (term) JOIN tf USING (term) JOIN dl USING (id) CROSS JOIN st GROUP BY query_id, id)"""


DOCS_BM25 = postings_sql("documents", "doc_id", "concat_ws(' ', lang, source)", "text") + ",\n" + bm25_sql("golden_items", "item_id", "query")
PRIOR = r"CASE WHEN regexp_matches(path, '(^|/)(tests?|__tests__|spec)(/|$)|(^|/)test_[^/]*$|[._-](test|spec)\.[A-Za-z]+$') THEN 0.7 WHEN lang = 'markdown' THEN 0.9 ELSE 1.0 END"
