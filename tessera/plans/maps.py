"""Code map, chunking and change queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import changes, chunking, indexing
from tessera.plans.common import ONCE, chunks, documents
from tessera.session import read_table


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return changes.files_to_index(read_table(spark, sf, "codebase_map"), read_table(spark, sf, "chunks"), read_table(spark, sf, "index_runs")).select("root", "path")


def _files(spark, sf):
    return documents(spark, sf).filter("text is not null").select("doc_id", "text", "lang", F.concat_ws("/", F.lit("docs"), F.coalesce("doc_kind", F.lit("none")), F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"))


def _lines(spark, sf):
    return _files(spark, sf).select("doc_id", F.size(T.lines(F.col("text"))).alias("n_lines"))


def split_lines(spark, sf):
    n = chunking.numbered_lines(documents(spark, sf), ["doc_id"])
    return n.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.max(F.length("line")).alias("longest"), F.sum(F.length("line")).alias("chars"))


def markdown_headings(spark, sf):
    return chunking.markdown_symbols(documents(spark, sf), ["doc_id"])


def markdown_purposes(spark, sf):
    return chunking.markdown_purpose(markdown_headings(spark, sf), ["doc_id"])


def regex_symbols(spark, sf):
    return chunking.regex_symbols(chunks(spark, sf, "text"), ["chunk_no"])


def python_ast_symbols(spark, sf):
    c = chunks(spark, sf, "text", "lang").filter("lang = 'python' and text is not null")
    return chunking.python_symbols(c, "chunk_no")


def line_windows_overlap(spark, sf):
    """Windows of 60 lines with 10 in common over all chunk texts (up to some 240 lines)."""
    n = chunks(spark, sf, "text").select("chunk_no", F.size(T.lines(F.col("text"))).alias("n_lines")).filter("n_lines > 0")
    w = F.explode(chunking.windows(F.lit(1), F.col("n_lines"))).alias("w")
    return n.select("chunk_no", w).select("chunk_no", F.col("w.wa").alias("line_start"), F.col("w.wb").alias("line_end"))


def _current_symbols(spark, sf):
    m = read_table(spark, sf, "codebase_map").groupBy("root", "path").agg(F.max_by("symbols", F.struct("scanned_at", "loaded_at")).alias("symbols"))
    s = m.select("root", "path", F.explode("symbols").alias("s")).select("root", "path", "s.name", "s.kind", "s.line_start", "s.line_end")
    return s, s.groupBy("root", "path").agg(F.max(F.greatest("line_start", "line_end")).alias("n_lines"))


def gap_islands(spark, sf):
    s, f = _current_symbols(spark, sf)
    return chunking.gaps(s.select("root", "path", F.col("line_start").alias("a"), F.col("line_end").alias("b")), f, ["root", "path"])


def next_start_lead(spark, sf):
    h = markdown_headings(spark, sf)
    return chunking.spans(h, _lines(spark, sf), ["doc_id"]).select("doc_id", "name", "a", "b")


def symbol_spans(spark, sf):
    s, f = _current_symbols(spark, sf)
    return chunking.spans(s, f, ["root", "path"]).groupBy("root", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest(F.lit(0), F.col("b") - F.col("a") + 1)).alias("lines"))


def chunk_documents(spark, sf):
    """Documents as files: source code goes through the Python parser or the line patterns, all else is Markdown."""
    f = _coded(spark, sf)
    return chunking.chunk_files(f, chunking.extract_symbols(f)[0])


def _coded(spark, sf):
    code = F.coalesce(F.col("doc_kind") == "source_code", F.lit(False))
    d = documents(spark, sf).filter("text is not null")
    return d.select(F.concat(F.lit("docs/"), F.col("doc_id"), F.when(code, ".py").otherwise(".md")).alias("path"), F.when(code, "python").otherwise("markdown").alias("lang"), "text")


def file_purposes(spark, sf):
    """What a file is for: a module's docstring or the first heading."""
    return chunking.extract_symbols(_coded(spark, sf))[1]


def chunk_order(spark, sf):
    c = chunks(spark, sf, "path", "line_start").withColumn("id", F.col("chunk_no"))
    return chunking.in_order(c).select("chunk_no", "position")


def decision_blocks(spark, sf):
    f = documents(spark, sf).filter("text is not null").select("doc_id", "text")
    marked = f.select(F.concat(F.lit("log/"), F.col("doc_id")).alias("path"), F.regexp_replace("text", "(?m)^# ", "## D-1 ").alias("text"))
    return chunking.decision_chunks(marked).select("id", "line_start", "line_end", F.length("text").alias("chars"))


def top_symbols(spark, sf):
    """At most 40 symbols of each file in line order, and how many more it has."""
    m = read_table(spark, sf, "codebase_map").groupBy("root", "path").agg(F.max_by("symbols", F.struct("scanned_at", "loaded_at")).alias("symbols"))
    return m.filter("symbols is not null").select("root", "path", F.array_join(F.transform(F.slice("symbols", 1, 40), lambda s: s["name"]), ",").alias("names"), F.greatest(F.lit(0), F.size("symbols") - 40).alias("more"))


def map_counts(spark, sf):
    s = F.coalesce(F.size("symbols"), F.lit(0))
    m = read_table(spark, sf, "codebase_map").groupBy("root", "path").agg(F.max_by("symbols", F.struct("scanned_at", "loaded_at")).alias("symbols"))
    return m.groupBy("root").agg(F.count(F.lit(1)).alias("file_count"), F.sum(s).cast("long").alias("symbol_count"))


def top_dirs(spark, sf):
    m = read_table(spark, sf, "codebase_map").select("root", "path").distinct()
    return m.groupBy("root", T.top_dir(F.col("path")).alias("dir")).agg(F.count(F.lit(1)).alias("files"))


def languages(spark, sf):
    m = read_table(spark, sf, "codebase_map").select("path").distinct()
    return m.groupBy(T.language(F.col("path")).alias("lang"), T.ignored(F.col("path")).alias("ignored")).agg(F.count(F.lit(1)).alias("files"))


def drift_full_outer(spark, sf):
    now = changes.current_files(read_table(spark, sf, "codebase_map")).withColumnRenamed("token", "sha")
    stored = changes.indexed_files(read_table(spark, sf, "chunks"), read_table(spark, sf, "index_runs")).withColumnRenamed("token", "sha")
    return indexing.drift(now, stored, ["root", "path"])


def incremental_anti_join(spark, sf):
    c = chunks(spark, sf, "id", "root", "sha")
    v = read_table(spark, sf, "chunk_vectors").filter("vec is not null").select("chunk_no").distinct()
    stored = c.join(v, "chunk_no", "left_semi").select(F.concat_ws("/", "root", "id").alias("id"), "sha").distinct().withColumn("vec", F.lit(None).cast("array<float>"))
    todo = indexing.reuse_embeddings(c.select("chunk_no", F.concat_ws("/", "root", "id").alias("id"), "sha"), stored)[1]
    return todo.select("chunk_no", "id", "sha")


def index_validate(spark, sf):
    """The checks of all chunks ever written; an id counts as duplicated if a run wrote it twice for a repository."""
    c = chunks(spark, sf, "path", "root", "run_id", F.col("id").alias("name")).withColumnRenamed("chunk_no", "id")
    v = read_table(spark, sf, "chunk_vectors").select(F.col("chunk_no").alias("id"), "vec").distinct()
    return indexing.problems(c, v, read_table(spark, sf, "codebase_map").select("path"), 64, names=["root", "run_id", "name"])


def content_sha(spark, sf):
    return documents(spark, sf).select("doc_id", T.short_sha(F.col("text")).alias("sha"))


def chunk_cap_topn(spark, sf):
    c = chunks(spark, sf, "kind", "text").filter("text is not null").withColumn("id", F.col("chunk_no"))
    return chunking.cap_chunks(c, 1000).select("chunk_no")


def systematic_sample(spark, sf):
    m = read_table(spark, sf, "codebase_map").select(F.concat_ws("/", "root", "path").alias("key"))
    return indexing.systematic_sample(m, "key")


def union_sources(spark, sf):
    a = chunks(spark, sf, "path", "source").select("path", "source")
    b = documents(spark, sf).select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("path"), F.lit("documents").alias("source"))
    return a.unionByName(b).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("paths"))


def path_difference(spark, sf):
    return read_table(spark, sf, "codebase_map").select("root", "path").distinct().join(read_table(spark, sf, "chunks").select("root", "path").distinct(), ["root", "path"], "left_anti")


def path_intersection(spark, sf):
    return read_table(spark, sf, "codebase_map").select("root", "path").intersect(read_table(spark, sf, "chunks").select("root", "path"))


def latest_chunk_per_id(spark, sf):
    c = chunks(spark, sf, "root", "id", "run_id", "sha")
    return c.groupBy("root", "id").agg(F.max_by("sha", F.struct("run_id", "chunk_no")).alias("sha"), F.max("run_id").alias("run_id"))


QUERIES = {f.__name__: f for f in (
    p4_found, split_lines, markdown_headings, markdown_purposes, regex_symbols, python_ast_symbols, line_windows_overlap, gap_islands, next_start_lead, symbol_spans, chunk_documents, file_purposes, chunk_order, decision_blocks, top_symbols, map_counts, top_dirs,
    languages, drift_full_outer, incremental_anti_join, index_validate, content_sha, chunk_cap_topn, systematic_sample, union_sources, path_difference, path_intersection, latest_chunk_per_id,
)}

_END = r"'\r\n|[\n\r\x{000b}\x{000c}\x{001c}\x{001d}\x{001e}\x{0085}\x{2028}\x{2029}]'"
_LN = rf"""ls AS (SELECT doc_id, CASE WHEN a[-1] = '' THEN a[1:len(a) - 1] ELSE a END AS ls FROM (SELECT doc_id, regexp_split_to_array(text, {_END}) AS a FROM documents WHERE text IS NOT NULL AND text <> '')),
ln AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM ls)"""
_HEAD = rf"""{_LN},
fe AS (SELECT *, regexp_matches(line, '^\s*(```|~~~)') AS fence, sum(CASE WHEN regexp_matches(line, '^\s*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS seen FROM ln),
hd AS (SELECT doc_id, trim(regexp_extract(line, '^(#{{1,6}})\s+(.+?)\s*#*\s*$', 2), ' ') AS name, 'h' || length(regexp_extract(line, '^(#{{1,6}})\s+(.+?)\s*#*\s*$', 1)) AS kind, n::INTEGER AS line_start, n::INTEGER AS line_end FROM fe WHERE NOT fence AND seen % 2 = 0 AND regexp_matches(line, '^(#{{1,6}})\s+(.+?)\s*#*\s*$'))"""
_CUR = "cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root, path ORDER BY scanned_at DESC, loaded_at DESC) AS rn FROM codebase_map) WHERE rn = 1)"
_SYM = f"{_CUR}, sy AS (SELECT root, path, s.name AS name, s.kind AS kind, s.line_start AS line_start, s.line_end AS line_end FROM (SELECT root, path, unnest(symbols) AS s FROM cur)), nl AS (SELECT root, path, max(greatest(line_start, line_end)) AS n_lines FROM sy GROUP BY 1, 2)"
_SPAN = """nx AS (SELECT {k}, name, line_start, line_end, n_lines, min(line_start) OVER (PARTITION BY {k} ORDER BY line_start RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM {s} JOIN {n} USING ({k}) WHERE kind <> 'constant'),
sp AS (SELECT {k}, name, line_start AS a, CASE WHEN nxt <= b0 THEN nxt - 1 ELSE b0 END AS b FROM (SELECT *, least(CASE WHEN line_end <= line_start THEN greatest(line_start, coalesce(nxt, n_lines + 1) - 1) ELSE line_end END, n_lines) AS b0 FROM nx))"""
_NORM = r"regexp_extract(lower(sha), '^\s*(?:sha-?256:)?\s*([0-9a-f]{12,})\s*$', 1)[1:12]"
_IDX = f"ix AS (SELECT c.root, c.path, max_by({_NORM}, r.started_at) AS sha, max(r.started_at) AS started_at FROM chunks c JOIN index_runs r ON c.run_id = r.run_id WHERE r.status = 'ok' GROUP BY 1, 2)"
_PATTERNS = "[" + ", ".join("'" + p + "'" for p, _ in chunking.SYMBOL_PATTERNS) + "]"
_CASE = " ".join(f"WHEN regexp_matches(line, '{p}') THEN {i}" for i, (p, _) in enumerate(chunking.SYMBOL_PATTERNS))
_NAME = " ".join(f"WHEN p = {i} THEN regexp_extract(line, '{p}', 1)" for i, (p, _) in enumerate(chunking.SYMBOL_PATTERNS))
_KIND = " ".join(f"WHEN p = {i} THEN '{k}'" for i, (_, k) in enumerate(chunking.SYMBOL_PATTERNS))

ORACLES = {
    "p4_found": rf"""WITH {_CUR}, {_IDX}, m AS (SELECT root, path, nullif({_NORM}, '') AS sha, mtime FROM cur)
SELECT m.root, m.path FROM m LEFT JOIN ix i ON i.root = m.root AND i.path = m.path WHERE i.root IS NULL OR m.sha <> i.sha OR (m.sha IS NULL AND m.mtime > epoch_us(i.started_at) / 1e6)""",
    "split_lines": f"WITH {_LN} SELECT doc_id, count(*) AS n_lines, max(length(line)) AS longest, cast(sum(length(line)) AS BIGINT) AS chars FROM ln GROUP BY 1",
    "markdown_headings": f"WITH {_HEAD} SELECT * FROM hd",
    "markdown_purposes": f"WITH {_HEAD} SELECT doc_id, min_by(name, line_start)[1:120] AS purpose FROM hd WHERE kind = 'h1' GROUP BY 1",
    "regex_symbols": rf"""WITH {ONCE}, ls AS (SELECT chunk_no, CASE WHEN a[-1] = '' THEN a[1:len(a) - 1] ELSE a END AS ls FROM (SELECT chunk_no, regexp_split_to_array(text, {_END}) AS a FROM k WHERE text IS NOT NULL AND text <> '')),
ln AS (SELECT chunk_no, unnest(ls) AS line, generate_subscripts(ls, 1)::INTEGER AS n FROM ls), h AS (SELECT *, CASE {_CASE} END AS p FROM ln)
SELECT chunk_no, CASE {_NAME} END AS name, CASE {_KIND} END AS kind, n AS line_start, n AS line_end FROM h WHERE p IS NOT NULL""",
    "line_windows_overlap": f"""WITH {ONCE}, c AS (SELECT chunk_no, len(a) - CASE WHEN a[-1] = '' THEN 1 ELSE 0 END AS m FROM (SELECT chunk_no, regexp_split_to_array(text, {_END}) AS a FROM k WHERE text IS NOT NULL AND text <> '')),
w AS (SELECT chunk_no, m, unnest(range(1, m + 1, 50)) AS wa FROM c) SELECT chunk_no, wa::INTEGER AS line_start, least(wa + 59, m)::INTEGER AS line_end FROM w WHERE wa = 1 OR wa + 9 < m""",
    "chunk_order": f"WITH {ONCE} SELECT chunk_no, row_number() OVER (ORDER BY path NULLS FIRST, line_start NULLS FIRST, chunk_no) AS position FROM k",
    "gap_islands": f"""WITH {_SYM}, al AS (SELECT root, path, unnest(range(1, n_lines + 1)) AS n FROM nl), cv AS (SELECT DISTINCT root, path, unnest(range(line_start, line_end + 1)) AS n FROM sy WHERE line_end >= line_start),
fr AS (SELECT root, path, n, n - row_number() OVER (PARTITION BY root, path ORDER BY n) AS g FROM (SELECT * FROM al ANTI JOIN cv USING (root, path, n)))
SELECT root, path, min(n)::INTEGER AS a, max(n)::INTEGER AS b FROM fr GROUP BY root, path, g HAVING count(*) >= 5""",
    "next_start_lead": f"WITH {_HEAD}, nl AS (SELECT doc_id, count(*)::INTEGER AS n_lines FROM ln GROUP BY 1), " + _SPAN.format(k="doc_id", s="hd", n="nl") + " SELECT doc_id, name, a, b FROM sp",
    "symbol_spans": f"WITH {_SYM}, " + _SPAN.format(k="root, path", s="sy", n="nl") + " SELECT root, path, count(*) AS n, cast(sum(greatest(0, b - a + 1)) AS BIGINT) AS lines FROM sp GROUP BY 1, 2",
    "decision_blocks": rf"""WITH f AS (SELECT 'log/' || doc_id AS path, regexp_replace(text, '(?m)^# ', '## D-1 ', 'g') AS text FROM documents WHERE text IS NOT NULL AND text <> ''),
ls AS (SELECT path, CASE WHEN a[-1] = '' THEN a[1:len(a) - 1] ELSE a END AS ls FROM (SELECT path, regexp_split_to_array(text, {_END}) AS a FROM f)),
h AS (SELECT path, ls, line, n FROM (SELECT path, ls, unnest(ls) AS line, generate_subscripts(ls, 1)::INTEGER AS n FROM ls) WHERE regexp_matches(line, '^##+\s+(D-\d+)\b')),
e AS (SELECT *, coalesce(lead(n) OVER (PARTITION BY path ORDER BY n) - 1, len(ls))::INTEGER AS e FROM h)
SELECT path || '::' || regexp_extract(line, '^##+\s+(D-\d+)\b', 1) || '::' || n AS id, n AS line_start, e AS line_end, length(array_to_string(ls[n:e], chr(10))[1:4096])::INTEGER AS chars FROM e""",
    "top_symbols": f"WITH {_CUR} SELECT root, path, coalesce(array_to_string(list_transform(symbols[1:40], lambda s: s.name), ','), '') AS names, greatest(0, len(symbols) - 40)::INTEGER AS more FROM cur WHERE symbols IS NOT NULL",
    "map_counts": f"WITH {_CUR} SELECT root, count(*) AS file_count, cast(sum(coalesce(len(symbols), 0)) AS BIGINT) AS symbol_count FROM cur GROUP BY 1",
    "top_dirs": "SELECT root, CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '.' END AS dir, count(*) AS files FROM (SELECT DISTINCT root, path FROM codebase_map) GROUP BY 1, 2",
    "languages": "WITH e AS (SELECT DISTINCT path, lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) AS e FROM codebase_map), l AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in T.LANGUAGES.items()) + ") AS t(e, lang)) SELECT lang, list_has_any(string_split(path, '/'), [" + ", ".join(f"'{d}'" for d in T.IGNORED_DIRS) + "]) AS ignored, count(*) AS files FROM e LEFT JOIN l USING (e) GROUP BY 1, 2",
    "drift_full_outer": f"""WITH {_CUR}, {_IDX}, m AS (SELECT root, path, nullif({_NORM}, '') AS sha FROM cur), j AS (SELECT coalesce(m.root, i.root) AS root, coalesce(m.path, i.path) AS path,
CASE WHEN i.root IS NULL THEN 'added' WHEN m.root IS NULL THEN 'deleted' WHEN coalesce(m.sha = i.sha, false) THEN NULL ELSE 'changed' END AS status FROM m FULL JOIN ix i ON m.root = i.root AND m.path = i.path) SELECT * FROM j WHERE status IS NOT NULL""",
    "incremental_anti_join": f"""WITH {ONCE}, c AS (SELECT chunk_no, root || '/' || id AS id, sha FROM k), s AS (SELECT DISTINCT id, sha FROM c WHERE chunk_no IN (SELECT chunk_no FROM chunk_vectors WHERE vec IS NOT NULL)) SELECT chunk_no, id, sha FROM c ANTI JOIN s USING (id, sha)""",
    "index_validate": f"""WITH {ONCE}, v AS (SELECT DISTINCT chunk_no, vec FROM chunk_vectors) SELECT 'unknown_file' AS "check", count(*) AS n FROM k WHERE path NOT IN (SELECT path FROM codebase_map) UNION ALL SELECT 'duplicate_id', count(*) FROM (SELECT root, run_id, id FROM k GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'vector_without_chunk', count(DISTINCT chunk_no) FROM v WHERE chunk_no NOT IN (SELECT chunk_no FROM chunks) UNION ALL SELECT 'chunk_without_vector', count(*) FROM k WHERE chunk_no NOT IN (SELECT chunk_no FROM v)
UNION ALL SELECT 'other_dimension', count(*) FROM v WHERE len(vec) <> 64 UNION ALL SELECT 'null_vector', count(*) FROM v WHERE vec IS NULL""",
    "content_sha": "SELECT doc_id, sha256(text)[1:12] AS sha FROM documents",
    "chunk_cap_topn": f"WITH {ONCE} SELECT chunk_no FROM k WHERE text IS NOT NULL ORDER BY CASE WHEN kind = 'module' THEN 1 ELSE 0 END, length(text), chunk_no LIMIT 1000",
    "systematic_sample": "WITH d AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT root || '/' || path AS key FROM codebase_map)) SELECT key FROM d WHERE r % greatest(1, n // 20) = 0 AND r < greatest(1, n // 20) * 20",
    "union_sources": f"WITH {ONCE} SELECT source, count(*) AS n, count(DISTINCT path) AS paths FROM (SELECT path, source FROM k UNION ALL SELECT 'doc/' || doc_id, 'documents' FROM documents) GROUP BY 1",
    "path_difference": "SELECT root, path FROM codebase_map EXCEPT SELECT root, path FROM chunks",
    "path_intersection": "SELECT root, path FROM codebase_map INTERSECT SELECT root, path FROM chunks",
    "latest_chunk_per_id": f"WITH {ONCE} SELECT root, id, arg_max(sha, run_id * 1000000000000 + chunk_no) AS sha, max(run_id) AS run_id FROM k GROUP BY 1, 2",
}
del _PATTERNS, Window
