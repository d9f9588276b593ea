"""Queries over sources and sinks: tables are written in a reader's format below the shared folder and read back, so the rows can be compared with SQL over the tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import abtest, changes
from tessera.plans.maps import _CUR, _NORM
from tessera.session import forget_later, read_table, shared_dir
from tessera.sources import files, logs, sinks
from tessera.sources.versions import create_file
from tessera.streaming import jobs


def _folder(spark: SparkSession, name: str) -> str:
    return forget_later(spark, f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}")


def _golden(spark, sf) -> DataFrame:
    """The held-out items, 150 at every scale: few enough for a file each."""
    return read_table(spark, sf, "golden_items")


def source_usage_log(spark, sf):
    """Usage lines with broken ones between them, filtered before they are parsed."""
    e = read_table(spark, sf, "events").filter("value is not null")
    usage = F.struct(F.floor("value").cast("bigint").alias("input_tokens"), (F.col("event_id") % 7).alias("output_tokens"), F.when(F.col("event_id") % 3 == 0, 5).alias("cache_read_input_tokens"))
    line = F.to_json(F.struct(F.struct(F.col("event_type").alias("model"), usage.alias("usage")).alias("message")))
    path = _folder(spark, "usage")
    e.select(F.when(F.col("event_id") % 50 == 0, F.concat(line, F.lit("}{"))).when(F.col("event_id") % 50 == 1, "  ").otherwise(line).alias("value")).write.text(path)
    u = logs.usage_events(logs.jsonl(spark, path, having='"model"', glob="*.txt"))
    return u.groupBy("model").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("input", "output", "cache_read", "cache_write")])


def source_transcript(spark, sf):
    """Turns as transcript lines with text, call and result blocks."""
    t = read_table(spark, sf, "turns").filter("text is not null")
    none = F.lit(None).cast("string")
    block = lambda kind, **f: F.struct(F.lit(kind).alias("type"), *[f.get(c, none).alias(c) for c in ("text", "id", "name", "tool_use_id", "content")])
    calls = F.transform(F.coalesce("tool_calls", F.array().cast("array<struct<id:string,name:string,input:string>>")), lambda c: block("tool_use", id=c["id"], name=c["name"]))
    results = F.transform(F.coalesce("tool_results", F.array().cast("array<struct<id:string,output:string>>")), lambda r: block("tool_result", tool_use_id=r["id"], content=r["output"]))
    content = F.concat(F.array(block("text", text=F.col("text"))), calls, results)
    path = _folder(spark, "transcript")
    t.select(F.to_json(F.struct(F.col("kind").alias("type"), "uuid", F.col("session_id").alias("sessionId"), F.struct(content.alias("content")).alias("message")))).write.text(path)
    got = logs.transcript(logs.jsonl(spark, path, glob="*.txt"))
    return got.select("session_id", "uuid", "kind", F.md5("text").alias("text"), F.size("tool_calls").alias("calls"), F.size("tool_results").alias("results"))


def source_golden_set(spark, sf):
    path = _folder(spark, "golden")
    _golden(spark, sf).select("repo", "query", F.col("query_type").alias("type"), "relevant").write.json(path)
    return logs.golden(spark, path).groupBy("repo", "type").agg(F.count(F.lit(1)).alias("items"), F.sum(F.size("relevant")).alias("specs"))


def source_questions(spark, sf):
    path = _folder(spark, "questions")
    _golden(spark, sf).select(F.concat(F.lit("  "), "query", F.lit("\n\n")).alias("value")).write.text(path)
    return logs.questions(spark, path)


def source_instances(spark, sf):
    """One JSON array, with the language under different names."""
    path = _folder(spark, "instances")
    odd = F.col("item_id") % 2 == 1
    row = F.struct(F.col("item_id").cast("string").alias("instance_id"), "repo", F.when(odd, F.lit("")).otherwise(F.col("query_type")).alias("repo_language"), F.when(odd & (F.col("item_id") % 3 > 0), F.col("query_type")).alias("lang"))
    _golden(spark, sf).agg(F.to_json(F.collect_list(row)).alias("value")).write.text(path)  # 150 items
    return logs.instances(spark, path).select("instance_id", "repo", "language")


def source_usage_csv(spark, sf):
    """A/B rows appended as CSV in two parts, one with unreadable numbers."""
    o = read_table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("instance_id"), F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("b").alias("arm"), F.col("o_orderpriority").alias("model"), F.when(F.col("o_orderkey") % 9 == 0, "n/a").otherwise(F.concat(F.col("o_custkey"), F.lit(".0"))).alias("input_tokens"),
        *[F.lit("").alias(c) for c in ("output_tokens", "cache_read_tokens", "cache_write_tokens")], F.col("o_totalprice").cast("string").alias("cost_usd"), *[F.lit("1").alias(c) for c in ("num_turns", "wall_s", "index_wall_s", "patch_bytes")], F.lit("").alias("error"),
    )
    path = _folder(spark, "csv")
    sinks.append_csv(o.filter("instance_id % 3 = 0"), path)
    sinks.append_csv(o.filter("instance_id % 3 <> 0"), path)
    u = logs.usage_csv(spark, path)
    return u.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum(F.round(F.col("cost_usd") * 100).cast("bigint")).alias("cents"))


def source_verdicts(spark, sf):
    """Verdicts in all three shapes, and a file that is no JSON."""
    ids = sorted(r[0] for r in _golden(spark, sf).select("item_id").collect())  # 150 items
    path = _folder(spark, "verdicts")
    shapes = {"list": {"resolved": [str(i) for i in ids if i % 2 == 0]}, "map": {str(i): i % 3 == 0 for i in ids}, "rows": [{"instance_id": str(i), "resolved": i % 5 == 0} for i in ids]}
    out = None
    for name, v in (*shapes.items(), ("bad", None)):
        create_file(spark, f"{path}/{name}.json", json.dumps(v) if v is not None else "no json {")
        d = logs.verdicts(spark, f"{path}/{name}.json").withColumn("shape", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out


def source_files(spark, sf):
    """A file for each held-out passage, some of unknown kinds, in ignored folders or binary."""
    path = _folder(spark, "files")
    for r in _golden(spark, sf).filter("passage is not null").select("item_id", "passage").collect():  # 150 items
        i = r["item_id"]
        name = f"r{i % 4}/{'node_modules/' if i % 10 == 0 else ''}f{i}.{('py', 'md', 'xyz')[i % 3]}"
        create_file(spark, f"{path}/{name}", ("\0" if i % 11 == 0 else "") + r["passage"])
    return files.scan_files(spark, path).select("path", "lang", "size", "sha", F.md5("text").alias("text"))


def sink_append_new(spark, sf):
    """Texts appended in two overlapping batches: each hash once."""
    d = read_table(spark, sf, "documents").filter("text is not null").select(T.short_sha(F.col("text")).alias("sha"))
    path = _folder(spark, "history")
    sinks.append_new(d.filter("sha < '9'"), path, "sha")
    sinks.append_new(d, path, "sha")
    return spark.read.parquet(path)


def sink_append_usage(spark, sf):
    e = read_table(spark, sf, "events").select("event_id", "event_type")
    path = _folder(spark, "log")
    sinks.append_usage(e.filter("event_id % 2 = 0"), path)
    sinks.append_usage(e.filter("event_id % 2 = 1"), path)
    return spark.read.schema("event_id long, event_type string").json(path)


def sink_publish(spark, sf):
    """Two versions published: readers see the second."""
    c = read_table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    path = _folder(spark, "published")
    sinks.publish(c, path)
    sinks.publish(c.filter("c_custkey % 2 = 0"), path)
    return sinks.current(spark, path)


def sink_predictions(spark, sf):
    """Predictions added in two steps to one JSON array (25 nations)."""
    n = read_table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("instance_id"), F.col("n_name").alias("patch"))
    path = _folder(spark, "predictions")
    sinks.append_prediction(n.filter("instance_id < '2'"), path, "instance_id")
    text = sinks.append_prediction(n.filter("instance_id >= '2'"), path, "instance_id")
    rows = spark.createDataFrame([(text,)], "t string").select(F.explode(F.from_json("t", "array<struct<instance_id:string,patch:string>>")).alias("x"))
    return rows.select("x.instance_id", "x.patch")


def sink_checkpoints(spark, sf):
    """Current checkpoints and the copies of both times."""
    s = read_table(spark, sf, "chat_sessions").groupBy("session_id").agg(F.max("cwd").alias("checkpoint")).filter("session_id is not null")
    path = _folder(spark, "checkpoints")
    sinks.write_checkpoints(s, path, 100)
    sinks.write_checkpoints(s.withColumn("checkpoint", F.upper("checkpoint")), path, 200)
    kept = spark.read.parquet(f"{path}/archive").groupBy("session_id").agg(F.count(F.lit(1)).alias("copies"))
    return sinks.current(spark, f"{path}/current").join(kept, "session_id")


def json_map_rows(spark, sf):
    """The code map as JSON texts, read again."""
    m = read_table(spark, sf, "codebase_map").groupBy("root", "path").agg(F.max_by(F.struct("lang", "size", "purpose", "symbols"), F.struct("scanned_at", "loaded_at")).alias("x"))
    j = files.json_map(m.select(F.concat_ws("/", "root", "path").alias("path"), "x.*"))
    x = F.from_json("json", "path string, lang string, size long, purpose string, symbols array<struct<name:string>>")
    return j.select(x.alias("x")).select("x.path", "x.lang", "x.size", "x.purpose", F.array_join(F.transform("x.symbols", lambda s: s["name"]), ",").alias("names"))


def ab_token_fallback(spark, sf):
    """Tokens of a run's own result, or of its logs where the result has none."""
    zero = F.lit(None).cast("long")
    own = read_table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")).alias("input"), zero.alias("output"), zero.alias("cache_read"), zero.alias("cache_write"))
    log = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").cast("long").alias("input"), F.col("l_linenumber").cast("long").alias("output"), zero.alias("cache_read"), zero.alias("cache_write"))
    return abtest.with_fallback(own, log, "o_orderkey").select("o_orderkey", "input", "output", "cache_read", "cache_write")


def change_store_runs(spark, sf):
    """Two runs of the change store: the first sees half of the files, the second all; the output of both, each file once."""
    now = changes.current_files(read_table(spark, sf, "codebase_map")).filter("token is not null and root is not null and path is not null").select("root", "path", "token")
    store = changes.MerkleStore(spark, _folder(spark, "store"), ["root", "path"])
    for seen, name in ((now.filter("length(path) % 2 = 0"), "first"), (now, "second")):
        run = store.start(seen)
        run.publish(run.pending.select("root", "path", F.lit(name).alias("run")))
    return store.output()


def stream_hook_events(spark, sf):
    kind = F.when(F.col("event_type") == "view", "SessionStart").when(F.col("event_type") == "purchase", "PreCompact").otherwise("Other")
    e = read_table(spark, sf, "events").select(F.when(F.col("event_id") % 40 == 0, "broken {").otherwise(F.to_json(F.struct(kind.alias("hook_event_name"), F.when(F.col("event_id") % 2 == 0, "clear").alias("source")))).alias("value"))
    path = _folder(spark, "hooks")
    e.write.text(path)
    return jobs.run_available(jobs.hook_events(spark, path, glob="*.txt")).groupBy("event", "source").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    source_usage_log, source_transcript, source_golden_set, source_questions, source_instances, source_usage_csv, source_verdicts, source_files, sink_append_new, sink_append_usage, sink_publish, sink_predictions, sink_checkpoints, json_map_rows, ab_token_fallback,
    change_store_runs, stream_hook_events,
)}

ORACLES = {
    "source_usage_log": "SELECT event_type AS model, count(*) AS n, cast(sum(floor(value)::BIGINT) AS BIGINT) AS input, cast(sum(event_id % 7) AS BIGINT) AS output, cast(sum(CASE WHEN event_id % 3 = 0 THEN 5 ELSE 0 END) AS BIGINT) AS cache_read, 0::BIGINT AS cache_write FROM events WHERE value IS NOT NULL AND event_id % 50 > 1 GROUP BY 1",
    "source_transcript": "SELECT session_id, uuid, kind, md5(trim(text, ' ')) AS text, coalesce(len(tool_calls), 0)::INTEGER AS calls, coalesce(len(tool_results), 0)::INTEGER AS results FROM turns WHERE text IS NOT NULL AND kind IN ('user', 'assistant', 'summary')",
    "source_golden_set": "SELECT repo, query_type AS type, count(*) AS items, cast(sum(len(relevant)) AS BIGINT) AS specs FROM golden_items GROUP BY 1, 2",
    "source_questions": "SELECT trim(query, ' ') AS query FROM golden_items WHERE trim(query, ' ') <> ''",
    "source_instances": "SELECT item_id::VARCHAR AS instance_id, repo, CASE WHEN item_id % 2 = 0 OR item_id % 3 > 0 THEN coalesce(nullif(query_type, ''), 'unknown') ELSE 'unknown' END AS language FROM golden_items",
    "source_usage_csv": "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS arm, count(*) AS n, cast(sum(CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE o_custkey END) AS BIGINT) AS input_tokens, cast(sum(round(o_totalprice * 100)::BIGINT) AS BIGINT) AS cents FROM orders GROUP BY 1",
    "source_verdicts": "SELECT 'list' AS shape, item_id::VARCHAR AS instance_id, true AS resolved FROM golden_items WHERE item_id % 2 = 0 UNION ALL SELECT 'map', item_id::VARCHAR, item_id % 3 = 0 FROM golden_items UNION ALL SELECT 'rows', item_id::VARCHAR, item_id % 5 = 0 FROM golden_items",
    "source_files": "SELECT 'r' || (item_id % 4) || '/f' || item_id || CASE item_id % 3 WHEN 0 THEN '.py' ELSE '.md' END AS path, CASE item_id % 3 WHEN 0 THEN 'python' ELSE 'markdown' END AS lang, strlen(passage)::BIGINT AS size, sha256(passage)[1:12] AS sha, md5(passage) AS text FROM golden_items WHERE passage IS NOT NULL AND item_id % 10 > 0 AND item_id % 3 < 2 AND item_id % 11 > 0",
    "sink_append_new": "SELECT DISTINCT sha256(text)[1:12] AS sha FROM documents WHERE text IS NOT NULL",
    "sink_append_usage": "SELECT event_id, event_type FROM events",
    "sink_publish": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 0",
    "sink_predictions": "SELECT n_nationkey::VARCHAR AS instance_id, n_name AS patch FROM nation",
    "sink_checkpoints": "SELECT session_id, upper(max(cwd)) AS checkpoint, 2::BIGINT AS copies FROM chat_sessions WHERE session_id IS NOT NULL GROUP BY 1",
    "json_map_rows": f"WITH {_CUR} SELECT concat_ws('/', root, path) AS path, lang, size, purpose, array_to_string(list_transform(symbols, lambda s: s.name), ',') AS names FROM cur",
    "ab_token_fallback": "WITH l AS (SELECT l_orderkey, cast(sum(l_quantity::BIGINT) AS BIGINT) AS i, cast(sum(l_linenumber) AS BIGINT) AS o FROM lineitem GROUP BY 1) SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 AND o_custkey > 0 THEN o_custkey ELSE coalesce(i, 0) END AS input, CASE WHEN o_orderkey % 3 > 0 AND o_custkey > 0 THEN 0 ELSE coalesce(o, 0) END AS output, 0::BIGINT AS cache_read, 0::BIGINT AS cache_write FROM orders LEFT JOIN l ON l_orderkey = o_orderkey",
    "change_store_runs": f"WITH {_CUR} SELECT root, path, CASE WHEN length(path) % 2 = 0 THEN 'first' ELSE 'second' END AS run FROM cur WHERE nullif({_NORM}, '') IS NOT NULL AND root IS NOT NULL AND path IS NOT NULL",
    "stream_hook_events": "SELECT CASE WHEN event_type = 'view' THEN 'SessionStart' ELSE 'PreCompact' END AS event, CASE WHEN event_id % 2 = 0 THEN 'clear' ELSE 'startup' END AS source, count(*) AS n FROM events WHERE event_type IN ('view', 'purchase') AND event_id % 40 > 0 GROUP BY 1, 2",
}
