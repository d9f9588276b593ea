"""Accounting queries. Events stand for usage records: the type names the model, the value the tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import usage as U
from tessera.operators import accounting as A
from tessera.operators import limits, routing
from tessera.plans.common import ONCE, chunks
from tessera.session import read_table

#: Event types as model ids (fixed for these queries).
MODELS = (("purchase", "opus-large"), ("signup", "sonnet-mid"), ("view", "haiku-small"), ("click", "fable-new"), ("error", "other-model"))
#: The latest time in the events table, as epoch seconds: queries never ask the clock.
NOW = 1_706_659_200.0


def _model():
    return F.coalesce(*[F.when(F.col("event_type") == k, F.lit(m)) for k, m in MODELS])


def _usage(spark: SparkSession, sf: str) -> DataFrame:
    v = F.floor(F.col("value") * 100).cast("long")
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(0))
    return read_table(spark, sf, "events").select("event_id", "ts", "user_id", _model().alias("model"), v.alias("input"), (v / 4).cast("long").alias("output"), (v * 3).alias("cache_read"), k.alias("cache_write"))


def usage_totals_by_model(spark, sf):
    return A.usage_totals(_usage(spark, sf))


def impact_cost_footprint(spark, sf):
    i = A.impact(A.usage_totals(_usage(spark, sf)))
    return i.select("input_tokens", "output_tokens", *[F.round(c, 8).alias(c) for c in ("actual_cost", "energy_wh", "water_ml", "co2_g")])


def impact_baseline_savings(spark, sf):
    i = A.impact(A.usage_totals(_usage(spark, sf)))
    return i.select(F.round("baseline_cost", 8).alias("baseline_cost"), *[F.round(c, 8).alias(c) for c in ("saved_cost", "saved_energy_wh", "saved_water_ml", "saved_co2_g")])


def impact_equivalents(spark, sf):
    e = A.equivalents(A.impact(A.usage_totals(_usage(spark, sf))))
    return e.select(*[F.round(c, 8).alias(c) for c in e.columns])


def retrieval_savings_window(spark, sf):
    e = read_table(spark, sf, "events").select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("when"), F.floor("value").cast("long").alias("chunk_tokens"), F.floor(F.col("value") * 7).cast("long").alias("whole_file_tokens"))
    s = A.retrieval_savings(A.in_window(e, "when", NOW, "10"))
    return s.withColumn("est_cost_avoided", F.round("est_cost_avoided", 6))


def context_bloat(spark, sf):
    b = A.context_bloat(read_table(spark, sf, "turns"))
    return b.withColumn("tool_output_mb", F.round("tool_output_mb", 6))


def milestone_level(spark, sf):
    i = A.impact(A.usage_totals(_usage(spark, sf)))
    return i.select(F.round(U.milestone(F.round("saved_cost", 6)), 2).alias("level"))


def price_lookup(spark, sf):
    m = _usage(spark, sf).select("model").distinct()
    return m.select("model", U.price_in(F.col("model")).alias("price_in"), U.price_out(F.col("model")).alias("price_out"), U.family(F.col("model")).alias("family"))


def cost_by_user(spark, sf):
    u = _usage(spark, sf).groupBy("user_id", "model").agg(*[F.sum(c).alias(c) for c in A.COUNTS])
    return u.groupBy("user_id").agg(F.round(F.sum(U.cost(F.col("model"), *[F.col(c) for c in A.COUNTS])), 9).alias("cost"))


def evidence_argmax(spark, sf):
    return routing.best_evidence(_evidence(spark, sf)).select("family", "model", "confidence")


def _evidence(spark, sf):
    u = _usage(spark, sf).filter("model <> 'fable-new'")
    logs = u.select("model", ((F.lit(NOW) - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6) / 86400.0).alias("age_days"))
    e = routing.log_evidence(logs).withColumn("seq", U.family_rank(F.col("family")))
    return e.unionByName(spark.createDataFrame([("sonnet-mid", "sonnet", "explicit", 0)], "model string, family string, strength string, seq int"))


def routing_table(spark, sf):
    return routing.routing(routing.best_evidence(_evidence(spark, sf)))


def rate_limit_sliding(spark, sf):
    r = limits.rate_limited(read_table(spark, sf, "events"), "user_id", "ts", 3, 43_200)
    return r.select("event_id", "n", "rejected")


def large_read_filter(spark, sf):
    m = read_table(spark, sf, "codebase_map").groupBy("root", "path").agg(F.max_by(F.struct("size", F.array_max(F.transform("symbols", lambda s: s["line_end"])).alias("lines")), F.struct("scanned_at", "loaded_at")).alias("x"))
    return m.filter(limits.large_read(F.col("x.size"), F.col("x.lines"), F.lit(None), F.lit(None))).select("root", "path", "x.size")


def restore_filter(spark, sf):
    c = chunks(spark, sf, "source", "text", "run_id")
    return c.filter(limits.restorable(F.col("source"), F.col("text"), F.col("run_id") % 14)).select("chunk_no", F.octet_length(limits.cut_bytes(F.col("text"), 501)).alias("bytes"))


QUERIES = {f.__name__: f for f in (
    usage_totals_by_model, impact_cost_footprint, impact_baseline_savings, impact_equivalents, retrieval_savings_window, context_bloat, milestone_level, price_lookup, cost_by_user, evidence_argmax, routing_table, rate_limit_sliding,
    large_read_filter, restore_filter,
)}

_MODEL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{m}'" for k, m in MODELS) + " END"
_U = f"""u AS (SELECT event_id, ts, user_id, {_MODEL} AS model, floor(value * 100)::BIGINT AS input, trunc(floor(value * 100)::BIGINT / 4.0)::BIGINT AS output, floor(value * 100)::BIGINT * 3 AS cache_read, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS cache_write FROM events),
t AS (SELECT coalesce(model, 'unknown') AS model, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, sum(cache_read)::BIGINT AS cache_read, sum(cache_write)::BIGINT AS cache_write FROM u GROUP BY 1)"""
_PIN = "CASE WHEN model LIKE '%opus%' THEN 5.0 WHEN model LIKE '%sonnet%' THEN 3.0 WHEN model LIKE '%haiku%' THEN 1.0 WHEN model LIKE '%fable%' THEN 10.0 ELSE 5.0 END"
_POUT = "CASE WHEN model LIKE '%opus%' THEN 25.0 WHEN model LIKE '%sonnet%' THEN 15.0 WHEN model LIKE '%haiku%' THEN 5.0 WHEN model LIKE '%fable%' THEN 50.0 ELSE 25.0 END"
_COST = f"(input::DOUBLE / 1e6 * {_PIN}::DOUBLE + output::DOUBLE / 1e6 * {_POUT}::DOUBLE + cache_read::DOUBLE / 1e6 * {_PIN}::DOUBLE * 0.1::DOUBLE + cache_write::DOUBLE / 1e6 * {_PIN}::DOUBLE * 1.25::DOUBLE)"
_I = f"""{_U}, n AS (SELECT *, input + cache_read + cache_write AS processed, floor((input + cache_read + cache_write) * 2.5::DOUBLE)::BIGINT AS naive FROM t),
s AS (SELECT sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, sum({_COST}) AS cost, sum(naive::DOUBLE / 1e6 * {_PIN}::DOUBLE + output::DOUBLE / 1e6 * {_POUT}::DOUBLE) AS base, sum(processed)::DOUBLE * 0.00005::DOUBLE + sum(output)::DOUBLE * 0.0005::DOUBLE AS wh, sum(naive)::DOUBLE * 0.00005::DOUBLE + sum(output)::DOUBLE * 0.0005::DOUBLE AS bwh FROM n)"""
_RANK = "CASE family WHEN 'haiku' THEN 1 WHEN 'sonnet' THEN 2 WHEN 'opus' THEN 3 WHEN 'fable' THEN 4 END"
_EV = f"""{_U}, l AS (SELECT model, CASE WHEN model LIKE '%haiku%' THEN 'haiku' WHEN model LIKE '%sonnet%' THEN 'sonnet' WHEN model LIKE '%opus%' THEN 'opus' END AS family, ({NOW} - epoch_us(ts) / 1e6) / 86400.0 AS age FROM u WHERE model <> 'fable-new'),
e AS (SELECT min(model) AS model, family, CASE WHEN min(age) <= 7 THEN 'recent' ELSE 'stale' END AS strength, {_RANK} AS seq FROM l WHERE family IS NOT NULL AND age <= 30 GROUP BY family UNION ALL SELECT 'sonnet-mid', 'sonnet', 'explicit', 0),
b AS (SELECT family, model, strength, {_RANK} AS rank FROM e ORDER BY rank DESC, seq LIMIT 1)"""

ORACLES = {
    "usage_totals_by_model": f"WITH {_U} SELECT * FROM t",
    "impact_cost_footprint": f"WITH {_I} SELECT input AS input_tokens, output AS output_tokens, round(cost, 8) AS actual_cost, round(wh, 8) AS energy_wh, round(wh * 0.95::DOUBLE, 8) AS water_ml, round(wh * 0.4::DOUBLE, 8) AS co2_g FROM s",
    "impact_baseline_savings": f"WITH {_I} SELECT round(base, 8) AS baseline_cost, round(greatest(0, base - cost), 8) AS saved_cost, round(bwh - wh, 8) AS saved_energy_wh, round((bwh - wh) * 0.95::DOUBLE, 8) AS saved_water_ml, round((bwh - wh) * 0.4::DOUBLE, 8) AS saved_co2_g FROM s",
    "impact_equivalents": f"WITH {_I} SELECT round((bwh - wh) / 12.2::DOUBLE, 8) AS phone_charges, round((bwh - wh) * 0.95::DOUBLE / 250, 8) AS glasses, round((bwh - wh) * 0.4::DOUBLE / 404, 8) AS miles, round((bwh - wh) / 10, 8) AS led_hours FROM s",
    "retrieval_savings_window": f"""WITH r AS (SELECT floor(value)::BIGINT AS c, floor(value * 7)::BIGINT AS w FROM events WHERE {NOW} - floor(epoch_us(ts) / 1e6) <= 864000),
s AS (SELECT count(*) AS queries, sum(c)::BIGINT AS chunk_tokens, sum(w)::BIGINT AS whole_file_tokens FROM r) SELECT *, greatest(0, whole_file_tokens - chunk_tokens)::BIGINT AS tokens_avoided, round(greatest(0, whole_file_tokens - chunk_tokens)::DOUBLE / 1e6 * 5, 6) AS est_cost_avoided FROM s WHERE queries > 0""",
    "context_bloat": """WITH r AS (SELECT session_id, CASE WHEN lower(trim(kind, ' ')) = 'summary' THEN 1 ELSE 0 END AS c, coalesce(len(tool_results), 0) AS n, coalesce(list_sum(list_transform(tool_results, lambda x: strlen(coalesce(x.output, '')))), 0) AS b FROM turns WHERE session_id IS NOT NULL),
p AS (SELECT session_id, max(c) AS c, sum(n) AS n, sum(b) AS b FROM r GROUP BY 1), s AS (SELECT count(*) AS sessions, sum(c)::BIGINT AS compacted_sessions, sum(n)::BIGINT AS tool_results, sum(b)::BIGINT AS b FROM p)
SELECT sessions, compacted_sessions, tool_results, b // 4 AS tool_output_tokens, round(b / 1048576.0::DOUBLE, 6) AS tool_output_mb, b // 4 // sessions AS avg_tool_output_tokens_per_session FROM s""",
    "milestone_level": f"WITH {_I} SELECT round(floor(round(greatest(0, base - cost), 6) / 5.0) * 5.0, 2)::DOUBLE AS level FROM s",
    "price_lookup": f"WITH {_U} SELECT DISTINCT model, {_PIN}::DOUBLE AS price_in, {_POUT}::DOUBLE AS price_out, CASE WHEN model LIKE '%haiku%' THEN 'haiku' WHEN model LIKE '%sonnet%' THEN 'sonnet' WHEN model LIKE '%opus%' THEN 'opus' WHEN model LIKE '%fable%' THEN 'fable' END AS family FROM u",
    "cost_by_user": f"WITH {_U}, g AS (SELECT user_id, model, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, sum(cache_read)::BIGINT AS cache_read, sum(cache_write)::BIGINT AS cache_write FROM u GROUP BY 1, 2) SELECT user_id, round(sum({_COST}), 9) AS cost FROM g GROUP BY 1",
    "evidence_argmax": f"WITH {_EV} SELECT family, model, CASE strength WHEN 'explicit' THEN 'high' WHEN 'recent' THEN 'medium' WHEN 'stale' THEN 'low' END AS confidence FROM b",
    "routing_table": f"WITH {_EV}, r AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in routing.ROUTES) + ") AS v(task, rule)) SELECT task, CASE WHEN family IS NULL THEN 'inherit' WHEN rule = 'best' THEN family WHEN rule = 'sonnet-or-best' THEN CASE WHEN rank >= 2 THEN 'sonnet' ELSE family END ELSE rule END AS target FROM r LEFT JOIN b ON true",
    "rate_limit_sliding": "SELECT event_id, n, n > 3 AS rejected FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 43199999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS n FROM events)",
    "large_read_filter": "WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root, path ORDER BY scanned_at DESC, loaded_at DESC) AS rn FROM codebase_map) WHERE rn = 1) SELECT root, path, size FROM c WHERE coalesce(size, 0) >= 100000 OR coalesce(list_max(list_transform(symbols, lambda s: s.line_end)), 0) >= 1200",
    "restore_filter": f"WITH {ONCE}, f AS (SELECT chunk_no, text FROM k WHERE coalesce(source, '') <> 'clear' AND run_id % 14 <= 7 AND regexp_matches(text, '\\S')), a AS (SELECT chunk_no, text, list_sum([0]) AS z FROM f), p AS (SELECT chunk_no, text, unnest(range(498, 502)) AS n FROM a) SELECT chunk_no, CASE WHEN strlen(any_value(text)) <= 501 THEN strlen(any_value(text)) ELSE max(b) END::INTEGER AS bytes FROM (SELECT chunk_no, text, b FROM (SELECT chunk_no, text, unnest(list_transform(range(100, 502), lambda n: strlen(text[1:n]))) AS b FROM f) WHERE b <= 501 OR strlen(text) <= 501) GROUP BY chunk_no",
}
