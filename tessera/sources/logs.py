"""JSON-lines logs, transcripts, evaluation sets and A/B tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

USAGE_CSV = (
    "instance_id string, arm string, model string, input_tokens string, output_tokens string, cache_read_tokens string, cache_write_tokens string, "
    "cost_usd string, num_turns string, wall_s string, index_wall_s string, patch_bytes string, error string"
)
GOLDEN = "repo string, query string, type string, relevant array<struct<path: string, symbols: array<string>>>"


def jsonl(spark: SparkSession, path: str, having: str | None = None, glob: str = "*.jsonl") -> DataFrame:
    """``file, at, mtime, value, v``: the non-blank lines of all files ``glob`` below a folder that are valid JSON, with it as VARIANT.

    ``having`` is a text that a line must hold: a cheap test before it is parsed.
    ``at`` orders a file's lines (start of the split, number within it) without reading a file as a whole.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("no")).alias("at"), F.col("_metadata.file_modification_time").alias("mtime"), F.trim("value").alias("value"))
    rows = rows.filter(F.contains("value", F.lit(having))) if having else rows
    # the parser stops after a first value, so a line with anything behind it is told by the array that it doesn't make
    one = rows.filter("value <> ''").withColumn("_all", F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]"))))
    one = one.filter(F.try_variant_get("_all", "$[0]", "variant").isNotNull() & F.try_variant_get("_all", "$[1]", "variant").isNull())
    return one.withColumn("v", F.try_variant_get("_all", "$[0]", "variant")).drop("_all")


def _get(path: str, kind: str = "string", v: str = "v") -> Column:
    return F.try_variant_get(F.col(v), path, kind)


def usage_events(lines: DataFrame) -> DataFrame:
    """``file, mtime, model, input, output, cache_read, cache_write`` of lines that carry usage."""
    u = lines.filter(_get("$.message.usage", "variant").isNotNull())
    count = lambda n: F.coalesce(_get(f"$.message.usage.{n}", "bigint"), F.lit(0)).alias
    return u.select("file", "mtime", F.coalesce(F.nullif(_get("$.message.model"), F.lit("")), F.nullif(_get("$.model"), F.lit("")), F.lit("unknown")).alias("model"), count("input_tokens")("input"), count("output_tokens")("output"), count("cache_read_input_tokens")("cache_read"), count("cache_creation_input_tokens")("cache_write"))


def transcript(lines: DataFrame) -> DataFrame:
    """Turns of transcripts: ``file, at, session_id, cwd, git_branch, uuid, ts, kind, text, tool_calls, tool_results``.

    Content is a string or an array of text, tool_use and tool_result blocks; texts are joined by line ends; a result's own content may be an array of
    texts. Only user, assistant and summary events are turns.
    """
    kind = _get("$.type")
    blocks = _get("$.message.content", "array<variant>")
    b = lines.withColumn("kind", kind).withColumn("blocks", F.coalesce(blocks, F.array().cast("array<variant>"))).filter("kind in ('user', 'assistant', 'summary')")
    get = lambda x, p, t="string": F.try_variant_get(x, p, t)
    of = lambda name: F.filter("blocks", lambda x: F.coalesce(get(x, "$.type") == name, F.lit(False)))
    texts = F.transform(of("text"), lambda x: F.coalesce(get(x, "$.text"), F.lit("")))
    own = F.when(F.size("blocks") == 0, F.array(F.coalesce(_get("$.message.content"), F.lit("")))).otherwise(texts)
    own = F.concat(own, F.when(F.col("kind") == "summary", F.array(F.coalesce(_get("$.summary"), F.lit("")))).otherwise(F.array().cast("array<string>")))
    calls = F.transform(of("tool_use"), lambda x: F.struct(F.coalesce(get(x, "$.id"), F.lit("")).alias("id"), F.coalesce(get(x, "$.name"), F.lit("")).alias("name"), F.coalesce(F.to_json(get(x, "$.input", "variant")), F.lit("{}")).alias("input")))
    parts = lambda x: F.filter(get(x, "$.content", "array<variant>"), lambda y: F.coalesce(get(y, "$.type") == "text", F.lit(False)))
    joined = lambda x: F.array_join(F.transform(parts(x), lambda y: F.coalesce(get(y, "$.text"), F.lit(""))), "\n")
    outs = F.transform(of("tool_result"), lambda x: F.struct(F.coalesce(get(x, "$.tool_use_id"), F.lit("")).alias("id"), F.coalesce(joined(x), get(x, "$.content"), F.lit("")).alias("output")))
    return b.select(
        "file", "at", _get("$.sessionId").alias("session_id"), _get("$.cwd").alias("cwd"), _get("$.gitBranch").alias("git_branch"), _get("$.uuid").alias("uuid"), _get("$.timestamp").alias("ts"), "kind",
        F.trim(F.array_join(F.filter(own, lambda s: s != ""), "\n")).alias("text"), calls.alias("tool_calls"), outs.alias("tool_results"),
    )


def latest_transcript(spark: SparkSession, path: str) -> DataFrame:
    """One row with the path of the newest ``*.jsonl`` file; none where there is none."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(path).select("path", "modificationTime")
    return f.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).filter("path is not null")


def golden(spark: SparkSession, path: str, repos: list[str] | None = None) -> DataFrame:
    g = spark.read.schema(GOLDEN).json(path)
    return g.filter(F.col("repo").isin(repos)) if repos else g


def questions(spark: SparkSession, path: str) -> DataFrame:
    """One question per line, blank lines dropped."""
    return spark.read.text(path).select(F.trim("value").alias("query")).filter("query <> ''")


def settings_model(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Explicit evidence ``model, strength, seq`` from settings files (JSON with ``model``), in the given order; unreadable ones give none."""
    from functools import reduce

    from tessera.session import _hadoop_path

    there = [(i, p) for i, p in enumerate(paths) if (lambda x: x[0].exists(x[1]))(_hadoop_path(spark, p))]
    none = spark.createDataFrame([], "model string, strength string, seq int")
    rows = [spark.read.option("wholetext", True).text(p).select(F.try_variant_get(F.try_parse_json("value"), "$.model", "string").alias("model"), F.lit("explicit").alias("strength"), F.lit(i).alias("seq")) for i, p in there]
    return reduce(DataFrame.unionByName, rows, none).filter("model is not null")


def environment_models(spark: SparkSession, environ: dict[str, str], names: tuple[str, ...], seq: int = 100) -> DataFrame:
    """Explicit evidence ``model, strength, seq`` from named environment variables that are set, in the order of the names."""
    rows = [(environ[n], "explicit", seq + i) for i, n in enumerate(names) if environ.get(n)]
    return spark.createDataFrame(rows, "model string, strength string, seq int")


def first_json(text: str) -> dict | None:
    """The first JSON object within mixed output, whatever stands before and after it; None where there is none."""
    import json
    import re

    read = json.JSONDecoder().raw_decode
    for brace in re.finditer(r"\{", text):
        try:
            return read(text, brace.start())[0]
        except ValueError:
            continue
    return None


def instances(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of instances with their language (the first non-empty of three fields, or 'unknown')."""
    d = spark.read.schema("instance_id string, repo string, base_commit string, problem_statement string, repo_language string, language string, lang string").option("multiLine", True).json(path)
    return d.withColumn("language", F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("repo_language", "language", "lang")], F.lit("unknown"))).drop("repo_language", "lang")


def usage_csv(spark: SparkSession, path: str) -> DataFrame:
    """A/B usage rows with numbers ('' and unreadable count as 0) and ``seq``, their order; the last row of an item and arm counts later."""
    d = spark.read.option("header", True).schema(USAGE_CSV).csv(path).withColumn("seq", F.monotonically_increasing_id())
    for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "patch_bytes"):
        d = d.withColumn(c, F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).cast("bigint"))
    return d.withColumn("cost_usd", F.coalesce(F.col("cost_usd").try_cast("double"), F.lit(0.0)))


def verdicts(spark: SparkSession, path: str) -> DataFrame:
    """``instance_id, resolved`` from any of three shapes: {"resolved": [ids]}, {id: bool} or [{"instance_id", "resolved"}]; a file that is no JSON gives none."""
    v = spark.read.option("wholetext", True).text(path).select(F.try_parse_json("value").alias("v")).filter("v is not null")
    listed = F.transform(_get("$.resolved", "array<string>"), lambda s: F.struct(s.alias("instance_id"), F.lit(True).alias("resolved")))
    rows = F.transform(_get("$", "array<variant>"), lambda r: F.struct(F.try_variant_get(r, "$.instance_id", "string").alias("instance_id"), F.coalesce(F.try_variant_get(r, "$.resolved", "boolean"), F.lit(False)).alias("resolved")))
    pairs = F.transform(F.map_entries(_get("$", "map<string, boolean>")), lambda e: F.struct(e["key"].alias("instance_id"), F.coalesce(e["value"], F.lit(False)).alias("resolved")))
    return v.select(F.explode(F.coalesce(listed, rows, pairs)).alias("x")).select("x.instance_id", "x.resolved").filter("instance_id is not null")
