"""Retrieval evaluation: relevance, hit rates, ranks, tokens and latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialise

K = 10


def relevant(results: DataFrame, golden: DataFrame) -> DataFrame:
    """Adds ``relevant``: a result matches a specification if the path is equal and it names no symbol or one within the result's symbol.

    ``results``: query_id, rank, path, symbol and others; ``golden``: query_id, relevant (array of path, symbols).
    """
    spec = golden.select("query_id", F.explode("relevant").alias("s")).select("query_id", F.col("s.path").alias("path"), F.col("s.symbols").alias("symbols"))
    any_symbol = F.coalesce(F.size("symbols"), F.lit(0)) <= 0
    named = F.exists("symbols", lambda s: F.contains(F.lower("symbol"), F.lower(s)))
    hit = results.join(spec, ["query_id", "path"]).filter(any_symbol | F.coalesce(named, F.lit(False))).select("query_id", "rank").distinct().withColumn("relevant", F.lit(True))
    return results.join(hit, ["query_id", "rank"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))


def score_queries(judged: DataFrame, golden: DataFrame) -> DataFrame:
    """One record for each golden query: ``query_id, type, first_rank, hit1, hit5, mrr, tokens_to_task, ctx_tokens_5``.

    ``judged``: query_id, rank, tokens, relevant. Queries without results count as misses with no context tokens.
    """
    upto = F.sum("tokens").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    per = judged.withColumn("upto", upto).groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first_rank"), F.min_by(F.when(F.col("relevant"), F.col("upto")), F.when(F.col("relevant"), F.col("rank"))).alias("tokens_to_task"), F.sum(F.when(F.col("rank") <= 5, F.col("tokens")).otherwise(0)).alias("ctx_tokens_5"))
    j = golden.select("query_id", "type").join(per, "query_id", "left")
    return j.select("query_id", "type", "first_rank", F.coalesce(F.col("first_rank") == 1, F.lit(False)).alias("hit1"), F.coalesce(F.col("first_rank") <= 5, F.lit(False)).alias("hit5"), F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("mrr"), "tokens_to_task", F.coalesce("ctx_tokens_5", F.lit(0)).cast("long").alias("ctx_tokens_5"))


def judge_rows(results: DataFrame, golden: DataFrame, top: int = 5) -> DataFrame:
    """Test cases for a judge: ``query_id, mode, query, context, reference`` with the first ``top`` results of every query and mode as one text.

    ``results``: query_id, mode, rank, path, symbol, text; ``golden``: query_id, query, relevant.
    """
    part = F.concat(F.lit("--- "), F.col("path"), F.lit(" ("), F.col("symbol"), F.lit(") ---\n"), F.coalesce("text", F.lit("")))
    ctx = results.filter(F.col("rank") <= top).groupBy("query_id", "mode").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", part.alias("p")))), lambda s: s["p"]), "\n\n").alias("context"))
    ref = F.array_join(F.transform("relevant", lambda s: F.concat(s["path"], F.when(F.coalesce(F.size(s["symbols"]), F.lit(0)) > 0, F.concat(F.lit(" ("), F.array_join(s["symbols"], ", "), F.lit(")"))).otherwise(""))), "; ")
    return ctx.join(golden.select("query_id", "query", ref.alias("reference")), "query_id").select("query_id", "mode", "query", "context", "reference")


def positional(value: Column, share: float | None) -> Column:
    """The element of the sorted values at n // 2 (``share`` None) or at min(n - 1, floor(share * n)), counted from 0."""
    v = F.array_sort(F.collect_list(value))
    at = F.floor(F.size(v) / 2) if share is None else F.least(F.size(v) - 1, F.floor(F.size(v) * F.lit(share)))
    return F.try_element_at(v, (at + 1).cast("int"))


def positional_distributed(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key, p50, p95`` by the same positions, from counts of distinct values, so that no group is collected.

    The running sums of the counts come from sums within range partitions of (key, value) plus the partitions' offsets, so a key with many values is many tasks' work.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    counts = materialise(counts.repartitionByRange(key, value).withColumn("_p", F.spark_partition_id()), "counts")
    sums = sorted((r["_p"], r["c"]) for r in counts.groupBy("_p").agg(F.sum("c").alias("c")).collect())  # a number per partition
    before = [(p, sum(c for _, c in sums[:i])) for i, (p, _) in enumerate(sums)]
    if not before:
        return counts.select(key, F.col(value).alias("p50"), F.col(value).alias("p95"))
    w = Window.partitionBy("_p").orderBy(key, value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "_p int, _o long"))
    seen = counts.withColumn("upto", F.sum("c").over(w)).join(offsets, "_p").withColumn("upto", F.col("upto") + F.col("_o"))
    per = seen.groupBy(F.col(key).alias("_k")).agg(F.sum("c").alias("n"), F.min(F.col("upto") - F.col("c")).alias("start"))
    seen = seen.join(per, F.col(key).eqNullSafe(F.col("_k"))).withColumn("upto", F.col("upto") - F.col("start"))
    mid, high = F.floor(F.col("n") / 2), F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(0.95)))
    return seen.groupBy(key).agg(F.min(F.when(F.col("upto") > mid, F.col(value))).alias("p50"), F.min(F.when(F.col("upto") > high, F.col(value))).alias("p95"))


def aggregate(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, mean hit1, hit5 and mrr, the half-even rounded means of tokens to task (of hits) and context tokens, and how many were degraded if that is known."""
    g = records.groupBy(*(by or []))
    extra = [F.sum(F.col("degraded").cast("long")).alias("degraded")] if "degraded" in records.columns else []
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return g.agg(F.count(F.lit(1)).alias("n"), rate("hit1").alias("hit1"), rate("hit5").alias("hit5"), rate("mrr").alias("mrr"), F.bround(F.avg("tokens_to_task"), 0).cast("long").alias("tokens_to_task"), F.bround(F.avg("ctx_tokens_5"), 0).cast("long").alias("ctx_tokens_5"), *extra)


def by_mode(golden: DataFrame, modes: list[str]) -> DataFrame:
    """Every golden query in every mode: the golden columns and ``mode`` (a stated, short list)."""
    return golden.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))


def gate(aggregated: DataFrame, least_hit5: float = 0.80) -> DataFrame:
    """Adds ``passed``: whether hit@5 reaches the floor."""
    return aggregated.withColumn("passed", F.col("hit5") >= least_hit5)
