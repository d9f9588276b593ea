"""From usage records to tokens, cost, footprint and savings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import usage as U

COUNTS = ("input", "output", "cache_read", "cache_write")


def usage_totals(events: DataFrame) -> DataFrame:
    """``model`` and the four token sums; missing counters count as 0, a missing model as 'unknown'. Records aren't deduplicated."""
    return events.groupBy(F.coalesce("model", F.lit("unknown")).alias("model")).agg(*[F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in COUNTS])


def impact(totals: DataFrame, baseline: float = U.BASELINE, co2: float = U.CO2_G_PER_WH) -> DataFrame:
    """One row: actual and baseline cost, footprint and what was saved. Baseline input is truncated for each model before it is summed."""
    processed = F.col("input") + F.col("cache_read") + F.col("cache_write")
    naive = F.floor(processed * F.lit(baseline)).cast("long")
    zero = F.lit(0)
    per = totals.select(
        *COUNTS, processed.alias("processed"), naive.alias("naive"), U.cost(F.col("model"), *[F.col(c) for c in COUNTS]).alias("cost"), U.cost(F.col("model"), naive, F.col("output"), zero, zero).alias("naive_cost"),
    )
    s = per.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*COUNTS, "processed", "naive")], F.coalesce(F.sum("cost"), F.lit(0.0)).alias("actual_cost"), F.coalesce(F.sum("naive_cost"), F.lit(0.0)).alias("baseline_cost"))
    s = s.withColumn("energy_wh", U.energy_wh(F.col("processed"), F.col("output"))).withColumn("baseline_wh", U.energy_wh(F.col("naive"), F.col("output")))
    saved_wh = F.greatest(F.lit(0.0), F.col("baseline_wh") - F.col("energy_wh"))
    return s.select(
        *[F.col(c).alias(f"{c}_tokens") for c in COUNTS], "actual_cost", "baseline_cost", F.greatest(F.lit(0.0), F.col("baseline_cost") - F.col("actual_cost")).alias("saved_cost"),
        "energy_wh", (F.col("energy_wh") * U.ML_PER_WH).alias("water_ml"), (F.col("energy_wh") * co2).alias("co2_g"),
        saved_wh.alias("saved_energy_wh"), (saved_wh * U.ML_PER_WH).alias("saved_water_ml"), (saved_wh * co2).alias("saved_co2_g"),
    )


def equivalents(impacts: DataFrame) -> DataFrame:
    """Phone charges, glasses of water, miles driven and LED hours that the saved footprint amounts to."""
    return impacts.select(
        (F.col("saved_energy_wh") / U.PHONE_WH).alias("phone_charges"), (F.col("saved_water_ml") / U.GLASS_ML).alias("glasses"), (F.col("saved_co2_g") / U.MILE_G).alias("miles"), (F.col("saved_energy_wh") / U.LED_WH).alias("led_hours"),
    )


def in_window(df: DataFrame, epoch_s: str, now_s: float, since: str = "30") -> DataFrame:
    """Records not older than the window; ``now_s`` is given by the caller. A null time counts as the epoch."""
    span = U.window_seconds(since)
    return df if span is None else df.filter(F.lit(float(now_s)) - F.coalesce(F.col(epoch_s), F.lit(0)) <= span)


def retrieval_savings(records: DataFrame) -> DataFrame:
    """Queries, tokens served, tokens of whole files, tokens and dollars avoided; no row where there is no query."""
    s = records.agg(F.count(F.lit(1)).alias("queries"), F.coalesce(F.sum("chunk_tokens"), F.lit(0)).cast("long").alias("chunk_tokens"), F.coalesce(F.sum("whole_file_tokens"), F.lit(0)).cast("long").alias("whole_file_tokens"))
    avoided = F.greatest(F.lit(0), F.col("whole_file_tokens") - F.col("chunk_tokens"))
    return s.filter("queries > 0").select("*", avoided.alias("tokens_avoided"), (avoided / 1e6 * U.DEFAULT_PRICE[0]).alias("est_cost_avoided"))


def context_bloat(turns: DataFrame) -> DataFrame:
    """Sessions, those that were compacted (a summary turn), tool results and their bytes as tokens, over raw turn rows.

    ``turns``: session_id, kind, tool_results. No row where there is no session.
    """
    out = F.transform("tool_results", lambda r: F.octet_length(F.coalesce(r["output"], F.lit(""))).cast("long"))
    size = F.coalesce(F.aggregate(out, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0))
    n = F.coalesce(F.size("tool_results"), F.lit(0))
    per = turns.filter("session_id is not null").groupBy("session_id").agg(F.max((F.lower(F.trim("kind")) == "summary").cast("int")).alias("compacted"), F.sum(n).alias("n"), F.sum(size).alias("bytes"))
    s = per.agg(F.count(F.lit(1)).alias("sessions"), F.sum("compacted").cast("long").alias("compacted_sessions"), F.sum("n").cast("long").alias("tool_results"), F.sum("bytes").cast("long").alias("b")).filter("sessions > 0")
    tokens = F.expr("b div 4")
    return s.select("sessions", "compacted_sessions", "tool_results", tokens.alias("tool_output_tokens"), (F.col("b") / 1048576.0).alias("tool_output_mb"), F.expr("(b div 4) div sessions").alias("avg_tool_output_tokens_per_session"))


def milestone_reached(saved: float, last: float, step: float) -> float | None:
    """The milestone that a sum of saved dollars newly reaches, None if it is no higher than the last one."""
    level = saved // max(0.01, step) * max(0.01, step)
    return level if level > max(last, 0.0) else None
