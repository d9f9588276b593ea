"""Paired A/B evaluation: stratified sample, pairing, report and bootstrap interval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import checked_join, materialise

#: Rounds and seed of the bootstrap (fixed values).
ROUNDS, SEED = 2000, 7


def quotas(items: DataFrame, stratum: str, n: int) -> DataFrame:
    """``stratum, size, quota``: a share of n in proportion, half-even rounded, at least 1."""
    sizes = items.groupBy(stratum).agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.sum("size").alias("total"))
    return sizes.crossJoin(F.broadcast(total)).select(stratum, "size", F.greatest(F.lit(1), F.bround(F.lit(float(n)) * F.col("size") / F.col("total"), 0).cast("long")).alias("quota"))


def stratified_sample(items: DataFrame, key: str, stratum: str, n: int, seed: int = SEED, only: list[str] | None = None) -> DataFrame:
    """At most n keys, each stratum's quota first, topped up from the rest; the order within a stratum is that of the MD5 of seed and key.

    A sampling operator: deterministic for any partitioning. ``only`` restricts it to some strata.
    """
    items = items if only is None else items.filter(F.col(stratum).isin(only))
    h = items.select(key, stratum).withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    r = h.withColumn("r", F.row_number().over(Window.partitionBy(stratum).orderBy("h", key))).filter(F.col("r") <= n)  # a stratum gives n keys at most, so this limit holds before the shuffle
    r = checked_join(r, materialise(quotas(items, stratum, n), "quotas"), stratum)
    return r.withColumn("extra", (F.col("r") > F.col("quota")).cast("int")).orderBy("extra", "h", key).limit(n).select(key, stratum)


def pair_arms(rows: DataFrame, item: str, arm: str, values: list[str], first: str, second: str, error: str = "error") -> DataFrame:
    """One row for each item: its values in both arms with suffixes ``_a`` and ``_b``, and ``complete``.

    Of several rows of an item and arm the one with the greatest ``seq`` counts. An item is complete if both arms ran without error.
    """
    last = rows.groupBy(item, arm).agg(*[F.max_by(c, "seq").alias(c) for c in (*values, error)])
    bad = F.coalesce(F.col(error), F.lit("")) != ""
    cols = [F.max(F.when(F.col(arm) == side, F.col(c))).alias(f"{c}_{tag}") for tag, side in (("a", first), ("b", second)) for c in values]
    ok = [F.max(F.when((F.col(arm) == side) & ~bad, 1).otherwise(0)).alias(f"ok_{tag}") for tag, side in (("a", first), ("b", second))]
    return last.groupBy(item).agg(*cols, *ok).withColumn("complete", (F.col("ok_a") == 1) & (F.col("ok_b") == 1)).drop("ok_a", "ok_b")


def with_fallback(results: DataFrame, logged: DataFrame, key: str) -> DataFrame:
    """Token counts of a run's own result if it has any, else the sums over the models in its logs, else 0.

    Both have ``key`` and input, output, cache_read, cache_write.
    """
    names = ("input", "output", "cache_read", "cache_write")
    sums = logged.groupBy(key).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(f"log_{c}") for c in names])
    any_own = F.coalesce(sum((F.coalesce(F.col(c), F.lit(0)) for c in names), F.lit(0)), F.lit(0)) > 0
    return results.join(sums, key, "left").select(key, *[F.when(any_own, F.coalesce(c, F.lit(0))).otherwise(F.coalesce(f"log_{c}", F.lit(0))).cast("long").alias(c) for c in names])


def with_verdicts(pairs: DataFrame, first: DataFrame, second: DataFrame, item: str) -> DataFrame:
    """Pairs with ``resolved_a`` and ``resolved_b`` from the arms' verdicts (item, resolved); a missing or null verdict counts as not resolved.

    An item with several verdicts in an arm is resolved if any says so.
    """
    out = pairs
    for d, tag in ((first, "a"), (second, "b")):
        v = d.filter(F.col(item).isNotNull()).groupBy(item).agg(F.coalesce(F.max("resolved"), F.lit(False)).alias(f"resolved_{tag}"))
        out = out.join(v, item, "left").withColumn(f"resolved_{tag}", F.coalesce(f"resolved_{tag}", F.lit(False)))
    return out


def runs_to_do(items: DataFrame, key: str, arms: list[str], done: DataFrame) -> DataFrame:
    """Every item in every arm, less what is done (``key, arm``)."""
    each = items.select(key).distinct().withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms])))
    return each.join(done.select(key, "arm").distinct(), [key, "arm"], "left_anti")


def bootstrap_distributed(values: DataFrame, value: str, key: str, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """``low, high`` of the mean by a Poisson bootstrap: each row's weight in a round comes from the MD5 of seed, round and key.

    For any number of rows: weights are drawn where the rows are, and only ``rounds`` sums are gathered.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("round").cast("string"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    e = values.select(key, F.col(value).cast("double").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    cdf, p, total = [], 0.36787944117144233, 0.0
    for k in range(8):
        total += p
        cdf.append(total)
        p /= k + 1
    w = F.lit(0)
    for c in cdf:
        w = w + F.when(u > c, 1).otherwise(0)
    m = e.withColumn("w", w).groupBy("round").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m"))
    v = F.array_sort(F.collect_list("m"))  # at most ``rounds`` numbers
    return m.agg(F.try_element_at(v, (F.floor(F.size(v) * F.lit(0.025)) + 1).cast("int")).alias("low"), F.try_element_at(v, (F.floor(F.size(v) * F.lit(0.975)) + 1).cast("int")).alias("high"))


def summary(pairs: DataFrame, tokens: str = "tokens", cost: str = "cost") -> DataFrame:
    """n, token sums, reduction (0 without baseline tokens), costs and cost per resolved item of complete pairs."""
    p = pairs.filter("complete")
    s = p.agg(F.count(F.lit(1)).alias("n"), F.sum(f"{tokens}_a").alias("tokens_a"), F.sum(f"{tokens}_b").alias("tokens_b"), F.sum(f"{cost}_a").alias("cost_a"), F.sum(f"{cost}_b").alias("cost_b"), F.sum(F.col("resolved_a").cast("long")).alias("resolved_a"), F.sum(F.col("resolved_b").cast("long")).alias("resolved_b"))
    reduction = F.coalesce(1 - F.try_divide(F.col("tokens_b").cast("double"), F.col("tokens_a").cast("double")), F.lit(0.0))
    per = lambda x: F.try_divide(F.col(f"cost_{x}"), F.col(f"resolved_{x}").cast("double")).alias(f"cost_per_resolved_{x}")
    return s.select("*", reduction.alias("reduction"), per("a"), per("b"))
