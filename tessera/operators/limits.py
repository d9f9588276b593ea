"""Filters over event streams: rate limits, large reads, restorable checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import epoch_micros

#: Hits in a sliding minute; bytes and lines of a large read; age in days and bytes of a checkpoint to restore (fixed values).
HITS, WINDOW_S = 5, 60
#: Windows in a span of a key.
BLOCKS = 16
LARGE_BYTES, LARGE_LINES = 100_000, 1_200
RESTORE_DAYS, RESTORE_BYTES = 7, 24_000


def rate_limited(hits: DataFrame, key: str, ts: str, most: int = HITS, seconds: int = WINDOW_S) -> DataFrame:
    """Adds ``n``, the hits of the key in the last ``seconds`` (strictly younger), itself included, and ``rejected``. Rejected hits count on.

    A key is cut into spans of BLOCKS windows; each span also gets the hits of the window before it, so a hot key is many tasks' work. Null times form a span of
    their own.
    """
    span = seconds * 1_000_000
    us = epoch_micros(hits, ts)
    cols = hits.columns
    own = hits.withColumn("_us", us).withColumn("_b", F.floor(F.col("_us") / (span * BLOCKS))).withColumn("_own", F.lit(True))
    before = own.filter(F.col("_us") >= (F.col("_b") + 1) * (span * BLOCKS) - span).withColumn("_b", F.col("_b") + 1).withColumn("_own", F.lit(False))
    w = Window.partitionBy(key, "_b").orderBy("_us").rangeBetween(-(span - 1), 0)
    counted = own.unionByName(before).withColumn("n", F.count(F.lit(1)).over(w)).filter("_own")
    return counted.select(*cols, "n", (F.col("n") > most).alias("rejected"))


def large_read(size: Column, n_lines: Column, offset: Column, limit: Column) -> Column:
    """True if a whole-file read is too large; a read of a part never is."""
    part = offset.isNotNull() | limit.isNotNull()
    return ~part & ((F.coalesce(size, F.lit(0)) >= LARGE_BYTES) | (F.least(F.coalesce(n_lines, F.lit(0)), F.lit(LARGE_LINES + 1)) >= LARGE_LINES))


def restorable(source: Column, text: Column, age_days: Column) -> Column:
    return (F.coalesce(source, F.lit("")) != "clear") & (age_days <= RESTORE_DAYS) & F.coalesce(text.rlike(r"\S"), F.lit(False))


def cut_bytes(text: Column, most: int = RESTORE_BYTES) -> Column:
    """The longest prefix of whole characters within ``most`` bytes of UTF-8."""
    raw = F.substring(F.encode(text, "UTF-8"), 1, most)
    tail = F.regexp_replace(F.hex(raw), "(C[2-9A-F]|D[0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-4](?:[89AB][0-9A-F]){0,2})$", "")
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.unhex(tail), "UTF-8"))
