"""Streaming forms of the batch operators over a table of events. Each runs what is available and returns the sink's table."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.limits import BLOCKS, HITS, RESTORE_DAYS, WINDOW_S
from tessera.session import shared_dir
from tessera.sources.versions import PartedTable, merge_latest


def event_stream(spark: SparkSession, path: str, time: str = "ts", glob: str | None = None) -> DataFrame:
    """A file stream of a Parquet table; the time column becomes a TIMESTAMP, which watermarks need."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    folder, _, name = path.rstrip("/").rpartition("/")
    s = reader.option("pathGlobFilter", glob or name).parquet(folder) if name.endswith(".parquet") and _is_file(spark, path) else reader.parquet(path)
    return s.withColumn(time, F.col(time).cast("timestamp"))


def _is_file(spark: SparkSession, path: str) -> bool:
    from tessera.session import _hadoop_path

    fs, p = _hadoop_path(spark, path)
    return fs.getFileStatus(p).isFile()


def run_available(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Runs a stream over all available input into a Parquet table in the shared folder and reads it.

    Output modes other than append, and ``each``, go through ``foreachBatch``: each batch's rows are written to a folder named by the batch, so that
    a batch that is run again after a failure replaces its own rows. In complete and update mode the last batch's rows count.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    schema = stream.schema
    if mode == "append" and each is None:
        q = writer.outputMode("append").format("parquet").start(f"{base}/out")
        q.awaitTermination()
        return spark.read.schema(schema).parquet(f"{base}/out")

    def write(df: DataFrame, batch: int) -> None:
        if each:
            each(df, batch)
        df.write.mode("overwrite").parquet(f"{base}/out/batch={batch}")

    q = writer.outputMode(mode).foreachBatch(write).start()
    q.awaitTermination()
    rows = spark.read.schema(schema).option("basePath", f"{base}/out").parquet(f"{base}/out/batch=*")
    rows = rows.withColumn("_b", F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(\d+)/", 1).cast("long"))
    last = rows.agg(F.max("_b").alias("_b"))
    return rows.join(F.broadcast(last), "_b").drop("_b") if mode == "complete" else rows.drop("_b")


def tumbling_usage(events: DataFrame, by: str, value: str, span: str = "1 day", late: str = "2 hours", time: str = "ts") -> DataFrame:
    """Sums and counts for each tumbling window and key; windows are emitted once the watermark has passed."""
    w = events.withWatermark(time, late).groupBy(F.window(time, span), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("window.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "2 hours", time: str = "ts") -> DataFrame:
    """Session windows of a key: runs of events with gaps shorter than ``gap``."""
    s = events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return s.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "3650 days", time: str = "ts") -> DataFrame:
    """Each combination of keys once, within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def rate_limiter(events: DataFrame, key: str, event_id: str, most: int = HITS, seconds: int = WINDOW_S, time: str = "ts") -> DataFrame:
    """``event_id, n, rejected`` by keyed state: the times of the last ``seconds`` of each key, rejected hits included.

    A key is cut into spans of BLOCKS windows, each also given the hits of the window before it, so a hot key is many groups' work and a group holds no more than
    a span's hits. State is dropped when the watermark has passed the span.
    """
    window = seconds * 1_000_000
    span = window * BLOCKS

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["us", "e"])
        us, own = rows["us"].to_numpy(), rows["own"].to_numpy()
        seen = np.sort(np.concatenate([np.array(times, np.int64), us]))
        n = np.searchsorted(seen, us, "right") - np.searchsorted(seen, us - window, "right")
        state.update((seen[seen > seen[-1] - window].tolist(),))
        state.setTimeoutTimestamp(max(int((k[1] + 1) * span // 1000) + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"e": rows["e"][own], "n": n[own], "rejected": n[own] > most})

    s = events.withWatermark(time, "1 hour").select(F.col(key).alias("k"), F.col(event_id).cast("long").alias("e"), F.unix_micros(time).alias("us"), time)
    block = F.floor(F.col("us") / span)
    both = F.when(F.col("us") >= (block + 1) * span - window, F.array(block, block + 1)).otherwise(F.array(block))
    s = s.withColumn("b", F.explode(both)).withColumn("own", F.col("b") == block)
    out = s.groupBy("k", "b").applyInPandasWithState(step, "e long, n long, rejected boolean", "times array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumnRenamed("e", event_id)


def upsert_index(changes: DataFrame, target: str, key: str, version: str) -> DataFrame:
    """A stream of changed records merged batch by batch into a table in parts, where the greatest ``version`` of a key counts.

    A batch rewrites only the parts that its keys fall into (:func:`tessera.sources.versions.merge_latest`).
    """
    table = PartedTable(changes.sparkSession, target)
    run_available(changes, "append", lambda df, batch: merge_latest(table, df, key, version))
    return table.read().drop("_part")


def hook_events(spark: SparkSession, folder: str, kinds: tuple[str, ...] = ("PreCompact", "SessionStart", "PreToolUse"), glob: str = "*.jsonl") -> DataFrame:
    """A stream of hook payloads (one JSON object a line, by files of a folder): ``event, session_id, cwd, trigger, source, transcript_path, payload``.

    Lines that are no JSON objects and events of other kinds drop out; ``trigger`` is 'auto' and ``source`` 'startup' where missing, ``cwd`` '.'.
    """
    v = spark.readStream.option("pathGlobFilter", glob).text(folder).withColumn("v", F.try_parse_json("value")).filter("v is not null")
    get = lambda p: F.try_variant_get("v", p, "string")
    or_ = lambda p, d: F.coalesce(F.nullif(get(p), F.lit("")), F.lit(d))
    out = v.select(get("$.hook_event_name").alias("event"), get("$.session_id").alias("session_id"), or_("$.cwd", ".").alias("cwd"), or_("$.trigger", "auto").alias("trigger"), or_("$.source", "startup").alias("source"), get("$.transcript_path").alias("transcript_path"), F.col("value").alias("payload"))
    return out.filter(F.col("event").isin(*kinds))


def restorable_checkpoints(starts: DataFrame, written: DataFrame, key: str, days: int = RESTORE_DAYS, time: str = "ts") -> DataFrame:
    """Starts of sessions with every checkpoint of their key that is at most ``days`` old then: an interval join of two streams, whose state the watermark bounds by that age.

    ``starts``: start_id, key, time; ``written``: key, time. Output: ``start_id, checkpoint_at``; the latest of a start is the one to restore (:func:`latest_per_start`).
    """
    s = starts.withWatermark(time, "1 hour").select("start_id", F.col(key).alias("_k"), F.col(time).alias("_started"))
    c = written.withWatermark(time, "1 hour").select(F.col(key).alias("_c"), F.col(time).alias("checkpoint_at"))
    on = (F.col("_k") == F.col("_c")) & (F.col("checkpoint_at") <= F.col("_started")) & (F.col("checkpoint_at") >= F.col("_started") - F.expr(f"INTERVAL {days} DAYS"))
    return s.join(c, on).select("start_id", "checkpoint_at")


def latest_per_start(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("start_id").agg(F.max("checkpoint_at").alias("checkpoint_at"))
