"""Sinks: appends, atomic replacement, reports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import _hadoop_path
from tessera.sources.versions import create_file, read_file


def append_usage(df: DataFrame, path: str) -> None:
    """Appends usage records as JSON lines."""
    df.write.mode("append").json(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Appends rows as CSV files, each with a header of its own."""
    df.write.mode("append").option("header", True).csv(path)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key isn't in the table yet, each key once; returns how many."""
    spark = df.sparkSession
    fs, p = _hadoop_path(spark, path)
    new = df.dropDuplicates([key])
    if fs.exists(p):
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    new = new.persist()
    try:
        n = new.count()
        if n:
            new.write.mode("append").parquet(path)
        return n
    finally:
        new.unpersist()


def publish(df: DataFrame, path: str) -> str:
    """Writes a new version of a table and then makes it current by replacing a pointer file; readers see the old one or the new one."""
    spark = df.sparkSession
    v = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{v}")
    create_file(spark, f"{path}/CURRENT", v, replace=True)
    return v


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The current version of a published table, or None."""
    v = read_file(spark, f"{path}/CURRENT")
    return spark.read.parquet(f"{path}/{v}") if v else None


def append_prediction(df: DataFrame, path: str, key: str) -> str:
    """Adds predictions to a published table and renders all as one JSON array text, ordered by ``key``; a report of a few rows, like its reader expects."""
    old = current(df.sparkSession, path)
    publish(df if old is None else old.unionByName(df), path)
    rows = current(df.sparkSession, path).select(F.to_json(F.struct(key, *[c for c in df.columns if c != key])).alias("j"), F.col(key).alias("_k")).orderBy("_k", "j").collect()
    return "[" + ", ".join(r["j"] for r in rows) + "]"


def save_state(spark: SparkSession, path: str, state: dict) -> None:
    """Writes a small state in one step."""
    create_file(spark, path, json.dumps(state), replace=True)


def load_state(spark: SparkSession, path: str, default: dict) -> dict:
    """A state as it was saved; the default where there is none or it can't be read."""
    try:
        state = json.loads(read_file(spark, path) or "")
    except ValueError:
        return dict(default)
    return state if isinstance(state, dict) else dict(default)


def write_checkpoints(checkpoints: DataFrame, path: str, at: int) -> None:
    """Publishes sessions' checkpoints (session_id, checkpoint) as current ones and keeps a copy under the time ``at`` (epoch seconds)."""
    checkpoints.write.mode("overwrite").parquet(f"{path}/archive/at={at}")
    publish(checkpoints.sparkSession.read.parquet(f"{path}/archive/at={at}"), f"{path}/current")


def _rows(df: DataFrame, most: int) -> tuple[list, int]:
    """At most ``most`` rows of a report and how many more there are."""
    rows = df.limit(most + 1).collect()
    return rows[:most], df.count() - most if len(rows) > most else 0


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A report table as Markdown, for aggregates of a few rows: of more than ``most`` the report says how many it leaves out."""
    rows, more = _rows(df, most)
    cell = lambda x: "" if x is None else f"{x:,.4g}" if isinstance(x, float) else str(x)
    out = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    out += ["| " + " | ".join(cell(x) for x in r) + " |" for r in rows] + ([f"… and {more:,} more rows"] if more else [])
    return "\n".join(out) + "\n"


def html_bars(df: DataFrame, label: str, value: str, title: str, most: int = 1000) -> str:
    """A report table as HTML bars, for aggregates of a few rows: of more than ``most`` the report says how many it leaves out."""
    import html

    rows, more = _rows(df.select(F.col(label).cast("string"), F.col(value).cast("double")), most)
    top = max([r[1] or 0.0 for r in rows] or [1.0]) or 1.0
    bars = "".join(f'<div><span>{html.escape(r[0] or "")}</span><b style="width:{100 * (r[1] or 0) / top:.1f}%">{r[1] or 0:,.0f}</b></div>' for r in rows)
    return f"<!doctype html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{bars}" + (f"<p>… and {more:,} more rows</p>" if more else "")
