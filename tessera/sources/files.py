"""Source trees as tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions.text import MAX_FILE_BYTES, ignored, language, short_sha

#: Bytes in which a NUL marks a binary file (fixed value).
SNIFF = 8192


@F.pandas_udf(StringType())
def decode_lenient(data: pd.Series) -> pd.Series:
    """UTF-8 text without the bytes that aren't UTF-8."""
    return data.map(lambda b: None if b is None else bytes(b).decode("utf-8", errors="ignore"))


def scan_files(spark: SparkSession, root: str, most_bytes: int = MAX_FILE_BYTES, tracked: DataFrame | None = None) -> DataFrame:
    """``path, lang, mtime, sha, size, text`` of the indexable files below ``root``.

    Left out: ignored directories, unknown extensions, files over ``most_bytes`` and binary files (a NUL near the start). ``tracked`` (column
    ``path``) restricts the result to the files of a listing. Path and size filters run on the file listing, before any content is read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(F.col("length") <= most_bytes)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", ""), "^" + F_quote(base) + "/", "")
    f = raw.select(rel.alias("path"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"), "content")
    f = f.withColumn("lang", language(F.col("path"))).filter(F.col("lang").isNotNull() & ~ignored(F.col("path")))
    if tracked is not None:
        f = f.join(tracked.select("path").distinct(), "path", "left_semi")
    f = f.filter(~F.contains(F.substring("content", 1, SNIFF), F.lit(b"\x00")))
    return f.select("path", "lang", "mtime", short_sha(F.col("content")).alias("sha"), "size", decode_lenient("content").alias("text"))


def git_listing(spark: SparkSession, root: str) -> DataFrame | None:
    """``path`` of the tracked and of the untracked but not ignored files of a git work tree; None where there is no such tree or no git.

    The listing is made by git on the driver; give it to :func:`scan_files` as ``tracked``.
    """
    import subprocess

    folder = root.removeprefix("file://")
    try:
        out = subprocess.run(["git", "-C", folder, "ls-files", "--cached", "--others", "--exclude-standard", "-z"], capture_output=True, check=True).stdout
    except (OSError, subprocess.CalledProcessError):
        return None
    return spark.createDataFrame([(p.decode("utf-8", "replace"),) for p in out.split(b"\0") if p], "path string")


def json_map(mapped: DataFrame) -> DataFrame:
    """The map as JSON, a text for each file: ``path, json`` with path, lang, mtime, sha, size, purpose and symbols."""
    cols = [c for c in ("path", "lang", "mtime", "sha", "size", "purpose", "engine", "symbols") if c in mapped.columns]
    return mapped.select("path", F.to_json(F.struct(*cols)).alias("json"))


def F_quote(s: str) -> str:  # noqa: N802
    """``s`` as a literal in a Java pattern."""
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def code_map(files: DataFrame, symbols: DataFrame, purposes: DataFrame | None = None) -> DataFrame:
    """One row per file with its symbols as an array ordered by line; files without symbols have an empty one."""
    s = symbols.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line_start", "line_end", "name", "kind"))).alias("s"))
    none = F.array().cast("array<struct<name:string,kind:string,line_start:int,line_end:int>>")
    tidy = F.transform("s", lambda x: F.struct(x["name"].alias("name"), x["kind"].alias("kind"), x["line_start"].alias("line_start"), x["line_end"].alias("line_end")))
    out = files.drop("text").join(s, "path", "left").withColumn("symbols", F.coalesce(tidy, none)).drop("s")
    return out.join(purposes, "path", "left") if purposes is not None else out.withColumn("purpose", F.lit(None).cast("string"))


def render_map(mapped: DataFrame, most: int = 40) -> DataFrame:
    """Markdown of a map by top directory: ``section, text``, at most ``most`` symbols of a file and how many more it has."""
    from tessera.functions.text import top_dir

    item = F.transform(F.slice("symbols", 1, most), lambda s: F.concat(F.lit("  - `"), s["name"], F.lit("` ("), s["kind"], F.lit(") L"), s["line_start"], F.when(s["line_end"] > s["line_start"], F.concat(F.lit("-"), s["line_end"])).otherwise("")))
    more = F.when(F.size("symbols") > most, F.concat(F.lit("\n  - … +"), F.size("symbols") - most, F.lit(" more"))).otherwise("")
    entry = F.concat(F.lit("- **"), F.col("path"), F.lit("**"), F.coalesce(F.concat(F.lit(" — "), F.col("purpose")), F.lit("")), F.when(F.size("symbols") > 0, F.concat(F.lit("\n"), F.array_join(item, "\n"), more)).otherwise(""))
    rows = mapped.select(top_dir(F.col("path")).alias("section"), "path", entry.alias("entry"))
    return rows.groupBy("section").agg(F.sort_array(F.collect_list(F.struct("path", "entry"))).alias("x")).select("section", F.concat(F.lit("## "), F.col("section"), F.lit("\n\n"), F.array_join(F.transform("x", lambda e: e["entry"]), "\n")).alias("text"))
