"""Session helpers: reading tables, the shared folder, cutting lineage, checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows that a side may have to be broadcast; callers keep such sides to a few fixed-width columns.
BROADCAST_ROWS = 500_000

_written: list[tuple[SparkSession, str]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir`` (a file or a folder)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` where it is set.

    Only where neither the setting nor the context names a folder (local tests) a temporary one is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = jdir.get() if jdir.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop_path(spark, path)
    fs.delete(p, True)


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back.

    This cuts the lineage like ``checkpoint()`` does (every executor can read the files, so a lost
    executor costs nothing), but columnar and compressed. :func:`clear` removes the tables, at the latest when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def forget_later(spark: SparkSession, path: str) -> str:
    """Has :func:`clear` remove a folder too; returns it."""
    _written.append((spark, path))
    return path


@atexit.register
def clear() -> None:
    """Removes all tables that :func:`materialise` wrote; call it when no DataFrame that reads them is needed any more."""
    while _written:
        spark, path = _written.pop()
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001  the context is gone; the folder's owner clears it
            return


def positioned(turns: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``g``, the global position in the total order ``order``, without a single-task window.

    Rows are range partitioned and sorted; each partition numbers its own rows and the offsets (one number per partition) are added.
    """
    cols = turns.columns
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    part = materialise(ranged.withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", 33)), "order")
    sizes = sorted((r["_p"], r["n"]) for r in part.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect())
    offset, pairs = 0, []
    for p, n in sizes:
        pairs.append((p, offset))
        offset += n
    if not pairs:
        return part.withColumn("g", F.lit(0).cast("long")).select(*cols, "g")
    offsets = F.broadcast(turns.sparkSession.createDataFrame(pairs, "_p long, _o long"))  # a row per partition
    return part.join(offsets, "_p").withColumn("g", F.col("_o") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).select(*cols, "g")


def read_spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table, spread over all cores if its files come in fewer pieces than there are cores.

    A matter of how the files were written (the test tables are single row groups), so it belongs to reading; no operator does it.
    """
    table, cores = read_table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


def epoch_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since the epoch of a time column; one without zone counts as UTC, whatever the session's zone."""
    c = F.col(name)
    if df.schema[name].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(c.cast("timestamp"))
    seconds = F.datediff(c, F.lit("1970-01-01")).cast("long") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``rows`` rows; reads no more than that many."""
    return df.limit(rows + 1).count() <= rows


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str] | str, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Joins, broadcasting ``right`` only if a count shows at most ``rows`` rows; else a shuffled join under AQE.

    ``right`` should be a materialised or cheap table, since it is counted first.
    """
    return left.join(F.broadcast(right) if small(right, rows) else right, on, how)
