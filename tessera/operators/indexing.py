"""Building an index table incrementally, finding drift and validating."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drift(now: DataFrame, stored: DataFrame, keys: Sequence[str], token: str = "sha") -> DataFrame:
    """``keys, status``: added, deleted or changed records (a full outer join on the keys). A null token counts as changed; null keys join null keys."""
    keys = list(keys)
    a, b = now.select(*keys, F.col(token).alias("_t")).alias("a"), stored.select(*keys, F.col(token).alias("_t")).alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    j = a.withColumn("_a", F.lit(True)).alias("a").join(b.withColumn("_b", F.lit(True)).alias("b"), on, "full_outer")
    status = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "deleted").when(~F.coalesce(F.col("a._t") == F.col("b._t"), F.lit(False)), "changed")
    return j.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], status.alias("status")).filter("status is not null")


def reuse_embeddings(chunks: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(reused, to_embed)``: vectors whose (id, sha) is unchanged, and the chunks that need a new one.

    ``chunks``: id, sha and others; ``stored``: id, sha, vec.
    """
    reused = chunks.select("id", "sha").join(stored.select("id", "sha", "vec"), ["id", "sha"])
    return reused, chunks.join(stored.select("id", "sha"), ["id", "sha"], "left_anti")


def problems(chunks: DataFrame, vectors: DataFrame, files: DataFrame, dim: int, id_col: str = "id", names: Sequence[str] = ()) -> DataFrame:
    """One row for each check of an index: ``check, n`` with the number of offending records.

    Checks: chunks of unknown files, duplicated ids, vectors without chunk, chunks without vector, vectors of another dimension, vectors that are null.
    ``names`` are the columns that must be unique (the id column without them).
    """
    names = list(names) or [id_col]
    c, v = chunks.select(*dict.fromkeys([id_col, "path", *names])), vectors.select(id_col, "vec")

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")

    ids = c.select(id_col).distinct()
    parts = [
        count(c.join(files.select("path").distinct(), "path", "left_anti"), "unknown_file"), count(c.groupBy(*names).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1"), "duplicate_id"),
        count(v.select(id_col).distinct().join(ids, id_col, "left_anti"), "vector_without_chunk"), count(ids.join(v.select(id_col).distinct(), id_col, "left_anti"), "chunk_without_vector"),
        count(v.filter(F.size("vec") != dim), "other_dimension"), count(v.filter("vec is null"), "null_vector"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def systematic_sample(files: DataFrame, key: str, most: int = 20) -> DataFrame:
    """Every (n // most)-th of the n keys in their order, at most ``most``; used for a quick staleness test.

    Keys are range partitioned, so that sorting isn't the work of one task; a key's global rank is its rank in its partition plus the
    sizes of the partitions before.
    """
    from pyspark.sql import Window

    from tessera.session import materialise

    keys = files.select(key).distinct().repartitionByRange(key)
    keys = materialise(keys.withColumn("_p", F.spark_partition_id()), "keys")
    sizes = keys.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    n = keys.count()
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per partition
    ranked = keys.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1).join(F.broadcast(before), "_p").withColumn("_r", F.col("_r") + F.col("_before"))
    step = max(1, n // most)
    return ranked.filter((F.col("_r") % step == 0) & (F.col("_r") < step * most)).select(key)
