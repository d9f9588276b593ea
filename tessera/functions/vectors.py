"""Column expressions over arrays of numbers, in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import tokens

HASH_DIM = 256


class BackendUnavailable(RuntimeError):
    """No embedding backend of that name is registered."""


#: Embedding backends: name to dimension and a function (table, id column, text) -> ``id, vec`` (unit vectors, array<double>).
BACKENDS: dict[str, tuple[int, Callable[[DataFrame, str, Column], DataFrame]]] = {}


def register_backend(name: str, dim: int, embed: Callable[[DataFrame, str, Column], DataFrame]) -> None:
    BACKENDS[name] = (dim, embed)


def get_backend(name: str) -> tuple[int, Callable[[DataFrame, str, Column], DataFrame]]:
    if name not in BACKENDS:
        raise BackendUnavailable(f"no embedding backend {name!r}; there are: {', '.join(sorted(BACKENDS))}")
    return BACKENDS[name]


def embed_text(header: Column, text: Column) -> Column:
    """What is embedded of a chunk: header, line end, text; null parts count as empty."""
    return F.concat(F.coalesce(header, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))


def as_doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalise(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is, an empty one empty, null null."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def hash_embedding(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """``id, bucket, value``: feature-hashed token counts in 256 dimensions, only non-zero ones.

    A token's bucket is the first byte of its MD5, its sign that of the fifth byte (odd: minus).
    """
    t = df.select(F.col(id_col), F.explode(tokens(text)).alias("t")).withColumn("h", F.md5("t"))
    bucket = F.conv(F.substring("h", 1, 2), 16, 10).cast("int")
    odd = F.conv(F.substring("h", 10, 1), 16, 10).cast("int") % 2 == 1
    summed = t.groupBy(id_col, bucket.alias("bucket")).agg(F.sum(F.when(odd, -1).otherwise(1)).cast("double").alias("value"))
    return summed.filter("value <> 0")


def hash_vectors(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """``id, vec``: the feature hashes of every text as a unit vector of 256 values; texts without a token have zeros."""
    # the length comes from the aggregation: within a transform it would be computed again for every element
    values = hash_embedding(df, id_col, text).groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("m"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("r"))  # at most 256 entries
    dense = F.transform(F.sequence(F.lit(0), F.lit(HASH_DIM - 1)), lambda b: F.coalesce(F.try_element_at("m", b) / F.col("r"), F.lit(0.0)))
    return df.select(id_col).distinct().join(values, id_col, "left").select(F.col(id_col).alias("id"), dense.alias("vec"))


register_backend("hash", HASH_DIM, hash_vectors)
