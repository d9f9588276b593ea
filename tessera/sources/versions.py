"""Tables in parts below a folder, changed by optimistic commits.

A generation is a file ``gen-<number>`` that names, for every part, the folder that holds it, and carries settings of the owner. A writer first writes new
folders, then creates the next generation's file, which fails if another writer was faster: readers see the old table or the new one, and no
commit is lost. Parts that a commit doesn't touch stay where they are.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import _hadoop_path, delete_path


class CommitConflict(RuntimeError):
    """Another writer has published since this one began."""


def create_file(spark: SparkSession, path: str, text: str, replace: bool = False) -> None:
    """Writes a small file in one step; without ``replace`` an existing one raises :class:`CommitConflict`."""
    jvm = spark._jvm
    fs, p = _hadoop_path(spark, path)
    _, tmp = _hadoop_path(spark, f"{p.getParent().toString()}/_next-{uuid.uuid4().hex}")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    opts = spark.sparkContext._gateway.new_array(rename, 1)
    opts[0] = rename.OVERWRITE if replace else rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(tmp, p, opts)
    except Exception as e:
        fs.delete(tmp, False)
        if not replace and fs.exists(p):
            raise CommitConflict(path) from e
        raise


def read_file(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None where there is none."""
    fs, p = _hadoop_path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


class PartedTable:
    """A table hashed into ``parts`` parts by the caller's column ``_part``; see the module for how it changes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def generation(self) -> int:
        """Number of the current generation; 0 before the first."""
        fs, p = _hadoop_path(self.spark, self.path)
        if not fs.exists(p):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return max([int(n[4:]) for n in names if n.startswith("gen-") and n[4:].isdigit()], default=0)

    def manifest(self, generation: int | None = None) -> dict:
        """``{"generation", "parts": {part: folder}, "settings"}`` of a generation (the current one)."""
        g = self.generation() if generation is None else generation
        text = read_file(self.spark, f"{self.path}/gen-{g:012d}") if g else None
        return json.loads(text) if text else {"generation": 0, "parts": {}, "settings": {}}

    def read(self, manifest: dict | None = None, parts: list[int] | None = None) -> DataFrame | None:
        """The rows of all parts, or of those given; None where no such part was written."""
        m = manifest or self.manifest()
        of = {int(k): v for k, v in m["parts"].items()}
        paths = [f"{self.path}/{of[k]}/_part={k}" for k in sorted(of) if parts is None or k in parts]
        return self.spark.read.parquet(*paths) if paths else None

    def write(self, rows: DataFrame) -> tuple[str, list[int]]:
        """Writes rows (with ``_part``) into a new folder; returns it and the parts that it holds. Nothing is visible before :meth:`commit`."""
        v = f"v-{uuid.uuid4().hex}"
        rows.hint("rebalance", F.col("_part")).write.partitionBy("_part").parquet(f"{self.path}/{v}")  # large parts are several tasks' work
        fs, p = _hadoop_path(self.spark, f"{self.path}/{v}")
        return v, sorted(int(s.getPath().getName()[6:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("_part="))

    def commit(self, base: dict, folders: dict[int, str | None], settings: dict) -> dict:
        """Publishes the generation after ``base`` with some parts replaced (None: emptied). Raises :class:`CommitConflict` if ``base`` is no longer current."""
        parts = {**base["parts"], **{str(k): v for k, v in folders.items()}}
        m = {"generation": base["generation"] + 1, "parts": {k: v for k, v in parts.items() if v is not None}, "settings": settings}
        _hadoop_path(self.spark, self.path)[0].mkdirs(_hadoop_path(self.spark, self.path)[1])
        if self.generation() != base["generation"]:
            raise CommitConflict(f"{self.path} is at generation {self.generation()}")
        create_file(self.spark, f"{self.path}/gen-{m['generation']:012d}", json.dumps(m))
        return m

    def clean(self, keep: int = 2, older_s: float = 86_400.0, also: set[str] | None = None) -> list[str]:
        """Deletes folders that neither the last ``keep`` generations nor ``also`` name and that are older than any running writer, and older generation files."""
        fs, p = _hadoop_path(self.spark, self.path)
        now = self.generation()
        live = set(also or ())
        for g in range(max(1, now - keep + 1), now + 1):
            live |= set(self.manifest(g)["parts"].values())
        gone = []
        for s in fs.listStatus(p) if fs.exists(p) else []:
            name, old = s.getPath().getName(), time.time() - s.getModificationTime() / 1000 >= older_s
            if old and (name.startswith("v-") and name not in live or name.startswith("gen-") and int(name[4:]) <= now - keep):
                delete_path(self.spark, f"{self.path}/{name}")
                gone.append(name)
        return gone


def merge_latest(target: PartedTable, changes: DataFrame, key: str, version: str, parts: int = 64) -> dict:
    """Merges changed records into the table, the greatest ``version`` of a key counting. Only parts that the changes touch are read and rewritten."""
    base = target.manifest()
    parts = base["settings"].get("parts", parts)
    marked = changes.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    touched = [r[0] for r in marked.select("_part").distinct().collect()]  # at most ``parts`` numbers
    if not touched:
        return base
    old = target.read(base, touched)
    both = marked if old is None else marked.unionByName(old.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")))
    cols = [c for c in changes.columns if c not in (key, version)]
    best = both.groupBy("_part", key).agg(F.max(F.struct(version, *cols)).alias("x")).select("_part", key, *[f"x.{c}" for c in (version, *cols)])
    v, written = target.write(best)
    return target.commit(base, {k: v for k in written}, {"parts": parts})
