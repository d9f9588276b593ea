"""A stored index: chunks, postings, statistics and vectors of one version, published together, and queries that read only what they need."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import indexing, retrieval
from tessera.session import _hadoop_path, small
from tessera.sources.versions import CommitConflict, create_file, read_file

SCHEMA_VERSION = 1
#: Seconds after which a writer's lock counts as abandoned (fixed value).
LOCK_STALE = 600


class LockHeld(RuntimeError):
    """Another writer holds the lock."""


class WriterLock:
    """An exclusive lock for writers: a file with the owner's token, created only if it isn't there and kept fresh while it is held.

    A lock that was not renewed for ``stale_after`` seconds is taken over by moving it away, which one taker alone can do; a taker that moved a fresh lock by
    mistake puts it back. Only its owner removes a lock.
    """

    def __init__(self, spark: SparkSession, path: str, stale_after: float = LOCK_STALE):
        self.spark, self.path, self.stale_after, self.token = spark, f"{path}/_LOCK", stale_after, uuid.uuid4().hex
        self.fs, self.file = _hadoop_path(spark, self.path)
        self._done = threading.Event()

    def _age(self) -> float:
        return time.time() - self.fs.getFileStatus(self.file).getModificationTime() / 1000

    def _steal(self) -> None:
        seen = read_file(self.spark, self.path)
        away = self.file.suffix(f"-{self.token}")
        if not self.fs.rename(self.file, away):
            return
        if read_file(self.spark, away.toString()) != seen:
            self.fs.rename(away, self.file)
            raise LockHeld(f"{self.path} was taken over by another writer")
        self.fs.delete(away, False)

    def acquire(self) -> None:
        self.fs.mkdirs(self.file.getParent())
        if self.fs.exists(self.file) and self._age() > self.stale_after:
            self._steal()
        try:
            create_file(self.spark, self.path, self.token)
        except CommitConflict as e:
            raise LockHeld(f"{self.path} is held by another writer") from e
        if self.stale_after > 0:
            threading.Thread(target=self._renew, daemon=True).start()

    def _renew(self) -> None:
        while not self._done.wait(self.stale_after / 4):
            if self.held():
                self.fs.setTimes(self.file, int(time.time() * 1000), -1)

    def held(self) -> bool:
        return read_file(self.spark, self.path) == self.token

    def check(self) -> None:
        """Raises :class:`LockHeld` if the lock was lost; called before anything is made visible."""
        if not self.held():
            raise LockHeld(f"{self.path} was lost to another writer")

    def release(self) -> None:
        self._done.set()
        if self.held():
            self.fs.delete(self.file, False)


@contextmanager
def writer_lock(spark: SparkSession, path: str, stale_after: float = LOCK_STALE) -> Iterator[WriterLock]:
    """Holds a :class:`WriterLock` for a block."""
    lock = WriterLock(spark, path, stale_after)
    lock.acquire()
    try:
        yield lock
    finally:
        lock.release()


class IndexStore:
    """Versions of an index below ``path``; the file ``CURRENT`` names the valid one with its settings.

    Tables: ``chunks`` (id, path, lang, header, text, sha and others), ``postings`` range partitioned and sorted by term, so that a query's term filter prunes row
    groups, ``files`` (path, sha, mtime), ``vectors`` (id, sha, vec) if an embedding function was given.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def meta(self) -> dict | None:
        """Settings of the current version; None if there is none or it can't be read."""
        fs, p = _hadoop_path(self.spark, f"{self.path}/CURRENT")
        if not fs.exists(p):
            return None
        try:
            return json.loads(read_file(self.spark, f"{self.path}/CURRENT") or "")
        except ValueError:
            return None

    def table(self, name: str) -> DataFrame:
        meta = self.meta()
        if meta is None:
            raise FileNotFoundError(f"no index at {self.path}")
        return self.spark.read.parquet(f"{self.path}/{meta['version']}/{name}")

    def build(self, chunks: DataFrame, files: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None, backend: str | None = None) -> dict:
        """Writes a new version and makes it current. Vectors whose (id, sha) is in the current version are reused; ``embed`` (chunks -> id, vec) makes the rest."""
        with writer_lock(self.spark, self.path) as lock:
            old = self.meta()
            v = f"v-{uuid.uuid4().hex}"
            at = f"{self.path}/{v}"
            chunks.write.parquet(f"{at}/chunks")
            c = self.spark.read.parquet(f"{at}/chunks")
            marked = retrieval.postings(c, "id", F.col("header"), F.col("text"), mark=True)  # one pass gives the postings and, under the term '', a row for each chunk
            marked.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(f"{at}/postings")
            files.select("path", "sha", "mtime").write.parquet(f"{at}/files")
            reused = 0
            if embed is not None:
                todo = c
                if old and old.get("backend") == backend and old.get("embeddings") == "present":
                    kept, todo = indexing.reuse_embeddings(c, self.spark.read.parquet(f"{self.path}/{old['version']}/vectors"))
                    kept.select("id", "sha", "vec").write.parquet(f"{at}/vectors")
                    reused = self.spark.read.parquet(f"{at}/vectors").count()
                embed(todo).join(c.select("id", "sha"), "id").select("id", "sha", "vec").write.mode("append").parquet(f"{at}/vectors")
            s = self.spark.read.parquet(f"{at}/postings").filter("term = ''").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl")).first()
            stats = {"n": s["n"], "avgdl": s["avgdl"]}
            meta = {"schema": SCHEMA_VERSION, "version": v, "chunk_count": c.count(), "backend": backend, "embeddings": "present" if embed else "absent", "reused": reused, **stats}
            lock.check()
            create_file(self.spark, f"{self.path}/CURRENT", json.dumps(meta), replace=True)
        return meta

    def problems(self) -> list[str]:
        """What is wrong with the current version: no settings, another schema, missing tables, counts that differ."""
        meta = self.meta()
        if meta is None:
            return ["no readable settings"]
        out = [] if meta.get("schema") == SCHEMA_VERSION else [f"schema {meta.get('schema')} instead of {SCHEMA_VERSION}"]
        n = {}
        for name in ("chunks", "postings", "files", *(["vectors"] if meta.get("embeddings") == "present" else [])):
            try:
                n[name] = self.table(name).count()
            except Exception:  # noqa: BLE001
                out.append(f"no readable table {name}")
        if "chunks" in n and n["chunks"] != meta.get("chunk_count"):
            out.append(f"{n['chunks']} chunks instead of {meta.get('chunk_count')}")
        if "vectors" in n and "chunks" in n and n["vectors"] != n["chunks"]:
            out.append(f"{n['vectors']} vectors for {n['chunks']} chunks")
        return out

    def stale(self, files: DataFrame, sample: int | None = None) -> DataFrame:
        """``path, status`` of files added, deleted or changed since the build; with ``sample``, only of so many stored files."""
        stored = self.table("files")
        if sample:
            keys = indexing.systematic_sample(stored, "path", sample)
            stored, files = stored.join(F.broadcast(keys), "path", "left_semi"), files.join(F.broadcast(keys), "path", "left_semi")  # at most ``sample`` keys
        return indexing.drift(files, stored, ["path"])

    def search(self, queries: DataFrame, k: int = 8, priors: bool = True) -> DataFrame:
        """``query_id, id, score, rank`` by BM25 from the stored postings; ``queries``: query_id, query.

        Few query terms become a filter on the sorted postings that the scan pushes down; many are joined.
        """
        meta = self.meta()
        qt = retrieval.query_terms(queries, "query_id", "query")
        wanted = qt.select("term").distinct()
        post = self.table("postings")
        if small(wanted, 1000):
            terms = [r["term"] for r in wanted.collect()]  # at most 1,000
            post = post.filter(F.col("term").isin(terms)) if terms else post.limit(0)
        else:
            post = post.join(wanted, "term", "left_semi")
        scored = retrieval.score_postings(post, qt, F.lit(float(meta["n"])), F.lit(float(meta["avgdl"])))
        if not priors:
            return retrieval.top_k(scored, k)
        cut = retrieval.top_k(scored, retrieval.fetch_size(k)).drop("rank")
        return retrieval.top_k(retrieval.apply_priors(cut, self.table("chunks").select("id", "path", "lang")), k)
