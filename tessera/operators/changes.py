"""Finding what changed since the last successful run, with a Merkle tree over key-range hashes.

Two sides hold ``(key columns, token)``: what is there now and what was processed last. Keys are hashed
into equal ranges of a 32-bit key space; the range number at level L is the first ``bits * L`` bits. A leaf's digest
is an order-free sum over its rows, so it is built by partial aggregation on the map side and no group is
ever collected; upper digests sum their children's. Comparison starts at the root and descends a level only
below nodes whose digests differ, and only rows of changed leaves are compared one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import checked_join, epoch_micros, materialise
from tessera.sources.versions import PartedTable

#: Bits of the key hash that each tree level adds, and levels below the root at least and at most; rows that a leaf should hold on average.
LEVEL_BITS = 4
LEVELS, MOST_LEVELS, LEAF_ROWS = 4, 8, 256
#: Level whose nodes are the parts in which a store keeps its state.
PART_LEVEL = 2


def levels_for(rows: int, bits: int = LEVEL_BITS) -> int:
    """Levels for so many rows: leaves keep some LEAF_ROWS rows however large the table, so that few changes open few rows."""
    level = LEVELS
    while level < MOST_LEVELS and rows > LEAF_ROWS << (bits * level):
        level += 1
    return level


def key_hash(keys: Sequence[str]) -> Column:
    """A 63-bit hash of the key columns; null and empty keys differ."""
    return F.xxhash64(*[F.concat(F.length(F.col(k)).cast("string"), F.lit(":"), F.col(k)) for k in keys], *[F.col(k).isNull() for k in keys]).bitwiseAND(F.lit((1 << 63) - 1))


def leaf_range(keys: Sequence[str], bits: int = LEVEL_BITS, levels: int = LEVELS) -> Column:
    return F.shiftright(key_hash(keys), 63 - bits * levels).cast("long")


def tree(rows: DataFrame, keys: Sequence[str], token: str, bits: int = LEVEL_BITS, levels: int = LEVELS) -> DataFrame:
    """``(level, node, digest, n)`` for every non-empty node, from the root (level 0) to the leaves.

    The digest is the sum, modulo 2**64 in two halves, of row hashes over keys and token; equal contents give
    equal digests whatever the row order or partitioning. An empty side has no nodes.
    """
    row = F.xxhash64(key_hash(keys), F.col(token), F.col(token).isNull())
    leaves = rows.select(leaf_range(keys, bits, levels).alias("node"), F.shiftright(row, 32).alias("hi"), row.bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo"))
    leaves = leaves.groupBy("node").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo"), F.count(F.lit(1)).alias("n"))
    per_level = F.explode(F.array(*[F.struct(F.lit(v).alias("level"), F.shiftright(F.col("node"), bits * (levels - v)).alias("node")) for v in range(levels + 1)]))
    nodes = leaves.select(per_level.alias("x"), "hi", "lo", "n").groupBy("x.level", "x.node").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo"), F.sum("n").alias("n"))
    return nodes.select("level", "node", F.concat_ws(".", F.hex("hi"), F.hex("lo")).alias("digest"), "n")


def changed_leaves(now: DataFrame, saved: DataFrame, levels: int = LEVELS, bits: int = LEVEL_BITS) -> DataFrame:
    """Leaf numbers whose digests differ, found by descending from the root only below differing nodes.

    ``now`` and ``saved`` are outputs of :func:`tree`. A node missing on one side differs.
    """
    a = now.select("level", "node", F.col("digest").alias("d1"))
    b = saved.select("level", "node", F.col("digest").alias("d2"))
    differ = a.join(b, ["level", "node"], "full_outer").filter(~F.col("d1").eqNullSafe(F.col("d2"))).select("level", "node")
    open_nodes = differ.filter("level = 0").select("node")
    for level in range(1, levels + 1):
        below = differ.filter(F.col("level") == level).select("node", F.shiftright("node", bits).alias("up"))
        open_nodes = below.join(open_nodes.select(F.col("node").alias("up")), "up", "left_semi").select("node")
    return open_nodes


def changed_rows(now: DataFrame, saved: DataFrame, keys: Sequence[str], token: str = "token", bits: int = LEVEL_BITS, levels: int = LEVELS, saved_tree: DataFrame | None = None) -> DataFrame:
    """Rows of ``now`` that are new or whose token differs from the saved one, each key once.

    ``now`` and ``saved`` have one row per key. A null token never equals anything: such a row counts as
    changed. Rows only in ``saved`` (deleted keys) do not come out. Extra columns of ``now`` are kept; those of
    ``saved`` come out with the prefix ``saved_``. Only rows in changed leaves are joined.
    """
    keys = list(keys)
    never = F.when(F.col(token).isNull(), F.lit("\u0000null")).otherwise(F.col(token).cast("string"))
    t1 = materialise(tree(now.select(*keys, never.alias("_token")), keys, "_token", bits, levels), "tree")
    t2 = saved_tree if saved_tree is not None else materialise(tree(saved.select(*keys, F.col(token).cast("string").alias("_token")), keys, "_token", bits, levels), "tree")
    leaves = materialise(changed_leaves(t1, t2, levels, bits), "leaves").withColumnRenamed("node", "_leaf")
    mark = leaf_range(keys, bits, levels)
    left = checked_join(now.withColumn("_leaf", mark), leaves, "_leaf", "left_semi").drop("_leaf")
    right = saved.select(*keys, *[F.col(c).alias(f"saved_{c}") for c in saved.columns if c not in keys])
    right = checked_join(right.withColumn("_leaf", mark), leaves, "_leaf", "left_semi").drop("_leaf", "_there").withColumn("_there", F.lit(True))
    l, r = left.alias("l"), right.alias("r")
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    joined = l.join(r, on, "left").filter(F.col("r._there").isNull() | F.col(f"l.{token}").isNull() | ~F.col(f"l.{token}").eqNullSafe(F.col(f"r.saved_{token}")))
    return joined.select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in (*keys, "_there")], F.col("r._there").isNull().alias("is_new"))


class MerkleStore:
    """What was processed so far: keys and tokens with their tree, and the output of all runs, published together.

    :meth:`start` takes one snapshot of the input; a run's pending rows, tree and state all come from it, so rows that arrive later are neither lost nor marked as done.
    :meth:`Run.publish` writes the run's output, its tree and the state of those key ranges that changed, then commits the next generation, which
    fails if another run has published since this one started. A run that dies leaves only unnamed folders (:meth:`clean` removes them), and the next one
    starts from the old tree: nothing is skipped, nothing is done twice. :meth:`output` is the output of all runs.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], token: str = "token", bits: int = LEVEL_BITS, levels: int | None = None):
        self.spark, self.path, self.keys, self.token, self.bits, self.levels = spark, path.rstrip("/"), list(keys), token, bits, levels
        self.table = PartedTable(spark, path)

    def start(self, now: DataFrame) -> Run:
        return Run(self, now)

    def output(self) -> DataFrame | None:
        """All runs' output, None before the first; runs may add columns, missing ones are null."""
        out = None
        for v in self.table.manifest()["settings"].get("outputs", []):
            part = self.spark.read.parquet(f"{self.path}/{v}")
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def clean(self, keep: int = 2, older_s: float = 86_400.0) -> list[str]:
        """Removes folders of dead runs and of states that no longer count; outputs stay."""
        s = self.table.manifest()["settings"]
        live = {*s.get("outputs", []), *([s["tree"]] if "tree" in s else [])}
        return self.table.clean(keep, older_s, {v.split("/")[0] for v in live})


class Run:
    """One run over a snapshot; ``pending`` has the rows that no published run covers."""

    def __init__(self, store: MerkleStore, now: DataFrame):
        self.store, self.now = store, materialise(now, "snapshot")
        self.base = store.table.manifest()
        settings = self.base["settings"]
        self.levels = store.levels or max(levels_for(self.now.count(), store.bits), settings.get("levels", 0))
        self.keyed = self.now.select(*store.keys, F.col(store.token).cast("string").alias("_token"))
        self.tree = materialise(tree(self.keyed, store.keys, "_token", store.bits, self.levels), "tree")
        state = store.table.read(self.base)
        if state is None:
            self.saved_tree = None
            self.pending = self.now.withColumn(f"saved_{store.token}", F.lit(None).cast(self.now.schema[store.token].dataType)).withColumn("is_new", F.lit(True))
            return
        state = state.drop("_part")
        if settings["levels"] == self.levels:
            self.saved_tree = store.spark.read.parquet(f"{store.path}/{settings['tree']}")
        else:  # the table has grown by a level
            self.saved_tree = materialise(tree(state.select(*store.keys, F.col(store.token).cast("string").alias("_token")), store.keys, "_token", store.bits, self.levels), "tree")
        self.pending = changed_rows(self.now, state, store.keys, store.token, store.bits, self.levels, saved_tree=self.saved_tree)

    def publish(self, output: DataFrame) -> dict:
        """Publishes the run's output with the snapshot's state; raises :class:`CommitConflict` if another run was faster."""
        s = self.store
        part = leaf_range(s.keys, s.bits, PART_LEVEL)
        if self.saved_tree is None:
            rows, touched = self.now, None
        else:
            up = F.shiftright("node", s.bits * (self.levels - PART_LEVEL)).cast("long")
            touched = [r[0] for r in changed_leaves(self.tree, self.saved_tree, self.levels, s.bits).select(up.alias("p")).distinct().collect()]  # at most 2**(bits * PART_LEVEL)
            rows = self.now.filter(part.isin(touched)) if touched else self.now.limit(0)
        v, written = s.table.write(rows.select(*s.keys, s.token, part.cast("int").alias("_part")))
        output.write.parquet(f"{s.path}/{v}/output")
        self.tree.write.parquet(f"{s.path}/{v}/tree")
        folders: dict[int, str | None] = {int(k): None for k in (self.base["parts"] if touched is None else touched)} | {k: v for k in written}
        outputs = [*self.base["settings"].get("outputs", []), f"{v}/output"]
        return s.table.commit(self.base, folders, {"levels": self.levels, "tree": f"{v}/tree", "outputs": outputs})


def norm_sha(c: Column) -> Column:
    """The first 12 hex digits of a content hash, whatever its case, blanks or ``sha256:`` prefix; else null."""
    hexes = F.regexp_extract(F.lower(c), r"^\s*(?:sha-?256:)?\s*([0-9a-f]{12,})\s*$", 1)
    return F.when(hexes != "", F.substring(hexes, 1, 12))


def current_files(code_map: DataFrame) -> DataFrame:
    """One row per file: ``root, path, token`` (12 hex digits or null) and ``mtime`` of the scan made last.

    Rows of one scan delivered twice count once; of equal scan times the one loaded last wins.
    """
    pick = F.max_by(F.struct("sha", "mtime"), F.struct("scanned_at", "loaded_at", "sha", "mtime")).alias("x")
    return code_map.groupBy("root", "path").agg(pick).select("root", "path", norm_sha(F.col("x.sha")).alias("token"), F.col("x.mtime").alias("mtime"))


def indexed_files(chunks: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per file that a successful run wrote: ``root, path, token, started_at`` of the run started last."""
    ok = runs.filter("status = 'ok'").select("run_id", "started_at").dropDuplicates(["run_id"])
    written = chunks.groupBy("root", "path", "run_id").agg(F.max("sha").alias("sha"))
    last = F.max_by(F.struct("sha", "started_at"), F.struct("started_at", "run_id")).alias("x")
    return written.join(ok, "run_id").groupBy("root", "path").agg(last).select("root", "path", norm_sha(F.col("x.sha")).alias("token"), F.col("x.started_at").alias("started_at"))


def files_to_index(code_map: DataFrame, chunks: DataFrame, runs: DataFrame) -> DataFrame:
    """Files whose current content no successful run has indexed, each once: ``root, path, reason``.

    Reasons: ``new`` (no successful run wrote it), ``changed`` (the hashes differ), ``touched`` (the current hash is
    unknown and the file is younger than the run). A current hash that is null or unreadable is unknown; with a null
    ``mtime`` such a file that was indexed is no case. Files missing from the map are none. Empty tables give no rows
    (an empty map) or every file (no chunks).
    """
    now, saved = materialise(current_files(code_map), "now"), materialise(indexed_files(chunks, runs), "saved")  # a row per file each, read twice
    pending = changed_rows(now, saved, ["root", "path"], levels=levels_for(now.count()))
    run_s = epoch_micros(pending, "saved_started_at") / F.lit(1e6)
    reason = F.when(F.col("is_new"), "new").when(F.col("token").isNotNull(), "changed").when(F.col("mtime") > run_s, "touched")
    return pending.select("root", "path", reason.alias("reason")).filter("reason is not null")
