from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators import changes as C

KEYED = "root string, path string, token string, note string"


def frame(spark, rows):
    return spark.createDataFrame(rows, KEYED)


def got(df):
    return sorted(((r["root"], r["path"]) for r in df.collect()), key=str)


def test_changed_rows(spark):
    now = frame(spark, [("r", f"p{i}", f"s{i}", "x") for i in range(200)] + [("r", "new", "s", None), (None, "p", "s", ""), ("r", None, "s", ""), ("r", "void", None, "")])
    saved = frame(spark, [("r", f"p{i}", f"s{i}" if i != 7 else "old", "y") for i in range(200)] + [("r", "gone", "s", None), (None, "p", "s", ""), ("r", None, "s", ""), ("r", "void", None, "")])
    out = C.changed_rows(now, saved, ["root", "path"])
    assert got(out) == [("r", "new"), ("r", "p7"), ("r", "void")]
    assert {r["path"]: r["saved_token"] for r in out.collect()}["p7"] == "old"
    assert got(C.changed_rows(now.limit(0), saved, ["root", "path"])) == []
    assert len(got(C.changed_rows(saved, now.limit(0), ["root", "path"]))) == saved.count()


def test_descent_visits_only_changed_ranges(spark):
    now = frame(spark, [("r", f"p{i}", "s", "") for i in range(500)])
    saved = frame(spark, [("r", f"p{i}", "s" if i else "t", "") for i in range(500)])
    t = lambda d: C.tree(d, ["root", "path"], "token")
    assert C.changed_leaves(t(now), t(saved)).count() == 1
    assert C.changed_leaves(t(now), t(now.repartition(7))).count() == 0
    root = t(now).filter("level = 0").first()
    assert root["n"] == 500


KEYS = [("r", "p0"), ("r", "p1"), ("r", "p2"), ("r", "p30")]


def test_store_survives_failures(spark, tmp_path):
    store = C.MerkleStore(spark, f"file://{tmp_path}/s", ["root", "path"])
    assert store.output() is None
    run = store.start(frame(spark, [("r", f"p{i}", "a", "") for i in range(30)]))
    assert run.pending.count() == 30
    run.publish(run.pending.select("path"))
    v2 = frame(spark, [("r", f"p{i}", "a" if i > 2 else "b", "") for i in range(31)])
    run = store.start(v2)
    assert got(run.pending) == KEYS

    class Broken:
        @property
        def write(self):
            raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        run.publish(Broken())
    run = store.start(v2)
    assert got(run.pending) == KEYS
    run.publish(run.pending.select("path"))
    assert store.start(v2).pending.count() == 0 and store.output().count() == 34
    assert len(store.clean(older_s=0.0)) == 1 and store.output().count() == 34 and store.start(v2).pending.count() == 0  # the dead run's folder
    few = v2.filter("path <> 'p5'")
    run = store.start(few)
    assert run.pending.count() == 0
    run.publish(run.pending.select("path"))
    assert got(store.start(v2).pending) == [("r", "p5")] and store.output().count() == 34


def test_store_racing_publishers_and_late_rows(spark, tmp_path):
    from tessera.sources.versions import CommitConflict

    store = C.MerkleStore(spark, f"file://{tmp_path}/s", ["root", "path"])
    frame(spark, [("r", f"p{i}", "a", "") for i in range(5)]).write.parquet(f"{tmp_path}/in")
    now = spark.read.parquet(f"{tmp_path}/in")
    one, two = store.start(now), store.start(now)
    frame(spark, [("r", "late", "a", "")]).write.mode("append").parquet(f"{tmp_path}/in")  # arrives between pending and publish
    one.publish(one.pending.select("path"))
    with pytest.raises(CommitConflict):
        two.publish(two.pending.select("path"))
    assert store.output().count() == 5
    assert got(store.start(spark.read.parquet(f"{tmp_path}/in")).pending) == [("r", "late")]


def test_levels_grow_with_rows(spark, tmp_path, monkeypatch):
    assert [C.levels_for(n) for n in (0, 10**6, 10**8, 10**10)] == [4, 4, 5, 7]
    v1 = frame(spark, [("r", f"p{i}", "a", "") for i in range(40)])
    store = C.MerkleStore(spark, f"file://{tmp_path}/s", ["root", "path"])
    run = store.start(v1)
    run.publish(run.pending.select("path"))
    monkeypatch.setattr(C, "LEVELS", 5)
    run = store.start(v1.withColumn("token", F.when(F.col("path") == "p7", "b").otherwise(F.col("token"))))
    assert run.levels == 5 and got(run.pending) == [("r", "p7")]


def test_merge_latest_rewrites_touched_parts(spark, tmp_path):
    from tessera.sources.versions import PartedTable, merge_latest

    t = PartedTable(spark, f"file://{tmp_path}/t")
    df = lambda rows: spark.createDataFrame(rows, "k long, at long, v string")
    first = merge_latest(t, df([(i, 1, "x") for i in range(200)]), "k", "at", 16)
    second = merge_latest(t, df([(3, 2, "y"), (3, 1, "z"), (900, 1, "n")]), "k", "at")
    assert t.read().count() == 201 and t.read().filter("k = 3").select("at", "v").collect() == [(2, "y")]
    assert sum(first["parts"].get(p) != f for p, f in second["parts"].items()) <= 2
    assert merge_latest(t, df([]), "k", "at") == second


def test_files_to_index(spark):
    t = lambda d: datetime(2026, 1, d)
    h = lambda c: c * 12
    maps = [
        ("r", "same", "SHA256:" + "A" * 64, 1, t(5), t(5)), ("r", "same", h("b"), 1, t(4), t(9)), ("r", "diff", h("c"), 1, t(5), t(5)), ("r", "diff", h("c"), 1, t(5), t(6)), ("r", "null-old", None, 0, t(5), t(5)),
        ("r", "null-new", None, 1893456000, t(5), t(5)), ("r", "null-none", None, None, t(5), t(5)), ("r", "never", h("a"), 1, t(5), t(5)), ("r", "failed", h("a"), 1, t(5), t(5)), ("q", "same", h("a"), 1, t(5), t(5)),
    ]
    m = spark.createDataFrame(maps, "root string, path string, sha string, mtime long, scanned_at timestamp, loaded_at timestamp").selectExpr("*", "1 AS token")
    runs = spark.createDataFrame([(1, t(1), "ok"), (2, t(3), "ok"), (3, t(4), "failed"), (1, t(1), "ok")], "run_id long, started_at timestamp, status string")
    ch = [("r", "same", h("b"), 1), ("r", "same", h("a"), 2), ("r", "diff", h("b"), 2), ("r", "diff", h("c"), 3), ("r", "null-old", h("a"), 1), ("r", "null-new", h("a"), 1), ("r", "null-none", h("a"), 1), ("r", "failed", h("a"), 3), ("r", "gone", h("a"), 1)]
    c = spark.createDataFrame(ch + ch, "root string, path string, sha string, run_id long")
    out = {(r["root"], r["path"]): r["reason"] for r in C.files_to_index(m, c, runs).collect()}
    assert out == {("r", "diff"): "changed", ("r", "null-new"): "touched", ("r", "never"): "new", ("r", "failed"): "new", ("q", "same"): "new"}
    assert C.files_to_index(m.limit(0), c, runs).count() == 0
    assert C.files_to_index(m, c.limit(0), runs.limit(0)).count() == 8
