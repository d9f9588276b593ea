import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.operators import accounting, chunking
from tessera.sources import files, logs, sinks
from tessera.streaming import jobs


def test_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_bytes(b"def f():\n    pass\n# caf\xc3\xa9 \xff end\n")
    (tmp_path / "src/bin.js").write_bytes(b"a\x00b")
    (tmp_path / "src/data.bin").write_bytes(b"zz")
    (tmp_path / "src/big.py").write_bytes(b"x" * 600_000)
    (tmp_path / "node_modules/b.js").write_bytes(b"var a")
    (tmp_path / "README.md").write_text("# Hi\n")
    f = files.scan_files(spark, str(tmp_path))
    out = {r["path"]: r for r in f.collect()}
    assert set(out) == {"src/a.py", "README.md"} and out["src/a.py"]["text"].endswith("café  end\n") and out["README.md"]["lang"] == "markdown"
    s = chunking.python_symbols(f.filter("lang = 'python'")).drop("engine")
    m = files.code_map(f, s)
    assert {r["path"]: len(r["symbols"]) for r in m.collect()} == {"src/a.py": 1, "README.md": 0}
    text = {r["section"]: r["text"] for r in files.render_map(m).collect()}
    assert "- **src/a.py**\n  - `f` (function) L1-2" in text["src"] and "." in text
    only = spark.createDataFrame([("README.md",)], "path string")
    assert files.scan_files(spark, str(tmp_path), tracked=only).count() == 1


def test_logs(spark, tmp_path):
    ev = [
        {"type": "user", "sessionId": "s", "cwd": "/w", "uuid": "1", "timestamp": "t", "message": {"content": "hello"}},
        {"type": "assistant", "uuid": "2", "model": "m-opus", "message": {"model": "opus-x", "usage": {"input_tokens": 5, "output_tokens": None}, "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}, {"type": "tool_use", "id": "c", "name": "Read", "input": {"file_path": "f"}}]}},
        {"type": "user", "uuid": "3", "message": {"content": [{"type": "tool_result", "tool_use_id": "c", "content": [{"type": "text", "text": "x"}, {"type": "text", "text": "y"}]}]}},
        {"type": "summary", "summary": "sum"}, {"type": "other"},
    ]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.jsonl").write_text("\n".join(json.dumps(e) for e in ev) + "\nnot json\n\n")
    (tmp_path / "d/b.txt").write_text("{}")
    lines = logs.jsonl(spark, str(tmp_path))
    assert lines.count() == 5
    t = [r for r in logs.transcript(lines).orderBy("at").collect()]
    assert [(r["kind"], r["text"]) for r in t] == [("user", "hello"), ("assistant", "a\nb"), ("user", ""), ("summary", "sum")]
    assert t[1]["tool_calls"][0]["name"] == "Read" and json.loads(t[1]["tool_calls"][0]["input"]) == {"file_path": "f"} and t[2]["tool_results"][0]["output"] == "x\ny"
    u = accounting.usage_totals(logs.usage_events(lines)).collect()
    assert [(r["model"], r["input"], r["output"]) for r in u] == [("opus-x", 5, 0)]
    assert logs.latest_transcript(spark, str(tmp_path)).first()["path"].endswith("a.jsonl")


def test_evaluation_sources(spark, tmp_path):
    for name, data in {"map": {"a": True, "b": False}, "object": {"resolved": ["a"], "x": 1}, "list": [{"instance_id": "a", "resolved": True}, {"instance_id": "b"}]}.items():
        p = tmp_path / f"{name}.json"
        p.write_text(json.dumps(data))
        got = {r["instance_id"]: r["resolved"] for r in logs.verdicts(spark, str(p)).collect()}
        assert got == ({"a": True} if name == "object" else {"a": True, "b": False})
    (tmp_path / "u.csv").write_text("instance_id,arm,model,input_tokens,output_tokens,cache_read_tokens,cache_write_tokens,cost_usd,num_turns,wall_s,index_wall_s,patch_bytes,error\ni,a,m,12.0,,x,1,0.5,,,,,\n")
    r = logs.usage_csv(spark, str(tmp_path / "u.csv")).first()
    assert (r["input_tokens"], r["output_tokens"], r["cache_read_tokens"], r["cost_usd"]) == (12, 0, 0, 0.5)
    (tmp_path / "i.json").write_text(json.dumps([{"instance_id": "1", "lang": "go"}, {"instance_id": "2", "repo_language": "", "language": None}]))
    assert [x["language"] for x in logs.instances(spark, str(tmp_path / "i.json")).orderBy("instance_id").collect()] == ["go", "unknown"]
    (tmp_path / "g.jsonl").write_text(json.dumps({"repo": "r", "query": "q", "type": "t", "relevant": [{"path": "p"}]}) + "\n")
    assert logs.golden(spark, str(tmp_path / "g.jsonl"), ["r"]).first()["relevant"][0]["symbols"] is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k long, v string")
    p = f"file://{tmp_path}/new"
    assert sinks.append_new(df, p, "k") == 2 and sinks.append_new(df, p, "k") == 0
    q = f"file://{tmp_path}/pub"
    assert sinks.current(spark, q) is None
    sinks.publish(df, q)
    sinks.publish(df.limit(1), q)
    assert sinks.current(spark, q).count() == 1
    sinks.append_csv(df, f"file://{tmp_path}/csv")
    sinks.append_usage(df, f"file://{tmp_path}/json")
    assert "| k | v |" in sinks.markdown(df, "T") and "<b style" in sinks.html_bars(df, "v", "k", "T")


def test_states_predictions_and_checkpoints(spark, tmp_path):
    base = f"file://{tmp_path}"
    assert sinks.load_state(spark, f"{base}/state", {"last": 0.0}) == {"last": 0.0}
    sinks.save_state(spark, f"{base}/state", {"last": 5.0})
    sinks.save_state(spark, f"{base}/state", {"last": 10.0})
    assert sinks.load_state(spark, f"{base}/state", {}) == {"last": 10.0}
    (tmp_path / "bad").write_text("{")
    assert sinks.load_state(spark, f"{base}/bad", {"last": 1.0}) == {"last": 1.0}
    one = spark.createDataFrame([("b", "x")], "instance_id string, patch string")
    assert json.loads(sinks.append_prediction(one, f"{base}/pred", "instance_id")) == [{"instance_id": "b", "patch": "x"}]
    two = spark.createDataFrame([("a", "y")], "instance_id string, patch string")
    assert [x["instance_id"] for x in json.loads(sinks.append_prediction(two, f"{base}/pred", "instance_id"))] == ["a", "b"]
    c = lambda text: spark.createDataFrame([("s", text)], "session_id string, checkpoint string")
    sinks.write_checkpoints(c("first"), f"{base}/cp", 100)
    sinks.write_checkpoints(c("second"), f"{base}/cp", 200)
    assert sinks.current(spark, f"{base}/cp/current").first()["checkpoint"] == "second" and spark.read.parquet(f"{base}/cp/archive").count() == 2
    assert "… and 3 more rows" in sinks.markdown(spark.range(5).toDF("k"), "T", 2)


def test_git_listing_and_json_map(spark, tmp_path):
    import shutil
    import subprocess

    if not shutil.which("git"):
        return
    (tmp_path / "tree").mkdir()
    for name, text in (("a.py", "x = 1\n"), ("b.py", "y = 1\n"), ("skip.py", "z = 1\n"), (".gitignore", "skip.py\n")):
        (tmp_path / "tree" / name).write_text(text)
    subprocess.run(["git", "init", "-q", str(tmp_path / "tree")], check=True)
    subprocess.run(["git", "-C", str(tmp_path / "tree"), "add", "a.py"], check=True)
    listed = files.git_listing(spark, f"file://{tmp_path}/tree")
    assert {r["path"] for r in listed.collect()} == {"a.py", "b.py", ".gitignore"}
    f = files.scan_files(spark, f"{tmp_path}/tree", tracked=listed)
    assert {r["path"] for r in f.collect()} == {"a.py", "b.py"}
    assert files.git_listing(spark, f"{tmp_path}/none") is None
    m = files.code_map(f, chunking.python_symbols(f).drop("engine"))
    assert {json.loads(r["json"])["path"] for r in files.json_map(m).collect()} == {"a.py", "b.py"}


def test_hook_events_and_prefilter(spark, tmp_path):
    (tmp_path / "h").mkdir()
    lines = ['{"hook_event_name": "PreCompact", "cwd": "/w", "session_id": "s"}', "noise", '{"hook_event_name": "Other"}', '{"hook_event_name": "SessionStart", "source": "clear"}', '{"message": {"model": "m"}}']
    (tmp_path / "h/e.jsonl").write_text("\n".join(lines))
    out = jobs.run_available(jobs.hook_events(spark, f"file://{tmp_path}/h")).orderBy("event").collect()
    assert [(r["event"], r["cwd"], r["trigger"], r["source"]) for r in out] == [("PreCompact", "/w", "auto", "startup"), ("SessionStart", ".", "auto", "clear")]
    assert logs.jsonl(spark, f"{tmp_path}/h", having='"model"').count() == 1 and logs.jsonl(spark, f"{tmp_path}/h").count() == 4
    (tmp_path / "v.json").write_text("no json")
    assert logs.verdicts(spark, str(tmp_path / "v.json")).count() == 0


def test_restorable_checkpoints(spark, tmp_path):
    t0 = datetime(2026, 1, 1)
    rows = [(1, t0, "w", "a"), (2, t0 + timedelta(days=6), "r", "a"), (3, t0 + timedelta(days=8), "r", "a"), (4, t0 + timedelta(days=5), "w", "a"), (5, t0, "r", "b"), (6, t0 + timedelta(days=20), "r", "a")]
    p = f"{tmp_path}/ev"
    spark.createDataFrame(rows, "start_id long, ts timestamp_ntz, what string, k string").write.parquet(p)
    e = lambda w: jobs.event_stream(spark, p).filter(F.col("what") == w)
    out = jobs.latest_per_start(jobs.run_available(jobs.restorable_checkpoints(e("r"), e("w"), "k")))
    assert {r["start_id"]: r["checkpoint_at"].day for r in out.collect()} == {2: 6, 3: 6}


def test_times_without_zone_ignore_the_session(spark):
    from tessera.session import epoch_micros

    df = spark.sql("SELECT TIMESTAMP_NTZ'2026-03-29 02:30:00.123456' AS t, TIMESTAMP'2026-03-29 02:30:00.5Z' AS z")
    try:
        for zone in ("UTC", "Europe/Berlin", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert tuple(df.select(epoch_micros(df, "t"), epoch_micros(df, "z")).first()) == (1774751400123456, 1774751400500000)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_streams(spark, tmp_path):
    t0 = datetime(2026, 1, 1)
    rows = [(i, t0 + timedelta(seconds=7 * i), "u" if i % 3 else "w", float(i)) for i in range(60)]
    p = f"{tmp_path}/ev"
    spark.createDataFrame(rows, "e long, ts timestamp_ntz, k string, v double").repartition(3).write.parquet(p)
    s = jobs.event_stream(spark, p)
    limited = {r["e"]: (r["n"], r["rejected"]) for r in jobs.run_available(jobs.rate_limiter(s, "k", "e", 3, 60)).collect()}
    for i, ts, k, _ in rows:
        n = sum(1 for j, t, kk, _ in rows if kk == k and t <= ts and ts - t < timedelta(seconds=60))
        assert limited[i] == (n, n > 3)
    tumbled = jobs.run_available(jobs.tumbling_usage(s, "k", "v", "1 minute"), "complete")
    assert tumbled.agg(F.sum("n")).first()[0] == 60
    assert jobs.run_available(jobs.first_seen(s, ["k"])).count() == 2
    assert jobs.run_available(jobs.sessions(s, "k", "5 minutes"), "complete").agg(F.sum("n")).first()[0] == 60
    target = f"file://{tmp_path}/index"
    out = jobs.upsert_index(s.select("k", "ts", "v"), target, "k", "ts")
    assert {r["k"]: r["v"] for r in out.collect()} == {"u": 59.0, "w": 57.0}


def test_queries_and_sql_have_the_same_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
