import random
import textwrap

from hypothesis import given, settings
from hypothesis import strategies as st
import pytest
from pyspark.sql import functions as F

from tessera.operators import abtest, accounting, chunking, distill, evaluation, indexing, limits, retrieval, routing


def test_impact_golden_numbers(spark):
    t = spark.createDataFrame([("opus", 2_000_000, 600_000, 15_000_000, 1_500_000)], "model string, input long, output long, cache_read long, cache_write long")
    r = accounting.impact(t).first()
    assert abs(r["actual_cost"] - 41.875) < 1e-9 and abs(r["energy_wh"] - 1225) < 1e-6 and abs(r["saved_cost"] - 204.375) < 1e-9 and abs(r["saved_energy_wh"] - 1387.5) < 1e-6
    assert accounting.impact(t.limit(0)).first()["actual_cost"] == 0.0


def test_savings_and_bloat(spark):
    u = spark.createDataFrame([(1000, 500, 4000), (1000, 300, 1300), (0, 9, 9)], "when long, chunk_tokens long, whole_file_tokens long")
    r = accounting.retrieval_savings(accounting.in_window(u, "when", 1000 + 86400, "1")).first()
    assert (r["queries"], r["tokens_avoided"], round(r["est_cost_avoided"], 6)) == (2, 4500, 0.0225)
    assert accounting.retrieval_savings(u.limit(0)).count() == 0
    t = spark.createDataFrame([("s", "Summary ", None), ("s", "user", [("1", "é" * 10), ("2", None)]), ("t", None, []), (None, "user", None)], "session_id string, kind string, tool_results array<struct<id:string,output:string>>")
    b = accounting.context_bloat(t).first()
    assert (b["sessions"], b["compacted_sessions"], b["tool_results"], b["tool_output_tokens"], b["avg_tool_output_tokens_per_session"]) == (2, 1, 2, 5, 2)


def test_rrf_by_hand(spark):
    df = lambda ids: spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(ids)], "query_id long, id string, rank int")
    out = {r["id"]: r["score"] for r in retrieval.rrf((df(["a", "b"]), 1.0), (df(["b", "c"]), 1.0)).collect()}
    assert out == {"a": round(1 / 61, 9), "b": round(1 / 62 + 1 / 61, 9), "c": round(1 / 62, 9)}


def test_priors_and_search(spark):
    docs = spark.createDataFrame([("t", "tests/a.py", "python", "", "retry handler retry"), ("c", "src/a.py", "python", "", "retry handler retry"), ("m", "doc.md", "markdown", None, None), ("z", "z.py", None, "other", "")], "id string, path string, lang string, header string, text string")
    q = spark.createDataFrame([(1, "retry_handler"), (2, ""), (3, None)], "query_id long, query string")
    out = retrieval.search(docs, q, mode="hybrid").collect()
    assert [(r["id"], r["degraded"]) for r in sorted(out, key=lambda r: r["rank"])] == [("c", True), ("t", True)]
    assert retrieval.search(docs.limit(0), q).count() == 0 and retrieval.search(docs, q.limit(0)).count() == 0
    assert [(r["id"], r["degraded"], r["reason"]) for r in retrieval.search(docs, q, mode="vector").orderBy("rank").collect()] == [("c", True, "no vectors"), ("t", True, "no vectors")]
    assert retrieval.search(docs, q, mode="vector", vector=spark.createDataFrame([], "query_id long, id string, score double")).count() == 0
    plain = docs.filter("lang = 'python'").select("path", "lang", F.lit("def retry():\n    return handler\n").alias("text"))
    assert [r["degraded"] for r in retrieval.ephemeral_search(plain, q, 1).collect()] == [True]
    with pytest.raises(ValueError):
        retrieval.ephemeral_search(plain, q, 1, most_files=1)


def test_cosine_blocks(spark, monkeypatch):
    rng = random.Random(1)
    v = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)] + [(100, [0.0] * 4), (101, None), (102, [1.0])]
    df = spark.createDataFrame(v, "id long, v array<double>")
    q = df.filter("id % 10 = 0")
    whole = {tuple(r) for r in retrieval.cosine_topk(df, q, 3, "id", "v", "id", "v", 4).collect()}
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    assert {tuple(r) for r in retrieval.cosine_topk(df, q, 3, "id", "v", "id", "v", 4).collect()} == whole and len(whole) == 21


def test_find_symbol(spark):
    s = spark.createDataFrame([("a", "C.method", 1), ("b", "method", 2), ("c", "methodical", 3)], "path string, name string, line_start int")
    assert [(r["path"], r["match"]) for r in retrieval.find_symbol(s, "method").collect()] == [("a", "exact"), ("b", "exact")]
    assert [(r["path"], r["match"]) for r in retrieval.find_symbol(s, "thodi").collect()] == [("c", "partial")]
    assert retrieval.find_symbol(s, "nothing").count() == 0


def plain_windows(a, b, size, overlap):
    out, x = [], a
    while True:
        out.append((x, min(x + size - 1, b)))
        if x + size - 1 >= b:
            return out
        x += size - overlap


def test_windows(spark):
    cases = [(1, n) for n in range(1, 140, 7)] + [(5, 5), (3, 64), (3, 62), (3, 63)]
    df = spark.createDataFrame(cases, "a int, b int")
    for r in df.select("a", "b", chunking.windows(F.col("a"), F.col("b")).alias("w")).collect():
        assert [tuple(x) for x in r["w"]] == plain_windows(r["a"], r["b"], 60, 10)


def test_gaps_and_spans_against_plain_python(spark):
    cases = []

    @settings(max_examples=60, deadline=None)
    @given(st.integers(1, 40), st.lists(st.tuples(st.integers(1, 40), st.integers(0, 9)), max_size=6))
    def collect(n, iv):
        cases.append((n, [(min(a, n), min(a + w, n)) for a, w in iv]))

    collect()
    files = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(cases)], "f int, n_lines int")
    sym = spark.createDataFrame([(i, f"s{k}", "function", a, b) for i, (_, iv) in enumerate(cases) for k, (a, b) in enumerate(iv)], "f int, name string, kind string, line_start int, line_end int")
    got = {}
    for r in chunking.gaps(sym.selectExpr("f", "line_start AS a", "line_end AS b"), files, ["f"]).collect():
        got.setdefault(r["f"], set()).add((r["a"], r["b"]))
    sp = {}
    for r in chunking.spans(sym, files, ["f"]).collect():
        sp.setdefault(r["f"], []).append((r["name"], r["a"], r["b"]))
    for i, (n, iv) in enumerate(cases):
        cov = {x for a, b in iv for x in range(a, b + 1)}
        want, run = set(), []
        for x in range(1, n + 2):
            if x <= n and x not in cov:
                run.append(x)
            elif run:
                if len(run) >= 5:
                    want.add((run[0], run[-1]))
                run = []
        assert got.get(i, set()) == want
        for name, a, b in sp.get(i, []):
            s, e = iv[int(name[1:])]
            later = [x for x, _ in iv if x > s]
            e = max(s, (min(later) if later else n + 1) - 1) if e <= s else e
            e = min(e, n)
            inner = [x for x in later if x <= e]
            assert (a, b) == (s, min(inner) - 1 if inner else e)


def test_markdown_and_chunks(spark):
    text = "# Title #\n\nintro\n```\n# not one\n```\n## Part\nbody\n" + "".join(f"line {i}\n" for i in range(6))
    f = spark.createDataFrame([("a.md", text, "markdown"), ("e.md", "", "markdown"), ("n.md", None, "markdown"), ("p.md", "x\n" * 6, "markdown")], "path string, text string, lang string")
    s = chunking.markdown_symbols(f, ["path"])
    assert [(r["name"], r["kind"], r["line_start"]) for r in s.orderBy("line_start").collect()] == [("Title", "h1", 1), ("Part", "h2", 7)]
    out = {r["id"]: r for r in chunking.chunk_files(f, s).collect()}
    assert set(out) == {"a.md::Title::1", "a.md::Part::7", "p.md::(module)::1"}
    assert out["a.md::Title::1"]["line_end"] == 6 and out["a.md::Part::7"]["header"] == "a.md :: Part (h2) L7-14 — ## Part"
    long = spark.createDataFrame([("b.py", "def f():\n    '''Doc line.'''\n" + "    x = 'yyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyy'\n" * 150, "python")], "path string, text string, lang string")
    ps = spark.createDataFrame([("b.py", "f", "function", 1, 152)], "path string, name string, kind string, line_start int, line_end int")
    parts = sorted(chunking.chunk_files(long, ps).collect(), key=lambda r: r["line_start"])
    assert [(r["id"], r["line_start"], r["line_end"]) for r in parts] == [("b.py::f::1::0", 1, 60), ("b.py::f::1::1", 51, 110), ("b.py::f::1::2", 101, 152)]
    assert parts[0]["header"].endswith("def f(): — Doc line.")


def test_python_symbols(spark):
    src = textwrap.dedent('''
        """Module purpose.

        More."""
        LIMIT = 3
        low = 1
        class A:
            x = 1
            def m(self): pass
            class B:
                def n(self): pass
        def f():
            def inner(): pass
        if True:
            def hidden(): pass
    ''')
    syms, doc = chunking.parse_python(src)
    assert doc == "Module purpose."
    assert [(n, k) for n, k, *_ in syms] == [("LIMIT", "constant"), ("A", "class"), ("A.m", "method"), ("A.B", "class"), ("B.n", "method"), ("f", "function")]
    df = spark.createDataFrame([("ok.py", src), ("bad.py", "def broken(:\n  pass"), ("none.py", None)], "path string, text string")
    out = chunking.python_symbols(df).collect()
    assert {r["engine"] for r in out if r["path"] == "ok.py"} == {"ast"}
    assert [(r["name"], r["engine"]) for r in out if r["path"] == "bad.py"] == [("broken", "regex")]


def test_decisions(spark):
    f = spark.createDataFrame([("D.md", "# Log\n## D-0001 — one\nbody\n## D-0002 — two\nlast"), ("x.md", "nothing")], "path string, text string")
    out = sorted(tuple(r) for r in chunking.decision_chunks(f).select("id", "line_end", "header", "text").collect())
    assert out == [("D.md::D-0001::2", 3, "D.md :: D-0001 — one", "## D-0001 — one\nbody"), ("D.md::D-0002::4", 5, "D.md :: D-0002 — two", "## D-0002 — two\nlast")]


TURNS = "session_id string, seq int, kind string, text string, tool_calls array<struct<id:string,name:string,input:string>>, tool_results array<struct<id:string,output:string>>"


def test_distill(spark):
    rows = [
        ("s", 1, "user", "Fix the bug\nnow", None, None), ("s", 2, "user", "<meta>", None, None), ("s", 3, "assistant", "Decision: use a queue\nchose Redis\nplain", [("c1", "Read", '{"file_path": "a.py"}'), ("c2", "Edit", '{"file_path": "a.py"}')], None),
        ("s", 4, "user", None, None, [("c1", "x\ny\nz\n")]), ("s", 5, "assistant", "Don't retry\ndecision: use a queue", [("c3", "Grep", '{"pattern": "q", "glob": "*.py"}'), ("c4", "Write", '{"file_path": "b.py"}'), ("c5", "Bash", '{"command": "ls"}'), ("c6", "Edit", '{"file_path": "a.py"}')], [("c3", "one\n\ntwo")]),
    ] + [("s", 6 + i, "assistant", f"reply {i}", None, None) for i in range(6)]
    t = spark.createDataFrame(rows, TURNS)
    assert [r["goal"] for r in distill.goals(t).orderBy("n").collect()] == ["Fix the bug\nnow"]
    assert [r["decision"] for r in distill.decision_lines(t).orderBy("n").collect()] == ["Decision: use a queue", "chose Redis", "decision: use a queue", "Don't retry"]
    assert [(r["path"], r["op"]) for r in distill.files_touched(t).orderBy("n").collect()] == [("a.py", "Edit"), ("b.py", "Write")]
    log = [r["line"] for r in distill.older_log(t).orderBy("seq", "k").collect()]
    assert log == ["- Read a.py (3 lines)", "- Edit a.py", "- Grep /q/ filter=*.py → ~2 match line(s)", "- Write b.py", "- $ ls  →  ", "- Edit a.py"]
    s = spark.createDataFrame([("s", "/w", None)], "session_id string, cwd string, git_branch string")
    full = distill.checkpoints(t, s).first()["checkpoint"]
    assert "- turns: 11 (last 6 kept verbatim)" in full and "## Earlier activity (compacted)\n- Read a.py" in full and full.count("### assistant") == 6
    small = distill.checkpoints(t, s, max_bytes=len(full.encode()) - 30).first()["checkpoint"]
    assert "- Read a.py" not in small and "- Edit a.py" in small and len(small.encode()) <= len(full.encode()) - 30
    tiny = distill.checkpoints(t, s, max_bytes=10).first()["checkpoint"]
    assert "Earlier activity" not in tiny and "## Recent turns" in tiny


def test_evaluation(spark):
    g = spark.createDataFrame([(1, "identifier", [("a.py", ["Run"])]), (2, "conceptual", [("b.py", None)]), (3, "conceptual", [("c.py", None)])], "query_id long, type string, relevant array<struct<path:string,symbols:array<string>>>")
    r = spark.createDataFrame([(1, 1, "a.py", "stop", 10), (1, 2, "a.py", "x.run_all", 20), (2, 1, "b.py", "y", 5)], "query_id long, rank int, path string, symbol string, tokens long")
    s = {x["query_id"]: x for x in evaluation.score_queries(evaluation.relevant(r, g), g).collect()}
    assert (s[1]["first_rank"], s[1]["hit1"], s[1]["hit5"], s[1]["mrr"], s[1]["tokens_to_task"], s[1]["ctx_tokens_5"]) == (2, False, True, 0.5, 30, 30)
    assert (s[2]["hit1"], s[3]["hit5"], s[3]["tokens_to_task"], s[3]["mrr"]) == (True, False, None, 0.0)
    v = spark.createDataFrame([("k", x) for x in (4, 1, 3, 2)] + [("j", 7)], "k string, v int")
    assert {x["k"]: (x["p50"], x["p95"]) for x in evaluation.positional_distributed(v, "k", "v").collect()} == {"k": (3, 4), "j": (7, 7)}
    assert evaluation.gate(evaluation.aggregate(evaluation.score_queries(evaluation.relevant(r, g), g))).first()["passed"] is False


def test_abtest(spark):
    rows = [(i, arm, None, 1, 10.0, 100 if arm == "a" else 50, 1) for i in range(4) for arm in "ab"] + [(0, "a", None, 2, 5.0, 300, 0), (7, "a", None, 1, 1.0, 1, 1), (8, "a", "boom", 1, 1.0, 1, 1), (8, "b", "", 1, 1.0, 1, 1)]
    df = spark.createDataFrame(rows, "item long, arm string, error string, seq long, cost double, tokens long, resolved int")
    p = abtest.pair_arms(df, "item", "arm", ["tokens", "cost", "resolved"], "a", "b")
    assert {r["item"] for r in p.filter("not complete").collect()} == {7, 8}
    s = abtest.summary(p).first()
    assert (s["n"], s["tokens_a"], s["tokens_b"], s["resolved_a"]) == (4, 600, 200, 3) and abs(s["reduction"] - 2 / 3) < 1e-9
    v = spark.createDataFrame([(i, float(i % 5 + 1)) for i in range(400)], "k long, v double")
    b = abtest.bootstrap_distributed(v, "v", "k").first()
    assert 2.75 < b["low"] < 3 < b["high"] < 3.25
    items = spark.createDataFrame([(i, "x" if i < 90 else "y") for i in range(100)], "k long, s string")
    one = sorted(r["k"] for r in abtest.stratified_sample(items, "k", "s", 10).collect())
    assert len(one) == 10 and sum(k >= 90 for k in one) == 1
    assert one == sorted(r["k"] for r in abtest.stratified_sample(items.repartition(7), "k", "s", 10).collect())


def test_bootstrap_rounds(spark):
    v = spark.createDataFrame([(i, float(i % 7)) for i in range(50)], "k int, v double")
    assert abtest.bootstrap_distributed(v, "v", "k").first() == abtest.bootstrap_distributed(v, "v", "k", rounds=2000).first() != abtest.bootstrap_distributed(v, "v", "k", rounds=200).first()


def test_routing(spark):
    e = lambda *rows: spark.createDataFrame([(m, s, i) for i, (m, s) in enumerate(rows)], "model string, strength string, seq int")
    best = routing.best_evidence(e(("my-opus", "explicit"), ("haiku-1", "recent")))
    assert best.first()["confidence"] == "high"
    r = {x["task"]: x["target"] for x in routing.routing(best).collect()}
    assert (r["planner"], r["explore_search"], r["code_review"]) == ("opus", "haiku", "sonnet")
    low = routing.best_evidence(e(("haiku-1", "recent")))
    r = {x["task"]: x["target"] for x in routing.routing(low).collect()}
    assert (r["code_review"], low.first()["confidence"]) == ("haiku", "medium")
    assert {x["target"] for x in routing.routing(e(("none", "recent")).transform(routing.best_evidence)).collect()} == {"inherit"}


def test_limits(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2026, 1, 1)
    h = spark.createDataFrame([("k", t0 + timedelta(seconds=10 * i)) for i in range(8)] + [("j", t0)], "k string, ts timestamp")
    r = [x["rejected"] for x in limits.rate_limited(h, "k", "ts").filter("k = 'k'").orderBy("ts").collect()]
    assert r == [False] * 5 + [True] * 3
    f = spark.createDataFrame([(99_999, 1199, None), (100_000, 1, None), (1, 1200, None), (200_000, 1, 5)], "size long, n int, off int")
    assert [x[0] for x in f.select(limits.large_read(F.col("size"), F.col("n"), F.col("off"), F.lit(None))).collect()] == [False, True, True, False]
    texts = ["aé日\U0001f600b" * 5, "plain", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in range(1, 14):
        for r in df.select("t", limits.cut_bytes(F.col("t"), n).alias("o")).collect():
            want = r["t"] if len(r["t"].encode()) <= n else r["t"].encode()[:n].decode("utf-8", errors="ignore")
            assert r["o"] == want


def test_indexing(spark):
    a = spark.createDataFrame([("r", "x", "1"), ("r", "y", "2"), ("r", "n", None), (None, "z", "1")], "root string, path string, sha string")
    b = spark.createDataFrame([("r", "x", "1"), ("r", "y", "3"), ("r", "n", None), (None, "z", "1"), ("r", "w", "1")], "root string, path string, sha string")
    assert {(x["path"], x["status"]) for x in indexing.drift(a, b, ["root", "path"]).collect()} == {("y", "changed"), ("n", "changed"), ("w", "deleted")}
    c = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, sha string")
    st_ = spark.createDataFrame([("a", "1", [1.0]), ("b", "1", [1.0])], "id string, sha string, vec array<float>")
    reused, todo = indexing.reuse_embeddings(c, st_)
    assert [x["id"] for x in reused.collect()] == ["a"] and [x["id"] for x in todo.collect()] == ["b"]
    k = spark.createDataFrame([(f"{i:04d}",) for i in range(107)], "key string")
    assert sorted(x["key"] for x in indexing.systematic_sample(k, "key").collect()) == [f"{i:04d}" for i in range(0, 100, 5)]


def test_index_store(spark, tmp_path):
    import pytest

    from tessera.operators import store as S

    st_ = S.IndexStore(spark, f"file://{tmp_path}/ix")
    assert st_.problems() == ["no readable settings"] and st_.meta() is None
    rows = [("a", "src/a.py", "python", "", "retry handler", "1"), ("b", "tests/b.py", "python", "", "retry handler", "1"), ("c", "c.md", "markdown", None, None, "1")]
    cols = "id string, path string, lang string, header string, text string, sha string"
    c = spark.createDataFrame(rows, cols)
    f = lambda d: d.select("path", "sha", F.lit(0).alias("mtime"))
    made = []

    def embed(d):
        made.append(sorted(r["id"] for r in d.select("id").collect()))
        return d.select("id", F.array(F.lit(1.0)).alias("vec"))

    st_.build(c, f(c), embed, "hash")
    assert st_.problems() == [] and made == [["a", "b", "c"]]
    q = spark.createDataFrame([(1, "retry_handler"), (2, None)], "query_id long, query string")
    assert [r["id"] for r in st_.search(q).orderBy("rank").collect()] == ["a", "b"]
    c2 = spark.createDataFrame([(*rows[0][:5], "2"), *rows[1:2]], cols)
    assert {(r["path"], r["status"]) for r in st_.stale(f(c2)).collect()} == {("src/a.py", "changed"), ("c.md", "deleted")}
    assert st_.stale(f(c), 20).count() == 0
    meta = st_.build(c2, f(c2), embed, "hash")
    assert made[1] == ["a"] and meta["reused"] == 1 and st_.problems() == []
    with S.writer_lock(spark, f"file://{tmp_path}/ix"), pytest.raises(S.LockHeld):
        st_.build(c2, f(c2))
    with S.writer_lock(spark, f"file://{tmp_path}/ix") as first:
        with S.writer_lock(spark, f"file://{tmp_path}/ix", -1) as second:  # takes over what it holds to be stale
            assert second.held() and not first.held()
            with pytest.raises(S.LockHeld):
                first.check()
        assert not first.held()


def test_small_helpers(spark):
    import hashlib
    import hmac

    from tessera.functions import text as T

    df = spark.createDataFrame([("a@b.co",), (" x@y.z ",), ("a@b",), ("a b@c.d",), (None,)], "e string")
    assert [r[0] for r in df.select(T.valid_email(F.col("e"))).collect()] == [True, True, False, False, False]
    got = [r[0] for r in df.filter("e is not null").select(T.hmac_sha256(F.col("e"), "key")).collect()]
    assert got[0] == hmac.new(b"key", b"a@b.co", hashlib.sha256).hexdigest()
    own = spark.createDataFrame([(1, 5, None, 0, 0), (2, 0, 0, 0, None), (3, None, None, None, None)], "k long, input long, output long, cache_read long, cache_write long")
    logs = spark.createDataFrame([(2, 1, 2, 3, 4), (2, 1, 1, 1, 1), (1, 9, 9, 9, 9)], "k long, input long, output long, cache_read long, cache_write long")
    assert sorted(tuple(r) for r in abtest.with_fallback(own, logs, "k").collect()) == [(1, 5, 0, 0, 0), (2, 2, 3, 4, 5), (3, 0, 0, 0, 0)]


def test_new_operators(spark):
    from tessera.functions import vectors as V
    from tessera.operators import accounting, chunking
    from tessera.sources import logs

    with pytest.raises(V.BackendUnavailable):
        V.get_backend("none")
    d = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "alpha beta alpha")], "id long, text string")
    vecs = {r["id"]: r["vec"] for r in V.get_backend("hash")[1](d, "id", F.col("text")).collect()}
    assert abs(sum(x * x for x in vecs[1]) - 1) < 1e-9 and not any(vecs[2]) and len(vecs[3]) == 256
    code = "\"\"\"Limits of things.\nmore\"\"\"\nLIMIT: int = 5\nMOST = 3\nlow: int = 1\nclass A:\n    B: int = 1\n    def f(self):\n        pass\n"
    files = spark.createDataFrame([("a.py", "python", code), ("b.md", "markdown", "# Title\n## Sub"), ("c.go", "go", "func Run(x int) {"), ("d.py", "python", "def f(:\ndef g():"), ("e", None, None)], "path string, lang string, text string")
    symbols, purposes = chunking.extract_symbols(files)
    assert {(r["path"], r["name"], r["kind"], r["engine"]) for r in symbols.collect()} == {
        ("a.py", "LIMIT", "constant", "ast"), ("a.py", "MOST", "constant", "ast"), ("a.py", "A", "class", "ast"), ("a.py", "A.f", "method", "ast"), ("b.md", "Title", "h1", "markdown"), ("b.md", "Sub", "h2", "markdown"),
        ("c.go", "Run", "function", "regex"), ("d.py", "f", "function", "regex"), ("d.py", "g", "function", "regex"),
    }
    assert {tuple(r) for r in purposes.collect()} == {("a.py", "Limits of things."), ("b.md", "Title")}
    assert accounting.milestone_reached(12.5, 5.0, 5.0) == 10.0 and accounting.milestone_reached(12.5, 10.0, 5.0) is None and accounting.milestone_reached(0.0, 0.0, 5.0) is None
    assert logs.first_json('progress {x\n{"a": {"b": 1}}\nWrote out') == {"a": {"b": 1}} and logs.first_json("none {") is None
    assert [tuple(r) for r in logs.environment_models(spark, {"A": "m1", "B": ""}, ("B", "A", "C"), 7).collect()] == [("m1", "explicit", 8)]


def test_grep_summary_counts_the_cut(spark):
    from tessera.operators import distill as D

    rows = [("Grep", '{"pattern": "x"}', ("a" * 119 + "\n") * 3), ("Grep", '{"pattern": "x"}', "a\n\nb")]
    out = [r[0] for r in spark.createDataFrame(rows, "name string, input string, output string").select(D.summary()).collect()]
    assert [s.split("→ ~")[1] for s in out] == ["3 match line(s)", "2 match line(s)"]  # at the cut the ellipsis stands on a line of its own
