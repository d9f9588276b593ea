import math
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import codefiles, distinctive, leakage, neighbours, reading


def test_distinctive_matches_brute_force(spark):
    rows = [(1, "getUserName", "alpha alpha beta gamma"), (1, "getUserName", "alpha alpha beta gamma"), (2, None, "beta beta delta ABCdef"), (3, "gamma", None), (4, None, None), (5, "", "xy")]
    df = spark.createDataFrame(rows, "chunk_no long, header string, text string").selectExpr("*", "'t' AS term", "1 AS n")
    got = {(r["chunk_no"], r["term"]): r for r in distinctive.weights(df).collect()}
    docs = {1: "user name alpha alpha beta gamma".split(), 2: "beta beta delta cdef".split(), 3: ["gamma"]}
    docs[2] = "beta beta delta abcdef".split()
    total = Counter(w for d in docs.values() for w in d)
    n = sum(total.values())
    assert set(got) == {(k, w) for k, d in docs.items() for w in d}
    x = lambda v: v * math.log(v) if v > 0 else 0.0
    for (k, w), r in got.items():
        a = docs[k].count(w)
        b, c = total[w] - a, len(docs[k]) - a
        d = n - len(docs[k]) - b
        g = 2 * (x(a) + x(b) + x(c) + x(d) - x(a + b) - x(c + d) - x(a + c) - x(b + d) + x(n))
        assert abs(abs(r["llr"]) - max(g, 0)) < 1e-3 and r["n_all"] == total[w]
    assert distinctive.weights(df.limit(0)).count() == 0
    assert {r["term"] for r in distinctive.weights(df, 2, 1).collect()} == {"alpha"}


def test_distinctive_keeps_words_commoner_elsewhere(spark, tmp_path):
    from tessera.llm import catalog

    for name, rows in (("one", [(1, "", "alpha " * 3)]), ("two", [(1, "", "filler " * 1000 + "alpha " * 3), (2, "", "alpha " * 8 + "other")])):
        spark.createDataFrame(rows, "chunk_no long, header string, text string").write.parquet(f"{tmp_path}/{name}/chunks.parquet")
    assert {tuple(r) for r in catalog.p6_found(spark, f"{tmp_path}/one").collect()} == {(1, "alpha")}
    assert {tuple(r) for r in catalog.p6_found(spark, f"{tmp_path}/two").collect()} == {(1, "filler"), (1, "alpha"), (2, "alpha")}


def test_hilbert_is_a_curve():
    pts = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    key = neighbours.hilbert(pts, 3)
    assert sorted(key) == list(range(512))
    walk = pts[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_neighbours_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 64)).astype("float32")
    x[:300] = x[300:600] + 0.1 * rng.normal(size=(300, 64))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5, [float(v) for v in x[5]]), (9001, None), (9002, [0.0] * 64), (9003, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "chunk_no long, vec array<float>").selectExpr("*", "1 AS key", "2 AS curve")
    got = {}
    for r in neighbours.knn(df).collect():
        got.setdefault(r["id"], set()).add(r["other"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1)[:, :5]
    assert set(got) == set(range(1500)) and all(len(v) == 5 for v in got.values())
    assert np.mean([len(got[i] & set(want[i].tolist())) / 5 for i in range(1500)]) > 0.8
    pairs = {tuple(r) for r in neighbours.close_pairs(neighbours.knn(df)).collect()}
    true = {(min(i, j), max(i, j)) for i in range(1500) for j in want[i].tolist() if s[i, j] >= 0.9}
    assert len(pairs & true) >= 0.99 * len(true) > 100
    assert neighbours.knn(df.limit(0)).count() == 0


def test_equal_vectors(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)], "chunk_no long, vec array<float>")
    out = neighbours.knn(df, dim=2, window=8, curves=2).collect()
    assert len(out) == 250 and all(r["similarity"] == 1.0 and r["id"] != r["other"] for r in out)


def _recall(df, x, **how):
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("float64")
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1)[:, :5]
    return np.mean([r["other"] in want[r["id"]] for r in neighbours.knn(df, **how).collect()])


def test_dense_group_and_rounds(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 64)).astype("float32")
    x[:1000] = x[0] + 0.3 * rng.normal(size=(1000, 64))  # a third in one dense group
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "chunk_no long, vec array<float>")
    few = dict(window=32, halo=8, curves=4)
    assert _recall(df, x, rounds=3, **few) > _recall(df, x, rounds=0, **few) + 0.3
    assert [neighbours.rounds_for(n) for n in (0, 1000, 100_000, 100_001, 10**7)] == [2, 2, 2, 3, 4]


def test_same_rows_for_any_partitioning(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 64)).astype("float32")
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "chunk_no long, vec array<float>")
    found = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n in (1, 8, 24):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            found.append({tuple(r) for r in neighbours.knn(df.repartition(n), window=32, halo=8, curves=3, rounds=1).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found[0]) == 3000 and found[0] == found[1] == found[2]


def test_copies_and_ties(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 8)).astype("float32")
    x[rng.permutation(500)[:200]] = 2 * x[0]
    x[rng.permutation(500)[:60]] = [1, 0, 0, 0, 0, 0, 0, 0]
    x[400:440] = rng.permutation(np.repeat(np.eye(8), 5, axis=0))  # orthogonal classes tie at 0
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "chunk_no long, vec array<float>")
    u = neighbours._unit(x)
    s = np.round(np.clip(u @ u.T, -1, 1), 12)
    np.fill_diagonal(s, -2)
    got = {(r["id"], r["rank"]): (r["other"], r["similarity"]) for r in neighbours.knn(df, dim=8).collect()}
    assert got == {(i, k + 1): (int(j), s[i, j]) for i in range(500) for k, j in enumerate(np.lexsort((np.arange(500), -s[i]))[:5])}


def test_edit_distance():
    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 3, (60, 7)), rng.integers(0, 3, (60, 7))
    assert leakage.edit_distance(a, b).tolist() == [slow(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)]


def test_leaks(spark):
    rng = random.Random(5)
    words = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(words, k=40))) for i in range(60)] + [(100, "too short"), (101, None), (0, None)]
    docs, exact, near = [], set(), set()
    for i in range(400):
        d = rng.choices(words, k=80)
        k = i % 60
        w = items[k][1].split()
        if i % 4 == 0:
            d[20:30] = w[7:17]
            exact.add((i, k))
        elif i % 4 == 1:
            part = w[7:17]
            part[4] = "changed"
            d[20:30] = part
            near.add((i, k))
        docs.append((i, (", ".join(d)).upper()))
    docs += [(1000, None), (1001, ""), (1002, "a_b")]
    dd = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id")
    ii = spark.createDataFrame(items, "item_id long, passage string")
    out = leakage.leaks(dd, ii).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out if r["distance"] == 0} == exact
    found = {(r["doc_id"], r["item_id"]) for r in out if r["distance"] == 1}
    assert found <= near and len(found) >= 0.9 * len(near)
    assert leakage.leaks(dd.limit(0), ii).count() == 0 and leakage.leaks(dd, ii.limit(0)).count() == 0


def test_leaks_inserted_and_deleted(spark):
    rng = random.Random(8)
    words = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(words, k=60))) for i in range(40)]
    docs, window, whole = [], {"in": set(), "out": set()}, {}
    for i in range(400):
        d, p = rng.choices(words, k=80), items[i % 40][1].split()
        if i % 4 == 0:
            d[20:30] = p[7:12] + ["inserted"] + p[12:17]
            window["in"].add((i, i % 40))
        elif i % 4 == 1:
            d[20:30] = p[7:12] + p[13:17]
            window["out"].add((i, i % 40))
        elif i % 4 == 2:  # a word inserted after every 8
            d[20:30] = [x for k in range(0, 60, 8) for x in [*p[k : k + 8], "inserted"]]
            whole[i, i % 40] = 7
        else:  # every fourth word changed
            d[20:30] = ["changed" if k % 4 == 3 else x for k, x in enumerate(p)]
            whole[i, i % 40] = 15
        docs.append((i, " ".join(d)))
    docs.append((1000, " ".join(items[0][1].split()[3:12])))  # the end of a text, a word short of a window
    window["out"].add((1000, 0))
    dd, ii = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")
    out = leakage.leaks(dd, ii).collect()
    found = {(r["doc_id"], r["item_id"]) for r in out if r["distance"] == 1}
    assert {(r["doc_id"], r["item_id"]): r["passage_distance"] for r in out if r["passage_distance"] is not None} == whole
    print("recall", {k: len(v & found) / len(v) for k, v in window.items()})
    assert all(len(v & found) >= 0.85 * len(v) for v in window.values()) and found <= window["in"] | window["out"] | set(whole)
    assert not any(r["distance"] == 0 for r in out)


def test_many_items_are_joined(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    passages = [[rng.choice(words) for _ in range(30)] for _ in range(40)]
    passages[7][:15] = passages[3][:15]  # a window that two items share
    items = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(passages)] + [(90, "tiny thing"), (None, "x"), (91, None)], "item_id long, passage string")
    docs = [(i, " ".join([rng.choice(words) for _ in range(40)] + passages[i % 40][5:25] + [rng.choice(words) for _ in range(5)])) for i in range(60)]
    docs += [(i + 100, " ".join([*passages[i][:12], rng.choice(words), *passages[i][13:20]])) for i in range(40)] + [(300, None), (301, ""), (302, "a tiny thing"), (303, " ".join(passages[3][:10]))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    whole = {tuple(r) for r in leakage.leaks(d, items).collect()}
    monkeypatch.setattr(leakage, "BLOCK_WINDOWS", 100)
    assert whole == {tuple(r) for r in leakage.leaks(d, items).collect()} and {(303, 3), (303, 7), (302, 90)} <= {r[:2] for r in whole}
    exact = leakage.leaks(d, items, passages=False).filter("distance = 0")
    assert {tuple(r)[:2] for r in exact.collect()} == {r[:2] for r in whole if r[2] == 0}


def test_short_items(spark):
    items = spark.createDataFrame([(1, "zebra"), (2, "blue zebra"), (3, "one two three four five"), (4, "..."), (5, "zebra blue")], "item_id long, passage string")
    docs = spark.createDataFrame([(1, "A blue zebra"), (2, "blue"), (3, "zebra"), (4, "see: one two, three four five."), (5, "one two three FOUR six " * 3), (6, None), (7, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["distance"], r["windows"], r["passage_distance"]) for r in leakage.leaks(docs, items).collect()}
    assert got == {(1, 1): (None, 0, 0), (1, 2): (None, 0, 0), (3, 1): (None, 0, 0), (4, 3): (None, 0, 0), (5, 3): (None, 0, 1)}


def test_item_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_WINDOWS", 15)  # passages of 21 windows come in parts
    words = [f"q{i}" for i in range(100)]
    items = spark.createDataFrame([(i, " ".join(words[i : i + 30])) for i in range(8)], "item_id long, passage string")
    docs = spark.createDataFrame([(1, " ".join(words[2:14]))], "doc_id long, text string")
    assert {r["item_id"] for r in leakage.leaks(docs, items).filter("distance = 0").collect()} == {0, 1, 2, 3, 4} & {i for i in range(8) if i <= 4}


@pytest.mark.parametrize(("text", "want"), [("One two. Three!", (3, 2)), ("v1.2 is e.g. here", (5, 2)), ("```\ncode here\n```\nreal words", (2, 1)), ("# head\n- item\n    code\n> q\ntext", (1, 1)), ("...", (0, 0)), ("", (0, 0)), ("```\nnever closed. at all", (0, 0))])
def test_measures(text, want):
    w, s, _ = reading.measures(text, reading._patterns())
    assert (len(w), s) == want


def test_reading_level_held_out(spark):
    rng = random.Random(2)
    easy, hard = [f"cat{i}" for i in "abcdefghij"], [f"epistemo{i}" for i in "abcdefghij"]
    docs, labels = [], []
    for i in range(300):
        p = (i % 5) / 4
        docs.append((i, " ".join(rng.choice(hard if rng.random() < p else easy) for _ in range(60)) + "."))
        if i < 200:
            labels += [(i, "r1", i % 5 + 1), (i, "r1", i % 5 + 1), (i, "r2", None)]
    docs += [(900, None), (901, ""), (902, "123 456"), (903, "zzz"), (None, "text")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "5 AS level")
    lab = spark.createDataFrame(labels, "doc_id long, rater string, reading_level int")
    out = {r["doc_id"]: r for r in reading.levels(d, reading.fit(d, lab)).collect()}
    err = [abs(out[i]["level"] - (i % 5 + 1)) for i in range(200, 300)]
    assert sum(err) / len(err) < 0.7
    assert out[900]["level"] is None and out[902]["n_words"] == 0 and out[903]["level"] == 3.0
    e = reading.heldout_error(d, lab).first()
    assert e["n"] > 20 and e["mean_error"] < 0.7 < e["median_error"] and e["correlation"] > 0.8
    assert reading.heldout_error(d, lab.limit(0)).first()["n"] == 0
    none = reading.fit(d, lab.limit(0))
    assert {r["level"] for r in reading.levels(d, none).collect()} == {None, 3.0}
    assert reading.demanding(reading.levels(d.limit(0), none)).count() == 0


MAP = "root string, path string, lang string, mtime long, sha string, size long, purpose string, engine string, symbols array<struct<name:string,kind:string,line_start:int,line_end:int>>, scanned_at timestamp, loaded_at timestamp"
CH = "chunk_no long, root string, path string, line_start int, line_end int, text string"


def test_code_files(spark):
    from datetime import datetime

    now = datetime(2026, 1, 1)
    f = lambda p, size=900, lang="python", root="r": (root, p, lang, 1, "s", size, None, "ast", [("f", "function", 1, 30)], now, now)
    files = [f(f"src/pkg/mod{i}.py") for i in range(20)] + [f("src/vendors/list.py"), f("src/api_pb2.py"), f("vendor/lib/a.py"), f("vendor/lib/b.py"), f("top.py"), f("web/app.min.js", 90000, "javascript"), f("src/made.py"), f("src/talk.py"), f("src/copy.py"), (None, "x", None, None, None, None, None, None, None, now, now), ("q", "only", None, None, None, None, None, None, None, None, None), f("src/pkg/mod0.py"), f("data/t.py", 300000)]
    code = "def run(value):\n    return value + other\n" * 5
    texts = {"src/made.py": "# Code generated by toolx. DO NOT EDIT.\n" + code, "src/talk.py": "# writes the DO NOT EDIT banner into its output\n" + code, "src/copy.py": "# Vendored from the abc project at tag 1.2\n" + code, "data/t.py": "T = [\n" + "  0x1f, 0x22, 0x93, 0x44,\n" * 60, "src/pkg/mod1.py": code}
    df = spark.createDataFrame(files, MAP)
    ch = spark.createDataFrame([(i, "r", p, 1, 10, t) for i, (p, t) in enumerate(texts.items())] + [(99, "r", "src/pkg/mod2.py", None, None, None)], CH)
    got = {(r["root"], r["path"]): r["label"] for r in codefiles.label_files(df, ch).collect()}
    assert len(got) == len({(x[0], x[1]) for x in files if x[0]})
    want = {"src/api_pb2.py": "generated", "vendor/lib/a.py": "vendored", "web/app.min.js": "minified", "src/made.py": "generated", "src/talk.py": "handwritten", "src/copy.py": "vendored", "data/t.py": "blob", "src/vendors/list.py": "handwritten", "src/pkg/mod1.py": "handwritten", "top.py": "handwritten"}
    assert {p: got["r", p] for p in want} == want
    assert codefiles.label_files(df.limit(0), ch).count() == 0
    assert codefiles.label_files(df, ch.limit(0)).count() == len(got)


def test_banners_in_new_wording(spark):
    """Nobody lists these words: they are learned from files that their names and directories give away."""
    from datetime import datetime

    now = datetime(2026, 1, 1)
    code = "def run(value):\n    return value + other\n" * 5
    told = "# Emitted out of the schema bundle. Hands off, rerun protomill to refresh.\n\n"
    plain = "#!/usr/bin/env python\n# Small helpers around parsing and retries for the worker pool.\n\n"
    texts = {f"a/generated/t{i}_pb2.py": told + code for i in range(15)} | {f"src/pkg{i}/m{j}.py": plain + code for i in range(12) for j in range(5)} | {f"src/pkg{i}/odd.py": told + code for i in range(12)}
    files = spark.createDataFrame([("r", p, "python", 1, "s", 900, None, "ast", [("f", "function", 1, 12)], now, now) for p in texts], MAP)
    ch = spark.createDataFrame([(i, "r", p, 1, 12, t) for i, (p, t) in enumerate(texts.items())], CH)
    got = {r["path"]: r["label"] for r in codefiles.label_files(files, ch).collect()}
    assert {got[p] for p in got if p.endswith("odd.py")} == {"generated"}
    assert {got[p] for p in got if "/m" in p} == {"handwritten"}


def test_bp_equals_enumeration(spark):
    """Marginals of a small tree against the sum over all labelings."""
    import itertools

    ev = {"a/x": [0, 2, -1, 0, 1], "a/y": [0.5, 0, 0, 1, 0], "z": [0, 0, 0.3, 0, 0]}
    fgd, dgp, prior = codefiles.FILE_GIVEN_DIR, codefiles.DIR_GIVEN_PARENT, codefiles.ROOT_PRIOR
    marg = {k: np.zeros(5) for k in ev}
    for r, a, x, y, z in itertools.product(range(5), repeat=5):
        p = prior[r] * dgp[r][a] * fgd[a][x] * fgd[a][y] * fgd[r][z] * math.exp(ev["a/x"][x] + ev["a/y"][y] + ev["z"][z])
        for k, v in (("a/x", x), ("a/y", y), ("z", z)):
            marg[k][v] += p
    rows = spark.createDataFrame([("r", k, k.rpartition("/")[0], None, list(map(float, v))) for k, v in ev.items()], "root string, path string, dir string, words array<string>, e array<double>")
    orig = codefiles.file_evidence
    codefiles.file_evidence = lambda files, texts: rows
    try:
        df = spark.createDataFrame([], MAP)
        ch = spark.createDataFrame([], CH)
        out = codefiles.label_files(df, ch).collect()
    finally:
        codefiles.file_evidence = orig
    for r in out:
        m = marg[r["path"]] / marg[r["path"]].sum()
        assert np.allclose([r[f"p_{x}"] for x in codefiles.LABELS], m, atol=1e-9)
