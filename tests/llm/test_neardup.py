import random
import re

import numpy as np

from tessera.llm import neardup as N


def jaccard(a, b, w=3):
    s = [{tuple(x[i : i + w]) for i in range(len(x) - w + 1)} for x in (re.findall("[a-z0-9_]+", t.lower()) for t in (a, b))]
    return len(s[0] & s[1]) / len(s[0] | s[1]) if s[0] and s[1] else 0.0


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [[rng.choice(words) for _ in range(rng.randint(20, 90))] for _ in range(n)]
    out = [" ".join(t) for t in texts]
    for t in texts[: n // 2]:
        u = t[:]
        for _ in range(rng.randint(0, 4)):
            u[rng.randrange(len(u))] = rng.choice(words)
        out.append(" ".join(u))
    return out + ["", "one two", "Ein ÜBER text", texts and " ".join(texts[0])]


def brute(rows, t=0.7):
    return {(a, b) for a, ra, pa, x in rows for b, rb, pb, y in rows if a < b and (ra, pa) != (rb, pb) and x is not None and y is not None and jaccard(x, y) >= t}


def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_no long, root string, path string, text string").selectExpr("*", "'z' AS cls", "1 AS key")


def test_pairs_match_brute_force(spark):
    rows = [(i, f"r{i % 3}", f"p{i % 50}", t) for i, t in enumerate(corpus())] + [(900, None, None, None), (901, None, "p", "a b c d"), (902, "r", None, "a b c d")]
    nameless = [(None, "n", "n", rows[0][3])] * 2
    want = brute(rows)
    got = {tuple(r) for r in N.found_pairs(frame(spark, rows + rows[:5] + nameless)).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 30


def test_groups_and_hot_keys(spark, monkeypatch):
    base = [f"t{i}" for i in range(60)]
    rows = [(i, "r", f"p{i}", " ".join([*base[:55], f"x{i}", f"y{i}", "t1"])) for i in range(150)]  # one bucket holds them all
    got = {tuple(r) for r in N.found_pairs(frame(spark, rows)).collect()}
    assert got == brute(rows)
    g = N.groups(frame(spark, [*rows, (500, "r", "p", None), (501, "r", "p", "alone in the world")])).collect()
    assert {(r["group_id"], r["links"]) for r in g if r["chunk_no"] < 500} == {(0, 149)}
    assert {(r["chunk_no"], r["group_id"], r["links"]) for r in g if r["chunk_no"] >= 500} == {(500, 500, 0), (501, 501, 0)}


def test_crowded_keys_are_marked():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    key = np.concatenate([np.full(200, 5), [7, 7, 9, 9], np.repeat(np.arange(20, 40), 2)])
    cls = np.concatenate([np.arange(200), [N._MARK, 1000, 300, 301], rng.integers(400, 500, 40)])
    order = np.lexsort((cls, key))
    for step in (1, 17, 500):
        batches = [pa.RecordBatch.from_arrays([pa.array(key[order][i : i + step]), pa.array(cls[order][i : i + step])], names=["key", "cls"]) for i in range(0, len(key), step)]
        out = [r for b in N._pair_runs(iter(batches)) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        assert {a for a, b in out if b is None} == {*range(200), 1000} and (300, 301) in out and len({x for x in out if x[1] is not None}) <= 21


def test_recall_at_the_threshold():
    """Pairs with a similarity just over 0.7: measured share that meets in a key."""
    rng = np.random.default_rng(2)
    met = 0
    for _ in range(1000):
        common, a, b = (rng.integers(1, 1 << 62, n, dtype=np.uint64) for n in (705, 147, 148))
        sig = N.signatures(np.concatenate([common, a, common, b]), np.array([852, 853]))
        x, y = N.index_keys(sig)
        met += bool(set(x.tolist()) & set(y.tolist()))
    assert met >= 990


def test_classes_of_clashing_texts(spark, monkeypatch):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "r", "p", "a b c d e"), (2, "r", "q", "v w x y z"), (3, "s", "q", "a b c d e")], "chunk_no long, root string, path string, text string")
    assert N.clashes(df) == ()
    plain = N.text_class
    monkeypatch.setattr(N, "text_class", lambda text, clashes=(): F.when(F.lit(bool(clashes)), plain(text)).otherwise(F.lit(7).cast("long")))
    assert N.clashes(df) == (7,)
    assert {tuple(r) for r in N.found_pairs(df).collect()} == {(1, 3)}


def test_empty(spark):
    df = frame(spark, [(1, "r", "p", "x")]).limit(0)
    assert N.found_pairs(df).count() == 0 and N.groups(df).count() == 0


def test_pigeonhole_guarantee():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, size=(300, N.SYMBOLS), dtype=np.uint64)
    b = a.copy()
    for i in range(300):  # as many differing symbols as the guarantee allows
        b[i, rng.choice(N.SYMBOLS, N.CHUNKS * (N.ERRORS + 1) - 1, replace=False)] += np.uint64(1)
    ka, kb = N.index_keys(a), N.index_keys(b)
    assert all(set(x) & set(y) for x, y in zip(ka, kb, strict=True))
