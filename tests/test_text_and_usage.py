import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import usage as U
from tessera.functions import vectors as V


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" if not isinstance(v, (int, float, list)) else f"{k} {'double' if not isinstance(v, list) else 'array<float>'}" for k, v in values.items()))
    return df.select(col.alias("o")).first()["o"]


def test_tokens(spark):
    cases = {"find_symbol": ["find_symbol", "find", "symbol"], "HTTPServer": ["httpserver", "http", "server"], "hello world": ["hello", "world"], "": [], "a1 22": ["a1", "a", "1", "22"], "_": ["_"]}
    for k, v in cases.items():
        assert one(spark, T.tokens(F.col("x")), x=k) == v
    assert spark.createDataFrame([(None,)], "x string").select(T.tokens(F.col("x"))).first()[0] is None


def test_tokens_against_plain_python(spark):
    texts = []

    @settings(max_examples=80, deadline=None)
    @given(st.text(alphabet="aBcDE_19 -.é", max_size=25))
    def collect(t):
        texts.append(t)

    collect()

    def plain(t):
        out = []
        for w in re.findall(r"[A-Za-z_][A-Za-z0-9_]*|\d+", t):
            sub = [s.lower() for p in w.split("_") for s in re.findall(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+", p)]
            out += [w.lower()] + (sub if len(sub) > 1 else [])
        return out

    df = spark.createDataFrame([(t,) for t in texts], "x string")
    for r in df.select("x", T.tokens(F.col("x")).alias("o")).collect():
        assert r["o"] == plain(r["x"])


def test_lines(spark):
    for t in ["", "a", "a\n", "a\n\n", "\n", "a\r\nb\rc", "x y\x0bz\x85w", "\r\n\r\n"]:
        assert one(spark, T.lines(F.col("x")), x=t) == t.splitlines()


def test_paths(spark):
    for p, want in {"a/b.PY": "python", "x.tar.md": "markdown", ".bashrc": None, "noext": None, "d.ts/x": None}.items():
        assert one(spark, T.language(F.col("x")), x=p) == want
    for p, lang, want in [("tests/a.md", "markdown", 0.7), ("a/test_x", "c", 0.7), ("a.spec.ts", "typescript", 0.7), ("r.md", "markdown", 0.9), ("contest/x.py", "python", 1.0)]:
        assert one(spark, T.rank_prior(F.col("x"), F.lit(lang)), x=p) == want
    assert one(spark, T.ignored(F.col("x")), x="a/node_modules/b.js") and not one(spark, T.ignored(F.col("x")), x="a/modules/b.js")
    assert one(spark, T.top_dir(F.col("x")), x="f.py") == "."


def test_identifier_queries(spark):
    for q, want in {"where is cost_usd": True, "the SessionManager class": True, 'what does "foo bar" do': True, "call fetch.user() twice": True, "how does retrieval work": False, "A plain Sentence": False}.items():
        assert one(spark, T.is_identifier_query(F.col("x")), x=q) is want


def test_usage(spark):
    c = lambda *v: U.cost(F.col("m"), *[F.lit(x) for x in v])
    assert one(spark, c(1e6, 1e6, 0, 0), m="big-opus-4") == 30.0
    assert one(spark, c(0, 0, 1e6, 0), m="opus") == 0.5
    assert one(spark, c(1e6, 0, 0, 0), m="unheard") == 5.0
    assert one(spark, U.family(F.col("m")), m="x.haiku-1") == "haiku" and one(spark, U.family(F.col("m")), m="other") is None
    assert U.window_seconds("all") is None and U.window_seconds("x") == 30 * 86400
    assert one(spark, U.milestone(F.lit(204.375)), m="x") == 200.0


def test_vectors(spark):
    assert one(spark, V.l2_normalise(F.col("v")), v=[3.0, 4.0]) == [0.6, 0.8]
    assert one(spark, V.l2_normalise(F.col("v")), v=[0.0, 0.0]) == [0.0, 0.0]


def test_estimate_tokens(spark):
    assert [one(spark, T.estimate_tokens(F.col("x")), x="é" * n) for n in (0, 3, 4, 9)] == [1, 1, 1, 2]
