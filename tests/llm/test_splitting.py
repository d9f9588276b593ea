from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import splitting as S


def check(text, limit, overlap):
    ps = S.split(text, limit, overlap)
    assert all(len(p.text) <= limit for p in ps)
    assert "".join(p.text[p.new_from :] for p in ps) == text
    assert all(p.new_from < len(p.text) for p in ps)
    for a, b in zip(ps, ps[1:], strict=False):
        assert a.text.endswith(b.text[: b.new_from])
        assert b.first <= b.last and a.first <= b.first
    return ps


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\r\t_é", max_size=400), st.integers(5, 60), st.integers(0, 10))
def test_round_trip(text, limit, overlap):
    check(text, limit, overlap)


def test_cuts_at_blocks_and_topics():
    a = "".join(f"alpha beta gamma {i}\n" for i in range(10))
    b = "".join(f"river water stone {i}\n" for i in range(10))
    ps = check(a + "\n" + b, 300, 2)
    assert ps[0].text == a + "\n"
    assert ps[1].text.startswith("alpha beta gamma 9\n\nriver")
    assert (ps[0].first, ps[0].last, ps[1].first) == (0, 10, 9)
    plain = check(a + b, 300, 2)
    assert plain[0].text == a


def test_long_line_and_overlap():
    ps = check("word " * 1000, 100, 10)
    assert all(p.first == p.last == 0 for p in ps)
    lines = "".join(f"line {i}\n" for i in range(1000))
    ps = check(lines, 500, 10)
    assert ps[1].text[: ps[1].new_from].count("\n") == 10


def test_table(spark):
    rows = [(1, 5, "short"), (2, None, "x y\n" * 1000), (2, None, "x y\n" * 1000), (3, 1, None), (4, 1, ""), (5, 7, "é" * 2048), (6, 7, "é" * 2049), (None, 7, "x" * 3000)]
    df = spark.createDataFrame(rows, "chunk_no long, line_start int, text string").selectExpr("*", "'k' AS part")
    out = S.pieces(df).collect()
    assert {r["chunk_no"] for r in out} == {2, 6}
    two = sorted((r for r in out if r["chunk_no"] == 2), key=lambda r: r["part"])
    assert [r["part"] for r in two] == list(range(len(two))) and two[0]["line_start"] == 1 and two[-1]["line_end"] == 1000
    assert S.pieces(df.limit(0)).count() == 0
