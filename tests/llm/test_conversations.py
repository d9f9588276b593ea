import math
import random
from datetime import datetime

from tessera.llm import conversations as C

TURN = "session_id string, uuid string, kind string, ts string, text string, tool_calls array<struct<id:string,name:string,input:string>>, tool_results array<struct<id:string,output:string>>, received_at timestamp, g string"


def at(n):
    return datetime(2026, 1, 1, 0, n // 60, n % 60)


def t(s, u, kind, ts, text="x", n=0, calls=None, results=None):
    return (s, u, kind, ts, text, calls, results, at(n), "extra")


def run(spark, rows, opened=()):
    turns = spark.createDataFrame(rows, TURN)
    o = spark.createDataFrame([(x,) for x in opened], "session_id string")
    return {r["session_id"]: r["reason"] for r in C.sessions(C.links(turns), o, turns).collect()}


def test_reasons(spark):
    rows = [
        t("ok", "1", " User ", "2026-01-01T00:00:00Z"), t("ok", "2", "ASSISTANT", "2026-01-01T02:00:01+02:00"), t("ok", "3", "progress", "bad"),
        t("late", "1", "user", "1767225600"), t("late", "2", "assistant", "1767225601000"), t("late", "2", "assistant", "n/a", "x", 5),
        t("blank", "1", "user", "2026-01-01 00:00:00", "  \n"), t("first", "1", "assistant", "2026-01-01 00:00:00"),
        t("twice", "1", "user", "2026-01-01 00:00:00"), t("twice", "2", "user", "2026-01-01 00:00:01"), t("twice", "3", "assistant", "2026-01-01 00:00:02"),
        t("open", "1", "user", "2026-01-01 00:00:00"), t(None, "1", "user", "2026-01-01 00:00:00"),
        t("tool", "1", "user", "2026-01-01 00:00:00"), t("tool", "2", "assistant", "2026-01-01 00:00:01", None, 0, [("c1", "Read", "{}")]),
        t("edited", "1", "user", "2026-01-01 00:00:00", "x", 1), t("edited", "2", "assistant", "2026-01-01 00:00:01", "x", 1), t("edited", "2", "assistant", "2026-01-01 00:00:01", "", 2),
    ]
    got = run(spark, rows, ["none", "ok", None])
    assert got == {"ok": None, "late": "untimed", "blank": "empty", "first": "no_question", "twice": "unanswered", "open": "no_answer", "tool": None, "edited": "no_answer", "none": "empty"}


def test_links_and_hot_session(spark, monkeypatch):
    rows = []
    for i in range(120):
        kind = "user" if i % 2 == 0 else "assistant"
        rows.append(t("hot", f"u{i:03d}", kind, f"2026-01-01T00:{i // 60:02d}:{i % 60:02d}Z", f"about topic{i // 2} here"))
    turns = spark.createDataFrame(rows, TURN)
    whole = {r["uuid"]: r["parent_uuid"] for r in C.links(turns).collect()}
    assert whole["u001"] == "u000" and whole["u051"] == "u050"
    out = C.conversations(turns, spark.createDataFrame([("hot",)], "session_id string")).collect()
    assert sorted(r["turn_no"] for r in out) == list(range(120))
    roots = {r["uuid"]: r["conversation"] for r in out}
    for u, p in whole.items():
        assert roots[u] == (u if p is None else roots[p])


def test_mentions_far_back(spark):
    rows = [t("s", "q", "user", "2026-01-01T00:00:00Z", "first question"), t("s", "call", "assistant", "2026-01-01T00:00:01Z", None, 0, [("c9", "Read", "{}")])]
    for i in range(30):
        rows.append(t("s", f"n{i:02d}", "user" if i % 2 == 0 else "assistant", f"2026-01-01T00:00:{i + 2:02d}Z", f"other thread{i // 2}"))
    rows.append(t("s", "result", "user", "2026-01-01T00:00:40Z", None, 0, None, [("c9", "out")]))
    rows.append(t("s", "0f-11-Aa", "assistant", "2026-01-01T00:00:41Z", "fine"))
    rows += [t("s", f"m{i:02d}", "user" if i % 2 == 0 else "assistant", f"2026-01-01T00:00:{i + 42:02d}Z", f"more thread{i // 2}") for i in range(12)]
    rows += [t("s", "back", "user", "2026-01-01T00:00:55Z", "as said in 0F-11-aa above"), t("s", "end", "assistant", "2026-01-01T00:00:56Z", "zzz", 0), t("z", "a", "user", "2026-01-01T00:00:58Z", "x", 0, None, [("c9", "out")])]
    got = {(r["session_id"], r["uuid"]): r["parent_uuid"] for r in C.links(spark.createDataFrame(rows, TURN)).collect()}
    assert len(got) == len(rows) and got["s", "result"] == "call" and got["s", "back"] == "0f-11-Aa" and got["z", "a"] is None
    out = {r["uuid"]: r for r in C.conversations(spark.createDataFrame([r for r in rows if r[0] == "s"], TURN), spark.createDataFrame([("s",)], "session_id string")).collect()}
    assert out["result"]["conversation"] == out["call"]["conversation"]


def test_planted_interleaving(spark):
    """24 channels of one session take turns, so a reply comes 24 turns after what it answers; both share words that nobody else uses."""
    rows, want = [], {}
    for i in range(8):
        for c in range(24):
            k = i * 24 + c
            rows.append(t("s", f"c{c}-{i}", "user" if i % 2 == 0 else "assistant", f"2026-01-01T00:{k // 60:02d}:{k % 60:02d}Z", f"the build step link_{c}_{i} and link_{c}_{i + 1} of channel{c}"))
            want[f"c{c}-{i}"] = f"c{c}-{i - 1}" if i else None
    got = {r["uuid"]: r["parent_uuid"] for r in C.links(spark.createDataFrame(rows, TURN)).collect()}
    replies = [u for u in want if want[u]]
    assert sum(got[u] == want[u] for u in replies) >= 0.9 * len(replies)


def test_same_links_for_any_block(spark, monkeypatch):
    rows = [t("s" if i % 3 else "r", f"u{i:03d}", "user" if i % 2 == 0 else "assistant", f"2026-01-01T00:{i // 60:02d}:{i % 60:02d}Z", f"word{i % 7} other{i // 9}") for i in range(150)]
    turns = spark.createDataFrame(rows, TURN)
    one = {(r["uuid"], r["parent_uuid"], r["score"], r["prev_kind"]) for r in C.links(turns).collect()}
    monkeypatch.setattr(C, "BLOCK", 32)
    assert one == {(r["uuid"], r["parent_uuid"], r["score"], r["prev_kind"]) for r in C.links(turns.repartition(5)).collect()}


def test_empty(spark):
    turns = spark.createDataFrame([], TURN)
    o = spark.createDataFrame([], "session_id string")
    assert C.conversations(turns, o).count() == 0
    assert C.sessions(C.links(turns), o, turns).count() == 0


def exhaustive(t):
    """Every turn with the likeliest of all turns before it in its session, by the definition; ``t``: rows of the worded turns."""
    out = {}
    for c in t:
        best = None
        for p in (p for p in t if p["session_id"] == c["session_id"] and p["g"] < c["g"]):
            gap = C.NO_GAP if c["us"] is None or p["us"] is None else max((c["us"] - p["us"]) / 6e7, 0.0)
            both = len(set(c["words"]) & set(p["words"]))
            mention = set(c["results"]) & set(p["calls"]) or p["uuid"].lower() in c["names"]
            score = -C.DECAY * math.log1p(gap) + C.ALTERNATE * (c["kind"] != p["kind"]) + C.MENTION * bool(mention) + (C.OVERLAP * both / len(set(c["words"]) | set(p["words"])) if both else 0.0)
            best = max(best or (-1e9, -1, ""), (round(score, 6), p["g"], p["uuid"]))
        out[c["session_id"], c["uuid"]] = best[2] if best and best[0] >= C.ROOT else None
    return out


def test_far_parent_by_common_words(spark):
    """Nobody is mentioned, and each word is used by more turns than a telling word may have."""
    rows = [t("s", "asks", "user", "2026-01-01T00:00:00Z", "alpha beta gamma delta")]
    for i in range(40):
        rows.append(t("s", f"n{i:02d}", "user" if i % 2 else "assistant", f"2026-01-01T00:01:{i:02d}Z", f"{('alpha', 'beta', 'gamma', 'delta')[i % 4]} other{i % 3} thing{i % 2}"))
    rows.append(t("s", "answers", "assistant", "2026-01-01T00:01:50Z", "alpha beta gamma delta"))
    got = {r["uuid"]: r["parent_uuid"] for r in C.links(spark.createDataFrame(rows, TURN)).collect()}
    assert got["answers"] == "asks"


def test_links_are_the_likeliest_of_all(spark, monkeypatch):
    rng = random.Random(11)
    rows, words = [], [f"word{chr(97 + i)}" for i in range(14)]
    for s, n, step in (("quick", 90, 2), ("slow", 90, 4000), ("mixed", 90, 700), ("same", 60, 0), ("void", 60, None), ("short", 17, 30)):
        now = 1767225600
        for i in range(n):
            now += rng.choice((0, 1, 1, 3)) * (step or 0)
            untimed = step is None or s == "mixed" and i % 9 == 0
            kind = "user" if i == 0 or s == "slow" and i > 30 or s != "slow" and rng.random() < 0.5 else "assistant"
            text = " ".join(rng.choices(words, k=rng.choice((0, 1, 3, 8))))
            rows.append(t(s, f"u{i:02d}", kind, "n/a" if untimed else str(now), text or "..", i))
    turns = spark.createDataFrame(rows, TURN)
    want = exhaustive(C._worded(C.positioned(C.counting_turns(turns), ["session_id", "us", "received_at", "uuid"])).collect())
    found = lambda: {(r["session_id"], r["uuid"]): r["parent_uuid"] for r in C.links(turns).collect()}
    assert found() == want
    for name, value in (("BLOCK", 32), ("FEW", 7)):  # values carried over blocks; time buckets
        monkeypatch.setattr(C, name, value)
    assert found() == want
