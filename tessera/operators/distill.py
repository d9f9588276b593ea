"""From a session's turns to a compact checkpoint.

Turns carry ``session_id`` and ``seq`` (their order), ``kind``, ``text``, ``tool_calls`` (id, name, input as JSON) and ``tool_results`` (id, output).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialise

#: Turns kept whole, bytes of a checkpoint, characters of a result's head; goals, decisions and the longest decision (fixed values).
KEEP, MAX_BYTES, HEAD, GOALS, DECISIONS, DECISION_CHARS = 6, 24_000, 240, 4, 12, 240
VOLATILE = ("Read", "Grep", "Glob", "Bash", "WebFetch", "WebSearch")
EDITS = ("Edit", "Write", "NotebookEdit")
#: Lines of a text that look like decisions (fixed values).
DECISION_LINES = (
    r"(?imd)^\s*(?:decision|chose|picked|going with|we['’]ll)\b.*",
    r"(?imd)^\s*(?:don['’]t|avoid|not using)\b.*",
)


def session_attributes(turns: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The last non-empty value of each named column of a session."""
    last = [F.max_by(F.nullif(F.col(c), F.lit("")), F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), F.col("seq"))).alias(c) for c in names]
    return turns.groupBy("session_id").agg(*last)


def goals(turns: DataFrame, most: int = GOALS) -> DataFrame:
    """The first messages of the user that aren't blank or machine made: ``session_id, n, goal``."""
    t = turns.filter((F.col("kind") == "user") & F.col("text").isNotNull()).withColumn("goal", F.trim("text"))
    t = t.filter((F.col("goal") != "") & ~F.col("goal").startswith("<") & ~F.col("goal").startswith("[") & ~F.col("goal").startswith('{"'))
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("seq"))
    return t.withColumn("n", n).filter(F.col("n") <= most).select("session_id", "n", "goal")


def decision_lines(turns: DataFrame, most: int = DECISIONS, longest: int = DECISION_CHARS, patterns: tuple[str, ...] = DECISION_LINES) -> DataFrame:
    """Distinct decision-like lines of the assistant in the order of turn, pattern and place: ``session_id, n, decision``."""
    t = turns.filter((F.col("kind") == "assistant") & F.col("text").isNotNull())

    def placed(k: int, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda s, i: F.struct(F.lit(k).alias("p"), i.alias("i"), F.trim(s).alias("decision")))

    found = [placed(k, p) for k, p in enumerate(patterns)]
    e = t.select("session_id", "seq", F.explode(F.concat(*found)).alias("x")).select("session_id", "seq", "x.*").filter((F.col("decision") != "") & (F.length("decision") < longest))
    first = e.groupBy("session_id", "decision").agg(F.min(F.struct("seq", "p", "i")).alias("at"))
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("at"))
    return first.withColumn("n", n).filter(F.col("n") <= most).select("session_id", "n", "decision")


def calls(turns: DataFrame) -> DataFrame:
    """Tool calls in order: ``session_id, seq, k, call_id, name, input``."""
    return turns.select("session_id", "seq", "kind", F.posexplode("tool_calls").alias("k", "c")).select("session_id", "seq", "kind", "k", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.input").alias("input"))


def results(turns: DataFrame) -> DataFrame:
    """The last output of each call id: ``session_id, call_id, output``."""
    r = turns.select("session_id", "seq", F.posexplode("tool_results").alias("k", "r")).select("session_id", F.col("r.id").alias("call_id"), F.struct("seq", "k").alias("at"), F.coalesce("r.output", F.lit("")).alias("output"))
    return r.filter("call_id is not null and call_id <> ''").groupBy("session_id", "call_id").agg(F.max_by("output", "at").alias("output"))


def answered_calls(turns: DataFrame) -> DataFrame:
    """Tool calls with the output of their result, '' where none came."""
    return calls(turns).join(results(turns), ["session_id", "call_id"], "left").withColumn("output", F.coalesce("output", F.lit("")))


def field(name: str) -> Column:
    return F.get_json_object("input", f"$.{name}")


def files_touched(turns: DataFrame, fields: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """Edited files (named by the first of ``fields`` in the call's input) with the last operation, in the order in which they were first seen: ``session_id, path, op, n``."""
    e = calls(turns).filter(F.col("name").isin(*EDITS)).withColumn("path", F.coalesce(*[field(x) for x in fields])).filter("path is not null and path <> ''").withColumn("at", F.struct("seq", "k"))
    g = e.groupBy("session_id", "path").agg(F.max_by("name", "at").alias("op"), F.min("at").alias("first"))
    return g.withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy("first"))).select("session_id", "path", "op", "n")


def summary() -> Column:
    """One line for a tool call with ``name``, ``input`` and ``output``."""
    out = F.col("output")
    n_lines = lambda c: F.size(F.filter(F.split(c, "\r\n|\r|\n"), lambda s: F.trim(s) != ""))
    read = F.concat(F.lit("Read "), F.coalesce(F.nullif(field("file_path"), F.lit("")), F.nullif(field("path"), F.lit("")), F.lit("?")), F.lit(" ("), F.length(out) - F.length(F.replace(out, F.lit("\n"), F.lit(""))), F.lit(" lines)"))
    kind = F.coalesce(F.nullif(field("type"), F.lit("")), field("glob"), F.lit(""))
    grep = F.concat(F.lit("Grep /"), F.coalesce(field("pattern"), F.lit("")), F.lit("/"), F.when(kind != "", F.concat(F.lit(" filter="), kind)).otherwise(""), F.lit(" → ~"), n_lines(F.concat(F.substring(out, 1, HEAD), F.when(F.length(out) > HEAD, "…").otherwise(""))), F.lit(" match line(s)"))
    paths = F.when(out == "", 0).otherwise(F.size(F.split(F.regexp_replace(out, r"(\r\n|\r|\n)\z", ""), "\r\n|\r|\n")))
    glob = F.concat(F.lit("Glob "), F.coalesce(field("pattern"), F.lit("?")), F.lit(" → "), paths, F.lit(" path(s)"))
    bash = F.concat(F.lit("$ "), F.substring(F.coalesce(field("command"), F.lit("")), 1, 160), F.lit("  →  "), F.substring(F.replace(F.trim(out), F.lit("\n"), F.lit(" ⏎ ")), 1, HEAD))
    web = F.concat(F.col("name"), F.lit(" "), F.substring(F.coalesce(F.nullif(field("url"), F.lit("")), field("query"), F.lit("")), 1, 120))
    edit = F.concat(F.col("name"), F.lit(" "), F.coalesce(field("file_path"), F.lit("?")))
    return F.when(F.col("name") == "Read", read).when(F.col("name") == "Grep", grep).when(F.col("name") == "Glob", glob).when(F.col("name") == "Bash", bash).when(F.col("name").isin("WebFetch", "WebSearch"), web).otherwise(edit)


def with_age(turns: DataFrame, keep: int = KEEP) -> DataFrame:
    """Adds ``recent``: whether a turn is among the last ``keep`` of its session.

    The last turns are found first (a limit per session that works before the shuffle), then joined, so a long session isn't one task's work.
    """
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("seq")))
    last = turns.select("session_id", "seq").withColumn("_b", back).filter(F.col("_b") <= keep).groupBy("session_id").agg(F.min("seq").alias("_from"))
    return turns.join(last, "session_id").withColumn("recent", F.col("seq") >= F.col("_from")).drop("_from")


def older_log(turns: DataFrame, keep: int = KEEP) -> DataFrame:
    """Lines for the assistant's volatile tool calls and edits outside the recent turns: ``session_id, seq, k, line``."""
    old = with_age(turns, keep).filter(~F.col("recent"))
    return _old_lines(calls(old).join(results(turns), ["session_id", "call_id"], "left").withColumn("output", F.coalesce("output", F.lit(""))))


def _old_lines(answered: DataFrame) -> DataFrame:
    wanted = answered.filter((F.col("kind") == "assistant") & F.col("name").isin(*VOLATILE, *EDITS))
    return wanted.select("session_id", "seq", "k", F.concat(F.lit("- "), summary()).alias("line"))


def within_budget(log: DataFrame, budget: int) -> DataFrame:
    """The longest suffix of a session's log lines whose bytes, with a line end each, stay within the budget."""
    w = Window.partitionBy("session_id").orderBy(F.desc("seq"), F.desc("k"))
    near = log.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max(budget, 1)).drop("_r")  # a line has a byte at least, so no more can fit
    return near.withColumn("bytes", F.sum(F.octet_length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter(F.col("bytes") <= budget)


def checkpoints(turns: DataFrame, sessions: DataFrame, keep: int = KEEP, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``session_id, checkpoint``: goals, files, decisions, compacted older activity and recent turns of every session as text.

    Older activity gives way, oldest line first, until the whole fits ``max_bytes``; what remains may still exceed it. An emptied section disappears.
    ``sessions``: session_id, cwd, git_branch (one row each).
    """
    turns = aged = materialise(with_age(turns, keep), "turns")  # read by every section
    answered = materialise(answered_calls(turns), "calls")

    def listed(df: DataFrame, order: Column, line: Column, title: str, name: str) -> DataFrame:
        rows = df.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), line.alias("l")))).alias("x"))
        return rows.select("session_id", F.concat(F.lit(title + "\n"), F.array_join(F.transform("x", lambda s: s["l"]), "\n"), F.lit("\n\n")).alias(name))

    head = F.substring_index(F.regexp_replace("goal", "\r\n|\r", "\n"), "\n", 1)
    g = listed(goals(turns), F.col("n"), F.concat(F.lit("- "), F.substring(head, 1, 280)), "## What the user asked for", "goals")
    f = listed(files_touched(turns), F.col("n"), F.concat(F.lit("- `"), F.col("path"), F.lit("` ("), F.col("op"), F.lit(")")), "## Files touched", "files")
    d = listed(decision_lines(turns), F.col("n"), F.concat(F.lit("- "), F.col("decision")), "## Decisions", "decisions")
    recent_calls = answered.join(aged.filter("recent").select("session_id", "seq"), ["session_id", "seq"], "left_semi")
    call_line = F.concat(F.lit("- tool: "), F.when(F.col("name").isin(*VOLATILE), summary()).otherwise(F.rtrim(F.concat(F.col("name"), F.lit(" "), F.coalesce(field("file_path"), F.lit(""))))))
    per_turn = recent_calls.groupBy("session_id", "seq").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", call_line.alias("l")))), lambda s: s["l"]), "\n").alias("tools"))
    body = F.concat_ws("\n", F.concat(F.lit("### "), F.col("kind")), F.nullif(F.substring("text", 1, 2000), F.lit("")), F.col("tools"), F.lit(""))
    r = listed(aged.filter("recent").join(per_turn, ["session_id", "seq"], "left"), F.col("seq"), body, "## Recent turns (verbatim)", "recent")
    n = aged.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("recent").cast("int")).alias("kept"))
    base = sessions.join(n, "session_id").join(g, "session_id", "left").join(f, "session_id", "left").join(d, "session_id", "left").join(r, "session_id", "left")
    top = F.concat(F.lit("# Session checkpoint\n\n- session: `"), F.col("session_id"), F.lit("`\n- cwd: `"), F.coalesce("cwd", F.lit("?")), F.lit("`\n"), F.coalesce(F.concat(F.lit("- branch: `"), F.nullif(F.col("git_branch"), F.lit("")), F.lit("`\n")), F.lit("")), F.lit("- turns: "), F.col("n"), F.lit(" (last "), F.col("kept"), F.lit(" kept verbatim)\n\n"))
    base = base.select("session_id", F.concat(top, *[F.coalesce(c, F.lit("")) for c in ("goals", "files", "decisions")]).alias("top"), F.coalesce("recent", F.lit("")).alias("recent"))
    title = "## Earlier activity (compacted)"
    room = base.select("session_id", (F.lit(max_bytes) - F.octet_length("top") - F.octet_length("recent") - F.lit(len(title) + 3)).alias("room"))
    fit = within_budget(_old_lines(answered.join(aged.filter("not recent").select("session_id", "seq"), ["session_id", "seq"], "left_semi")), max_bytes).join(room, "session_id").filter(F.col("bytes") <= F.col("room"))
    log = listed(fit, F.struct("seq", "k"), F.col("line"), title, "log")
    return base.join(log, "session_id", "left").select("session_id", F.concat("top", F.coalesce("log", F.lit("")), "recent").alias("checkpoint"))
