"""Distillation queries over the turns of sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import distill as D
from tessera.plans.common import TURNS, turns
from tessera.session import read_table


PATTERNS = (r"(?imd)^\s*(?:put|run|use|keep)\b.*", r"(?imd)^\s*(?:nobody|never|if)\b.*")


def session_last_nonempty(spark, sf):
    t = turns(spark, sf)
    return D.session_attributes(t, ("kind", "text")).select("session_id", F.col("kind").alias("last_kind"), F.md5("text").alias("last_text"))


def user_goals_first4(spark, sf):
    return D.goals(turns(spark, sf)).select("session_id", "n", F.md5("goal").alias("goal"))


def decision_lines(spark, sf):
    """The operator with patterns that occur in the test data; its own patterns are covered by unit tests."""
    return D.decision_lines(turns(spark, sf), patterns=PATTERNS)


def decision_lines_default(spark, sf):
    """With the operator's own patterns."""
    return D.decision_lines(turns(spark, sf))


def recent_vs_older_split(spark, sf):
    return D.with_age(turns(spark, sf)).groupBy("session_id", "recent").agg(F.count(F.lit(1)).alias("turns"))


def files_touched_last_op(spark, sf):
    return D.files_touched(turns(spark, sf), ("file_path", "path"))


def tool_result_left_join(spark, sf):
    return D.answered_calls(turns(spark, sf)).select("session_id", "call_id", "name", F.octet_length("output").alias("bytes"))


def tool_call_counts(spark, sf):
    c = D.calls(turns(spark, sf))
    return c.groupBy("name").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("session_id").alias("sessions"), F.sum(F.col("name").isin(*D.VOLATILE).cast("long")).alias("volatile"))


def byte_budget_suffix(spark, sf):
    t = turns(spark, sf).filter("text is not null").select("session_id", "seq", F.lit(0).alias("k"), F.col("text").alias("line"))
    return D.within_budget(t, 1500).select("session_id", "seq", "bytes")


def tool_summaries(spark, sf):
    return D.older_log(turns(spark, sf)).select("session_id", "seq", "k", "line")


def checkpoint_render(spark, sf):
    s = read_table(spark, sf, "chat_sessions").groupBy("session_id").agg(F.max("cwd").alias("cwd"), F.max("git_branch").alias("git_branch"))
    return D.checkpoints(turns(spark, sf), s)


QUERIES = {f.__name__: f for f in (
    session_last_nonempty, user_goals_first4, decision_lines, decision_lines_default, recent_vs_older_split, files_touched_last_op, tool_result_left_join, tool_call_counts, byte_budget_suffix, tool_summaries, checkpoint_render,
)}

_CALLS = f"{TURNS}, c0 AS (SELECT session_id, seq, kind, unnest(tool_calls) AS c, generate_subscripts(tool_calls, 1) - 1 AS k FROM t), c AS (SELECT session_id, seq, kind, k, c.id AS call_id, c.name AS name, c.input AS input FROM c0)"
_RES = "r0 AS (SELECT session_id, seq, unnest(tool_results) AS r, generate_subscripts(tool_results, 1) AS k FROM t), r AS (SELECT session_id, r.id AS call_id, arg_max(coalesce(r.output, ''), seq * 1000 + k) AS output FROM r0 WHERE coalesce(r.id, '') <> '' GROUP BY 1, 2)"


def _decided(patterns: tuple[str, ...]) -> str:
    found = " UNION ALL ".join(
        "SELECT session_id, seq, {k} AS p, unnest(regexp_extract_all(text, '{p}')) AS d, generate_subscripts(regexp_extract_all(text, '{p}'), 1) AS i FROM t WHERE kind = 'assistant' AND text IS NOT NULL".format(k=k, p=p.replace("(?imd)", "(?im)").replace("'", "''")) for k, p in enumerate(patterns)
    )
    return f"""WITH {TURNS}, d AS (SELECT session_id, trim(d, ' ') AS decision, seq, p, i FROM ({found})), f AS (SELECT session_id, decision, min(seq * 1000000 + p * 10000 + i) AS pos FROM d WHERE decision <> '' AND length(decision) < 240 GROUP BY 1, 2)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS n, decision FROM f QUALIFY n <= 12"""


_J = lambda f: f"json_extract_string(input, '$.{f}')"

ORACLES = {
    "session_last_nonempty": f"WITH {TURNS} SELECT session_id, arg_max(nullif(kind, ''), CASE WHEN kind <> '' THEN seq END) AS last_kind, md5(arg_max(nullif(text, ''), CASE WHEN text <> '' THEN seq END)) AS last_text FROM t GROUP BY 1",
    "user_goals_first4": f"""WITH {TURNS}, g AS (SELECT session_id, seq, trim(text, ' ') AS goal FROM t WHERE kind = 'user' AND text IS NOT NULL)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n, md5(goal) AS goal FROM g WHERE goal <> '' AND NOT starts_with(goal, '<') AND NOT starts_with(goal, '[') AND NOT starts_with(goal, '{{"') QUALIFY n <= 4""",
    "decision_lines": _decided(PATTERNS),
    "decision_lines_default": _decided(D.DECISION_LINES),
    "recent_vs_older_split": f"WITH {TURNS}, a AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 6 AS recent FROM t) SELECT session_id, recent, count(*) AS turns FROM a GROUP BY 1, 2",
    "files_touched_last_op": f"""WITH {_CALLS}, e AS (SELECT session_id, coalesce({_J('file_path')}, {_J('path')}) AS path, name, seq * 1000 + k AS pos FROM c WHERE name IN ('Edit', 'Write', 'NotebookEdit')), g AS (SELECT session_id, path, arg_max(name, pos) AS op, min(pos) AS f FROM e WHERE path <> '' GROUP BY 1, 2)
SELECT session_id, path, op, row_number() OVER (PARTITION BY session_id ORDER BY f) AS n FROM g""",
    "tool_result_left_join": f"WITH {_CALLS}, {_RES} SELECT session_id, call_id, name, strlen(coalesce(output, ''))::INTEGER AS bytes FROM c LEFT JOIN r USING (session_id, call_id)",
    "tool_call_counts": f"WITH {_CALLS} SELECT name, count(*) AS calls, count(DISTINCT session_id) AS sessions, cast(sum(CASE WHEN name IN ('Read', 'Grep', 'Glob', 'Bash', 'WebFetch', 'WebSearch') THEN 1 ELSE 0 END) AS BIGINT) AS volatile FROM c GROUP BY 1",
    "byte_budget_suffix": f"WITH {TURNS}, b AS (SELECT session_id, seq, cast(sum(strlen(text) + 1) OVER (PARTITION BY session_id ORDER BY seq DESC) AS BIGINT) AS bytes FROM t WHERE text IS NOT NULL) SELECT * FROM b WHERE bytes <= 1500",
    "tool_summaries": f"""WITH {_CALLS}, {_RES}, a AS (SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 6 AS recent FROM t),
o AS (SELECT c.session_id, c.seq, c.k, name, input, coalesce(output, '') AS out FROM c JOIN a ON a.session_id = c.session_id AND a.seq = c.seq AND NOT recent LEFT JOIN r ON r.session_id = c.session_id AND r.call_id = c.call_id WHERE kind = 'assistant'),
x AS (SELECT *, out[1:240] || CASE WHEN length(out) > 240 THEN '…' ELSE '' END AS head, coalesce(nullif({_J('type')}, ''), {_J('glob')}, '') AS tp FROM o)
SELECT session_id, seq, k::INTEGER AS k, '- ' || CASE WHEN name = 'Read' THEN 'Read ' || coalesce(nullif({_J('file_path')}, ''), nullif({_J('path')}, ''), '?') || ' (' || (length(out) - length(replace(out, chr(10), ''))) || ' lines)'
WHEN name = 'Grep' THEN 'Grep /' || coalesce({_J('pattern')}, '') || '/' || CASE WHEN tp <> '' THEN ' filter=' || tp ELSE '' END || ' → ~' || len(list_filter(regexp_split_to_array(head, '\r\n|\r|\n'), lambda s: trim(s, ' ') <> '')) || ' match line(s)'
WHEN name = 'Glob' THEN 'Glob ' || coalesce({_J('pattern')}, '?') || ' → ' || CASE WHEN out = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(out, '(\r\n|\r|\n)$', ''), '\r\n|\r|\n')) END || ' path(s)'
WHEN name = 'Bash' THEN '$ ' || coalesce({_J('command')}, '')[1:160] || '  →  ' || replace(trim(out, ' '), chr(10), ' ⏎ ')[1:240]
WHEN name IN ('WebFetch', 'WebSearch') THEN name || ' ' || coalesce(nullif({_J('url')}, ''), {_J('query')}, '')[1:120] ELSE name || ' ' || coalesce({_J('file_path')}, '?') END AS line
FROM x WHERE name IN ('Read', 'Grep', 'Glob', 'Bash', 'WebFetch', 'WebSearch', 'Edit', 'Write', 'NotebookEdit')""",
}
