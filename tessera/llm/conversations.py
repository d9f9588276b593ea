"""Rebuilding conversations from message rows.

The deduplicated turns get a global position in the order (session, time). Blocks of equal numbers of positions, each with
the few positions before it, are independent windows, so a session that holds a third of all rows is spread like any other. Every turn scores candidate
parents by time, mentions (a tool result names a tool call, a text a ``uuid``) and lexical overlap, and takes the likeliest; the links form trees.
Candidates are all turns before it in its session: those just before, however far back those that it mentions or shares a telling word with, and of the
rest every one whose shared words may make up for its distance; all are found and scored with built-in functions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialise, positioned

#: Turns just before a turn that are always scored; positions in a block; most turns of a session that use a telling word; most that use a word sought without regard to time.
CANDIDATES, BLOCK, TELLING, FEW = 16, 4096, 6, 256
#: Weights of the link score: mention, role change, lexical overlap, and loss per e-fold of the gap in minutes; a best score below ROOT starts a tree.
MENTION, ALTERNATE, OVERLAP, DECAY, ROOT = 6.0, 1.5, 3.0, 0.35, -2.5
#: Minutes that a gap counts if a time isn't usable.
NO_GAP = 1e4
WORD, NAME = r"[A-Za-z_][A-Za-z0-9_]{2,}", r"[A-Za-z0-9_-]{3,}"


def parse_ts(c: Column) -> Column:
    """Microseconds since the epoch of a time in ISO notation (UTC without offset) or epoch seconds or milliseconds; else null."""
    s = F.trim(c)
    digits = F.when(s.rlike(r"^\d{9,11}$"), s.try_cast("bigint") * 1_000_000).when(s.rlike(r"^\d{12,14}$"), s.try_cast("bigint") * 1_000)
    bare = s.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$")
    iso = bare | s.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)? ?(Z|z|[+-]\d{2}:?\d{2})$")
    fixed = F.regexp_replace(F.regexp_replace(F.upper(s), r" ?([+-]\d{2}):?(\d{2})$", "$1:$2"), r" Z$", "Z")
    zoned = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(s, F.lit("T00:00:00Z"))).when(bare, F.concat(s, F.lit("Z"))).otherwise(fixed)
    return F.coalesce(digits, F.when(iso, F.unix_micros(zoned.try_cast("timestamp"))))


def counting_turns(turns: DataFrame) -> DataFrame:
    """One row per session and ``uuid`` that counts: ``session_id, uuid, kind, us, text, calls, results, received_at``.

    The row received last stands for all rows of its session and ``uuid`` (a null ``uuid`` stands for itself); only kinds user and assistant
    with text, a tool call or a tool result count. Rows without session belong to none. ``us`` is null where the time isn't usable.
    """
    key = F.coalesce("uuid", F.concat(F.lit("row-"), F.sha2(F.to_json(F.struct("kind", "ts", "text", "received_at")), 256)))
    row = F.struct("received_at", F.coalesce("ts", F.lit("")).alias("ts"), F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.col("tool_calls.id").alias("calls"), F.col("tool_results.id").alias("results"), F.coalesce(F.size("tool_calls"), F.lit(0)).alias("n_calls"), F.coalesce(F.size("tool_results"), F.lit(0)).alias("n_results"))
    last = turns.filter("session_id is not null").groupBy("session_id", key.alias("uuid")).agg(F.max(row).alias("x")).select("session_id", "uuid", "x.*")
    last = last.withColumn("kind", F.lower(F.regexp_replace("kind", r"(?U)^\s+|\s+$", ""))).filter("kind in ('user', 'assistant')")
    last = last.filter(F.col("text").rlike(r"(?U)\S") | (F.col("n_calls") > 0) | (F.col("n_results") > 0))
    return last.select("session_id", "uuid", "kind", parse_ts(F.col("ts")).alias("us"), "text", "calls", "results", "received_at")


def _score(child: Callable[[str], Column], parent: Callable[[str], Column]) -> Column:
    """How likely one turn answers another: loss by time, gain by role change, mention and shared words."""
    gap = F.coalesce((child("us") - parent("us")) / 6e7, F.lit(NO_GAP))
    common = F.size(F.array_intersect(child("words"), parent("words")))
    either = F.size(child("words")) + F.size(parent("words")) - common
    mention = F.arrays_overlap(child("results"), parent("calls")) | F.array_contains(child("names"), F.lower(parent("uuid")))
    return F.round(
        -DECAY * F.log1p(F.greatest(gap, F.lit(0.0))) + F.when(child("kind") != parent("kind"), ALTERNATE).otherwise(0.0) + F.when(F.coalesce(mention, F.lit(False)), MENTION).otherwise(0.0)
        + F.when((F.size(child("words")) > 0) & (F.size(parent("words")) > 0), OVERLAP * common / either).otherwise(0.0), 6,
    )


def _worded(turns: DataFrame) -> DataFrame:
    """Adds ``words`` (hashes of the distinct words), ``names`` (what may be a ``uuid``); empty ids of calls and results drop out."""
    ids = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    found = lambda p: F.regexp_extract_all(F.lower("text"), F.lit(p), F.lit(0))
    return turns.withColumn("words", F.transform(F.array_distinct(found(WORD)), lambda w: F.xxhash64(w))).withColumn("names", F.array_distinct(found(NAME))).withColumn("calls", ids("calls")).withColumn("results", ids("results"))


def far_pairs(t: DataFrame) -> DataFrame:
    """``g, p``: every turn with the turns more than CANDIDATES before it in its session that it mentions or shares a telling word with.

    A word is telling if at most TELLING of the turns ``t`` of the session use it, so a word gives a bounded number of pairs; see ``common_pairs`` for the others.
    """
    each = lambda c: t.select("session_id", "g", F.explode(c).alias("w")).select(F.xxhash64("session_id", "w").alias("x"), "g")
    call, result, word = each("calls").withColumnRenamed("g", "p"), each("results"), each("words")
    named = t.select(F.lower("uuid").alias("w"), "session_id", F.col("g").alias("p"))
    lengths = F.broadcast(named.select(F.length("w").alias("n")).distinct())  # few: only words as long as some uuid are joined
    name = t.select("session_id", "g", F.explode("names").alias("w")).withColumn("n", F.length("w")).join(lengths, "n", "left_semi").drop("n")
    telling = word.groupBy("x").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(2, TELLING)).select("x")
    used = word.join(telling, "x").groupBy("x").agg(F.collect_list("g").alias("gs")).select(F.explode("gs").alias("g"), "gs").select("g", F.explode("gs").alias("p"))
    pairs = result.join(call, "x").select("g", "p").unionByName(name.join(named, ["session_id", "w"]).select("g", "p")).unionByName(used)
    return pairs.filter(F.col("p") < F.col("g") - CANDIDATES).distinct()


def _beyond(rest: Column, size: Column, gain: Column, gap: Column | None = None) -> Column:
    """The most that ``rest`` shared words, ``size`` words in all, can make of a score, less the loss by the gap if it is known."""
    top = OVERLAP * rest / size + gain
    return top if gap is None else top - DECAY * F.log1p(gap)


def common_pairs(t: DataFrame, best: DataFrame) -> DataFrame:
    """``g, p``: the turns more than CANDIDATES before a turn that share only words with it that aren't telling and may still score above its best so far.

    ``best``: ``g, floor`` (the score to beat) and ``least`` (minutes to the nearest of those turns). A prefix filter: with a turn's words from rare to common, the
    first one that two turns share bounds their overlap, and so the time that a parent can lie back. Words of more than FEW turns are
    sought in buckets of that length only. Nothing is dropped but what can't win.
    """
    word = t.select("session_id", "g", "kind", "us", F.size("words").alias("size"), F.explode("words").alias("w")).select(F.xxhash64("session_id", "w").alias("x"), "g", "kind", "us", "size")
    often = word.groupBy("x").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TELLING)
    ranked = word.join(often, "x").groupBy("g", "kind", "us", "size").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("ws"))
    ranked = ranked.select("g", "kind", "us", "size", F.size("ws").alias("k"), F.posexplode("ws").alias("r", "e"))
    ranked = materialise(ranked.select("g", "kind", "us", "size", (F.col("k") - F.col("r")).alias("rest"), "e.n", "e.x"), "common")

    minute, slack = 60_000_000, 1e-5  # scores are rounded
    place = lambda us, level: F.expr(f"({us} + 100000000000000000) div shiftleft({minute}L, 2 * {level})")  # noqa: E731  never negative
    of = F.when(F.col("kind") == "user", F.array(F.lit("assistant"), F.lit("user"))).otherwise(F.array(F.lit("user"), F.lit("assistant")))
    look = ranked.join(best, "g").select("*", F.posexplode(of).alias("same", "of")).withColumn("gain", F.when(F.col("same") == 0, ALTERNATE).otherwise(0.0) - F.col("floor") + slack)
    look = look.withColumn("reach", F.expm1(F.least(_beyond(F.col("rest"), F.col("size"), F.col("gain")) / DECAY, F.lit(24.0))))  # minutes
    timed, untimed = F.col("us").isNotNull() & (F.col("reach") >= F.col("least")), F.col("reach") >= NO_GAP * (1 - slack)
    level = F.greatest(F.ceil(F.log(F.greatest("reach", F.lit(1.0))) / math.log(4)), F.lit(0)).cast("int")
    at = lambda level, bucket: F.struct(level.cast("int").alias("level"), bucket.cast("long").alias("bucket"))  # noqa: E731  level -1: any time; -2: no time
    look = look.filter(timed | untimed).withColumn("level", level)
    buckets = F.when(F.col("n") <= FEW, F.array(at(F.lit(-1), F.lit(0)))).otherwise(
        F.concat(F.when(timed, F.array(at(F.col("level"), place("us", "level")), at(F.col("level"), place("us", "level") - 1))).otherwise(F.array()), F.when(untimed, F.array(at(F.lit(-2), F.lit(0)))).otherwise(F.array()))
    )
    look = look.withColumn("at", F.explode(buckets)).select("x", "of", "at.level", "at.bucket", "g", F.col("us").alias("us_g"), F.col("size").alias("size_g"), F.col("rest").alias("rest_g"), "gain")
    parents = ranked.select("x", F.col("kind").alias("of"), "n", F.col("g").alias("p"), F.col("us").alias("us_p"), F.col("size").alias("size_p"), F.col("rest").alias("rest_p"))
    once = parents.filter((F.col("n") <= FEW) | F.col("us_p").isNull()).withColumn("level", F.when(F.col("n") <= FEW, -1).otherwise(-2)).withColumn("bucket", F.lit(0).cast("long"))
    spans = look.filter("level >= 0").select("x", "level").distinct()
    often_used = parents.filter((F.col("n") > FEW) & F.col("us_p").isNotNull()).join(spans, "x").withColumn("bucket", place("us_p", "level"))
    pairs = look.join(once.unionByName(often_used).drop("n"), ["x", "of", "level", "bucket"]).filter(F.col("p") < F.col("g") - CANDIDATES)
    shared, gap = F.least("rest_g", "rest_p"), F.greatest(F.coalesce((F.col("us_g") - F.col("us_p")) / 6e7, F.lit(NO_GAP)), F.lit(0.0))
    return pairs.filter(_beyond(shared, F.col("size_g") + F.col("size_p") - shared, F.col("gain"), gap) >= 0).select("g", "p").distinct()


def _scored(t: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """``g`` and in ``name`` the likeliest parent among its ``pairs`` of one session."""
    side = lambda tag, *cols: t.select(F.col("g").alias(tag), F.struct(*cols).alias(f"{tag}_"))
    far = pairs.join(side("p", "uuid", "kind", "us", "words", "calls", "session_id"), "p").join(side("g", "kind", "us", "words", "results", "names", "session_id"), "g")
    far = far.filter(F.col("g_.session_id") == F.col("p_.session_id"))  # ids are joined by hashes
    scored = F.struct(_score(lambda c: F.col(f"g_.{c}"), lambda c: F.col(f"p_.{c}")).alias("score"), F.col("p").alias("g"), F.col("p_.uuid").alias("uuid"))
    return far.groupBy("g").agg(F.max(scored).alias(name))


def near_best(t: DataFrame) -> DataFrame:
    """Turns with the likeliest parent ``near`` of the CANDIDATES before, a written table.

    ``child``, ``parent``: whether more than CANDIDATES turns of the session come before, after; ``least``: minutes to the first turn beyond the
    candidates; ``plain``: of the turns of the session before, the last of the other kind and the last untimed ones of either, which
    no other turn beats without a mention or a shared word.
    """
    far, kinds = CANDIDATES + 1, ("user", "assistant")
    marks = {f"{k}_{u}": (F.col("kind") == k) & (F.col("us").isNull() if u == "untimed" else F.lit(True)) for k in kinds for u in ("any", "untimed")}
    latest = [F.max(F.when(c, F.struct("g", "session_id"))) for c in marks.values()]
    own = t.withColumn("b", F.expr(f"g div {BLOCK}")).withColumn("halo", F.lit(False))
    before = t.filter(F.col("g") % BLOCK >= BLOCK - far).withColumn("b", F.expr(f"g div {BLOCK} + 1")).withColumn("halo", F.lit(True))
    after = t.filter(F.col("g") % BLOCK < far).withColumn("b", F.expr(f"g div {BLOCK} - 1")).withColumn("halo", F.lit(True))
    carried = own.groupBy("b").agg(*[x.alias(k) for k, x in zip(marks, latest, strict=True)])  # a row per block
    earlier = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select("b", *[F.max(k).over(earlier).alias(f"_{k}") for k in marks])

    order = Window.partitionBy("b").orderBy("g")
    near = F.collect_list(F.struct("g", "session_id", "uuid", "kind", "us", "words", "calls")).over(order.rowsBetween(-CANDIDATES, -1))
    prev, first = F.lag(F.struct("session_id", "kind")).over(order), F.lag(F.struct("session_id", "us"), far).over(order)
    last = [x.over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(k) for k, x in zip(marks, latest, strict=True)]
    n = own.unionByName(before).unionByName(after).select("*", near.alias("near"), prev.alias("prev"), first.alias("first"), F.lead("session_id", far).over(order).alias("next"), *last).filter("not halo").join(carried, "b", "left")
    mine = F.filter("near", lambda p: p["session_id"] == F.col("session_id"))
    best = F.array_max(F.transform(mine, lambda p: F.struct(_score(F.col, lambda c: p[c]).alias("score"), p["g"].alias("g"), p["uuid"].alias("uuid"))))
    seen = {k: F.greatest(k, f"_{k}") for k in marks}
    plain = F.array(F.when(F.col("kind") == "user", seen["assistant_any"]).otherwise(seen["user_any"]), seen["user_untimed"], seen["assistant_untimed"])
    plain = F.array_distinct(F.transform(F.filter(plain, lambda p: (p["session_id"] == F.col("session_id")) & (p["g"] < F.col("g") - CANDIDATES)), lambda p: p["g"]))
    out = n.select(
        "session_id", "uuid", "kind", "us", "g", "words", "names", "calls", "results", best.alias("near"), F.when(F.col("prev.session_id") == F.col("session_id"), F.col("prev.kind")).alias("prev_kind"),
        F.coalesce(F.col("first.session_id") == F.col("session_id"), F.lit(False)).alias("child"), F.coalesce(F.col("next") == F.col("session_id"), F.lit(False)).alias("parent"),
        F.coalesce((F.col("us") - F.col("first.us")) / 6e7, F.lit(NO_GAP)).alias("least"), plain.alias("plain"),
    )
    return materialise(out, "near")


def links(turns: DataFrame) -> DataFrame:
    """Counting turns in order with the likeliest parent: ``session_id, uuid, kind, us, g, parent_g, parent_uuid, score, prev_kind``, a written table.

    All turns before in the session are candidates: those just before, those mentioned or with a shared telling word, and of the others all
    that may score above these. A best score below ROOT, or no turn before, makes a turn a root; of equal scores the later turn counts. The result is the same for any partitioning.
    """
    n = near_best(materialise(_worded(positioned(counting_turns(turns), ["session_id", "us", "received_at", "uuid"])).drop("text", "received_at"), "worded"))
    t = n.filter("child or parent")
    told = far_pairs(t).unionByName(t.filter("child").select("g", F.explode("plain").alias("p"))).distinct()
    n = n.select("session_id", "uuid", "kind", "us", "g", "prev_kind", "child", "least", "near").join(_scored(t, told, "told"), "g", "left")
    n = materialise(n.withColumn("best", F.array_max(F.array("near", "told"))).drop("near", "told"), "told")
    floor = n.filter("child").select("g", F.greatest("best.score", F.lit(ROOT)).alias("floor"), "least")
    n = n.join(_scored(t, common_pairs(t, floor), "common"), "g", "left").withColumn("best", F.array_max(F.array("best", "common")))
    ok = F.col("best.score") >= ROOT
    out = n.select("session_id", "uuid", "kind", "us", "g", F.when(ok, F.col("best.g")).alias("parent_g"), F.when(ok, F.col("best.uuid")).alias("parent_uuid"), F.when(ok, F.col("best.score")).alias("score"), "prev_kind")
    return materialise(out, "links")


def sessions(linked: DataFrame, opened: DataFrame, turns: DataFrame) -> DataFrame:
    """``session_id, n_turns, reason`` of every session named in either table; ``reason`` is null for those that are kept.

    Reasons in this order: ``empty`` (no turn counts), ``untimed``, ``no_question`` (the first isn't the user's), ``no_answer`` (the last
    isn't the assistant's), ``unanswered`` (two of the user follow each other).
    """
    stats = linked.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.max(F.col("us").isNull()).alias("untimed"), F.min_by("kind", "g").alias("first"), F.max_by("kind", "g").alias("last"),
        F.max((F.col("kind") == "user") & F.coalesce(F.col("prev_kind") == "user", F.lit(False))).alias("twice"),
    )
    named = opened.select("session_id").union(turns.select("session_id")).filter("session_id is not null").distinct()
    reason = (
        F.when(F.col("n_turns").isNull(), "empty").when(F.col("untimed"), "untimed").when(F.col("first") != "user", "no_question")
        .when(F.col("last") != "assistant", "no_answer").when(F.col("twice"), "unanswered")
    )
    return named.join(stats, "session_id", "left").select("session_id", F.coalesce("n_turns", F.lit(0)).cast("long").alias("n_turns"), reason.alias("reason"))


def trees(linked: DataFrame) -> DataFrame:
    """``g, top``: the root of every turn's link tree, by pointer doubling: a chain of m links takes log2(m) rounds."""
    tops = linked.select("g", F.coalesce("parent_g", "g").alias("top"))
    while True:
        up = tops.select(F.col("g").alias("top"), F.col("top").alias("up"))
        step = materialise(tops.join(up, "top").select("g", F.col("up").alias("top"), (F.col("up") != F.col("top")).alias("moved")), "tops")
        tops = step.select("g", "top")
        if not step.filter("moved").limit(1).count():
            return tops


def conversations(turns: DataFrame, opened: DataFrame) -> DataFrame:
    """The turns of all kept sessions: ``session_id, turn_no, conversation, uuid, role, parent_uuid, us``.

    ``conversation`` is the ``uuid`` of the root of the turn's link tree, ``turn_no`` its place in the session. Empty tables give no rows.
    """
    linked = links(turns)
    kept = sessions(linked, opened, turns).filter("reason is null").select("session_id")
    firsts = linked.groupBy("session_id").agg(F.min("g").alias("g0"))
    roots = linked.select(F.col("g").alias("top"), F.col("uuid").alias("conversation"))
    rows = linked.join(kept, "session_id", "left_semi").join(trees(linked), "g").join(roots, "top").join(firsts, "session_id")
    return rows.select("session_id", (F.col("g") - F.col("g0")).alias("turn_no"), "conversation", "uuid", F.col("kind").alias("role"), "parent_uuid", "us")
