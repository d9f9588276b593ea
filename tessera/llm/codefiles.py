"""Telling hand-written files from generated, minified, vendored ones and data blobs.

Belief propagation over the directory trees. Every file has a label, every directory a prevailing label; edges hold parent-child compatibilities,
so siblings speak to each other through their directory. Evidence of a file comes from its name, size, symbols, purpose and the text
of its chunks, evidence of a directory from its name. On a tree one pass up and one down give exact marginals. Messages into a directory
are sums of log-likelihoods, so hot directories and repositories are pre-aggregated on the map side; passes go level by level.

What is stated below are starting values. A first run over all files gives marginals, from which the words of head comments are learned (how much
likelier a word is under each label than in hand-written files), and a second run uses them: wording that nobody listed counts once files known
otherwise carry it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import materialise

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
#: Probability of a file's label given its directory's prevailing label (rows), and of a directory's given its parent's.
FILE_GIVEN_DIR = (
    (0.87, 0.045, 0.02, 0.04, 0.025),
    (0.15, 0.80, 0.01, 0.01, 0.03),
    (0.25, 0.02, 0.65, 0.02, 0.06),
    (0.015, 0.01, 0.01, 0.96, 0.005),
    (0.25, 0.02, 0.05, 0.02, 0.66),
)
DIR_GIVEN_PARENT = (
    (0.962, 0.014, 0.008, 0.008, 0.008),
    (0.16, 0.80, 0.01, 0.02, 0.01),
    (0.20, 0.02, 0.72, 0.03, 0.03),
    (0.01, 0.005, 0.005, 0.975, 0.005),
    (0.20, 0.02, 0.03, 0.03, 0.72),
)
ROOT_PRIOR = (0.96, 0.01, 0.01, 0.01, 0.01)
#: A directory whose name alone gives a label at least this log-odds is mostly a world of its own: messages between it and its parent count for the share LOOSE.
NAMED, LOOSE = 5.0, 0.05
#: Learned words of head comments: files that must have one, log-odds that one gives at most, weight of a file's words, log-odds that they give at most together.
WORD_FILES, WORD_MOST, WORD_WEIGHT, WORDS_MOST = 5, 2.0, 0.4, 5.0

#: Directory names and the log-odds they give to a label (fixed values).
DIR_NAMES = (
    ("vendored", 12.0, r"^(vendor|_vendor|third[_-]?party|3rd[_-]?party|node_modules|bower_components|pods|site-packages|godeps|jspm_packages)$"),
    ("vendored", 8.0, r"^(external|extern|externals|deps|contrib)$"),
    ("vendored", 10.0, r"^[a-z][a-z0-9_]*-v?\d+(\.\d+)+$"),
    ("generated", 9.0, r"^(generated|__generated__|_generated|autogen|auto_generated|gen-src|src-gen|proto-out|generated-sources|generated_src)$"),
    ("generated", 2.0, r"^(gen|stubs)$"),
    ("minified", 1.5, r"^(dist|public|static|min)$"),
    ("blob", 1.0, r"^(data|testdata|fixtures|assets|blobs)$"),
)
#: File names, likewise.
FILE_NAMES = (
    ("generated", 7.0, r"(_pb2(_grpc)?\.pyi?|\.pb\.(go|cc|h|rs)|\.gen\.\w+|\.g\.\w+|\.generated\.\w+|\.designer\.\w+|[_-](auto)?generated\.\w+|\.tab\.[ch]|_wrap\.(c|cc|cpp|cxx))$"),
    ("generated", 7.0, r"^(lex\..+\.c|mock_.+_gen\.\w+|zz_generated.+)$"),
    ("generated", 3.0, r"_gen\.\w+$"),
    ("minified", 6.0, r"([.-]min\.(js|mjs|cjs|css)|\.bundle\.(js|mjs)|\.[0-9a-f]{8,}\.(chunk\.)?(js|mjs|css)|\.chunk\.(js|mjs)|\.prod\.js)$"),
    ("blob", 2.0, r"([_-](lut|font|icon|fixtures?|blob|data|table|weights|sprite)\.\w+|^(seed|fixtures?)[_-].+\.sql)$"),
)
#: The leading comments of a file, with blank lines, block comments and docstrings; at most 60 of them.
_HEAD = (
    r"\A((?:[ \t]*(?:\r\n|\r|\n)|[ \t]*(?://|#|--|;|%)[^\r\n]*+(?:\r\n|\r|\n|\z)|[ \t]*/\*(?:[^*]|\*(?!/)){0,4000}+\*/[ \t]*(?:\r\n|\r|\n|\z)"
    r"|[ \t]*<!--(?:[^-]|-(?!->)){0,4000}+-->[ \t]*(?:\r\n|\r|\n|\z)|[ \t]*\"\"\"(?:[^\"]|\"(?!\"\")){0,4000}+\"\"\"[ \t]*(?:\r\n|\r|\n|\z)){1,60}+)"
)
_ACTS = r"(?i)\b(writes?|skips?|strips?|detects?|removes?|checks?|emits?|adds?|finds?|parses?|ignores?|looks?|handles?|inserts?)\b"
_MADE = (
    r"(?i)(@generated\b|auto-?generated[\s>]|\bgenerated by\b|code generated\b|machine[- ](written|generated|made)\b|produced automatically|automatically (produced|generated|created|written)"
    r"|created by the \S+ (compiler|generator)|(overwritten|lost) on the next build|changes will be lost|(do|must) not (modify|edit|be edited|change)\b.*(by hand)?|regenerate with)"
)
_TAKEN = (
    r"(?i)(\bvendored from\b|copied (verbatim|unchanged|unmodified)|imported (unchanged|verbatim|unmodified)|\bbundled copy\b|\bthird[- ]party copy\b|taken (verbatim|unchanged) from"
    r"|report problems upstream|see their licen[cs]e|\(c\) the \S+ (contributors|authors))"
)
_N = len(LABELS)
_I = {name: i for i, name in enumerate(LABELS)}


def _through(df: DataFrame, source: Column, table: tuple[tuple[float, ...], ...], up: bool, name: str) -> DataFrame:
    """Adds a message over an edge: for each of the receiver's labels the log of the sum over the sender's labels of compatibility times exp(belief).

    Beliefs and messages are arrays; each step is a projection of its own, so generated code stays small.
    """
    df = df.withColumn("_x", source).withColumn("_top", F.array_max("_x")).withColumn("_w", F.transform("_x", lambda v: F.exp(v - F.col("_top"))))
    rows = [[table[i][j] if up else table[j][i] for j in range(_N)] for i in range(_N)]
    tables = F.array(*[F.array(*[F.lit(v) for v in r]) for r in rows])
    weighed = F.transform(tables, lambda r: F.log(F.aggregate(F.zip_with(r, "_w", lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)))
    return df.withColumn(name, F.transform(weighed, lambda v: v + F.col("_top"))).drop("_x", "_top", "_w")


def _plus(a: str | Column, b: str | Column, sign: float = 1.0) -> Column:
    return F.zip_with(a, b, lambda x, y: x + sign * y)


def _summed(name: str) -> Column:
    """Element-wise sum of arrays over a group."""
    return F.array(*[F.sum(F.element_at(name, i + 1)) for i in range(_N)])


def _flat() -> Column:
    return F.array(*[F.lit(0.0)] * _N)


def _scores(pairs: list[tuple[str, Column]]) -> list[Column]:
    """Sums the log-odds given to each label."""
    out = [F.lit(0.0)] * _N
    for label, value in pairs:
        out[_I[label]] = out[_I[label]] + value
    return out


def _when(cond: Column, value: float) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), F.lit(value)).otherwise(F.lit(0.0))


def current_map(code_map: DataFrame) -> DataFrame:
    """One row per file, from the scan made last: ``root, path, lang, size, purpose, engine, n_symbols, last_line``."""
    row = F.struct("scanned_at", "loaded_at", "size", "lang", "purpose", "engine", F.size("symbols").alias("n_symbols"), F.array_max(F.transform("symbols", lambda s: s["line_end"])).alias("last_line"))
    return code_map.filter("root is not null and path is not null").groupBy("root", "path").agg(F.max(row).alias("x")).select("root", "path", "x.lang", "x.size", "x.purpose", "x.engine", "x.n_symbols", "x.last_line")


def text_evidence(chunks: DataFrame) -> DataFrame:
    """Per file, over its whole chunk texts: shares of letters, digits and white space, mean line length, head-comment banners."""
    t = F.col("text")
    bare = F.regexp_replace(t, "[A-Za-z]+", "")
    plain = F.regexp_replace("bare", "[0-9]+", "")
    head = F.when(F.coalesce(F.col("line_start"), F.lit(1)) <= 3, F.regexp_extract(t, _HEAD, 1)).otherwise(F.lit(""))
    per = chunks.filter("root is not null and path is not null and text is not null").select("root", "path", t.alias("text"), "line_start", "line_end", bare.alias("bare"), head.alias("head"))
    # a banner's sentence says what the file is; one with another verb speaks about something else
    says = lambda rule: F.exists(F.split("head", r"[.!?](?=\s)|[\r\n]+"), lambda x: x.rlike(rule) & ~x.rlike(_ACTS))
    per = per.select(
        "root", "path", "line_end", F.length("text").alias("chars"), F.length("bare").alias("n_bare"), F.length(plain).alias("n_plain"), F.length(F.regexp_replace(plain, r"\s+", "")).alias("n_dense"),
        (F.length("bare") - F.length(F.replace(F.replace("bare", F.lit("\n"), F.lit("")), F.lit("\r"), F.lit(""))) + 1).alias("lines"),
        (F.coalesce(F.col("line_start"), F.lit(1)) <= 3).alias("top"), says(_MADE).alias("made"), says(_TAKEN).alias("taken"), F.array_distinct(F.regexp_extract_all(F.lower("head"), F.lit("[a-z]{3,}"), F.lit(0))).alias("words"),
    )
    agg = per.groupBy("root", "path").agg(*[F.sum(c).alias(c) for c in ("chars", "n_bare", "n_plain", "n_dense", "lines")], F.max("line_end").alias("end"), F.max("top").alias("top"), F.max("made").alias("made"), F.max("taken").alias("taken"), F.max_by("words", F.size("words")).alias("words"))
    n = F.greatest(F.col("chars"), F.lit(1))
    return agg.select(
        "root", "path", "chars", "end", "top", "made", "taken", "words", ((F.col("chars") - F.col("n_bare")) / n).alias("letters"), ((F.col("n_bare") - F.col("n_plain")) / n).alias("digits"),
        ((F.col("n_plain") - F.col("n_dense")) / n).alias("blanks"), (F.col("chars") / F.col("lines")).alias("line_length"),
    )


def file_evidence(files: DataFrame, texts: DataFrame) -> DataFrame:
    """``root, path, dir, words, e``: log-likelihoods of the labels from everything but the tree, and the distinct words of the head comment."""
    f = files.join(texts, ["root", "path"], "left")
    name = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    size, ns = F.col("size").cast("double"), F.coalesce(F.col("n_symbols"), F.lit(0))
    prose = F.coalesce(F.col("lang") == "markdown", F.lit(False))
    seen = F.coalesce(F.col("chars") >= 40, F.lit(False))
    #: a hand-written file has some 30 characters on each line up to its last symbol; far more bytes are no such text
    last = F.greatest(F.coalesce("last_line", F.lit(0)), F.coalesce("end", F.lit(0)))
    swollen = (size > 8000) & (size > 3 * (last * 30.0 + 1500.0)) & ~prose & ((last > 0) | (size > 40000))
    dense = seen & (F.col("blanks") < 0.05) & (F.col("digits") < 0.4) & (F.col("letters") > 0.25) & ~prose
    numbers = seen & ((F.col("digits") > 0.3) | ((F.col("digits") > 0.2) & (F.col("letters") < 0.35))) & ~prose
    plain_text = seen & ~dense & ~numbers
    unmarked = ~F.coalesce(F.col("made") | F.col("taken"), F.lit(False)) & ~name.rlike("|".join(rule for _, _, rule in FILE_NAMES))
    start_seen = F.coalesce(F.col("top"), F.lit(False))
    pairs = [(label, _when(name.rlike(rule), value)) for label, value, rule in FILE_NAMES]
    #: what a file of that label shows no mark in name or head comment with, as a log-probability
    pairs += [("generated", F.when(unmarked, F.when(start_seen, -0.9).otherwise(-0.3)).otherwise(0.0)), ("vendored", F.when(unmarked, F.when(start_seen, -0.6).otherwise(-0.05)).otherwise(0.0))]
    pairs += [
        ("generated", _when(F.col("made"), 8.0)), ("vendored", _when(F.col("taken"), 8.0)), ("generated", _when(F.col("purpose").rlike(r"(?i)^(auto-?)?generated\b.*\bcode\b"), 4.0)),
        ("minified", _when(dense & (F.col("line_length") > 120), 7.0)), ("minified", _when(dense & (F.col("line_length") <= 120), 2.0)), ("blob", _when(numbers, 7.0)),
        ("minified", _when(plain_text, -5.0)), ("blob", _when(plain_text, -4.0)),
        ("handwritten", _when(swollen, -2.0)), ("handwritten", _when(swollen & (size > 40000), -3.0)), ("vendored", _when(swollen & (size > 40000), -3.0)),
        ("blob", _when(swollen & ~seen & (ns <= 1) & (size > 100000), 2.0)), ("minified", _when(swollen & ~seen & (ns > 1), -3.0)), ("blob", _when(swollen & ~seen & (ns > 1), -3.0)),
        ("minified", _when(~F.coalesce(F.col("lang").isin("javascript", "typescript"), F.lit(True)), -3.0)),
        ("blob", _when(~swollen & (size < 8000), -3.0)), ("minified", _when(~seen & ~swollen, -1.5)),
    ]
    return f.select("root", "path", F.regexp_extract("path", r"^(.*?)/?[^/]*$", 1).alias("dir"), "words", F.array(*_scores(pairs)).alias("e"))


def _dirs(files: DataFrame) -> DataFrame:
    """Every directory above a file: ``root, dir, up, depth, named, p`` with evidence from its name (``''`` is the top)."""
    parts = F.filter(F.split("dir", "/"), lambda s: s != "")
    above = F.transform(F.sequence(F.lit(0), F.size("parts")), lambda n: F.array_join(F.slice("parts", 1, n), "/"))
    per_dir = files.select("root", "dir").distinct().select("root", parts.alias("parts"))
    d = per_dir.select("root", F.explode(above).alias("dir")).distinct()
    name = F.lower(F.regexp_extract("dir", r"([^/]*)$", 1))
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    up = F.when(F.col("dir") == "", F.lit(None)).otherwise(F.regexp_extract("dir", r"^(.*?)/?[^/]*$", 1))
    own = F.array(*_scores([(label, _when(name.rlike(rule), value)) for label, value, rule in DIR_NAMES]))
    named = name.rlike("|".join(rule for _, value, rule in DIR_NAMES if value >= NAMED))
    return d.select("root", "dir", up.alias("up"), depth.alias("depth"), named.alias("named"), own.alias("p"))


def _loose(name: str) -> Column:
    """The message as it is, or a small share of it over the edge of a directory named for a label."""
    return F.when(F.col("named"), F.transform(name, lambda v: v * LOOSE)).otherwise(F.col(name))


def _marginals(files: DataFrame, dirs: DataFrame, deepest: int) -> DataFrame:
    """``root, path, logs``: log-probabilities of every file's labels. ``files``: root, path, dir, e; ``dirs``: root, dir, up, depth, named, p."""
    files = materialise(_through(files, F.col("e"), FILE_GIVEN_DIR, True, "m"), "files")
    said = materialise(files.groupBy("root", "dir").agg(_summed("m").alias("s")), "said")
    levels: list[DataFrame] = []
    heard = None
    for depth in range(deepest, -1, -1):
        own = dirs.filter(F.col("depth") == depth)
        into = said.join(own.select("root", "dir"), ["root", "dir"], "left_semi")
        into = into if heard is None else into.unionByName(heard)
        into = into.groupBy("root", "dir").agg(_summed("s").alias("s"))
        node = own.join(into, ["root", "dir"], "left").select("root", "dir", "up", "named", _plus("p", F.coalesce("s", _flat())).alias("b"))
        node = _through(node, F.col("b"), DIR_GIVEN_PARENT, True, "u")
        node = materialise(node.withColumn("u", _loose("u")), "up")
        levels.append(node)
        heard = node.select("root", F.col("up").alias("dir"), F.col("u").alias("s"))
    full = levels[-1].select("root", "dir", _plus("b", F.array(*[F.lit(math.log(q)) for q in ROOT_PRIOR])).alias("b"))
    beliefs = full
    for node in reversed(levels[:-1]):
        above = full.select("root", F.col("dir").alias("up"), F.col("b").alias("r"))
        down = _through(node.join(above, ["root", "up"]), _plus("r", "u", -1.0), DIR_GIVEN_PARENT, False, "d")
        full = materialise(down.select("root", "dir", _plus("b", _loose("d")).alias("b")), "down")
        beliefs = beliefs.unionByName(full)
    joined = _through(files.join(beliefs, ["root", "dir"]), _plus("b", "m", -1.0), FILE_GIVEN_DIR, False, "d")
    return joined.select("root", "path", _plus("e", "d").alias("logs"))


def _probabilities(logs: DataFrame) -> DataFrame:
    """``root, path, p`` with the labels' probabilities as an array."""
    top = logs.withColumn("_top", F.array_max("logs")).withColumn("_w", F.transform("logs", lambda v: F.exp(v - F.col("_top"))))
    top = top.withColumn("_z", F.aggregate("_w", F.lit(0.0), lambda acc, v: acc + v))
    return top.select("root", "path", F.transform("_w", lambda v: v / F.col("_z")).alias("p"))


def learned_words(worded: DataFrame) -> DataFrame:
    """``word, odds``: how much likelier a head comment's word is under each label than in a hand-written file, as log-odds, from expected counts.

    ``worded``: root, path, words, p. Counts cover all files; a word needs WORD_FILES files. Each label's counts are smoothed towards the word's
    overall share, so that a label with few files says little.
    """
    per = worded.select(F.explode("words").alias("word"), "p").groupBy("word").agg(F.count(F.lit(1)).alias("n"), _summed("p").alias("c")).filter(F.col("n") >= WORD_FILES)
    total = worded.agg(F.count(F.lit(1)).alias("files"), _summed("p").alias("t"))
    j = per.crossJoin(F.broadcast(total))  # one row
    share = (F.col("n") + 1.0) / (F.col("files") + 2.0)
    rate = F.zip_with("c", "t", lambda c, t: F.log((c + 4.0 * share) / (t + 4.0)))
    j = j.select("word", rate.alias("rate"))
    return j.select("word", F.transform("rate", lambda v: F.greatest(F.lit(-WORD_MOST), F.least(F.lit(WORD_MOST), v - F.element_at("rate", 1)))).alias("odds"))


def label_files(code_map: DataFrame, chunks: DataFrame) -> DataFrame:
    """``root, path, label, p_handwritten, ..., p_blob``: the marginal probabilities and the likeliest label of every file of the map.

    Files without chunks, language, symbols or purpose are judged by what is left, in the end by their directory. Files known only from
    chunks don't come out; a file scanned or delivered several times comes out once; an empty map gives no rows; rows with a null root or path are no files.
    """
    tidy = F.regexp_replace(F.regexp_replace("dir", "/+", "/"), "^/", "")
    files = materialise(file_evidence(current_map(code_map), text_evidence(chunks)).withColumn("dir", tidy), "evidence")
    dirs = materialise(_dirs(files), "dirs")
    deepest = dirs.agg(F.max("depth")).first()[0]
    if deepest is None:
        return files.select("root", "path", F.lit(None).cast("string").alias("label"), *[F.lit(0.0).alias(f"p_{x}") for x in LABELS])
    first = _probabilities(_marginals(files.drop("words"), dirs, deepest))
    worded = materialise(files.filter(F.size("words") > 0).select("root", "path", "words").join(first, ["root", "path"]), "worded")
    odds = worded.select("root", "path", F.explode("words").alias("word")).join(learned_words(worded), "word").groupBy("root", "path").agg(_summed("odds").alias("o"))
    bound = F.transform("o", lambda v: F.greatest(F.lit(-WORDS_MOST), F.least(F.lit(WORDS_MOST), v * WORD_WEIGHT)))
    again = files.drop("words").join(odds, ["root", "path"], "left").select("root", "path", "dir", _plus("e", F.coalesce(bound, _flat())).alias("e"))
    p = _probabilities(_marginals(again, dirs, deepest))
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), F.array_position("p", F.array_max("p")).cast("int"))
    return p.select("root", "path", label.alias("label"), *[F.element_at("p", i + 1).alias(f"p_{x}") for i, x in enumerate(LABELS)])


def not_handwritten(labelled: DataFrame) -> DataFrame:
    """``root, path`` of the files that somebody else or a tool wrote, once each: hand-writing is less likely than all else together."""
    return labelled.filter("p_handwritten < 0.5").select("root", "path")
