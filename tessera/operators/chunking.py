"""From files to symbols and chunks."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import lines, short_sha, strip
from tessera.session import materialise

#: Chunk size, line window and overlap, least gap, most chunks, longest decision body (fixed values).
MAX_CHARS, WINDOW_LINES, OVERLAP_LINES, GAP_LINES, MAX_CHUNKS, DECISION_CHARS = 2048, 60, 10, 5, 50_000, 4096
#: Patterns that find definitions by line, tried in this order (fixed values).
SYMBOL_PATTERNS = (
    (r"^\s*(?:export\s+)?(?:async\s+)?(?:public|private|protected|static|\s)*\bclass\s+([A-Za-z_]\w*)", "class"),
    (r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+([A-Za-z_]\w*)", "function"),
    (r"^\s*(?:export\s+)?(?:pub\s+)?(?:async\s+)?fn\s+([A-Za-z_]\w*)", "function"),
    (r"^\s*func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*\(", "function"),
    (r"^\s*def\s+([A-Za-z_]\w*)", "function"),
    (r"^\s*(?:export\s+)?(?:type|interface|struct|enum)\s+([A-Za-z_]\w*)", "type"),
    (r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_]\w*)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>", "function"),
)
HEADING, FENCE, DECISION = r"^(#{1,6})\s+(.+?)\s*#*\s*$", r"^\s*(```|~~~)", r"^##+\s+(D-\d+)\b"
SYMBOLS = "name string, kind string, line_start int, line_end int"


def numbered_lines(files: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys, line_no, line`` (from 1) of every file; null and empty texts have none."""
    cut = F.posexplode(lines(F.col(text_col))).alias("p", "line")
    return files.select(*keys, cut).select(*keys, (F.col("p") + 1).alias("line_no"), "line")


def outside_fences(numbered: DataFrame, keys: list[str]) -> DataFrame:
    """Lines that are neither a code fence nor inside one: an even number of fences was seen so far."""
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fence = F.col("line").rlike(FENCE)
    return numbered.withColumn("_seen", F.sum(F.when(fence, 1).otherwise(0)).over(w)).filter((F.col("_seen") % 2 == 0) & ~fence).drop("_seen")


def markdown_symbols(files: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Headings outside code fences: ``keys, name, kind (h1-h6), line_start, line_end``."""
    h = outside_fences(numbered_lines(files, keys, text_col), keys).filter(F.col("line").rlike(HEADING))
    return h.select(*keys, F.trim(F.regexp_extract("line", HEADING, 2)).alias("name"), F.concat(F.lit("h"), F.length(F.regexp_extract("line", HEADING, 1))).alias("kind"), F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"))


def markdown_purpose(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """The first h1 of each file, at most 120 characters."""
    return symbols.filter("kind = 'h1'").groupBy(*keys).agg(F.substring(F.min_by("name", "line_start"), 1, 120).alias("purpose"))


def regex_symbols(files: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Definitions found line by line; of several patterns the first that matches counts."""
    found = F.coalesce(*[F.when(F.col("line").rlike(p), F.struct(F.regexp_extract("line", p, 1).alias("name"), F.lit(k).alias("kind"))) for p, k in SYMBOL_PATTERNS])
    s = numbered_lines(files, keys, text_col).withColumn("s", found).filter("s is not null")
    return s.select(*keys, "s.name", "s.kind", F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"))


def parse_python(text: str) -> tuple[list[tuple[str, str, int, int]], str | None]:
    """Functions, classes, methods (``Class.method``) and upper-case constants at module level, and the docstring's first line.

    Only classes are descended into; a nested class's members carry its own name. A text that can't be parsed raises SyntaxError.
    """
    tree = ast.parse(text)
    out: list[tuple[str, str, int, int]] = []

    def visit(body: list, owner: str) -> None:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append((owner + node.name, "method" if owner else "function", node.lineno, node.end_lineno or node.lineno))
            elif isinstance(node, ast.ClassDef):
                out.append((owner + node.name, "class", node.lineno, node.end_lineno or node.lineno))
                visit(node.body, node.name + ".")
            elif isinstance(node, (ast.Assign, ast.AnnAssign)) and not owner:
                for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    if isinstance(t, ast.Name) and t.id.isupper():
                        out.append((t.id, "constant", node.lineno, node.end_lineno or node.lineno))

    visit(tree.body, "")
    doc = ast.get_docstring(tree)
    return out, doc.strip().splitlines()[0][:120] if doc and doc.strip() else None


def python_symbols(files: DataFrame, key: str = "path", text_col: str = "text", purpose: bool = False) -> DataFrame:
    """``key, name, kind, line_start, line_end, engine`` by the Python parser, or by the line patterns where it fails.

    With ``purpose`` a docstring's first line comes out as a row of kind ``purpose`` with line 0.
    """
    import re

    rules = [(re.compile(p), k) for p, k in SYMBOL_PATTERNS]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for k, text in zip(pdf["k"], pdf["text"], strict=True):
                try:
                    found, doc = parse_python(text or "")
                    rows += [(k, *s, "ast") for s in found] + ([(k, doc, "purpose", 0, 0, "ast")] if purpose and doc else [])
                except (SyntaxError, ValueError, RecursionError):
                    for n, line in enumerate((text or "").splitlines(), 1):
                        hit = next(((m.group(1), kind) for rule, kind in rules if (m := rule.match(line))), None)
                        if hit:
                            rows.append((k, *hit, n, n, "regex"))
            yield pd.DataFrame(rows, columns=["k", "name", "kind", "line_start", "line_end", "engine"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(F.col(key).alias("k"), F.col(text_col).alias("text")).mapInPandas(run, f"k {kind}, {SYMBOLS}, engine string").withColumnRenamed("k", key)


def extract_symbols(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(symbols, purposes)`` of files (path, lang, text), each by the engine of its language.

    Markdown gives headings, Python goes through its parser (line patterns where that fails), all else through the line patterns. Symbols: path, name, kind,
    line_start, line_end, engine; purposes: path, purpose (a module docstring's first line or the first h1). A null language counts as other.
    """
    lang = F.coalesce("lang", F.lit(""))
    f = files.select("path", lang.alias("lang"), "text").filter("text is not null")
    md = markdown_symbols(f.filter("lang = 'markdown'"), ["path"]).withColumn("engine", F.lit("markdown"))
    py = materialise(python_symbols(f.filter("lang = 'python'"), purpose=True), "symbols")  # parsed once, read for symbols and purposes
    other = regex_symbols(f.filter("lang not in ('markdown', 'python')"), ["path"]).withColumn("engine", F.lit("regex"))
    purposes = markdown_purpose(md, ["path"]).unionByName(py.filter("kind = 'purpose'").select("path", F.col("name").alias("purpose")))
    return md.unionByName(py.filter("kind <> 'purpose'")).unionByName(other), purposes


def spans(symbols: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Symbols with real ends: ``a, b``. Constants are left out; a point symbol reaches to the line before the next greater start, or the last line
    ``n_lines``; a symbol ends before the first one that starts inside it."""
    s = symbols.filter("kind <> 'constant'").join(files.select(*keys, "n_lines"), keys)
    later = Window.partitionBy(*keys).orderBy("line_start").rangeBetween(1, Window.unboundedFollowing)
    s = s.withColumn("nxt", F.min("line_start").over(later))
    end = F.when(F.col("line_end") <= F.col("line_start"), F.greatest(F.col("line_start"), F.coalesce(F.col("nxt"), F.col("n_lines") + 1) - 1)).otherwise(F.col("line_end"))
    s = s.withColumn("b", F.least(end, F.col("n_lines")))
    return s.withColumn("b", F.when(F.col("nxt") <= F.col("b"), F.col("nxt") - 1).otherwise(F.col("b"))).withColumn("a", F.col("line_start")).drop("nxt")


def gaps(covered: DataFrame, files: DataFrame, keys: list[str], least: int = GAP_LINES) -> DataFrame:
    """``keys, a, b``: runs of at least ``least`` lines that no interval (``a``, ``b``) covers.

    Intervals are merged by a running maximum, so no line is ever exploded.
    """
    ends = files.select(*keys, (F.col("n_lines") + 1).cast("int").alias("a"), (F.col("n_lines") + 1).cast("int").alias("b"))
    iv = covered.select(*keys, F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b")).filter("b >= a").unionByName(ends)
    w = Window.partitionBy(*keys).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    g = iv.withColumn("seen", F.coalesce(F.max("b").over(w), F.lit(0))).filter(F.col("a") - F.col("seen") - 1 >= least)
    return g.select(*keys, (F.col("seen") + 1).alias("a"), (F.col("a") - 1).alias("b")).distinct()


def windows(a: Column, b: Column, size: int = WINDOW_LINES, overlap: int = OVERLAP_LINES) -> Column:
    """Array of (wa, wb): line windows from a to b, each starting ``size - overlap`` lines after the one before, until one reaches b."""
    step = size - overlap
    last = F.greatest(a, a + F.ceil(F.greatest(b - a + 1 - size, F.lit(0)) / step).cast("int") * step)
    return F.transform(F.sequence(a, last, F.lit(step)), lambda x: F.struct(x.alias("wa"), F.least(x + size - 1, b).alias("wb")))


def _body(line_array: Column, a: Column, b: Column) -> Column:
    return F.array_join(F.slice(line_array, a, F.greatest(b - a + 1, F.lit(0))), "\n")


def _doc_line(line_array: Column, a: Column) -> Column:
    """The first docstring line within five lines after a signature, at most 120 characters; null if there is none."""
    near = F.transform(F.slice(line_array, a + 1, F.lit(7)), lambda s: strip(s))
    opens = r"^[rbu]*(\"\"\"|''')(.*)$"
    at = F.nullif(F.array_position(F.transform(F.slice(near, 1, 5), lambda s: s.rlike(opens)), True), F.lit(0).cast("long")).cast("int")
    first = F.try_element_at(near, at)
    rest = strip(F.regexp_replace(F.regexp_extract(first, opens, 2), "\"\"\"|'''", ""))
    after = F.filter(F.slice(near, at + 1, F.lit(2)), lambda s: (s != "") & ~s.startswith('"""') & ~s.startswith("'''"))
    return F.when(at > 0, F.substring(F.when(rest != "", rest).otherwise(F.try_element_at(after, F.lit(1))), 1, 120))


def chunk_files(files: DataFrame, symbols: DataFrame, source: str = "code") -> DataFrame:
    """Chunks of files (``path, text, lang``) at the boundaries of their ``symbols`` (path, name, kind, line_start, line_end).

    One chunk for each symbol's span, module chunks for uncovered runs of lines, line windows where a span exceeds the size limit; blank bodies give none.
    Columns: id, path, symbol, kind, line_start, line_end, header, text, sha, lang, source. Empty files give no chunks.
    """
    f = files.select("path", "text", "lang", short_sha(F.col("text")).alias("sha"), lines(F.col("text")).alias("ls")).withColumn("n_lines", F.size("ls")).filter("n_lines > 0")
    meta = f.select("path", "n_lines")
    s = spans(symbols, meta, ["path"]).select("path", "name", "kind", "a", "b").filter("b >= a")
    bodies = f.select("path", "ls").join(s, "path").select("path", "a", "b", _body(F.col("ls"), F.col("a"), F.col("b")).alias("t")).filter(F.col("t").rlike(r"\S"))
    mod = gaps(bodies, meta, ["path"]).select("path", F.lit("(module)").alias("name"), F.lit("module").alias("kind"), "a", "b")
    x = f.join(s.unionByName(mod), "path").withColumn("t", _body(F.col("ls"), F.col("a"), F.col("b"))).filter(F.col("t").rlike(r"\S"))
    whole = F.array(F.struct(F.col("a").alias("wa"), F.col("b").alias("wb")))
    x = x.withColumn("long", F.length("t") > MAX_CHARS).withColumn("w", F.when(F.col("long"), windows(F.col("a"), F.col("b"))).otherwise(whole))
    cut = F.filter(F.transform("w", lambda w: F.struct(w["wa"].alias("wa"), w["wb"].alias("wb"), _body(F.col("ls"), w["wa"], w["wb"]).alias("t"))), lambda w: w["t"].rlike(r"\S"))
    x = x.select("path", "name", "kind", "a", "sha", "lang", "ls", "long", F.posexplode(cut).alias("part", "w"))
    sign = F.substring(strip(F.element_at("ls", F.col("w.wa"))), 1, 120)
    doc = _doc_line(F.col("ls"), F.col("w.wa"))
    head = F.concat(F.col("path"), F.lit(" :: "), F.col("name"), F.lit(" ("), F.col("kind"), F.lit(") L"), F.col("w.wa"), F.lit("-"), F.col("w.wb"), F.lit(" — "), sign)
    head = F.concat(head, F.when(doc.isNotNull() & (doc != "") & (doc != sign), F.concat(F.lit(" — "), doc)).otherwise(""))
    ident = F.concat_ws("::", "path", "name", F.col("a").cast("string"), F.when(F.col("long"), F.col("part").cast("string")))
    return x.select(ident.alias("id"), "path", F.col("name").alias("symbol"), "kind", F.col("w.wa").alias("line_start"), F.col("w.wb").alias("line_end"), head.alias("header"), F.col("w.t").alias("text"), "sha", "lang", F.lit(source).alias("source"))


def decision_chunks(files: DataFrame) -> DataFrame:
    """Blocks under ``## D-nnnn`` headings of decision logs (``path, text``): each reaches to the line before the next heading."""
    f = files.select("path", short_sha(F.col("text")).alias("sha"), lines(F.col("text")).alias("ls"), "text")
    h = numbered_lines(f, ["path"]).filter(F.col("line").rlike(DECISION))
    nxt = F.lead("line_no").over(Window.partitionBy("path").orderBy("line_no"))
    h = h.withColumn("nxt", nxt).join(f.select("path", "sha", "ls"), "path")
    end = F.coalesce(F.col("nxt") - 1, F.size("ls"))
    did = F.regexp_extract("line", DECISION, 1)
    title = strip(F.regexp_replace("line", "^#+", ""))
    return h.select(
        F.concat_ws("::", "path", did, F.col("line_no").cast("string")).alias("id"), "path", did.alias("symbol"), F.lit("decision").alias("kind"), F.col("line_no").alias("line_start"), end.cast("int").alias("line_end"),
        F.concat(F.col("path"), F.lit(" :: "), title).alias("header"), F.substring(_body(F.col("ls"), F.col("line_no"), end), 1, DECISION_CHARS).alias("text"), "sha", F.lit("markdown").alias("lang"), F.lit("decisions").alias("source"),
    )


def in_order(chunks: DataFrame) -> DataFrame:
    """Chunks with ``position`` (from 1) in the order of path, first line and id, numbered without a single-task window."""
    from tessera.session import positioned

    return positioned(chunks, ["path", "line_start", "id"]).withColumn("position", F.col("g") + 1).drop("g")


def cap_chunks(chunks: DataFrame, most: int = MAX_CHUNKS) -> DataFrame:
    """At most ``most`` chunks, as an option of small interactive indexes: the longest module chunks go first."""
    return chunks.orderBy((F.col("kind") == "module").cast("int"), F.length("text"), "id").limit(most)
