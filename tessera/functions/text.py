"""Column expressions over text, paths and names. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word and sub-word patterns of the code-aware tokeniser (fixed values).
WORD = r"[A-Za-z_][A-Za-z0-9_]*|\p{Nd}+"
SUBWORD = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\p{Nd}+"
#: Line ends that split a text into lines (fixed values).
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
#: Rank priors (fixed values).
PRIOR_TEST, PRIOR_DOCS, PRIOR_CODE = 0.7, 0.9, 1.0
TEST_PATH = r"(^|/)(tests?|__tests__|spec)(/|$)|(^|/)test_[^/]*$|[._-](test|spec)\.[A-Za-z]+$"
#: What marks a query as naming an identifier (fixed values).
IDENTIFIER_PATTERNS = (
    r"\b[a-z0-9]+_[a-z0-9_]+\b",
    r"\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+\b",
    r"[\"'][^\"']+[\"']",
    r"\b\w+\.\w+\(\)",
)
#: Extensions and their languages (fixed values).
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript",
    "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "java": "java", "kt": "kotlin", "swift": "swift", "scala": "scala", "c": "c", "h": "c", "cc": "cpp",
    "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "cs": "csharp", "m": "objc", "sh": "shell", "bash": "shell", "lua": "lua", "r": "r", "jl": "julia", "ex": "elixir",
    "exs": "elixir", "dart": "dart", "vue": "vue", "svelte": "svelte", "sql": "sql", "md": "markdown", "markdown": "markdown",
}
#: Directories that are never indexed, and the largest file in bytes (fixed values).
IGNORED_DIRS = (
    ".git", ".hg", ".svn", "node_modules", "venv", ".venv", "env", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", "dist", "build", ".next", ".nuxt",
    "target", "out", "coverage", ".idea", ".vscode", "vendor", ".tox", ".gradle", "bin", "obj",
)
MAX_FILE_BYTES = 500_000


def tokens(text: Column) -> Column:
    """Lower-case words of a text; an identifier of several parts is followed by its parts. Null gives null."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def with_parts(w: Column) -> Column:
        parts = F.regexp_extract_all(w, F.lit(SUBWORD), F.lit(0))
        whole = w.rlike("^[a-z]+$")  # most words; they have no parts
        return F.when(whole, F.array(w)).when(F.size(parts) > 1, F.concat(F.array(F.lower(w)), F.transform(parts, F.lower))).otherwise(F.array(F.lower(w)))

    return F.flatten(F.transform(words, with_parts))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def short_sha(data: Column) -> Column:
    return F.substring(F.sha2(data, 256), 1, 12)


def lines(text: Column) -> Column:
    """The lines of a text, without an empty last one; an empty text has none."""
    cut = F.split(text, LINE_END)
    cut = F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.greatest(F.size(cut) - 1, F.lit(0)))).otherwise(cut)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(cut)


def strip(text: Column) -> Column:
    """The text without white space at its ends, whatever kind."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def extension(path: Column) -> Column:
    """The lower-case extension of the last path part without its dot; '' if it has none (``.name`` has none)."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, extension(path))


def ignored(path: Column) -> Column:
    """True if a directory of the path is in the ignore list."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in IGNORED_DIRS]))


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def rank_prior(path: Column, lang: Column) -> Column:
    """Score factor by kind of file; a test file counts as one even if it is Markdown."""
    return F.when(F.coalesce(is_test_path(path), F.lit(False)), PRIOR_TEST).when(F.coalesce(lang == "markdown", F.lit(False)), PRIOR_DOCS).otherwise(PRIOR_CODE)


def is_identifier_query(q: Column) -> Column:
    """True if a query names code: a snake-case or camel-case word, something in quotes, or a dotted call. Null gives null."""
    found = F.lit(False)
    for pattern in IDENTIFIER_PATTERNS:
        found = found | q.rlike(pattern)
    return found


def valid_email(address: Column) -> Column:
    """One ``@`` between parts without blanks, a dot in the second, at most 254 characters; null gives false."""
    a = strip(address)
    return F.coalesce(a.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$") & (F.length(a) <= 254), F.lit(False))


def hmac_sha256(message: Column, key: str) -> Column:
    """HMAC-SHA256 of a text as hex, composed of the built-in hash; keys of up to 64 bytes."""
    raw = key.encode()
    if len(raw) > 64:
        raise ValueError("keys of over 64 bytes are hashed first")
    raw = raw.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def top_dir(path: Column) -> Column:
    """The first directory of a path, '.' for a file at the top."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(F.lit("."))


def project_slug(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\]", "-")
