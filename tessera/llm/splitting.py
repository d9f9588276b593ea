"""Cutting oversized texts at natural boundaries, by lexical cohesion.

At every line boundary the words of a block of lines before and after are compared (cosine); a low similarity between two
peaks is a valley, where the topic changes. Within each size window the deepest valley is cut, at a block boundary (blank line) if the window has
one, else at a line boundary, else (a line longer than the limit) at a blank or, at last, inside the line.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2048, 10
#: Lines on each side that are compared at a boundary.
BLOCK = 5
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\Z")
_WORD = re.compile(r"[A-Za-z_]\w+")


@dataclass
class Piece:
    part: int
    text: str
    first: int  # line numbers within the text, from 0
    last: int
    new_from: int  # characters of the text that repeat the piece before


def _units(text: str, limit: int) -> list[tuple[str, int]]:
    """Lines with their ends; a line over the limit comes in fragments, cut after a blank where the second half has one."""
    out: list[tuple[str, int]] = []
    for k, m in enumerate(_LINE.finditer(text)):
        line = m.group()
        at = 0
        while len(line) - at > limit:
            blank = max(line.rfind(" ", at + limit // 2, at + limit), line.rfind("\t", at + limit // 2, at + limit))
            end = blank + 1 if blank >= 0 else at + limit
            out.append((line[at:end], k))
            at = end
        out.append((line[at:] if at else line, k))
    return out


def depths(units: list[tuple[str, int]], block: int = BLOCK) -> list[float]:
    """Valley depth at the boundary before each unit: how far the similarity lies below the peaks on both sides."""
    bags = [Counter(w.lower() for w in _WORD.findall(u)) for u, _ in units]
    n = len(units)
    sim = [1.0] * n
    left: Counter = Counter()
    right: Counter = Counter()
    for b in bags[:block]:
        right.update(b)
    for i in range(1, n):
        left.update(bags[i - 1])
        right.subtract(bags[i - 1])
        if i - 1 - block >= 0:
            left.subtract(bags[i - 1 - block])
        if i - 1 + block < n:
            right.update(bags[i - 1 + block])
        left, right = +left, +right
        dot = sum(v * right[w] for w, v in left.items() if w in right)
        norm = math.sqrt(sum(v * v for v in left.values()) * sum(v * v for v in right.values()))
        sim[i] = dot / norm if norm else 0.0
    lp, rp = sim[:], sim[:]
    for i in range(1, n):  # the peak is reached by climbing while the similarity doesn't fall
        lp[i] = lp[i - 1] if i > 1 and sim[i - 1] >= sim[i] else sim[i]
    for i in range(n - 2, 0, -1):
        rp[i] = rp[i + 1] if sim[i + 1] >= sim[i] else sim[i]
    return [lp[i] + rp[i] - 2 * sim[i] for i in range(n)]


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[Piece]:
    """Pieces of at most ``limit`` characters, in order; a text within the limit is one piece, an empty one none.

    Each piece repeats the last ``overlap`` lines of the piece before, or as many whole lines as leave room for at least one
    new unit. Without the repeated parts the pieces concatenate to the text.
    """
    if not text:
        return []
    units = _units(text, limit)
    n, size = len(units), [len(u) for u, _ in units]
    if len(text) <= limit:
        return [Piece(0, text, 0, units[-1][1], 0)]
    deep = depths(units)
    blank = [not u.strip() for u, _ in units]
    whole = [(i == 0 or units[i - 1][1] != units[i][1]) and (i + 1 == n or units[i + 1][1] != units[i][1]) for i in range(n)]
    out: list[Piece] = []
    start, begin = 0, 0  # the first new unit, and the first unit of the piece with its repeated lines
    while start < n:
        used = sum(size[begin:start])
        end, low = start, start
        while end < n and used + size[end] <= limit:
            used += size[end]
            end += 1
            if used <= limit // 2:
                low = end
        cut = end
        if end < n:
            spots = [c for c in range(max(low, start + 1), end + 1) if units[c][1] != units[c - 1][1]]
            blocks = [c for c in spots if blank[c - 1] and not blank[c]]
            if blocks or spots:
                cut = max(blocks or spots, key=lambda c: (round(deep[c], 9), c))
        out.append(Piece(len(out), "".join(u for u, _ in units[begin:cut]), units[begin][1], units[cut - 1][1], sum(size[begin:start])))
        if cut == n:
            break
        room, back = limit - size[cut], cut
        while back > begin + 1 and cut - back < overlap and whole[back - 1] and size[back - 1] <= room:
            back -= 1
            room -= size[back]
        start, begin = cut, back
    return out


def pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``chunk_no, part, text, line_start, line_end, repeated`` for every chunk whose text exceeds ``limit`` characters.

    ``repeated`` counts the leading characters that the piece before also has. Null and short texts give no rows; a chunk
    delivered twice is cut once; a null ``line_start`` counts as 1; a row without ``chunk_no`` is no chunk. Only the oversized texts leave the JVM.
    """
    long = chunks.filter((F.length("text") > limit) & F.col("chunk_no").isNotNull()).select("chunk_no", "line_start", "text")
    once = long.groupBy("chunk_no").agg(F.min(F.struct(F.col("line_start"), F.col("text"))).alias("x")).select("chunk_no", "x.line_start", "x.text")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for no, line, text in zip(pdf["chunk_no"], pdf["line_start"], pdf["text"], strict=True):
                base = 1 if pd.isna(line) else int(line)
                rows += [(no, p.part, p.text, base + p.first, base + p.last, p.new_from) for p in split(text, limit, overlap)]
            yield pd.DataFrame(rows, columns=["chunk_no", "part", "text", "line_start", "line_end", "repeated"])

    return once.mapInPandas(run, "chunk_no long, part int, text string, line_start int, line_end int, repeated int")
