"""Problem 2: cut oversized texts into pieces at natural boundaries, with overlap.

Balanced targets: the least possible number of pieces gives equal-length targets; each target
is snapped to the strongest boundary nearby; where a piece would pass the limit, the number
of pieces grows by one and the targets are placed anew.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

#: Unicode White_Space, spelled out so that Java, RE2 and Python agree.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WORD = re.compile(f"[^{SPACE}]+")
#: Boundary strengths after a word.
NONE, COMMA, CLAUSE, LINE, SENTENCE, PARAGRAPH = 0.0, 1.0, 2.0, 2.5, 4.0, 6.0
_CLOSERS = "\"'»”’)]}"


def word_count(col: Column) -> Column:
    """Words between Unicode white space, counted in the JVM. Null text has null words."""
    return F.regexp_count(col, F.lit(f"[^{SPACE}]+"))


def has_words(text: str, least: int) -> bool:
    """Has the text so many words? Not all are counted."""
    if len(text) < 2 * least - 1:
        return False
    return len(text.split(None, least)) >= least if text.isascii() or "\x1c" not in text else sum(1 for _ in _WORD.finditer(text)) >= least


def boundary_strengths(text: str, spans: list[tuple[int, int]]) -> list[float]:
    """Strength of the boundary after each word: paragraph, sentence, line, clause, comma, none."""
    out = []
    for i, (b, e) in enumerate(spans):
        gap = text[e : spans[i + 1][0]] if i + 1 < len(spans) else "\n\n"
        core = text[b:e].rstrip(_CLOSERS)
        last = core[-1:] or ""
        if gap.count("\n") >= 2 or "\u2029" in gap:
            s = PARAGRAPH
        elif last in ".!?…" and not (len(core) <= 2 and core[:1].isalpha()):
            nxt = text[spans[i + 1][0]] if i + 1 < len(spans) else ""
            s = SENTENCE if not nxt.islower() else CLAUSE
            s += 0.5 * ("\n" in gap)
        elif "\n" in gap and last not in "-­¬":
            s = LINE
        elif last in ";:":
            s = CLAUSE
        elif last in ",—–":
            s = COMMA
        else:
            s = NONE
        out.append(s)
    return out


def _snap(target: float, lo: int, hi: int, strength: list[float], radius: float) -> int:
    """The cut (number of words before it) in [lo, hi] of most strength less distance; ties: the earlier."""
    best, at = None, None
    for c in range(max(lo, int(target - radius)), min(hi, int(target + radius) + 1) + 1):
        v = strength[c - 1] - 3.0 * abs(c - target) / max(radius, 1.0)
        if best is None or v > best:
            best, at = v, c
    return at if at is not None else min(max(int(round(target)), lo), hi)


def _back_up(cut: int, overlap: int, floor: int, strength: list[float]) -> int:
    """Where the repeated part of the piece before begins: near ``overlap`` words, at a boundary if one is close."""
    best, at = None, cut - overlap
    for s in range(max(floor, cut - overlap - overlap // 5), cut - overlap + overlap // 5 + 1):
        v = (strength[s - 1] if s else PARAGRAPH) - 3.0 * abs(cut - overlap - s) / max(overlap / 5, 1)
        if best is None or v > best:
            best, at = v, s
    return max(floor, at)


def plan_pieces(text: str, limit: int = 400, overlap: int = 50) -> list[tuple[int, int, int, int]]:
    """(first word, end word, first character, end character) of each piece; words end-exclusive.

    No piece has more than ``limit`` words. The first piece starts at the first word and the last
    ends at the last, each later piece starts about ``overlap`` words before its predecessor's end.
    """
    spans = [m.span() for m in _WORD.finditer(text)]
    n = len(spans)
    if n == 0:
        return []
    if n <= limit:
        return [(0, n, spans[0][0], spans[-1][1])]
    strength = boundary_strengths(text, spans)
    overlap = min(overlap, limit // 2)
    slack = overlap // 5
    fresh = limit - overlap - slack  # words that a later piece surely may add
    count = 1 + -(-(n - limit) // (limit - overlap))
    while True:
        # equal lengths: piece k covers n_k new words; the first has no repeated part
        length = (n + (count - 1) * overlap) / count
        cuts, starts, ok = [], [0], True
        for k in range(1, count):
            target = length * k - overlap * (k - 1)
            prev = cuts[-1] if cuts else 0
            lo, hi = prev + max(1, overlap), min(starts[-1] + limit, n - 1)
            if lo > hi:
                ok = False
                break
            cut = _snap(target, lo, hi, strength, max(length / 5, 1))
            cuts.append(cut)
            starts.append(_back_up(cut, overlap, starts[-1] + 1, strength))
        if ok and n - starts[-1] <= limit:
            break
        count += 1
        if count > n // max(1, min(fresh, overlap)) + 2:  # nothing natural fits: plain windows
            step = limit - overlap
            starts = list(range(0, max(1, n - overlap), step))
            cuts = [s + limit for s in starts[:-1]]
            break
    ends = [*cuts, n]
    return [(s, e, spans[s][0], spans[e - 1][1]) for s, e in zip(starts, ends)]


def _pieces(batches: Iterator[pd.DataFrame], limit: int, overlap: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for cid, text in zip(pdf["chunk_id"], pdf["text"]):
            for k, (ws, we, cs, ce) in enumerate(plan_pieces(text, limit, overlap)):
                rows.append((cid, k, text[cs:ce], we - ws, ws, we, cs, ce))
        yield pd.DataFrame(rows, columns=["chunk_id", "piece_no", "piece", "words", "first_word", "end_word", "first_char", "end_char"])


PIECES = "chunk_id string, piece_no int, piece string, words int, first_word int, end_word int, first_char int, end_char int"


def split_oversized(chunks: DataFrame, limit: int = 400, overlap: int = 50) -> DataFrame:
    """Pieces of every text of more than ``limit`` words.

    Words are counted in the JVM, so only oversized texts go to Python, and only they are shuffled
    to drop repeated rows. Rows with a null text or null chunk_id give nothing; a chunk_id with two
    different oversized texts has both cut (the piece numbers then repeat); other columns, whatever
    their names, are ignored.
    """
    ship(chunks.sparkSession)
    big = (
        chunks.select("chunk_id", "text")
        .filter(F.col("chunk_id").isNotNull() & (F.length("text") > 2 * limit) & (word_count(F.col("text")) > limit))
        .dropDuplicates(["chunk_id", "text"])
    )
    return big.mapInPandas(lambda it: _pieces(it, limit, overlap), PIECES)
