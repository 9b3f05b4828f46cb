"""Splitting oversized texts at natural boundaries with overlap between neighbours.

A text is cut at candidate positions, each with a strength: 3 after a paragraph, 2 after a sentence, 1 after a word.
A sparse table over the strengths answers "strongest candidate in this window" in constant time; among equals the
rightmost wins, so pieces are as long as their best boundary allows.  Each next piece steps back by the overlap, to
the strongest candidate within a tolerance around that place.  The coarsest level at which all units of a text fit
comes from the same table.  Only texts above the limit leave the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
SENTENCE = re.compile(r"""(?<=[.!?…])["'”’»)\]}›“‘]*\s+""")
SPACE = re.compile(r"\s+")
LEVELS = {3: "paragraph", 2: "sentence", 1: "word"}
#: A piece may start this share of the overlap before or after the exact step back, to meet a boundary.
TOLERANCE = 0.25


class RangeMax:
    """Sparse table: ``best(lo, hi)`` is the rightmost index of the largest value in ``lo..hi`` inclusive."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        # The key grows with the value and, among equal values, with the place: ties break to the right.
        self.rows = [values.astype(np.int64) * n + np.arange(n)]
        self.n = n
        width = 1
        while 2 * width <= n:
            last = self.rows[-1]
            self.rows.append(np.maximum(last[:-width], last[width:]))
            width *= 2

    def best(self, lo: int, hi: int) -> int:
        k = (hi - lo + 1).bit_length() - 1
        row = self.rows[k]
        return int(max(row[lo], row[hi - (1 << k) + 1])) % self.n


Cuts = tuple[np.ndarray, np.ndarray, np.ndarray]


def boundaries(text: str) -> Cuts:
    """Candidate cuts: where a unit ends, where the next one starts, and the strength of the cut between them."""
    ends, starts, strength = [], [], []
    hard = [(m.start(), m.end()) for m in PARAGRAPH.finditer(text)]
    for m in SPACE.finditer(text):
        ends.append(m.start())
        starts.append(m.end())
        strength.append(1)
    ends_a, starts_a, strength_a = np.array(ends, int), np.array(starts, int), np.array(strength, int)
    for m in SENTENCE.finditer(text):
        strength_a[np.searchsorted(starts_a, m.end())] = 2
    for _, b in hard:
        strength_a[np.searchsorted(starts_a, b)] = 3
    return ends_a, starts_a, strength_a


def level(text: str, limit: int, cuts: Cuts | None = None, table: RangeMax | None = None) -> str:
    """The first of paragraph, sentence, word at which every unit is within the limit, else ``hard``.

    From the start of a unit the strongest boundary within the limit is asked for; the weakest answer on the way
    through the text is the level.  A unit of some level that is too long leaves a window without a boundary of that
    level, and every window starts at a boundary at least as strong as the level so far.
    """
    ends, starts, strength = cuts or boundaries(text)
    table = table or (RangeMax(strength) if len(strength) else None)
    found, at = max(LEVELS), 0
    while len(text) - at > limit:
        lo, hi = int(np.searchsorted(ends, at, "left")), int(np.searchsorted(ends, at + limit, "right")) - 1
        if table is None or lo > hi:
            return "hard"
        cut = table.best(lo, hi)
        found, at = min(found, int(strength[cut])), int(starts[cut])
    return LEVELS[found]


def pieces(
    text: str, limit: int, overlap: int, cuts: Cuts | None = None, table: RangeMax | None = None, tolerance: float = TOLERANCE
) -> list[tuple[int, int, str]]:
    """``(start, end, boundary)`` of consecutive pieces of at most ``limit`` characters that cover the text.

    ``boundary`` names the cut at a piece's end (``end`` for the last).  A cut lies in the upper half of the limit
    where that holds a candidate, else at the last candidate before, else at the limit.  The next piece starts
    ``overlap`` characters before the cut, give or take ``tolerance`` of the overlap: at the strongest candidate in
    that stretch, the rightmost among equals, and exactly ``overlap`` before the cut where it holds none.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, "end")]
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    ends, starts, strength = cuts or boundaries(text)
    table = table or (RangeMax(strength) if len(strength) else None)
    slack = min(int(overlap * tolerance), limit - 1 - overlap)
    out, at = [], 0
    while n - at > limit:
        # A piece must reach beyond its overlap with the one before, else it would add nothing.
        least = at + overlap + slack + 1
        lo = int(np.searchsorted(ends, max(least, at + limit // 2), "left"))
        hi = int(np.searchsorted(ends, at + limit, "right")) - 1
        if table is not None and lo <= hi:
            cut = table.best(lo, hi)
        else:
            cut = hi if table is not None and hi >= 0 and ends[hi] >= least else -1
        end, name = (int(ends[cut]), LEVELS[int(strength[cut])]) if cut >= 0 else (at + limit, "hard")
        out.append((at, end, name))
        at = end - overlap
        if slack:
            lo = int(np.searchsorted(starts, at - slack, "left"))
            hi = int(np.searchsorted(starts, at + slack, "right")) - 1
            if table is not None and lo <= hi:
                at = int(starts[table.best(lo, hi)])
    out.append((at, n, "end"))
    return out


def split_long(df: DataFrame, key: Column, text: Column, limit: int, overlap: int) -> DataFrame:
    """Pieces of every text above ``limit`` characters: ``key, piece_no, start_pos, end_pos, boundary, cut_at, piece``.

    ``cut_at`` is the coarsest level at which the whole text's units fit the limit; positions count code points.
    Null texts, empty ones and texts within the limit give no row.  Rows stand for themselves, repeated or not, and
    a null key is kept.  A single word above the limit is cut hard.  Extra columns of ``df`` play no role.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch["key"], batch["text"], strict=True):
                cuts = boundaries(t)
                table = RangeMax(cuts[2]) if len(cuts[2]) else None
                at = level(t, limit, cuts, table)
                rows += [(k, i, a, b, name, at, t[a:b]) for i, (a, b, name) in enumerate(pieces(t, limit, overlap, cuts, table))]
            yield pd.DataFrame(rows, columns=["key", "piece_no", "start_pos", "end_pos", "boundary", "cut_at", "piece"])

    long = df.select(key.alias("key"), text.alias("text")).where(F.length("text") > limit)
    kind = long.schema["key"].dataType.simpleString()
    return long.mapInPandas(run, f"key {kind}, piece_no int, start_pos long, end_pos long, boundary string, cut_at string, piece string")
