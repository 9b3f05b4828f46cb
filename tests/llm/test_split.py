"""Splitting: limits, cover, overlap, strength of the cuts, and the range maximum."""

from __future__ import annotations

import re

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from parlance.llm import queries
from parlance.llm.split import PARAGRAPH, SENTENCE, SPACE, TOLERANCE, RangeMax, boundaries, level, pieces, split_long
from parlance.sources.tables import table

TEXT = st.text(st.sampled_from("ab .!?\"\n…)"), max_size=400)


@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.data())
def test_range_maximum(values, data):
    lo = data.draw(st.integers(0, len(values) - 1))
    hi = data.draw(st.integers(lo, len(values) - 1))
    best = max(values[lo : hi + 1])
    assert RangeMax(np.array(values)).best(lo, hi) == max(i for i in range(lo, hi + 1) if values[i] == best)


@settings(max_examples=300)
@given(TEXT, st.integers(3, 60), st.integers(0, 20))
def test_pieces(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    ps = pieces(text, limit, overlap)
    assert ps[0][0] == 0 and ps[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b, _ in ps) or not text
    for (a, b, name), (c, d, _) in zip(ps, ps[1:]):
        assert a < c <= b and abs(b - c - overlap) <= overlap * TOLERANCE and d > b
        assert name == "hard" or text[b].isspace()


def test_levels():
    assert level("aaa bbb.\n\nccc", 8) == "paragraph"
    assert level('aaa "bbb." ccc', 10) == "sentence"
    assert level("aaa bbb ccc", 4) == "word"
    assert level("aaaaaa", 4) == "hard"
    assert level("a.b c.\n \n d", 6) == "paragraph"
    assert list(boundaries("One. Two\n\nThree")[2]) == [2, 3]


def plain_level(text, limit):
    mark = lambda p: re.sub(SENTENCE.pattern.replace("(?<=[.!?…])", "([.!?…]").replace("*\\s+", "*)\\s+"), "\\1\x01", p)
    sentences = [s for p in PARAGRAPH.split(text) for s in mark(p).split("\x01")]
    for name, units in (("paragraph", PARAGRAPH.split(text)), ("sentence", sentences), ("word", SPACE.split(text))):
        if max(map(len, units)) <= limit:
            return name
    return "hard"


@settings(max_examples=500)
@given(TEXT, st.integers(2, 60))
def test_level_is_that_of_the_longest_unit(text, limit):
    assert level(text, limit) == plain_level(text, limit)


def test_overlaps_of_the_messages(spark):
    d = "/root/testdata/sf0.001"
    overlap = table(spark, d, "split_rules").where("item_kind = 'campaign_message'").first().overlap_chars
    by: dict = {}
    for r in queries.p2_pieces(spark, d).collect():
        by.setdefault(r.row_id, []).append(r)
    sorted_ = [sorted(rows, key=lambda r: r.piece_no) for rows in by.values()]
    gaps = [a.end_pos - b.start_pos for rows in sorted_ for a, b in zip(rows, rows[1:])]
    assert gaps and all(abs(g - overlap) <= overlap * TOLERANCE for g in gaps)


def test_without_a_cut_in_the_upper_half_the_piece_is_as_long_as_it_can_be():
    text = "a. b. c. " + "x" * 40
    assert pieces(text, 30, 0)[0] == (0, 8, "sentence")


def test_strongest_cut_and_overlap():
    text = "one two.\n\nthree four five. six seven eight"
    first, second = pieces(text, 30, 12)[:2]
    assert text[first[0] : first[1]] == "one two." or first[2] in ("sentence", "paragraph")
    assert second[0] >= first[1] - 12


def test_table(spark):
    data = [(1, "a b " * 10, "x"), (2, "short", "x"), (3, None, "x"), (4, "", "x"), (None, "y" * 25, "x"), (1, "a b " * 10, "x"), (6, "word " * 60_000, "x")]
    df = spark.createDataFrame(data, "row_id long, text string, piece string")
    out = split_long(df, F.col("row_id"), F.col("text"), 20, 4)
    by: dict = {}
    for r in out.collect():
        by.setdefault((r.key, r.cut_at), []).append(r)
    assert set(by) == {(1, "word"), (None, "hard"), (6, "word")}
    assert all(len(r.piece) <= 20 for rows in by.values() for r in rows)
    assert split_long(df.limit(0), F.col("row_id"), F.col("text"), 20, 4).count() == 0
