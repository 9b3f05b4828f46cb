"""Conversations: pointers against a plain walk, verdicts, and rebuilt rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from parlance.llm import threads


def walk(nodes):
    """Root, depth and state the plain way."""
    parent = {(c, i): p for c, i, p in nodes}
    out = {}
    for c, i in parent:
        at, steps, seen = i, 0, set()
        while True:
            if at in seen:
                out[(c, i)] = (None, None, "cycle")
                break
            seen.add(at)
            p = parent[(c, at)]
            if p is None:
                out[(c, i)] = (at, steps, "ok")
                break
            if (c, p) not in parent:
                out[(c, i)] = (at, steps, "orphan")
                break
            at, steps = p, steps + 1
    return out


def resolved(spark, nodes, block):
    df = spark.createDataFrame(nodes, "conv string, id long, parent long")
    return {(r.conv, r.id): (r.root, r.depth, r.state) for r in threads.resolve(df, block).collect()}


@pytest.mark.parametrize("block", [3, 4096])
def test_pointers(spark, block):
    rng = random.Random(block)
    nodes = [("chain", i, i - 1 if i else None) for i in range(50)]
    nodes += [("tree", i, rng.randrange(i) if i else None) for i in range(60)]
    nodes += [("wild", i, rng.choice([None, 99, *range(40)])) for i in range(40)]
    nodes += [("ring", 0, 5), ("ring", 5, 9), ("ring", 9, 0), ("ring", 20, 9), ("self", 1, 1), ("lost", 4, 3), ("lost", 5, 4), ("lost", 14, 5)]
    assert resolved(spark, nodes, block) == walk(nodes)


def test_no_rows(spark):
    assert resolved(spark, [], 10) == {}


MESSAGES = "row_id long, campaign_id string, message_id long, player string, character string, text string, state string"


def campaign(name, rows, first=0):
    return [(first + i, name, m, p, c, t, "x") for i, (m, p, c, t) in enumerate(rows)]


def test_verdicts(spark):
    gm, pc, dice = ("g", "Dungeon Mster"), ("p", "Ann"), (None, "Dice Roller")
    data = (
        campaign("good", [(1, *pc, "hi"), (0, *gm, "yo"), (1, *pc, "hi")]) + campaign("blank", [(0, *gm, " \xa0"), (1, *pc, "[removed by moderator]"), (2, *pc, None)])
        + campaign("hole", [(0, *gm, "a"), (2, *pc, "b")]) + campaign("late", [(1, *gm, "a"), (2, *pc, "b")]) + campaign("alone", [(0, *gm, "a"), (1, *dice, "Result: 3"), (2, "p", " ", "b")])
        + campaign("mute", [(0, *gm, "a"), (1, *pc, "(post removed)")]) + campaign(None, [(0, *gm, "a")]) + campaign("nullid", [(None, *gm, "a"), (0, *gm, "x"), (1, *pc, "y")])
    )
    df = spark.createDataFrame(data, MESSAGES)
    meta = spark.createDataFrame([(c,) for c in ("good", "blank", "hole", "late", "alone", "mute", "none", "nullid", None, "good")], "campaign_id string")
    got = {r.campaign_id: r.reason for r in threads.verdicts(df, meta).collect()}
    assert got == {"good": None, "blank": "empty", "hole": "broken", "late": "broken", "alone": "no_reply", "mute": "no_reply", "none": "empty", "nullid": None}
    rows = [(r.turn, r.role, r.text) for r in threads.rebuild(df, meta).where("campaign_id = 'good'").orderBy("turn").collect()]
    assert rows == [(0, "gm", "yo"), (1, "player", "hi")]
    again = [(r.turn, r.text) for r in threads.rebuild(df.unionByName(df), meta).where("campaign_id = 'good'").orderBy("turn").collect()]
    assert again == [(0, "yo"), (1, "hi")]
    assert threads.verdicts(df.limit(0), meta).where("reason = 'empty'").count() == 9 - 1
    assert threads.verdicts(df, meta.limit(0)).count() == 0


def test_roles(spark):
    values = {"DM": "gm", "D.M.": "gm", "The DM": "gm", "Game Master": "gm", "dungeon master": "gm", "Dungeonmaster": "gm", "Master Larkwright": "player", "dice roller": "dice", "": None, None: None}
    df = spark.createDataFrame([(k,) for k in values], "c string")
    assert {r.c: r.r for r in df.select("c", threads.speaker_role(F.col("c")).alias("r")).collect()} == values
