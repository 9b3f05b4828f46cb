"""Profiles from answers, logged games, owners of turns, automata side by side, rolling means over borders, parsers line by line."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import automaton, basic, parsers as P, profiles as Pr, simulation as G
from parlance.operators.shred import message_object
from parlance.sources import campaigns


class Script:
    def __init__(self, text):
        self.text = text

    def answer(self, prompts):
        return [self.text for _ in prompts]


def turns(spark, n=6):
    rows = [("c", i, " Ann " if i % 2 else "ann", ("Kira", "Bo (bard)")[i % 2] if i else None, f"text {i}") for i in range(n)]
    return spark.createDataFrame(rows, "campaign_id string, turn_idx long, player string, character string, text string")


def test_profiles(spark):
    t = turns(spark)
    text = Pr.excerpts(t, F.col("character")).first()
    assert text.names == ["Bo (bard)", "Kira"] and text.text.startswith("Turn 0 - : text 0\nTurn 1 - Bo (bard): text 1")
    told = {(r.name, r.value) for r in Pr.profiles(t, "description", lambda: Script("1. **Kira**: tall, quick\n- Bo (bard): sings: loudly\nStranger: x")).collect()}
    assert told == {("Kira", "tall, quick"), ("Bo (bard)", "sings: loudly")}
    sheets = {(r.name, r.field, r.value) for r in Pr.profiles(t, "sheet", lambda: Script("Kira:\nLevel: 3\nLanguages: elvish,  common\nBo:\nLevel: 2")).collect()}
    # A heading of nobody known opens no sheet; its lines still belong to the one before.
    assert sheets == {("Kira", "Level", "2"), ("Kira", "Languages", "elvish, common"), ("Kira", "Bo", "")}
    assert [(r.name, r.value) for r in Pr.profiles(t, "personality", lambda: Script("ann: kind")).collect()] == [("ann", "kind")]
    assert Pr.profiles(t.limit(0), "sheet", lambda: Script("")).count() == 0 and Pr.profiles(t, "sheet", lambda: Script("no sheet")).count() == 0


def test_log_keeps_the_newest_load(spark, tmp_path):
    log = lambda text, n: spark.createDataFrame([("g", i, "Bo", f"{text} {i}") for i in range(n)], "game_id string, turn_idx long, character string, text string")
    G.save_log(log("old", 3), str(tmp_path / "log"))
    G.save_log(log("new", 2), str(tmp_path / "log"))
    got = campaigns.flatten(G.read_log(spark, str(tmp_path / "log"))).orderBy("message_id").collect()
    assert [(r.message_id, r.character, r.text, r.label_counts.in_character) for r in got] == [(0, "Bo", "new 0", 1), (1, "Bo", "new 1", 1), (2, "Bo", "old 2", 1)]


def test_owners_do_not_depend_on_partitions(spark):
    a = [r.character for r in G.turn_sequence(spark, ["x", "y"], 300).orderBy("turn_idx").collect()]
    b = [r.character for r in G.turn_sequence(spark, ["x", "y"], 300).repartition(7).orderBy("turn_idx").collect()]
    assert a == b and 100 < a.count("x") < 200


@pytest.mark.parametrize("step", [automaton.packing_step(10), automaton.chunking_step(4)])
def test_blocks_side_by_side(spark, step, monkeypatch):
    monkeypatch.setattr(automaton, "BLOCK", 8)
    states, move = step
    rng = np.random.default_rng(1)
    rows = [(f"c{c}", i, int(rng.integers(0, 2 if states == 5 else 9))) for c, n in enumerate((1, 7, 8, 9, 61)) for i in range(n)]
    want = {}
    for c in {r[0] for r in rows}:
        s = np.array([0])
        for _, i, x in sorted(r for r in rows if r[0] == c):
            s, fresh = move(s, np.array([x]))
            want[(c, i)] = bool(fresh[0])
    got = automaton.starts(spark.createDataFrame(rows, "conv string, idx long, symbol int"), states, move)
    assert {(r.conv, r.idx): r.fresh for r in got.collect()} == want


def test_rolling_means_over_borders(spark, monkeypatch):
    monkeypatch.setattr(basic, "PLACES", 8)
    df = spark.createDataFrame([("k", i, float(i * i % 17)) for i in range(40)], "k string, i long, v double")
    got = {r.i: r.rolling for r in basic.rolling_mean(df, ["k"], "i", "v", 6).collect()}
    x = [i * i % 17 for i in range(40)]
    assert got == {i: round(sum(x[i - 3 : i + 3]) / 6, 6) if 3 <= i <= 37 else None for i in range(40)}


@pytest.mark.parametrize("bins", [1, 3, 64])
def test_medians_by_counting(spark, monkeypatch, bins):
    monkeypatch.setattr(basic, "BINS", bins)
    rng = np.random.default_rng(bins)
    rows = [(f"c{c}", f"p{i % 2}", None if i % 11 == 5 else float(rng.integers(0, 9)) ** 2) for c, n in enumerate((1, 2, 7, 30, 61)) for i in range(n)] + [("same", "p", 2.0)] * 8
    df = spark.createDataFrame(rows, "c string, p string, v double")
    for keys in (["c"], ["c", "p"]):
        want = sorted(map(tuple, df.where("v IS NOT NULL").groupBy(*keys).agg(F.median("v")).collect()))
        assert sorted(map(tuple, basic.medians(df, keys, "v", "m", least=20).collect())) == want
        assert sorted(map(tuple, basic.medians(df, keys, "v", "m", least=0).collect())) == want
    assert basic.medians(df.limit(0), ["c"], "v", "m").count() == 0


def test_payloads_are_unwrapped_to_any_depth():
    import json

    value: object = {"text": "hi"}
    for n in range(30):
        value = json.dumps(value) if n % 3 == 0 else {f"k{n}": value}
    assert message_object(json.dumps(value)) == {"text": "hi"}
    assert message_object('{"paragraphs": {"1": {"text": "x"}}}') == {"paragraphs": {"1": {"text": "x"}}}
    assert message_object('{"count": 3}') == {"count": 3} and message_object("[1]") is None and message_object("{") is None and message_object(None) is None


def test_sections_of_a_judge(spark):
    answer = "Novelty: 2\n\n### Kira:\n- Novelty: 5\n- Value: N/A\n**Bo (bard)**:\n- Novelty: 1\n- Resonance: 4\nOverall:\n- Value: 3"
    df = spark.createDataFrame([(answer, c) for c in ("kira", "Bo (bard)", "Zed")], "r string, c string")
    got = [r.m for r in df.select(P.judge_character(F.col("r"), F.col("c")).alias("m")).collect()]
    assert got == [{"novelty": 5, "value": None}, {"novelty": 1, "resonance": 4}, {}]
