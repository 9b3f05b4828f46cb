"""Micro-fixtures with results computed by hand, and invariants of the folds."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import text as X
from parlance.operators import automaton, basic, corrections, episodes as E, lexical, models, parsers, results, semantic, simulation
from parlance.operators.order import with_turns

T0 = dt.datetime(2024, 1, 1)


def messages(spark, hours, **extra):
    data = [(i, "c", i, None if h is None else T0 + dt.timedelta(hours=h), *(v[i] for v in extra.values())) for i, h in enumerate(hours)]
    kinds = {str: "string", int: "int", bool: "boolean"}
    cols = "".join(f", {k} {next((kinds[type(x)] for x in v if x is not None), 'string')}" for k, v in extra.items())
    return spark.createDataFrame(data, "row_id long, campaign_id string, message_id long, date timestamp_ntz" + cols)


def test_intervals(spark):
    r = basic.interval_statistics(with_turns(messages(spark, [0, 1, 1, 8, 14, 21])), ["campaign_id"]).first()
    assert (r["mean"], r["median"], r["std"], r["count"]) == (4.2, 6.0, 3.420526, 5)


def test_lengths(spark):
    r = basic.length_statistics(with_turns(messages(spark, [0, 1, 2, 3], word_count=[2, 4, 4, 10])), ["campaign_id"]).first()
    assert (r["mean"], r["median"], r["std"], r["max"]) == (5.0, 4.0, 3.464102, 10)


def test_order_over_chunks_nulls_last_and_copies(spark):
    df = messages(spark, [500, None, 0, 24 * 30, 500])
    turns = with_turns(df.unionByName(df.withColumn("row_id", F.col("row_id") + 100)))
    assert [r.message_id for r in turns.orderBy("turn_idx").collect()] == [2, 0, 4, 3, 1]
    assert [r.turn_idx for r in turns.orderBy("turn_idx").collect()] == [0, 1, 2, 3, 4]


def words_of(spark, rows):
    return spark.createDataFrame(rows, "campaign_id string, turn_idx long, player string, text string")


def test_jaccard(spark):
    two = lexical.player_words(words_of(spark, [("c", 0, "a", "the cat sat"), ("c", 1, "b", "The dog sat")]))
    assert lexical.session_jaccard(two).first().jaccard == 0.5
    three = lexical.player_words(words_of(spark, [("c", 0, "a", "a b"), ("c", 1, "b", "b c"), ("c", 2, "d", "c d")]))
    assert lexical.session_jaccard(three).first().jaccard == pytest.approx(1 / 3, abs=1e-6)
    blank = lexical.player_words(words_of(spark, [("c", 0, "a", "  "), ("c", 1, "b", "b c")]))
    assert lexical.session_jaccard(blank).first().jaccard == 0.0
    assert lexical.player_words(words_of(spark, [("c", 0, "a", "one"), ("c", 1, None, "two")])).count() == 0


def test_self_jaccard_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 2)
    rng = random.Random(1)
    data = [("c", 5 * i, "a", " ".join(rng.sample("abcdefgh", 3))) for i in range(7)] + [("c", 99, "b", "z")]
    got = lexical.self_jaccard(lexical.player_words(words_of(spark, data))).first()
    sets = [set(t.split()) for _, _, p, t in data if p == "a"]
    values = [len(x & y) / len(x | y) for i, x in enumerate(sets) for y in sets[i + 1 :]]
    assert (got.pairs, got.self_jaccard) == (21, round(float(np.mean(values)), 6))


VECTORS = [(1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 2.0)]


def vectors(spark, rows=VECTORS):
    return spark.createDataFrame([("c", i, list(v)) for i, v in enumerate(rows)], "campaign_id string, turn_idx long, vector array<double>")


def test_cosines(spark):
    back = semantic.cosine_back(vectors(spark), ["campaign_id"], "turn_idx").orderBy("turn_idx").collect()
    assert [r.cosine and round(r.cosine, 6) for r in back] == [None, 0.707107, 0.707107, 1.0]
    s = semantic.block_cohesion(vectors(spark), ["campaign_id"], "turn_idx", 10).first()
    assert (s["mean"], s["least"], s["deviation"], s["comparisons"]) == (0.52022, 0.0, 0.382149, 6)
    assert semantic.diversity(vectors(spark), ["campaign_id"], F.col("vector")).first().diversity == 0.47978
    assert semantic.diversity(vectors(spark, [(0.0, 0.0), (1.0, 0.0)]), ["campaign_id"], F.col("vector")).first().diversity == 1.0
    assert semantic.diversity(vectors(spark, [(1.0, 0.0)]), ["campaign_id"], F.col("vector")).first().diversity is None


def symbols(spark, values, conv="c"):
    return spark.createDataFrame([(conv, i, v) for i, v in enumerate(values)], "conv string, idx long, symbol int")


def scene_starts(spark, words, target=175):
    states, step = automaton.packing_step(target)
    return sorted(r.idx for r in automaton.starts(symbols(spark, words), states, step).where("fresh").collect())


def test_scenes(spark):
    assert scene_starts(spark, [100, 50, 30, 200, 10]) == [0, 2, 3, 4]
    assert scene_starts(spark, [0, 200, 5]) == [0, 1, 2]
    assert scene_starts(spark, [175, 1]) == [0, 1]


def test_fold_over_blocks_equals_the_loop(spark):
    rng = random.Random(3)
    words = [rng.choice([0, 3, 20, 90, 300]) for _ in range(3000)]
    at, held, expected = 0, 0, [0]
    for i, w in enumerate(words):
        if i and held + w > 175:
            expected.append(i)
            held = w
        else:
            held += w
    assert scene_starts(spark, words) == expected


def chunk_bounds(spark, n, size, found):
    turns = spark.range(n).select(F.lit("c").alias("campaign_id"), F.col("id").alias("turn_idx"))
    eps = spark.createDataFrame([("c", a, b, b - a + 1, 4.0) for a, b in found], "campaign_id string, start_turn long, end_turn long, turn_count long, rating double")
    parts = E.chunks(turns, eps, size)
    return parts, eps, [(r.start, r.end) for r in parts.orderBy("start").collect()]


def test_chunks(spark):
    parts, eps, bounds = chunk_bounds(spark, 120, 50, [(48, 52), (99, 99)])
    assert bounds == [(0, 53), (53, 103), (103, 120)]
    figures = [(r.episodes, r.turns, r.proportion, r.mean_rating) for r in E.chunk_figures(parts, eps).orderBy("start").collect()]
    assert figures == [(1, 5, 0.09434, 4.0), (1, 1, 0.02, 4.0), (0, 0, 0.0, 0.0)]
    assert chunk_bounds(spark, 100, 50, [(50, 55)])[2] == [(0, 50), (50, 100)]
    assert chunk_bounds(spark, 60, 50, [(45, 59)])[2] == [(0, 60)]


def test_windows_and_islands(spark):
    n = spark.createDataFrame([("a", 1), ("b", 500), ("c", 501), ("d", 900), ("e", 1201), ("f", 0)], "campaign_id string, n long")
    got: dict = {}
    for r in E.windows(n).orderBy("campaign_id", "window_start").collect():
        got.setdefault(r.campaign_id, []).append((r.window_start, r.window_end))
    assert got == {"a": [(0, 0)], "b": [(0, 499)], "c": [(0, 499), (400, 500)], "d": [(0, 499), (400, 899), (800, 899)], "e": [(0, 499), (400, 899), (800, 1200), (1200, 1200)]}
    marked = spark.createDataFrame([("c", t) for t in (5, 6, 7, 9, 10)], "campaign_id string, turn_idx long")
    eps = E.episodes(marked, F.lit("B"), F.lit(1), "A", "B").orderBy("start_turn").collect()
    assert [(r.start_turn, r.end_turn, r.kind) for r in eps] == [(5, 7, "B"), (9, 10, "B")]


def test_histograms(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (4.0,), (10.0,), (None,), (float("nan"),)], "x double")
    assert {r.bin: r.n for r in results.histogram(df, F.col("x"), 6).collect()} == {0: 2, 1: 1, 2: 1, 4: 1}
    assert results.histogram(df.limit(0), F.col("x")).count() == 0
    assert sum(r.n for r in results.histogram(df, F.col("x"), 6, log=True).collect()) == 4


def test_labels_and_types(spark):
    df = spark.createDataFrame([((2, 2, 0, 0),), ((0, 0, 0, 0),), ((0, 1, 3, 3),), (None,)], "c struct<in_character: int, out_of_character: int, mixed: int, unlabeled: int>")
    assert [r[0] for r in df.select(X.primary_label(F.col("c"))).collect()] == ["in-character", "unlabeled", "mixed", "unlabeled"]
    df = spark.createDataFrame([("I look around",), ("it's late",), ("Dawn.",), (None,)], "t string")
    assert [r[0] for r in df.select(X.message_type(F.col("t"), F.lit(False))).collect()] == ["action", "dialogue", "narrative", "narrative"]


def test_corrections(spark):
    df = spark.createDataFrame([("c", 0, "X"), ("c", 1, "Y"), ("c", 2, "Y"), ("c", 3, "Dungeon Master"), ("c", 4, None), ("c", 5, "Z")], "campaign_id string, turn_idx long, character string")
    assert sorted(str(r.character) for r in corrections.without_single_posts(df).collect()) == ["Dungeon Master", "None", "Y", "Y"]
    fix = spark.createDataFrame([("c", "Z", "X"), ("d", "Y", "Q")], "campaign_id string, old_name string, new_name string")
    assert sorted(str(r.character) for r in corrections.corrected(df, fix).collect()) == ["Dungeon Master", "None", "X", "X", "Y", "Y"]


def test_categories(spark):
    meta = spark.createDataFrame([("a", "m", True), ("b", "m", None), ("c", None, None)], "campaign_id string, model string, include_player_personalities boolean")
    got = {r.campaign_id: r.category for r in results.categories(meta.select("campaign_id").union(spark.createDataFrame([("z",)], "campaign_id string")), meta).collect()}
    assert got == {"a": "model:m, include_player_personalities:True", "b": "model:m", "c": "human", "z": "human"}


ANSWER = "TURN 3: one\nmore\nTURN 4: two\nTURN 99: out"


def test_turn_parsers(spark):
    df = spark.createDataFrame([("c", 0, 10, ANSWER), ("d", 0, 10, "no_humor_found " + ANSWER), ("e", 0, 10, None), ("f", 0, 10, "")], "campaign_id string, window_start long, window_end long, response string")
    got = [(r.campaign_id, r.turn_idx, r.explanation) for r in parsers.turn_list(df, F.col("response"), "NO_HUMOR_FOUND").orderBy("turn_idx").collect()]
    assert got == [("c", 3, "one\nmore"), ("c", 4, "two")]
    typed = spark.createDataFrame([("c", 0, 10, "TURN 1 [dramatic]: x\nTURN 2 [odd]: y\nTURN 3: z\nno_conflicts_found")], df.schema)
    got = [(r.turn_idx, r.type) for r in parsers.typed_turns(typed, F.col("response"), "NO_CONFLICTS_FOUND", ("PLAYER", "DRAMATIC")).orderBy("turn_idx").collect()]
    assert got == [(1, "DRAMATIC"), (2, "PLAYER")]
    norms = spark.createDataFrame([("c", 0, 10, "TURN 1 [Following]: x\ny TURN 2 [violating]: z TURN 3 [other]: w")], df.schema)
    got = [(r.turn_idx, r.type) for r in parsers.norm_turns(norms, F.col("response")).orderBy("turn_idx").collect()]
    assert got[0] == (1, "following") and got[1][0] == 2


def test_value_parsers(spark):
    df = spark.createDataFrame([("Originality: 7",), ("no score",), ("Novelty: 4\nKim:\n- Novelty: 2\n- Value: N/A\n",)], "r string")
    assert [r[0] for r in df.select(parsers.rating(F.col("r"), "Originality")).collect()] == [7, 3, 3]
    last = df.select(parsers.judge_overall(F.col("r")).alias("o"), parsers.judge_character(F.col("r"), F.lit("Kim")).alias("k")).collect()[2]
    assert last.o == {"novelty": 4} and last.k == {"novelty": 2, "value": None}
    humor = spark.createDataFrame([("TURN 1: origin\nTURN 1: CALLBACK\nTURN 2: ORIGIN",)], "r string")
    assert humor.select(parsers.humor_types(F.col("r"))).first()[0] == {1: "CALLBACK", 2: "ORIGIN"}
    norm = spark.createDataFrame([("Type: Violating\nExplicit: yes\nNorm: be kind\nDescription: he was not",), ("nothing",)], "r string")
    a, b = (r[0] for r in norm.select(parsers.norm_category(F.col("r"), F.lit("following"), F.lit("d"))).collect())
    assert tuple(a) == ("violating", True, "be kind", "he was not") and tuple(b) == ("following", False, "d", "d")


def test_text_parsers():
    assert parsers.described("1. **Ann**: brave, loud\n- bo (Bob): shy", ["Ann", "Bo", "Dungeon Master"]) == {"Ann": "brave, loud", "Bo": "shy"}
    assert parsers.described("Ann: brave, Bo: shy", ["Ann", "Bo"])["Bo"] == "shy"
    sheet = parsers.character_sheets("[Ann] (elf):\nLevel: 3\nLanguages: Elvish, Common\nWisdom: unknown\nBo:\n", ["Ann", "Bo"])
    assert sheet == [{"Name": "Ann", "Level": 3, "Languages": ["Elvish", "Common"], "Wisdom": "unknown"}]
    assert parsers.final_response("thinking\n**Final response**: I go.\nAnd wait.") == "I go.\nAnd wait."
    with pytest.raises(ValueError):
        parsers.final_response("nothing")


def test_retry_and_norms(spark):
    calls, pauses = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("rate limit")
        return ["ok"]

    assert models.with_retry(flaky, sleep=pauses.append) == ["ok"] and pauses == [10.0, 15.0]
    with pytest.raises(KeyError):
        models.with_retry(lambda: {}["x"], sleep=pauses.append)
    eps = spark.createDataFrame([("c", 0, "share the loot", "following", True), ("c", 5, "always share loot fairly", "violating", False), ("c", 7, "no phones", "establishing", False)], "campaign_id string, start_turn long, description string, episode_type string, is_explicit boolean")
    norms = {r.norm_id: (r.episodes, r.is_explicit, r.description) for r in models.norm_summaries(models.link_norms(eps)).collect()}
    assert norms == {"norm_1": (2, True, "always share loot fairly"), "norm_2": (1, False, "no phones")}


def test_history_and_games(spark):
    h = simulation.History(50, 50)
    assert not h.due(99) and h.due(100)
    h.summaries.append("s")
    assert not h.due(149) and h.due(150)
    games = spark.createDataFrame([("g", "sys", "start", ["A", "B"], 9)], "game_id string, system string, scenario string, characters array<string>, turns int")

    log = simulation.play(games, lambda: models.KeywordAnnotator(("x",), "pass"), 2, 2).orderBy("turn_idx").collect()
    assert [r.turn_idx for r in log] == list(range(9)) and log[-1].n_summaries == 3


def test_rolling_and_running(spark):
    df = spark.createDataFrame([("c", i, float(i)) for i in range(12)], "campaign_id string, turn_idx long, x double")
    got = {r.turn_idx: r.rolling for r in basic.rolling_mean(df, ["campaign_id"], "turn_idx", "x").collect()}
    assert got[4] is None and got[5] == 4.5 and got[7] == 6.5 and got[8] is None
