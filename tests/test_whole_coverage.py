"""Operators of the inventory that the coverage table names: M2, M4, A25, A27, A30, K3."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from parlance.operators import corrections, models, parsers, results
from parlance.plans import tables

SMALL = "/root/testdata/sf0.001"


def test_label_embeddings(spark):
    df = spark.createDataFrame([(1, "a b", "", None), (2, None, "c", "d")], "k int, in_character_text string, out_of_character_text string, mixed_text string")
    got = {(r.k, r.label): r.vector for r in models.embed_labels(df, ["k"]).collect()}
    assert sorted(got) == [(1, "in-character"), (2, "mixed"), (2, "out-of-character")]
    assert np.allclose(got[1, "in-character"], models.HashEncoder().encode(["a b"])[0])


def test_player_scenes_equal_a_plain_loop(spark):
    rows = tables.turns(spark, SMALL, "player", "text").where("player IS NOT NULL").orderBy("campaign_id", "turn_idx").collect()
    own: dict = {}
    for r in rows:
        own.setdefault((r.campaign_id, r.player), []).append(r.text)
    want = {}
    for k, texts in own.items():
        scenes, size = [], 0
        for t in texts:
            n = len((t or "").split())
            if not scenes or (size and size + n > 175):
                scenes.append(0)
                size = 0
            scenes[-1] += 1
            size += n
        if len(texts) > 1:
            want[k] = (len(scenes), len(texts))
    got = {(r.campaign_id, r.player): r for r in tables.player_diversity(spark, SMALL).collect()}
    assert {k: (r.scenes, r.messages) for k, r in got.items()} == want


def test_character_pool(spark):
    values = spark.createDataFrame([("c", "m", 1.0), ("c", "m", 3.0), ("d", "m", float("nan")), ("e", "m", 8.0)], "campaign_id string, metric string, value double")
    kinds = spark.createDataFrame([("c", "human"), ("e", "human"), ("d", "x")], "campaign_id string, category string")
    got = {r.category: (r.campaigns, r["values"], r["mean"], r.median) for r in results.pool_characters(values, kinds).collect()}
    assert got == {"human": (2, 3, 4.0, 3.0), "x": (0, 0, None, None)}


def test_episode_rating_correlation(spark):
    row = tables.episode_rating_correlation(spark, SMALL).first()
    assert (row.a, row.b) == ("words", "rating") and -1 <= row.r <= 1


def test_judge_summary_keeps_sessions_apart(spark):
    df = spark.createDataFrame([("c", "novelty: 2\nvalue: 4"), ("c", "novelty: 4"), ("c", "nothing")], "k string, response string")
    r = parsers.judge_summary(df.withColumn("s", parsers.judge_overall(F.col("response"))), "s", ["k"]).first()
    assert (r.judged, r.mean_novelty, r.mean_value, r.mean_adherence, r.mean_creativity) == (3, 3.0, 4.0, None, 3.5)


def test_corrected_campaigns_are_written_once(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame(rows, "campaign_id string, character string")
    corrections.save_corrected(make(("a", "X")), str(tmp_path / "c"))
    held = corrections.save_corrected(make(("a", "changed"), ("b", "Y")), str(tmp_path / "c"))
    assert sorted(map(tuple, held.collect())) == [("a", "X"), ("b", "Y")]
