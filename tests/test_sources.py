"""Conversation files: reading, flattening, metadata, and the stream of sessions."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from parlance.sources import campaigns as S
from parlance.streaming import sessions as Z


def write(folder, name, messages, meta=None):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text(json.dumps({**{str(i): m for i, m in enumerate(messages)}, **({"_metadata": meta} if meta else {})}))


def test_files(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    new = {"date": "2024-01-01T00:00:00", "character": "X", "paragraphs": {"10": {"text": "z", "label": "mixed", "actions": []}, "2": {"text": "I cast it", "label": "in-character"}, "1": {"text": "a", "label": "odd", "actions": ["q"]}}}
    old = {"date": "bad", "text": "old one", "actions": ["check"]}
    write(a, "one", [new] * 3, {"model": "m", "temperature": 0.5})
    write(b, "one", [old] * 8)
    write(b, "two", [new, old])
    rows = S.message_rows(S.read_files(spark, [str(a), str(b)]))
    kept = S.first_with_enough(rows, 5)
    assert {(r.campaign_id, r.prio) for r in kept.collect()} == {("one", 1)}
    flat = S.flatten(rows.where("campaign_id = 'two'")).orderBy("ordinal").collect()
    assert flat[0].text == "a I cast it z" and flat[0].mixed_text == "z" and tuple(flat[0].label_counts) == (1, 0, 1, 1)
    assert flat[0].paragraph_actions == ["q", "spells"] and flat[0].date.year == 2024
    assert flat[1].text == "old one" and tuple(flat[1].label_counts) == (0, 0, 0, 1) and flat[1].date is None
    index = S.metadata_index(rows)
    assert [(r.campaign_id, r.model) for r in index.collect()] == [("one", "m")]
    assert S.matching(rows, index, {"model": ["m", "n"], "temperature": 0.5}).select("campaign_id").distinct().count() == 1
    assert S.matching(rows, index, {"model": "n"}).count() == 0
    assert S.read_files(spark, [str(a), str(b)], max_campaigns=1).count() == 1


def test_corrections_file(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"camp": {"character_name_corrections": {"X": "Y"}}, "none": {}}))
    assert [tuple(r) for r in S.read_corrections(spark, str(tmp_path / "c.json")).collect()] == [("camp", "X", "Y")]


def test_streams(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", Z.STATE_STORE)
    data = [(i, f"2024-01-0{1 + i // 60} {i % 24:02d}:00:00", i % 3, "post", 1.0, "{}") for i in range(120)] + [(0, "2024-01-01 00:00:00", 0, "post", 1.0, "{}"), (999, "2024-01-20 00:00:00", 0, "post", 1.0, "{}")]
    spark.createDataFrame(data, "event_id long, t string, user_id long, event_type string, value double, props string").select(
        "event_id", F.col("t").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props"
    ).coalesce(1).write.parquet(str(tmp_path / "in"))
    for name, made, mode in (("daily", Z.daily, "complete"), ("sessions", Z.sessions, "append"), ("once", Z.deduplicated, "append"), ("due", lambda e: Z.summaries_due(e, 5, 5), "append")):
        q = made(Z.read_events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName(f"s_{name}").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("s_once").count() == 121
    assert spark.table("s_daily").agg(F.sum("n")).first()[0] == 122
    assert spark.table("s_due").where("user_id = 1").count() == 7
    assert spark.table("s_sessions").count() > 0
