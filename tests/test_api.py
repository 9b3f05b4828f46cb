"""From files to metrics in two calls."""

from __future__ import annotations

import json

import pytest

from parlance import api


def test_load_and_analyze(spark, tmp_path):
    for name, model in (("one", "m"), ("two", None)):
        said = {str(i): {"date": f"2024-01-01T0{i}:00:00", "player": "pq"[i % 2], "character": "XY"[i % 2], "text": f"word{i} roll some more"} for i in range(6)}
        (tmp_path / f"{name}.json").write_text(json.dumps({**said, **({"_metadata": {"model": model}} if model else {})}))
    (tmp_path / "short.json").write_text(json.dumps({"0": {"text": "x"}}))
    turns = api.load_campaigns(spark, str(tmp_path))
    assert {r.campaign_id: r["count"] for r in turns.groupBy("campaign_id").count().collect()} == {"one": 6, "two": 6}
    first = turns.orderBy("campaign_id", "turn_idx").first()
    assert (first.word_count, first.has_dice_roll, first.message_type, first.session_id) == (4, True, "action", "session_1")
    assert [r.campaign_id for r in api.load_campaigns(spark, str(tmp_path), filter_by={"model": ["m"]}).select("campaign_id").distinct().collect()] == ["one"]
    results = api.analyze(turns)
    assert {m: sorted(t) for m, t in results.items()} == {"basic": ["lengths", "report", "summary"], "jaccard": ["self", "series", "vocabulary"], "semantic": ["series", "sessions"], "dsi": ["series"]}
    assert all(df.count() > 0 for tables in results.values() for df in tables.values())
    with pytest.raises(ValueError):
        api.analyze(turns, ["nope"])


def test_named_corpora(spark, tmp_path):
    for kind, names in (("human", ("a", "b")), ("llm", ("b", "c"))):
        (tmp_path / kind).mkdir()
        for n in names:
            (tmp_path / kind / f"{n}.json").write_text(json.dumps({str(i): {"text": f"{kind} {i}"} for i in range(6)}))
    corpora = {k: str(tmp_path / k) for k in ("human", "llm")}

    def got(source):
        return {(r.campaign_id, r.text.split()[0]) for r in api.load_campaigns(spark, source, corpora=corpora).select("campaign_id", "text").collect()}

    assert got("llm") == {("b", "llm"), ("c", "llm")} and got(["human", "llm"]) == {("a", "human"), ("b", "human"), ("c", "llm")}
    assert got("b") == {("b", "human")} and got(["b", "c"]) == {("b", "human"), ("c", "llm")}
    with pytest.raises(ValueError):
        got(["human", "c"])
