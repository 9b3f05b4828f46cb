"""Flattening takes every shape of payload."""

from __future__ import annotations

import hashlib
import json

from parlance.plans import tables


def test_every_shape_is_flattened(spark, tmp_path):
    paragraphs = [{"text": "b", "label": "mixed", "actions": "look"}, "loose", {"text": "c", "actions": ["roll", None]}]
    plain = {"date": "2024-01-01T00:00:00", "player": "p", "character": "X", "paragraphs": {"1": paragraphs[0], "2": "loose", "10": paragraphs[2]}}
    shapes = [plain, {"message": plain}, json.dumps(plain), {"character": "X"} | plain, plain | {"paragraphs": paragraphs}]
    rows = [(i, "c", str(i), json.dumps(s)) for i, s in enumerate(shapes)]
    rows += [(5, "c", "5", "  " + json.dumps(plain)), (6, "c", "6", '{"date": "2024'), (7, "c", "_metadata", "{}")]
    spark.createDataFrame(rows, "raw_id long, campaign_id string, message_key string, payload string").write.parquet(str(tmp_path / "raw_messages.parquet"))
    got = {r.raw_id: r for r in tables.flatten_messages(spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(7))
    text_md5 = hashlib.md5(b"b c").hexdigest()
    assert {tuple(got[i])[1:] for i in range(6)} == {("p", "X", text_md5, 0, 0, 1, 1, 0, "look,roll")}
    assert got[6].player is None and got[6].text_md5 is None
