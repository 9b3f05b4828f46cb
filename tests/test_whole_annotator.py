"""The keyword annotator reads whole texts."""

from __future__ import annotations

import datetime

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from parlance.operators import models, parsers
from parlance.plans import tables
from parlance.plans.base import M

#: Over whole texts, unlike the SQL of ``annotated_turns``, which reads the first line of a text only.
WHOLE = f"WITH {M} SELECT campaign_id, turn_idx, 'DRAMATIC' AS type FROM m WHERE contains(lower(text), 'attacks')"


def test_later_lines_and_colons_in_names():
    prompt = "Find.\n\nTurn 0 - A: first\n\nthen it Attacks\nTurn 1 - The: Wolf: attacks\nTurn 2 - attacks: no\nTurn 12 - : x\nit attacks"
    answer = models.KeywordAnnotator(("attacks",), "NONE", "DRAMATIC").answer([prompt, "Turn 1 - A: b"])
    assert [line.split(" [")[0] for line in answer[0].split("\n")] == ["TURN 0", "TURN 1", "TURN 12"] and answer[1] == "NONE"


def test_annotated_turns_equal_sql_over_whole_texts(spark, tmp_path):
    texts = ["he attacks", "a\nb\n\nshe ATTACKS now", None, "none", "\nattacks", "x" * 200 + "\r\nattacks", "a: b\nc: attacks"] * 100
    at = datetime.datetime(2024, 1, 1)
    rows = pd.DataFrame({
        "row_id": range(700), "campaign_id": "c", "message_id": range(700), "date": [at + datetime.timedelta(hours=i) for i in range(700)],
        "player": "p", "character": [("A", "B: C", None)[i % 3] for i in range(700)], "text": texts,
        "word_count": 1, "has_dice_roll": False, "message_type": "x", "gender": "g", "race": "r", "class": "k",
    })
    file = str(tmp_path / "campaign_messages.parquet")
    spark.createDataFrame(rows).withColumn("date", F.col("date").cast("timestamp_ntz")).coalesce(1).write.parquet(file)
    want = duckdb.sql(WHOLE.replace("FROM campaign_messages", f"FROM '{file}/*.parquet'")).fetchall()
    assert sorted(map(tuple, tables.annotated_turns(spark, str(tmp_path)).collect())) == sorted(want) and len(want) == 500
