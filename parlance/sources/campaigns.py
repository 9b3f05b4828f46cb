"""Readers of conversation files: one JSON object per conversation, message ids as keys, keys with ``_`` as metadata."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from parlance.operators.shred import plain_message

PARAGRAPHS = "map<string, struct<text: string, label: string, actions: array<string>>>"
#: A message object; ``actions`` stays raw JSON, as it is an object or a list.
MESSAGE = (
    f"struct<date: string, player: string, character: string, text: string, paragraphs: {PARAGRAPHS}, actions: string, in_combat: boolean, "
    "name_mentions: array<string>, gender: string, race: string, class: string, inventory: array<string>>"
)
METADATA = (
    "struct<model: string, temperature: double, max_tokens: int, campaign_name: string, include_player_personalities: boolean, scratchpad: boolean, "
    "summarization_enabled: boolean, summary_chunk_size: int, extraction_initial_turns: int, extraction_intro_window: int, "
    "extraction_pre_intro_turns: int, timestamp: string, year: int, month: int, day: int>"
)


def read_files(spark: SparkSession, folders: list[str], names: list[str] | None = None, max_campaigns: int | None = None) -> DataFrame:
    """``campaign_id, prio, path, raw``: conversation files of several folders, in order of preference.

    ``max_campaigns`` limits the sorted list of files before anything is read, as a feature of the loader.
    """
    parts = []
    for prio, folder in enumerate(folders):
        rows = spark.read.text(f"{folder}/*.json", wholetext=True).select(
            F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1).alias("campaign_id"), F.lit(prio).alias("prio"),
            F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"),
        )
        parts.append(rows.where(F.col("campaign_id").isin(names)) if names else rows)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    if max_campaigns is not None:
        every = every.join(every.select("path").orderBy("path").limit(max_campaigns), "path", "left_semi")
    return every


def message_rows(files: DataFrame) -> DataFrame:
    """``campaign_id, prio, ordinal, message_key, payload``: one row per key, in the order of the file."""
    entries = F.posexplode(F.from_json("raw", "map<string, string>")).alias("ordinal", "message_key", "payload")
    return files.select("campaign_id", "prio", entries)


def first_with_enough(rows: DataFrame, min_turns: int) -> DataFrame:
    """Of several files of a name the first that holds at least ``min_turns`` messages."""
    size = rows.where(~F.col("message_key").startswith("_")).groupBy("campaign_id", "prio").agg(F.count("*").alias("n"))
    best = size.where(F.col("n") >= min_turns).groupBy("campaign_id").agg(F.min("prio").alias("prio"))
    return rows.join(best, ["campaign_id", "prio"], "left_semi")


def metadata_index(rows: DataFrame) -> DataFrame:
    """One row of metadata per conversation that has any."""
    meta = rows.where(F.col("message_key") == "_metadata").select("campaign_id", F.from_json("payload", METADATA).alias("m"))
    return meta.select("campaign_id", "m.*")


def matching(rows: DataFrame, index: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Rows of conversations whose metadata match all of ``wanted``: a list means any of its values."""
    cond = F.lit(True)
    for k, v in wanted.items():
        cond = cond & (F.col(k).isin(list(v)) if isinstance(v, (list, tuple)) else F.col(k).eqNullSafe(F.lit(v)))
    return rows.join(index.where(cond).select("campaign_id"), "campaign_id", "left_semi")


def _ordered(paragraphs: Column) -> Column:
    """Entries by numeric key, others as 0, ties by key."""
    number = lambda e: F.when(e["key"].rlike("^[0-9]+$"), e["key"].cast("long")).otherwise(0)
    tagged = F.transform(F.map_entries(paragraphs), lambda e: F.struct(number(e).alias("n"), e["key"].alias("k"), e["value"].alias("v")))
    return F.transform(F.array_sort(tagged, lambda a, b: F.when(a["n"] < b["n"], -1).when(a["n"] > b["n"], 1).when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)), lambda e: e["v"])


def flatten(rows: DataFrame) -> DataFrame:
    """Messages with their texts by label, label counts and paragraph actions.

    A message with ``text`` has the old format and wins over paragraphs.  Paragraphs are joined by one space in the
    order of their numeric keys.  Paragraphs without an ``actions`` key get what their text suggests.  Wrapped and
    re-encoded payloads and paragraphs in a list count as plain ones; paragraphs that are not objects are passed over.
    A payload that holds no message keeps its row, without content.
    """
    from parlance.functions.text import action_class

    @F.pandas_udf("string")
    def plain(payloads: pd.Series) -> pd.Series:
        return payloads.map(plain_message)

    m = rows.where(~F.col("message_key").startswith("_")).select("campaign_id", "ordinal", "message_key", F.from_json(plain(F.col("payload")), MESSAGE).alias("m"))
    old = F.col("m.text").isNotNull()
    held = m.select("campaign_id", "ordinal", "message_key", "m", old.alias("old"), F.when(~old, _ordered(F.col("m.paragraphs"))).alias("p"))

    def texts(label: str | None = None) -> Column:
        kept = F.filter("p", lambda e: (e["text"].isNotNull()) & (F.lit(True) if label is None else F.coalesce(e["label"] == label, F.lit(False))))
        return F.array_join(F.transform(kept, lambda e: e["text"]), " ")

    def count(label: str) -> Column:
        return F.coalesce(F.size(F.filter("p", lambda e: F.coalesce(e["label"] == label, F.lit(False)))), F.lit(0))

    known = sum(count(x) for x in ("in-character", "out-of-character", "mixed"))
    rest = F.when(F.col("old"), 1).otherwise(F.coalesce(F.size("p"), F.lit(0)) - known)
    guessed = lambda e: F.coalesce(e["actions"], F.array_compact(F.array(action_class(e["text"]))))
    return held.select(
        "campaign_id", "ordinal", F.col("message_key").try_cast("long").alias("message_id"), F.try_to_timestamp(F.col("m.date")).cast("timestamp_ntz").alias("date"),
        "m.player", "m.character", F.when(F.col("old"), F.col("m.text")).otherwise(texts()).alias("text"),
        texts("in-character").alias("in_character_text"), texts("out-of-character").alias("out_of_character_text"), texts("mixed").alias("mixed_text"),
        F.struct(count("in-character").alias("in_character"), count("out-of-character").alias("out_of_character"), count("mixed").alias("mixed"), rest.alias("unlabeled")).alias("label_counts"),
        F.coalesce("m.in_combat", F.lit(False)).alias("in_combat"), F.coalesce("m.name_mentions", F.array().cast("array<string>")).alias("name_mentions"),
        F.col("m.actions").alias("actions"), F.flatten(F.transform("p", guessed)).alias("paragraph_actions"),
        "m.gender", "m.race", "m.class", F.coalesce("m.inventory", F.array().cast("array<string>")).alias("inventory"),
    )


def write_index(index: DataFrame, path: str) -> None:
    index.coalesce(1).write.mode("overwrite").json(path)


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """Hand-made corrections as ``campaign_id, old_name, new_name`` from ``{campaign: {character_name_corrections: {old: new}}}``."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, struct<character_name_corrections: map<string, string>>>").alias("m"))
    each = raw.select(F.explode("m").alias("campaign_id", "c"))
    return each.select("campaign_id", F.explode("c.character_name_corrections").alias("old_name", "new_name"))
