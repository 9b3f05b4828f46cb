"""Simulated games: serial inside a game, parallel across games; prompts, history summaries, and the log."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parlance.operators.models import Annotator


@dataclass
class History:
    """Summaries of complete chunks and the turns after them.

    A chunk is summarised once it is complete and at least ``verbatim`` turns remain behind it; no summaries with
    ``verbatim`` None or ``chunk`` 0.
    """

    chunk: int = 50
    verbatim: int | None = 50
    summaries: list[str] = field(default_factory=list)

    def due(self, turn: int) -> bool:
        if self.verbatim is None or not self.chunk:
            return False
        end = (len(self.summaries) + 1) * self.chunk
        return end <= turn and turn - end >= self.verbatim

    def catch_up(self, turn: int, log: list[dict], summarise: Callable[[str], str]) -> None:
        while self.due(turn):
            start = len(self.summaries) * self.chunk
            self.summaries.append(summarise(as_text(log, start, start + self.chunk)))

    def recent(self, turn: int, log: list[dict]) -> str:
        if self.summaries:
            start = len(self.summaries) * self.chunk
        else:
            start = 0 if self.verbatim is None else max(0, turn - self.verbatim)
        return as_text(log, start, turn)


def as_text(log: list[dict], start: int, end: int) -> str:
    """Turns ``start`` to ``end - 1`` with text, one a line."""
    return "\n".join(f"Turn {i} - {e['character']}: {e['text']}" for i, e in enumerate(log[start:end], start) if (e["text"] or "").strip())


def prompt(system: str, sheet: str, history: History, turn: int, log: list[dict], situation: str) -> str:
    """The blocks of a character's prompt in their order; empty ones are left out."""
    past = "\n\n".join(history.summaries)
    return "\n\n".join(b for b in (system, sheet, past, history.recent(turn, log), situation) if b)


def turn_sequence(spark: SparkSession, characters: list[str], turns: int, seed: int = 20) -> DataFrame:
    """The owner of each turn, drawn evenly with replacement: by a checksum of seed and turn, so it does not depend on partitions."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long") % len(characters)
    return spark.range(turns).select(F.col("id").alias("turn_idx"), F.element_at(F.array(*map(F.lit, characters)), (drawn + 1).cast("int")).alias("character"))


LOG = "game_id string, turn_idx long, character string, text string, n_summaries int"


def play(games: DataFrame, make: Callable[[], Annotator], chunk: int = 50, verbatim: int = 50) -> DataFrame:
    """Plays every game of ``(game_id, system, scenario, characters array<string>, turns int)``; one row per turn.

    A game is a chain of calls, each seeing the turns before it; games run next to each other.  Its length is the
    parameter ``turns``, so a task's work is bounded by it.
    """

    def run(batches):
        model = make()
        for pdf in batches:
            rows = []
            for g in pdf.itertuples():
                log, history = [{"character": "Dungeon Master", "text": g.scenario}], History(chunk, verbatim)
                rows.append((g.game_id, 0, "Dungeon Master", g.scenario, 0))
                owners = np.random.default_rng(len(g.game_id)).integers(0, len(g.characters), g.turns)
                for turn in range(1, g.turns):
                    history.catch_up(turn, log, lambda text: model.answer([f"Summarise:\n{text}"])[0])
                    who = g.characters[owners[turn]]
                    said = model.answer([prompt(g.system, f"You are {who}.", history, turn, log, f"It is turn {turn}.")])[0]
                    log.append({"character": who, "text": said})
                    rows.append((g.game_id, turn, who, said, len(history.summaries)))
            yield pd.DataFrame(rows, columns=["game_id", "turn_idx", "character", "text", "n_summaries"])

    return games.mapInPandas(run, LOG)


def as_message(character: Column, text: Column, date: Column) -> Column:
    """A logged event as a message object of the conversation format."""
    part = F.struct(text.alias("text"), F.lit("in-character").alias("label"), F.array().cast("array<string>").alias("actions"))
    return F.to_json(F.struct(date.alias("date"), character.alias("player"), character.alias("character"), F.create_map(F.lit("0"), part).alias("paragraphs")))


def save_log(log: DataFrame, folder: str) -> None:
    """Appends played turns as messages of the conversation format: ``campaign_id, message_key, payload, loaded_at``."""
    rows = log.select(
        F.col("game_id").alias("campaign_id"), F.col("turn_idx").cast("string").alias("message_key"),
        as_message(F.col("character"), F.col("text"), F.lit(None).cast("string")).alias("payload"), F.current_timestamp().alias("loaded_at"),
    )
    rows.write.mode("append").parquet(folder)


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """The logged messages as rows for the flattener; of a turn logged repeatedly the newest load."""
    newest = spark.read.parquet(folder).groupBy("campaign_id", "message_key").agg(F.max_by("payload", F.struct("loaded_at", "payload")).alias("payload"))
    return newest.select("campaign_id", F.col("message_key").try_cast("long").alias("ordinal"), "message_key", "payload")


def system_prompt(name: str, mean: float, median: float, deviation: float) -> str:
    """Instruction with the usual length of a post, rounded to whole words."""
    return f"You take part in the game {name}. Posts have {mean:.0f} words on average (median {median:.0f}, standard deviation {deviation:.0f})."


def system_prompts(turns: DataFrame) -> DataFrame:
    """The system prompt of each campaign from its post lengths, with the population deviation."""
    s = turns.groupBy("campaign_id").agg(F.avg("word_count").alias("m"), F.median("word_count").alias("d"), F.stddev_pop("word_count").alias("p"))
    whole = [F.floor(F.col(c) + 0.5) for c in ("m", "d", "p")]
    text = F.format_string("You take part in the game %s. Posts have %d words on average (median %d, standard deviation %d).", "campaign_id", *whole)
    return s.select("campaign_id", text.alias("prompt"))
