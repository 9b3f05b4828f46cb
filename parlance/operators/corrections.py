"""Corrections of transcripts: renaming, rare characters, conflicts, and who plays whom."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from parlance.operators.models import Annotator, annotate
from parlance.session import written

MASTER = "Dungeon Master"


def renamed(turns: DataFrame, corrections: DataFrame) -> DataFrame:
    """Characters renamed by hand-made corrections ``(campaign_id, old_name, new_name)``; a repeated old name takes the first new one."""
    one = corrections.groupBy("campaign_id", F.col("old_name").alias("character")).agg(F.min("new_name").alias("_new"))
    return turns.join(one, ["campaign_id", "character"], "left").withColumn("character", F.coalesce("_new", "character")).drop("_new")


def without_single_posts(turns: DataFrame, master: str = MASTER) -> DataFrame:
    """Drops the posts of characters with a single post; the game master, blank and missing characters stay."""
    once = turns.where(F.col("character").isNotNull() & ~F.col("character").isin("", master)).groupBy("campaign_id", "character").agg(F.count("*").alias("n"))
    return turns.join(once.where("n = 1").drop("n"), ["campaign_id", "character"], "left_anti")


def name_conflicts(turns: DataFrame, master: str = MASTER) -> DataFrame:
    """Characters that several players post as."""
    rows = turns.where(F.col("character").isNotNull() & (F.col("character") != master) & F.col("player").isNotNull())
    each = rows.groupBy("campaign_id", "character").agg(F.array_sort(F.collect_set("player")).alias("players"))
    return each.where(F.size("players") > 1).select("campaign_id", "character", F.array_join("players", "|").alias("players"))


def players_of_characters(turns: DataFrame) -> DataFrame:
    """The player who last posted as each character."""
    return turns.where("character IS NOT NULL").groupBy("campaign_id", "character").agg(F.max_by("player", "turn_idx").alias("player"))


def resolved(turns: DataFrame, resolution: DataFrame) -> DataFrame:
    """Characters renamed by ``(campaign_id, character, player, new_name)``, such as a model proposes for conflicts."""
    one = resolution.groupBy("campaign_id", "character", "player").agg(F.min("new_name").alias("_new"))
    return turns.join(one, ["campaign_id", "character", "player"], "left").withColumn("character", F.coalesce("_new", "character")).drop("_new")


def proposed(conflicts: DataFrame, make: Callable[[], Annotator], stored: DataFrame | None = None) -> DataFrame:
    """``campaign_id, character, player, new_name``: what a model answers about ``conflicts`` (see :func:`name_conflicts`).

    A request names the character and its players, a line each; an answer has ``player: name`` lines.  Players the
    answer leaves out, and empty names, keep the character's name: they give no row.
    """
    asked = conflicts.withColumn("prompt", F.concat_ws("\n", "character", F.replace("players", F.lit("|"), F.lit("\n"))))
    answers = annotate(asked, "prompt", make, "name-conflicts", stored=stored)
    each = answers.select("campaign_id", "character", "response", F.explode(F.split("players", "\\|")).alias("player"))
    said = F.filter(F.split("response", "\n"), lambda line: F.startswith(line, F.concat("player", F.lit(":"))))
    name = F.trim(F.substring(F.try_element_at(said, F.lit(1)), F.length("player") + 2, F.lit(2**31 - 1)))
    return each.select("campaign_id", "character", "player", name.alias("new_name")).where("new_name <> ''")


def corrected(turns: DataFrame, corrections: DataFrame, resolution: DataFrame | None = None) -> DataFrame:
    """Renaming, then dropping single posts, then resolving conflicts: a renaming can save a character from being dropped."""
    kept = without_single_posts(renamed(turns, corrections))
    return kept if resolution is None else resolved(kept, resolution)


def save_corrected(messages: DataFrame, folder: str) -> DataFrame:
    """Writes the corrected messages of campaigns that ``folder`` does not hold yet; all that it then holds."""
    spark = messages.sparkSession
    if written(spark, folder):
        messages = messages.join(spark.read.parquet(folder).select("campaign_id").distinct(), "campaign_id", "left_anti")
    messages.write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def turn_distribution(turns: DataFrame) -> DataFrame:
    each = turns.where("character IS NOT NULL").groupBy("campaign_id", "character").agg(F.count("*").alias("turns"))
    total = turns.where("character IS NOT NULL").groupBy("campaign_id").agg(F.count("*").alias("_n"))
    return each.join(total, "campaign_id").select("campaign_id", "character", "turns", F.round(100.0 * F.col("turns") / F.col("_n"), 6).alias("percent"))


def sheets(turns: DataFrame) -> DataFrame:
    """Attributes of each character at its first post."""
    cols = ("player", "gender", "race", "class")
    first = turns.where("character IS NOT NULL").groupBy("campaign_id", "character").agg(F.min_by(F.struct(*cols), "turn_idx").alias("s"))
    return first.select("campaign_id", "character", "s.*")
