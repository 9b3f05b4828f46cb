"""The short way: load conversations from files and compute metric families over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from parlance.config import DEFAULTS, Settings
from parlance.functions import text as X
from parlance.operators import basic, corrections, episodes, families, lexical, models, parsers, semantic
from parlance.operators.order import with_turns
from parlance.session import Stage
from parlance.sources import campaigns


def derived(messages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Ordered messages with word counts, dice flag, message type, primary label and block session."""
    counts = {f"{c}word_count": X.word_count(F.col(t), X.UNICODE_SPACE) for c, t in (
        ("", "text"), ("in_character_", "in_character_text"), ("out_of_character_", "out_of_character_text"), ("mixed_", "mixed_text"),
    )}
    dice = X.has_dice(F.col("text"), F.col("actions"))
    turns = with_turns(messages, ("ordinal",))
    return turns.withColumns(counts | {
        "has_dice_roll": dice, "message_type": X.message_type(F.col("text"), dice), "primary_label": X.primary_label(F.col("label_counts")),
        "session_id": F.concat(F.lit("session_"), (F.floor(F.col("turn_idx") / settings.messages_per_session) + 1).cast("string")),
    })


def load_campaigns(
    spark: SparkSession,
    source: str | list[str],
    names: list[str] | None = None,
    max_campaigns: int | None = None,
    filter_by: dict[str, object] | None = None,
    settings: Settings = DEFAULTS,
    corpora: dict[str, str] | None = None,
) -> DataFrame:
    """Messages of the conversation files in one folder, or in several with the first one preferred.

    ``corpora`` names folders, in order of preference.  ``source`` may then be one of these names, or names of
    conversations (without a slash), which are looked for in all of them.
    ``max_campaigns`` limits the sorted files before conversations of fewer than ``settings.min_turns`` messages drop
    out.  ``filter_by`` selects by the metadata in the files; a list means any of its values.  A folder without
    messages gives an empty result.
    """
    folders = [source] if isinstance(source, str) else list(source)
    if corpora and all("/" not in f for f in folders):
        known = [f for f in folders if f in corpora]
        if known and len(known) < len(folders):
            raise ValueError(f"neither names of corpora nor of conversations: {', '.join(folders)}")
        names = names if known else folders
        folders = [corpora[f] for f in known] or list(corpora.values())
    rows = campaigns.message_rows(campaigns.read_files(spark, folders, names, max_campaigns))
    if filter_by:
        rows = campaigns.matching(rows, campaigns.metadata_index(rows), filter_by)
    return derived(campaigns.flatten(campaigns.first_with_enough(rows, settings.min_turns)), settings)


def _jaccard(turns: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    words = lexical.player_words(turns, settings.messages_per_session)
    return {"series": lexical.session_jaccard(words), "vocabulary": lexical.vocabulary_sizes(words), "self": lexical.self_jaccard(words)}


def _semantic(turns: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    # Campaigns with fewer than five texts tell nothing of cohesion.
    told = semantic.enough(turns.where("text IS NOT NULL"), ["campaign_id"], 5).select("campaign_id").distinct()
    held = turns.select("campaign_id", "turn_idx", "player", "text").join(told, "campaign_id", "left_semi")
    vectors = semantic.as_doubles(models.embed(held, "text"))
    return {
        "series": semantic.cosine_back(vectors, ["campaign_id"], "turn_idx").select("campaign_id", "turn_idx", "cosine"),
        "sessions": semantic.block_cohesion(vectors, ["campaign_id"], "turn_idx", settings.messages_per_session),
    }


def _dsi(turns: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    turns = semantic.enough(turns, ["campaign_id"], 2)
    counted = turns.withColumn("_n", X.word_count(F.col("text"), X.UNICODE_SPACE))
    placed = episodes.scenes(counted, F.col("_n"), settings.scene_words).join(turns.select("campaign_id", "turn_idx", "text"), ["campaign_id", "turn_idx"])
    scene = placed.groupBy("campaign_id", "scene_no").agg(F.array_sort(F.collect_list(F.struct("turn_idx", "text"))).alias("s"))
    scene = scene.select("campaign_id", "scene_no", F.array_join(F.transform("s", lambda x: x.getField("text")), " ").alias("text"))
    return {"series": models.token_diversity(scene, ["campaign_id", "scene_no"], "text")}


def _basic(turns: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    return {"summary": basic.campaign_bundle(turns), "report": basic.summary_report(turns), "lengths": basic.length_statistics(turns, ["campaign_id"])}


METRICS: dict[str, Callable[[DataFrame, Settings], dict[str, DataFrame]]] = {"basic": _basic, "jaccard": _jaccard, "semantic": _semantic, "dsi": _dsi}
JUDGE = "judge"
#: Metrics that ask an annotator.
ASKED = (*families.FAMILIES, JUDGE)


def judged(turns: DataFrame, make: Callable[[], models.Annotator], settings: Settings = DEFAULTS, stored: DataFrame | None = None) -> dict[str, DataFrame]:
    """A judge's scores of each session, and their means by campaign and by player: ``series, summary, players``."""
    held = Stage(turns.select("campaign_id", "turn_idx", "player", "character", "text"), "judge-turns").df
    sessions = episodes.judge_sessions(held, settings.judge_session)
    told = f"Rate {', '.join(parsers.DIMENSIONS)} of this session, and of each character under a heading with the name, as name: 1 to 5.\nCharacters: "
    requests = sessions.select("campaign_id", "block", "characters", F.concat(F.lit(told), "characters", F.lit("\n\n"), "text").alias("prompt"))
    answers = Stage(models.annotate(requests, "prompt", make, JUDGE, stored=stored).drop("prompt", "request_key"), "judge-answers").df
    series = answers.withColumn("scores", parsers.judge_overall(F.col("response")))
    each = answers.select("campaign_id", "block", "response", F.explode(F.split("characters", "\\|")).alias("character")).where("character <> ''")
    whose = corrections.players_of_characters(held.where("player IS NOT NULL"))
    scored = each.join(whose, ["campaign_id", "character"]).withColumn("scores", parsers.judge_character(F.col("response"), F.col("character")))
    return {
        "series": series.drop("response"), "summary": parsers.judge_summary(series, "scores", ["campaign_id"]),
        "players": parsers.judge_summary(scored.where("size(scores) > 0"), "scores", ["campaign_id", "player"]),
    }


def analyze(
    turns: DataFrame, metrics: list[str] | None = None, settings: Settings = DEFAULTS,
    annotators: dict[str, Callable[[], models.Annotator]] | None = None, stored: DataFrame | None = None,
) -> dict[str, dict[str, DataFrame]]:
    """Result tables by metric family; an unknown name is an error.

    The families of ``ASKED`` need an annotator of their name in ``annotators``; without ``metrics`` all families run
    for which there is one.  ``stored`` holds answers of earlier runs.
    """
    annotators = annotators or {}
    wanted = metrics if metrics is not None else [*METRICS, *(m for m in ASKED if m in annotators)]
    unknown = sorted(set(wanted) - set(METRICS) - set(ASKED))
    if unknown:
        raise ValueError(f"unknown metrics: {', '.join(unknown)}")
    mute = sorted(m for m in wanted if m in ASKED and m not in annotators)
    if mute:
        raise ValueError(f"no annotator for: {', '.join(mute)}")
    out: dict[str, dict[str, DataFrame]] = {}
    for m in wanted:
        if m in METRICS:
            out[m] = METRICS[m](turns, settings)
        elif m == JUDGE:
            out[m] = judged(turns, annotators[m], settings, stored)
        else:
            found = families.analyze(turns, families.FAMILIES[m], annotators[m], settings, stored)
            out[m] = {"series": found.chunks, "summary": found.summary, "episodes": found.episodes, "turns": found.turns} | ({"norms": found.norms} if found.norms is not None else {})
    return out


def campaign_sample(turns: DataFrame, campaign_id: str) -> DataFrame:
    """One campaign's messages in their order; the selection reaches the scan."""
    return turns.where(F.col("campaign_id") == campaign_id).orderBy("turn_idx")
