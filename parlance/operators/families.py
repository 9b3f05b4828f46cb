"""Findings of an annotator in conversations, family by family: windows, requests, answers, turns, episodes, ratings, chunks.

All families share one pipeline and differ in the form of their answers and in what is asked about an episode.  Answers
are stored before they are parsed, as they are dear; stored answers of an earlier run are used again by their key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from parlance.config import DEFAULTS, Settings
from parlance.operators import episodes as E, models as M, parsers as P
from parlance.session import Stage


@dataclass(frozen=True)
class Family:
    """``none`` is the answer without findings, ``form`` how turns are listed (``list``, ``typed`` or ``norms``), ``kinds`` the
    default kind of an episode and the other one, ``rating`` the dimension an episode is rated in."""

    name: str
    none: str
    form: str
    kinds: tuple[str, str] | None = None
    rating: str | None = None

    @property
    def request(self) -> str:
        marks = {"list": "TURN n: why", "typed": f"TURN n [{'|'.join(self.kinds or ())}]: why, one a line", "norms": f"TURN n [{P.NORM_TYPES}]: why"}
        return f"List the turns with {self.name.replace('_', ' ')} as {marks[self.form]}. If there is none, answer {self.none}."


#: The words of each family's protocol.
FAMILIES = {
    f.name: f for f in (
        Family("humor", "NO_HUMOR_FOUND", "list", ("ORIGIN", "CALLBACK"), "Originality"),
        Family("conflict", "NO_CONFLICTS_FOUND", "typed", ("PLAYER", "DRAMATIC"), "Intensity"),
        Family("cooperation", "NO_COOPERATION_FOUND", "typed", ("ACTUAL", "LANGUAGE"), "Depth"),
        Family("norms", "NO_NORMS_FOUND", "norms"),
        Family("collab_creativity", "NO_COLLAB_CREATIVITY_FOUND", "list", None, "Creativity"),
    )
}
NORM_KINDS = tuple(P.NORM_TYPES.split("|"))


@dataclass(frozen=True)
class Findings:
    """``turns``: the annotated turns; ``episodes`` with participants, texts and ratings or norms; ``chunks``: the series;
    ``summary``: one row per campaign; ``norms``: the linked norms, of the family of that name only."""

    turns: DataFrame
    episodes: DataFrame
    chunks: DataFrame
    summary: DataFrame
    norms: DataFrame | None = None


def found_turns(answers: DataFrame, family: Family) -> DataFrame:
    """``campaign_id, turn_idx, explanation, type`` of every turn found, by its first window; no type in families without kinds."""
    response = F.col("response")
    if family.form == "typed":
        found = P.typed_turns(answers, response, family.none, family.kinds)
    elif family.form == "norms":
        found = P.norm_turns(answers, response, family.none)
    else:
        found = P.turn_list(answers, response, family.none).withColumn("type", F.lit(None).cast("string"))
    return E.first_found(found.select("campaign_id", "window_start", "position", "turn_idx", "explanation", "type")).select("campaign_id", "turn_idx", "explanation", "type")


def classified(found: DataFrame, family: Family, ask: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Turns with their kind from one answer per campaign; a turn the answer leaves out has the default kind.

    The request is one text by its contract, so a campaign's findings, not its messages, come together in it.
    """
    line = F.concat(F.lit("TURN "), F.col("turn_idx").cast("string"), F.lit(": "), F.col("explanation"))
    lists = found.groupBy("campaign_id").agg(F.array_sort(F.collect_list(F.struct("turn_idx", line.alias("l")))).alias("ls"))
    prompt = F.concat(F.lit(f"Answer TURN n: {' or '.join(family.kinds)} for each.\n\n"), F.array_join(F.transform("ls", lambda x: x.getField("l")), "\n"))
    answers = ask(lists.select("campaign_id", prompt.alias("prompt")), "kinds")
    told = answers.select("campaign_id", F.explode(P.humor_types(F.col("response"))).alias("turn_idx", "kind"))
    return found.join(told, ["campaign_id", "turn_idx"], "left").withColumn("type", F.coalesce("kind", F.lit(family.kinds[0]))).drop("kind")


def grouped(found: DataFrame, family: Family) -> DataFrame:
    """Episodes of consecutive turns: place, length, kind, the first turn's explanation, and all of them in order.

    The kind is that of the majority and the default in a tie; of norms the most frequent, in a tie the one met first.
    """
    marked = E.islands(found)
    base = marked.groupBy("campaign_id", "episode_no").agg(
        F.min("turn_idx").alias("start_turn"), F.max("turn_idx").alias("end_turn"), (F.max("turn_idx") - F.min("turn_idx") + 1).alias("turn_count"),
        F.min_by("explanation", "turn_idx").alias("description"), F.array_sort(F.collect_list(F.struct("turn_idx", "explanation", "type"))).alias("explanations"),
        *((F.when(F.count_if(F.col("type") == family.kinds[1]) > F.count_if(F.col("type") == family.kinds[0]), family.kinds[1]).otherwise(family.kinds[0]).alias("kind"),) if family.kinds else ()),
    )
    if family.form == "norms":
        base = base.join(E.first_common(marked, "type").withColumnRenamed("type", "kind"), ["campaign_id", "episode_no"])
    return base


def _asked_about(turns: DataFrame, found: DataFrame, instruction: str) -> DataFrame:
    text = E.range_text(turns, found.select("campaign_id", "episode_no", "start_turn", "end_turn"), ["episode_no"])
    return text.select("campaign_id", "episode_no", F.col("text").alias("episode_text"), F.concat(F.lit(instruction + "\n\n"), "text").alias("prompt"))


def analyze(turns: DataFrame, family: Family, make: Callable[[], M.Annotator], settings: Settings = DEFAULTS, stored: DataFrame | None = None) -> Findings:
    """The whole pipeline of a family over ``turns(campaign_id, turn_idx, player, character, text)``.

    ``stored(request_key, response)`` are answers of earlier runs.  Campaigns without findings keep their chunks and a
    summary of zeros; an empty table gives empty results.
    """

    def ask(requests: DataFrame, stage: str) -> DataFrame:
        return Stage(M.annotate(requests, "prompt", make, f"{family.name}-{stage}", stored=stored).drop("prompt", "request_key"), f"{family.name}-{stage}").df

    lengths = turns.groupBy("campaign_id").agg(F.count("*").alias("n"))
    windows = E.windows(lengths, settings.extraction_window, settings.extraction_overlap)
    found = found_turns(ask(M.extraction_requests(turns, windows, family.request), "windows"), family)
    if family.name == "humor":
        found = classified(Stage(found, "humor-turns").df, family, ask)
    found = Stage(found, f"{family.name}-turns").df
    # Numbers of episodes are kept, so that all that is asked about them finds its way back.
    base = Stage(grouped(found, family), f"{family.name}-episodes").df
    base = base.join(E.participants(turns, base), ["campaign_id", "episode_no"], "left")
    norms = None
    if family.form == "norms":
        answers = ask(_asked_about(turns, base, "Type, Explicit, Norm and Description of this episode, a line each:"), "episodes")
        told = base.join(answers, ["campaign_id", "episode_no"]).withColumn("c", P.norm_category(F.col("response"), F.col("kind"), F.col("description")))
        told = told.drop("description", "kind", "response").select("*", "c.*").drop("c")
        every = Stage(M.link_norms(told), "norms-linked").df.withColumn("rating", F.lit(0.0))
        norms = M.norm_summaries(every)
    else:
        answers = ask(_asked_about(turns, base, f"Rate this episode as {family.rating}: 1 to 5."), "episodes")
        rated = answers.select("campaign_id", "episode_no", "episode_text", P.rating(F.col("response"), family.rating).cast("double").alias("rating"))
        every = Stage(base.join(rated, ["campaign_id", "episode_no"]), f"{family.name}-rated").df
    series = Stage(E.chunk_figures(E.chunks(turns, every, settings.chunk_turns), every), f"{family.name}-chunks").df
    return Findings(found, every, series, summary(every, series, family), norms)


def summary(found: DataFrame, series: DataFrame, family: Family) -> DataFrame:
    """One row per campaign: episodes and how many of each kind, mean share of the chunks, mean rating (0 without episodes).

    For norms: how many are different, and episodes of each type.
    """
    kind = F.col("episode_type") if family.form == "norms" else F.col("kind")
    kinds = NORM_KINDS if family.form == "norms" else family.kinds or ()
    counts = [F.count_if(kind == k).alias(f"n_{k.lower()}") for k in kinds]
    extra = [F.count_distinct("norm_id").alias("norms")] if family.form == "norms" else [F.round(F.avg("rating"), 6).alias("mean_rating")]
    each = found.groupBy("campaign_id").agg(F.count("*").alias("episodes"), *counts, *extra)
    share = series.groupBy("campaign_id").agg(F.count("*").alias("chunks"), F.round(F.avg(F.col("turns") / (F.col("end") - F.col("start"))), 6).alias("mean_proportion"))
    zeros = [c for c in each.columns if c not in ("campaign_id", "mean_rating")]
    joined = share.join(each, "campaign_id", "left").na.fill(0, zeros)
    return joined if family.form == "norms" else joined.na.fill(0.0, ["mean_rating"])


def episode_columns(family: Family) -> tuple[Column, ...]:
    """The flat columns of a family's episodes."""
    own = ("episode_type", "is_explicit", "norm_id", "description") if family.form == "norms" else (*(("kind",) if family.kinds else ()), "rating", "description")
    return tuple(F.col(c) for c in ("campaign_id", "start_turn", "end_turn", "turn_count", "participants", *own))
