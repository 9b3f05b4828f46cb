"""From annotated turns to episodes, chunks and their figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from parlance.operators import automaton
from parlance.operators.order import previous, running_sum


def windows(lengths: DataFrame, size: int = 500, overlap: int = 100) -> DataFrame:
    """Overlapping extraction windows of ``(campaign_id, n)``: one if n <= size, else one every ``size - overlap`` turns."""
    step = size - overlap
    at = F.when(F.col("n") <= size, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long")))
    rows = lengths.where("n > 0").select("campaign_id", "n", F.explode(at).alias("window_start"))
    return rows.select("campaign_id", "window_start", F.least(F.col("window_start") + size - 1, F.col("n") - 1).alias("window_end"))


def first_found(found: DataFrame) -> DataFrame:
    """The first finding of every turn, in order of window and position."""
    cols = [c for c in found.columns if c not in ("campaign_id", "turn_idx")]
    kept = found.groupBy("campaign_id", "turn_idx").agg(F.min_by(F.struct(*cols), F.struct("window_start", "position")).alias("r"))
    return kept.select("campaign_id", "turn_idx", "r.*")


def islands(annotated: DataFrame, max_gap: int = 1) -> DataFrame:
    """Adds ``episode``: its first turn.  Turns at most ``max_gap`` apart belong together."""
    chunked = annotated.withColumn("chunk", F.floor(F.col("turn_idx") / 4096).cast("int"))
    before = previous(chunked, ["campaign_id"], F.col("turn_idx"), "turn_idx", "_prior")
    marked = before.withColumn("_fresh", F.when(F.col("turn_idx") - F.col("_prior") <= max_gap, 0).otherwise(1))
    return running_sum(marked, ["campaign_id"], [F.col("turn_idx")], "_fresh", "episode_no").drop("_prior", "_fresh", "chunk")


def episodes(annotated: DataFrame, kind: Column, rating: Column, default: str, other: str, max_gap: int = 1) -> DataFrame:
    """One row per episode: first and last turn, length, mean rating and majority kind, the default on a tie."""
    marked = islands(annotated.withColumn("_kind", kind).withColumn("_rating", rating), max_gap)
    votes = F.count_if(F.col("_kind") == other) > F.count_if(F.col("_kind") == default)
    return marked.groupBy("campaign_id", "episode_no").agg(
        F.min("turn_idx").alias("start_turn"), F.max("turn_idx").alias("end_turn"),
        (F.max("turn_idx") - F.min("turn_idx") + 1).alias("turn_count"), F.round(F.avg("_rating"), 6).alias("rating"),
        F.when(votes, other).otherwise(default).alias("kind"),
    )


def first_common(annotated: DataFrame, kind: str) -> DataFrame:
    """Most frequent kind of each episode; among equals the one met first."""
    each = annotated.groupBy("campaign_id", "episode_no", kind).agg(F.count("*").alias("n"), F.min("turn_idx").alias("first"))
    return each.groupBy("campaign_id", "episode_no").agg(F.max_by(kind, F.struct("n", -F.col("first"))).alias(kind))


def chunks(turns: DataFrame, found: DataFrame, size: int = 50) -> DataFrame:
    """Chunks of ``size`` turns that no episode crosses: ``campaign_id, chunk_no, start, end`` (exclusive)."""
    inner = found.where("turn_count > 1").select(F.col("campaign_id").alias("conv"), F.explode(F.sequence(F.col("start_turn") + 1, F.col("end_turn"))).alias("idx"))
    inner = inner.withColumn("symbol", F.lit(1))
    base = turns.select(F.col("campaign_id").alias("conv"), F.col("turn_idx").alias("idx"))
    symbols = base.join(inner, ["conv", "idx"], "left").na.fill(0, ["symbol"])
    states, step = automaton.chunking_step(size)
    flags = automaton.starts(symbols, states, step).where("fresh")
    n = turns.groupBy("campaign_id").agg(F.count("*").alias("n"))
    # One row per chunk: few, even for a long campaign.
    order = W.partitionBy("campaign_id").orderBy("start")
    begun = flags.select(F.col("conv").alias("campaign_id"), F.col("idx").alias("start")).join(n, "campaign_id")
    return begun.select(
        "campaign_id", (F.row_number().over(order) - 1).alias("chunk_no"), "start", F.coalesce(F.lead("start").over(order), F.col("n")).alias("end")
    )


def chunk_figures(parts: DataFrame, found: DataFrame) -> DataFrame:
    """Episodes that overlap each chunk, turns covered, share of the chunk and mean rating (0 without episodes)."""
    # Both sides are unfolded to turns, so that a long campaign's chunks never meet all of its episodes.
    inside = parts.select("campaign_id", "chunk_no", F.explode(F.sequence("start", F.col("end") - 1)).alias("turn_idx"))
    told = found.select("campaign_id", "start_turn", "rating", F.explode(F.sequence("start_turn", "end_turn")).alias("turn_idx"))
    each = inside.join(told, ["campaign_id", "turn_idx"]).groupBy("campaign_id", "chunk_no", "start_turn").agg(
        F.count("*").alias("covered"), F.first("rating").alias("rating")
    )
    hit = each.groupBy("campaign_id", "chunk_no").agg(F.count("*").alias("episodes"), F.sum("covered").alias("turns"), F.avg("rating").alias("rating"))
    joined = parts.join(hit, ["campaign_id", "chunk_no"], "left")
    turns = F.coalesce("turns", F.lit(0))
    return joined.select(
        "campaign_id", "chunk_no", "start", "end", F.coalesce("episodes", F.lit(0)).alias("episodes"), turns.alias("turns"),
        F.round(turns / (F.col("end") - F.col("start")), 6).alias("proportion"), F.round(F.coalesce("rating", F.lit(0.0)), 6).alias("mean_rating"),
    )


def social_summary(found: DataFrame, figures: DataFrame) -> DataFrame:
    """Per campaign: episodes and turns by kind, mean of the chunks' shares and mean of the episodes' ratings."""
    kinds = found.groupBy("campaign_id").agg(
        F.count("*").alias("episodes"), F.sum("turn_count").alias("turns"), F.round(F.avg("rating"), 6).alias("mean_rating")
    )
    share = figures.groupBy("campaign_id").agg(F.count("*").alias("chunks"), F.round(F.avg("proportion"), 4).alias("mean_proportion"))
    return share.join(kinds, "campaign_id", "left").na.fill(0, ["episodes", "turns"]).na.fill(0.0, ["mean_rating"])


def range_text(turns: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """The turns of each range as ``Turn i - character: text`` lines; ``ranges(campaign_id, keys, start_turn, end_turn)``.

    Ranges are unfolded to turns, so the join is on equality and balances like the turns themselves.
    """
    line = F.concat(F.lit("Turn "), F.col("turn_idx").cast("string"), F.lit(" - "), F.coalesce("character", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    wide = ranges.select("campaign_id", *keys, F.explode(F.sequence("start_turn", "end_turn")).alias("turn_idx"))
    lines = wide.join(turns, ["campaign_id", "turn_idx"]).groupBy("campaign_id", *keys).agg(
        F.array_sort(F.collect_list(F.struct("turn_idx", line.alias("line")))).alias("lines")
    )
    return lines.select("campaign_id", *keys, F.array_join(F.transform("lines", lambda s: s.getField("line")), "\n").alias("text"))


def participants(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Sorted distinct characters (else players) of each episode."""
    wide = found.select("campaign_id", "episode_no", F.explode(F.sequence("start_turn", "end_turn")).alias("turn_idx"))
    who = F.coalesce(F.col("character"), F.col("player"))
    joined = wide.join(turns.select("campaign_id", "turn_idx", who.alias("who")), ["campaign_id", "turn_idx"]).where("who IS NOT NULL")
    return joined.groupBy("campaign_id", "episode_no").agg(F.array_join(F.array_sort(F.collect_set("who")), "|").alias("participants"))


def scenes(turns: DataFrame, words: Column, target: int = 175) -> DataFrame:
    """Greedy scenes of whole messages up to about ``target`` words: adds ``scene_no``."""
    states, step = automaton.packing_step(target)
    base = turns.select(F.col("campaign_id").alias("conv"), F.col("turn_idx").alias("idx"), words.cast("int").alias("symbol"))
    flags = automaton.starts(base, states, step)
    numbered = running_sum(
        flags.select(F.col("conv").alias("campaign_id"), F.col("idx").alias("turn_idx"), F.col("fresh").cast("int").alias("_f"), F.floor(F.col("idx") / 4096).cast("int").alias("chunk")),
        ["campaign_id"], [F.col("turn_idx")], "_f", "scene_no",
    )
    return numbered.select("campaign_id", "turn_idx", (F.col("scene_no") - 1).alias("scene_no"))


def judge_sessions(turns: DataFrame, size: int = 20) -> DataFrame:
    """Blocks of ``size`` turns, the last one as it is: text joined by blank lines, sorted characters and players."""
    block = F.floor(F.col("turn_idx") / size)
    rows = turns.withColumn("block", block).groupBy("campaign_id", "block").agg(
        F.count("*").alias("messages"), F.array_sort(F.collect_list(F.struct("turn_idx", F.coalesce("text", F.lit("")).alias("t")))).alias("texts"),
        F.array_join(F.array_sort(F.collect_set("character")), "|").alias("characters"), F.array_join(F.array_sort(F.collect_set("player")), "|").alias("players"),
    )
    return rows.withColumn("text", F.array_join(F.transform("texts", lambda s: s.getField("t")), "\n\n")).drop("texts")


def first_appearances(turns: DataFrame) -> DataFrame:
    return turns.where("character IS NOT NULL").groupBy("campaign_id", "character").agg(F.min("turn_idx").alias("first_turn"))


def excerpt_ranges(turns: DataFrame, master: str = "Dungeon Master", initial: int = 100, intro: int = 50, lead_in: int = 10) -> DataFrame:
    """The campaign's start and the stretch around every later first appearance, overlapping or adjacent ones merged."""
    last = turns.groupBy("campaign_id").agg(F.max("turn_idx").alias("last"))
    start = last.select("campaign_id", F.lit(0).cast("long").alias("s"), F.least(F.lit(initial - 1), F.col("last")).cast("long").alias("e"), F.lit("Campaign Start").alias("label"), F.lit(-1).cast("long").alias("o"))
    late = first_appearances(turns).where((F.col("character") != master) & (F.col("first_turn") >= initial)).join(last, "campaign_id")
    late = late.select(
        "campaign_id", F.greatest(F.lit(0), F.col("first_turn") - lead_in).alias("s"), F.least(F.col("first_turn") + intro, F.col("last")).alias("e"),
        F.concat(F.lit("Introduction of "), F.col("character")).alias("label"), F.col("first_turn").alias("o"),
    )
    # One row per character: windows over these stay small.
    order = W.partitionBy("campaign_id").orderBy("s", "o", "label")
    every = start.unionByName(late).withColumn("reach", F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1)))
    every = every.withColumn("island", F.sum(F.when(F.col("s") <= F.col("reach") + 1, 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    labels = F.transform(F.array_sort(F.collect_list(F.struct("s", "o", "label"))), lambda x: x.getField("label"))
    # A label that is already part of the joined ones is not repeated.
    joined = F.aggregate(labels, F.lit(""), lambda acc, x: F.when(acc == "", x).when(F.contains(acc, x), acc).otherwise(F.concat(acc, F.lit(", "), x)))
    return every.groupBy("campaign_id", "island").agg(F.min("s").alias("start_turn"), F.max("e").alias("end_turn"), joined.alias("label")).drop("island")


def opening_run(turns: DataFrame, master: str = "Dungeon Master") -> DataFrame:
    """The game master's turns before anyone else has posted."""
    other = turns.where(~F.coalesce(F.col("character") == master, F.lit(False))).groupBy("campaign_id").agg(F.min("turn_idx").alias("stop"))
    return turns.join(other, "campaign_id", "left").where("stop IS NULL OR turn_idx < stop").select("campaign_id", "turn_idx")


def summary_schedule(lengths: DataFrame, size: int = 50, verbatim: int = 50) -> DataFrame:
    """When each summary falls due: chunk k ends at turn k*size+size-1 and is summarised ``verbatim`` turns after."""
    k = F.explode(F.when(F.col("n") >= size + verbatim, F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - verbatim) / size) - 1)).otherwise(F.array().cast("array<bigint>")))
    rows = lengths.select("campaign_id", k.alias("k"))
    return rows.select("campaign_id", "k", (F.col("k") * size).alias("chunk_start"), (F.col("k") * size + size - 1).alias("chunk_end"), ((F.col("k") + 1) * size + verbatim).alias("due_turn"))


def recent_context(turns: DataFrame, window: int = 50) -> DataFrame:
    """The last ``window`` turns of each campaign."""
    n = turns.groupBy("campaign_id").agg(F.count("*").alias("n"))
    return turns.join(n, "campaign_id").where(F.col("turn_idx") >= F.greatest(F.lit(0), F.col("n") - window)).select("campaign_id", "turn_idx")
