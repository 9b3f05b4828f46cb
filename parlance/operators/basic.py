"""Posting rhythm, message length, mentions, dice and summary statistics of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from parlance.functions.times import hours_between, micros_between
from parlance.operators.order import large, previous, running_sum

DAY_MICROS = 86_400_000_000
#: Places of a conversation that are worked on together.
PLACES = 4_096


def statistics(value: Column, prefix: str = "") -> list[Column]:
    """Mean, exact median, sample deviation, largest and number of the non-null values."""
    return [
        F.round(F.avg(value), 6).alias(f"{prefix}mean"), F.round(F.median(value), 6).alias(f"{prefix}median"),
        F.round(F.stddev_samp(value), 6).alias(f"{prefix}std"), F.max(value).alias(f"{prefix}max"), F.count(value).alias(f"{prefix}count"),
    ]


#: Rows of a campaign whose values one buffer may hold; with more, the middle is found by counting.
BUFFERED = 1_000_000
BINS = 1_024


def medians(rows: DataFrame, keys: list[str], value: str, into: str, least: int | None = None) -> DataFrame:
    """``keys, into``: the exact median of the non-null values, however many a campaign (the first key) has.

    Values of most campaigns are few and are sorted in a buffer.  Those of the others, which are fewer than
    ``order.MOST_LARGE``, are counted in bins; only bins with the middle are looked at value by value.
    """
    there = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    many = [r[0] for r in large(there, keys[0], BUFFERED if least is None else least).collect()]
    plain = lambda df: df.groupBy(*keys).agg(F.median("_v").alias(into))
    if not many:
        return plain(there)
    heavy = F.col(keys[0]).isin(many)
    limits = there.where(heavy).groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    width = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    at = F.coalesce(F.least(F.floor((F.col("_v") - F.col("_lo")) / width * BINS), F.lit(BINS - 1)), F.lit(0))
    placed = there.where(heavy).join(limits, keys).select(*keys, "_v", "_n", at.alias("_bin"))

    def around(counted: DataFrame, within: list[str], order: str, start: Column) -> DataFrame:
        """Rows that hold the middle place or places, by the counts ``_c`` in their order."""
        up_to = start + F.sum("_c").over(W.partitionBy(*within).orderBy(order))
        held = counted.withColumn("_end", up_to).withColumn("_before", F.col("_end") - F.col("_c"))
        first, second = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
        return held.where((F.col("_before") < second) & (F.col("_end") >= first))

    bins = around(placed.groupBy(*keys, "_n", "_bin").agg(F.count("*").alias("_c")), keys, "_bin", F.lit(0))
    close = placed.join(bins.select(*keys, "_bin", F.col("_before").alias("_start")), [*keys, "_bin"])
    counted = close.groupBy(*keys, "_n", "_bin", "_start", "_v").agg(F.count("*").alias("_c"))
    middle = around(counted, [*keys, "_bin"], "_v", F.col("_start"))
    found = middle.groupBy(*keys).agg(((F.min("_v") + F.max("_v")) / 2).alias(into))
    return plain(there.where(~heavy)).unionByName(found)


def intervals(turns: DataFrame, keys: list[str]) -> DataFrame:
    """Hours since the previous dated message of the same keys; the first of each has null."""
    dated = turns.where(F.col("date").isNotNull())
    for k in keys:
        dated = dated.where(F.col(k).isNotNull())
    before = previous(dated, keys, F.struct("turn_idx"), "date", "date_before")
    return before.withColumn("hours", hours_between(F.col("date_before"), F.col("date")))


def interval_statistics(turns: DataFrame, keys: list[str], source: DataFrame | None = None) -> DataFrame:
    """Mean, exact median, sample deviation and number of the hours between messages.

    ``source``: the messages before they were ordered, for counting them at less cost.
    """
    hours = intervals(turns, keys).where("hours IS NOT NULL")
    mean, _, deviation, _, count = statistics(F.col("hours"))
    if not large(turns if source is None else source, keys[0], BUFFERED).isEmpty():
        return hours.groupBy(*keys).agg(mean, deviation, count).join(medians(hours, keys, "hours", "median").withColumn("median", F.round("median", 6)), keys)
    return hours.groupBy(*keys).agg(*statistics(F.col("hours"))[:3], count)


def length_statistics(turns: DataFrame, keys: list[str]) -> DataFrame:
    return turns.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(*statistics(F.col("word_count")))


def lengths_by_label(turns: DataFrame, keys: list[str]) -> DataFrame:
    """Lengths of the parts of a message by label: positive counts of three columns, and unlabelled messages whole."""
    parts = F.array(
        F.struct(F.lit("in-character").alias("label"), F.col("in_character_word_count").alias("words")),
        F.struct(F.lit("out-of-character").alias("label"), F.col("out_of_character_word_count").alias("words")),
        F.struct(F.lit("mixed").alias("label"), F.col("mixed_word_count").alias("words")),
        F.struct(F.lit("unlabeled").alias("label"), F.when(F.col("primary_label") == "unlabeled", F.col("word_count")).alias("words")),
    )
    flat = turns.select(*keys, F.explode(parts).alias("p")).select(*keys, "p.label", "p.words").where("words > 0")
    return flat.groupBy(*keys, "label").agg(*statistics(F.col("words")), F.sum("words").alias("total_words"))


def label_summary(turns: DataFrame) -> DataFrame:
    c = F.col("label_counts")
    used = sum((F.coalesce(c.getField(k), F.lit(0)) > 0).cast("int") for k in ("in_character", "out_of_character", "mixed"))
    return turns.groupBy("campaign_id").agg(
        F.count("*").alias("messages"), F.count_if(used > 0).alias("labelled"), F.count_if(used > 1).alias("several_labels"),
        F.round(F.avg(used), 6).alias("labels_per_message"),
    )


def mention_counts(turns: DataFrame, top: int = 15) -> DataFrame:
    """The most mentioned names of each campaign; ties by first mention, then name.  A report: it keeps ``top`` rows."""
    each = turns.select("campaign_id", "turn_idx", F.explode("name_mentions").alias("name"))
    counted = each.groupBy("campaign_id", "name").agg(F.count("*").alias("mentions"), F.min("turn_idx").alias("first_turn"))
    ranked = counted.withColumn("rank", F.row_number().over(W.partitionBy("campaign_id").orderBy(F.desc("mentions"), "first_turn", "name")))
    return ranked.where(F.col("rank") <= top)


def mention_totals(turns: DataFrame) -> DataFrame:
    each = turns.select("campaign_id", F.explode("name_mentions").alias("name")).groupBy("campaign_id", "name").agg(F.count("*").alias("n"))
    return each.groupBy("campaign_id").agg(F.sum("n").alias("mentions"), F.count("*").alias("names"))


def dice_overall(turns: DataFrame) -> DataFrame:
    return turns.groupBy("campaign_id").agg(
        F.count("*").alias("messages"), F.count_if("has_dice_roll").alias("rolls"),
        F.round(100.0 * F.count_if("has_dice_roll") / F.count("*"), 6).alias("percent"),
    )


def dice_by_player(turns: DataFrame, least: int = 5) -> DataFrame:
    by = turns.where("player IS NOT NULL").groupBy("campaign_id", "player").agg(
        F.count("*").alias("messages"), F.count_if("has_dice_roll").alias("rolls"),
        F.round(100.0 * F.count_if("has_dice_roll") / F.count("*"), 6).alias("percent"),
    )
    return by.where(F.col("messages") >= least)


def dice_daily(turns: DataFrame) -> DataFrame:
    return turns.where("date IS NOT NULL").groupBy("campaign_id", F.to_date("date").alias("day")).agg(
        F.count("*").alias("messages"), F.count_if("has_dice_roll").alias("rolls")
    )


def summary_report(turns: DataFrame) -> DataFrame:
    """Span in whole days, distinct players and characters, pace, most active player and shares of modes."""
    days = F.floor(micros_between(F.min("date"), F.max("date")) / DAY_MICROS)
    share = lambda cond: F.round(100.0 * F.count_if(cond) / F.count("*"), 6)
    base = turns.groupBy("campaign_id").agg(
        F.count("*").alias("messages"), days.alias("days"), F.count_distinct("player").alias("players"),
        F.count_distinct("character").alias("characters"), share(F.col("in_combat")).alias("combat_percent"),
        share(F.col("message_type") == "action").alias("action_percent"), share(F.col("message_type") == "dialogue").alias("dialogue_percent"),
        share(F.col("message_type") == "narrative").alias("narrative_percent"), F.sum("word_count").alias("words"),
    )
    by = turns.where("player IS NOT NULL").groupBy("campaign_id", "player").agg(F.count("*").alias("n"), F.min("turn_idx").alias("first"))
    active = by.groupBy("campaign_id").agg(F.max_by("player", F.struct("n", -F.col("first"))).alias("most_active"))
    joined = base.join(active, "campaign_id", "left")
    return joined.withColumn("per_day", F.round(F.col("messages") / F.greatest(F.coalesce("days", F.lit(0)), F.lit(1)), 6))


def campaign_bundle(turns: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """One row per campaign with the headline figures of length, rhythm and dice."""
    flat = turns.groupBy("campaign_id").agg(
        *statistics(F.col("word_count"), "words_")[:2], F.count("*").alias("messages"), F.count_distinct("player").alias("players"),
        F.round(100.0 * F.count_if("has_dice_roll") / F.count("*"), 6).alias("dice_percent"),
    )
    rhythm = interval_statistics(turns, ["campaign_id"], source).select("campaign_id", F.col("mean").alias("hours_mean"), F.col("median").alias("hours_median"))
    return flat.join(rhythm, "campaign_id", "left")


def largest_campaigns(turns: DataFrame, top: int = 10) -> DataFrame:
    return turns.groupBy("campaign_id").agg(F.count("*").alias("messages")).orderBy(F.desc("messages"), "campaign_id").limit(top)


def cumulative_posts_by_player(turns: DataFrame, more_than: int = 5) -> DataFrame:
    """Posts per player up to each posting day of the campaign, without gaps, for players with more than a few."""
    dated = turns.where("date IS NOT NULL AND player IS NOT NULL").withColumn("day", F.to_date("date"))
    daily = dated.groupBy("campaign_id", "player", "day").agg(F.count("*").alias("n"))
    keep = daily.groupBy("campaign_id", "player").agg(F.sum("n").alias("total")).where(F.col("total") > more_than).drop("total")
    spine = daily.select("campaign_id", "day").distinct().join(keep, "campaign_id")
    full = spine.join(daily, ["campaign_id", "player", "day"], "left")
    up_to = W.partitionBy("campaign_id", "player").orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow)
    return full.select("campaign_id", "player", "day", F.sum(F.coalesce("n", F.lit(0))).over(up_to).alias("posts"))


def running_distinct(turns: DataFrame, column: str, into: str) -> DataFrame:
    """Distinct values of a column seen up to each turn: first occurrences are flagged, then summed along the order."""
    first = turns.where(F.col(column).isNotNull()).groupBy("campaign_id", column).agg(F.min("turn_idx").alias("turn_idx"))
    flags = first.groupBy("campaign_id", "turn_idx").agg(F.count("*").alias("_new"))
    base = turns.select("campaign_id", "chunk", "turn_idx").join(flags, ["campaign_id", "turn_idx"], "left").na.fill(0, ["_new"])
    return running_sum(base, ["campaign_id"], [F.col("turn_idx")], "_new", into).select("campaign_id", "turn_idx", into)


def rolling_mean(values: DataFrame, keys: list[str], order: str, value: str, window: int = 10) -> DataFrame:
    """Mean over a centred window of rows; null where the window is not full.

    ``order`` counts the rows of the keys without holes.  Windows run inside chunks of places; rows near a border also
    take part in the neighbouring chunk.
    """
    before, after = window // 2, window - window // 2 - 1
    own = F.floor(F.col(order) / PLACES)
    near = F.array_distinct(F.array(F.floor((F.col(order) - after) / PLACES), own, F.floor((F.col(order) + before) / PLACES)))
    spread = values.withColumn("_own", own).withColumn("_chunk", F.explode(near))
    frame = W.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(-before, after)
    rolled = spread.withColumn("rolling", F.when(F.count(value).over(frame) == window, F.round(F.avg(value).over(frame), 6)))
    return rolled.where("_own = _chunk").drop("_own", "_chunk")
