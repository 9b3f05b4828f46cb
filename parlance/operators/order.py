"""The total order of a conversation's messages, without ever putting a whole conversation into one task.

Rows are split by ``(campaign, time chunk)``.  Ranks, running sums and previous values are computed inside chunks; what
crosses a chunk's border comes from one small row per chunk.  Chunks are weeks, and minutes in campaigns that are large
against all messages, whose weeks could hold a good part of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CHUNK_DAYS = 7
#: A campaign is large if it has more messages than this, and more than a hundred-thousandth of all.
LARGE, MOST_LARGE = 2_000, 100_000
#: Messages without a date come last, in chunks of so many places of the tie.
LAST_CHUNK, UNDATED = 2**40, 4_096


def once(messages: DataFrame, columns: tuple[str, ...], load: str = "row_id") -> DataFrame:
    """One row per ``(campaign_id, message_id)`` with ``columns``, by the smallest ``load``; no order, one exchange by message."""
    groups = ("campaign_id", "message_id")
    return messages.groupBy(*groups).agg(*(F.min_by(c, load).alias(c) for c in columns)) if columns else messages.select(*groups).distinct()


def large(rows: DataFrame, key: str, least: int | None = None) -> DataFrame:
    """Values of ``key`` with more rows than ``least`` and than a hundred-thousandth of all, as ``key, large``.

    They are fewer than ``MOST_LARGE``, so they can be sent to every task.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    # One row.
    total = counts.agg(F.sum("n").alias("total"))
    bound = F.greatest(F.lit(LARGE if least is None else least), F.col("total") / MOST_LARGE)
    return counts.crossJoin(F.broadcast(total)).where(F.col("n") > bound).select(key, F.lit(True).alias("large"))


def with_turns(messages: DataFrame, tie: tuple[str, ...] = ("message_id", "row_id"), least: int | None = None) -> DataFrame:
    """One row per message with ``chunk`` and ``turn_idx``, its 0-based place in the campaign.

    The order is by date (nulls last), then by ``tie``, whose first column is a number.  ``(campaign_id, message_id)``
    identifies a message; a message loaded repeatedly counts once, by its smallest row id.  Copies share their date,
    hence their chunk, and are dropped inside the shuffle that builds the order.
    """
    day = F.unix_date(F.col("date").cast("date"))
    minute = day.cast("long") * 1440 + F.hour("date") * 60 + F.minute("date")
    chunk = (
        F.when(F.col("date").isNull(), LAST_CHUNK + F.floor(F.coalesce(F.col(tie[0]), F.lit(0)) / UNDATED)).when(F.col("large"), minute)
        .otherwise(F.floor(day / CHUNK_DAYS))
    )
    marked = messages.join(F.broadcast(large(messages, "campaign_id", least)), "campaign_id", "left")
    keyed = marked.withColumn("chunk", chunk.cast("long")).drop("large")
    inside = W.partitionBy("campaign_id", "chunk").orderBy(F.col("date").asc_nulls_last(), *tie)
    copy = F.coalesce(F.lag("message_id").over(inside) == F.col("message_id"), F.lit(False))
    fresh = keyed.withColumn("_copy", copy).where(~F.col("_copy")).drop("_copy")
    return offset(fresh.withColumn("turn_idx", F.row_number().over(inside) - 1), ["campaign_id"], "turn_idx", F.count("*"))


def offset(df: DataFrame, keys: list[str], into: str, amount: Column) -> DataFrame:
    """Adds to ``into`` the sum of ``amount`` over all earlier chunks of the same keys."""
    sums = df.groupBy(*keys, "chunk").agg(amount.alias("_n"))
    before = W.partitionBy(*keys).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*keys, "chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = df.join(sums, [*keys, "chunk"])
    return joined.withColumn(into, (F.col(into) + F.col("_before")).cast("long")).drop("_before")


def running_sum(df: DataFrame, keys: list[str], order: list[Column], value: str, into: str) -> DataFrame:
    """Adds ``into``: the sum of ``value`` up to and with the row, in chunk and row order."""
    inside = W.partitionBy(*keys, "chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return offset(df.withColumn(into, F.sum(value).over(inside)), keys, into, F.sum(value))


def previous(df: DataFrame, keys: list[str], order: Column, value: str, into: str) -> DataFrame:
    """Adds ``into``: ``value`` of the row before, also across the border of chunks; null for the first row."""
    inside = W.partitionBy(*keys, "chunk").orderBy(order)
    last = df.groupBy(*keys, "chunk").agg(F.max_by(F.struct(value), order).alias("_l"))
    last = last.withColumn("_p", F.lag("_l").over(W.partitionBy(*keys).orderBy("chunk"))).select(*keys, "chunk", "_p")
    here = df.withColumn("_i", F.lag(F.struct(value)).over(inside)).join(last, [*keys, "chunk"])
    return here.withColumn(into, F.coalesce("_i", "_p").getField(value)).drop("_i", "_p")
