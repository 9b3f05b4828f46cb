"""Sessions separated by inactivity, built per time chunk and merged at the chunk borders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from parlance.functions.times import micros_between


def handle(col: Column) -> Column:
    """A user's handle: white space trimmed, lower-cased; null when nothing is left."""
    bare = F.lower(F.regexp_replace(col, r"(?U)^\s+|\s+$", ""))
    return F.when(bare != "", bare)


def gap_sessions(
    events: DataFrame,
    user: Column,
    at: Column,
    identity: tuple[Column, ...] = (),
    gap_seconds: int = 6 * 3600,
    chunk_days: float = 30,
) -> DataFrame:
    """Sessions ``(user, started_at, ended_at, n_events, duration_seconds)`` of every user.

    A new session begins when more than ``gap_seconds`` passed since the user's previous event; a gap of exactly
    that length stays inside the session.

    * Work is split by ``(user, time chunk)``: local sessions are built inside each chunk, so a user with a third
      of all rows is spread over as many tasks as that user has chunks.  Only the first and last local session of
      a chunk can touch a neighbour; the merge window therefore sees at most two rows per user and chunk, a number
      bounded by the time span and not by the volume.  ``chunk_days`` may be a fraction, down to an hour.
    * ``identity``: columns that name an event.  Rows that agree in them and in user and time are one event
      loaded repeatedly and count once; a row with a null identity column stands for itself.  Copies share their
      time, hence their chunk, so they vanish inside the same shuffle that builds the sessions.
    * Null users or times take no part.  Equal times are one instant inside a session.  An empty input gives an
      empty result.  Other columns of ``events`` are ignored and may have any name.
    """
    keys = [c.alias(f"k{i}") for i, c in enumerate(identity)]
    base = events.select(user.alias("u"), at.cast("timestamp_ntz").alias("t"), *keys)
    base = base.where(F.col("u").isNotNull() & F.col("t").isNotNull())
    base = base.withColumn("chunk", F.floor((F.unix_date(F.col("t").cast("date")) * 24 + F.hour("t")) / max(1, round(24 * chunk_days))).cast("int"))

    names = [f"k{i}" for i in range(len(identity))]
    local = W.partitionBy("u", "chunk").orderBy("t", *names)
    prev_t = F.lag("t").over(local)
    copy = F.lit(False)
    if names:
        copy = prev_t == F.col("t")
        for k in names:
            copy = copy & (F.lag(k).over(local) == F.col(k))
    marked = base.select(
        "u", "chunk", "t",
        F.coalesce(copy, F.lit(False)).alias("copy"),
        F.coalesce(beyond(prev_t, F.col("t"), gap_seconds), F.lit(True)).cast("int").alias("fresh"),
    )
    running = W.partitionBy("u", "chunk").orderBy("t").rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = (
        marked.withColumn("s", F.sum("fresh").over(running))
        .groupBy("u", "chunk", "s")
        .agg(F.min("t").alias("b"), F.max("t").alias("e"), F.sum((~F.col("copy")).cast("long")).alias("n"))
    )
    last = F.max("s").over(W.partitionBy("u", "chunk"))
    inner = (F.col("s") > 1) & (F.col("s") < F.col("last"))
    # Sessions inside a chunk keep their chunk as a key of their own; those at its borders meet under a null key.
    parts = parts.withColumn("last", last).withColumn("own", F.when(inner, F.col("chunk")))

    border = W.partitionBy("u", "own").orderBy("b", "e")
    joined = parts.withColumn(
        "fresh", F.coalesce(beyond(F.lag("e").over(border), F.col("b"), gap_seconds), F.lit(True)).cast("int")
    ).withColumn("s", F.sum("fresh").over(border.rowsBetween(W.unboundedPreceding, W.currentRow)))
    merged = joined.groupBy("u", "own", "s").agg(
        F.min("b").alias("started_at"), F.max("e").alias("ended_at"), F.sum("n").alias("n_events")
    )
    return merged.select(
        F.col("u").alias("user"), "started_at", "ended_at", "n_events",
        F.floor(micros_between(F.col("started_at"), F.col("ended_at")) / 1_000_000).alias("duration_seconds"),
    )


def beyond(a: Column, b: Column, seconds: int) -> Column:
    """Whether more than ``seconds`` lie between ``a`` and ``b``; null if either is null."""
    return b > a + F.make_dt_interval(secs=F.lit(seconds))
