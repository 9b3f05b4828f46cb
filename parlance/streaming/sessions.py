"""Streaming counterparts of the batch operators, on event time with a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as files arrive in a folder."""
    return spark.readStream.schema(EVENTS).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events per day and type."""
    windowed = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return windowed.select(F.col("window.start").alias("day"), "event_type", "n")


def sliding(events: DataFrame, length: str = "1 day", every: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Events per type in overlapping windows; on a stream or a table."""
    windowed = events.withWatermark("ts", late) if events.isStreaming else events
    counted = windowed.groupBy(F.window("ts", length, every), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Sessions per user, emitted once the watermark has passed their end."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("n_events"))
    return grouped.select("user_id", "started_at", "ended_at", "n_events")


def deduplicated(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Every event once, however often it arrives within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


class _Due(StatefulProcessor):
    """Counts a key's events and tells which chunks fall due; the state is one pair of counters per key."""

    def __init__(self, chunk: int, verbatim: int):
        self.chunk, self.verbatim = chunk, verbatim

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "seen long, done long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        seen, done = self.counts.get() if self.counts.exists() else (0, 0)
        seen += sum(len(b) for b in rows)
        out = []
        while (done + 1) * self.chunk <= seen and seen - (done + 1) * self.chunk >= self.verbatim:
            out.append((key[0], done * self.chunk, (done + 1) * self.chunk - 1))
            done += 1
        self.counts.update((seen, done))
        yield pd.DataFrame(out, columns=["user_id", "chunk_start", "chunk_end"])

    def close(self) -> None:
        pass


def summaries_due(events: DataFrame, chunk: int = 50, verbatim: int = 50) -> DataFrame:
    """Chunks of a user's events that fall due for a summary, counted in the order of arrival.

    Needs the state store ``STATE_STORE`` as ``spark.sql.streaming.stateStore.providerClass``.
    """
    return events.groupBy("user_id").transformWithStateInPandas(
        _Due(chunk, verbatim), outputStructType="user_id long, chunk_start long, chunk_end long", outputMode="Append", timeMode="None"
    )
