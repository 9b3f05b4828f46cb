"""Cohesion of conversations by the cosine of message vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from parlance.functions.vectors import cosine, doubles, unit
from parlance.operators.order import offset


def place_in(df: DataFrame, keys: list[str], order: str, into: str) -> DataFrame:
    """0-based place in the order among the rows of the same keys, computed in chunks of the order's values."""
    chunked = df.withColumn("chunk", F.floor(F.col(order) / 4096))
    inside = W.partitionBy(*keys, "chunk").orderBy(order)
    return offset(chunked.withColumn(into, F.row_number().over(inside) - 1), keys, into, F.count("*")).drop("chunk")


def enough(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows of keys with at least ``least`` rows."""
    many = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    return df.join(many, keys, "left_semi")


def cosine_back(df: DataFrame, keys: list[str], place: str, window: int = 1) -> DataFrame:
    """Cosine with the row ``window`` places earlier; null for the first ones.  A join on the place, so no long window."""
    earlier = df.select(*keys, (F.col(place) + window).alias(place), F.col("vector").alias("_earlier"))
    return df.join(earlier, [*keys, place], "left").withColumn("cosine", cosine(F.col("vector"), F.col("_earlier"))).drop("_earlier")


def block_cohesion(df: DataFrame, keys: list[str], place: str, size: int = 5) -> DataFrame:
    """Cosines of all pairs inside blocks of ``size`` rows: mean, median, least, population deviation and counts.

    The number of pairs is bounded by the block's size.  Blocks with one row give no row.
    """
    blocked = df.withColumn("block", F.floor(F.col(place) / size))
    a = blocked.select(*keys, "block", F.col(place).alias("i"), F.col("vector").alias("x"))
    b = blocked.select(*keys, "block", F.col(place).alias("j"), F.col("vector").alias("y"))
    pairs = a.join(b, [*keys, "block"]).where("i < j").withColumn("c", cosine(F.col("x"), F.col("y")))
    stats = pairs.groupBy(*keys, "block").agg(
        F.round(F.avg("c"), 6).alias("mean"), F.round(F.median("c"), 6).alias("median"), F.round(F.min("c"), 6).alias("least"),
        F.round(F.stddev_pop("c"), 6).alias("deviation"), F.count("*").alias("comparisons"),
    )
    return stats.join(blocked.groupBy(*keys, "block").agg(F.count("*").alias("posts")), [*keys, "block"])


def diversity(df: DataFrame, keys: list[str], vector: Column) -> DataFrame:
    """Mean of 1 - cosine over all pairs of a group, from the sum of its unit vectors; null below two vectors.

    The sum of all pairwise cosines is (|sum of units|^2 - number of nonzero vectors) / 2, so no pair is formed.
    """
    units = df.select(*keys, unit(vector).alias("u"))
    parts = units.select(*keys, F.posexplode("u").alias("at", "x")).groupBy(*keys, "at").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    total = parts.groupBy(*keys).agg(F.sum(F.col("s") * F.col("s")).alias("s2"), F.sum("q").alias("nonzero"))
    n = units.groupBy(*keys).agg(F.count("*").alias("vectors"))
    value = 1 - (F.col("s2") - F.col("nonzero")) / F.nullif(F.col("vectors") * (F.col("vectors") - 1), F.lit(0))
    return n.join(total, keys).select(*keys, "vectors", F.round(value, 6).alias("diversity"))


def as_doubles(df: DataFrame) -> DataFrame:
    return df.withColumn("vector", doubles(F.col("vector")))
