"""Differences of time stamps that do not depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def micros_between(a: Column, b: Column) -> Column:
    """Microseconds from ``a`` to ``b`` (both without time zone), as a long."""
    gap = b - a
    seconds = F.extract(F.lit("DAY"), gap).cast("long") * 86400 + F.extract(F.lit("HOUR"), gap).cast("long") * 3600
    seconds = seconds + F.extract(F.lit("MINUTE"), gap).cast("long") * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), gap) * 1_000_000).cast("long")


def hours_between(a: Column, b: Column) -> Column:
    return micros_between(a, b) / F.lit(3.6e9)
