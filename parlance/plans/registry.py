"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parlance.plans import analysis, basic, families, records, tables

FLAGSHIP = "time_intervals"
MODULES = (records, basic, analysis, tables, families)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.SQL.items()}
