"""The inputs that most queries share, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parlance.operators.order import once, with_turns
from parlance.session import Stage
from parlance.sources.tables import table

#: ``m``: one row per message with its place ``turn_idx`` in the campaign.
M = """
d AS (SELECT * FROM campaign_messages QUALIFY row_number() OVER (PARTITION BY campaign_id, message_id ORDER BY row_id) = 1),
m AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY date NULLS LAST, message_id) - 1 AS turn_idx FROM d)"""


def turns(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Messages in their order, with the columns asked for."""
    wanted = dict.fromkeys(("row_id", "campaign_id", "message_id", "date", *columns))
    return with_turns(table(spark, d, "campaign_messages").select(*wanted))


def messages(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Every message once, without their order: for figures that do not depend on it."""
    wanted = dict.fromkeys(("row_id", "campaign_id", "message_id", *columns))
    return once(table(spark, d, "campaign_messages").select(*wanted), columns)


def stored_turns(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """As :func:`turns`, written once: for queries that read the order several times."""
    return Stage(turns(spark, d, *columns), "turns").df


def stats(value: str, prefix: str = "", largest: bool = True) -> str:
    """SQL of the five statistics of a column."""
    top = f"max({value}) AS {prefix}max, " if largest else ""
    return (
        f"round(avg({value}), 6) AS {prefix}mean, round(median({value}), 6) AS {prefix}median, "
        f"round(stddev_samp({value}), 6) AS {prefix}std, {top}count({value}) AS {prefix}count"
    )
