"""Queries of the general data operators: sessions by time and flat tables of nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from parlance.operators.sessions import gap_sessions, handle
from parlance.operators.shred import actions_table, clean_label, messages_table, paragraphs_table
from parlance.sources.tables import table

STAMP = "yyyy-MM-dd HH:mm:ss"


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of every player over all campaigns; more than 6 hours of silence end one."""
    found = gap_sessions(
        table(spark, d, "campaign_messages"), handle(F.col("player")), F.col("date"),
        identity=(F.col("campaign_id"), F.col("message_id")),
    )
    return found.select(
        F.col("user").alias("player"),
        F.date_format("started_at", STAMP).alias("started_at"),
        F.date_format("ended_at", STAMP).alias("ended_at"),
        F.col("n_events").alias("n_messages"),
    )


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_messages")
    return raw.where(~F.coalesce(F.col("message_key").startswith("_"), F.lit(False))).select("raw_id", "payload")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per paragraph action, and one for every paragraph without any."""
    rows = actions_table(_payloads(spark, d), F.col("raw_id"), F.col("payload"), outer=True)
    return rows.select(
        F.col("record_id").alias("raw_id"), "para_key", clean_label(F.col("label")).alias("label_out"), "action_no", "action_name"
    )


def p6_messages(spark: SparkSession, d: str) -> DataFrame:
    return messages_table(_payloads(spark, d), F.col("raw_id"), F.col("payload"))


def p6_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return paragraphs_table(_payloads(spark, d), F.col("raw_id"), F.col("payload"))


QUERIES = {"p4_found": p4_found, "p6_found": p6_found, "p6_messages": p6_messages, "p6_paragraphs": p6_paragraphs}

#: Paragraph objects of readable new-format messages: ``raw_id, k, q`` (key or place, paragraph).
PARAGRAPHS = """
t0 AS (SELECT raw_id, payload AS p FROM raw_messages WHERE NOT coalesce(starts_with(message_key, '_'), false) AND json_valid(payload)),
t1 AS (SELECT raw_id, CASE WHEN json_type(p) = 'VARCHAR' THEN p ->> '$' ELSE p END AS p FROM t0),
t2 AS (SELECT raw_id, p FROM t1 WHERE json_valid(p)),
t3 AS (SELECT raw_id, CASE WHEN json_type(p) = 'OBJECT' AND json_keys(p) = ['message'] THEN CAST(json_extract(p, '$.message') AS VARCHAR) ELSE p END AS p FROM t2),
msg AS (SELECT raw_id, p, json_extract(p, '$.paragraphs') AS ps, coalesce(json_type(p, '$.text'), 'NULL') <> 'NULL' AS old FROM t3 WHERE json_type(p) = 'OBJECT'),
ent AS (SELECT raw_id, nth, k, json_extract(ps, '$."' || k || '"') AS q FROM (SELECT raw_id, ps, unnest(json_keys(ps)) AS k, unnest(range(len(json_keys(ps)))) AS nth FROM msg WHERE NOT old AND json_type(ps) = 'OBJECT')
  UNION ALL SELECT raw_id, i, CAST(i AS VARCHAR), json_extract(ps, '$[' || i || ']') FROM (SELECT raw_id, ps, unnest(range(CAST(json_array_length(ps) AS BIGINT))) AS i FROM msg WHERE NOT old AND json_type(ps) = 'ARRAY')),
par AS (SELECT raw_id, nth, k, q, json_extract(q, '$.actions') AS a FROM ent WHERE json_type(q) = 'OBJECT')"""
LABEL = r"""CASE WHEN lower(regexp_replace(q ->> '$.label', '^\s+|\s+$', '', 'g')) IN ('in-character', 'out-of-character', 'mixed')
  THEN lower(regexp_replace(q ->> '$.label', '^\s+|\s+$', '', 'g')) ELSE 'unlabeled' END"""
#: Actions of the paragraphs, nulls left out, numbered from 1; with the paragraphs that have none.
ACTIONS = """
one AS (SELECT raw_id, k, q, 0 AS i, a AS x FROM par WHERE json_type(a) = 'VARCHAR'
  UNION ALL SELECT raw_id, k, q, i, json_extract(a, '$[' || i || ']') FROM (SELECT *, unnest(range(CAST(json_array_length(a) AS BIGINT))) AS i FROM par WHERE json_type(a) = 'ARRAY')),
act AS (SELECT raw_id, k, q, row_number() OVER (PARTITION BY raw_id, k ORDER BY i) AS action_no,
  coalesce(CASE WHEN json_type(x) = 'OBJECT' THEN x ->> '$.name' ELSE x ->> '$' END, '') AS action_name FROM one WHERE json_type(x) <> 'NULL'),
every AS (SELECT * FROM act UNION ALL SELECT raw_id, k, q, CASE WHEN coalesce(json_type(a), 'NULL') = 'NULL' THEN -1 ELSE 0 END, '' FROM par
  WHERE NOT EXISTS (SELECT 1 FROM act WHERE act.raw_id = par.raw_id AND act.k = par.k))"""

_STRING = "CASE WHEN json_type({o}, '$.{c}') = 'VARCHAR' THEN {o} ->> '$.{c}' END AS {c}"

SQL = {
    "p6_messages": f"WITH {PARAGRAPHS} SELECT raw_id AS record_id, " + ", ".join(_STRING.format(o="p", c=c) for c in ("date", "player", "character", "text"))
    + ", CASE WHEN old THEN 'old' ELSE 'new' END AS format FROM msg",
    "p6_paragraphs": f"""WITH {PARAGRAPHS}, num AS (SELECT raw_id, k, q, row_number() OVER (PARTITION BY raw_id ORDER BY nth) - 1 AS para_no FROM par)
SELECT raw_id AS record_id, para_no, k AS para_key, """ + ", ".join(_STRING.format(o="q", c=c) for c in ("text", "label")) + " FROM num",
    "p6_found": f"WITH {PARAGRAPHS}, {ACTIONS} SELECT raw_id, k AS para_key, {LABEL} AS label_out, action_no, action_name FROM every",
    "p4_found": r"""
WITH m AS (
  SELECT DISTINCT campaign_id, message_id, lower(regexp_replace(player, '^\s+|\s+$', '', 'g')) AS player, date
  FROM campaign_messages WHERE date IS NOT NULL
), g AS (
  SELECT *, CASE WHEN date - lag(date) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh
  FROM m WHERE player <> '' WINDOW w AS (PARTITION BY player ORDER BY date, campaign_id, message_id)
), s AS (
  SELECT *, sum(fresh) OVER (PARTITION BY player ORDER BY date, campaign_id, message_id ROWS UNBOUNDED PRECEDING) AS sid FROM g
)
SELECT player, strftime(min(date), '%Y-%m-%d %H:%M:%S') AS started_at,
       strftime(max(date), '%Y-%m-%d %H:%M:%S') AS ended_at, count(*) AS n_messages
FROM s GROUP BY player, sid""",
}
