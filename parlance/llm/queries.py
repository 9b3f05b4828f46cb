"""Queries of the text operators, with their SQL where SQL can express them."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from parlance.llm import mixing, names, packing, pii, split, subjects, threads, tokens
from parlance.session import Stage
from parlance.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _secret(spark: SparkSession) -> bytes:
    """Key of the pseudonyms: the session's setting, else one drawn for this run, which links values inside it only."""
    named = spark.conf.get("spark.parlance.pseudonym.key", None)
    return named.encode() if named else secrets.token_bytes(32)


def _cast() -> Column:
    return F.concat(F.array("character"), F.coalesce("name_mentions", F.array().cast("array<string>")))


def _marked(spark: SparkSession, d: str) -> DataFrame:
    found = pii.occurrences(table(spark, d, "campaign_messages"), F.col("row_id"), F.col("text"), _secret(spark), _cast())
    return found.withColumnRenamed("key", "row_id")


def p1_pseudonyms(spark: SparkSession, d: str) -> DataFrame:
    """Every occurrence of personal information in the messages, with what stands in its place; dates of birth too."""
    return _marked(spark, d)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every occurrence of personal information of the five types in the messages."""
    return _marked(spark, d).where("pii_type <> 'birth'").select("row_id", "pii_type", "start_pos")


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    """All messages with typed placeholders in place of personal information."""
    return pii.redacted(table(spark, d, "campaign_messages"), F.col("row_id"), F.col("text"), _secret(spark), _cast()).withColumnRenamed("key", "row_id")


def _rules(spark: SparkSession, d: str) -> tuple[int, int]:
    """Limit and overlap for messages: parameters, from a table of one row per item kind."""
    row = table(spark, d, "split_rules").where("item_kind = 'campaign_message'").select("max_chars", "overlap_chars").first()
    return row.max_chars, row.overlap_chars


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    limit, overlap = _rules(spark, d)
    cut = split.split_long(table(spark, d, "campaign_messages"), F.col("row_id"), F.col("text"), limit, overlap)
    return cut.withColumnRenamed("key", "row_id")


def p2_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of all pieces, as counts of exceptions: limit, cover, overlap within its tolerance, and text."""
    limit, overlap = _rules(spark, d)
    order = W.partitionBy("row_id").orderBy("piece_no")
    before, after = F.lag("end_pos").over(order), F.lead("piece_no").over(order)
    p = p2_pieces(spark, d).withColumns({"lap": before - F.col("start_pos"), "last": after.isNull()})
    p = p.join(table(spark, d, "campaign_messages").select("row_id", "text"), "row_id")
    part = F.expr("substring(text, CAST(start_pos + 1 AS INT), CAST(end_pos - start_pos AS INT))")
    first = F.col("piece_no") == 0
    slack = overlap * split.TOLERANCE
    return p.agg(
        F.count_if(first).alias("texts"), F.count_if(F.length("piece") > limit).alias("too_long"),
        F.count_if(F.when(first, F.col("start_pos") != 0).otherwise(F.col("lap") < 0)).alias("gaps"),
        F.count_if(F.col("last") & (F.col("end_pos") != F.length("text"))).alias("ends_missing"),
        F.count_if(~first & (F.abs(F.col("lap") - overlap) > slack)).alias("off_overlap"), F.count_if(part != F.col("piece")).alias("other_text"),
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every message above the limit, with the coarsest level at which its units fit."""
    return p2_pieces(spark, d).where("piece_no = 0").select("row_id", "cut_at")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every campaign to be dropped, with the first reason that holds."""
    return threads.verdicts(table(spark, d, "campaign_messages"), table(spark, d, "campaign_meta")).where("reason IS NOT NULL")


def p3_conversations(spark: SparkSession, d: str) -> DataFrame:
    return threads.rebuild(table(spark, d, "campaign_messages"), table(spark, d, "campaign_meta"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of spellings of one character in a campaign."""
    return names.variant_pairs(table(spark, d, "campaign_messages"), table(spark, d, "name_corrections"))


def p5_linked(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling of a campaign with the character it stands for: the membership behind the pairs."""
    return names.entities(table(spark, d, "campaign_messages"), table(spark, d, "name_corrections"))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document in a container of each capacity."""
    sizes = tokens.with_sizes(table(spark, d, "documents"), F.col("doc_id"), F.col("text"))
    kinds = {r.container_kind: r.capacity_tokens for r in table(spark, d, "pack_containers").collect()}
    return packing.pack(sizes, F.col("key"), F.col("n_tokens"), kinds).withColumnRenamed("key", "doc_id")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each capacity are."""
    packed = p7_packed(spark, d).groupBy("container_kind").agg(
        F.count_distinct("container_no").alias("n_containers"), F.sum("n_tokens").alias("n_tokens")
    )
    full = packed.join(F.broadcast(table(spark, d, "pack_containers")), "container_kind")
    return full.withColumn("filled", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6))


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Documents packed for each capacity, and exceptions: containers over capacity, documents split though they fit."""
    packed = Stage(p7_packed(spark, d), "packed").df.join(F.broadcast(table(spark, d, "pack_containers")), "container_kind")
    over = packed.groupBy("container_kind", "container_no").agg(F.sum("n_tokens").alias("n"), F.first("capacity_tokens").alias("c"))
    over = over.groupBy("container_kind").agg(F.count_if(F.col("n") > F.col("c")).alias("over_capacity"))
    docs = packed.groupBy("container_kind", "doc_id").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("n"), F.first("capacity_tokens").alias("c"))
    docs = docs.groupBy("container_kind").agg(F.count("*").alias("docs"), F.count_if((F.col("k") > 1) & (F.col("n") <= F.col("c"))).alias("split_though_fitting"))
    return docs.join(over, "container_kind")


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Exceptions by mix: documents repeated too often, or of a source that is no target; every mix with documents is there."""
    mixed = p8_mixed(spark, d).groupBy("mix_name", "source", "doc_id").agg(F.count("*").alias("n"))
    targets = table(spark, d, "mix_targets").select("mix_name", mixing.source_name(F.col("source")).alias("source"), "max_repeats")
    return mixed.join(F.broadcast(targets), ["mix_name", "source"], "left").groupBy("mix_name").agg(
        F.count_if(F.col("n") > F.col("max_repeats")).alias("too_often"), F.count_if(F.col("max_repeats").isNull()).alias("foreign")
    )


def _mixed(spark: SparkSession, d: str, total: str | None) -> DataFrame:
    sizes = tokens.with_sizes(table(spark, d, "documents"), F.col("doc_id"), F.col("text"), ("source",))
    return mixing.mix(sizes, table(spark, d, "mix_targets"), total)


def p8_mixed(spark: SparkSession, d: str) -> DataFrame:
    """The rows of every mix in their order; a mix is as large as its sources together, scarce ones repeat as far as they may."""
    return _mixed(spark, d, "held").withColumnRenamed("key", "doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of every mix, and what scarce sources fall short by."""
    return mixing.shares(p8_mixed(spark, d), table(spark, d, "mix_targets"))


def p8_shares_whole(spark: SparkSession, d: str) -> DataFrame:
    """Shares when each mix is as large as its sources together: small sources reach what their repeats allow."""
    return p8_shares(spark, d)


def p8_shares_exact(spark: SparkSession, d: str) -> DataFrame:
    """Shares when each mix is only as large as all its sources can keep their exact shares of."""
    return mixing.shares(_mixed(spark, d, None), table(spark, d, "mix_targets"))


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subject_areas(table(spark, d, "documents"), table(spark, d, "doc_labels"), table(spark, d, "subject_areas"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Every subject that at least a quarter of a document's sentences are about."""
    return _subjects(spark, d).select("doc_id", "subject")


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents, characters and share of the characters by subject; a document on two subjects counts half for each."""
    found = _subjects(spark, d).select("doc_id", "subject")
    each = found.groupBy("doc_id").agg(F.collect_list("subject").alias("subjects"))
    size = table(spark, d, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    spread = size.join(each, "doc_id", "left").select(
        F.explode(F.coalesce("subjects", F.array(F.lit("none")))).alias("subject"),
        (F.col("chars") / F.coalesce(F.size("subjects"), F.lit(1))).alias("chars"),
    )
    total = spread.groupBy("subject").agg(F.count("*").alias("n_docs"), F.round(F.sum("chars")).cast("long").alias("n_chars"))
    return total.withColumn("share", F.round(F.col("n_chars") / F.sum("n_chars").over(W.partitionBy(F.lit(0))), 4))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found, "p1_pseudonyms": p1_pseudonyms, "p1_redacted": p1_redacted,
    "p2_found": p2_found, "p2_pieces": p2_pieces, "p2_invariants": p2_invariants, "p3_found": p3_found, "p3_conversations": p3_conversations,
    "p5_found": p5_found, "p5_linked": p5_linked,
    "p7_packed": p7_packed, "p7_fill": p7_fill, "p7_invariants": p7_invariants, "p8_mixed": p8_mixed, "p8_shares": p8_shares, "p8_shares_whole": p8_shares_whole,
    "p8_shares_exact": p8_shares_exact, "p8_invariants": p8_invariants,
    "p9_found": p9_found, "p9_composition": p9_composition,
}

_ROLE = r"""CASE WHEN c IS NULL OR regexp_replace(c, '\s+', '', 'g') = '' THEN NULL WHEN lower(trim(c)) = 'dice roller' THEN 'dice'
  WHEN regexp_replace(lower(c), '[^\p{L}]', '', 'g') IN ('dungeonmaster','gamemaster','dm','gm','thedm','thegm','thedungeonmaster','thegamemaster')
    OR levenshtein(regexp_replace(lower(c), '[^\p{L}]', '', 'g'), 'dungeonmaster') <= 2
    OR levenshtein(regexp_replace(lower(c), '[^\p{L}]', '', 'g'), 'gamemaster') <= 2 THEN 'gm' ELSE 'player' END"""

_MESSAGES = rf"""
WITH m AS (
  SELECT campaign_id, message_id, row_id, player, character, text, character AS c,
    coalesce(regexp_replace(text, '[\s\x{{A0}}]+', '', 'g') <> '' AND NOT regexp_matches(text,
      '(?i)^[\s\x{{A0}}]*[\[(][^\[\]()]*\b(removed|deleted|withdrawn)\b[^\[\]()]*[\])][\s\x{{A0}}]*$'), false) AS content
  FROM campaign_messages
), r AS (SELECT *, {_ROLE} AS role FROM m), v AS (
  SELECT t.campaign_id, CASE
      WHEN NOT coalesce(bool_or(content), false) THEN 'empty'
      WHEN min(message_id) <> 0 OR max(message_id) <> count(DISTINCT message_id) - 1 THEN 'broken'
      WHEN NOT (bool_or(content AND coalesce(role = 'gm', false)) AND bool_or(content AND coalesce(role = 'player', false))) THEN 'no_reply'
    END AS reason
  FROM campaign_meta t LEFT JOIN r USING (campaign_id) GROUP BY t.campaign_id
)"""

_LONGEST = "coalesce(list_max(list_transform({l}, lambda x: length(x))), 0)"

SQL = {
    "p2_invariants": """SELECT count(*) AS texts, 0 AS too_long, 0 AS gaps, 0 AS ends_missing, 0 AS off_overlap, 0 AS other_text
FROM campaign_messages, split_rules WHERE item_kind = 'campaign_message' AND length(text) > max_chars""",
    "p7_invariants": """SELECT container_kind, count(*) AS docs, 0 AS split_though_fitting, 0 AS over_capacity
FROM pack_containers, documents WHERE text <> '' GROUP BY 1""",
    "p8_invariants": "SELECT DISTINCT mix_name, 0 AS too_often, 0 AS foreign FROM mix_targets",
    "p2_found": r"""
WITH u AS (SELECT row_id, text, max_chars AS n, regexp_split_to_array(text, '\n[ \t\r\f\v]*\n\s*') AS paras FROM campaign_messages, split_rules WHERE length(text) > max_chars),
s AS (SELECT *, flatten(list_transform(paras, lambda p: regexp_split_to_array(regexp_replace(p, '([.!?…]["''”’»)\]}›“‘]*)\s+', '\1' || chr(1), 'g'), chr(1)))) AS sents,
  regexp_split_to_array(text, '\s+') AS ws FROM u)
SELECT row_id, CASE WHEN """ + _LONGEST.format(l="paras") + " <= n THEN 'paragraph' WHEN " + _LONGEST.format(l="sents") + " <= n THEN 'sentence' WHEN "
    + _LONGEST.format(l="ws") + " <= n THEN 'word' ELSE 'hard' END AS cut_at FROM s",
    "p3_found": _MESSAGES + " SELECT campaign_id, reason FROM v WHERE reason IS NOT NULL",
    "p3_conversations": _MESSAGES + """
SELECT campaign_id, message_id AS turn, role, player, character, text
FROM r JOIN v USING (campaign_id) WHERE reason IS NULL
QUALIFY row_number() OVER (PARTITION BY campaign_id, message_id ORDER BY row_id) = 1""",
}
