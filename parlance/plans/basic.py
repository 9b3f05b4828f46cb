"""Queries of the basic statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from parlance.functions import text as X
from parlance.operators import basic as B
from parlance.operators.sessions import gap_sessions, handle
from parlance.plans.base import M, messages, stats, stored_turns, turns
from parlance.sources.tables import table

HOURS = "date_diff('microsecond', lag(date) OVER (PARTITION BY {k} ORDER BY turn_idx), date) / 3.6e9"
PERCENT = "round(100.0 * count(*) FILTER (WHERE {c}) / count(*), 6)"


def time_intervals(spark: SparkSession, d: str) -> DataFrame:
    return B.interval_statistics(turns(spark, d), ["campaign_id"], table(spark, d, "campaign_messages"))


def time_intervals_by_player(spark: SparkSession, d: str) -> DataFrame:
    return B.interval_statistics(turns(spark, d, "player"), ["campaign_id", "player"], table(spark, d, "campaign_messages"))


def interval_series(spark: SparkSession, d: str) -> DataFrame:
    series = B.intervals(turns(spark, d), ["campaign_id"]).where("hours IS NOT NULL")
    return series.select("campaign_id", "turn_idx", F.round("hours", 6).alias("hours"))


def post_lengths(spark: SparkSession, d: str) -> DataFrame:
    return B.length_statistics(messages(spark, d, "word_count"), ["campaign_id"])


def post_lengths_by_player(spark: SparkSession, d: str) -> DataFrame:
    return B.length_statistics(messages(spark, d, "word_count", "player"), ["campaign_id", "player"])


def post_lengths_levels(spark: SparkSession, d: str) -> DataFrame:
    """Overall and per player in one pass over grouping sets; null players only take part overall."""
    t = messages(spark, d, "word_count", "player")
    sets = t.groupingSets([["campaign_id"], ["campaign_id", "player"]], "campaign_id", "player").agg(
        *B.statistics(F.col("word_count")), F.grouping("player").alias("overall")
    )
    return sets.where("overall = 1 OR player IS NOT NULL").withColumn("overall", F.col("overall").cast("int"))


LABEL_COLUMNS = ("word_count", "in_character_word_count", "out_of_character_word_count", "mixed_word_count", "primary_label", "player")


def post_lengths_by_label(spark: SparkSession, d: str) -> DataFrame:
    return B.lengths_by_label(messages(spark, d, *LABEL_COLUMNS), ["campaign_id"])


def post_lengths_by_label_player(spark: SparkSession, d: str) -> DataFrame:
    return B.lengths_by_label(messages(spark, d, *LABEL_COLUMNS).where("player IS NOT NULL"), ["campaign_id", "player"])


def label_summary(spark: SparkSession, d: str) -> DataFrame:
    return B.label_summary(messages(spark, d, "label_counts"))


def mention_counts(spark: SparkSession, d: str) -> DataFrame:
    return B.mention_counts(turns(spark, d, "name_mentions"))


def mention_totals(spark: SparkSession, d: str) -> DataFrame:
    return B.mention_totals(messages(spark, d, "name_mentions"))


def dice_roll_overall(spark: SparkSession, d: str) -> DataFrame:
    return B.dice_overall(messages(spark, d, "has_dice_roll"))


def dice_roll_by_player(spark: SparkSession, d: str) -> DataFrame:
    return B.dice_by_player(messages(spark, d, "has_dice_roll", "player"))


def dice_roll_daily(spark: SparkSession, d: str) -> DataFrame:
    return B.dice_daily(messages(spark, d, "has_dice_roll", "date"))


def summary_report(spark: SparkSession, d: str) -> DataFrame:
    return B.summary_report(stored_turns(spark, d, "player", "character", "in_combat", "message_type", "word_count"))


def campaign_bundle(spark: SparkSession, d: str) -> DataFrame:
    return B.campaign_bundle(stored_turns(spark, d, "player", "word_count", "has_dice_roll"), table(spark, d, "campaign_messages"))


def campaign_sizes(spark: SparkSession, d: str) -> DataFrame:
    return B.largest_campaigns(messages(spark, d))


def cumulative_posts(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).select("campaign_id", "message_id", (F.col("turn_idx") + 1).alias("posts"))


def cumulative_posts_by_player(spark: SparkSession, d: str) -> DataFrame:
    return B.cumulative_posts_by_player(turns(spark, d, "player"))


def unique_players_running(spark: SparkSession, d: str) -> DataFrame:
    t = stored_turns(spark, d, "player", "character")
    return B.running_distinct(t, "player", "players").join(B.running_distinct(t, "character", "characters"), ["campaign_id", "turn_idx"])


def min_turns_filter(spark: SparkSession, d: str) -> DataFrame:
    t = messages(spark, d)
    large = t.groupBy("campaign_id").agg(F.count("*").alias("n")).where("n >= 5")
    return t.join(large.select("campaign_id"), "campaign_id", "left_semi").groupBy("campaign_id").agg(F.count("*").alias("messages"))


def block_sessions(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    return t.select("campaign_id", "message_id", F.concat(F.lit("session_"), (F.floor(F.col("turn_idx") / 5) + 1).cast("string")).alias("session"))


def campaign_gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a campaign by silence of more than six hours; a campaign may be as dense as the whole table."""
    s = gap_sessions(table(spark, d, "campaign_messages"), F.col("campaign_id"), F.col("date"), (F.col("message_id"),), chunk_days=1 / 8)
    return s.select(F.col("user").alias("campaign_id"), "started_at", "ended_at", "n_events")


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = gap_sessions(table(spark, d, "events"), F.col("user_id"), F.col("ts"))
    return s.select(F.col("user").alias("user_id"), "started_at", "ended_at", "n_events", "duration_seconds")


def word_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "campaign_messages")
    names = ("text", "in_character_text", "out_of_character_text", "mixed_text")
    return t.select("row_id", *(X.word_count(F.col(c)).alias(f"n_{c}") for c in names))


def dice_flag(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "campaign_messages")
    return t.select("row_id", X.has_dice(F.col("text"), F.col("actions")).alias("has_dice"))


def message_type(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "campaign_messages")
    return t.select("row_id", X.message_type(F.col("text"), X.has_dice(F.col("text"), F.col("actions"))).alias("kind"))


def primary_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "campaign_messages").select("row_id", X.primary_label(F.col("label_counts")).alias("label"))


def action_fallback(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "campaign_messages").select("row_id", X.action_class(F.col("text")).alias("action_class"))


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "campaign_messages").select("row_id", X.token_estimate(F.col("text")).alias("tokens"))


def provider_route(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "campaign_meta").where("model IS NOT NULL")
    return t.select("campaign_id", X.provider(F.col("model")).alias("provider"), X.model_slug(F.concat(F.lit("x/"), "model")).alias("slug"))


def player_handles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "campaign_messages").select(handle(F.col("player")).alias("player")).where("player IS NOT NULL").groupBy("player").count()


QUERIES = {f.__name__: f for f in (
    time_intervals, time_intervals_by_player, interval_series, post_lengths, post_lengths_by_player, post_lengths_levels,
    post_lengths_by_label, post_lengths_by_label_player, label_summary, mention_counts, mention_totals, dice_roll_overall,
    dice_roll_by_player, dice_roll_daily, summary_report, campaign_bundle, campaign_sizes, cumulative_posts,
    cumulative_posts_by_player, unique_players_running, min_turns_filter, block_sessions, campaign_gap_sessions,
    event_sessions, word_counts, dice_flag, message_type, primary_label, action_fallback, token_estimate, provider_route,
    player_handles,
)}


def _intervals(keys: str) -> str:
    present = " AND ".join(f"{k.strip()} IS NOT NULL" for k in keys.split(","))
    return f"WITH {M}, g AS (SELECT {keys}, turn_idx, {HOURS.format(k=keys)} AS hours FROM m WHERE date IS NOT NULL AND {present})"


def _labels(keys: str, cond: str = "true") -> str:
    parts = " UNION ALL ".join(
        f"SELECT {keys}, '{label}' AS label, {col} AS words FROM m WHERE {col} > 0 AND {cond} AND {extra}"
        for label, col, extra in (
            ("in-character", "in_character_word_count", "true"), ("out-of-character", "out_of_character_word_count", "true"),
            ("mixed", "mixed_word_count", "true"), ("unlabeled", "word_count", "primary_label = 'unlabeled'"),
        )
    )
    return f"WITH {M}, p AS ({parts}) SELECT {keys}, label, {stats('words')}, sum(words) AS total_words FROM p GROUP BY {keys}, label"


def _contains(parts: tuple[str, ...], col: str) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(col, p.replace("'", "''")) for p in parts) + ")"


_WORDS = r"len(list_filter(regexp_split_to_array(coalesce({c}, ''), '[ \t\n\r\f\x0B]+'), lambda x: x <> ''))"
_DICE = (
    r"(coalesce(regexp_matches(lower(text), '\d+d\d+|roll|\d{1,2}\s*(that|with)'), false)"
    " OR coalesce(contains(json_extract(actions, '$.check')::varchar, 'roll'), false)"
    " OR coalesce(contains(json_extract(actions, '$.survival')::varchar, 'roll'), false))"
)


def _sessions(user: str, at: str, source: str) -> str:
    return f"""WITH e AS ({source}), g AS (SELECT *, CASE WHEN {at} - lag({at}) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh
  FROM e WINDOW w AS (PARTITION BY {user} ORDER BY {at}, k)), s AS (
  SELECT *, sum(fresh) OVER (PARTITION BY {user} ORDER BY {at}, k ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT {user}, min({at}) AS started_at, max({at}) AS ended_at, count(*) AS n_events"""


SQL = {
    "time_intervals": _intervals("campaign_id") + f" SELECT campaign_id, {stats('hours', largest=False)} FROM g WHERE hours IS NOT NULL GROUP BY 1",
    "time_intervals_by_player": _intervals("campaign_id, player")
    + f" SELECT campaign_id, player, {stats('hours', largest=False)} FROM g WHERE hours IS NOT NULL GROUP BY 1, 2",
    "interval_series": _intervals("campaign_id") + " SELECT campaign_id, turn_idx, round(hours, 6) AS hours FROM g WHERE hours IS NOT NULL",
    "post_lengths": f"WITH {M} SELECT campaign_id, {stats('word_count')} FROM m GROUP BY 1",
    "post_lengths_by_player": f"WITH {M} SELECT campaign_id, player, {stats('word_count')} FROM m WHERE player IS NOT NULL GROUP BY 1, 2",
    "post_lengths_levels": f"""WITH {M} SELECT campaign_id, CAST(NULL AS VARCHAR) AS player, {stats('word_count')}, 1 AS overall FROM m GROUP BY 1
UNION ALL SELECT campaign_id, player, {stats('word_count')}, 0 AS overall FROM m WHERE player IS NOT NULL GROUP BY 1, 2""",
    "post_lengths_by_label": _labels("campaign_id"),
    "post_lengths_by_label_player": _labels("campaign_id, player", "player IS NOT NULL"),
    "label_summary": f"""WITH {M}, u AS (SELECT campaign_id, CASE WHEN label_counts.in_character > 0 THEN 1 ELSE 0 END
  + CASE WHEN label_counts.out_of_character > 0 THEN 1 ELSE 0 END + CASE WHEN label_counts.mixed > 0 THEN 1 ELSE 0 END AS used FROM m)
SELECT campaign_id, count(*) AS messages, count(*) FILTER (WHERE used > 0) AS labelled, count(*) FILTER (WHERE used > 1) AS several_labels,
  round(avg(used), 6) AS labels_per_message FROM u GROUP BY 1""",
    "mention_counts": f"""WITH {M}, e AS (SELECT campaign_id, turn_idx, unnest(name_mentions) AS name FROM m)
SELECT campaign_id, name, count(*) AS mentions, min(turn_idx) AS first_turn,
  row_number() OVER (PARTITION BY campaign_id ORDER BY count(*) DESC, min(turn_idx), name) AS rank
FROM e GROUP BY campaign_id, name QUALIFY rank <= 15""",
    "mention_totals": f"""WITH {M}, e AS (SELECT campaign_id, unnest(name_mentions) AS name FROM m)
SELECT campaign_id, count(*) AS mentions, count(DISTINCT name) AS names FROM e GROUP BY 1""",
    "dice_roll_overall": f"""WITH {M} SELECT campaign_id, count(*) AS messages, count(*) FILTER (WHERE has_dice_roll) AS rolls,
  {PERCENT.format(c='has_dice_roll')} AS percent FROM m GROUP BY 1""",
    "dice_roll_by_player": f"""WITH {M} SELECT campaign_id, player, count(*) AS messages, count(*) FILTER (WHERE has_dice_roll) AS rolls,
  {PERCENT.format(c='has_dice_roll')} AS percent FROM m WHERE player IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5""",
    "dice_roll_daily": f"""WITH {M} SELECT campaign_id, CAST(date AS DATE) AS day, count(*) AS messages,
  count(*) FILTER (WHERE has_dice_roll) AS rolls FROM m WHERE date IS NOT NULL GROUP BY 1, 2""",
    "summary_report": f"""WITH {M}, a AS (SELECT campaign_id, player FROM m WHERE player IS NOT NULL GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY campaign_id ORDER BY count(*) DESC, min(turn_idx)) = 1), s AS (
SELECT campaign_id, count(*) AS messages, date_diff('microsecond', min(date), max(date)) // 86400000000 AS days,
  count(DISTINCT player) AS players, count(DISTINCT character) AS characters, {PERCENT.format(c='in_combat')} AS combat_percent,
  {PERCENT.format(c="message_type = 'action'")} AS action_percent, {PERCENT.format(c="message_type = 'dialogue'")} AS dialogue_percent,
  {PERCENT.format(c="message_type = 'narrative'")} AS narrative_percent, sum(word_count) AS words FROM m GROUP BY 1)
SELECT s.*, a.player AS most_active, round(messages / greatest(coalesce(days, 0), 1), 6) AS per_day FROM s LEFT JOIN a USING (campaign_id)""",
    "campaign_bundle": _intervals("campaign_id") + f""", i AS (SELECT campaign_id, round(avg(hours), 6) AS hours_mean,
  round(median(hours), 6) AS hours_median FROM g WHERE hours IS NOT NULL GROUP BY 1), f AS (SELECT campaign_id,
  round(avg(word_count), 6) AS words_mean, round(median(word_count), 6) AS words_median, count(*) AS messages,
  count(DISTINCT player) AS players, {PERCENT.format(c='has_dice_roll')} AS dice_percent FROM m GROUP BY 1)
SELECT f.*, hours_mean, hours_median FROM f LEFT JOIN i USING (campaign_id)""",
    "campaign_sizes": f"WITH {M} SELECT campaign_id, count(*) AS messages FROM m GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "cumulative_posts": f"WITH {M} SELECT campaign_id, message_id, turn_idx + 1 AS posts FROM m",
    "cumulative_posts_by_player": f"""WITH {M}, c AS (SELECT campaign_id, player, CAST(date AS DATE) AS day, count(*) AS n
  FROM m WHERE date IS NOT NULL AND player IS NOT NULL GROUP BY 1, 2, 3), k AS (SELECT campaign_id, player FROM c GROUP BY 1, 2 HAVING sum(n) > 5),
  s AS (SELECT DISTINCT campaign_id, day FROM c)
SELECT s.campaign_id, k.player, s.day, CAST(sum(coalesce(c.n, 0)) OVER (PARTITION BY s.campaign_id, k.player ORDER BY s.day
  ROWS UNBOUNDED PRECEDING) AS BIGINT) AS posts FROM s JOIN k USING (campaign_id)
LEFT JOIN c ON c.campaign_id = s.campaign_id AND c.player = k.player AND c.day = s.day""",
    "unique_players_running": f"""WITH {M}, f AS (SELECT campaign_id, turn_idx,
  CASE WHEN player IS NOT NULL AND row_number() OVER (PARTITION BY campaign_id, player ORDER BY turn_idx) = 1 THEN 1 ELSE 0 END AS p,
  CASE WHEN character IS NOT NULL AND row_number() OVER (PARTITION BY campaign_id, character ORDER BY turn_idx) = 1 THEN 1 ELSE 0 END AS c FROM m)
SELECT campaign_id, turn_idx, CAST(sum(p) OVER w AS BIGINT) AS players, CAST(sum(c) OVER w AS BIGINT) AS characters FROM f
WINDOW w AS (PARTITION BY campaign_id ORDER BY turn_idx ROWS UNBOUNDED PRECEDING)""",
    "min_turns_filter": f"WITH {M} SELECT campaign_id, count(*) AS messages FROM m GROUP BY 1 HAVING count(*) >= 5",
    "block_sessions": f"WITH {M} SELECT campaign_id, message_id, 'session_' || (turn_idx // 5 + 1) AS session FROM m",
    "campaign_gap_sessions": _sessions("campaign_id", "date", "SELECT DISTINCT campaign_id, message_id AS k, date FROM campaign_messages WHERE date IS NOT NULL")
    + " FROM s GROUP BY campaign_id, sid",
    "event_sessions": _sessions("user_id", "ts", "SELECT user_id, event_id AS k, ts FROM events")
    + ", date_diff('microsecond', min(ts), max(ts)) // 1000000 AS duration_seconds FROM s GROUP BY user_id, sid",
    "word_counts": "SELECT row_id, " + ", ".join(
        f"{_WORDS.format(c=c)} AS n_{c}" for c in ("text", "in_character_text", "out_of_character_text", "mixed_text")
    ) + " FROM campaign_messages",
    "dice_flag": f"SELECT row_id, {_DICE} AS has_dice FROM campaign_messages",
    "message_type": f"""SELECT row_id, CASE WHEN {_contains(X.ACTION_WORDS, "lower(coalesce(text, ''))")} OR {_DICE} THEN 'action'
  WHEN {_contains(('"', "'"), "coalesce(text, '')")} THEN 'dialogue' ELSE 'narrative' END AS kind FROM campaign_messages""",
    "primary_label": """SELECT row_id, CASE WHEN g = 0 THEN 'unlabeled' WHEN c.in_character = g THEN 'in-character'
  WHEN c.out_of_character = g THEN 'out-of-character' WHEN c.mixed = g THEN 'mixed' ELSE 'unlabeled' END AS label
FROM (SELECT row_id, label_counts AS c, coalesce(greatest(label_counts.in_character, label_counts.out_of_character,
  label_counts.mixed, label_counts.unlabeled), 0) AS g FROM campaign_messages)""",
    "action_fallback": "SELECT row_id, CASE " + " ".join(
        f"WHEN {_contains(words, 'lower(text)')} THEN '{name}'" for name, words in (
            ("roll", X.ROLL_WORDS), ("dialogue", X.SPEECH_WORDS), ("spells", X.SPELL_WORDS), ("weapon", X.WEAPON_WORDS))
    ) + " END AS action_class FROM campaign_messages",
    "token_estimate": "SELECT row_id, length(text) // 4 AS tokens FROM campaign_messages",
    "provider_route": """SELECT campaign_id, CASE WHEN lower(model) LIKE '%claude%' OR lower(model) LIKE '%anthropic%' THEN 'anthropic'
  WHEN lower(model) LIKE '%gpt%' OR lower(model) LIKE '%openai%' THEN 'openai'
  WHEN lower(model) LIKE '%gemini%' OR lower(model) LIKE '%google%' THEN 'google' ELSE 'anthropic' END AS provider,
  replace(replace('x/' || model, '/', '_'), '.', '-') AS slug FROM campaign_meta WHERE model IS NOT NULL""",
    "player_handles": r"""SELECT lower(regexp_replace(player, '^\s+|\s+$', '', 'g')) AS player, count(*) AS count
FROM campaign_messages WHERE regexp_replace(player, '^\s+|\s+$', '', 'g') <> '' GROUP BY 1""",
}
