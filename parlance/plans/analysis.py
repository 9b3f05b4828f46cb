"""Queries of lexical and semantic cohesion, episodes, scenes and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from parlance.functions.text import word_count
from parlance.functions.vectors import cosine
from parlance.operators import basic, episodes as E, lexical as L, semantic as S
from parlance.plans.base import M, messages, stored_turns, turns
from parlance.session import Stage
from parlance.sources.tables import table


def _words(spark: SparkSession, d: str) -> DataFrame:
    return L.player_words(turns(spark, d, "text", "player"))


def jaccard_session(spark: SparkSession, d: str) -> DataFrame:
    return L.session_jaccard(_words(spark, d))


def jaccard_campaign(spark: SparkSession, d: str) -> DataFrame:
    return L.session_values(_words(spark, d)).groupBy("campaign_id").agg(F.count("*").alias("sessions"), F.round(F.avg("jaccard"), 6).alias("jaccard"))


def player_vocab(spark: SparkSession, d: str) -> DataFrame:
    return L.vocabulary_sizes(_words(spark, d))


def player_self_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return L.self_jaccard(_words(spark, d))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as messages: the label is the conversation, four players take turns."""
    rows = table(spark, d, "embeddings").select(
        F.col("label").alias("campaign_id"), "vec_id", (F.col("vec_id") % 4).alias("player"), F.col("embedding").alias("vector")
    )
    return S.as_doubles(S.place_in(rows, ["campaign_id"], "vec_id", "turn_idx"))


def sequential_cohesion(spark: SparkSession, d: str) -> DataFrame:
    back = S.cosine_back(_vectors(spark, d), ["campaign_id"], "turn_idx")
    return back.select("campaign_id", "turn_idx", F.round("cosine", 6).alias("cosine"))


def sequential_cohesion_3(spark: SparkSession, d: str) -> DataFrame:
    back = S.cosine_back(_vectors(spark, d), ["campaign_id"], "turn_idx", 3)
    return back.groupBy("campaign_id").agg(F.round(F.avg("cosine"), 6).alias("mean"), F.count("cosine").alias("n"))


def session_cohesion(spark: SparkSession, d: str) -> DataFrame:
    return S.block_cohesion(_vectors(spark, d), ["campaign_id"], "turn_idx", 5)


def player_sequential(spark: SparkSession, d: str) -> DataFrame:
    own = S.place_in(_vectors(spark, d), ["campaign_id", "player"], "vec_id", "own_idx")
    back = S.cosine_back(own, ["campaign_id", "player"], "own_idx")
    return back.groupBy("campaign_id", "player").agg(F.round(F.avg("cosine"), 6).alias("mean"), F.count("cosine").alias("n"))


def player_chunk_cohesion(spark: SparkSession, d: str) -> DataFrame:
    own = S.place_in(_vectors(spark, d), ["campaign_id", "player"], "vec_id", "own_idx")
    blocks = S.block_cohesion(own, ["campaign_id", "player"], "own_idx", 5)
    return blocks.groupBy("campaign_id", "player").agg(F.round(F.avg("mean"), 5).alias("cohesion"), F.count("*").alias("chunks"))


def vector_diversity(spark: SparkSession, d: str) -> DataFrame:
    return S.diversity(_vectors(spark, d), ["campaign_id"], F.col("vector"))


def diversity_emergence(spark: SparkSession, d: str) -> DataFrame:
    """How much more diverse a conversation is than its players on average."""
    v = _vectors(spark, d)
    own = S.diversity(v, ["campaign_id", "player"], F.col("vector")).groupBy("campaign_id").agg(F.avg("diversity").alias("own"))
    joined = S.diversity(v, ["campaign_id"], F.col("vector")).join(own, "campaign_id")
    return joined.select("campaign_id", F.round(F.col("diversity") - F.col("own"), 5).alias("emergence"))


def rolling_distance(spark: SparkSession, d: str) -> DataFrame:
    back = S.cosine_back(_vectors(spark, d), ["campaign_id"], "turn_idx").withColumn("distance", 1 - F.col("cosine"))
    return basic.rolling_mean(back.where("distance IS NOT NULL"), ["campaign_id"], "turn_idx", "distance").select("campaign_id", "turn_idx", "rolling")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d, "character", "player", "text", "in_combat", "primary_label", "word_count")


def _marks(spark: SparkSession, d: str) -> DataFrame:
    """The order with what the episodes need, stored."""
    return stored_turns(spark, d, "in_combat", "primary_label", "word_count")


def _annotated(t: DataFrame) -> DataFrame:
    """Combat turns stand for the findings of an annotator; their kind and rating follow from the message."""
    kind = F.when(F.col("primary_label") == "in-character", "DRAMATIC").otherwise("PLAYER")
    return t.where("in_combat").select("campaign_id", "turn_idx", kind.alias("type"), (F.col("word_count") % 5 + 1).alias("rate"))


def _episodes(t: DataFrame) -> DataFrame:
    return E.episodes(_annotated(t), F.col("type"), F.col("rate"), "PLAYER", "DRAMATIC")


def extraction_windows(spark: SparkSession, d: str) -> DataFrame:
    return E.windows(messages(spark, d).groupBy("campaign_id").agg(F.count("*").alias("n")))


def dedupe_turns(spark: SparkSession, d: str) -> DataFrame:
    """Findings of overlapping windows, each turn kept as its first window has it."""
    t = _marks(spark, d)
    n = t.groupBy("campaign_id").agg(F.count("*").alias("n"))
    w = E.windows(n, 50, 10).select("campaign_id", "window_start", F.explode(F.sequence("window_start", "window_end")).alias("turn_idx"))
    found = _annotated(t).join(w, ["campaign_id", "turn_idx"]).withColumn("position", F.col("turn_idx") - F.col("window_start"))
    return E.first_found(found).select("campaign_id", "turn_idx", "window_start", "type")


def episodes(spark: SparkSession, d: str) -> DataFrame:
    return _episodes(_turns(spark, d)).select("campaign_id", "start_turn", "end_turn", "turn_count", "rating", "kind")


def episode_first_common(spark: SparkSession, d: str) -> DataFrame:
    return E.first_common(E.islands(_annotated(_turns(spark, d))), "type").groupBy("campaign_id", "type").agg(F.count("*").alias("episodes"))


def episode_participants(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d)
    found = _episodes(t)
    return E.participants(t, found).join(found.select("campaign_id", "episode_no", "start_turn"), ["campaign_id", "episode_no"]).select("campaign_id", "start_turn", "participants")


def episode_text(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d)
    return E.range_text(t, _episodes(t).where("turn_count > 2"), ["start_turn", "end_turn"])


def chunks(spark: SparkSession, d: str) -> DataFrame:
    t = _marks(spark, d)
    return E.chunks(t, _episodes(t), 7)


def chunk_metrics(spark: SparkSession, d: str) -> DataFrame:
    t = _marks(spark, d)
    found = Stage(_episodes(t), "episodes").df
    return E.chunk_figures(E.chunks(t, found, 7), found)


def social_summary(spark: SparkSession, d: str) -> DataFrame:
    t = _marks(spark, d)
    found = Stage(_episodes(t), "episodes").df
    return E.social_summary(found, E.chunk_figures(E.chunks(t, found, 7), found))


def scenes(spark: SparkSession, d: str) -> DataFrame:
    held = Stage(turns(spark, d, "text").select("campaign_id", "turn_idx", word_count(F.col("text")).alias("n")), "scene-words").df
    numbered = E.scenes(held, F.col("n")).join(held.select("campaign_id", "turn_idx", "n"), ["campaign_id", "turn_idx"])
    return numbered.groupBy("campaign_id", "scene_no").agg(F.min("turn_idx").alias("first_turn"), F.count("*").alias("messages"), F.sum("n").alias("words"))


def judge_sessions(spark: SparkSession, d: str) -> DataFrame:
    return E.judge_sessions(_turns(spark, d))


def excerpt_ranges(spark: SparkSession, d: str) -> DataFrame:
    return E.excerpt_ranges(_turns(spark, d))


def opening_run(spark: SparkSession, d: str) -> DataFrame:
    return E.opening_run(_turns(spark, d))


def first_appearance(spark: SparkSession, d: str) -> DataFrame:
    return E.first_appearances(_turns(spark, d))


def summary_schedule(spark: SparkSession, d: str) -> DataFrame:
    return E.summary_schedule(messages(spark, d).groupBy("campaign_id").agg(F.count("*").alias("n")))


def recent_context(spark: SparkSession, d: str) -> DataFrame:
    return E.recent_context(turns(spark, d))


def cosine_scalar(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return v.join(other, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"))


QUERIES = {f.__name__: f for f in (
    jaccard_session, jaccard_campaign, player_vocab, player_self_jaccard, sequential_cohesion, sequential_cohesion_3, session_cohesion,
    player_sequential, player_chunk_cohesion, vector_diversity, diversity_emergence, rolling_distance, extraction_windows, dedupe_turns,
    episodes, episode_first_common, episode_participants, episode_text, chunks, chunk_metrics, social_summary, scenes, judge_sessions,
    excerpt_ranges, opening_run, first_appearance, summary_schedule, recent_context, cosine_scalar,
)}

_W = rf"""WITH {M}, r AS (SELECT campaign_id, turn_idx // 5 AS session, player, list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f\x0B]+'), lambda x: x <> '') AS ws
  FROM m WHERE text IS NOT NULL AND player IS NOT NULL), k AS (SELECT campaign_id FROM r GROUP BY 1 HAVING count(DISTINCT player) >= 2),
s AS (SELECT campaign_id, session, player, list_distinct(flatten(list(ws))) AS ws FROM r JOIN k USING (campaign_id) GROUP BY 1, 2, 3)"""

_PAIRS = f"""{_W}, o AS (SELECT a.campaign_id, a.session, a.player, any_value(a.ws) AS ws, list_distinct(flatten(list(b.ws))) AS rest FROM s a JOIN s b
  ON a.campaign_id = b.campaign_id AND a.session = b.session AND a.player <> b.player GROUP BY 1, 2, 3),
q AS (SELECT campaign_id, session, count(*) AS players, CAST(sum(len(list_intersect(ws, rest))) AS DOUBLE)
  / (greatest(max(len(list_distinct(list_concat(ws, rest)))), 1) * count(*)) AS jaccard FROM o GROUP BY 1, 2)"""

_V = """WITH v AS (SELECT label AS campaign_id, vec_id, vec_id % 4 AS player, CAST(embedding AS DOUBLE[]) AS x,
  row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS turn_idx, row_number() OVER (PARTITION BY label, vec_id % 4 ORDER BY vec_id) - 1 AS own_idx FROM embeddings)"""
_LAG = "list_cosine_similarity(x, lag(x, {w}) OVER (PARTITION BY {k} ORDER BY {o}))"
_BLOCK = """p AS (SELECT {k}, block, list_cosine_similarity(a.x, b.x) AS c FROM (SELECT *, {o} // 5 AS block FROM v) a
  JOIN (SELECT *, {o} // 5 AS block FROM v) b USING ({k}, block) WHERE a.{o} < b.{o})"""

_A = f"""WITH RECURSIVE {M}, n AS (SELECT campaign_id, count(*) AS n FROM m GROUP BY 1),
a AS (SELECT campaign_id, turn_idx, CASE WHEN primary_label = 'in-character' THEN 'DRAMATIC' ELSE 'PLAYER' END AS type, word_count % 5 + 1 AS rate FROM m WHERE in_combat),
i AS (SELECT *, sum(f) OVER (PARTITION BY campaign_id ORDER BY turn_idx ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN turn_idx - lag(turn_idx) OVER (PARTITION BY campaign_id ORDER BY turn_idx) <= 1 THEN 0 ELSE 1 END AS f FROM a)),
e AS (SELECT campaign_id, min(turn_idx) AS start_turn, max(turn_idx) AS end_turn, max(turn_idx) - min(turn_idx) + 1 AS turn_count, round(avg(rate), 6) AS rating,
  CASE WHEN count(*) FILTER (WHERE type = 'DRAMATIC') > count(*) FILTER (WHERE type = 'PLAYER') THEN 'DRAMATIC' ELSE 'PLAYER' END AS kind FROM i GROUP BY campaign_id, island)"""
_C = f"""{_A}, walk AS (SELECT campaign_id, 0 AS chunk_no, CAST(0 AS BIGINT) AS s, (SELECT least(n, greatest(least(7, n), coalesce(max(end_turn) + 1, 0)))
    FROM e WHERE e.campaign_id = n.campaign_id AND start_turn < least(7, n) AND end_turn >= least(7, n)) AS t FROM n
  UNION ALL SELECT w.campaign_id, w.chunk_no + 1, w.t, (SELECT least(n, greatest(least(w.t + 7, n), coalesce(max(end_turn) + 1, 0)))
    FROM e WHERE e.campaign_id = w.campaign_id AND start_turn < least(w.t + 7, n) AND end_turn >= least(w.t + 7, n))
  FROM walk w JOIN n USING (campaign_id) WHERE w.t < n.n),
c AS (SELECT campaign_id, chunk_no, s AS start, t AS "end" FROM walk)"""
_F = f"""{_C}, h AS (SELECT campaign_id, chunk_no, count(*) AS episodes, sum(least(end_turn + 1, "end") - greatest(start_turn, start)) AS turns, avg(rating) AS r
  FROM c JOIN e USING (campaign_id) WHERE start_turn < "end" AND end_turn >= start GROUP BY 1, 2),
f AS (SELECT campaign_id, chunk_no, start, "end", coalesce(episodes, 0) AS episodes, coalesce(turns, 0) AS turns,
  round(coalesce(turns, 0) / ("end" - start), 6) AS proportion, round(coalesce(r, 0.0), 6) AS mean_rating FROM c LEFT JOIN h USING (campaign_id, chunk_no))"""

SQL = {
    "jaccard_session": _PAIRS + " SELECT * REPLACE (round(jaccard, 6) AS jaccard) FROM q",
    "jaccard_campaign": _PAIRS + " SELECT campaign_id, count(*) AS sessions, round(avg(jaccard), 6) AS jaccard FROM q GROUP BY 1",
    "player_vocab": _W + " SELECT campaign_id, player, len(list_distinct(flatten(list(ws)))) AS vocabulary, count(*) AS sessions FROM s GROUP BY 1, 2",
    "player_self_jaccard": _W + """, z AS (SELECT * FROM s WHERE len(ws) > 0)
SELECT a.campaign_id, a.player, round(avg(len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws)))), 6) AS self_jaccard, count(*) AS pairs
FROM z a JOIN z b ON a.campaign_id = b.campaign_id AND a.player = b.player AND a.session < b.session GROUP BY 1, 2""",
    "sequential_cohesion": _V + f" SELECT campaign_id, turn_idx, round({_LAG.format(w=1, k='campaign_id', o='turn_idx')}, 6) AS cosine FROM v",
    "sequential_cohesion_3": _V + f", l AS (SELECT campaign_id, {_LAG.format(w=3, k='campaign_id', o='turn_idx')} AS c FROM v) SELECT campaign_id, round(avg(c), 6) AS mean, count(c) AS n FROM l GROUP BY 1",
    "session_cohesion": _V + "," + _BLOCK.format(k="campaign_id", o="turn_idx") + """, z AS (SELECT campaign_id, turn_idx // 5 AS block, count(*) AS posts FROM v GROUP BY 1, 2)
SELECT campaign_id, block, round(avg(c), 6) AS mean, round(median(c), 6) AS median, round(min(c), 6) AS least, round(stddev_pop(c), 6) AS deviation,
  count(*) AS comparisons, any_value(posts) AS posts FROM p JOIN z USING (campaign_id, block) GROUP BY 1, 2""",
    "player_sequential": _V + f", l AS (SELECT campaign_id, player, {_LAG.format(w=1, k='campaign_id, player', o='own_idx')} AS c FROM v) SELECT campaign_id, player, round(avg(c), 6) AS mean, count(c) AS n FROM l GROUP BY 1, 2",
    "player_chunk_cohesion": _V + "," + _BLOCK.format(k="campaign_id, player", o="own_idx") + """, z AS (SELECT campaign_id, player, block, round(avg(c), 6) AS mean FROM p GROUP BY 1, 2, 3)
SELECT campaign_id, player, round(avg(mean), 5) AS cohesion, count(*) AS chunks FROM z GROUP BY 1, 2""",
    "vector_diversity": _V + """ SELECT a.campaign_id, any_value(n.n) AS vectors, round(avg(1 - list_cosine_similarity(a.x, b.x)), 6) AS diversity
FROM v a JOIN v b ON a.campaign_id = b.campaign_id AND a.turn_idx < b.turn_idx JOIN (SELECT campaign_id, count(*) AS n FROM v GROUP BY 1) n ON n.campaign_id = a.campaign_id GROUP BY 1""",
    "diversity_emergence": _V + """, t AS (SELECT a.campaign_id, round(avg(1 - list_cosine_similarity(a.x, b.x)), 6) AS whole FROM v a JOIN v b ON a.campaign_id = b.campaign_id AND a.turn_idx < b.turn_idx GROUP BY 1),
o AS (SELECT a.campaign_id, a.player, round(avg(1 - list_cosine_similarity(a.x, b.x)), 6) AS own FROM v a JOIN v b ON a.campaign_id = b.campaign_id AND a.player = b.player AND a.turn_idx < b.turn_idx GROUP BY 1, 2)
SELECT campaign_id, round(any_value(whole) - avg(own), 5) AS emergence FROM t JOIN o USING (campaign_id) GROUP BY 1""",
    "rolling_distance": _V + f""", l AS (SELECT campaign_id, turn_idx, 1 - {_LAG.format(w=1, k='campaign_id', o='turn_idx')} AS x FROM v)
SELECT campaign_id, turn_idx, CASE WHEN count(*) OVER w = 10 THEN round(avg(x) OVER w, 6) END AS rolling FROM l WHERE x IS NOT NULL
WINDOW w AS (PARTITION BY campaign_id ORDER BY turn_idx ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)""",
    "extraction_windows": f"""WITH {M}, n AS (SELECT campaign_id, count(*) AS n FROM m GROUP BY 1),
s AS (SELECT campaign_id, n, unnest(CASE WHEN n <= 500 THEN [0] ELSE range(0, n, 400) END) AS window_start FROM n)
SELECT campaign_id, window_start, least(window_start + 499, n - 1) AS window_end FROM s""",
    "dedupe_turns": _A + """, s AS (SELECT campaign_id, n, unnest(CASE WHEN n <= 50 THEN [0] ELSE range(0, n, 40) END) AS window_start FROM n)
SELECT campaign_id, turn_idx, min(window_start) AS window_start, any_value(type) AS type FROM a JOIN s USING (campaign_id)
WHERE turn_idx BETWEEN window_start AND least(window_start + 49, n - 1) GROUP BY 1, 2""",
    "episodes": _A + " SELECT campaign_id, start_turn, end_turn, turn_count, rating, kind FROM e",
    "episode_first_common": _A + """, k AS (SELECT campaign_id, island, type FROM i GROUP BY 1, 2, 3
  QUALIFY row_number() OVER (PARTITION BY campaign_id, island ORDER BY count(*) DESC, min(turn_idx)) = 1) SELECT campaign_id, type, count(*) AS episodes FROM k GROUP BY 1, 2""",
    "episode_participants": _A + """ SELECT e.campaign_id, start_turn, array_to_string(list_sort(list(DISTINCT coalesce(character, player))), '|') AS participants
FROM e JOIN m ON m.campaign_id = e.campaign_id AND turn_idx BETWEEN start_turn AND end_turn WHERE coalesce(character, player) IS NOT NULL GROUP BY 1, 2""",
    "episode_text": _A + """ SELECT e.campaign_id, start_turn, end_turn, string_agg('Turn ' || turn_idx || ' - ' || coalesce(character, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn_idx) AS text
FROM e JOIN m ON m.campaign_id = e.campaign_id AND turn_idx BETWEEN start_turn AND end_turn WHERE turn_count > 2 GROUP BY 1, 2, 3""",
    "chunks": _C + " SELECT * FROM c",
    "chunk_metrics": _F + " SELECT * FROM f",
    "social_summary": _F + """, a1 AS (SELECT campaign_id, count(*) AS chunks, round(avg(proportion), 4) AS mean_proportion FROM f GROUP BY 1),
a2 AS (SELECT campaign_id, count(*) AS episodes, sum(turn_count) AS turns, round(avg(rating), 6) AS mean_rating FROM e GROUP BY 1)
SELECT campaign_id, chunks, mean_proportion, coalesce(episodes, 0) AS episodes, coalesce(turns, 0) AS turns, coalesce(mean_rating, 0.0) AS mean_rating FROM a1 LEFT JOIN a2 USING (campaign_id)""",
    "scenes": rf"""WITH RECURSIVE {M}, w AS (SELECT campaign_id, turn_idx, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f\x0B]+'), lambda x: x <> '')) AS n FROM m),
f AS (SELECT campaign_id, turn_idx, n, n AS acc, 0 AS scene_no FROM w WHERE turn_idx = 0
  UNION ALL SELECT w.campaign_id, w.turn_idx, w.n, CASE WHEN f.acc + w.n > 175 THEN w.n ELSE f.acc + w.n END, f.scene_no + CASE WHEN f.acc + w.n > 175 THEN 1 ELSE 0 END
  FROM f JOIN w ON w.campaign_id = f.campaign_id AND w.turn_idx = f.turn_idx + 1)
SELECT campaign_id, scene_no, min(turn_idx) AS first_turn, count(*) AS messages, sum(n) AS words FROM f GROUP BY 1, 2""",
    "judge_sessions": f"""WITH {M} SELECT campaign_id, turn_idx // 20 AS block, count(*) AS messages, array_to_string(list_sort(list(DISTINCT character) FILTER (WHERE character IS NOT NULL)), '|') AS characters,
  array_to_string(list_sort(list(DISTINCT player) FILTER (WHERE player IS NOT NULL)), '|') AS players, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn_idx) AS text FROM m GROUP BY 1, 2""",
    "opening_run": f"""WITH {M}, o AS (SELECT campaign_id, min(turn_idx) AS stop FROM m WHERE NOT coalesce(character = 'Dungeon Master', false) GROUP BY 1)
SELECT campaign_id, turn_idx FROM m LEFT JOIN o USING (campaign_id) WHERE stop IS NULL OR turn_idx < stop""",
    "first_appearance": f"WITH {M} SELECT campaign_id, character, min(turn_idx) AS first_turn FROM m WHERE character IS NOT NULL GROUP BY 1, 2",
    "excerpt_ranges": f"""WITH RECURSIVE {M}, l AS (SELECT campaign_id, max(turn_idx) AS last FROM m GROUP BY 1),
r AS (SELECT campaign_id, 0 AS s, least(99, last) AS e, 'Campaign Start' AS label, -1 AS o FROM l
  UNION ALL SELECT campaign_id, greatest(0, f - 10), least(f + 50, last), 'Introduction of ' || character, f
  FROM (SELECT campaign_id, character, min(turn_idx) AS f FROM m WHERE character IS NOT NULL AND character <> 'Dungeon Master' GROUP BY 1, 2) JOIN l USING (campaign_id) WHERE f >= 100),
x AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY s, o, label) AS k FROM r),
g AS (SELECT campaign_id, k, s, e, label, s AS s0, 1 AS grp FROM x WHERE k = 1
  UNION ALL SELECT x.campaign_id, x.k, x.s, CASE WHEN x.s <= g.e + 1 THEN greatest(x.e, g.e) ELSE x.e END,
    CASE WHEN x.s > g.e + 1 THEN x.label WHEN contains(g.label, x.label) THEN g.label ELSE g.label || ', ' || x.label END,
    CASE WHEN x.s <= g.e + 1 THEN g.s0 ELSE x.s END, g.grp + CASE WHEN x.s <= g.e + 1 THEN 0 ELSE 1 END
  FROM g JOIN x ON x.campaign_id = g.campaign_id AND x.k = g.k + 1)
SELECT campaign_id, s0 AS start_turn, e AS end_turn, label FROM g QUALIFY row_number() OVER (PARTITION BY campaign_id, grp ORDER BY k DESC) = 1""",
    "summary_schedule": f"""WITH {M}, n AS (SELECT campaign_id, count(*) AS n FROM m GROUP BY 1), k AS (SELECT campaign_id, unnest(range(0, (n - 50) // 50)) AS k FROM n WHERE n >= 100)
SELECT campaign_id, k, k * 50 AS chunk_start, k * 50 + 49 AS chunk_end, (k + 1) * 50 + 50 AS due_turn FROM k""",
    "recent_context": f"WITH {M}, n AS (SELECT campaign_id, count(*) AS n FROM m GROUP BY 1) SELECT campaign_id, turn_idx FROM m JOIN n USING (campaign_id) WHERE turn_idx >= greatest(0, n - 50)",
    "cosine_scalar": "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
}
