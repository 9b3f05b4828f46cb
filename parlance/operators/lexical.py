"""Lexical cohesion by similarity of word sets, inside sessions and across a player's sessions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from parlance.functions.text import vocabulary

#: Sessions of one player are compared in blocks of this many.
BLOCK = 256


def player_words(turns: DataFrame, session_turns: int = 5) -> DataFrame:
    """Distinct words per player and block session: ``campaign_id, session, player, words``.

    Messages without text or player take no part; campaigns with fewer than two players drop out.  A row holds the
    words of at most ``session_turns`` messages.
    """
    rows = turns.where("text IS NOT NULL AND player IS NOT NULL").select(
        "campaign_id", F.floor(F.col("turn_idx") / session_turns).alias("session"), "player", vocabulary(F.col("text")).alias("words")
    )
    sets = rows.groupBy("campaign_id", "session", "player").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"))
    several = sets.groupBy("campaign_id").agg(F.min("player").alias("a"), F.max("player").alias("b")).where("a <> b").select("campaign_id")
    return sets.join(several, "campaign_id", "left_semi")


def session_values(words: DataFrame) -> DataFrame:
    """As :func:`session_jaccard`, not rounded: whole numbers are summed up and divided once."""
    held = words.groupBy("campaign_id", "session").agg(F.collect_list(F.struct("player", "words")).alias("p"))
    others = lambda me: F.flatten(F.transform(F.filter("p", lambda q: q["player"] != me["player"]), lambda q: q["words"]))
    shared = F.aggregate(F.transform("p", lambda me: F.size(F.array_intersect(me["words"], others(me)))), F.lit(0), lambda s, x: s + x)
    union = F.size(F.array_distinct(F.flatten(F.transform("p", lambda q: q["words"]))))
    players = F.size("p")
    value = shared / (F.greatest(union, F.lit(1)) * players)
    return held.where(players >= 2).select("campaign_id", "session", players.cast("long").alias("players"), value.alias("jaccard"))


def session_jaccard(words: DataFrame) -> DataFrame:
    """Each player's words against the others' together, averaged over the players of a session with at least two.

    The union is all words of the session for every player.  A session is a few messages, so its sets are compared
    inside one row; no pairs of rows are formed.
    """
    return session_values(words).withColumn("jaccard", F.round("jaccard", 6))


def vocabulary_sizes(words: DataFrame) -> DataFrame:
    """Distinct words and sessions of each player of a campaign."""
    each = words.select("campaign_id", "player", F.explode("words").alias("word")).groupBy("campaign_id", "player").agg(F.count_distinct("word").alias("v"))
    sessions = words.groupBy("campaign_id", "player").agg(F.count("*").alias("sessions"))
    joined = sessions.join(each, ["campaign_id", "player"], "left")
    return joined.select("campaign_id", "player", F.coalesce("v", F.lit(0)).alias("vocabulary"), "sessions")


def self_jaccard(words: DataFrame) -> DataFrame:
    """Mean similarity of a player's sessions with one another, over all pairs in which both have words.

    The pairs are summed up inside blocks of sessions against blocks of sessions; only sums leave a task.
    """
    sets = words.where(F.size("words") > 0).withColumn("words", F.transform("words", lambda w: F.xxhash64(w)))
    key = F.pmod(F.xxhash64("session"), F.lit(1 << 30))
    count = sets.groupBy("campaign_id", "player").agg(F.count("*").alias("n")).where("n >= 2")
    blocked = sets.join(count, ["campaign_id", "player"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    blocked = blocked.withColumn("b", (key % F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = blocked.withColumn("o", other).withColumn("i", F.least("b", "o")).withColumn("j", F.greatest("b", "o"))
    packed = spread.groupBy("campaign_id", "player", "i", "j").agg(F.collect_list(F.struct("b", "words")).alias("sets"))

    @F.pandas_udf("struct<total double, pairs long>")
    def sums(i: pd.Series, j: pd.Series, held: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, rows in zip(i, j, held, strict=True):
            vocab = {w: n for n, w in enumerate(sorted({w for r in rows for w in r["words"]}))}
            m = np.zeros((len(rows), len(vocab)), dtype=np.float32)
            for n, r in enumerate(rows):
                m[n, [vocab[w] for w in r["words"]]] = 1
            side = np.array([r["b"] for r in rows])
            x, y = (m, m) if a == b else (m[side == a], m[side == b])
            both = (x @ y.T).astype(np.float64)
            value = both / (x.sum(1)[:, None] + y.sum(1)[None, :] - both)
            if a == b:
                upper = np.triu_indices(len(x), 1)
                out.append((float(value[upper].sum()), len(upper[0])))
            else:
                out.append((float(value.sum()), value.size))
        return pd.DataFrame(out, columns=["total", "pairs"])

    scored = packed.select("campaign_id", "player", sums("i", "j", "sets").alias("s"))
    return scored.groupBy("campaign_id", "player").agg(
        F.round(F.sum("s.total") / F.nullif(F.sum("s.pairs"), F.lit(0)), 6).alias("self_jaccard"), F.sum("s.pairs").alias("pairs")
    )
