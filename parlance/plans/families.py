"""Queries of the annotator families and of stored answers and vectors, with an offline annotator that SQL can follow."""

from __future__ import annotations

import re
import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from parlance.config import DEFAULTS
from parlance.operators import corrections as C, families as Fa, models as Mo, profiles as Pr, simulation as G
from parlance.plans.base import M, messages, stored_turns
from parlance.session import Stage, shared_folder
from parlance.sources import campaigns as S
from parlance.sources.tables import table

#: What the offline annotator takes for a finding of each family.
KEYWORDS = {"humor": "amused", "conflict": "attacks", "cooperation": "waits", "norms": "must", "collab_creativity": "owe"}
NORMS = ("silence", "sharing", "courtesy")


class OfflineAnnotator:
    """Answers every request of a family by rules: findings by a keyword, kinds and norms by the turn's number, ratings by
    the episode's length.  A stand-in that keeps to the protocols, no judge of texts."""

    def __init__(self, family: Fa.Family):
        self.family, self.keyword = family, KEYWORDS[family.name]

    def _mark(self, n: int) -> str:
        if self.family.form == "typed":
            return f" [{self.family.kinds[n % 2]}]"
        return f" [{Fa.NORM_KINDS[n % 4]}]" if self.family.form == "norms" else ""

    def _one(self, prompt: str) -> str:
        parts = Mo.KeywordAnnotator.HEADING.split(prompt)[1:]
        numbers = [int(n) for n in parts[::2]]
        if prompt.startswith("List the turns"):
            texts = [b.partition(": ")[2] for b in parts[1::2]]
            hits = [f"TURN {n}{self._mark(n)}: {' '.join(t.split())}" for n, t in zip(numbers, texts, strict=True) if self.keyword in t.lower()]
            return "\n".join(hits) or self.family.none
        if prompt.startswith("Answer TURN"):
            return "\n".join(f"TURN {n}: {self.family.kinds[1]}" for n in map(int, re.findall(r"(?m)^TURN (\d+): ", prompt)) if n % 3 == 0)
        if prompt.startswith("Rate"):
            return f"{self.family.rating}: {len(numbers) % 5 + 1}"
        n = numbers[0]
        kind = [f"Type: {Fa.NORM_KINDS[n % 4]}"] if n % 3 else []
        return "\n".join([*kind, f"Explicit: {'YES' if n % 2 else 'NO'}", f"Norm: {NORMS[n % len(NORMS)]}", f"Description: at turn {n}"])

    def answer(self, prompts: list[str]) -> list[str]:
        return [self._one(p) for p in prompts]


def _findings(spark: SparkSession, d: str, name: str, stored: DataFrame | None = None) -> Fa.Findings:
    family = Fa.FAMILIES[name]
    return Fa.analyze(stored_turns(spark, d, "player", "character", "text"), family, partial(OfflineAnnotator, family), stored=stored)


def _episodes(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        kept = [c for c in Fa.episode_columns(Fa.FAMILIES[name])]
        return _findings(spark, d, name).episodes.select(*kept).drop(*(() if name == "norms" else ("description",)))

    query.__name__, query.__doc__ = f"{name}_episodes", f"Episodes of {name.replace('_', ' ')} with participants and what was asked about them."
    return query


def _summary(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _findings(spark, d, name).summary

    query.__name__, query.__doc__ = f"{name}_summary", f"One row of {name.replace('_', ' ')} per campaign."
    return query


def norms_linked(spark: SparkSession, d: str) -> DataFrame:
    """Norms of each campaign with their episodes by type."""
    return _findings(spark, d, "norms").norms.drop("norm_id")


def answers_reused(spark: SparkSession, d: str) -> DataFrame:
    """Conflict turns found from stored answers alone: the annotator of the second run has none to give."""
    family = Fa.FAMILIES["conflict"]
    t = stored_turns(spark, d, "player", "character", "text")
    from parlance.operators import episodes as E

    windows = E.windows(t.groupBy("campaign_id").agg(F.count("*").alias("n")))
    requests = Stage(Mo.extraction_requests(t, windows, family.request), "requests").df
    first = Stage(Mo.annotate(requests, "prompt", partial(OfflineAnnotator, family), "conflict").select("request_key", "response"), "answers-kept").df
    again = Mo.annotate(requests, "prompt", _Silent, "conflict", stored=first)
    return Fa.found_turns(again.drop("prompt", "request_key"), family).select("campaign_id", "turn_idx", "type")


class _Silent:
    """An annotator that must not be asked."""

    def answer(self, prompts: list[str]) -> list[str]:
        raise RuntimeError("a stored answer was not used")


def embeddings_cached(spark: SparkSession, d: str) -> DataFrame:
    """Vectors by way of the cache, in two runs: the second encodes only what the first has not."""
    folder = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    t = table(spark, d, "campaign_messages").select("row_id", "text")
    Mo.embed_cached(t.where("row_id % 2 = 0"), "text", "offline", folder)
    return Mo.embed_cached(t, "text", "offline", folder).select("row_id", vector_text(F.col("vector")).alias("vector"))


def vector_text(vector) -> F.Column:
    """A vector's components in millionths, as text, for comparing whole vectors."""
    return F.array_join(F.transform(vector, lambda x: F.round(x.cast("double") * 1_000_000).cast("long").cast("string")), ",")


class _Resolver:
    """An annotator that gives every player of a shared character a name of their own."""

    def answer(self, prompts: list[str]) -> list[str]:
        return ["\n".join(f"{who}: {p.partition(chr(10))[0]} of {who}" for who in p.split("\n")[1:]) for p in prompts]


def conflicts_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Messages after hand-made and model corrections: a character of several players is split by player."""
    t = Stage(C.corrected(messages(spark, d, "player", "character"), table(spark, d, "name_corrections")), "corrected").df
    return C.resolved(t, C.proposed(C.name_conflicts(t), _Resolver)).select("campaign_id", "message_id", "character")


class _Profiler:
    """An annotator that describes everyone by the length of the name."""

    def answer(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            names = p.partition("\nNames:\n")[2].partition("\n\n")[0].split("\n")
            sheet = p.startswith(Pr.REQUESTS["sheet"])
            out.append("\n".join(f"{n}:\nLevel: {len(n)}\nLanguages: common, {len(n)}" if sheet else f"{i}. **{n}**: {len(n)} letters" for i, n in enumerate(names, 1)))
        return out


def character_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions and sheets of the characters and personalities of the players of every campaign, from excerpts."""
    t = stored_turns(spark, d, "player", "character", "text")
    out = None
    for kind in Pr.REQUESTS:
        one = Pr.profiles(t, kind, _Profiler).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("campaign_id", "kind", "field").agg(F.count("*").alias("names"))


def games_logged(spark: SparkSession, d: str) -> DataFrame:
    """Played games written turn by turn as conversation messages, read again and flattened; the newest load of a turn counts."""
    folder = f"{shared_folder(spark)}/games-{uuid.uuid4().hex}"
    meta = table(spark, d, "campaign_meta").where("model IS NOT NULL")
    games = meta.select(
        F.col("campaign_id").alias("game_id"), F.lit("Play.").alias("system"), F.lit("It begins.").alias("scenario"),
        F.array(F.lit("Ann"), F.lit("Bo")).alias("characters"), F.lit(6).alias("turns"),
    )
    played = Stage(G.play(games, _Counter, chunk=4, verbatim=4), "games").df
    G.save_log(played.where("turn_idx < 4"), folder)
    G.save_log(played.where("turn_idx >= 2"), folder)
    return S.flatten(G.read_log(spark, folder)).groupBy("campaign_id").agg(F.count("*").alias("turns"), F.max("message_id").alias("last_turn"))


class _Counter:
    """An annotator that answers with the number of lines it was shown."""

    def answer(self, prompts: list[str]) -> list[str]:
        return [f"after {p.count(chr(10))} lines" for p in prompts]


QUERIES = {q.__name__: q for q in (
    *(make(name) for name in Fa.FAMILIES for make in (_episodes, _summary)), norms_linked, answers_reused, embeddings_cached, conflicts_resolved, character_profiles,
    games_logged,
)}

_SIZE = DEFAULTS.chunk_turns


def _found(name: str) -> str:
    """CTEs ``e`` (episodes) and ``n`` (lengths) of a family under the offline annotator's rules."""
    family = Fa.FAMILIES[name]
    if family.form == "norms":
        kind = "CASE " + " ".join(f"WHEN turn_idx % 4 = {i} THEN '{k}'" for i, k in enumerate(Fa.NORM_KINDS)) + " END"
    else:
        kind = f"CASE WHEN turn_idx % {3 if family.form == 'list' else 2} = {0 if family.form == 'list' else 1} THEN '{(family.kinds or ('', ''))[1]}' ELSE '{(family.kinds or ('', ''))[0]}' END"
    if family.form == "norms":
        hint = "(SELECT type FROM g h WHERE h.campaign_id = g.campaign_id AND h.isl = g.isl GROUP BY type ORDER BY count(*) DESC, min(turn_idx) LIMIT 1)"
        asked = "CASE " + " ".join(f"WHEN min(turn_idx) % 3 <> 0 AND min(turn_idx) % 4 = {i} THEN '{k}'" for i, k in enumerate(Fa.NORM_KINDS)) + f" ELSE {hint} END AS episode_type"
        norm = "CASE " + " ".join(f"WHEN min(turn_idx) % {len(NORMS)} = {i} THEN '{k}'" for i, k in enumerate(NORMS)) + " END AS description"
        columns = f"{asked}, min(turn_idx) % 2 = 1 AS is_explicit, {norm}, 0.0 AS rating"
    else:
        vote = f"CASE WHEN count(*) FILTER (WHERE type = '{family.kinds[1]}') > count(*) FILTER (WHERE type = '{family.kinds[0]}') THEN '{family.kinds[1]}' ELSE '{family.kinds[0]}' END AS kind, " if family.kinds else ""
        columns = f"{vote}CAST(count(*) % 5 + 1 AS DOUBLE) AS rating"
    return f"""WITH RECURSIVE {M}, n AS (SELECT campaign_id, count(*) AS n FROM m GROUP BY 1),
a AS (SELECT campaign_id, turn_idx, {kind} AS type FROM m WHERE contains(lower(text), '{KEYWORDS[name]}')),
g AS (SELECT *, turn_idx - row_number() OVER (PARTITION BY campaign_id ORDER BY turn_idx) AS isl FROM a),
e AS (SELECT campaign_id, min(turn_idx) AS start_turn, max(turn_idx) AS end_turn, count(*) AS turn_count, {columns} FROM g GROUP BY campaign_id, isl),
w AS (SELECT e.campaign_id, start_turn, string_agg(DISTINCT coalesce(character, player), '|' ORDER BY coalesce(character, player)) AS participants
  FROM e JOIN m ON m.campaign_id = e.campaign_id AND turn_idx BETWEEN start_turn AND end_turn GROUP BY 1, 2)"""


def _chunked(name: str) -> str:
    return _found(name) + f""", walk AS (SELECT campaign_id, CAST(0 AS BIGINT) AS s, (SELECT least(n, greatest(least({_SIZE}, n), coalesce(max(end_turn) + 1, 0)))
    FROM e WHERE e.campaign_id = n.campaign_id AND start_turn < least({_SIZE}, n) AND end_turn >= least({_SIZE}, n)) AS t FROM n
  UNION ALL SELECT k.campaign_id, k.t, (SELECT least(n, greatest(least(k.t + {_SIZE}, n), coalesce(max(end_turn) + 1, 0)))
    FROM e WHERE e.campaign_id = k.campaign_id AND start_turn < least(k.t + {_SIZE}, n) AND end_turn >= least(k.t + {_SIZE}, n))
  FROM walk k JOIN n USING (campaign_id) WHERE k.t < n.n),
h AS (SELECT walk.campaign_id, s, t, coalesce(sum(CASE WHEN end_turn IS NOT NULL THEN least(end_turn + 1, t) - greatest(start_turn, s) END), 0) / (t - s) AS share
  FROM walk LEFT JOIN e ON e.campaign_id = walk.campaign_id AND start_turn < t AND end_turn >= s GROUP BY 1, 2, 3),
c AS (SELECT campaign_id, count(*) AS chunks, round(avg(share), 6) AS mean_proportion FROM h GROUP BY 1)"""


def _sql(name: str) -> dict[str, str]:
    family = Fa.FAMILIES[name]
    norms = family.form == "norms"
    own = "episode_type, is_explicit, description" if norms else ("kind, " if family.kinds else "") + "rating"
    number = ", 'norm_' || CAST(dense_rank() OVER (PARTITION BY campaign_id ORDER BY lead_turn) AS VARCHAR) AS norm_id" if norms else ""
    source = "(SELECT *, min(start_turn) OVER (PARTITION BY campaign_id, description) AS lead_turn FROM e)" if norms else "e"
    kinds = Fa.NORM_KINDS if norms else family.kinds or ()
    count = ", ".join(f"count(*) FILTER (WHERE {'episode_type' if norms else 'kind'} = '{k}') AS n_{k.lower()}" for k in kinds)
    last = "count(DISTINCT description) AS norms" if norms else "round(avg(rating), 6) AS mean_rating"
    names = [f"n_{k.lower()}" for k in kinds] + (["norms"] if norms else ["mean_rating"])
    return {
        f"{name}_episodes": _found(name) + f" SELECT campaign_id, start_turn, end_turn, turn_count, participants, {own}{number} FROM {source} LEFT JOIN w USING (campaign_id, start_turn)",
        f"{name}_summary": _chunked(name) + f""", r AS (SELECT campaign_id, count(*) AS episodes, {count + ', ' if count else ''}{last} FROM e GROUP BY 1)
SELECT c.*, coalesce(episodes, 0) AS episodes, {', '.join(f'coalesce({x}, 0) AS {x}' for x in names)} FROM c LEFT JOIN r USING (campaign_id)""",
    }


#: The offline encoder: signed counts of words by the first digits of their MD5 sum, scaled to unit length.
def vectors_sql(source: str) -> str:
    """SQL of ``row_id, vector`` for the texts of ``source(row_id, text)``."""
    return rf"""WITH src AS ({source}),
t AS (SELECT row_id, CASE WHEN regexp_full_match(coalesce(text, ''), '[\s\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}]*') THEN '[EMPTY]' ELSE text END AS text FROM src),
w AS (SELECT row_id, unnest(list_filter(regexp_split_to_array(lower(text), '[\s\v\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+'), lambda x: x <> '')) AS w FROM t),
b AS (SELECT row_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h FROM w),
s AS (SELECT row_id, h % 64 AS i, CAST(sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS DOUBLE) AS x FROM b GROUP BY 1, 2),
z AS (SELECT row_id, sqrt(sum(x * x)) AS z FROM s GROUP BY 1),
v AS (SELECT t.row_id, k AS i, CAST(coalesce(CASE WHEN z = 0 THEN x ELSE x / z END, 0) AS FLOAT) AS x
  FROM (SELECT row_id, unnest(range(64)) AS k FROM t) t LEFT JOIN s ON s.row_id = t.row_id AND s.i = k LEFT JOIN z ON z.row_id = t.row_id)
SELECT row_id, string_agg(CAST(CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY i) AS vector FROM v GROUP BY 1"""


VECTOR_SQL = vectors_sql("SELECT row_id, text FROM campaign_messages")

_CORRECTED = f"""{M}, o AS (SELECT campaign_id, old_name, min(new_name) AS new_name FROM name_corrections GROUP BY 1, 2),
x AS (SELECT m.campaign_id, message_id, player, coalesce(new_name, character) AS character FROM m LEFT JOIN o ON o.campaign_id = m.campaign_id AND o.old_name = m.character),
one AS (SELECT campaign_id, character FROM x WHERE character IS NOT NULL AND character NOT IN ('', 'Dungeon Master') GROUP BY 1, 2 HAVING count(*) = 1),
y AS (SELECT x.* FROM x LEFT JOIN one USING (campaign_id, character) WHERE one.character IS NULL),
u AS (SELECT campaign_id, character FROM y WHERE character IS NOT NULL AND character <> 'Dungeon Master' AND player IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT player) > 1)"""

SQL = {k: q for name in Fa.FAMILIES for k, q in _sql(name).items()} | {
    "norms_linked": _found("norms") + """ SELECT campaign_id, description, count(*) AS episodes, bool_or(is_explicit) AS is_explicit, """
    + ", ".join(f"count(*) FILTER (WHERE episode_type = '{k}') AS times_{n}" for k, n in (("establishing", "established"), ("following", "followed"), ("violating", "violated"), ("enforcing", "enforced")))
    + " FROM e GROUP BY campaign_id, description",
    "answers_reused": f"WITH {M} SELECT campaign_id, turn_idx, CASE WHEN turn_idx % 2 = 1 THEN 'DRAMATIC' ELSE 'PLAYER' END AS type FROM m WHERE contains(lower(text), 'attacks')",
    "embeddings_cached": VECTOR_SQL,
    "character_profiles": f"""WITH {M}, c AS (SELECT DISTINCT campaign_id, character AS name FROM m WHERE character IS NOT NULL), p AS (SELECT DISTINCT campaign_id, lower(regexp_replace(player, '^\\s+|\\s+$', '', 'g')) AS name FROM m WHERE regexp_replace(player, '^\\s+|\\s+$', '', 'g') <> ''),
k AS (SELECT DISTINCT campaign_id, lower(trim(name)) AS name, 'description' AS kind, 'description' AS field FROM c WHERE trim(name) <> '' UNION ALL SELECT *, 'personality', 'personality' FROM p
  UNION ALL SELECT *, 'sheet', 'Level' FROM c UNION ALL SELECT *, 'sheet', 'Languages' FROM c)
SELECT campaign_id, kind, field, count(*) AS names FROM k GROUP BY 1, 2, 3""",
    "games_logged": "SELECT campaign_id, 6 AS turns, 5 AS last_turn FROM campaign_meta WHERE model IS NOT NULL",
    "conflicts_resolved": f"""WITH {_CORRECTED} SELECT y.campaign_id, message_id, CASE WHEN u.character IS NOT NULL AND player IS NOT NULL THEN trim(y.character || ' of ' || player) ELSE y.character END AS character
FROM y LEFT JOIN u USING (campaign_id, character)""",
}
