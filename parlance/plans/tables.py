"""Queries of results, categories, histograms, corrections, JSON flattening, parsers, models, simulation and streams."""

from __future__ import annotations

import json
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from parlance.functions.text import ROLL_WORDS, SPEECH_WORDS, SPELL_WORDS, WEAPON_WORDS, action_class, python_bool
from parlance.operators import basic, corrections as C, episodes as E, models as Mo, parsers as P, results as R, semantic as Se, simulation as G
from parlance.operators.shred import actions_table, clean_label, messages_table, paragraphs_table
from parlance.plans import analysis as An
from parlance.plans.base import M, messages, turns
from parlance.plans.basic import _sessions
from parlance.plans.families import VECTOR_SQL, vector_text, vectors_sql
from parlance.plans.records import ACTIONS, LABEL, PARAGRAPHS
from parlance.session import Stage, shared_folder
from parlance.sources import campaigns as S
from parlance.sources.tables import table
from parlance.streaming import sessions as Z


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d, "player", "character", "text", "word_count", "has_dice_roll", "message_type", "gender", "race", "class")


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d, "date", "player", "character", "word_count", "message_type")


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).groupBy("campaign_id").agg(F.count("*").alias("messages"), F.round(F.avg("word_count"), 6).alias("words"))


def _categories(spark: SparkSession, d: str) -> DataFrame:
    meta = table(spark, d, "campaign_meta")
    return R.categories(meta.select("campaign_id"), meta)


def campaign_categories(spark: SparkSession, d: str) -> DataFrame:
    return _categories(spark, d)


def category_pool(spark: SparkSession, d: str) -> DataFrame:
    return R.pool(_sizes(spark, d), _categories(spark, d), "words")


def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    meta = table(spark, d, "campaign_meta").where(F.col("temperature").isin(0.7, 1.0) & F.col("scratchpad").eqNullSafe(F.lit(False)))
    return messages(spark, d).join(meta.select("campaign_id"), "campaign_id", "left_semi").groupBy("campaign_id").agg(F.count("*").alias("messages"))


def histogram_linear(spark: SparkSession, d: str) -> DataFrame:
    return R.histogram(table(spark, d, "campaign_messages"), F.col("word_count"), 20)


def histogram_log(spark: SparkSession, d: str) -> DataFrame:
    return R.histogram(_sizes(spark, d), F.col("messages"), 12, log=True)


def histogram_by_category(spark: SparkSession, d: str) -> DataFrame:
    return R.histogram(_sizes(spark, d).join(_categories(spark, d), "campaign_id"), F.col("words"), 10, group=["category"])


def novelty_panels(spark: SparkSession, d: str) -> DataFrame:
    """Twenty bins, as a histogram with a given number of bins has."""
    return R.histogram(_sizes(spark, d), F.col("words"), 21)


def metric_correlation(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d)
    m = t.groupBy("campaign_id").agg(
        F.count("*").alias("messages"), F.avg("word_count").alias("words"), F.avg(F.col("has_dice_roll").cast("int")).alias("dice"),
        F.count_distinct("player").alias("players"),
    ).join(basic.intervals(t, ["campaign_id"]).groupBy("campaign_id").agg(F.avg("hours").alias("hours")), "campaign_id", "left")
    return R.correlations(m, ["messages", "words", "dice", "players", "hours"])


def tidy_summary(spark: SparkSession, d: str) -> DataFrame:
    return R.tidy(_sizes(spark, d).withColumn("messages", F.col("messages").cast("double")), ["campaign_id"], ["messages", "words"])


def metric_names(spark: SparkSession, d: str) -> DataFrame:
    return tidy_summary(spark, d).select("metric").distinct()


def resolve_metric(spark: SparkSession, d: str) -> DataFrame:
    """A metric that only the summary has, and one that both have, from the series first."""
    summary = tidy_summary(spark, d)
    series = _messages(spark, d).select("campaign_id", F.lit("words").alias("metric"), F.col("word_count").cast("double").alias("value"))
    both = R.resolve_metric(series, summary, "words").withColumn("metric", F.lit("words"))
    only = R.resolve_metric(series, summary, "messages").withColumn("metric", F.lit("messages"))
    return both.unionByName(only).groupBy("campaign_id", "metric").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def topic_day_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.day_topics(_messages(spark, d), F.to_date("date"), F.col("message_type"), ["action", "dialogue", "narrative"])


def type_transitions(spark: SparkSession, d: str) -> DataFrame:
    return R.transitions(_turns(spark, d), "message_type")


def top_transitions(spark: SparkSession, d: str) -> DataFrame:
    return R.top_transitions(R.transitions(_turns(spark, d), "message_type"), 2)


def cross_model_pivot(spark: SparkSession, d: str) -> DataFrame:
    """The same blocks of turns side by side for three kinds of messages."""
    t = _turns(spark, d).withColumn("chunk_idx", F.floor(F.col("turn_idx") / 50))
    wide = t.groupBy("campaign_id", "chunk_idx").pivot("message_type", ["action", "dialogue", "narrative"]).agg(F.count(F.lit(1)))
    return wide.na.fill(0)


def turn_distribution(spark: SparkSession, d: str) -> DataFrame:
    return C.turn_distribution(_messages(spark, d))


def first_sheets(spark: SparkSession, d: str) -> DataFrame:
    return C.sheets(_turns(spark, d))


def character_players(spark: SparkSession, d: str) -> DataFrame:
    return C.players_of_characters(_turns(spark, d))


def name_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return C.name_conflicts(_messages(spark, d))


def single_post_filter(spark: SparkSession, d: str) -> DataFrame:
    return C.without_single_posts(_messages(spark, d)).select("campaign_id", "message_id", "character")


def manual_corrections(spark: SparkSession, d: str) -> DataFrame:
    return C.renamed(_messages(spark, d), table(spark, d, "name_corrections")).select("campaign_id", "message_id", "character")


def corrected_messages(spark: SparkSession, d: str) -> DataFrame:
    return C.corrected(_messages(spark, d), table(spark, d, "name_corrections")).select("campaign_id", "message_id", "character")


def player_posts_top(spark: SparkSession, d: str) -> DataFrame:
    """The first ten posts of each player of a campaign; ranks above ten are cut before rows are exchanged."""
    rank = F.row_number().over(W.partitionBy("campaign_id", "player").orderBy("turn_idx"))
    return _turns(spark, d).where("player IS NOT NULL").withColumn("rank", rank).where("rank <= 10").select("campaign_id", "player", "turn_idx")


def cache_miss(spark: SparkSession, d: str) -> DataFrame:
    meta = table(spark, d, "campaign_meta").select("campaign_id")
    return R.missing(meta, _sizes(spark, d), ["campaign_id"])


def cache_status(spark: SparkSession, d: str) -> DataFrame:
    held = _sizes(spark, d).select("campaign_id", F.lit(True).alias("cached"))
    return table(spark, d, "campaign_meta").select("campaign_id").join(held, "campaign_id", "left").na.fill(False, ["cached"])


def cache_merge(spark: SparkSession, d: str) -> DataFrame:
    sizes = _sizes(spark, d).select("campaign_id", "messages")
    return R.merged(sizes.withColumn("messages", -F.col("messages")), sizes.where("messages >= 20"), ["campaign_id"])


def cache_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Results written under their fingerprint and read again."""
    path = R.save_results(_sizes(spark, d), f"{shared_folder(spark)}/cache", "sizes", {"folder": d})
    return spark.read.parquet(path)


def _raw(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_messages")
    return raw.where(~F.coalesce(F.col("message_key").startswith("_"), F.lit(False)))


def flatten_messages(spark: SparkSession, d: str) -> DataFrame:
    """All message payloads flattened to the message model; one row per payload, readable or not."""
    rows = _raw(spark, d).select("campaign_id", F.col("raw_id").alias("ordinal"), "message_key", "payload")
    flat = S.flatten(rows)
    return flat.select(
        F.col("ordinal").alias("raw_id"), "player", "character", F.md5("text").alias("text_md5"), "label_counts.in_character", "label_counts.out_of_character",
        "label_counts.mixed", "label_counts.unlabeled", F.size("name_mentions").alias("mentions"), F.array_join("paragraph_actions", ",").alias("paragraph_actions"),
    )


def metadata_index(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_messages").where(F.col("message_key") == "_metadata")
    return S.metadata_index(raw.select("campaign_id", "message_key", "payload")).distinct()


def message_formats(spark: SparkSession, d: str) -> DataFrame:
    return messages_table(_raw(spark, d), F.col("raw_id"), F.col("payload")).groupBy("format").agg(F.count("*").alias("messages"))


def paragraph_labels(spark: SparkSession, d: str) -> DataFrame:
    p = paragraphs_table(_raw(spark, d), F.col("raw_id"), F.col("payload"))
    return p.groupBy(clean_label(F.col("label")).alias("label")).agg(F.count("*").alias("paragraphs"))


#: Kinds of paragraph actions and the words that tell them, in their order.
ACTION_KINDS = (("name_mentions", ("name", "mention")), ("spells", ("spell", "magic")), ("dialogue", ("dialogue", "talk", "speak")), ("roll", ("roll", "dice", "check")), ("weapon", ("weapon", "attack", "fight")))


def _paragraph_kinds(spark: SparkSession, d: str) -> DataFrame:
    """``record_id, kind``: a row for each kind of action a paragraph has, ``no_action`` if it has none."""
    from parlance.functions.text import has_any

    rows = actions_table(_raw(spark, d), F.col("raw_id"), F.col("payload"), outer=True)
    low, kind = F.lower("action_name"), F.lit("no_action")
    for name, words in reversed(ACTION_KINDS):
        kind = F.when(has_any(low, words), name).otherwise(kind)
    each = rows.withColumn("kind", kind).groupBy("record_id", "para_no").agg(F.collect_set("kind").alias("kinds"))
    named = F.filter("kinds", lambda k: k != "no_action")
    return each.select("record_id", F.explode(F.when(F.size(named) == 0, F.array(F.lit("no_action"))).otherwise(named)).alias("kind"))


def paragraph_actions(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs by kind of action; a paragraph counts once for each kind it has, ``no_action`` if for none."""
    return _paragraph_kinds(spark, d).groupBy("kind").agg(F.count("*").alias("paragraphs"))


def paragraph_actions_daily(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs by day and kind of action, and the kind's share of the day's kinds; messages without a readable date are left out."""
    rows = Stage(_paragraph_kinds(spark, d), "paragraph-kinds").df
    date = messages_table(_raw(spark, d), F.col("raw_id"), F.col("payload")).select("record_id", F.try_to_timestamp("date").cast("date").alias("day")).where("day IS NOT NULL")
    daily = rows.join(date, "record_id").groupBy("day", "kind").agg(F.count("*").alias("paragraphs"))
    total = daily.groupBy("day").agg(F.sum("paragraphs").alias("_n"))
    return daily.join(total, "day").select("day", "kind", "paragraphs", F.round(100.0 * F.col("paragraphs") / F.col("_n"), 6).alias("percent"))


def session_panels(spark: SparkSession, d: str) -> DataFrame:
    """Histograms of the sessions' mean, least and spread of cohesion."""
    return R.panels(Stage(An.session_cohesion(spark, d), "sessions").df, ["mean", "least", "deviation"])


def session_scatter(spark: SparkSession, d: str) -> DataFrame:
    """Posts of each session against its mean distance."""
    return An.session_cohesion(spark, d).select("campaign_id", "block", "posts", F.round(1 - F.col("mean"), 6).alias("distance"))


def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Mean words of the same stretch of a game under each model, side by side."""
    meta = table(spark, d, "campaign_meta").where("model IS NOT NULL").select("campaign_id", "campaign_name", "model")
    # One row per model: few.
    models = sorted(r.model for r in meta.select("model").distinct().collect())
    t = turns(spark, d, "word_count").select("campaign_id", F.floor(F.col("turn_idx") / 50).alias("chunk_idx"), "word_count")
    return R.compare_models(t.join(meta, "campaign_id"), ["campaign_name", "chunk_idx"], "model", "word_count", models)


def histogram_by_model(spark: SparkSession, d: str) -> DataFrame:
    """Words per message of campaigns by model and by whether players had personalities, in common bins."""
    meta = table(spark, d, "campaign_meta").where("model IS NOT NULL").select("campaign_id", "model", "include_player_personalities")
    return R.histogram(_sizes(spark, d).join(meta, "campaign_id"), F.col("words"), 10, group=["model", "include_player_personalities"])


def paragraph_fallback(spark: SparkSession, d: str) -> DataFrame:
    p = paragraphs_table(_raw(spark, d), F.col("raw_id"), F.col("payload"))
    return p.groupBy(F.coalesce(action_class(F.col("text")), F.lit("none")).alias("kind")).agg(F.count("*").alias("paragraphs"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Extraction windows answered by the keyword annotator; the answers are stored before they are parsed."""
    t = _turns(spark, d)
    w = E.windows(t.groupBy("campaign_id").agg(F.count("*").alias("n")))
    requests = Mo.extraction_requests(t, w, "Find the attacks.")
    return Stage(Mo.annotate(requests, "prompt", lambda: Mo.KeywordAnnotator(("attacks",), "NO_CONFLICTS_FOUND", "DRAMATIC"), "conflict"), "answers").df


def annotated_turns(spark: SparkSession, d: str) -> DataFrame:
    """Window texts answered by an annotator, parsed, validated and kept once per turn."""
    found = P.typed_turns(_answers(spark, d).drop("prompt"), F.col("response"), "NO_CONFLICTS_FOUND", ("PLAYER", "DRAMATIC"))
    return E.first_found(found).select("campaign_id", "turn_idx", "type")


def annotated_episodes(spark: SparkSession, d: str) -> DataFrame:
    found = annotated_turns(spark, d)
    return E.episodes(found, F.col("type"), F.lit(3.0), "PLAYER", "DRAMATIC").select("campaign_id", "start_turn", "end_turn", "turn_count", "kind")


def message_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """The vector of every message, whole, as text."""
    t = table(spark, d, "campaign_messages").select("row_id", "text")
    return Mo.embed(t, "text").select("row_id", vector_text(F.col("vector")).alias("vector"))


def scene_diversity(spark: SparkSession, d: str) -> DataFrame:
    """Diversity of each scene's words by the offline token encoder."""
    from parlance.functions.text import word_count

    t = _turns(spark, d).withColumn("n", word_count(F.col("text")))
    placed = E.scenes(t, F.col("n")).join(t.select("campaign_id", "turn_idx", "text"), ["campaign_id", "turn_idx"])
    text = placed.groupBy("campaign_id", "scene_no").agg(F.array_sort(F.collect_list(F.struct("turn_idx", "text"))).alias("s"))
    text = text.select("campaign_id", "scene_no", F.array_join(F.transform("s", lambda x: x.getField("text")), " ").alias("text"))
    return Mo.token_diversity(text, ["campaign_id", "scene_no"], "text").withColumn("diversity", F.round("diversity", 6))


def label_embeddings(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "campaign_messages").select("row_id", *Mo.LABEL_TEXTS.values())
    return Mo.embed_labels(t, ["row_id"]).select("row_id", "label", vector_text(F.col("vector")).alias("vector"))


def player_scenes(spark: SparkSession, d: str) -> DataFrame:
    """Diversity of the scenes of each player's own messages in a campaign; players with one message have none."""
    from parlance.functions.text import word_count

    t = turns(spark, d, "player", "text").where("player IS NOT NULL")
    own = Se.place_in(t, ["campaign_id", "player"], "turn_idx", "own_idx")
    conv = F.to_json(F.struct("campaign_id", "player"))
    held = Stage(own.select("campaign_id", "player", conv.alias("conv"), "own_idx", "text", word_count(F.col("text")).alias("n")), "player-turns").df
    placed = E.scenes(held.select(F.col("conv").alias("campaign_id"), F.col("own_idx").alias("turn_idx"), "n"), F.col("n")).toDF("conv", "own_idx", "scene_no")
    scene = placed.join(held, ["conv", "own_idx"]).groupBy("campaign_id", "player", "scene_no").agg(
        F.count("*").alias("messages"), F.array_sort(F.collect_list(F.struct("own_idx", "text"))).alias("s")
    )
    many = held.groupBy("campaign_id", "player").agg(F.count("*").alias("all")).where("all >= 2").drop("all")
    text = scene.join(many, ["campaign_id", "player"], "left_semi").withColumn("text", F.array_join(F.transform("s", lambda x: x.getField("text")), " ")).drop("s")
    return Mo.token_diversity(text, ["campaign_id", "player", "scene_no", "messages"], "text").withColumn("diversity", F.round("diversity", 6))


def player_diversity(spark: SparkSession, d: str) -> DataFrame:
    """Scenes, messages and mean diversity of each player of a campaign."""
    return player_scenes(spark, d).groupBy("campaign_id", "player").agg(
        F.count("*").alias("scenes"), F.sum("messages").alias("messages"), F.round(F.avg("diversity"), 6).alias("mean_diversity")
    )


def character_pool(spark: SparkSession, d: str) -> DataFrame:
    """Per-player values of diversity, self-similarity, vocabulary and cohesion pooled by category of campaign."""
    scene = Stage(player_scenes(spark, d), "player-scenes").df
    means = scene.groupBy("campaign_id", "player").agg(F.avg("diversity").alias("v"))
    own = Se.place_in(turns(spark, d, "player", "text").where("player IS NOT NULL"), ["campaign_id", "player"], "turn_idx", "own_idx")
    vectors = Stage(Se.as_doubles(Mo.embed(own.select("campaign_id", "player", "own_idx", "text"), "text")), "player-vectors").df
    parts = (
        ("dsi_scores", scene, "diversity"), ("mean_dsi", means, "v"), ("mean_jaccard", An.player_self_jaccard(spark, d), "self_jaccard"),
        ("vocabulary", An.player_vocab(spark, d), "vocabulary"), ("sequential_cohesion", Se.cosine_back(vectors, ["campaign_id", "player"], "own_idx"), "cosine"),
    )
    values = None
    for name, df, column in parts:
        one = df.where("player IS NOT NULL").select("campaign_id", F.lit(name).alias("metric"), F.col(column).cast("double").alias("value"))
        values = one if values is None else values.unionByName(one)
    return R.pool_characters(values, _categories(spark, d))


def episode_rating_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of the words of an episode's text with its rating, over all episodes."""
    from parlance.functions.text import word_count

    t = turns(spark, d, "character", "text", "in_combat", "primary_label", "word_count")
    found = An._episodes(t)
    text = E.range_text(t, found.select("campaign_id", "start_turn", "end_turn"), ["start_turn", "end_turn"])
    sized = text.select("campaign_id", "start_turn", word_count(F.col("text")).alias("words"))
    return R.correlations(sized.join(found.select("campaign_id", "start_turn", "rating"), ["campaign_id", "start_turn"]), ["words", "rating"])


class _Judge:
    """An annotator that rates a session and each character of its first line by a checksum, as a stand-in."""

    def answer(self, prompts: list[str]) -> list[str]:
        return [self._one(p) for p in prompts]

    def _one(self, prompt: str) -> str:
        def rate(who: str, dash: str) -> str:
            return "\n".join(f"{dash}{n}: {zlib.crc32(f'{who}|{n}|{prompt}'.encode()) % 5 + 1}" for n in P.DIMENSIONS)

        names = [n for n in prompt.partition("\n")[0].split("|") if n]
        return "\n".join([rate("", ""), *(f"### {n}:\n{rate(n, '- ')}" for n in names)])


def _judged(spark: SparkSession, d: str) -> DataFrame:
    sessions = E.judge_sessions(turns(spark, d, "player", "character", "text"))
    requests = sessions.select("campaign_id", "block", "characters", F.concat("characters", F.lit("\n\n"), "text").alias("prompt"))
    return Stage(Mo.annotate(requests, "prompt", _Judge, "judge").drop("prompt"), "judge-answers").df


def judge_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Mean score of each dimension and composite of every campaign's judged sessions."""
    return P.judge_summary(_judged(spark, d).withColumn("scores", P.judge_overall(F.col("response"))), "scores", ["campaign_id"])


def judge_player_summaries(spark: SparkSession, d: str) -> DataFrame:
    """As :func:`judge_summaries`, by the player who last posted as the judged character."""
    each = _judged(spark, d).select("campaign_id", "response", F.explode(F.split("characters", "\\|")).alias("character")).where("character <> ''")
    players = C.players_of_characters(turns(spark, d, "player", "character").where("player IS NOT NULL"))
    scored = each.join(players, ["campaign_id", "character"]).withColumn("scores", P.judge_character(F.col("response"), F.col("character")))
    return P.judge_summary(scored.where("size(scores) > 0"), "scores", ["campaign_id", "player"])


def corrected_once(spark: SparkSession, d: str) -> DataFrame:
    """Corrected messages written in two passes; the second leaves alone what the first has written."""
    folder, t = f"{shared_folder(spark)}/corrected-{uuid.uuid4().hex}", corrected_messages(spark, d)
    C.save_corrected(t.where(F.crc32("campaign_id") % 2 == 0), folder)
    return C.save_corrected(t, folder)


def linked_norms(spark: SparkSession, d: str) -> DataFrame:
    """Norms linked over the texts of combat turns, as stand-ins for an annotator's descriptions."""
    t = turns(spark, d, "text", "in_combat").where("in_combat AND text IS NOT NULL")
    norms = t.select("campaign_id", F.col("turn_idx").alias("start_turn"), F.col("text").alias("description"), (F.col("turn_idx") % 2 == 0).alias("is_explicit"))
    kind = F.element_at(F.array(*map(F.lit, ("establishing", "following", "violating", "enforcing"))), (F.col("start_turn") % 4 + 1).cast("int"))
    return Mo.norm_summaries(Mo.link_norms(norms.withColumn("episode_type", kind)))


def system_prompts(spark: SparkSession, d: str) -> DataFrame:
    return G.system_prompts(_messages(spark, d))


class _Echo:
    """An annotator that answers with the length of the prompt."""

    def answer(self, prompts: list[str]) -> list[str]:
        return [f"seen {len(p)} characters" for p in prompts]


def simulated_games(spark: SparkSession, d: str) -> DataFrame:
    """One short game per campaign with a model."""
    meta = table(spark, d, "campaign_meta").where("model IS NOT NULL")
    games = meta.select(
        F.col("campaign_id").alias("game_id"), F.concat(F.lit("Play "), "campaign_id").alias("system"), F.lit("It begins.").alias("scenario"),
        F.array(F.lit("Ann"), F.lit("Bo")).alias("characters"), F.lit(12).alias("turns"),
    )
    return G.play(games, _Echo, chunk=4, verbatim=4)


def turn_owners(spark: SparkSession, d: str) -> DataFrame:
    return G.turn_sequence(spark, ["Ann", "Bo", "Cy"], 1000)


def events_daily(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("date").alias("day"), "event_type", "n")


def events_sliding(spark: SparkSession, d: str) -> DataFrame:
    return Z.sliding(table(spark, d, "events"))


def streamed_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The sessions a stream over the events emits, drained into a table.

    A second source brings a last event of no user, far in the future: the watermark then passes every session's end.
    """
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events = table(spark, d, "events")
    last = {"ts": F.lit("2999-01-01").cast("timestamp_ntz")}
    closing = spark.range(1).select(*(last.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema))
    closing.write.parquet(f"{folder}/closing")
    # A table is one file or a folder of them.
    read = lambda path: spark.readStream.schema(events.schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    stream = read(f"{d}/events.parquet*").unionByName(read(f"{folder}/closing"))
    query = (
        Z.sessions(stream).writeStream.format("parquet").outputMode("append")
        .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "ended_at")}
    return spark.read.parquet(f"{folder}/out").where("user_id IS NOT NULL").withColumns(times)


QUERIES = {f.__name__: f for f in (
    campaign_categories, category_pool, metadata_filter, histogram_linear, histogram_log, histogram_by_category, novelty_panels, metric_correlation,
    tidy_summary, metric_names, resolve_metric, topic_day_counts, type_transitions, top_transitions, cross_model_pivot, turn_distribution, first_sheets,
    character_players, name_conflicts, single_post_filter, manual_corrections, corrected_messages, player_posts_top, cache_miss, cache_status, cache_merge,
    paragraph_actions_daily, session_panels, session_scatter, model_comparison, histogram_by_model, cache_roundtrip, flatten_messages, metadata_index, message_formats, paragraph_labels, paragraph_actions, paragraph_fallback, annotated_turns,
    annotated_episodes, message_embeddings, label_embeddings, player_scenes, player_diversity, character_pool, episode_rating_correlation, judge_summaries,
    judge_player_summaries, corrected_once, scene_diversity, linked_norms, system_prompts, simulated_games, turn_owners, events_daily, events_sliding, streamed_sessions,
)}

_SIZES = f"WITH {M}, z AS (SELECT campaign_id, count(*) AS messages, round(avg(word_count), 6) AS words FROM m GROUP BY 1)"
_CATEGORY = """k AS (SELECT campaign_id, CASE WHEN model IS NULL THEN 'human' ELSE 'model:' || model ||
  coalesce(', include_player_personalities:' || CASE WHEN include_player_personalities THEN 'True' ELSE 'False' END, '') END AS category FROM campaign_meta)"""


def _histogram(source: str, value: str, bins: int, group: str = "", log: bool = False) -> str:
    g = f"{group}, " if group else ""
    y = f"log10({value})" if log else f"CAST({value} AS DOUBLE)"
    return f"""{source} SELECT {g}CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((y - lo) / ((hi - lo) / {bins})), {bins - 1}) END AS INTEGER) AS bin, count(*) AS n
FROM (SELECT {g}{y} AS y, min({y}) OVER () AS lo, max({y}) OVER () AS hi FROM src WHERE {value} IS NOT NULL{f' AND {value} > 0' if log else ''}) GROUP BY {g}2""".replace(
        "GROUP BY 2", "GROUP BY 1"
    )


_RENAMED = f"""WITH {M}, f AS (SELECT campaign_id, old_name, min(new_name) AS new_name FROM name_corrections GROUP BY 1, 2),
c AS (SELECT m.* REPLACE (coalesce(f.new_name, m.character) AS character) FROM m LEFT JOIN f ON f.campaign_id = m.campaign_id AND f.old_name = m.character)"""
_SINGLE = """SELECT campaign_id, message_id, character FROM (SELECT *, count(*) OVER (PARTITION BY campaign_id, character) AS n FROM {t})
WHERE character IS NULL OR character IN ('', 'Dungeon Master') OR n <> 1"""
_META = ", ".join(
    f"CAST(payload ->> '$.{c}' AS {t}) AS {c}" for c, t in (
        ("model", "VARCHAR"), ("temperature", "DOUBLE"), ("max_tokens", "INTEGER"), ("campaign_name", "VARCHAR"), ("include_player_personalities", "BOOLEAN"),
        ("scratchpad", "BOOLEAN"), ("summarization_enabled", "BOOLEAN"), ("summary_chunk_size", "INTEGER"), ("extraction_initial_turns", "INTEGER"),
        ("extraction_intro_window", "INTEGER"), ("extraction_pre_intro_turns", "INTEGER"), ("timestamp", "VARCHAR"), ("year", "INTEGER"), ("month", "INTEGER"), ("day", "INTEGER"),
    )
)

_KINDS = f"WITH {PARAGRAPHS}, {ACTIONS}, z AS (SELECT DISTINCT raw_id, k, CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(action_name), '{w}')" for w in words) + f" THEN '{name}'" for name, words in ACTION_KINDS
) + """ ELSE 'no_action' END AS kind FROM every), n AS (SELECT raw_id, k, count(*) FILTER (WHERE kind <> 'no_action') AS named FROM z GROUP BY 1, 2),
kinds AS (SELECT raw_id, kind FROM z JOIN n USING (raw_id, k) WHERE kind <> 'no_action' OR named = 0)"""

_ACTION = "CASE WHEN json_type({x}) = 'VARCHAR' THEN {x} ->> '$' ELSE CAST(json({x}) AS VARCHAR) END"
#: The kind of action a paragraph's lower-cased text suggests.
_CLASS = "CASE " + " ".join(
    "WHEN " + " OR ".join("contains(low, '{}')".format(w.replace("'", "''")) for w in words) + f" THEN '{name}'"
    for name, words in (("roll", ROLL_WORDS), ("dialogue", SPEECH_WORDS), ("spells", SPELL_WORDS), ("weapon", WEAPON_WORDS))
) + " END"

SQL = {
    "campaign_categories": f"WITH {_CATEGORY} SELECT * FROM k",
    "category_pool": f"""{_SIZES}, {_CATEGORY} SELECT category, count(DISTINCT campaign_id) AS campaigns, count(words) AS values, round(avg(words), 6) AS mean,
  round(median(words), 6) AS median, row_number() OVER (ORDER BY CASE WHEN category = 'human' THEN 0 ELSE 1 END, category) AS position FROM k LEFT JOIN z USING (campaign_id) GROUP BY category""",
    "metadata_filter": f"""WITH {M} SELECT campaign_id, count(*) AS messages FROM m WHERE campaign_id IN (SELECT campaign_id FROM campaign_meta
  WHERE temperature IN (0.7, 1.0) AND scratchpad IS NOT DISTINCT FROM false) GROUP BY 1""",
    "histogram_linear": _histogram("WITH src AS (SELECT * FROM campaign_messages)", "word_count", 19),
    "histogram_log": _histogram(f"{_SIZES}, src AS (SELECT * FROM z)", "messages", 11, log=True),
    "histogram_by_category": _histogram(f"{_SIZES}, {_CATEGORY}, src AS (SELECT * FROM z JOIN k USING (campaign_id))", "words", 9, "category"),
    "novelty_panels": _histogram(f"{_SIZES}, src AS (SELECT * FROM z)", "words", 20),
    "metric_correlation": f"""WITH {M}, i AS (SELECT campaign_id, date_diff('microsecond', lag(date) OVER (PARTITION BY campaign_id ORDER BY turn_idx), date) / 3.6e9 AS h FROM m WHERE date IS NOT NULL),
a AS (SELECT campaign_id, count(*) AS messages, avg(word_count) AS words, avg(CAST(has_dice_roll AS INTEGER)) AS dice, count(DISTINCT player) AS players FROM m GROUP BY 1),
x AS (SELECT * FROM a LEFT JOIN (SELECT campaign_id, avg(h) AS hours FROM i GROUP BY 1) USING (campaign_id)) """
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM x"
        for i, a in enumerate(("messages", "words", "dice", "players", "hours")) for b in ("messages", "words", "dice", "players", "hours")[i + 1 :]
    ),
    "tidy_summary": _SIZES + " SELECT campaign_id, 'messages' AS metric, CAST(messages AS DOUBLE) AS value FROM z UNION ALL SELECT campaign_id, 'words', words FROM z",
    "metric_names": "SELECT unnest(['messages', 'words']) AS metric",
    "resolve_metric": _SIZES + """ SELECT campaign_id, 'words' AS metric, count(*) AS n, round(sum(CAST(word_count AS DOUBLE)), 4) AS total FROM m GROUP BY 1
UNION ALL SELECT campaign_id, 'messages', 1, CAST(messages AS DOUBLE) FROM z""",
    "topic_day_counts": f"""WITH {M} SELECT CAST(date AS DATE) AS day, count(*) FILTER (WHERE message_type = 'action') AS action, count(*) FILTER (WHERE message_type = 'dialogue') AS dialogue,
  count(*) FILTER (WHERE message_type = 'narrative') AS narrative FROM m WHERE date IS NOT NULL GROUP BY 1""",
    "type_transitions": f"""WITH {M}, t AS (SELECT message_type AS "from", lead(message_type) OVER (PARTITION BY campaign_id ORDER BY turn_idx) AS "to",
  lead(turn_idx) OVER (PARTITION BY campaign_id ORDER BY turn_idx) AS nxt FROM m) SELECT "from", "to", count(*) AS n FROM t WHERE nxt IS NOT NULL GROUP BY 1, 2""",
    "top_transitions": f"""WITH {M}, t AS (SELECT message_type AS "from", lead(message_type) OVER (PARTITION BY campaign_id ORDER BY turn_idx) AS "to",
  lead(turn_idx) OVER (PARTITION BY campaign_id ORDER BY turn_idx) AS nxt FROM m), x AS (SELECT "from", "to", count(*) AS n FROM t WHERE nxt IS NOT NULL GROUP BY 1, 2),
b AS (SELECT "from" FROM x GROUP BY 1 ORDER BY sum(n) DESC, 1 LIMIT 2) SELECT * FROM x WHERE "from" IN (SELECT * FROM b) AND "to" IN (SELECT * FROM b)""",
    "cross_model_pivot": f"""WITH {M} SELECT campaign_id, turn_idx // 50 AS chunk_idx, count(*) FILTER (WHERE message_type = 'action') AS action,
  count(*) FILTER (WHERE message_type = 'dialogue') AS dialogue, count(*) FILTER (WHERE message_type = 'narrative') AS narrative FROM m GROUP BY 1, 2""",
    "turn_distribution": f"""WITH {M} SELECT campaign_id, character, count(*) AS turns, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY campaign_id), 6) AS percent
FROM m WHERE character IS NOT NULL GROUP BY 1, 2""",
    "first_sheets": f"""WITH {M} SELECT campaign_id, character, player, gender, race, class FROM m WHERE character IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY campaign_id, character ORDER BY turn_idx) = 1""",
    "character_players": f"""WITH {M} SELECT campaign_id, character, player FROM m WHERE character IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY campaign_id, character ORDER BY turn_idx DESC) = 1""",
    "name_conflicts": f"""WITH {M} SELECT campaign_id, character, array_to_string(list_sort(list(DISTINCT player)), '|') AS players FROM m
WHERE character IS NOT NULL AND character <> 'Dungeon Master' AND player IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT player) > 1""",
    "single_post_filter": f"WITH {M} " + _SINGLE.format(t="m"),
    "manual_corrections": _RENAMED + " SELECT campaign_id, message_id, character FROM c",
    "corrected_messages": _RENAMED + " " + _SINGLE.format(t="c"),
    "player_posts_top": f"""WITH {M} SELECT campaign_id, player, turn_idx FROM m WHERE player IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY campaign_id, player ORDER BY turn_idx) <= 10""",
    "cache_miss": "SELECT campaign_id FROM campaign_meta WHERE campaign_id NOT IN (SELECT campaign_id FROM campaign_messages)",
    "cache_status": "SELECT campaign_id, campaign_id IN (SELECT campaign_id FROM campaign_messages) AS cached FROM campaign_meta",
    "cache_merge": _SIZES + " SELECT campaign_id, CASE WHEN messages >= 20 THEN messages ELSE -messages END AS messages FROM z",
    "cache_roundtrip": _SIZES + " SELECT * FROM z",
    "metadata_index": f"SELECT DISTINCT campaign_id, {_META} FROM raw_messages WHERE message_key = '_metadata' AND json_valid(payload)",
    "system_prompts": f"""WITH {M} SELECT campaign_id, 'You take part in the game ' || campaign_id || printf('. Posts have %d words on average (median %d, standard deviation %d).',
  CAST(floor(avg(word_count) + 0.5) AS BIGINT), CAST(floor(median(word_count) + 0.5) AS BIGINT), CAST(floor(stddev_pop(word_count) + 0.5) AS BIGINT)) AS prompt FROM m GROUP BY 1""",
    "message_embeddings": VECTOR_SQL,
    "annotated_turns": f"WITH {M} SELECT campaign_id, turn_idx, 'DRAMATIC' AS type FROM m WHERE contains(lower(text), 'attacks')",
    "annotated_episodes": f"""WITH {M}, a AS (SELECT campaign_id, turn_idx, turn_idx - row_number() OVER (PARTITION BY campaign_id ORDER BY turn_idx) AS isl
  FROM m WHERE contains(lower(text), 'attacks'))
SELECT campaign_id, min(turn_idx) AS start_turn, max(turn_idx) AS end_turn, count(*) AS turn_count, 'DRAMATIC' AS kind FROM a GROUP BY campaign_id, isl""",
    "flatten_messages": f"""WITH {PARAGRAPHS}, r AS (SELECT raw_id FROM raw_messages WHERE NOT coalesce(starts_with(message_key, '_'), false)),
f AS (SELECT raw_id, k, q, q ->> '$.text' AS t, q ->> '$.label' AS l, lower(q ->> '$.text') AS low, a FROM par),
s AS (SELECT raw_id, string_agg(t, ' ' ORDER BY CASE WHEN regexp_full_match(k, '[0-9]+') THEN CAST(k AS BIGINT) ELSE 0 END, k) AS text,
  count(*) FILTER (WHERE l = 'in-character') AS i, count(*) FILTER (WHERE l = 'out-of-character') AS o, count(*) FILTER (WHERE l = 'mixed') AS m, count(*) AS n,
  string_agg(acts, ',' ORDER BY CASE WHEN regexp_full_match(k, '[0-9]+') THEN CAST(k AS BIGINT) ELSE 0 END, k) FILTER (WHERE acts <> '') AS acts FROM (
    SELECT *, CASE WHEN json_type(a) = 'ARRAY' THEN array_to_string(list_transform(list_filter(CAST(a AS JSON[]), lambda x: coalesce(json_type(x), 'NULL') <> 'NULL'), lambda x: {_ACTION.format(x="x")}), ',')
      WHEN coalesce(json_type(a), 'NULL') IN ('VARCHAR', 'OBJECT') THEN {_ACTION.format(x="a")} ELSE coalesce({_CLASS}, '') END AS acts FROM f) GROUP BY 1)
SELECT r.raw_id, p ->> '$.player' AS player, p ->> '$.character' AS character, CASE WHEN old THEN md5(p ->> '$.text') ELSE md5(coalesce(s.text, CASE WHEN json_type(ps) IN ('OBJECT', 'ARRAY') THEN '' END)) END AS text_md5,
  coalesce(i, 0) AS in_character, coalesce(o, 0) AS out_of_character, coalesce(m, 0) AS mixed, CASE WHEN old THEN 1 ELSE coalesce(n - i - o - m, 0) END AS unlabeled,
  CASE WHEN json_type(p, '$.name_mentions') = 'ARRAY' THEN json_array_length(p, '$.name_mentions') ELSE 0 END AS mentions, CASE WHEN NOT old AND json_type(ps) IN ('OBJECT', 'ARRAY') THEN coalesce(acts, '') END AS paragraph_actions
FROM r LEFT JOIN msg USING (raw_id) LEFT JOIN s USING (raw_id)""",
    "message_formats": f"WITH {PARAGRAPHS} SELECT CASE WHEN old THEN 'old' ELSE 'new' END AS format, count(*) AS messages FROM msg GROUP BY 1",
    "paragraph_labels": f"WITH {PARAGRAPHS} SELECT {LABEL} AS label, count(*) AS paragraphs FROM par GROUP BY 1",
    "paragraph_fallback": f"WITH {PARAGRAPHS}, x AS (SELECT lower(q ->> '$.text') AS t FROM par) SELECT CASE WHEN contains(t, 'roll') OR contains(t, 'd20') OR contains(t, 'dice') THEN 'roll'"
    """ WHEN contains(t, 'says') OR contains(t, 'asks') OR contains(t, 'replies') OR contains(t, '"') OR contains(t, '''') THEN 'dialogue' WHEN contains(t, 'spell') OR contains(t, 'cast') OR contains(t, 'magic') THEN 'spells'
  WHEN contains(t, 'attack') OR contains(t, 'sword') OR contains(t, 'weapon') OR contains(t, 'hit') THEN 'weapon' ELSE 'none' END AS kind, count(*) AS paragraphs FROM x GROUP BY 1""",
    "paragraph_actions": _KINDS + " SELECT kind, count(*) AS paragraphs FROM kinds GROUP BY 1",
    "paragraph_actions_daily": _KINDS + """, dated AS (SELECT raw_id, CAST(TRY_CAST(p ->> '$.date' AS TIMESTAMP) AS DATE) AS day FROM msg)
SELECT day, kind, count(*) AS paragraphs, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY day), 6) AS percent FROM kinds JOIN dated USING (raw_id) WHERE day IS NOT NULL GROUP BY 1, 2""",
    "session_panels": " UNION ALL ".join(
        f"SELECT '{c}' AS panel, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) / ((hi - lo) / 20)), 19) END AS INTEGER) AS bin, count(*) AS n FROM (SELECT {c} AS x, min({c}) OVER () AS lo, max({c}) OVER () AS hi FROM ({An.SQL['session_cohesion']})) GROUP BY 1, 2"
        for c in ("mean", "least", "deviation")
    ),
    "session_scatter": f"SELECT campaign_id, block, posts, round(1 - mean, 6) AS distance FROM ({An.SQL['session_cohesion']})",
    "model_comparison": f"""WITH {M}, x AS (SELECT campaign_name, turn_idx // 50 AS chunk_idx, model, round(avg(word_count), 6) AS v FROM m JOIN campaign_meta USING (campaign_id)
  WHERE model IS NOT NULL GROUP BY 1, 2, 3) PIVOT x ON model USING first(v) GROUP BY campaign_name, chunk_idx""",
    "histogram_by_model": f"""{_SIZES}, s AS (SELECT model, include_player_personalities, words AS y, min(words) OVER () AS lo, max(words) OVER () AS hi FROM z JOIN campaign_meta USING (campaign_id)
  WHERE model IS NOT NULL AND words IS NOT NULL)
SELECT model, include_player_personalities, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((y - lo) / ((hi - lo) / 9)), 8) END AS INTEGER) AS bin, count(*) AS n FROM s GROUP BY 1, 2, 3""",
    "label_embeddings": "SELECT CAST(split_part(row_id, '|', 1) AS BIGINT) AS row_id, split_part(row_id, '|', 2) AS label, vector FROM (" + vectors_sql(" UNION ALL ".join(
        f"SELECT row_id || '|{label}' AS row_id, {column} AS text FROM campaign_messages WHERE length({column}) > 0" for label, column in Mo.LABEL_TEXTS.items()
    )) + ")",
    "episode_rating_correlation": An._A + r""", x AS (SELECT e.campaign_id, start_turn, any_value(rating) AS rating, sum(len(list_filter(regexp_split_to_array(
  'Turn ' || turn_idx || ' - ' || coalesce(character, '') || ': ' || coalesce(text, ''), '[ \t\n\r\f\x0B]+'), lambda x: x <> ''))) AS words
  FROM e JOIN m ON m.campaign_id = e.campaign_id AND turn_idx BETWEEN start_turn AND end_turn GROUP BY 1, 2)
SELECT 'words' AS a, 'rating' AS b, round(corr(words, rating), 6) AS r FROM x""",
    "streamed_sessions": _sessions("user_id", "ts", "SELECT user_id, event_id AS k, ts FROM events") + " FROM s GROUP BY user_id, sid",
    "turn_owners": "SELECT t AS turn_idx, ['Ann', 'Bo', 'Cy'][CAST('0x' || substr(md5('20|' || t), 1, 8) AS BIGINT) % 3 + 1] AS character FROM range(1000) r(t)",
    "events_sliding": """WITH w AS (SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(6 * k) AS start FROM events, range(4) r(k))
SELECT start, start + INTERVAL 1 DAY AS "end", event_type, count(*) AS n FROM w GROUP BY 1, 2, 3""",
    "events_daily": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
