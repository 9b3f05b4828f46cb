"""Rebuilding conversations from message rows by parent pointers.

Every message points at its parent.  Pointers are first followed inside blocks of neighbouring messages, where they
mostly lead; what remains are pointers between blocks.  Those few are resolved by pointer jumping: in each round a
join replaces every pointer by its target's pointer, so chains of any length end after a logarithmic number of
rounds.  A message whose chain ends at a missing parent is an orphan; one whose chain never ends lies on or behind a
cycle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from parlance.session import Stage

#: Messages of one conversation whose ids agree after division by this share a block.
BLOCK = 4096


def jump(target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Follow ``target`` (own place: stop) to its end by doubling; the end and the number of steps, ends first.

    A place that is still moving after as many doublings as the array is long lies on or behind a cycle and gets
    the end -1.
    """
    n = len(target)
    at, steps = target.copy(), (target != np.arange(n)).astype(np.int64)
    for _ in range(max(n, 1).bit_length() + 1):
        further = at[at]
        if (further == at).all():
            return at, steps
        steps = steps + steps[at]
        at = further
    moving = target[at] != at
    return np.where(moving, -1, at), steps


def _local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Resolve pointers inside each batch of rows, whatever conversations it holds.

    ``top`` is the highest message of the chain in the batch, ``ptr`` the parent it points at outside (null at a
    root), ``steps`` the way to ``ptr``, or to ``top`` at a root.
    """
    for batch in batches:
        n = len(batch)
        conv, _ = pd.factorize(batch["conv"])
        ids = batch["id"].to_numpy(np.int64)
        known = batch["parent"].notna().to_numpy()
        parent = batch["parent"].fillna(0).to_numpy(np.int64)
        # One number for (conversation, id), dense in the ids that occur.
        _, rank = np.unique(np.concatenate((ids, parent)), return_inverse=True)
        key = conv * np.int64(rank.max() + 1 if n else 1)
        own, up = key + rank[:n], key + rank[n:]
        order = np.argsort(own, kind="stable")
        spot = np.minimum(np.searchsorted(own[order], up), n - 1)
        inside = known & (own[order][spot] == up)
        end, steps = jump(np.where(inside, order[spot], np.arange(n)))
        cyclic = end < 0
        end = np.where(cyclic, 0, end)
        leaves = known[end] & ~cyclic
        yield batch.assign(
            top=ids[end], ptr=pd.arrays.IntegerArray(parent[end], ~leaves), steps=np.where(cyclic, 0, steps + leaves), cyclic=cyclic
        )


def resolve(messages: DataFrame, block: int = BLOCK) -> DataFrame:
    """Root and depth of every message of ``(conv, id, parent)``: adds ``root, depth, state``.

    ``state`` is ``ok``, ``orphan`` (the chain ends at a parent that is not there) or ``cycle``.  ``root`` is the
    message without parent at the top, or the topmost message that is there for an orphan, null for a cycle;
    ``depth`` counts the steps to it.  ``(conv, id)`` must be unique and not null; a null parent marks a root.
    """
    near = F.floor(F.col("id") / block)
    base = messages.repartition("conv", near).sortWithinPartitions("conv", near, "id")
    extra = [f.name for f in messages.schema if f.name not in ("conv", "id", "parent")]
    schema = StructType(messages.schema.fields).add("top", "long").add("ptr", "long").add("steps", "long").add("cyclic", "boolean")
    local = Stage(base.mapInPandas(_local, schema), "threads-local")
    # Only messages some other block points at take part in the jumping.
    wanted = local.df.where("ptr IS NOT NULL").select("conv", F.col("ptr").alias("id")).distinct()
    ports = wanted.join(local.df.select("conv", "id", F.col("top").alias("ptop"), "ptr", "steps", "cyclic"), ["conv", "id"], "left")
    ports = ports.select(
        "conv", "id",
        # end: the topmost message reached so far; next: where the chain goes on, null if it ended.
        F.col("ptop").alias("end"), F.col("ptr").alias("next"), F.coalesce("steps", F.lit(0)).alias("steps"),
        F.when(F.col("ptop").isNull(), "missing").when(F.col("cyclic"), "cycle").when(F.col("ptr").isNull(), "ok").alias("state"),
    )
    stage = Stage(ports, "threads-ports")
    total = stage.df.count()
    for _ in range(total.bit_length() + 1):
        if total == 0 or stage.df.where("state IS NULL").isEmpty():
            break
        ahead = stage.df.select(
            "conv", F.col("id").alias("next"), F.col("end").alias("end2"), F.col("next").alias("next2"),
            F.col("steps").alias("steps2"), F.col("state").alias("state2"),
        )
        moved = stage.df.join(ahead, ["conv", "next"], "left")
        go = F.col("state").isNull()
        lost = go & (F.col("state2") == "missing")
        moved = moved.select(
            "conv", "id",
            F.when(go & ~F.coalesce(lost, F.lit(False)), F.col("end2")).otherwise(F.col("end")).alias("end"),
            F.when(go, F.col("next2")).otherwise(F.col("next")).alias("next"),
            # The step onto a missing parent was counted; it leads nowhere.
            (F.col("steps") + F.when(F.coalesce(lost, F.lit(False)), -1).when(go, F.col("steps2")).otherwise(0)).alias("steps"),
            F.when(go, F.when(F.coalesce(lost, F.lit(False)), "orphan").otherwise(F.col("state2"))).otherwise(F.col("state")).alias("state"),
        )
        after = Stage(moved, "threads-ports")
        stage.drop()
        stage = after
    done = stage.df.select(
        "conv", F.col("id").alias("ptr"), F.col("end").alias("end2"), F.col("steps").alias("steps2"),
        F.coalesce("state", F.lit("cycle")).alias("state2"),
    )
    inside = local.df.where("ptr IS NULL").select(
        "conv", "id", "parent", *extra,
        F.when(~F.col("cyclic"), F.col("top")).alias("root"),
        F.when(~F.col("cyclic"), F.col("steps")).alias("depth"),
        F.when(F.col("cyclic"), "cycle").otherwise("ok").alias("state"),
    )
    missing = F.col("state2") == "missing"
    state = F.when(missing, "orphan").otherwise(F.col("state2"))
    outside = local.df.where("ptr IS NOT NULL").join(done, ["conv", "ptr"], "left").withColumn("state", state)
    outside = outside.select(
        "conv", "id", "parent", *extra,
        F.when(missing, F.col("top")).when(F.col("state") != "cycle", F.col("end2")).alias("root"),
        # The step onto a missing parent was counted; it leads nowhere.
        F.when(F.col("state") != "cycle", F.col("steps") + F.when(missing, -1).otherwise(F.col("steps2"))).alias("depth"),
        "state",
    )
    return inside.unionByName(outside)


#: The titles under which a game master posts, letters only, and the writer of automatic dice posts.
GM_TITLES = ("dungeonmaster", "gamemaster", "dm", "gm", "thedm", "thegm", "thedungeonmaster", "thegamemaster")
DICE = "Dice Roller"
REMOVAL = r"(?i)^\s*[\[(][^\[\]()]*\b(removed|deleted|withdrawn)\b[^\[\]()]*[\])]\s*$"


def speaker_role(character: Column) -> Column:
    """``gm``, ``player``, ``dice`` for automatic posts; null for a blank or missing character.

    A title counts with any case, spaces or dots, and the long ones with up to two typing errors.
    """
    letters = F.lower(F.regexp_replace(character, r"[^\p{L}]", ""))
    typo = (F.levenshtein(letters, F.lit("dungeonmaster"), 2) >= 0) | (F.levenshtein(letters, F.lit("gamemaster"), 2) >= 0)
    blank = character.isNull() | (F.regexp_replace(character, r"(?U)\s+", "") == "")
    return (
        F.when(blank, None)
        .when(F.lower(F.trim(character)) == DICE.lower(), "dice")
        .when(letters.isin(*GM_TITLES) | typo, "gm")
        .otherwise("player")
    )


def has_content(text: Column) -> Column:
    """Whether a text is more than white space and not only a bracketed notice of removal; false for null."""
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.coalesce((bare != "") & ~bare.rlike(REMOVAL), F.lit(False))


def turns(messages: DataFrame) -> DataFrame:
    """Resolved messages of ``(row_id, campaign_id, message_id, character, text)``: one row per distinct message.

    A message's parent is the turn before it.  Repeated loads are one message, which has content, or a side, if
    any of its loads has; ``load`` is its smallest row id.  Rows with a null campaign or message id take no part.
    """
    role, content = speaker_role(F.col("character")), has_content(F.col("text"))
    flat = messages.where("campaign_id IS NOT NULL AND message_id IS NOT NULL").select(
        F.col("campaign_id").alias("conv"), F.col("message_id").cast("long").alias("id"), F.col("row_id").cast("long").alias("load"),
        content.alias("content"), (content & F.coalesce(role == "gm", F.lit(False))).alias("gm"),
        (content & F.coalesce(role == "player", F.lit(False))).alias("pc"),
    )
    # Spread by block first; the aggregation then finds its rows together and needs no exchange of its own.
    near = F.floor(F.col("id") / BLOCK)
    one = flat.withColumn("near", near).repartition("conv", "near").groupBy("conv", "near", "id").agg(
        F.min("load").alias("load"), F.max("content").alias("content"), F.max("gm").alias("gm"), F.max("pc").alias("pc")
    )
    parent = F.when(F.col("id") != 0, F.col("id") - 1)
    return resolve(one.select("conv", "id", parent.alias("parent"), "load", "content", "gm", "pc"))


def verdicts(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Every conversation of ``conversations(campaign_id)`` with ``reason``: null if it is kept.

    ``empty``: no message with content, also if there is no message at all.  ``broken``: some message is an orphan
    or on a cycle, so the turns are not 0, 1, 2, ... without a hole.  ``no_reply``: the game master or the players
    have no message with content.  The first that holds is the reason.  Null campaign ids give no row; repeated
    ones give one.
    """
    return _reasons(turns(messages), conversations)


def _reasons(resolved: DataFrame, conversations: DataFrame) -> DataFrame:
    known = resolved.groupBy("conv").agg(
        F.max("content").alias("content"), F.max("gm").alias("gm"), F.max("pc").alias("pc"),
        F.max(F.col("state") != "ok").alias("broken"),
    )
    every = conversations.where("campaign_id IS NOT NULL").select(F.col("campaign_id").alias("conv")).distinct()
    reason = (
        F.when(~F.coalesce("content", F.lit(False)), "empty")
        .when(F.col("broken"), "broken")
        .when(~(F.col("gm") & F.col("pc")), "no_reply")
    )
    return every.join(known, "conv", "left").select(F.col("conv").alias("campaign_id"), reason.alias("reason"))


def rebuild(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """The kept conversations, one row per message: ``campaign_id, turn, role, player, character, text``.

    A conversation is the path from its root to its leaf: ``turn`` is the depth to which following the parents led, so
    rows read in its order.  Of repeated loads the one with the smallest row id is emitted; a message whose loads all
    lack a row id comes without player, character and text.  Conversations stay rows rather than one array: a single
    one may hold a large part of the corpus.
    """
    resolved = Stage(turns(messages), "threads-resolved").df
    kept = _reasons(resolved, conversations).where("reason IS NULL").select(F.col("campaign_id").alias("conv"))
    path = resolved.join(kept, "conv", "left_semi").select(F.col("conv").alias("campaign_id"), "id", "depth", "load")
    # Texts move once, by message and load; rows that agree in those are one load.
    held = messages.where("row_id IS NOT NULL").select(
        "campaign_id", F.col("message_id").cast("long").alias("id"), F.col("row_id").cast("long").alias("load"), "player", "character", "text"
    ).dropDuplicates(["campaign_id", "id", "load"])
    return path.join(held, ["campaign_id", "id", "load"], "left").select(
        "campaign_id", F.col("depth").alias("turn"), speaker_role(F.col("character")).alias("role"), "player", "character", "text",
    )
