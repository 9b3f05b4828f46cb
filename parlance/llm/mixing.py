"""Mixing sources to target weights by proportionate-fair scheduling.

Each source's documents, in a fixed random order and repeated as often as needed, form a line of tokens cut into
blocks.  Of a source with n of the mix's T blocks, block k is released at slot floor(k T / n) and due at slot
ceil((k + 1) T / n); the earliest deadline first gives every source its share in every prefix up to less than one block.

A long mix is cut into segments of slots.  Where they meet, every source stands less than one block off its share, so
each segment is a mix of its own, scheduled in a task of its own; a prefix then deviates by less than two blocks,
however large the mix.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from parlance.session import Stage

#: Tokens of a block and slots of a segment, unless others are asked for.
BLOCK, SEGMENT = 4096, 65_536
ROWS_PER_SALT = 200_000


def source_name(source: Column) -> Column:
    """A source without outer space and case, its words joined by underscores; null for a blank one."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", "")), r"(?U)[\s\-]+", "_")
    return F.when(bare != "", bare)


def schedule(blocks: list[int]) -> list[tuple[int, int]]:
    """The source and its block in each slot, by earliest deadline among the released, for sources of so many blocks."""
    total, done = sum(blocks), [0] * len(blocks)
    # One entry per source: its next block, waiting for its release or ready for its deadline.
    waiting = [(0, i) for i, n in enumerate(blocks) if n]
    ready: list[tuple[int, int]] = []
    out: list[tuple[int, int]] = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(done[i] + 1) * total // blocks[i]), i))
        _, i = heapq.heappop(ready)
        out.append((i, done[i]))
        done[i] += 1
        if done[i] < blocks[i]:
            heapq.heappush(waiting, (done[i] * total // blocks[i], i))
    return out


def segments(blocks: list[int], size: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """First slot, blocks done before and blocks to do of each source, for every segment of ``size`` slots.

    At every border each source has the whole blocks of its share, or one more; the sources furthest behind get
    those.  No source ever steps back.
    """
    total, done, start = sum(blocks), [0] * len(blocks), 0
    while start < total:
        end = min(total, start + size)
        reached = [max(d, end * n // total) for d, n in zip(done, blocks)]
        behind = sorted(((end * n % total, -i) for i, n in enumerate(blocks) if reached[i] == end * n // total), reverse=True)
        for _, i in behind[: end - sum(reached)]:
            reached[-i] += 1
        yield start, done, [b - a for a, b in zip(done, reached)]
        done, start = reached, end


def _slots(mixes: DataFrame, size: int) -> DataFrame:
    """``mix_name, source, k, slot`` of every block of ``mixes(mix_name, sources, blocks)``, a segment at a time."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for mix, sources, blocks in zip(batch["mix_name"], batch["sources"], batch["blocks"], strict=True):
                for start, done, todo in segments([int(n) for n in blocks], size):
                    yield pd.DataFrame({"mix_name": [mix], "sources": [sources], "start": [start], "done": [done], "todo": [todo]})

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for mix, sources, start, done, todo in zip(*(batch[c] for c in ("mix_name", "sources", "start", "done", "todo")), strict=True):
                who, k = zip(*schedule([int(n) for n in todo]))
                number = [int(done[i]) + j for i, j in zip(who, k)]
                yield pd.DataFrame({"mix_name": mix, "source": [sources[i] for i in who], "k": number, "slot": range(start, start + len(who))})

    cuts = mixes.mapInPandas(cut, "mix_name string, sources array<string>, start long, done array<long>, todo array<long>")
    return cuts.repartition("mix_name", "start").mapInPandas(fill, "mix_name string, source string, k long, slot long")


def quotas(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, int]:
    """Tokens each source contributes.

    Without ``total`` the mix is as large as all sources with documents can keep their shares of, within their
    repeats.  With it, a source that cannot reach its share is used as often as it may be, and the others share the
    rest by their weights.  Sources without documents contribute nothing.
    """
    able = {s: (Fraction(w).limit_denominator(10**9), r) for s, (w, r) in targets.items() if sizes.get(s, 0) > 0 and w > 0 and r > 0}
    if not able:
        return {}
    if total is None:
        whole = sum(w for w, _ in able.values())
        room = min(sizes[s] * r * whole / w for s, (w, r) in able.items())
        return {s: math.floor(room * w / whole) for s, (w, _) in able.items()}
    out: dict[str, int] = {}
    left, open_ = Fraction(total), dict(able)
    while open_:
        whole = sum(w for w, _ in open_.values())
        short = {s for s, (w, r) in open_.items() if sizes[s] * r < left * w / whole}
        if not short:
            out |= {s: math.floor(left * w / whole) for s, (w, _) in open_.items()}
            break
        for s in short:
            out[s] = sizes[s] * open_.pop(s)[1]
            left -= out[s]
    return out


def mix(sized: DataFrame, targets: DataFrame, total: int | str | None, seed: int = 20, block: int = BLOCK, segment: int = SEGMENT) -> DataFrame:
    """Every mix of ``targets(mix_name, source, target_share, max_repeats)`` over ``sized(key, source, n_tokens)``.

    ``mix_name, slot, place, source, key, repeat_no, n_tokens``: read in order of slot and place.  Sources are
    compared by :func:`source_name`.  Documents without source or tokens take no part; a repeated key is a document
    of its own.  Sources that have no documents are left out and the others keep their proportions.  A source's
    contribution ends with the document that reaches its quota.  Targets are few and given; sums per source are all
    the driver holds.  ``total`` is the size of each mix in tokens: ``"held"`` stands for all tokens of the mix's
    sources, None for as many as keep every share exact (see :func:`quotas`).  ``block`` is the number of tokens of a
    block at every size of the corpus; a document belongs to the block it begins in.
    """
    spark = sized.sparkSession
    wanted: dict[str, dict[str, tuple[float, int]]] = {}
    for r in targets.where("mix_name IS NOT NULL AND source IS NOT NULL").select("mix_name", source_name(F.col("source")).alias("source"), "target_share", "max_repeats").collect():
        wanted.setdefault(r.mix_name, {})[r.source] = (r.target_share or 0.0, r.max_repeats or 0)
    named = sized.select("key", source_name(F.col("source")).alias("source"), "n_tokens").where("source IS NOT NULL AND n_tokens > 0")
    docs = Stage(named.where(F.col("source").isin(sorted({s for m in wanted.values() for s in m}))), "mix-docs").df
    # A document's place in its source's line: salts in order of the hash, prefix sums over salts, then inside a salt.
    salts = max(16, docs.count() // ROWS_PER_SALT)
    mark = F.xxhash64(F.lit(seed), "key")
    salted = docs.withColumn("mark", mark).withColumn("salt", F.floor((F.col("mark") / F.lit(2.0**64) + 0.5) * salts).cast("int"))
    sums = Stage(salted.groupBy("source", "salt").agg(F.sum("n_tokens").alias("n")), "mix-sums").df
    sizes = {r.source: r.n for r in sums.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    up_to = W.partitionBy("source").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("source", "salt", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("offset"))
    inside = W.partitionBy("source", "salt").orderBy("mark", "key").rowsBetween(W.unboundedPreceding, -1)
    line = salted.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(offsets, ["source", "salt"])
    line = line.select("source", "key", "n_tokens", (F.col("offset") + F.col("before")).alias("start"))

    mixes, quota_rows = [], []
    for name, target in sorted(wanted.items()):
        size = sum(sizes.get(s, 0) for s in target) if total == "held" else total
        quota = {s: q for s, q in quotas(sizes, target, size).items() if q}
        if quota:
            mixes.append((name, list(quota), [math.ceil(q / block) for q in quota.values()]))
            quota_rows += [(name, s, q, sizes[s], math.ceil(q / sizes[s])) for s, q in quota.items()]
    quota_df = spark.createDataFrame(quota_rows, "mix_name string, source string, quota long, held long, rounds int")
    slots = _slots(spark.createDataFrame(mixes, "mix_name string, sources array<string>, blocks array<long>"), segment)
    # One row per mix and source: a handful.
    copies = line.join(F.broadcast(quota_df), "source").withColumn("repeat_no", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)))
    copies = copies.withColumn("at", F.col("start") + F.col("repeat_no") * F.col("held")).where("at < quota")
    copies = copies.withColumn("k", F.floor(F.col("at") / block))
    return copies.join(slots, ["mix_name", "source", "k"]).select(
        "mix_name", "slot", (F.col("at") - F.col("k") * block).alias("place"), "source", "key", "repeat_no", "n_tokens"
    )


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual share, shortfall, tokens, documents and rounds of every source of every mix."""
    each = mixed.groupBy("mix_name", "source").agg(
        F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"), (F.max("repeat_no") + 1).alias("rounds")
    )
    every = targets.select("mix_name", source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    joined = every.join(each, ["mix_name", "source"], "left").na.fill(0, ["tokens", "rows", "rounds"])
    whole = F.sum("tokens").over(W.partitionBy("mix_name"))
    reached = joined.withColumn("actual_share", F.when(whole > 0, F.round(F.col("tokens") / whole, 6)))
    return reached.withColumn("shortfall", F.round(F.greatest(F.col("target_share") - F.col("actual_share"), F.lit(0.0)), 6))
