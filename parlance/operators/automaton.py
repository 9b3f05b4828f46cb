"""Sequential folds over a conversation whose state takes few values, run in parallel over blocks of turns.

A block maps every state it could be entered in to the state it leaves; chaining these maps gives the entry state of
each block, and then all blocks can be replayed at once.  A task holds a bounded number of turns, however long the
conversation is.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

BLOCK = 1024
#: From states and symbols of turns to the new states and whether a new unit begins with the turn; arrays that broadcast.
Step = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _padded(symbols: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """A row of symbols per block, and which of its places are there."""
    sizes = symbols.map(len).to_numpy()
    there = np.arange(sizes.max(initial=0)) < sizes[:, None]
    out = np.zeros(there.shape, dtype=np.int64)
    if len(sizes):
        out[there] = np.concatenate(list(symbols))
    return out, there


def starts(turns: DataFrame, states: int, step: Step) -> DataFrame:
    """``conv, idx, fresh``: whether a unit begins at the turn.  ``turns(conv, idx, symbol)``; state 0 is the first.

    ``idx`` counts from 0 without holes.  An empty input gives an empty result.
    """
    blocks = turns.groupBy("conv", F.floor(F.col("idx") / BLOCK).alias("block")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "symbol"))), lambda s: s.getField("symbol")).alias("symbols")
    )

    @F.pandas_udf("array<int>")
    def through(symbols: pd.Series) -> pd.Series:
        x, there = _padded(symbols)
        s = np.broadcast_to(np.arange(states), (len(x), states))
        for i in range(x.shape[1]):
            s = np.where(there[:, i, None], step(s, x[:, i, None])[0], s)
        return pd.Series(list(s.astype(np.int32)))

    @F.pandas_udf("array<boolean>")
    def replay(symbols: pd.Series, entry: pd.Series) -> pd.Series:
        x, there = _padded(symbols)
        s, out = entry.to_numpy(np.int64), np.zeros(x.shape, dtype=bool)
        for i in range(x.shape[1]):
            s, out[:, i] = step(s, x[:, i])
        return pd.Series([row[: n] for row, n in zip(out, there.sum(axis=1), strict=True)])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        state, entry = 0, []
        for table in pdf["map"]:
            entry.append(state)
            state = int(table[state])
        return pd.DataFrame({"conv": pdf["conv"], "block": pdf["block"], "entry": entry})

    # Only conversations of several blocks need chaining; one row per block takes part.
    long = turns.where(F.col("idx") == BLOCK).select("conv")
    maps = blocks.join(long, "conv", "left_semi").select("conv", "block", through("symbols").alias("map"))
    entries = maps.groupBy("conv").applyInPandas(chain, "conv string, block long, entry int")
    placed = blocks.join(entries, ["conv", "block"], "left").withColumn("entry", F.coalesce("entry", F.lit(0)))
    flags = placed.select("conv", "block", F.posexplode(replay("symbols", "entry")).alias("at", "fresh"))
    return flags.select("conv", (F.col("block") * BLOCK + F.col("at")).alias("idx"), "fresh")


def packing_step(target: int) -> tuple[int, Step]:
    """Greedy packing: a unit is closed before an item that would exceed the target, unless it is empty.

    States: 0 is before the first item, s + 1 a unit holding s.  What is held is capped just above the target: there
    any next item closes the unit.
    """

    def step(s: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held = s - 1
        fresh = (s == 0) | (held + size > target)
        return np.minimum(np.where(fresh, size, held + size), target + 1) + 1, fresh

    return target + 3, step


def chunking_step(size: int) -> tuple[int, Step]:
    """Chunks of ``size`` turns whose end is put off while a turn lies inside an episode (symbol 1).

    States: 0 is before the first turn, s the number of turns in the current chunk, ``size`` also if it is overdue.
    """

    def step(s: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fresh = (s == 0) | ((s == size) & (inside == 0))
        return np.where(fresh, 1, np.minimum(s + 1, size)), fresh

    return size + 1, step
