"""Filling containers of fixed capacity: dominance reduction, then best fit, on the histogram of sizes.

Sizes are whole numbers up to the capacity, so an instance of any number of items is a histogram of at most that many
classes.  The solver works on classes: a step fixes a whole batch of equal containers at once.  Items find their
container by their rank among the items of their size, and ranks are computed in salted groups.

Dominance (after Martello and Toth): a set of items around an item j can be fixed as a container if every other set
that j could be packed with can be exchanged against it without needing more containers.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from parlance.session import Stage

#: Items of one size and salt; the number of salts follows from the number of items.
ROWS_PER_SALT = 200_000
#: Every item is packed once for each capacity, and these few rows are sent to all tasks.
MOST_KINDS = 100


@dataclass
class Pattern:
    """``count`` equal containers, each with ``content``: (size, copies)."""

    count: int
    content: list[tuple[int, int]]
    rule: str


@dataclass
class Classes:
    """A multiset of sizes as sorted distinct sizes with counts."""

    count: dict[int, int] = field(default_factory=dict)
    sizes: list[int] = field(default_factory=list)

    @classmethod
    def of(cls, histogram: dict[int, int]) -> Classes:
        kept = {s: n for s, n in histogram.items() if n > 0}
        return cls(kept, sorted(kept))

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            del self.sizes[bisect.bisect_left(self.sizes, size)]

    def largest(self, limit: int) -> int | None:
        """The largest size up to ``limit``."""
        i = bisect.bisect_right(self.sizes, limit) - 1
        return self.sizes[i] if i >= 0 else None

    def smallest(self, n: int, above: int = 0) -> list[int]:
        """The ``n`` smallest items above a size, copies included."""
        out: list[int] = []
        for i in range(bisect.bisect_right(self.sizes, above), len(self.sizes)):
            out += [self.sizes[i]] * min(self.count[self.sizes[i]], n - len(out))
            if len(out) == n:
                break
        return out

    def best_pair(self, limit: int) -> int:
        """The largest sum up to ``limit`` of two items; 0 if no two fit."""
        best, lo, hi = 0, 0, len(self.sizes) - 1
        while lo <= hi:
            a, b = self.sizes[lo], self.sizes[hi]
            if a + b > limit or (lo == hi and self.count[a] < 2):
                hi -= 1
            else:
                best = max(best, a + b)
                lo += 1
        return best


def dominating(c: Classes, j: int, capacity: int) -> tuple[list[int], str] | None:
    """The partners with which an item of size ``j`` (already taken out of ``c``) can be fixed, and the rule.

    1. Nothing fits beside j: alone.
    2. The largest fitting r fills the container: whatever else j could have fits into r's place.
    3. Only one item fits beside j: the largest, as any other can be swapped with it.
    4. At most two fit.  If no pair exceeds r, r: a pair fits into r's place.  If every pair is in its larger part at
       most r and in its smaller part at most b, the largest beside r: r and b, swapped part by part.
    """
    room = capacity - j
    r = c.largest(room)
    if r is None:
        return [], "alone"
    if r == room:
        return [r], "full"
    low = c.smallest(3)
    if len(low) < 2 or low[0] + low[1] > room:
        return [r], "single"
    if len(low) < 3 or sum(low) > room:
        if c.best_pair(room) <= r:
            return [r], "pair"
        c.take(r, 1)
        b = c.largest(room - r)
        c.count[r] = c.count.get(r, 0) + 1
        if c.count[r] == 1:
            bisect.insort(c.sizes, r)
        if b is not None:
            over = c.smallest(2, above=b)
            if len(over) < 2 or sum(over) > room:
                return [r, b], "both"
    return None


def reduce(c: Classes, capacity: int) -> list[Pattern]:
    """Fix every dominating set, largest items first, until none is left; ``c`` keeps the rest."""
    fixed: list[Pattern] = []
    again = True
    while again:
        again = False
        for j in reversed(list(c.sizes)):
            while c.count.get(j):
                c.take(j, 1)
                found = dominating(c, j, capacity)
                if found is None:
                    if j in c.count:
                        c.count[j] += 1
                    else:
                        c.count[j] = 1
                        bisect.insort(c.sizes, j)
                    break
                partners, rule = found
                need: dict[int, int] = {}
                for s in (j, *partners):
                    need[s] = need.get(s, 0) + 1
                # Taking items away only makes the smallest larger and pairs fewer, so the rule holds for as many equal
                # sets as there are items; j itself was taken once above.
                n = min((c.count.get(s, 0) + (s == j)) // k for s, k in need.items())
                for s, k in need.items():
                    c_n = n * k - (s == j)
                    if c_n:
                        c.take(s, c_n)
                fixed.append(Pattern(n, sorted(need.items(), reverse=True), rule))
                again = True
    return fixed


def best_fit(c: Classes, capacity: int) -> list[Pattern]:
    """Best fit, largest first, a class at a time; groups of equal containers are kept by their room."""
    groups: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    rooms: list[int] = []

    def put(room: int, n: int, content: list[tuple[int, int]]) -> None:
        if room not in groups:
            groups[room] = []
            bisect.insort(rooms, room)
        groups[room].append((n, content))

    for s in reversed(c.sizes):
        left = c.count[s]
        while left:
            i = bisect.bisect_left(rooms, s)
            if i == len(rooms):
                per = capacity // s
                bins, rest = divmod(left, per)
                if bins:
                    put(capacity - per * s, bins, [(s, per)])
                if rest:
                    put(capacity - rest * s, 1, [(s, rest)])
                break
            room = rooms[i]
            n, content = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(i)
            # A container that has got one item of this size is the tightest for the next one, until none fits.
            per = room // s
            bins = min(n, left // per)
            if bins:
                put(room - per * s, bins, [*content, (s, per)])
                left -= bins * per
            n -= bins
            if n and left and left < per:
                put(room - left * s, 1, [*content, (s, left)])
                left, n = 0, n - 1
            if n:
                put(room, n, content)
    return [Pattern(n, content, "best fit") for held in groups.values() for n, content in held]


def solve(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Containers for a histogram of sizes between 1 and the capacity."""
    c = Classes.of(histogram)
    fixed = reduce(c, capacity)
    return fixed + best_fit(c, capacity)


@dataclass
class Slots:
    """Where the items of one size go: item ``rank`` of range i is in container ``first[i] + (rank - start[i]) // copies[i]``."""

    start: np.ndarray
    first: np.ndarray
    copies: np.ndarray


def slots(patterns: list[Pattern]) -> dict[int, Slots]:
    used: dict[int, int] = {}
    raw: dict[int, list[tuple[int, int, int]]] = {}
    number = 0
    for p in patterns:
        for s, k in p.content:
            raw.setdefault(s, []).append((used.get(s, 0), number, k))
            used[s] = used.get(s, 0) + p.count * k
        number += p.count
    return {s: Slots(*(np.array(x, dtype=np.int64) for x in zip(*rows))) for s, rows in raw.items()}


def pack(sized: DataFrame, key: Column, size: Column, capacities: dict[str, int]) -> DataFrame:
    """A container for every item: ``container_kind, container_no, key, piece_no, n_tokens``.

    An item above the capacity is split into full pieces and a remainder; all others stay whole.  Items of size 0 or
    null need no container and give no row; null keys are packed like any other, repeated keys are items of their
    own.  Ties among equal sizes go by the key.  The capacities are few and given, and the plan that is sent to the
    tasks has at most as many entries as sizes up to the capacity have partners; it does not grow with the items.
    """
    spark = sized.sparkSession
    if len(capacities) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} capacities")
    kinds = spark.createDataFrame(sorted(capacities.items()), "kind string, capacity long")
    base = sized.select(key.alias("key"), size.cast("long").alias("size")).where("size > 0")
    whole = F.floor(F.col("size") / F.col("capacity"))
    pieces = base.crossJoin(F.broadcast(kinds)).select(
        "kind", "key", "capacity",
        F.explode(F.when(F.col("size") <= F.col("capacity"), F.array(F.struct(F.lit(0).alias("no"), F.col("size").alias("n")))).otherwise(
            F.transform(
                F.sequence(F.lit(0), F.ceil(F.col("size") / F.col("capacity")).cast("int") - 1),
                lambda i: F.struct(i.alias("no"), F.when(i < whole, F.col("capacity")).otherwise(F.col("size") - whole * F.col("capacity")).alias("n")),
            )
        )).alias("piece"),
    ).select("kind", "key", F.col("piece.no").alias("piece_no"), F.col("piece.n").alias("n"))
    items = Stage(pieces, "pack-items").df
    salts = max(8, items.count() // ROWS_PER_SALT)
    salted = items.withColumn("salt", F.pmod(F.xxhash64("key", "piece_no"), F.lit(salts)).cast("int"))
    counts = Stage(salted.groupBy("kind", "n", "salt").agg(F.count("*").alias("m")), "pack-counts").df
    # One row per capacity and size: bounded by the capacities.
    histogram: dict[str, dict[int, int]] = {k: {} for k in capacities}
    for r in counts.groupBy("kind", "n").agg(F.sum("m").alias("m")).collect():
        histogram[r.kind][r.n] = r.m
    plan = spark.sparkContext.broadcast({k: slots(solve(h, capacities[k])) for k, h in histogram.items()})
    before = W.partitionBy("kind", "n").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("m").over(before), F.lit(0))).select("kind", "n", "salt", "offset")
    place = F.row_number().over(W.partitionBy("kind", "n", "salt").orderBy("key", "piece_no"))
    ranked = salted.withColumn("place", place).join(offsets, ["kind", "n", "salt"])
    ranked = ranked.select("kind", "key", "piece_no", "n", (F.col("offset") + F.col("place") - 1).alias("rank"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            number = np.zeros(len(batch), dtype=np.int64)
            for (kind, n), at in batch.groupby(["kind", "n"], sort=False).indices.items():
                s, rank = plan.value[kind][n], batch["rank"].to_numpy()[at]
                i = np.searchsorted(s.start, rank, "right") - 1
                number[at] = s.first[i] + (rank - s.start[i]) // s.copies[i]
            out = batch[["kind", "key", "piece_no", "n"]].copy()
            out.insert(1, "number", number)
            yield out

    kind_of = ranked.schema["key"].dataType.simpleString()
    out = ranked.mapInPandas(run, f"kind string, number long, key {kind_of}, piece_no int, n long")
    return out.toDF("container_kind", "container_no", "key", "piece_no", "n_tokens")
