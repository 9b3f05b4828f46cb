"""Packing: dominance keeps the optimum, nothing is lost; mixing: shares, caps and deviation."""

from __future__ import annotations

import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from parlance.llm import mixing, packing


def optimum(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + items[i] <= capacity and bins[b] not in bins[:b]:
                bins[b] += items[i]
                go(i + 1, bins)
                bins[b] -= items[i]
        bins.append(items[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0] if items else 0


def histogram(items):
    return {s: items.count(s) for s in set(items)}


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(2, 20), max_size=9))
def test_dominance_keeps_the_optimum(items):
    c = packing.Classes.of(histogram(items))
    fixed = packing.reduce(c, 20)
    rest = [s for s, n in c.count.items() for _ in range(n)]
    assert sum(p.count for p in fixed) + optimum(rest, 20) == optimum(items, 20)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80), st.integers(50, 90))
def test_everything_is_packed(items, capacity):
    got: dict = {}
    for p in packing.solve(histogram(items), capacity):
        assert p.count > 0 and sum(s * k for s, k in p.content) <= capacity
        for s, k in p.content:
            got[s] = got.get(s, 0) + p.count * k
    assert got == histogram(items)


def test_pack_table(spark):
    rng = random.Random(2)
    data = [(i, rng.randint(0, 130), "x") for i in range(400)] + [(1000 + i, 7, "x") for i in range(300)] + [(5, 250, "x"), (None, 9, "x"), (6, None, "x"), (7, 0, "x"), (8, 9, "x"), (8, 9, "x")]
    df = spark.createDataFrame(data, "id long, size long, kind string")
    rows = packing.pack(df, F.col("id"), F.col("size"), {"a": 100, "b": 64}).collect()
    for kind, cap in (("a", 100), ("b", 64)):
        use: dict = {}
        for r in (r for r in rows if r.container_kind == kind):
            use[r.container_no] = use.get(r.container_no, 0) + r.n_tokens
        total = sum(s or 0 for _, s, _ in data)
        assert max(use.values()) <= cap and sum(use.values()) == total and len(use) <= 1.05 * total / cap + 2
        assert set(use) == set(range(len(use)))
        whole = [r for r in rows if r.container_kind == kind and r.key == 5]
        assert max(r.n_tokens for r in whole) == cap or len(whole) > 1
    assert packing.pack(df.limit(0), F.col("id"), F.col("size"), {"a": 100}).count() == 0


def deviation(order, blocks):
    """Furthest any source is from its share over all prefixes; every source's blocks come in their order."""
    total, seen, far = sum(blocks), [0] * len(blocks), 0.0
    for t, (i, k) in enumerate(order, 1):
        assert k == seen[i]
        seen[i] += 1
        far = max(far, *(abs(n - t * b / total) for n, b in zip(seen, blocks)))
    assert seen == blocks
    return far


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=8), st.integers(1, 40))
def test_schedule_deviates_by_less_than_a_block_and_segments_by_less_than_two(blocks, size):
    assert deviation(mixing.schedule(blocks), blocks) < 1
    parts = [(i, done[i] + k) for _, done, todo in mixing.segments(blocks, size) for i, k in mixing.schedule(todo)]
    assert deviation(parts, blocks) < 2
    starts = [s for s, _, _ in mixing.segments(blocks, size)]
    assert starts == list(range(0, sum(blocks), size))


def test_quotas():
    sizes, targets = {"a": 1000, "b": 10, "c": 0}, {"a": (0.5, 1), "b": (0.3, 4), "c": (0.2, 9)}
    assert mixing.quotas(sizes, targets) == {"a": 66, "b": 40}
    assert mixing.quotas(sizes, targets, 500) == {"b": 40, "a": 460}
    assert mixing.quotas(sizes, targets, 5000) == {"b": 40, "a": 1000}
    assert mixing.quotas({}, targets) == {}


def test_mix_table(spark):
    rng = random.Random(4)
    data = [(i, rng.choice(["Big One", "big_one ", "BIG-ONE"]), rng.randint(1, 900), "m") for i in range(600)] + [(1000 + i, "small", 500, "m") for i in range(40)] + [(1, None, 5, "m"), (2, " ", 5, "m"), (3, "small", 0, "m"), (None, "small", 100, "m")]
    df = spark.createDataFrame(data, "key long, source string, n_tokens long, mix_name string")
    targets = spark.createDataFrame([("m", "big_one", 0.7, 1), ("m", "small", 0.2, 3), ("m", "gone", 0.1, 2), (None, "small", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    mixed = mixing.mix(df, targets, None, segment=4)
    rows = mixed.orderBy("slot", "place").collect()
    used: dict = {}
    for r in rows:
        used[(r.source, r.key)] = used.get((r.source, r.key), 0) + 1
    assert max(n for (s, _), n in used.items() if s == "small") <= 3 and max(n for (s, _), n in used.items() if s == "big_one") == 1
    total, so_far, by = sum(r.n_tokens for r in rows), 0, {"big_one": 0, "small": 0}
    for r in rows:
        so_far += r.n_tokens
        by[r.source] += r.n_tokens
        assert abs(by["small"] - so_far * 2 / 9) < 2 * mixing.BLOCK + 1000
    report = {r.source: r.actual_share for r in mixing.shares(mixed, targets).where("mix_name = 'm'").collect()}
    assert report["gone"] == 0.0 and abs(report["small"] - 2 / 9) < 0.02 and total > 0
    assert mixing.mix(df.limit(0), targets, "held").count() == 0 and mixing.mix(df, targets.limit(0), "held").count() == 0
