"""Time-gap sessions against a plain loop, and the special cases of their inputs."""

from __future__ import annotations

import datetime as dt

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from parlance.operators.sessions import gap_sessions, handle

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "who string, at timestamp_ntz, camp string, msg long, user string, n_events int"


def rows(*events):
    return [(w, None if m is None else T0 + dt.timedelta(minutes=m), "c", i, "x", 7) for i, (w, m) in enumerate(events)]


def run(spark, data, chunk_days=1):
    df = spark.createDataFrame(data, SCHEMA)
    out = gap_sessions(df, handle(F.col("who")), F.col("at"), (F.col("camp"), F.col("msg")), chunk_days=chunk_days)
    return sorted((r.user, r.started_at, r.ended_at, r.n_events, r.duration_seconds) for r in out.collect())


def loop(data):
    out, seen = [], set()
    for w, at, camp, msg, *_ in sorted((r for r in data if r[0] and r[0].strip() and r[1]), key=lambda r: (r[0].strip().lower(), r[1])):
        if (w.strip().lower(), at, camp, msg) in seen:
            continue
        seen.add((w.strip().lower(), at, camp, msg))
        u = w.strip().lower()
        if out and out[-1][0] == u and at - out[-1][2] <= dt.timedelta(hours=6):
            out[-1] = (u, out[-1][1], at, out[-1][3] + 1)
        else:
            out.append((u, at, at, 1))
    return sorted((u, b, e, n, int((e - b).total_seconds())) for u, b, e, n in out)


def test_edges_of_the_gap(spark):
    data = rows(("a", 0), ("a", 360), ("a", 721), ("A ", 722), ("b", 0))
    assert run(spark, data) == loop(data)
    assert [r[3] for r in run(spark, data)] == [2, 2, 1]


def test_sessions_over_many_chunks(spark):
    data = rows(*[("a", 300 * i) for i in range(40)], *[("b", 500 * i) for i in range(20)], ("c", 1439), ("c", 1441))
    for days in (1, 2, 365):
        assert run(spark, data, days) == loop(data)


def test_repeated_loads_count_once(spark):
    one = rows(("a", 0), ("a", 10))
    assert run(spark, one + one) == run(spark, one)


def test_nulls_blanks_and_empty(spark):
    data = rows((None, 0), ("  ", 0), ("a", None), ("\t", 3))
    assert run(spark, data) == []
    assert run(spark, []) == []


def test_null_identity_stands_for_itself(spark):
    data = [("a", T0, None, None, "x", 1), ("a", T0, None, None, "x", 1)]
    assert run(spark, data)[0][3] == 2


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "B", " b", None]), st.integers(0, 6000)), max_size=60))
def test_any_events(spark, events):
    data = rows(*events)
    assert run(spark, data) == loop(data)
