"""Stages are written, read again, and removed with their scope."""

from __future__ import annotations

import os

from parlance.session import Stage, forget, stages


def _there(stage):
    return os.path.isdir(stage.path.removeprefix("file:").replace("//", "/"))


def test_scopes(spark):
    df = spark.range(5)
    outer = Stage(df, "outer")
    with stages():
        a = Stage(df, "a")
        with stages():
            b = Stage(df, "b")
            assert b.df.count() == 5
        assert _there(a) and not _there(b)
    assert _there(outer) and not _there(a) and outer.df.count() == 5
    forget(spark)
    assert not _there(outer)
