"""The diversity of a scene counts all its words."""

from __future__ import annotations

import pytest

from parlance.operators import models


def test_words_beyond_510_count(spark):
    text = " ".join(["same"] * 510 + [f"w{i}" for i in range(490)])
    df = spark.createDataFrame([(1, text)], "k int, text string")
    r = models.token_diversity(df, ["k"], "text").first()
    v = models.HashEncoder().tokens(text).astype(float)
    s = v.sum(axis=0)
    assert r.n_tokens == 1000 and r.diversity == pytest.approx(1 - (s @ s - 1000) / (1000 * 999), abs=1e-6)
    assert models.token_diversity(df, ["k"], "text", most=510).first().n_tokens == 510
