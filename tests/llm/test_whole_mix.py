"""The mixes of the queries use their sources as far as shares and repeats allow."""

from __future__ import annotations

from parlance.llm import queries


def test_a_tiny_source_does_not_shrink_the_mix(spark, tmp_path):
    docs = [(i, f"word{i} " * 200, ("a", "b")[i % 2]) for i in range(200)] + [(999, "one short text", "tiny")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    targets = [("m", "a", 0.5, 2), ("m", "b", 0.3, 1), ("m", "tiny", 0.2, 4)]
    spark.createDataFrame(targets, "mix_name string, source string, target_share double, max_repeats int").write.parquet(str(tmp_path / "mix_targets.parquet"))
    got = {r.source: r for r in queries.p8_shares(spark, str(tmp_path)).collect()}
    exact = {r.source: r for r in queries.p8_shares_exact(spark, str(tmp_path)).collect()}
    assert got["tiny"].rounds == 4 and got["tiny"]["rows"] == 4 and got["tiny"].shortfall > 0.19 and got["a"].shortfall == 0
    assert got["a"].rounds == 2 and got["a"]["rows"] > 100 and got["b"]["rows"] > 70
    assert sum(r["rows"] for r in exact.values()) < 20
