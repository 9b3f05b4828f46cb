"""Annotator families from request to summary, stored answers, cached vectors, and the order of a campaign that is large."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from parlance import api
from parlance.config import Settings
from parlance.operators import families as Fa, models as Mo
from parlance.operators.order import large, once, with_turns
from parlance.operators.sessions import gap_sessions

TURNS = "campaign_id string, turn_idx long, player string, character string, text string"


class Script:
    """Answers by the first line of the request."""

    def __init__(self, **answers):
        self.answers = answers

    def answer(self, prompts):
        return [next(a(p) if callable(a) else a for k, a in self.answers.items() if p.startswith(k)) for p in prompts]


def turns(spark, n=10, campaign="c"):
    return spark.createDataFrame([(campaign, i, f"p{i % 2}", f"C{i % 2}" if i else None, f"text {i}") for i in range(n)], TURNS)


def test_humor(spark):
    lists = "TURN 2: a joke\nover two lines\nTURN 3: again TURN 5: late\nTURN 99: outside"
    make = lambda: Script(List=lists, Answer="TURN 3: CALLBACK\nTURN 5: callback", Rate="Originality: 4 of 5")
    found = Fa.analyze(turns(spark), Fa.FAMILIES["humor"], make, Settings(chunk_turns=3))
    eps = {r.start_turn: r for r in found.episodes.collect()}
    assert {k: (r.end_turn, r.turn_count, r.kind, r.rating, r.participants) for k, r in eps.items()} == {2: (3, 2, "ORIGIN", 4.0, "C0|C1"), 5: (5, 1, "CALLBACK", 4.0, "C1")}
    assert eps[2].description == "a joke\nover two lines" and eps[2].episode_text.split("\n") == ["Turn 2 - C0: text 2", "Turn 3 - C1: text 3"]
    s = found.summary.first()
    assert (s.episodes, s.n_origin, s.n_callback, s.mean_rating) == (2, 1, 1, 4.0)
    # The first chunk waits for the episode across its border.
    assert [(r.start, r.end, r.episodes, r.turns) for r in found.chunks.orderBy("start").collect()] == [(0, 4, 1, 2), (4, 7, 1, 1), (7, 10, 0, 0)]


@pytest.mark.parametrize("name", list(Fa.FAMILIES))
def test_no_findings_and_no_turns(spark, name):
    family = Fa.FAMILIES[name]
    found = Fa.analyze(turns(spark), family, lambda: Script(List=f"Well: {family.none}."))
    s = found.summary.first()
    assert s.episodes == 0 and s.mean_proportion == 0.0 and found.episodes.count() == 0
    if name != "norms":
        return
    assert s.norms == 0 and found.norms.count() == 0
    assert Fa.analyze(turns(spark).limit(0), family, lambda: Script()).summary.count() == 0


def test_norms_are_linked(spark):
    lists = "TURN 1 [following]: no shouting\nTURN 2 [violating]: he shouts TURN 5 [enforcing]: told off\nTURN 7 [dreaming]: not one of the types"
    told = lambda p: "Type: violating\nExplicit: yes\nNorm: Keep your voice down" if "Turn 1" in p else "Norm: keep your voice down, please"
    found = Fa.analyze(turns(spark), Fa.FAMILIES["norms"], lambda: Script(List=lists, Type=told))
    assert [(r.start_turn, r.episode_type, r.is_explicit, r.norm_id) for r in found.episodes.orderBy("start_turn").collect()] == [(1, "violating", True, "norm_1"), (5, "enforcing", False, "norm_1")]
    n = found.norms.first()
    assert (n.episodes, n.is_explicit, n.times_violated, n.times_enforced, n.description) == (2, True, 1, 1, "keep your voice down, please")


def test_stored_answers_are_used_and_the_rest_asked_once(spark, tmp_path):
    log = tmp_path / "log"

    def make():
        return Script(q=lambda p: log.open("a").write(p + "\n") and f"new {p}")

    requests = spark.createDataFrame([(1, "q1"), (2, "q2"), (3, "q2"), (4, None)], "id int, prompt string").where("id < 4")
    key = requests.select(F.sha2(F.concat_ws("|", F.lit("s"), "prompt"), 256).alias("request_key"), F.lit("old").alias("response")).where("prompt = 'q1'")
    got = {r.id: r.response for r in Mo.annotate(requests, "prompt", make, "s", stored=key.unionByName(key)).collect()}
    assert got == {1: "old", 2: "new q2", 3: "new q2"} and log.read_text() == "q2\n"


def test_cached_vectors(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, " "), (5, "c")], "id int, text string")
    folder = str(tmp_path / "v")
    first = {r.id: list(r.vector) for r in Mo.embed_cached(df.where("id < 5"), "text", "m", folder).collect()}
    both = {r.id: list(r.vector) for r in Mo.embed_cached(df, "text", "m", folder).collect()}
    plain = {r.id: list(r.vector) for r in Mo.embed(df, "text").collect()}
    assert both == plain and first == {k: v for k, v in plain.items() if k < 5} and spark.read.parquet(folder).count() == 3
    Mo.embed_cached(df, "text", "other", folder)
    assert spark.read.parquet(folder).count() == 6 and Mo.embed_cached(df.limit(0), "text", "m", folder).count() == 0


def test_analyze_asks_only_where_there_is_an_annotator(spark):
    t = turns(spark)
    with pytest.raises(ValueError, match="no annotator for: judge"):
        api.analyze(t, ["judge"])
    overall = "Novelty: 4\nValue: 2\nAdherence: 3\nResonance: 3\n### C1:\n- Novelty: 5\n- Value: N/A\n- Adherence: 1\n- Resonance: 3"
    out = api.analyze(t, ["judge", "conflict"], annotators={"judge": lambda: Script(Rate=overall), "conflict": lambda: Script(List="TURN 3 [DRAMATIC]: x", Rate="none")})
    assert out["judge"]["summary"].first().mean_creativity == 3.0 and out["judge"]["players"].where("player = 'p1'").first().mean_novelty == 5.0
    s = out["conflict"]["summary"].first()
    assert (s.n_dramatic, s.n_player, s.mean_rating) == (1, 0, 3.0)
    assert [r.turn_idx for r in api.campaign_sample(t, "c").collect()] == list(range(10))


MESSAGES = "row_id long, campaign_id string, message_id long, date timestamp_ntz, extra int"


def test_a_large_campaign_inside_a_day_is_split(spark):
    data = [(i, "large" if i % 10 == 0 else f"c{i % 180}", i // 10, None if i % 700 == 0 else i * 7 % 80_000) for i in range(20_000)]
    df = spark.createDataFrame(data, "row_id long, campaign_id string, message_id long, s int").selectExpr(
        "row_id", "campaign_id", "message_id", "timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, 0, 0, s) AS date"
    )
    assert [r.campaign_id for r in large(df, "campaign_id", 1_000).collect()] == ["large"]
    ordered = with_turns(df.unionByName(df), least=1_000)
    sizes = {(r.campaign_id, r.chunk): r.n for r in ordered.groupBy("campaign_id", "chunk").agg(F.count("*").alias("n")).collect()}
    others = sorted(n for (c, _), n in sizes.items() if c != "large")
    assert max(n for (c, _), n in sizes.items() if c == "large") <= 2 * others[len(others) // 2]
    want = {}
    for c in {r[1] for r in data}:
        own = sorted((r for r in data if r[1] == c), key=lambda r: (r[3] is None, r[3] or 0, r[2], r[0]))
        seen, place = set(), 0
        for r in own:
            if (r[2], r[3]) not in seen:
                seen.add((r[2], r[3]))
                want[r[0]] = place
                place += 1
    assert {r.row_id: r.turn_idx for r in ordered.collect()} == want


def test_once_takes_the_first_load(spark):
    df = spark.createDataFrame([(5, "c", 1, None, 7), (2, "c", 1, None, 8), (9, "c", 2, None, None)], MESSAGES)
    assert sorted((r.message_id, r.extra) for r in once(df, ("extra",)).collect()) == [(1, 8), (2, None)]
    assert once(df, ()).count() == 2 and once(df.limit(0), ("extra",)).count() == 0


def test_sessions_do_not_depend_on_the_chunk(spark):
    events = spark.createDataFrame([(f"u{i % 3}", i * i * 977 % 500_000) for i in range(400)], "u string, s int").selectExpr("u", "timestamp_ntz'1969-12-30 00:00:00' + make_dt_interval(0, 0, 0, s) AS t")
    got = [sorted(map(tuple, gap_sessions(events, F.col("u"), F.col("t"), gap_seconds=1800, chunk_days=h / 24).collect())) for h in (1, 5, 720)]
    assert got[0] == got[1] == got[2] and len(got[0]) > 20
