"""Spellings of names: forms, similarity, recall of the bands, and linked pairs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from parlance.llm import names as N


@pytest.mark.parametrize("spelling", ["Kaelen Stagbrook", "KAELEN  STAGBROOK", "Stagbrook, Kaelen", "Brother Kaelen Stagbrook", "Kaelen-Stagbrook", "kaelen_stagbrook", "KaelenStagbrook", "Stagbrook Kaelen", "Kaelen Stagbrook the Bold", "Kaelen Stagbrook of the Fens", "Capt. Kaelén Stagbrook"])
def test_one_form(spelling):
    assert N.tokens(spelling) == ["kaelen", "stagbrook"]


def test_edits():
    assert all(N.edits(a, "stagbrook", 2) == 1 for a in ("stagbroook", "stagbrok", "stagbrpok", "satgbrook"))
    assert N.edits("stagbrook", "stagbrook", 2) == 0 and N.edits("stgbrok", "stagbrook", 2) == 2 and N.edits("", "stagbrook", 2) == 3


def similar(a, b, da=None, db=None, short=None):
    x, y = N.tokens(a), N.tokens(b)
    names = lambda ts: [(short or {}).get(t, ()) for t in ts]
    return N.monge_elkan(x, y, da or [1] * len(x), db or [1] * len(y), names(x), names(y))


def test_similarity():
    assert similar("Kaelen Stagbrook", "K. Stagbrook") > 0.8 and similar("Kaelen Stagbrook", "Kaelen S.") > 0.8
    assert similar("Kaelen Stagbrook", "Ser Stagbrook") == 1.0 and similar("Kaelen Stagbrook", "Kaelen Stagbrok") > similar("Kaelen Stagbrook", "Kaelen Stgbrok") > 0.8
    assert similar("Wendy Ravenmere", "Gwendra Ravenmere", short={"wendy": ("gwendra",)}) > 0.8
    assert similar("Aldous Galeshaw", "Emberly Galeshaw") == 0.0
    assert similar("Kaelen Galeshaw", "Kaelin Galeshaw", [50, 9], [60, 9]) == 0.0
    assert similar("K. S.", "Kaelen Stagbrook") == 0.0 and similar("", "Kaelen") == 0.0


FIRST, LAST = ("kael", "dorr", "wren", "ysol"), ("brook", "thorne", "field", "mere", "gate")
WHOLE = [f"{a}{x} {b}{y}" for a in FIRST for x in ("en", "un", "na") for b in ("stag", "glas", "moss") for y in LAST]
SINGLE = [f"{a}{y}" for a in ("stag", "glas", "moss", "win", "alder") for y in LAST]
SHORT = ["kira", "orin", "dain", "mott", "elsa", "tove", "bran", "sigi", "perr", "ulma", "hugo", "nell", "kip", "ana", "tomas", "rowen", "lysa", "gerd", "wilm", "jorun"]


def typos(name):
    """One error in every place: left out, doubled, replaced, swapped."""
    for i in range(1, len(name)):
        yield name[:i] + name[i + 1 :]
        yield name[:i] + name[i] + name[i:]
        yield name[:i] + "x" + name[i + 1 :]
        yield name[: i - 1] + name[i] + name[i - 1] + name[i + 1 :]


def recall(pairs_, keys):
    pairs_ = [(a, b) for a, b in pairs_ if a != b]
    return sum(bool(set(keys(a)) & set(keys(b))) for a, b in pairs_) / len(pairs_)


def test_band_recall_of_every_kind():
    bands = N.Bands()
    whole = lambda s: bands.of_name(s.split())
    assert recall([(n, n[:2] + n[3:]) for n in WHOLE], whole) >= 0.97
    assert recall([(n, n.replace("br", "b").replace("th", "t").replace("ie", "ei")[1:]) for n in WHOLE], whole) >= 0.9
    assert recall([(n, t) for n in SINGLE for t in typos(n)], bands.of_token) >= 0.97
    # A swap in a name of three or four letters leaves one or two of its q-grams.
    assert recall([(n, t) for n in SHORT for t in typos(n) if len(t) > 2], bands.of_token) >= 0.9
    shortened = [(n, n[:k]) for n in SINGLE for k in range(2, len(n))]
    keys = lambda s: {k for k, _ in bands.keys([s], [()])}
    assert recall(shortened, keys) >= 0.97
    nick = lambda s: {k for k, _ in bands.keys([s], [("gwendra",) if s == "wendy" else ()])}
    assert nick("wendy") & nick("gwendra")
    assert N.bands_for(2, 0.5, 0.9) == 9


def test_stars_of_a_long_chain_and_of_a_large_bucket(spark, monkeypatch):
    links = [(i, i + 1) for i in range(10)]
    rows = [(a, b, (a,), (b,)) for a, b in links + [(b, a) for a, b in links]]
    edges = spark.createDataFrame(rows, "a long, b long, ra struct<r: long>, rb struct<r: long>")
    # The highest form is a centre, the next its satellite, and so on down the chain, a round for each.
    assert {r.id for r in N._satellites(edges).collect()} == {9, 7, 5, 3, 1}
    monkeypatch.setattr(N, "BUCKET_PART", 7)
    monkeypatch.setattr(N, "MOST_SPLIT", 1)
    bucket = spark.createDataFrame([(i, 5 if i % 2 else 6, None if i % 2 else i % 4 == 0) for i in range(60)], "id long, key long, full boolean")
    large, bound = N._large(bucket, "key", 7)
    assert sorted((r.key, r.n) for r in large.collect()) == [(5, 30), (6, 30)] and bound == 7
    got = sorted((r.a, r.b) for r in N._candidates(bucket, large, bound).collect())
    odd, short = [i for i in range(60) if i % 2], [i for i in range(60) if i % 4 == 2]
    want = {(a, b) for a in odd for b in odd if a < b} | {(min(a, b), max(a, b)) for a in short for b in range(0, 60, 2) if a != b}
    assert got == sorted(want)


def pairs(spark, spelled, corrections=()):
    rows = [(i, "c", c, m, p, 1) for i, (c, m, p) in enumerate(spelled)]
    df = spark.createDataFrame(rows, "row_id long, campaign_id string, character string, name_mentions array<string>, player string, entity int")
    fix = spark.createDataFrame(list(corrections), "campaign_id string, old_name string, new_name string")
    return sorted((r.name_a, r.name_b) for r in N.variant_pairs(df, fix).collect())


def test_pairs(spark):
    spelled = [("Kaelen Stagbrook", ["Aldous Galeshaw", "Emberly Galeshaw", None, " "], "p1")] * 3 + [("kaelen stagbrook", None, "p1"), ("Emberly Galeshaw", [], "p3"), ("Ser Galeshaw", [], "p3"), ("Aldous Galeshaw", [], "p2"), ("Dungeon Mster", [], "g"), ("GM", [], "g"), ("Dice Roller", [], None), (None, None, None), ("", [], "p")]
    got = pairs(spark, spelled)
    assert got == [("Dungeon Mster", "GM"), ("Emberly Galeshaw", "Ser Galeshaw"), ("Kaelen Stagbrook", "kaelen stagbrook")]


def test_nicknames_from_corrections(spark):
    fix = [("x", "Wendy Palemoor", "Gwendra Palemoor"), ("y", None, "Z"), ("y", "Gwendraa Palemoor", "Gwendra Palemoor")]
    assert pairs(spark, [("Wendy Ravenmere", [], "p"), ("Gwendra Ravenmere", [], "q")], fix) == [("Gwendra Ravenmere", "Wendy Ravenmere")]
    assert pairs(spark, [], fix) == []
    # Every correction counts, however many there are.
    many = fix + [("x", f"Q{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}k Palemoor", f"Q{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}korvald Palemoor") for i in range(3000)]
    assert N.nicknames(spark.createDataFrame(many, "c string, o string, n string"), F.col("o"), F.col("n")).count() == 3001
    long = "Wendy " + "x" * 20_000
    assert pairs(spark, [(long, [long.lower()], "p")], fix) == [(long, long.lower())]
