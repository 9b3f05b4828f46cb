"""Variant spellings of names: MinHash banding over padded q-grams, Monge-Elkan verification, star clustering.

Everything happens inside a group (a campaign).  Spellings are reduced to a form: case, accents, separators, order,
titles and epithets are taken away.  Forms with two whole names meet in bands over the q-grams of both; incomplete
forms (a single name, or one with an initial) meet whole ones in bands over the q-grams of single names, and of what
a single name begins with, so that shortened names meet their whole ones.  Candidates are verified token by token; in
the graph of verified links the strongest forms become star centres, and every other form joins its best adjacent
centre.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from parlance.llm.threads import speaker_role
from parlance.session import Stage

#: Forms of address that are no part of a name.
TITLES = frozenset(
    "ser sir lady lord dame captain capt brother sister father mother master mistress mr mrs ms miss dr doctor".split()
)
NGRAM = 2


def bands_for(rows: int, similarity: float, recall: float) -> int:
    """Bands of ``rows`` rows that let pairs of this similarity collide with at least this probability.

    A band collides with probability ``s ** r``, some band of b with ``1 - (1 - s ** r) ** b``.
    """
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


#: Two whole names with a typing error in each share about half of their q-grams; one name with an error about six
#: tenths, one of up to six letters about three tenths.
WHOLE_ROWS, SINGLE_ROWS, SHORT_ROWS = 3, 2, 1
WHOLE_BANDS = bands_for(WHOLE_ROWS, 0.55, 0.97)
SINGLE_BANDS = bands_for(SINGLE_ROWS, 0.6, 0.97)
SHORT_BANDS = bands_for(SHORT_ROWS, 0.33, 0.97)
SHORT_LENGTH = 6
#: A shortened name is compared with beginnings of its own length, up to this one.
LONGEST_SHORT = 7
#: Forms of a bucket that one task pairs with as many others; larger buckets are split into parts.
BUCKET_PART = 2_000
#: No more buckets than this can be that large (see :func:`_large`).
MOST_SPLIT = 10_000

_CAMEL = re.compile(r"(?<=[a-zà-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ])")
_EPITHET = re.compile(r"\s(?:of\s)?the\s.*$|\sof\s.*$|\s*\(.*\)\s*$", re.I)
_BREAKS = re.compile(r"[\s_\-–·/]+")


def plain(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).casefold()


def tokens(spelling: str) -> list[str]:
    """The name's tokens without case, accents, titles and epithets, sorted; single letters are initials."""
    s = spelling.strip()
    if "," in s:
        last, _, first = s.partition(",")
        s = f"{first.strip()} {last.strip()}"
    s = _EPITHET.sub("", " " + s).strip() or s
    if not _BREAKS.search(s):
        s = _CAMEL.sub(" ", s)
    parts = [p for p in (t.strip(".'\"“”()[]") for t in _BREAKS.split(plain(s))) if p]
    while len(parts) > 1 and parts[0] in TITLES:
        parts = parts[1:]
    return sorted(parts)


def grams(token: str) -> set[str]:
    padded = f"^{token}$"
    return {padded[i : i + NGRAM] for i in range(len(padded) - NGRAM + 1)}


_P = np.uint64((1 << 61) - 1)
_RNG = np.random.default_rng(20)
_A = _RNG.integers(1, 1 << 60, 128, dtype=np.uint64)
_B = _RNG.integers(0, 1 << 60, 128, dtype=np.uint64)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=4).digest(), "big")


def band_keys(features: set[str], rows: int, bands: int, space: str, memo: dict[str, int]) -> list[int]:
    """One 64-bit key per band of the MinHash signature of ``features``."""
    for g in features:
        if g not in memo:
            memo[g] = _hash(g)
    base = np.array([memo[g] for g in features], dtype=np.uint64)
    # Multiply-shift hashing: the high bits of a*x + b over 64 bits.
    with np.errstate(over="ignore"):
        sig = ((_A[: rows * bands, None] * (base[None, :] + np.uint64(1)) + _B[: rows * bands, None]) >> np.uint64(31)).min(axis=1)
        sig = sig.reshape(bands, rows)
        key = np.full(bands, _hash(space), dtype=np.uint64)
        for r in range(rows):
            key = (key ^ sig[:, r]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        key = (key + np.arange(bands, dtype=np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return key.view(np.int64).tolist()


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours that separate the two; ``most + 1`` if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def token_similarity(a: str, b: str, da: int, db: int, na: Sequence[str] = (), nb: Sequence[str] = ()) -> float:
    """Similarity of two tokens.

    ``da, db``: in how many groups they occur, for telling a name from a mistyped one; ``na, nb``: the names they may
    be short for.  Typing errors are graded by their number against the length: one in any name of three letters or
    more, two in one of seven or more.
    """
    if a == b:
        return 1.0
    if a in nb or b in na:
        return 0.93
    if len(a) == 1 or len(b) == 1:
        return 0.9 if a[0] == b[0] else 0.0
    short, long, ds, dl = (a, b, da, db) if len(a) < len(b) else (b, a, db, da)
    if long.startswith(short) and ds < 0.5 * max(dl, 2):
        return 0.85
    # Two tokens that are both common are two names, however close their letters.
    established = min(da, db) >= max(3, 0.05 * max(da, db))
    allowed = 0 if len(short) < 3 or established else 1 if len(short) < 7 else 2
    found = edits(a, b, allowed)
    return 1 - found / len(long) if found <= allowed else 0.0


def monge_elkan(
    a: list[str], b: list[str], da: list[int], db: list[int], na: Sequence[Sequence[str]] | None = None, nb: Sequence[Sequence[str]] | None = None
) -> float:
    """Mean of the best similarities of the shorter name's tokens, each matched to another token; 0 if any has none."""
    na, nb = na if na is not None else [()] * len(a), nb if nb is not None else [()] * len(b)
    if len(a) > len(b):
        a, b, da, db, na, nb = b, a, db, da, nb, na
    if not a or max(map(len, a)) == 1 and len(a) > 1:
        return 0.0
    free, total, whole = list(range(len(b))), 0.0, 0.0
    for i in sorted(range(len(a)), key=lambda i: -len(a[i])):
        best, at = 0.0, -1
        for j in free:
            s = token_similarity(a[i], b[j], da[i], db[j], na[i], nb[j])
            if s > best:
                best, at = s, j
        if at < 0:
            return 0.0
        free.remove(at)
        total += best
        if len(a[i]) > 1 and len(b[at]) > 1:
            whole = max(whole, best)
    # Initials alone link nothing: some token must agree as a whole name.
    return total / len(a) if whole or len(a) == 1 else 0.0


def nicknames(corrections: DataFrame, old: Column, new: Column, support: int = 1) -> DataFrame:
    """``token, names``: short forms of given names, read from hand-made corrections that keep the other token.

    A pair counts with at least ``support`` corrections, and if the two have their first letter or two letters in a
    row in common.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for o, n in zip(batch["o"], batch["n"], strict=True):
                a, b = tokens(o), tokens(n)
                rest_a, rest_b = [t for t in a if t not in b], [t for t in b if t not in a]
                if len(a) == len(b) == 2 and len(rest_a) == len(rest_b) == 1:
                    x, y = rest_a[0], rest_b[0]
                    initial = len(x) == 1 and "." in o
                    alike = x[0] == y[0] or any(x[i : i + 2] in y for i in range(len(x) - 1))
                    if not initial and edits(x, y, 1) > 1 and len(x) < len(y) and alike:
                        rows.append((x, y))
            yield pd.DataFrame(rows, columns=["token", "name"])

    pairs = corrections.select(old.alias("o"), new.alias("n")).where("o IS NOT NULL AND n IS NOT NULL")
    counted = pairs.mapInPandas(run, "token string, name string").groupBy("token", "name").count().where(F.col("count") >= support)
    return counted.groupBy("token").agg(F.array_sort(F.collect_set("name")).alias("names"))


def spellings(messages: DataFrame) -> DataFrame:
    """Distinct spellings of ``(campaign_id, character, name_mentions, player)``: ``grp, spelling, n, user, gm``.

    ``user`` is the handle that most often posts under the spelling, null if none does.  Blank and null spellings,
    automatic dice posts and rows without a campaign take no part.
    """
    rows = messages.where("campaign_id IS NOT NULL").select(
        F.col("campaign_id").alias("grp"), "name_mentions", "character", F.lower(F.trim("player")).alias("user")
    )
    posted = rows.groupBy("grp", F.col("character").alias("spelling"), "user").agg(F.count("*").alias("n"))
    named = rows.select("grp", F.explode("name_mentions").alias("spelling")).groupBy("grp", "spelling").agg(F.count("*").alias("n"))
    both = posted.unionByName(named.withColumn("user", F.lit(None).cast("string")))
    both = both.where(F.regexp_replace("spelling", r"(?U)\s+", "") != "")
    role = speaker_role(F.col("spelling"))
    distinct = both.groupBy("grp", "spelling").agg(
        F.sum("n").alias("n"), F.max(F.when(F.col("user") != "", F.struct("n", "user"))).getField("user").alias("user")
    )
    return distinct.withColumn("role", role).where("role <> 'dice'").select("grp", "spelling", "n", "user", (F.col("role") == "gm").alias("gm"))


class Bands:
    """Band keys of forms, with a memo of the tokens seen by this worker."""

    def __init__(self) -> None:
        self.grams: dict[str, int] = {}
        self.single: dict[str, list[int]] = {}

    def of_token(self, t: str) -> list[int]:
        """Keys under which a single name is found."""
        if t not in self.single:
            if len(self.single) > 200_000:
                self.single.clear()
            # Names of the length between have both, as one typing error can lead to either side.
            keys = band_keys(grams(t), SINGLE_ROWS, SINGLE_BANDS, "single", self.grams) if len(t) >= SHORT_LENGTH else []
            if len(t) <= SHORT_LENGTH:
                keys = keys + band_keys(grams(t), SHORT_ROWS, SHORT_BANDS, "short", self.grams)
            self.single[t] = keys
        return self.single[t]

    def beginning(self, t: str) -> int:
        """One key of all q-grams of a name's beginning, in their order: a band of as many rows as it has."""
        return _hash("begin|" + t)

    def of_name(self, parts: list[str]) -> list[int]:
        return band_keys(set().union(*map(grams, parts)), WHOLE_ROWS, WHOLE_BANDS, "whole", self.grams)

    def keys(self, parts: list[str], names: Sequence[Sequence[str]]) -> Iterator[tuple[int, bool | None]]:
        """``(key, full)`` of a form: ``full`` is null for bands over whole names, else tells those from incomplete ones."""
        long = [t for t in parts if len(t) > 1]
        full = len(long) > 1
        for t, known in zip(parts, names, strict=True):
            for x in (*((t,) if len(t) > 1 else ()), *known):
                yield from ((k, full) for k in self.of_token(x))
            # Incomplete forms ask for names that begin as they do; a form that may be asked has a key per beginning.
            for n in range(2, min(len(t), LONGEST_SHORT) + 1):
                yield self.beginning(t[:n]), full or n < len(t)
        if full:
            views = [long] + [[n if x == t else x for x in long] for t, known in zip(parts, names, strict=True) for n in known]
            for v in views:
                yield from ((k, None) for k in self.of_name(v))


def _large(rows: DataFrame, key: str, total: int) -> tuple[DataFrame, int]:
    """``key, n`` of the values of ``key`` with more rows than ``BUCKET_PART`` and than a ten-thousandth of all, and that bound.

    They are fewer than ``MOST_SPLIT``, so they can be sent to every task.
    """
    bound = max(BUCKET_PART, total // MOST_SPLIT)
    return rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > bound), bound


def _candidates(banded: DataFrame, large: DataFrame, bound: int) -> DataFrame:
    """``a, b``: distinct pairs of forms that share a bucket, whole names with whole ones, incomplete ones with all.

    ``large(key, n)`` are the buckets with more than ``bound`` forms; they are paired part by part.
    """
    parts = large.select("key", F.ceil(F.col("n") / bound).cast("int").alias("parts"))
    split = banded.join(F.broadcast(parts), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    # Part (p, q) of a bucket pairs the left forms of part p with the right forms of part q.  Keys of whole names and of
    # single ones are never the same.
    left = split.where("full IS NULL OR NOT full").select("key", F.col("id").alias("a"), F.col("full").isNull().alias("whole"), own.alias("p"), every.alias("q"))
    right = split.select("key", F.col("id").alias("b"), every.alias("p"), own.alias("q"))
    near = left.join(right, ["key", "p", "q"]).where("a < b OR NOT whole AND a <> b")
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _satellites(edges: DataFrame) -> DataFrame:
    """``id`` of the forms that are no star centres, by ``edges(a, b, ra, rb)`` in both directions with both ranks.

    In each round an undecided form above all its undecided neighbours becomes a centre, and its neighbours
    satellites; decided forms and their edges leave.  The highest form of what is left is decided in every round, so
    rounds go on until nothing is left.  A form that loses all its neighbours is a centre.
    """
    found: list[DataFrame] = []
    left = Stage(edges, "names-open")
    while not left.df.isEmpty():
        top = left.df.groupBy("a").agg(F.max("rb").alias("top"), F.max("ra").alias("ra"))
        chosen = Stage(top.where(F.col("ra") > F.col("top")).select("a"), "names-centres")
        hit = left.df.join(chosen.df.select(F.col("a").alias("b")), "b", "left_semi").select("a").distinct()
        hit = Stage(hit, "names-satellites")
        gone = chosen.df.unionByName(hit.df)
        after = left.df.join(gone, "a", "left_anti").join(gone.select(F.col("a").alias("b")), "b", "left_anti")
        after = Stage(after.select("a", "b", "ra", "rb"), "names-open")
        chosen.drop()
        left.drop()
        found.append(hit.df)
        left = after
    left.drop()
    out = edges.select(F.col("a").alias("id")).limit(0)
    for hit in found:
        out = out.unionByName(hit.select(F.col("a").alias("id")))
    return out


def link(spelled: DataFrame, nick: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Entities of the spellings of each group: ``grp, spelling, entity``.

    ``spelled`` is as :func:`spellings` gives it, ``nick`` as :func:`nicknames`.  The titles of a game master are one
    entity.  Every spelling gets exactly one entity, its own if nothing matches.  Repeated rows and ties are settled
    by count and then by the alphabet, so the result does not depend on the order of rows.
    """

    @F.pandas_udf("array<string>")
    def parsed(s: pd.Series) -> pd.Series:
        return s.map(tokens)

    split = Stage(spelled.withColumn("tokens", F.when(~F.col("gm"), parsed("spelling"))), "names-spellings")
    form = F.when(F.col("gm"), F.lit("#")).otherwise(F.concat_ws(" ", "tokens"))
    base = split.df.withColumn("form", form)
    forms = base.where(~F.col("gm")).groupBy("grp", "form").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", "user")).getField("user").alias("user"), F.first("tokens").alias("tokens")
    )
    spread = forms.select(F.explode("tokens").alias("token"), "grp").groupBy("token").agg(F.count_distinct("grp").alias("df"))
    known = spread.join(nick, "token", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    counted = (
        forms.select("grp", "form", F.explode("tokens").alias("token")).join(known, "token")
        .groupBy("grp", "form").agg(F.map_from_entries(F.collect_set(F.struct("token", F.struct("df", "names")))).alias("of"))
    )
    forms = forms.join(counted, ["grp", "form"]).select(
        F.xxhash64("grp", "form").alias("id"), "grp", "form", "n", "user", "tokens",
        F.transform("tokens", lambda t: F.col("of")[t]["df"]).alias("dfs"), F.transform("tokens", lambda t: F.col("of")[t]["names"]).alias("names"),
    )
    forms_at = Stage(forms, "names-forms")

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands = Bands()
        for batch in batches:
            ids, grps, out, whole = [], [], [], []
            for i, g, ts, ns in zip(batch["id"], batch["grp"], batch["tokens"], batch["names"], strict=True):
                for k, full in bands.keys(list(ts), [tuple(n) for n in ns]):
                    ids.append(i)
                    grps.append(g)
                    out.append(k)
                    whole.append(full)
            yield pd.DataFrame({"id": ids, "grp": grps, "key": out, "full": pd.array(whole, dtype="boolean")})

    named = forms_at.df.select("id", "tokens", "names", F.xxhash64("grp").alias("grp"))
    # A bucket holds forms of one group, so only large groups can have large buckets.
    groups, bound = _large(named, "grp", named.count())
    rows = named.mapInPandas(keys, "id long, grp long, key long, full boolean").join(F.broadcast(groups), "grp", "left")
    banded = Stage(rows.select("id", F.xxhash64("grp", "key").alias("key"), "full", F.col("n").isNotNull().alias("large")), "names-bands").df
    buckets, _ = _large(banded.where("large"), "key", bound * MOST_SPLIT)
    near = _candidates(banded.select("id", "key", "full"), buckets, bound)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            columns = (batch[c] for c in ("ta", "tb", "da", "db", "na", "nb"))
            yield batch[["a", "b"]].assign(score=[monge_elkan(*map(list, x)) for x in zip(*columns, strict=True)])[lambda f: f["score"] >= threshold]

    side = forms_at.df.select("id", "tokens", "dfs", "names")
    pairs = near.join(side.toDF("a", "ta", "da", "na"), "a").join(side.toDF("b", "tb", "db", "nb"), "b")
    scored = Stage(pairs.mapInPandas(score, "a long, b long, score double"), "names-links")

    long = F.size(F.filter("tokens", lambda t: F.length(t) > 1))
    known = F.size(F.filter("names", lambda n: F.size(n) > 0))
    # Names that are common over all groups come before rare tokens, which may be mistyped, whatever their counts here.
    usual = lambda c: F.floor(F.log2(c)).cast("int")
    rank = F.struct(
        F.least(long, F.lit(2)).alias("whole"), (-known).alias("nick"), usual(F.array_min("dfs")).alias("least"), usual(F.array_max("dfs")).alias("most"),
        F.col("n").alias("n"), F.col("form").alias("form"), F.col("id").alias("id"),
    )
    ranked = forms_at.df.select("id", "user", rank.alias("rank"))
    both = scored.df.unionByName(scored.df.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    both = both.join(ranked.toDF("a", "ua", "ra"), "a").join(ranked.toDF("b", "ub", "rb"), "b")
    edges = Stage(both.select("a", "b", "score", F.coalesce(F.col("ua") == F.col("ub"), F.lit(False)).alias("same"), "ra", "rb"), "names-edges")
    satellites = Stage(_satellites(edges.df.select("a", "b", "ra", "rb")), "names-decided").df
    best = (
        edges.df.join(satellites.select(F.col("id").alias("a")), "a", "left_semi").join(satellites.select(F.col("id").alias("b")), "b", "left_anti")
        .groupBy("a").agg(F.max_by("b", F.struct("same", "score", "rb")).alias("entity"))
    )
    every = forms_at.df.select("grp", "form", "id").join(best.withColumnRenamed("a", "id"), "id", "left")
    every = every.select("grp", "form", F.coalesce("entity", "id").alias("entity"))
    out = base.where(~F.col("gm")).join(every, ["grp", "form"]).select("grp", "spelling", "entity")
    return out.unionByName(base.where("gm").select("grp", "spelling", F.lit(0).cast("long").alias("entity")))


def entities(messages: DataFrame, corrections: DataFrame) -> DataFrame:
    """``campaign_id, spelling, entity``: every spelling of a campaign once, with the character it stands for."""
    nick = nicknames(corrections, F.col("old_name"), F.col("new_name"))
    return link(spellings(messages), nick).withColumnRenamed("grp", "campaign_id")


def variant_pairs(messages: DataFrame, corrections: DataFrame) -> DataFrame:
    """``campaign_id, name_a, name_b``: all pairs of different spellings of one character in a campaign, a before b.

    Null and empty spellings, empty tables and campaigns with one spelling give no pair; names of any length are
    compared whole.
    """
    linked = Stage(entities(messages, corrections), "names-entities").df
    a = linked.select("campaign_id", "entity", F.col("spelling").alias("name_a"))
    b = linked.select("campaign_id", "entity", F.col("spelling").alias("name_b"))
    return a.join(b, ["campaign_id", "entity"]).where("name_a < name_b").select("campaign_id", "name_a", "name_b")
