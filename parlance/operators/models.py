"""Model-backed stages: pluggable encoders and annotators behind ``mapInPandas``.

A model is any object with the method named below; it is created once per worker process from a factory, so that
only the factory travels.  Defaults run offline and give the same result everywhere.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from parlance.session import written


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class Annotator(Protocol):
    def answer(self, prompts: list[str]) -> list[str]: ...


class HashEncoder:
    """Signed hashing of words into a fixed number of dimensions by their MD5 sums, scaled to unit length."""

    def __init__(self, size: int = 64):
        self.size = size

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.md5(w.encode("utf-8", "surrogatepass")).digest()[:4], "big")
                out[i, h % self.size] += 1 if h >> 31 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).astype(np.float32)

    def tokens(self, text: str) -> np.ndarray:
        """One vector per word."""
        return self.encode(text.split()) if text.split() else np.zeros((0, self.size), dtype=np.float32)


class KeywordAnnotator:
    """Answers an extraction prompt with the turns whose text, up to the next turn's heading, holds one of the keywords."""

    HEADING = re.compile(r"^Turn (\d+) - ", re.M)

    def __init__(self, keywords: tuple[str, ...], none: str, kind: str | None = None):
        self.keywords, self.none, self.kind = keywords, none, kind

    def answer(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            parts = self.HEADING.split(p)[1:]
            texts = [(n, body.partition(": ")[2]) for n, body in zip(parts[::2], parts[1::2], strict=True)]
            hits = [(n, " ".join(t.split())) for n, t in texts if any(k in t.lower() for k in self.keywords)]
            mark = f" [{self.kind}]" if self.kind else ""
            out.append("\n".join(f"TURN {n}{mark}: {t}" for n, t in hits) or self.none)
        return out


def with_retry(call: Callable[[], list[str]], attempts: int = 3, delay: float = 10.0, factor: float = 1.5, sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """Call again after a growing pause while the error looks passing (rate, overload, time-out, connection)."""
    for n in range(attempts):
        try:
            return call()
        except Exception as e:
            passing = any(k in str(e).lower() for k in ("rate", "overload", "timeout", "timed out", "connection", "503", "529"))
            if n + 1 == attempts or not passing:
                raise
            sleep(delay * factor**n)
    raise AssertionError


def embed(df: DataFrame, text: str, make: Callable[[], Encoder] = HashEncoder, batch: int = 64, into: str = "vector") -> DataFrame:
    """Adds a vector per row; a blank or null text is encoded as ``[EMPTY]``."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, `{into}` array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            texts = [t if isinstance(t, str) and t.strip() else "[EMPTY]" for t in pdf[text]]
            rows: list[np.ndarray] = []
            for at in range(0, len(texts), batch):
                rows += list(model.encode(texts[at : at + batch]))
            yield pdf.assign(**{into: rows})

    return df.mapInPandas(run, schema)


def embed_cached(df: DataFrame, text: str, model: str, folder: str, make: Callable[[], Encoder] = HashEncoder, batch: int = 64) -> DataFrame:
    """Adds a vector per row, read from the cache in ``folder``; texts it does not hold are encoded once each and added.

    The key depends on the model's name and the text, so equal texts share a vector, whatever their rows.
    """
    plain = F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "[EMPTY]").otherwise(F.col(text))
    keyed = df.withColumn("_key", F.sha2(F.concat_ws("|", F.lit(model), plain), 256))
    wanted = keyed.select("_key", plain.alias("_text")).dropDuplicates(["_key"])
    spark = df.sparkSession
    if written(spark, folder):
        wanted = wanted.join(spark.read.parquet(folder).select("_key"), "_key", "left_anti")
    embed(wanted, "_text", make, batch).select("_key", "vector").write.mode("append").parquet(folder)
    return keyed.join(spark.read.parquet(folder), "_key", "left").drop("_key")


#: The text column of each label.
LABEL_TEXTS = {"in-character": "in_character_text", "out-of-character": "out_of_character_text", "mixed": "mixed_text"}


def embed_labels(df: DataFrame, keys: list[str], make: Callable[[], Encoder] = HashEncoder, batch: int = 64) -> DataFrame:
    """``keys, label, text, vector``: a vector per text of a label; messages without content for a label have none."""
    each = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(n).alias("label"), F.col(c).alias("text")) for n, c in LABEL_TEXTS.items()))).alias("t"))
    return embed(each.select(*keys, "t.*").where("length(text) > 0"), "text", make, batch)


def token_diversity(df: DataFrame, keys: list[str], text: str, make: Callable[[], HashEncoder] = HashEncoder, least: int = 5, most: int | None = None) -> DataFrame:
    """Mean distance of all pairs of a text's token vectors, from the sum of the unit vectors; null below ``least`` tokens.

    All tokens count; ``most`` is for encoders that read no further.
    """
    kinds = dict((f.name, f.dataType.simpleString()) for f in df.schema)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n_tokens int, diversity double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            out = []
            for t in pdf[text]:
                v = model.tokens(t or "")[:most].astype(np.float64)
                n, s = len(v), v.sum(axis=0)
                out.append((n, 1 - (s @ s - n) / (n * (n - 1)) if n >= least else None))
            yield pdf[keys].assign(n_tokens=[n for n, _ in out], diversity=[d for _, d in out])

    return df.mapInPandas(run, schema)


def annotate(requests: DataFrame, prompt: str, make: Callable[[], Annotator], stage: str, batch: int = 16, stored: DataFrame | None = None) -> DataFrame:
    """Adds ``request_key`` and ``response``.  The key depends on stage and prompt.

    A request whose key ``stored(request_key, response)`` holds gets that answer; only the others are asked, and equal
    ones once each.
    """
    keyed = requests.withColumn("request_key", F.sha2(F.concat_ws("|", F.lit(stage), F.col(prompt)), 256))
    if stored is not None:
        held = stored.groupBy("request_key").agg(F.min("response").alias("response"))
        new = annotate(keyed.join(held, "request_key", "left_anti").select(prompt).distinct(), prompt, make, stage, batch)
        return keyed.join(held.unionByName(new.select("request_key", "response")), "request_key")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in keyed.schema)}, response string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            out: list[str] = []
            for at in range(0, len(pdf), batch):
                part = list(pdf[prompt].iloc[at : at + batch])
                out += with_retry(lambda part=part: model.answer(part))
            yield pdf.assign(response=out)

    return keyed.mapInPandas(run, schema)


def extraction_requests(turns: DataFrame, windows: DataFrame, instruction: str) -> DataFrame:
    """A prompt per extraction window: the instruction and the window's turns as text."""
    from parlance.operators.episodes import range_text

    ranges = windows.select("campaign_id", F.col("window_start").alias("start_turn"), F.col("window_end").alias("end_turn"))
    text = range_text(turns, ranges, ["start_turn", "end_turn"])
    return text.select("campaign_id", F.col("start_turn").alias("window_start"), F.col("end_turn").alias("window_end"), F.concat(F.lit(instruction + "\n\n"), "text").alias("prompt"))


#: Words that do not make two norm descriptions alike.
STOP_WORDS = frozenset("the a an is are to of and or in on at for".split())


def alike(a: str, b: str) -> bool:
    """Whether one description holds the other, or half of the shorter one's content words are shared."""
    if a and b and (a in b or b in a):
        return True
    x, y = set(a.split()) - STOP_WORDS, set(b.split()) - STOP_WORDS
    return bool(x) and bool(y) and len(x & y) >= 0.5 * min(len(x), len(y))


def link_norms(episodes: DataFrame, group: str = "campaign_id", order: str = "start_turn", description: str = "description") -> DataFrame:
    """Adds ``norm_id``: each episode joins the first earlier norm of its conversation whose first description is alike.

    The result depends on the order, as the first description stands for a norm.  Episodes are rare findings of an
    annotator; a conversation's episodes, not its messages, come together in one task.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in episodes.schema)}, norm_id string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, norms, ids = pdf.sort_values(order), [], []
        for d in pdf[description]:
            d = (d or "").lower().strip()
            at = next((i for i, known in enumerate(norms) if alike(d, known)), None)
            if at is None:
                norms.append(d)
                at = len(norms) - 1
            ids.append(f"norm_{at + 1}")
        return pdf.assign(norm_id=ids)

    return episodes.groupBy(group).applyInPandas(run, schema)


def norm_summaries(linked: DataFrame) -> DataFrame:
    """Per norm: counts by type, whether any episode is explicit, the longest description (the earliest of equals)."""
    times = [F.count_if(F.col("episode_type") == t).alias(f"times_{n}") for t, n in (("establishing", "established"), ("following", "followed"), ("violating", "violated"), ("enforcing", "enforced"))]
    return linked.groupBy("campaign_id", "norm_id").agg(
        F.count("*").alias("episodes"), F.bool_or("is_explicit").alias("is_explicit"), *times,
        F.max_by("description", F.struct(F.length("description"), -F.col("start_turn"))).alias("description"),
    )


def request_cost(prompt: Column) -> Column:
    return F.floor(F.length(prompt) / 4)
