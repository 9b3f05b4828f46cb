"""Sizes of texts in tokens of a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

FOLDER = os.environ.get("PARLANCE_TOKENIZERS", "/opt/tokenizers")
#: A vocabulary of byte-level BPE as ranks, and its rule for cutting a text into stretches (both fixed by the vocabulary).
NAME = "byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict[str, object] = {}


def load(path: str) -> object:
    """The tokenizer of a file, loaded once per worker process."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
        _LOADED[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores, for work that is heavy against its input: a file of few row groups would keep few busy."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def with_sizes(df: DataFrame, key: Column, text: Column, keep: tuple[str, ...] = (), path: str = f"{FOLDER}/{NAME}") -> DataFrame:
    """``key, n_tokens`` and the columns ``keep``; null and empty texts have 0 tokens.  Texts are counted whole."""
    slim = df.select(key.alias("key"), *keep, F.coalesce(text, F.lit("")).alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = load(path)
        for batch in batches:
            # No strings of special tokens: they count as the plain text they are.
            yield batch.drop(columns="text").assign(n_tokens=[len(tokenizer.encode_ordinary(t)) for t in batch["text"]])

    return spread(slim, "key").mapInPandas(run, f"{fields}, n_tokens long")
