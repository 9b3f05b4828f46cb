"""Descriptions, personalities and sheets of a campaign's characters, as an annotator reads them from excerpts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from parlance.operators import episodes as E
from parlance.operators.models import Annotator, annotate
from parlance.operators.parsers import character_sheets, described
from parlance.operators.sessions import handle

#: What is asked for, by kind.
REQUESTS = {
    "personality": "Describe how each player writes and what the player likes, one line each as name: text.",
    "description": "Describe each character, one line each as name: text.",
    "sheet": "Give each character's sheet under a heading with the name: fields as name: value, a line each.",
}


def excerpts(turns: DataFrame, names: Column, initial: int = 100, intro: int = 50, lead_in: int = 10) -> DataFrame:
    """``campaign_id, names, text``: a campaign's start and every later character's introduction, and all names.

    The number of turns in an excerpt is bounded by the parameters and the number of characters.
    """
    ranges = E.excerpt_ranges(turns, initial=initial, intro=intro, lead_in=lead_in).select("campaign_id", "start_turn", "end_turn")
    text = E.range_text(turns, ranges, ["start_turn", "end_turn"])
    whole = text.groupBy("campaign_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_turn", "text"))), lambda x: x.getField("text")), "\n\n").alias("text"))
    who = turns.select("campaign_id", names.alias("n")).where("n IS NOT NULL").groupBy("campaign_id").agg(F.array_sort(F.collect_set("n")).alias("names"))
    return whole.join(who, "campaign_id")


def profiles(turns: DataFrame, kind: str, make: Callable[[], Annotator], stored: DataFrame | None = None, **bounds: int) -> DataFrame:
    """``campaign_id, name, field, value``: what the answers hold of each name; the field of a text is the kind itself.

    ``kind`` is one of ``REQUESTS``; personalities are those of players, by their handles, the others those of characters.  Names the
    answer leaves out give no row; lists are joined by commas.
    """
    held = excerpts(turns, handle(F.col("player")) if kind == "personality" else F.col("character"), **bounds)
    names = F.array_join("names", "\n")
    asked = held.select("campaign_id", "names", F.concat(F.lit(REQUESTS[kind] + "\nNames:\n"), names, F.lit("\n\n"), "text").alias("prompt"))
    answers = annotate(asked, "prompt", make, kind, stored=stored).select("campaign_id", "names", "response")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for campaign, known, answer in zip(batch["campaign_id"], batch["names"], batch["response"], strict=True):
                if kind == "sheet":
                    for sheet in character_sheets(answer, list(known)):
                        rows += [(campaign, sheet["Name"], f, ", ".join(v) if isinstance(v, list) else str(v)) for f, v in sheet.items() if f != "Name"]
                else:
                    rows += [(campaign, name, kind, text) for name, text in described(answer, list(known)).items()]
            yield pd.DataFrame(rows, columns=["campaign_id", "name", "field", "value"])

    return answers.mapInPandas(run, "campaign_id string, name string, field string, value string")
