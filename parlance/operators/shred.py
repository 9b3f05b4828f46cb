"""Columnar shredding of nested records: repetition and definition levels per leaf, tables rebuilt from the levels.

A record schema is a tree of ``Leaf`` and ``Many`` nodes.  Every leaf path becomes one column of triples
``(repetition, definition, value)``:

* repetition says at which repeated ancestor the entry starts anew (0: a new record);
* definition says how much of the path exists: a list that is null adds nothing, an empty list adds one, an
  element adds two, a present leaf value adds one more.

A table for a repeated ancestor needs only these level sequences: elements are the entries whose repetition is at
most the ancestor's and whose definition reaches it, and running counts over the same sequence give the record,
the parent element and the place in the parent.  A batch is shredded and reassembled with vector operations; no
shuffle and no per-row join is needed to keep child and parent linked.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Leaf:
    name: str


@dataclass(frozen=True)
class Many:
    """A repeated group; its value in a record is null or a list of dicts."""

    name: str
    fields: tuple = ()


@dataclass
class Levels:
    rep: list = field(default_factory=list)
    dfn: list = field(default_factory=list)
    val: list = field(default_factory=list)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        val = np.empty(len(self.val), dtype=object)
        val[:] = self.val
        return np.asarray(self.rep, dtype=np.int32), np.asarray(self.dfn, dtype=np.int32), val


class Shredded:
    """Level columns of a batch of records under one schema."""

    def __init__(self, schema: tuple, records: Iterable[dict]):
        self.schema = schema
        self.columns: dict[tuple[str, ...], Levels] = {}
        self._declare(schema, ())
        for record in records:
            self._group(schema, record, (), 0, 0, 1)
        self._arrays = {p: c.arrays() for p, c in self.columns.items()}

    def _declare(self, fields: tuple, at: tuple) -> None:
        for f in fields:
            if isinstance(f, Leaf):
                self.columns[(*at, f.name)] = Levels()
            else:
                self._declare(f.fields, (*at, f.name))

    def _group(self, fields: tuple, value: dict | None, at: tuple, rep: int, dfn: int, depth: int) -> None:
        for f in fields:
            path = (*at, f.name)
            v = None if value is None else value.get(f.name)
            if isinstance(f, Leaf):
                c = self.columns[path]
                c.rep.append(rep)
                c.dfn.append(dfn + (v is not None))
                c.val.append(v)
            elif not v:
                self._group(f.fields, None, path, rep, dfn + (v is not None), depth + 1)
            else:
                for i, element in enumerate(v):
                    self._group(f.fields, element, path, depth if i else rep, dfn + 2, depth + 1)

    def _leaf_below(self, at: tuple[str, ...]) -> tuple[str, ...]:
        return next(p for p in self.columns if p[: len(at)] == at)

    def table(self, at: tuple[str, ...] = (), outer: bool = False) -> dict[str, np.ndarray]:
        """The table of the repeated ancestor ``at`` (``()``: the records).

        Columns: ``record`` (place of the record in the batch), ``parent`` (row of the parent in its own table),
        ``place`` (0-based, in the parent) and the leaves directly below.  With ``outer`` a parent without
        elements keeps one row, whose place is -1 if its list is empty and -2 if its list is null.
        """
        k, d = len(at), 2 * len(at)
        rep, dfn, _ = self._arrays[self._leaf_below(at)]
        parents = (rep < max(k, 1)) & (dfn >= max(d - 2, 0))
        element = (rep <= k) & (dfn >= d)
        keep = ((rep <= k) & (dfn >= max(d - 2, 0))) if outer else element
        record = np.cumsum(rep == 0) - 1
        parent = np.cumsum(parents) - 1
        start = np.maximum.accumulate(np.where(rep < max(k, 1), np.arange(len(rep)), 0)) if len(rep) else rep
        count = np.cumsum(element)
        before = count[start] - element[start] if len(rep) else count
        place = np.where(element, count - 1 - before, np.where(dfn == d - 1, -1, -2))
        out = {"record": record[keep], "parent": parent[keep], "place": place[keep]}
        for path in self.columns:
            if path[:-1] == at:
                lrep, ldfn, lval = self._arrays[path]
                wanted = ((lrep <= k) & (ldfn >= max(d - 2, 0))) if outer else ((lrep <= k) & (ldfn >= d))
                out[path[-1]] = lval[wanted]
        return out


#: A chat message: paragraphs with their label and actions; the rest are plain attributes.
MESSAGE = (
    Leaf("date"), Leaf("player"), Leaf("character"), Leaf("text"), Leaf("format"),
    Many("paragraphs", (Leaf("key"), Leaf("text"), Leaf("label"), Many("actions", (Leaf("name"),)))),
)
#: Attributes by which a message object is told from a wrapper around one.
ATTRIBUTES = frozenset(("date", "player", "character", "text", "paragraphs"))


def message_object(payload: str | None) -> dict | None:
    """The message object in a payload; None if it holds no readable object.

    A payload may be encoded as a JSON string again and again, and the message may sit under single keys that are no
    attributes of a message, in any depth.
    """
    value: object = payload
    while True:
        if isinstance(value, str):
            try:
                value = json.loads(value)
            except (ValueError, RecursionError):
                return None
        elif isinstance(value, dict) and len(value) == 1 and ATTRIBUTES.isdisjoint(value):
            inner = next(iter(value.values()))
            found = message_object(inner) if isinstance(inner, str) else inner
            if not isinstance(found, dict):
                return value
            value = found
        else:
            return value if isinstance(value, dict) else None


def paragraph_items(value: dict) -> list[tuple[str, dict]] | None:
    """Keys and paragraph objects of a message, a list's keys being its places; None if it has no paragraphs."""
    paragraphs = value.get("paragraphs")
    if isinstance(paragraphs, dict):
        items = list(paragraphs.items())
    elif isinstance(paragraphs, list):
        items = [(str(i), p) for i, p in enumerate(paragraphs)]
    else:
        return None
    return [(k, p) for k, p in items if isinstance(p, dict)]


def plain_message(payload: str | None) -> str | None:
    """A payload as JSON of one shape: paragraphs as an object of objects, their actions as lists without nulls."""
    value = message_object(payload)
    if value is None:
        return None
    items = paragraph_items(value)
    if items is not None:
        value = value | {"paragraphs": {k: p | {"actions": action_list(p.get("actions"))} for k, p in items}}
    return json.dumps(value)


def parse_message(payload: str | None) -> dict | None:
    """A payload as a record of :data:`MESSAGE`; None if :func:`message_object` finds no message.

    A message with a non-null ``text`` has the old format: it keeps its text and has no paragraphs.
    """
    value = message_object(payload)
    if value is None:
        return None
    record = {k: v if isinstance(v, str) else None for k in ("date", "player", "character", "text") for v in (value.get(k),)}
    old = value.get("text") is not None
    record["format"] = "old" if old else "new"
    items = None if old else paragraph_items(value)
    record["paragraphs"] = None if items is None else [paragraph(k, p) for k, p in items]
    return record


def action_list(actions: object) -> list | None:
    """Actions as a list without nulls, a single one as a list of one; None if there are none."""
    if isinstance(actions, (str, dict)):
        actions = [actions]
    return [a for a in actions if a is not None] if isinstance(actions, list) else None


def paragraph(key: str, value: dict) -> dict:
    actions = action_list(value.get("actions"))
    named: list[dict] | None = None if actions is None else [{"name": action_name(a)} for a in actions]
    text, label = value.get("text"), value.get("label")
    return {
        "key": key, "text": text if isinstance(text, str) else None,
        "label": label if isinstance(label, str) else None, "actions": named,
    }


def action_name(action: object) -> str:
    if isinstance(action, dict):
        action = action.get("name")
    if action is None:
        return ""
    return action if isinstance(action, str) else json.dumps(action)


def _shred(df: DataFrame, record_id: Column, payload: Column, make: Callable[[Shredded, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, records = [], []
            for i, p in zip(batch["record_id"], batch["payload"], strict=True):
                record = parse_message(p)
                if record is not None:
                    ids.append(i)
                    records.append(record)
            yield make(Shredded(MESSAGE, records), np.asarray(ids, dtype=np.int64))

    narrow = df.select(record_id.cast("long").alias("record_id"), payload.alias("payload"))
    return narrow.where("record_id IS NOT NULL AND payload IS NOT NULL").mapInPandas(run, schema)


def messages_table(df: DataFrame, record_id: Column, payload: Column) -> DataFrame:
    """One row per readable message: ``record_id, date, player, character, text, format``.

    Rows with a null id or payload, and payloads that hold no message object, give no row.  Loaded twice means
    two rows.  Attributes of another type than string come out null.  Other columns of ``df`` play no role.
    """

    def make(s: Shredded, ids: np.ndarray) -> pd.DataFrame:
        t = s.table()
        return pd.DataFrame({"record_id": ids[t["record"]]} | {k: t[k] for k in ("date", "player", "character", "text", "format")})

    return _shred(df, record_id, payload, make, "record_id long, date string, player string, character string, text string, format string")


def paragraphs_table(df: DataFrame, record_id: Column, payload: Column) -> DataFrame:
    """One row per paragraph object: ``record_id, para_no, para_key, text, label``; ``record_id`` is the parent link.

    ``para_no`` counts a message's paragraph objects from 0; ``para_key`` is the key in the source, or the place in
    its list.  Paragraphs that are not objects give no row.
    """

    def make(s: Shredded, ids: np.ndarray) -> pd.DataFrame:
        t = s.table(("paragraphs",))
        return pd.DataFrame({"record_id": ids[t["record"]], "para_no": t["place"], "para_key": t["key"], "text": t["text"], "label": t["label"]})

    return _shred(df, record_id, payload, make, "record_id long, para_no long, para_key string, text string, label string")


def actions_table(df: DataFrame, record_id: Column, payload: Column, outer: bool = False) -> DataFrame:
    """One row per paragraph action: ``record_id, para_no, para_key, label, action_no, action_name``.

    ``(record_id, para_no)`` is the parent link and ``action_no`` counts from 1; the parent's key and label are
    carried along.  With ``outer`` a paragraph without actions keeps one row with the name '' and the number 0 if
    its actions are a list, -1 if they are null or absent.  Null actions do not count; a single string is one action.
    """

    def make(s: Shredded, ids: np.ndarray) -> pd.DataFrame:
        p, a = s.table(("paragraphs",)), s.table(("paragraphs", "actions"), outer)
        up = a["parent"]
        name = np.array([v if v is not None else "" for v in a["name"]], dtype=object)
        return pd.DataFrame({
            "record_id": ids[a["record"]], "para_no": p["place"][up], "para_key": p["key"][up], "label": p["label"][up],
            "action_no": a["place"] + 1, "action_name": name,
        })

    return _shred(df, record_id, payload, make, "record_id long, para_no long, para_key string, label string, action_no long, action_name string")


LABELS = ("in-character", "out-of-character", "mixed")


def clean_label(label: Column) -> Column:
    """The label trimmed and lower-cased if it is one of the three known ones, else ``unlabeled``."""
    bare = F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))
    return F.when(bare.isin(*LABELS), bare).otherwise("unlabeled")
