"""Shredding: levels, tables and their links against a plain walk over the records."""

from __future__ import annotations

import json

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from parlance.operators.shred import MESSAGE, Leaf, Many, Shredded, actions_table, clean_label, messages_table, paragraphs_table, parse_message

PARAGRAPH = st.one_of(
    st.none(), st.just("text"),
    st.fixed_dictionaries({}, optional={
        "text": st.one_of(st.none(), st.just("t")), "label": st.sampled_from(["mixed", " In-Character", None, "x"]),
        "actions": st.one_of(st.none(), st.just("hit"), st.lists(st.one_of(st.none(), st.sampled_from(["a", "b"]), st.just({"name": "n"}), st.just({})), max_size=4)),
    }),
)
RECORD = st.fixed_dictionaries({"date": st.just("d")}, optional={"paragraphs": st.one_of(st.none(), st.lists(PARAGRAPH, max_size=4), st.dictionaries(st.sampled_from("0123"), PARAGRAPH, max_size=3))})


def walk(records):
    """Paragraph actions the plain way."""
    out = []
    for i, r in enumerate(records):
        p = r.get("paragraphs")
        items = list(p.items()) if isinstance(p, dict) else list(enumerate(p)) if isinstance(p, list) else []
        for k, v in items:
            if not isinstance(v, dict):
                continue
            a = v.get("actions")
            if a is None:
                out.append((i, str(k), -1, ""))
                continue
            a = [x for x in ([a] if isinstance(a, str) else a) if x is not None]
            if not a:
                out.append((i, str(k), 0, ""))
            out += [(i, str(k), n + 1, x if isinstance(x, str) else x.get("name") or "") for n, x in enumerate(a)]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(RECORD, max_size=6))
def test_tables_from_levels(records):
    s = Shredded(MESSAGE, [parse_message(json.dumps(r)) for r in records])
    p, a = s.table(("paragraphs",)), s.table(("paragraphs", "actions"), outer=True)
    got = [(int(r), p["key"][up], int(n) + 1, name or "") for r, up, n, name in zip(a["record"], a["parent"], a["place"], a["name"])]
    assert got == walk(records)
    inner = s.table(("paragraphs", "actions"))
    assert len(inner["name"]) == sum(n > 0 for _, _, n, _ in walk(records))


def test_level_numbers():
    schema = (Leaf("id"), Many("xs", (Leaf("a"), Many("ys", (Leaf("b"),)))))
    s = Shredded(schema, [{"id": 1, "xs": None}, {"id": None, "xs": []}, {"xs": [{"a": 1, "ys": None}, {"a": None, "ys": [{"b": 2}, {"b": None}]}]}])
    c = s.columns[("xs", "ys", "b")]
    assert (c.rep, c.dfn, c.val) == ([0, 0, 0, 1, 2], [0, 1, 2, 5, 4], [None, None, None, 2, None])
    assert s.columns[("id",)].dfn == [1, 0, 0]


def payloads(spark, values):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in enumerate(values)], "raw_id long, payload string, record_id string, para_key string")


def test_shapes_of_payloads(spark):
    message = {"date": "d", "player": "p", "paragraphs": {"0": {"text": "t", "label": " MIXED ", "actions": ["a", None, {"name": "b"}]}, "1": None, "2": "s"}}
    values = [
        json.dumps(message), json.dumps(json.dumps(message)), json.dumps({"message": message}), json.dumps(message)[:-9], None, "", "[1, 2]", "7", "null",
        json.dumps({"date": "d", "text": "old", "paragraphs": [{"actions": ["a"]}]}), json.dumps({"paragraphs": {}}), json.dumps({"paragraphs": []}),
    ]
    df = payloads(spark, values)
    got = sorted((r.record_id, r.para_no, r.para_key, r.label, r.action_no, r.action_name) for r in actions_table(df, F.col("raw_id"), F.col("payload"), True).collect())
    assert got == [(i, 0, "0", " MIXED ", n, x) for i in (0, 1, 2) for n, x in ((1, "a"), (2, "b"))]
    formats = {r.record_id: r.format for r in messages_table(df, F.col("raw_id"), F.col("payload")).collect()}
    assert formats == {0: "new", 1: "new", 2: "new", 9: "old", 10: "new", 11: "new"}
    assert paragraphs_table(df, F.col("raw_id"), F.col("payload")).count() == 3


def test_empty_and_very_long(spark):
    assert actions_table(payloads(spark, []), F.col("raw_id"), F.col("payload")).count() == 0
    long = json.dumps({"paragraphs": [{"text": "x" * 500_000, "actions": ["a"] * 2000}]})
    rows = actions_table(payloads(spark, [long, long]), F.col("raw_id"), F.col("payload"))
    assert rows.count() == 4000


def test_labels(spark):
    df = spark.createDataFrame([(" In-Character ",), ("MIXED",), ("other",), (None,), ("",)], "l string")
    assert [r[0] for r in df.select(clean_label(F.col("l"))).collect()] == ["in-character", "mixed", "unlabeled", "unlabeled", "unlabeled"]
