"""Parsers of annotators' text answers, as column expressions where the format allows and else as UDFs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: The dimensions of a judge's rating.
DIMENSIONS = ("novelty", "value", "adherence", "resonance")
NORM_TYPES = "establishing|following|violating|enforcing"


def _entries(found: DataFrame, answer: Column, head: str, beyond: str) -> DataFrame:
    """An answer cut before every ``beyond``, one row ``_e`` for each part that starts with ``head``, numbered by ``position``."""
    parts = F.filter(F.split(answer, rf"(?i)(?={beyond})"), lambda e: F.rlike(e, F.lit(rf"(?i)^{head}")))
    return found.select(*found.columns, F.posexplode(parts).alias("position", "_e"))


def turn_list(found: DataFrame, response: Column, none: str) -> DataFrame:
    """``TURN n: explanation`` entries, explanations over several lines, inside the window of each row.

    Adds ``position, turn_idx, explanation``.  An answer that holds the token ``none`` in any case gives no row.
    """
    kept = found.withColumn("_r", response).where(~F.contains(F.upper("_r"), F.lit(none.upper())))
    head = r"TURN\s+(\d+):\s*"
    rows = _entries(kept, F.col("_r"), head, r"TURN\s+\d+:")
    told = _strip(F.regexp_replace("_e", rf"(?i)^{head}", ""))
    return _in_window(rows, F.regexp_extract("_e", rf"(?i)^{head}", 1), {"explanation": told})


def typed_turns(found: DataFrame, response: Column, none: str, types: tuple[str, str]) -> DataFrame:
    """``TURN n [TYPE]: explanation``, one a line; unknown types become the first one.  The token counts in its own case only."""
    kept = found.withColumn("_r", response).where(~F.contains("_r", F.lit(none)))
    lines = kept.select(*found.columns, F.posexplode(F.split("_r", "\n")).alias("position", "_l"))
    pattern = r"(?i)TURN\s+(\d+)\s*\[(\w+)\]\s*:\s*(.+)"
    kind = F.upper(F.regexp_extract("_l", pattern, 2))
    lines = lines.where(F.col("_l").rlike(pattern))
    return _in_window(lines, F.regexp_extract("_l", pattern, 1), {"explanation": _strip(F.regexp_extract("_l", pattern, 3)), "type": F.when(kind.isin(*types), kind).otherwise(types[0])})


def norm_turns(found: DataFrame, response: Column, none: str = "NO_NORMS_FOUND") -> DataFrame:
    """``TURN n [type]: explanation`` with one of the four norm types; other types are passed over."""
    kept = found.withColumn("_r", response).where(~F.contains(F.upper("_r"), F.lit(none)))
    head = rf"TURN\s+(\d+)\s*\[({NORM_TYPES})\]:\s*"
    rows = _entries(kept, F.col("_r"), head, r"TURN\s+\d+\s*\[")
    told = {"explanation": _strip(F.regexp_replace("_e", rf"(?i)^{head}", "")), "type": F.lower(F.regexp_extract("_e", rf"(?i)^{head}", 2))}
    return _in_window(rows, F.regexp_extract("_e", rf"(?i)^{head}", 1), told)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _in_window(rows: DataFrame, number: Column, extra: dict[str, Column]) -> DataFrame:
    out = rows.withColumn("turn_idx", number.try_cast("long"))
    for name, c in extra.items():
        out = out.withColumn(name, c)
    return out.where("turn_idx BETWEEN window_start AND window_end").drop("_e", "_l", "_r")


def humor_types(response: Column) -> Column:
    """Map from turn to ORIGIN or CALLBACK; the last line of a turn wins."""
    pattern = F.lit(r"(?i)TURN\s+(\d+):\s*(ORIGIN|CALLBACK)")
    turns, kinds = F.regexp_extract_all(response, pattern, F.lit(1)), F.regexp_extract_all(response, pattern, F.lit(2))
    entries = F.reverse(F.zip_with(turns, kinds, lambda n, k: F.struct(n.try_cast("long").alias("n"), F.upper(k).alias("k"))))
    return F.aggregate(entries, F.map_from_arrays(F.array().cast("array<bigint>"), F.array().cast("array<string>")), lambda m, e: F.when(F.map_contains_key(m, e["n"]), m).otherwise(F.map_concat(m, F.create_map(e["n"], e["k"]))))


def rating(response: Column, name: str, default: int = 3) -> Column:
    """The digit after ``name:``; any digit counts, 3 if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(response, rf"(?i){name}:\s*(\d)", 1), F.lit("")).cast("int"), F.lit(default))


def _field(answer: Column, name: str) -> Column:
    """What the first line with ``name:`` says behind it, up to a field that follows on the line; null if nothing."""
    line = F.try_element_at(F.filter(F.split(answer, "\n"), lambda x: F.rlike(x, F.lit(rf"(?i)\b{name}:"))), F.lit(1))
    said = F.regexp_extract(line, rf"(?i)\b{name}:(.*)$", 1)
    return F.nullif(_strip(F.element_at(F.split(said, r"(?i)\b(?:Type|Explicit|Norm|Description):"), 1)), F.lit(""))


def norm_category(response: Column, hint: Column, description: Column) -> Column:
    """Type, explicitness, norm and description of a norm episode, each with its default."""
    kind = F.lower(_field(response, "Type"))
    known = F.regexp_extract(kind, rf"^({NORM_TYPES})", 1)
    return F.struct(
        F.coalesce(F.nullif(known, F.lit("")), hint, F.lit("establishing")).alias("episode_type"),
        F.coalesce(F.startswith(F.upper(_field(response, "Explicit")), F.lit("YES")), F.lit(False)).alias("is_explicit"),
        F.coalesce(_field(response, "Norm"), description, F.lit("")).alias("description"),
        F.coalesce(_field(response, "Description"), description, F.lit("")).alias("episode_description"),
    )


def judge_overall(response: Column) -> Column:
    """Map from dimension to the first score found anywhere; missing dimensions are absent."""
    found = F.array(*(F.struct(F.lit(d).alias("k"), F.nullif(F.regexp_extract(response, rf"(?i){d}:\s*(\d)", 1), F.lit("")).cast("int").alias("v")) for d in DIMENSIONS))
    return F.map_from_entries(F.filter(found, lambda e: e["v"].isNotNull()))


def judge_character(response: Column, character: Column) -> Column:
    """Map from dimension to the score in a character's section; ``N/A`` is null, missing dimensions are absent.

    The answer is read line by line: a line that is a name with a colon, perhaps marked as a heading, opens that name's
    section, and the scores are the lines of the section that start with a dash.
    """
    lines = F.transform(F.split(response, "\n"), lambda x: _strip(x))
    heads = F.transform(lines, lambda x: F.when(F.startswith(x, F.lit("-")), None).otherwise(F.regexp_extract(x, r"^[#*\s]*(.*?)[*\s]*:[*\s]*$", 1)))
    opens = F.transform(heads, lambda h: F.nullif(F.lower(h), F.lit("")))
    first = F.array_position(opens, F.lower(character))
    rest = F.slice(lines, F.greatest(first, F.lit(1)).cast("int") + 1, F.size(lines))
    later = F.slice(opens, F.greatest(first, F.lit(1)).cast("int") + 1, F.size(lines))
    stop = F.array_position(F.transform(later, lambda h: h.isNotNull()), True)
    own = F.when(first > 0, F.when(stop > 0, F.slice(rest, 1, (stop - 1).cast("int"))).otherwise(rest)).otherwise(F.array().cast("array<string>"))

    def score(dimension: str) -> Column:
        hit = F.try_element_at(F.filter(own, lambda x: F.rlike(x, F.lit(rf"(?i)^-\s*{dimension}:\s*(\d|N/A)"))), F.lit(1))
        return F.nullif(F.regexp_extract(hit, r":\s*(\d|[Nn]/[Aa])", 1), F.lit(""))

    raw = F.array(*(F.struct(F.lit(d).alias("k"), score(d).alias("v")) for d in DIMENSIONS))
    kept = F.filter(raw, lambda e: e["v"].isNotNull())
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["k"].alias("k"), e["v"].try_cast("int").alias("v"))))


def judge_summary(scores: DataFrame, score: str, keys: list[str]) -> DataFrame:
    """Mean of each dimension over the score maps of ``keys``, and ``creativity``: the mean of the maps' own means.

    Every map is one session's (or one character's in it), so a missing dimension shifts nothing.
    """
    each = [F.try_element_at(F.col(score), F.lit(d)).cast("double") for d in DIMENSIONS]
    there = F.array_compact(F.array(*each))
    own = F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there))
    means = [F.round(F.avg(c), 6).alias(f"mean_{d}") for d, c in zip(DIMENSIONS, each, strict=True)]
    return scores.groupBy(*keys).agg(F.count("*").alias("judged"), *means, F.round(F.avg(own), 6).alias("mean_creativity"))


#: A name in a list: behind a number or bullet, perhaps in stars.
LISTED = re.compile(r"[\s\d.)*-]*(?P<name>.*?)[\s*]*")
REMARK = re.compile(r"[\s*]*\([^()]*\)[\s*]*$")


def _known(head: str, names: dict[str, str]) -> str | None:
    """The name a head stands for: as it is, without what lists put around it, or without a remark in brackets too."""
    plain = LISTED.fullmatch(head.strip()).group("name").lower()
    return names.get(head.strip().lower()) or names.get(plain) or names.get(REMARK.sub("", plain))


def described(response: str | None, names: list[str], master: str = "Dungeon Master") -> dict[str, str]:
    """Descriptions by name: one ``name: text`` a line, else several separated by commas; the first found stays."""
    lower = {n.lower(): n for n in reversed(names)}
    out: dict[str, str] = {}
    text = (response or "").strip()
    for line in text.split("\n"):
        head, colon, tail = line.strip().partition(":")
        name = _known(head, lower)
        if colon and name:
            out[name] = tail.strip()
    if len(out) < sum(n != master for n in names):
        # A pair ends where a comma is followed by the next name and its colon.
        for part in re.split(r",\s*(?=[^,:\n]+:)", text):
            head, colon, tail = part.strip().partition(":")
            name = _known(head, lower)
            if colon and name:
                out.setdefault(name, tail.strip())
    return out


#: The fields of a character sheet that hold numbers and lists.
NUMBER_FIELDS = ("Level", "Strength", "Dexterity", "Constitution", "Intelligence", "Wisdom", "Charisma", "Armor Class")
LIST_FIELDS = ("Saving Throw Proficiencies", "Skill Proficiencies", "Languages", "Equipment", "Spells Known", "Special Abilities")


def character_sheets(response: str | None, names: list[str]) -> list[dict[str, object]]:
    """Sheets of ``field: value`` lines under headings ``Name:``; numbers and lists in the fields that hold them."""
    known = {n.lower(): n for n in names}
    sheets: list[dict[str, object]] = []
    current: dict[str, object] | None = None
    for line in map(str.strip, (response or "").split("\n")):
        head, colon, value = line.partition(":")
        name = head.strip().strip("*#").strip().split(" (", 1)[0].strip().removeprefix("[").removesuffix("]").strip()
        if colon and name.lower() in known:
            current = {"Name": known[name.lower()]}
            sheets.append(current)
        elif colon and current is not None:
            key, value = head.strip(), value.strip()
            if value.lower() == "unknown":
                current[key] = value
            elif key in NUMBER_FIELDS:
                current[key] = int(value) if re.fullmatch(r"[+-]?\d+", value) else value
            elif key in LIST_FIELDS:
                current[key] = [x.strip() for x in value.split(",") if x.strip()]
            else:
                current[key] = value
    return [s for s in sheets if len(s) > 1]


FINAL = re.compile(r"(?im)^.*?\*{0,2}final\s+response\*{0,2}\s*:\*{0,2}[ \t]*")


def final_response(response: str) -> str:
    """What follows the marker ``Final response:``; an answer without it is an error."""
    m = FINAL.search(response)
    rest = response[m.end() :].strip() if m else ""
    if not rest:
        raise ValueError("the answer holds no final response")
    return rest


def final_response_or_null(response: Column) -> Column:
    """As :func:`final_response`, null where it would fail."""

    def one(text: str | None) -> str | None:
        try:
            return final_response(text) if isinstance(text, str) else None
        except ValueError:
            return None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(response)
