"""Text expressions over columns: words, vocabularies, set similarity and the message classifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space as the conversation format knows it; the general Unicode class is ``UNICODE_SPACE``.
SPACE = r"[ \t\n\r\f\x0B]+"
UNICODE_SPACE = r"(?U)[\s\x1c-\x1f]+"


def words(text: Column, space: str = SPACE) -> Column:
    """The words of a text, split at white space; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), space), lambda w: w != "")


def word_count(text: Column, space: str = SPACE) -> Column:
    return F.size(words(text, space))


def vocabulary(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(text) / 4)


# Keywords of the message classifiers; matched as substrings of the lower-cased text.
ROLL_WORDS = ("roll", "d20", "dice")
SPEECH_WORDS = ("says", "asks", "replies", '"', "'")
SPELL_WORDS = ("spell", "cast", "magic")
WEAPON_WORDS = ("attack", "sword", "weapon", "hit")
ACTION_WORDS = (
    "roll", "check", "move", "attack", "cast", "look", "search", "investigate", "perception", "stealth", "climb", "jump",
)
DICE_PATTERN = r"\d+d\d+|roll|\d{1,2}\s*(that|with)"


def has_any(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(text, F.lit(p))
    return found


def action_class(text: Column) -> Column:
    """The kind of action a paragraph's text suggests, the first that fits; null if none does."""
    low = F.lower(text)
    return (
        F.when(has_any(low, ROLL_WORDS), "roll").when(has_any(low, SPEECH_WORDS), "dialogue")
        .when(has_any(low, SPELL_WORDS), "spells").when(has_any(low, WEAPON_WORDS), "weapon")
    )


def has_dice(text: Column, actions: Column) -> Column:
    """Whether a text or its raw JSON actions (``check`` or ``survival`` holding a roll) mention a dice roll."""
    held = F.lit(False)
    for field in ("check", "survival"):
        held = held | F.coalesce(F.contains(F.get_json_object(actions, f"$.{field}"), F.lit("roll")), F.lit(False))
    return F.coalesce(F.lower(text).rlike(DICE_PATTERN), F.lit(False)) | held


def message_type(text: Column, dice: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(has_any(low, ACTION_WORDS) | dice, "action").when(has_any(low, ('"', "'")), "dialogue").otherwise("narrative")


def primary_label(counts: Column) -> Column:
    """The most frequent label; ties go in the fixed order, all zero is ``unlabeled``."""
    c = {k: F.coalesce(counts.getField(k), F.lit(0)) for k in ("in_character", "out_of_character", "mixed", "unlabeled")}
    top = F.greatest(*c.values())
    return (
        F.when(top == 0, "unlabeled").when(c["in_character"] == top, "in-character")
        .when(c["out_of_character"] == top, "out-of-character").when(c["mixed"] == top, "mixed").otherwise("unlabeled")
    )


def provider(model: Column) -> Column:
    """The provider of a language model by its name; unknown names go to the default."""
    low = F.lower(model)
    return (
        F.when(has_any(low, ("claude", "anthropic")), "anthropic").when(has_any(low, ("gpt", "openai")), "openai")
        .when(has_any(low, ("gemini", "google")), "google").otherwise("anthropic")
    )


def model_slug(model: Column) -> Column:
    return F.translate(model, "/.", "_-")


def python_bool(value: Column) -> Column:
    return F.initcap(value.cast("string"))
