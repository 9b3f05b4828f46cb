"""Personal information: forms, contexts, traps; pseudonyms are one to one and keep their format."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from parlance.llm import pii
from parlance.llm.pseudonym import DIGITS, LETTERS, permute, permute_date, permute_text

KEY = b"test"

FOUND = [
    ("mail me: a.b+c@mail.example.org now", "email", "a.b+c@mail.example.org"),
    ("reach me at kim at hexgrid dot test please", "email", "kim at hexgrid dot test"),
    ("kim-lee [at] post.example", "email", "kim-lee [at] post.example"),
    ("kim_1 (at) post (dot) example please", "email", "kim_1 (at) post (dot) example"),
    ("KIM＠EXAMPLE.NET", "email", "KIM＠EXAMPLE.NET"),
    ("kim@ example.org.", "email", "kim@ example.org"),
    ("call +49 30 23125 618 now", "phone", "+49 30 23125 618"),
    ("call +44 (0)20 79460903.", "phone", "+44 (0)20 79460903"),
    ("on (651) 555-0113 tonight", "phone", "(651) 555-0113"),
    ("on 555‑0180.", "phone", "555‑0180"),
    ("on 8665550133 now", "phone", "8665550133"),
    ("on 01.99.00.47.96 now", "phone", "01.99.00.47.96"),
    ("on 030/23125618, now", "phone", "030/23125618"),
    ("call five five five zero one four two now", "phone", "five five five zero one four two"),
    ("call five\xa0five\xa0five\xa0zero\xa0one\xa0six\xa0eight now", "phone", "five\xa0five\xa0five\xa0zero\xa0one\xa0six\xa0eight"),
    ("SSN 963\xa042\xa03773.", "identity", "963\xa042\xa03773"),
    ("my SSN is 963-42-3773.", "identity", "963-42-3773"),
    ("SSN 952285521 (delete)", "identity", "952285521"),
    ("NI number QQ 59 91 64 C.", "identity", "QQ 59 91 64 C"),
    ("passport: PD 714 4977.", "identity", "PD 714 4977"),
    ("driver's licence H908-4186-3180", "identity", "H908-4186-3180"),
    ("national id card 44.810.805-7", "identity", "44.810.805-7"),
    ("at Flat 2, 238 Elderfold Avenue, come", "address", "Flat 2, 238 Elderfold Avenue"),
    ("at 33b Oddfellow Lane.", "address", "33b Oddfellow Lane."),
    ("at 5 millrace drive, kestonbury this time", "address", "5 millrace drive, kestonbury"),
    ("at PO Box 4400, Port Sellow, bye", "address", "PO Box 4400, Port Sellow"),
    ("at Millraceweg 2, 96263 Averley, bye", "address", "Millraceweg 2, 96263 Averley"),
    ("OOC: my real name is Y. Grenbinder.", "name", "Y. Grenbinder"),
    ("signed, Durorsby, Claire (the person)", "name", "Durorsby, Claire"),
    ("Tell YUSUF HOFFFELDT's sister", "name", "YUSUF HOFFFELDT"),
    ("Ask for Mr. Stefan C. Veldinova at the door", "name", "Stefan C. Veldinova"),
    ('signed, Keiko "Ferret" Halverhoven (x)', "name", 'Keiko "Ferret" Halverhoven'),
    ("yesterday Kwame Okanbrough came", "name", "Kwame Okanbrough"),
]
TRAPS = [
    "Map seed 82589617, grid 259-45, square E13.", "Is that on p. 141-300 of the rules, or from version 1.5.4677?", "Session on 2022-03-14, 19:30-23:00 as usual.",
    "Score so far 430-76-76, reset.", "Grid 194 6003, then 89 squares north.", "The tag on the crate reads QX-3813-41.", "@warywisp you are up, then Elowyn Stormonshaw.",
    "Ask for Nolthar Ashagrove at the salt cellar, everyone there knows that name.", '"My name is Drusk Winteresfen," comes the answer.', "Ticket 84558455 for the ferry, gate 42.",
    "Arrows @ 51 gp per 538, take it.", "The house at the end of Tallow Street belongs to her aunt.", "Room 433 has 2541 scratched on the door.", "I roll Stealth: 1d20+5 = 7.",
    "Dice server says 463.38.38 is out.", "Dot the map at every ford, Bérenne.", "The passport office in the story opens at 75:00 somehow.", "Total XP 26,844 for the table, 5722 each.",
    "You find 43 silver and a lantern under the boards of room 25 on the third floor.", "Drusk Winteresfen, 480 paces east of the Saltmarket.", "", "lol",
]


@pytest.mark.parametrize(("text", "kind", "value"), FOUND)
def test_found(text, kind, value):
    assert [(k, text[a:b]) for a, b, k in pii.find(text)] == [(kind, value)]


@pytest.mark.parametrize("text", TRAPS)
def test_traps(text):
    assert pii.find(text) == []


#: Sentences whose frames and names are not those of the tables.
HELD_OUT = [
    ("My name is Hiroshi Tanaka and I will be late.", ["Hiroshi Tanaka"]), ("I'm Oluwaseun Adeyemi, we spoke last week.", ["Oluwaseun Adeyemi"]),
    ("Her full name is Siobhan Gallagher.", ["Siobhan Gallagher"]), ("Real name: Katarzyna Nowak", ["Katarzyna Nowak"]), ("Regards,\nBartholomew Okafor", ["Bartholomew Okafor"]),
    ("Meet at Calle Mayor 12, Madrid", ["Calle Mayor 12, Madrid"]), ("The parcel went to 14 Rue de Rivoli", ["14 Rue de Rivoli"]), ("we live in Via Roma 5", ["Via Roma 5"]),
    ("the form was signed by López, Maria.", ["López, Maria"]), ("Ship to: Aroha Ngata, thanks", ["Aroha Ngata"]), ("Kind regards,\nTove Lindqvist", ["Tove Lindqvist"]),
    ("Attn: Dr. Nikhil Raghunathan", ["Nikhil Raghunathan"]), ("Their legal name is Ludwig van Aarden.", ["Ludwig van Aarden"]), ("(I am Ewa Zielinska, new at the table)", ["Ewa Zielinska"]),
    ("yesterday Maria de la Cruz joined the call", ["Maria de la Cruz"]), ("The landlord: Tomasz Wrona", ["Tomasz Wrona"]), ("hi, Bronagh Kelleher here", ["Bronagh Kelleher"]),
    ("c/o Anneliese Brandt", ["Anneliese Brandt"]), ("avenue: 3 Rue des Lilas", ["3 Rue des Lilas"]), ("Organizer: Chukwudi Eze", ["Chukwudi Eze"]), ("Sincerely, Wolfgang Amsel", ["Wolfgang Amsel"]),
    ("born on 12 March 1987 in Leeds", ["12 March 1987"]), ("DOB: 1987-03-12", ["1987-03-12"]), ("my birthday is 03/12/1987", ["03/12/1987"]),
    ("write to " + "x" * 200 + "@example.org", ["x" * 200 + "@example.org"]), ("passport" + " " * 60 + "number PD 714 4977.", ["PD 714 4977"]),
    ("at Apartment       12,         7 Cedar Road", ["Apartment       12,         7 Cedar Road"]),
    ("Maria Silverhand draws her sword", []), ("James Blackwood the wizard casts", []), ("Rosa Parks Avenue is long", []), ('"My name is Inigo Stormcloak," he says.', []),
    ("“I am Daniel Ravenmoor,” she lies.", []), ("Sorry, Daniel. Thanks, Maria.", []), ("I'm Dungeon Master tonight.", []), ("The battle of 1415-10-25 was long.", []), ("Her name is known to Peter of Dale", []),
]


def test_held_out_sentences():
    found = [[text[a:b] for a, b, _ in pii.find(text)] for text, _ in HELD_OUT]
    right = sum(sum(v in want for v in got) for got, (_, want) in zip(found, HELD_OUT))
    assert right >= 0.9 * sum(len(want) for _, want in HELD_OUT), [(f, w) for f, (_, w) in zip(found, HELD_OUT) if f != w]
    assert right >= 0.9 * sum(map(len, found)), [(f, w) for f, (_, w) in zip(found, HELD_OUT) if f != w]


def test_names_of_the_cast_are_no_persons():
    text = "yesterday Kwame Okanbrough came. My name is Tilda Marsh."
    assert [text[a:b] for a, b, _ in pii.find(text)] == ["Kwame Okanbrough", "Tilda Marsh"]
    assert pii.find(text, {"kwame", "okanbrough", "tilda", "marsh"}) == []


def test_pseudonyms_of_valid_numbers_are_valid_and_one_to_one():
    rng = random.Random(3)
    dni = {f"{n:08d}{pii.DNI_LETTERS[n % 23]}" for n in (rng.randrange(10**8) for _ in range(300))}
    rut = {(lambda b: f"{b[:2]}.{b[2:5]}.{b[5:]}-{pii.rut_check(b)}")(str(rng.randrange(10**7, 10**8))) for _ in range(300)}
    ssn = {f"{rng.randrange(1, 666):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}" for _ in range(300)}
    nino = {f"{a}{b} {rng.randrange(100):02d} {rng.randrange(100):02d} {rng.randrange(100):02d} {rng.choice('ABCD')}" for a in "ABCEGH" for b in "ABCEGH" if pii.nino_prefix(a + b)}
    area = {f"({rng.randrange(200, 1000)}) {rng.randrange(200, 1000)}-{rng.randrange(10000):04d}" for _ in range(300)}
    for values, valid, kind in (
        (dni, pii.dni_valid, "identity"), (rut, pii.rut_valid, "identity"), (ssn, lambda v: pii.ssn_given(v.replace("-", "")), "identity"),
        (nino, lambda v: pii.nino_prefix(v[:2]) and v[-1] in "ABCD", "identity"), (area, lambda v: v[1] not in "01" and v[6] not in "01", "phone"),
    ):
        out = {pii.pseudonym(v, kind, KEY) for v in values}
        assert len(out) == len(values) and all(map(valid, values)) and all(map(valid, out)) and out != values
        assert {re.sub(r"[0-9A-Z]", "x", v) for v in out} == {re.sub(r"[0-9A-Z]", "x", v) for v in values}
    assert not any(pii.dni_valid(pii.pseudonym(v[:-1] + ("T" if v[-1] != "T" else "R"), "identity", KEY)) for v in dni)


@pytest.mark.parametrize(("inland", "abroad"), [("612 345 678", "+34 612 345 678"), ("06 1234 5678", "+39 06 1234 5678"), ("020 7946 0903", "+44 (0)20 7946 0903"), ("402-881-3920", "+1 402 881 3920"), ("030 23125618", "0049 30 23125618"), ("01 4221 2345", "+353 1 4221 2345")])
def test_forms_of_one_number_stay_linked(inland, abroad):
    a, b = (pii.pseudonym(v, "phone", KEY) for v in (inland, abroad))
    assert pii.national(a)[1] == pii.national(b)[1] and pii.national(a)[0] == pii.national(inland)[0] and pii.national(b)[0] == pii.national(abroad)[0]


def test_dates_of_birth_keep_their_form():
    for text in ("born 1987-03-12", "born 12.03.1987", "DOB: 03/12/1987", "born 12 March 1987", "born on March 12, 1987"):
        out = pii.redact(text, KEY)
        assert "[BIRTH:" in out and "1987" not in out
        assert {c for c in re.sub(r"[0-9A-Za-z]", "", out)} >= {c for c in re.sub(r"[0-9A-Za-z]", "", text)}
    assert pii.redact("born 1987-03-12", KEY)[-11:-1] == permute_date(dt.date(1987, 3, 12), KEY).isoformat()
    assert pii.redact("born 1987-13-12 or so", KEY) == "born 1987-13-12 or so"


def test_one_line_with_all():
    text = "Contact sheet: Ingrid Beruelo, 155 Tanyard Street, Averley 12345; 555-0165; ingrid-beruelo (at) pos (dot) example."
    assert [k for _, _, k in pii.find(text)] == ["name", "address", "phone", "email"]


def test_redaction_keeps_the_rest_and_links_equal_values():
    text = "ring 07700 900743 or +44 7700 900 743!\nBye"
    out = pii.redact(text, KEY)
    assert out.startswith("ring [PHONE:0") and out.endswith("]!\nBye")
    a, b = (p.split("]")[0] for p in out.split("[PHONE:")[1:])
    assert "".join(filter(str.isdigit, a))[1:] == "".join(filter(str.isdigit, b))[2:]
    assert pii.redact("kim@example.org", KEY) == pii.redact("kim (at) example (dot) org", KEY)
    assert pii.redact("x", KEY) == "x" and pii.redact("", KEY) == "" and pii.redact(None, KEY) is None
    assert pii.redact("my SSN is 963-42-3773.", KEY) != pii.redact("my SSN is 963-42-3773.", b"other")


@settings(max_examples=200)
@given(st.text(DIGITS, max_size=12), st.text(LETTERS, max_size=9))
def test_permutations_can_be_undone(digits, letters):
    for s, alphabet in ((digits, DIGITS), (letters, LETTERS)):
        t = permute(s, KEY, alphabet)
        assert len(t) == len(s) and permute(t, KEY, alphabet, inverse=True) == s
    assert len({permute(f"{i:03d}", KEY) for i in range(1000)}) == 1000


@given(st.dates(dt.date(1900, 1, 1), dt.date(2099, 12, 31)))
def test_dates(day):
    moved = permute_date(day, KEY)
    assert dt.date(1900, 1, 1) <= moved <= dt.date(2099, 12, 31) and permute_date(moved, KEY, inverse=True) == day
    assert permute_date(dt.date(1800, 1, 1), KEY) == dt.date(1800, 1, 1)


@given(st.text(max_size=300))
def test_any_text(text):
    spans = pii.find(text)
    assert all(a < b <= c for (a, b, _), (c, _, _) in zip(spans, spans[1:]))
    assert permute_text("Ab-1 x9!", KEY).translate(str.maketrans("", "", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")) == "- !"


def test_table(spark):
    long = "word " * 200_000 + "ring 555-0180 now"
    data = [(1, "ring 555-0180 now", "p"), (2, None, "p"), (3, "", "p"), (None, "ring 555-0180 now", "p"), (5, long, "p"), (1, "ring 555-0180 now", "p")]
    df = spark.createDataFrame(data, "row_id long, text string, pii_type string")
    got = [tuple(r)[:4] for r in pii.occurrences(df, F.col("row_id"), F.col("text"), KEY).collect()]
    assert sorted(got, key=str) == sorted([(1, "phone", 5, 13), (1, "phone", 5, 13), (None, "phone", 5, 13), (5, "phone", 1_000_005, 1_000_013)], key=str)
    clean = [r.text for r in pii.redacted(df, F.col("row_id"), F.col("text"), KEY).collect()]
    assert clean[1] is None and clean[2] == "" and "555-0180" not in clean[0]
    assert pii.occurrences(df.limit(0), F.col("row_id"), F.col("text"), KEY).count() == 0
