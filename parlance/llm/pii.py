"""Personal information inside free text: found by form and context, replaced by typed placeholders.

Numbers are accepted by the rules of their numbering plan (length, leading digits, check digits) or by a label that
names them.  A placeholder reads ``[PHONE:1-402-881-3920]``: the type, and a keyed pseudonym in the same format, so
the text stays readable and equal values stay linked across documents.  Pseudonyms of valid numbers are valid under the
same plan: the free digits are permuted, check digits are computed anew.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Collection, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from parlance.llm.pseudonym import DIGITS, permute, permute_date, permute_text, within

# ---- e-mail -------------------------------------------------------------------------------------------------
_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_+-])?"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_DOT = r"(?:\.|\s?[\[({<]\s?dot\s?[\])}>]\s?|\sdot\s)"
_TLD = r"[A-Za-z]{2,12}(?![A-Za-z0-9-])"
AT = re.compile(r"\s?(?:[@＠]|[\[({<]\s?at\s?[\])}>])\s?", re.I)
AT_WORD = re.compile(r"\sat\s", re.I)
DOMAIN = re.compile(rf"(?:{_LABEL}{_DOT})+{_TLD}", re.I)
DOMAIN_WORDS = re.compile(rf"(?:{_LABEL}\sdot\s)+{_TLD}", re.I)
LOCAL = re.compile(_LOCAL)
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def local_start(text: str, end: int) -> int | None:
    """Where the local part that ends at ``end`` begins; None if there is none."""
    at = end
    while at and text[at - 1] in _LOCAL_CHARS:
        at -= 1
    whole = LOCAL.fullmatch(text, at, end) and not (at and (text[at - 1].isalnum() or text[at - 1] == "_"))
    return at if whole else None


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses around every at sign, written as a sign, in brackets or as a word."""
    marks = []
    if "@" in text or "＠" in text or re.search(r"[\[({<]\s?at\s?[\])}>]", text, re.I):
        marks.append((AT, DOMAIN))
    if "dot" in text or "DOT" in text or "Dot" in text:
        marks.append((AT_WORD, DOMAIN_WORDS))
    for at, domain in marks:
        for m in at.finditer(text):
            right = domain.match(text, m.end())
            left = local_start(text, m.start()) if right else None
            if left is not None:
                yield left, right.end()


# ---- identity numbers ---------------------------------------------------------------------------------------
_SEP = "[-\u2010\u2011\u2013 \u00a0]"
IDENTITY = re.compile(
    rf"""(?<![\w+/=-])(?:
      (?P<ssn>\d{{3}}(?P<s>{_SEP}?)\d{{2}}(?P=s)\d{{4}})
    | (?P<nino>[A-Z]{{2}}\s?\d{{2}}\s?\d{{2}}\s?\d{{2}}\s?[A-D])
    | (?P<dni>\d{{8}}-?[A-Z])
    | (?P<rut>\d{{1,2}}\.\d{{3}}\.\d{{3}}-[\dkK])
    | (?P<licence>[A-Z]\d{{3}}-\d{{4}}-\d{{4}})
    | (?P<passport>[A-Z]{{1,2}}(?:\s\d{{3}}\s\d{{4}}|\d{{6,8}}))
    )(?![\w+/=]|-\d)""",
    re.X | re.I,
)
ID_LABEL = re.compile(
    r"(?:\bSSN|social\s+security|national\s+insurance|\bNINO?|\bNI\s+number|\bDNI|\bNIF|\bRUT|passport|licen[cs]e|"
    r"\bidentity|national\s+id|\bID)(?:\s+(?:card|number|no\.?|nr\.?|num\.?|is))*\s*[:#]?\s*",
    re.I,
)
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"  # fixed value: the check letters in the order of the remainder


def dni_valid(v: str) -> bool:
    digits = re.sub(r"\D", "", v)
    return DNI_LETTERS[int(digits) % 23] == v[-1].upper()


def rut_check(body: str) -> str:
    rest = 11 - sum(int(c) * (2 + i % 6) for i, c in enumerate(reversed(body))) % 11
    return {11: "0", 10: "K"}.get(rest, str(rest))


def rut_valid(v: str) -> bool:
    return v[-1].upper() == rut_check(re.sub(r"\D", "", v[:-1]))


def ssn_given(digits: str) -> bool:
    """Area 000 and 666, group 00 and serial 0000 are never given out."""
    return digits[:3] not in ("000", "666") and digits[3:5] != "00" and digits[5:] != "0000"


def identity_valid(kind: str, m: re.Match, labels: Collection[int]) -> bool:
    """A label right before the number decides; without one, the form must be unmistakable or its check digit right."""
    if m.start() in labels:
        return True
    v = m.group()
    if kind == "ssn":
        return m.group("s") not in ("", " ", "\u00a0") and ssn_given(re.sub(r"\D", "", v))
    if kind in ("nino", "licence"):
        return v.upper() == v
    if kind == "dni":
        return dni_valid(v) and v.upper() == v
    return kind == "rut" and rut_valid(v)


#: Every number below, identity or telephone, holds such a run; only its surroundings are looked at closely.
RUN = re.compile("\\d[\\d\\s.()/\u00a0\u2010\u2011\u2013-]{4,}[\\dA-Za-z]")

# ---- telephone ----------------------------------------------------------------------------------------------
_S = "[-\u2010\u2011\u2013. \u00a0]"
PHONE = re.compile(
    rf"""(?<![\w+/=.,:-])(?:
      (?P<intl>(?:\+|00)\d{{1,3}}(?:{_S}?\(0\))?(?:[-\u2010\u2011\u2013. \u00a0/]?\(?\d{{1,5}}\)?){{2,6}})
    | (?P<nanp>(?:1{_S})?(?:\(\d{{3}}\)\s?|\d{{3}}{_S})\d{{3}}{_S}\d{{4}})
    | (?P<pairs>0[1-9](?:[. \u00a0-]\d{{2}}){{4}})
    | (?P<trunk>0\d{{2,4}}[ /\u00a0-]\d{{3,8}}(?:[ \u00a0-]\d{{3,4}})?)
    | (?P<bare>1?[2-9]\d{{2}}[2-9]\d{{6}})
    | (?P<local>[2-9]\d{{2}}[-\u2010\u2011\u2013.]\d{{4}})
    )(?![\w+/=]|[-\u2010\u2011\u2013.,:]\d)""",
    re.X,
)
_DIGIT_WORD = "(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
SPOKEN = re.compile(rf"(?<![\w-]){_DIGIT_WORD}(?:(?:\s{{1,3}}|-){_DIGIT_WORD}){{6,14}}(?![\w-])", re.I)
WORD_DIGIT = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}


def phone_valid(kind: str, v: str) -> bool:
    n = sum(c.isdigit() for c in v)
    if kind == "intl":
        return 8 <= n <= 15
    if kind == "trunk":
        return 10 <= n <= 12
    if kind == "nanp":
        digits = re.sub(r"\D", "", v)[-10:]
        return digits[0] not in "01"
    return True


# ---- street address -----------------------------------------------------------------------------------------
_KIND = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Court|Ct|Close|Terrace|Crescent|Place|Boulevard|Blvd|Way|Square|Row|Gardens)"
_CAP = r"[A-ZÀ-Þ][\w'’-]+"
_NO_WORD = r"(?:of|the|near|at|in|on|to|a|an|and|by|from|with|over|down|up|his|her|this|that|each|gp|silver|paces)\b"
HOUSE = re.compile(r"(?<![\w.,:+/=-])\d{1,5}[a-z]?\s(?=[^\W\d_]{3})")
STREET = re.compile(rf"(?:{_CAP}\s){{1,3}}{_KIND}\b\.?|(?!{_NO_WORD})[a-z]{{3,}}\s{_KIND.lower()}\b\.?")
UNIT = re.compile(r"(?<!\w)(?:Flat|Apt\.?|Apartment|Unit|Suite|Room)\s+\d+[A-Za-z]?,?\s+", re.I)
BOX = re.compile(r"(?<!\w)P\.?\s?O\.?\s?Box\s\d+", re.I)
GERMAN_MARKS = ("weg ", "straße ", "strasse ", "gasse ", "platz ", "allee ", "str. ", "Weg ", "Straße ", "Strasse ", "Gasse ", "Platz ", "Allee ")
GERMAN = re.compile(
    r"(?<!\w)[A-ZÀ-Þ]\w+(?:(?:weg|straße|strasse|gasse|platz|allee|str\.)|\s(?:Weg|Straße|Strasse|Gasse|Platz|Allee))\s\d{1,4}[a-z]?\b"
)


#: Streets named after their kind, as in Romance languages, with the number before or behind.
ROMANCE_MARKS = ("calle ", "avenida ", "plaza ", "paseo ", "rue ", "boulevard ", "via ", "viale ", "piazza ", "corso ", "rua ", "praça ")
_ROMANCE = (
    r"(?:[Cc]alle|[Aa]venida|[Pp]laza|[Pp]aseo|[Rr]ue|[Bb]oulevard|Via|[Vv]iale|[Pp]iazza|[Cc]orso|[Rr]ua|[Pp]raça)"
    rf"(?:\s(?:de|del|des|du|da|do|dos|di|della|dei|la|las|le|les|los)){{0,2}}\s{_CAP}(?:\s{_CAP})?"
)
ROMANCE = re.compile(rf"(?<![\w.,:+/=-])(?:\d{{1,4}}(?:\s?(?:bis|ter|[a-d]))?,?\s{_ROMANCE}|{_ROMANCE},?\s(?:n[º°o]\.?\s?)?\d{{1,4}}[a-z]?\b)")


def addresses(text: str, low: str) -> Iterator[tuple[int, int]]:
    """Street addresses and boxes; ``low`` is the text in lower case, for looking for marks."""
    units: dict[int, int] | None = None
    for m in HOUSE.finditer(text):
        street = STREET.match(text, m.end())
        if street:
            if units is None:
                units = {u.end(): u.start() for u in UNIT.finditer(text)}
            yield units.get(m.start(), m.start()), street.end()
    if any(k in low for k in ROMANCE_MARKS):
        yield from (m.span() for m in ROMANCE.finditer(text))
    if "ox " in text or "OX " in text:
        yield from (m.span() for m in BOX.finditer(text))
    if any(k in text for k in GERMAN_MARKS):
        yield from (m.span() for m in GERMAN.finditer(text))


#: What may follow a street: a unit, a town, a postal code.  A town in small letters only after a street in small letters.
_FLAT = r"(?:,?\s(?:Apt\.?|Flat|Unit)\s\d+)?"
CITY = re.compile(rf"{_FLAT}(?:,\s\d{{5}}\s{_CAP}(?:\s{_CAP})?|[,\n]\s?{_CAP}(?:\s{_CAP})?(?:\s\d{{5}})?)?")
CITY_LOW = re.compile(rf"{_FLAT}(?:,\s[a-z]{{4,}}(?:\s[a-z]+)?(?=[,;.]|\s\d{{5}}|\sthis\b)(?:\s\d{{5}})?)?")


def address_end(text: str, a: int, b: int) -> int:
    return (CITY_LOW if text[a:b].islower() else CITY).match(text, b).end()


# ---- names --------------------------------------------------------------------------------------------------
#: Common given names of people, lower case.
GIVEN = frozenset(
    """adam ahmed aisha alan alexander ali alice amina amir ana andre andrea andrew angela anita anna anne anthony
    antonio barbara benjamin bridget brian carlos carmen caroline catherine charles chen chloe christian christine
    claire daniel david deborah diana diego dmitri eduardo elena elizabeth emily emma eric fatima felix fernando
    francesca frank gabriel george giulia hannah hans hassan helen henry ingrid isabel ivan james jan jean jennifer
    john jonas jorge jose joseph juan julia julian karen katarina keiko kenji kevin kwame laura layla leila linda liam
    lucas lucia luis maria marie mario mark marta martin mary mateo matthew mei michael miguel mohammed monica nadia
    natalia nicolas noor olga oliver omar owen pablo patricia paul paula pedro peter philip pierre priya rachel rafael
    rajiv rebecca renata ricardo robert rosa ruth samuel sandra sanjay sarah simon sofia sophie stefan stephen susan
    tatiana teresa thomas tomas ursula victor wei william yuki yusuf zainab""".split()
)
_W = r"[^\W\d_]+(?:['’-][^\W\d_]{2,})*"
_NICK = r"""(?:\s["“'‘][^\W\d_]+["”'’])?"""
_TITLE = r"(?:(?:Mr|Mrs|Ms|Mx|Miss|Dr|Prof|Herr|Frau|Señora?)\.?\s)?"
_PARTICLE = r"(?:\s(?:de|del|della|da|di|du|la|le|van|von|der|den|ter|bin|al|el))*"
_FULL = rf"(?P<name>{_W}{_NICK}(?:\s[^\W\d_]\.)?{_PARTICLE}\s{_W}|[^\W\d_]\.\s{_W}|{_W},\s{_W})"
_NAME = rf"{_TITLE}{_FULL}"
PARTICLES = frozenset("de del della da di du la le van von der den ter bin al el".split())
_KIN = r"(?:sister|brother|mother|father|wife|husband|partner|mum|mom|dad|son|daughter|cousin|aunt|uncle)"
_ROLE = (
    r"(?:emergency\s+contact|contact(?:\s+(?:person|sheet|details|info))?|host|hosted\s+by|organi[sz]er|attn|attention|landlord|"
    r"tenant|guardian|bill(?:ed)?\s+to|ship(?:ped)?\s+to|deliver\s+to|care\s+of|c/o)"
)
_CLOSE = r"(?:signed|(?:(?:best|kind|warm)\s+)?regards|sincerely|yours(?:\s+truly)?|cheers|best(?:\s+wishes)?|cordially|respectfully)"
_ROLE_MARKS = ("contact", "host", "organi", "attn", "attention", "landlord", "tenant", "guardian", "bill", "ship", "deliver to", "care of", "c/o")
_CLOSE_MARKS = ("signed,", "regards,", "sincerely,", "yours", "cheers,", "best", "cordially,", "respectfully,")
_BEGIN = r"(?:^|(?<=[.!?(:\n]\s)|(?<=[(:\n]))"
#: Contexts in which a person is named: marks of which one is there in lower case, the form, and how much the context
#: tells.  "person": it names a real one.  "self": it does outside quoted speech, where characters speak.  "known": only
#: with a known given name or an initial.
CONTEXTS = tuple(
    (marks, re.compile(p), tells) for marks, p, tells in (
        (("real name", "full name", "legal name", "actual name", "birth name", "passport name"), rf"(?i:\b(?:real|full|legal|actual|birth|passport)\sname\s?(?:is|['’]s|:))\s{_NAME}", "person"),
        (_ROLE_MARKS, rf"(?i:\b{_ROLE}(?:\s+is|\s?:))\s{_NAME}", "person"),
        (("c/o ",), rf"(?i:\bc/o)\s{_NAME}", "person"),
        (_CLOSE_MARKS, rf"(?i:\b{_CLOSE},)\s+{_NAME}(?=\s*(?:\(|\n|$))", "person"),
        ((" goes to ",), rf"(?i:\bcredit\s(?:for\s[^.\n]{{1,200}}?\s)?goes\sto)\s{_NAME}", "person"),
        ((" / ",), rf"(?<![\w/]){_NAME}(?=\s/\s(?:[+(\d]|(?:zero|five)\s|[\w.+-]+@))", "person"),
        ((" here",), rf"(?i:\b(?:by\sthe\sway|btw|ooc|hi|hello|hey)[,:]?)\s{_NAME}(?=\shere\b)", "person"),
        ((" here, i play", " here, i am play", " here, playing"), rf"(?<!\w){_NAME}(?=\shere,\s(?i:I\s(?:play|am\splaying)|playing)\b)", "self"),
        (("my name", "his name", "her name", "their name"), rf"(?i:\b(?:my|his|her|their)\s+name\s?(?:is|['’]s|:))\s{_NAME}", "self"),
        (("i'm ", "i’m ", "i am "), rf"{_BEGIN}(?i:I['’]m|I\sam)\s{_NAME}(?=\s*(?:[.,;!)\n]|$|and\b|from\b))", "self"),
        (("tell ",), rf"\b[Tt]ell\s{_NAME}(?=['’]s\s{_KIN}\b)", "known"),
        (("ask for ",), rf"\b[Aa]sk\sfor\s{_NAME}(?=\sat\sthe\s(?:door|desk|reception|bar|counter|front)\b)", "known"),
    )
)
#: A family name before a known given one, inside a sentence.
TURNED = re.compile(r"(?<=[a-zà-ÿ]\s)(?P<name>[^\W\d_]{3,},\s[^\W\d_]{3,})(?=\s*[.;)\n]|$)")
WORD = re.compile(r"[^\W\d_]+")
FREE = re.compile(rf"(?<![\w.@+-])(?P<given>[^\W\d_]{{2,}}){_NICK}(?:\s[^\W\d_]\.)?(?P<particle>{_PARTICLE})\s(?P<family>{_W})(?![\w@+])")
#: What follows a name in a story, or makes it that of a place: an epithet, what characters do, a kind of street.
STORY = re.compile(
    rf"\s(?:the|of)\s|\s(?:draws?|casts?|swings?|attacks?|rolls?|strikes?|raises?|nods?|grins?|charges?|parries|readies|wields?|drew|swung)\b|\s(?:{_CAP}\s)?{_KIND}\b"
)
_PUNCTUATION = str.maketrans({c: " " for c in ".,;:!?…()[]{}<>\"'“”‘’«»/@+-_*\n"})
QUOTES = "\"“”«»"
#: Words of the game that stand where a name could.
GAME_WORDS = frozenset("dungeon game master dm gm player character party team level ready".split())


def _shape(name: str) -> bool:
    """Whether every word but particles is capitalised (the given name may be an initial)."""
    return all(w[0].isupper() or w in PARTICLES for w in WORD.findall(name))


def quoted(text: str, at: int) -> bool:
    """Whether a place lies inside double quotation marks of its paragraph."""
    start = max(text.rfind("\n\n", 0, at), text.rfind("\r\n\r\n", 0, at), 0)
    return sum(text.count(q, start, at) for q in QUOTES) % 2 == 1


def names(text: str, low: str, words: set[str], cast: Collection[str] = ()) -> Iterator[tuple[int, int]]:
    """Names of persons; ``low`` is the text in lower case, ``words`` its words.

    ``cast`` holds lower-case words of the names of characters: a family name among them is theirs.
    """
    given_there = GIVEN & words
    turned = [((",",), TURNED, "known")] if given_there else []
    for marks, rx, tells in (*CONTEXTS, *turned):
        if any(m in low for m in marks):
            for m in rx.finditer(text):
                name = m.group("name")
                parts = [w.lower() for w in WORD.findall(name)]
                given, family = (parts[-1], parts[0]) if ", " in name else (parts[0], parts[-1])
                if family in cast or not GAME_WORDS.isdisjoint(parts):
                    continue
                shaped, known = _shape(name), given in GIVEN
                if tells == "person":
                    real = shaped or known
                elif tells == "self":
                    real = shaped and not quoted(text, m.start())
                else:
                    real = known and (shaped or ", " not in name) and family not in GIVEN or shaped and len(given) == 1
                if real:
                    yield m.span("name")
    for first in given_there:
        if first in cast:
            continue
        # Only the places where a known given name stands are looked at.
        for at in re.finditer(rf"(?<![\w.@+-]){first}(?!\w)", text, re.I):
            m = FREE.match(text, at.start())
            if m and m.group("given")[0].isupper() and not STORY.match(text, m.end()):
                family = m.group("family")
                if family[0].isupper() and len(family) > 2 and family.lower() not in GIVEN and family.lower() not in cast:
                    yield m.start(), m.end("family")


# ---- dates of birth -----------------------------------------------------------------------------------------
_MONTHS = "January February March April May June July August September October November December".split()
BIRTH_MARKS = ("born", "birth", "dob", "d.o.b")
BIRTH = re.compile(
    rf"""(?i:\b(?:born(?:\son)?|date\sof\sbirth|dob|d\.o\.b\.|birthday|birthdate))\s?(?:is|:|,|-)?\s(?:the\s)?(?P<date>
      (?P<y>\d{{4}})-(?P<m>\d{{2}})-(?P<d>\d{{2}}) | (?P<d2>\d{{1,2}})\.(?P<m2>\d{{1,2}})\.(?P<y2>\d{{4}})
    | (?P<m3>\d{{1,2}})/(?P<d3>\d{{1,2}})/(?P<y3>\d{{4}}) | (?P<d4>\d{{1,2}})\s(?P<m4>{"|".join(_MONTHS)})\s(?P<y4>\d{{4}})
    | (?P<m5>{"|".join(_MONTHS)})\s(?P<d5>\d{{1,2}}),\s(?P<y5>\d{{4}}))(?!\w)""",
    re.X,
)


def moved_date(m: re.Match, key: bytes) -> str | None:
    """The date's pseudonym written as the date was; None if it is no day of the calendar."""
    form = next(f for f in ("", "2", "3", "4", "5") if m.group("y" + f))
    month = m.group("m" + form)
    try:
        day = dt.date(int(m.group("y" + form)), int(month) if month.isdigit() else _MONTHS.index(month) + 1, int(m.group("d" + form)))
    except ValueError:
        return None
    new = permute_date(day, key)
    name = _MONTHS[new.month - 1]
    return {
        "": new.isoformat(), "2": f"{new.day:02d}.{new.month:02d}.{new.year}", "3": f"{new.month:02d}/{new.day:02d}/{new.year}",
        "4": f"{new.day} {name} {new.year}", "5": f"{name} {new.day}, {new.year}",
    }[form]


def find(text: str | None, cast: Collection[str] = ()) -> list[tuple[int, int, str]]:
    """``(start, end, type)`` of every occurrence, in order and without overlap; nothing for null or empty text.

    ``cast``: lower-case words of characters' names (see :func:`names`).
    """
    if not text:
        return []
    spans: list[tuple[int, int, str]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or y <= a for x, y, _ in spans)

    def add(found: Iterator[tuple[int, int]], kind: str) -> None:
        spans.extend((a, b, kind) for a, b in found if free(a, b))

    add(emails(text), "email")
    low = text.lower()
    if any(k in low for k in BIRTH_MARKS):
        add((m.span("date") for m in BIRTH.finditer(text) if moved_date(m, b"") is not None), "birth")
    runs = [(max(0, m.start() - 8), m.end() + 6) for m in RUN.finditer(text)]
    numbers = [m for a, b in runs for m in IDENTITY.finditer(text, a, b)]
    labels = {m.end() for m in ID_LABEL.finditer(text)} if numbers else ()
    add((m.span() for m in numbers if identity_valid(m.lastgroup if m.lastgroup != "s" else "ssn", m, labels)), "identity")
    add(((a, address_end(text, a, b)) for a, b in addresses(text, low)), "address")
    for a, b in runs:
        add((m.span() for m in PHONE.finditer(text, a, b) if phone_valid(m.lastgroup or "", m.group())), "phone")
    words = set(low.translate(_PUNCTUATION).split())
    if not words.isdisjoint(WORD_DIGIT):
        add((m.span() for m in SPOKEN.finditer(text)), "phone")
    add(names(text, low, words, cast), "name")
    return sorted(spans)


# ---- pseudonyms ---------------------------------------------------------------------------------------------
#: Country calling codes of one and two digits; all others have three.
_SHORT_CODES = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)


def national(value: str) -> tuple[str, str]:
    """A telephone number's digits as a prefix and the national number behind it, which all its forms share.

    The prefix is the international one with the country's code and a trunk zero, or a trunk zero, or the long-distance
    one of the North American plan.
    """
    digits = "".join(c for c in value if c in DIGITS)
    if value.lstrip().startswith("+") or digits.startswith("00"):
        at = 2 if digits.startswith("00") else 0
        at += next((n for n in (1, 2) if digits[at : at + n] in _SHORT_CODES), 3)
    else:
        at = 1 if len(digits) == 11 and digits[0] == "1" else 0
    body = digits[at:].lstrip("0")
    return digits[: len(digits) - len(body)], body


def number_kind(body: str) -> tuple[bool, bool]:
    """What a national number must stay: without a zero in front; where it fits the North American plan, within that."""
    plan = len(body) in (7, 10) and all(body[i] not in "01" for i in ((0, 3) if len(body) == 10 else (0,)))
    return body[:1] != "0", plan


def _phone(value: str, key: bytes) -> str:
    if any(c in DIGITS for c in value):
        head, body = national(value)
        new = iter(head + within(body, lambda b: permute(b, key), number_kind))
        return "".join(next(new) if c in DIGITS else c for c in value)
    digits = "".join(WORD_DIGIT[w.lower()] for w in WORD.findall(value))
    back = "zero one two three four five six seven eight nine".split()
    return " ".join(back[int(c)] for c in within(digits, lambda b: permute(b, key), number_kind))


#: Letters and pairs that no national insurance number begins with.
_NINO_FIRST, _NINO_SECOND, _NINO_PAIRS = "DFIQUV", "DFIQUVO", ("BG", "GB", "NK", "KN", "TN", "NT", "ZZ")


def nino_prefix(pair: str) -> bool:
    return pair[0] not in _NINO_FIRST and pair[1] not in _NINO_SECOND and pair not in _NINO_PAIRS


def _identity(value: str, key: bytes) -> str:
    m = IDENTITY.fullmatch(value)
    kind = (m.lastgroup if m.lastgroup != "s" else "ssn") if m else ""
    bare = re.sub(r"[^0-9A-Za-z]", "", value).upper()
    digits = "".join(c for c in bare if c in DIGITS)
    move = lambda b: permute(b, key)
    if kind == "ssn":
        bare = within(digits, move, ssn_given)
    elif kind == "nino":
        pair = within(bare[:2], lambda p: permute_text(p, key), nino_prefix)
        bare = pair + move(digits) + "ABCD"[int(permute(str("ABCD".index(bare[-1])), key, "0123"))]
    elif kind == "dni" and dni_valid(value):
        digits = move(digits)
        bare = digits + DNI_LETTERS[int(digits) % 23]
    elif kind == "rut" and rut_valid(value):
        body = within(bare[:-1], move, lambda b: b[0] != "0")
        bare = body + rut_check(body)
    elif kind in ("dni", "rut"):
        valid = dni_valid if kind == "dni" else rut_valid
        bare = within(bare, lambda b: permute_text(b, key), valid)
    else:
        bare = permute_text(bare, key)
    new = iter(bare)
    return "".join(next(new) if c.isalnum() else c for c in value)


def pseudonym(value: str, kind: str, key: bytes) -> str:
    """The value's pseudonym in its own format; forms of one value that differ in spacing or notation share it."""
    if kind == "phone":
        return _phone(value, key)
    if kind == "email":
        plain = re.sub(rf"(?i){AT.pattern}|\sat\s", "@", value, count=1)
        plain, dot, top = re.sub(rf"(?i){_DOT}", ".", plain).lower().rpartition(".")
        return permute_text(plain, key) + dot + top
    if kind == "identity":
        return _identity(value, key)
    if kind == "birth":
        return moved_date(BIRTH.match("born " + value), key) or value
    if kind == "name" and ", " in value:
        value = " ".join(reversed(value.split(", ", 1)))
    return permute_text(" ".join(value.split()).title(), key)


def marked(text: str | None, key: bytes, cast: Collection[str] = ()) -> list[tuple[int, int, str, str]]:
    """``(start, end, type, pseudonym)`` of every occurrence, in order."""
    return [(a, b, kind, pseudonym(text[a:b], kind, key)) for a, b, kind in find(text, cast)]


def redact(text: str | None, key: bytes, cast: Collection[str] = ()) -> str | None:
    """The text with ``[TYPE:pseudonym]`` in place of every occurrence; everything else as it was, null stays null."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind, stands in marked(text, key, cast):
        out += [text[at:a], f"[{kind.upper()}:{stands}]"]
        at = b
    return "".join([*out, text[at:]])


def _words(names_: object) -> frozenset[str]:
    """Lower-case words of a row's names of characters; none for null."""
    return frozenset(w.lower() for n in (names_ if names_ is not None else ()) if n for w in WORD.findall(n))


def _narrow(df: DataFrame, key: Column, text: Column, cast: Column | None) -> DataFrame:
    return df.select(key.alias("key"), text.alias("text"), (cast if cast is not None else F.lit(None)).cast("array<string>").alias("cast"))


def occurrences(df: DataFrame, key: Column, text: Column, secret: bytes, cast: Column | None = None) -> DataFrame:
    """One row per occurrence: ``key, pii_type, start_pos, end_pos, pseudonym``; places in code points, the end exclusive.

    ``pii_type`` is ``email``, ``phone``, ``identity``, ``address``, ``name`` or ``birth`` (a date of birth).  ``cast`` is an
    array of names of characters that play in the row, null if none is known.  Null and empty texts give no row.  Rows
    stand for themselves, repeated or not; a null key is kept.  Texts of any length are read whole.  Extra columns of
    ``df`` play no role.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (k, kind, a, b, stands) for k, t, c in zip(batch["key"], batch["text"], batch["cast"], strict=True) for a, b, kind, stands in marked(t, secret, _words(c))
            ]
            yield pd.DataFrame(rows, columns=["key", "pii_type", "start_pos", "end_pos", "pseudonym"])

    narrow = _narrow(df, key, text, cast).where("text <> ''")
    return narrow.mapInPandas(run, f"key {narrow.schema['key'].dataType.simpleString()}, pii_type string, start_pos long, end_pos long, pseudonym string")


def redacted(df: DataFrame, key: Column, text: Column, secret: bytes, cast: Column | None = None) -> DataFrame:
    """``key, text`` of every row with the text redacted under ``secret``; null and empty texts come back as they are."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series, casts: pd.Series) -> pd.Series:
        return pd.Series([redact(t, secret, _words(c)) if isinstance(t, str) else None for t, c in zip(texts, casts, strict=True)])

    return _narrow(df, key, text, cast).select("key", clean("text", "cast").alias("text"))
