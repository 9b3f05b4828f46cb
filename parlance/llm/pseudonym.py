"""Keyed, format-preserving pseudonyms: a Feistel network permutes the digits and letters of a value.

The result has the same length, separators, case and character classes.  The permutation depends on the key and on
the value's length only, so equal values get equal pseudonyms in every document, and the holder of the key can undo
them.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import unicodedata
from collections.abc import Callable, Hashable

ROUNDS = 8
DIGITS = "0123456789"
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _round(key: bytes, i: int, size: int, half: str, modulus: int) -> int:
    digest = hashlib.blake2b(f"{i}|{size}|{half}".encode(), key=key, digest_size=16).digest()
    return int.from_bytes(digest, "big") % modulus


def _number(s: str, alphabet: str) -> int:
    n = 0
    for c in s:
        n = n * len(alphabet) + alphabet.index(c)
    return n


def _string(n: int, size: int, alphabet: str) -> str:
    out = []
    for _ in range(size):
        n, r = divmod(n, len(alphabet))
        out.append(alphabet[r])
    return "".join(reversed(out))


def permute(s: str, key: bytes, alphabet: str = DIGITS, inverse: bool = False) -> str:
    """The permuted string over ``alphabet``; one to one on strings of the same length."""
    if not s:
        return s
    if len(s) == 1:
        base = len(alphabet)
        shift = _round(key, 0, 1, alphabet, base)
        return alphabet[(alphabet.index(s) + (-shift if inverse else shift)) % base]
    cut = len(s) // 2
    left, right = s[:cut], s[cut:]
    for i in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        # Even rounds change the left half, odd rounds the right one; each depends on the other half only.
        side, other = (left, right) if i % 2 == 0 else (right, left)
        modulus = len(alphabet) ** len(side)
        f = _round(key, i, len(s), other, modulus)
        side = _string((_number(side, alphabet) + (-f if inverse else f)) % modulus, len(side), alphabet)
        left, right = (side, right) if i % 2 == 0 else (left, side)
    return left + right


def permute_text(s: str, key: bytes, inverse: bool = False) -> str:
    """Digits permuted among digits and letters among letters, everything else and the case kept.

    Letters with accents are permuted as their base letter; such a value cannot be undone to its accents.
    """
    plain = [unicodedata.normalize("NFKD", c)[0] if c.isalpha() else c for c in s]
    plain = [c if c.lower() in LETTERS or c in DIGITS or not c.isalpha() else "x" for c in plain]
    digits = iter(permute("".join(c for c in plain if c in DIGITS), key, DIGITS, inverse))
    letters = iter(permute("".join(c.lower() for c in plain if c.lower() in LETTERS), key, LETTERS, inverse))
    out = []
    for c in plain:
        if c in DIGITS:
            out.append(next(digits))
        elif c.lower() in LETTERS:
            out.append(next(letters).upper() if c.isupper() else next(letters))
        else:
            out.append(c)
    return "".join(out)


def within(s: str, step: Callable[[str], str], kind: Callable[[str], Hashable]) -> str:
    """``step`` repeated until the value is of the same kind again.

    Where ``step`` is one to one on a finite set, so is this on the values of each kind (cycle walking).
    """
    wanted, s = kind(s), step(s)
    while kind(s) != wanted:
        s = step(s)
    return s


FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1), dt.date(2099, 12, 31)


def permute_date(day: dt.date, key: bytes, inverse: bool = False) -> dt.date:
    """A date of 1900 to 2099 permuted among those dates; cycle walking keeps it in range.  Others come back as they are."""
    span = (LAST_DAY - FIRST_DAY).days + 1
    n = (day - FIRST_DAY).days
    if not 0 <= n < span:
        return day
    while True:
        n = int(permute(f"{n:05d}", key, DIGITS, inverse))
        if n < span:
            return FIRST_DAY + dt.timedelta(days=n)
