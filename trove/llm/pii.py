"""Operator 8, format-preserving pseudonyms for personal data.

Validated values (payment cards by Luhn, IBANs by mod 97, social security
numbers by their ranges, IPv4 by octets, calendar dates, phone numbers by
digit count), e-mail addresses and secrets in an assignment are replaced by a
keyed permutation of themselves inside their own format: same length, same
separators, again valid. The permutation is a Feistel network with
cycle-walking, so it is one-to-one: equal values stay equal in every document
(however they are spaced or cased), different values stay different, and the
holder of the key can undo it.

A match may take in a word or number that follows the value. So a card is cut
to its shortest grouping that passes, an IBAN to its country's length, a phone
number to its longest grouping that passes; if none does, the search goes on
just after the start of the match. Whether the shorter grouping passes is a
property that the permutation keeps, so undoing cuts at the same place.

Numbers that fail their check (a 16-digit number with a wrong Luhn digit, the
date 2021-02-30) are not personal data and stay as they are, and so do numbers
in digits of other scripts than 0-9: the checks are made for those. Row-local: no
shuffle, no state. Not undone with certainty: a value that directly follows
digits in its own format (for a card one case in ten), as its pseudonym may
pass together with them.

Letters and digits of every script are permuted among those of their own script
and kind (as the worker's Unicode tables list them; key holders need the same
version to undo). A value without any such character, as in "_@example.com",
has only itself as an image and is not counted.

Defined results: null text becomes empty; repeated rows each give a row; null
ids pass; texts without personal data come back byte for byte; extra columns
are left behind by ``find_and_replace`` and kept by ``pseudonymise``.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
import sys
import unicodedata
from collections import Counter, defaultdict
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import batch_slices, map_batches, texts_of

ROUNDS = 10
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

_DIGITS, _HEX = "0123456789", "0123456789abcdef"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_ACCENTED = "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"

#: Fixed patterns, tried in this order at each place.
PATTERN = re.compile(r"""
  (?i:\b(?P<lead>(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s*[=:]\s*["']?))(?P<secret>[A-Za-z0-9+/_-]{16,}(?:\.[A-Za-z0-9+/_-]{16,})*)(?![A-Za-z0-9+/_-])
 |(?P<email>(?<![\w.%+-])\w[\w.%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})
 |(?P<iban>(?<!\w)[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w))
 |(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9]))
 |(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
 |(?P<iso>(?<![\w-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![\w-]))
 |(?P<dotted>(?<![\w.])[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}(?!\w|\.[0-9]))
 |(?P<slashed>(?<![\w/])[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![\w/]))
 |(?P<phone>(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?!\w)
   |(?<![\w+])\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}(?!\w))
 |(?P<card>(?<![\w-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![\w-]))
""", re.X)
#: Places where a match that failed may end sooner: before a separator.
_CUT = re.compile(r"[ -]")
#: Lengths of the IBANs of each country.
IBAN_LENGTH = {c: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ DZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 33: "LC RU"}.items() for c in countries.split()}
#: Secrets up to LONGEST_WORD characters are permuted as one number, longer ones in pieces.
LONGEST_WORD, PIECE = 96, 64
_MAYBE = re.compile(r"[0-9@]|(?i:token|secret|passw|key)")


CARD = re.compile(r"[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}")
PHONE = re.compile(r"\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}")


class Feistel:
    """A keyed permutation of 0 .. n-1 for any n."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _f(self, kind: str, n: int, i: int, half: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{kind}|{n}|{i}|{half}".encode(), key=self.key, digest_size=64).digest(), "big")

    def _pass(self, kind: str, n: int, x: int, undo: bool) -> int:
        a = math.isqrt(max(0, n - 1)) + 1
        b = -(-n // a)
        left, right = divmod(x, b)
        for i in (reversed(range(ROUNDS)) if undo else range(ROUNDS)):
            if i % 2:
                f = self._f(kind, n, i, left)
                right = (right + (-f if undo else f)) % b
            else:
                f = self._f(kind, n, i, right)
                left = (left + (-f if undo else f)) % a
        return left * b + right

    def permute(self, kind: str, n: int, x: int, valid=lambda y: True, undo: bool = False) -> int:
        """The image of x; the walk goes on until it is inside 0 .. n-1 and
        ``valid`` (which must hold for x), so it stays one-to-one there."""
        while True:
            x = self._pass(kind, n, x, undo)
            if x < n and valid(x):
                return x


def luhn_digit(body: str) -> str:
    """The check digit that makes body + digit valid."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _short_card(digits: str) -> bool:
    """A longer number whose first 16 digits are a card by themselves."""
    return len(digits) > 16 and luhn_digit(digits[:15]) == digits[15]


def _short_iban(bare: str) -> bool:
    """A longer text that starts with an IBAN of its country's length."""
    n = IBAN_LENGTH.get(bare[:2], len(bare))
    return n < len(bare) and _mod97(bare[4:n] + bare[:4]) == 1


@cache
def _alphabets() -> dict[str, str]:
    """Every letter and digit that stands in words as a lower-case or uncased
    character -> the characters of its script and kind, itself among them.
    Cased ones have a capital of one character that leads back to them."""
    kinds = defaultdict(list)
    for i in range(0x80, sys.maxunicode + 1):
        c = chr(i)
        if not c.isalnum() or c in _ACCENTED or (len(c.lower()) == 1 and c.lower() != c):
            continue
        cased = c.upper() != c and len(c.upper()) == 1 and c.upper().lower() == c
        script = unicodedata.name(c, "").split(" ")[0].split("-")[0]
        kind = (script, unicodedata.category(c), cased, unicodedata.normalize("NFKC", c) == c)
        kinds[("CJK", "Lo", False, True) if c == "〇" else kind].append(c)
    for k in [k for k, members in kinds.items() if len(members) == 1]:              # single ones share an alphabet
        kinds[("LATIN", "Ll", True, True) if k[2] else ("", k[1], False, False)] += kinds.pop(k)
    return {c: alphabet for alphabet in map("".join, kinds.values()) for c in alphabet}


@cache
def _places(alphabet: str) -> dict[str, int]:
    return {c: i for i, c in enumerate(alphabet)}


def _alphabet(c: str) -> str:
    return next((s for s in (_LETTERS, _DIGITS, _ACCENTED) if c in s), None) or (c if c < "\x80" else _alphabets().get(c, c))


def _poured(shape: str, chars: str) -> str:
    """``chars`` in the places of the letters and digits of ``shape``."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in shape)


class Pseudonyms:
    """Replaces every value it validates; ``found`` counts them by kind."""

    def __init__(self, key: bytes, undo: bool = False):
        self.f, self.undo, self.found = Feistel(key), undo, Counter()

    def _number(self, kind: str, n: int, x: int, valid=lambda y: True) -> int:
        return self.f.permute(kind, n, x, valid, self.undo)

    def _word(self, kind: str, word: str, hexadecimal: bool = False, valid=lambda word: True) -> str | None:
        """Letters and digits permuted within their class; case and all other
        characters stay in place. None if that leaves only the word itself."""
        low = [c.lower() if len(c.lower()) == 1 else c for c in word]
        sets = [_HEX if hexadecimal else _alphabet(c) for c in low]
        x, n = 0, math.prod(map(len, sets))
        if n == 1:
            return None
        for c, s in zip(low, sets):
            x = x * len(s) + (s.index(c) if len(s) < 64 else _places(s)[c])

        def spelled(x: int) -> str:
            out = []
            for s in reversed(sets):
                x, at = divmod(x, len(s))
                out.append(s[at])
            return "".join(c.upper() if w.isupper() and len(c.upper()) == 1 else c for c, w in zip(reversed(out), word))
        return spelled(self._number(kind, n, x, lambda y: valid(spelled(y))))

    def secret(self, v: str) -> str | None:
        hexadecimal = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", v) is not None
        if not hexadecimal:
            return self._long("secret", v, False)
        upper = any(c.isupper() for c in v)
        out = self._long("secret", v.lower(), True)
        return out and (out.upper() if upper else out)

    def _long(self, kind: str, v: str, hexadecimal: bool) -> str | None:
        """``_word`` for a value of any length: beyond PIECE characters it goes
        piece by piece, each under a permutation that the pseudonym before
        it selects, so that it stays one-to-one and can be undone."""
        if len(v) <= LONGEST_WORD:
            return self._word(kind, v, hexadecimal)
        out, before, changed = [], f"{kind}|{len(v)}", False
        for at in range(0, len(v), PIECE):
            piece = v[at:at + PIECE]
            new = self._word(before, piece, hexadecimal)
            changed |= new is not None
            out.append(piece if new is None else new)
            before = f"{kind}|{(piece if self.undo else out[-1]).lower()}"
        return "".join(out) if changed else None

    def email(self, v: str) -> str | None:
        local, _, domain = v.partition("@")
        new = self._word("email@" + domain.lower(), local)
        return new and f"{new}@{domain}"

    def iban(self, v: str) -> str | None:
        bare = v.replace(" ", "")
        if not 15 <= len(bare) <= 34 or _mod97(bare[4:] + bare[:4]) != 1:
            return None
        def whole(body: str) -> str:
            return f"{bare[:2]}{98 - _mod97(body + bare[:2] + '00'):02d}{body}"
        short = _short_iban(bare)
        return _poured(v, whole(self._word("iban", bare[4:], valid=lambda body: _short_iban(whole(body)) == short)))

    def ip(self, v: str) -> str | None:
        parts = [int(x) for x in v.split(".")]
        if max(parts) > 255:
            return None
        x = self._number("ip", 1 << 32, int.from_bytes(bytes(parts), "big"))
        return ".".join(map(str, x.to_bytes(4, "big")))

    def ssn(self, v: str) -> str | None:
        def valid(x: int) -> bool:
            area, group, serial = x // 10 ** 6, x // 10 ** 4 % 100, x % 10 ** 4
            return area not in (0, 666) and area < 900 and group > 0 and serial > 0
        x = int(v.replace("-", ""))
        return _poured(v, f"{self._number('ssn', 10 ** 9, x, valid):09d}") if valid(x) else None

    def _day(self, year: str, month: str, day: str, valid=lambda d: True) -> datetime.date | None:
        try:
            date = datetime.date(int(year), int(month), int(day))
        except ValueError:
            return None
        if not FIRST_DAY <= date.toordinal() <= LAST_DAY:
            return None
        n = LAST_DAY - FIRST_DAY + 1
        x = self._number("date", n, date.toordinal() - FIRST_DAY,
                         lambda y: valid(datetime.date.fromordinal(y + FIRST_DAY)))
        return datetime.date.fromordinal(x + FIRST_DAY)

    def iso(self, v: str) -> str | None:
        date = self._day(*v.split("-"))
        return date and date.isoformat()

    def _short(self, a: str, b: str, first: int, second: int, sep: str, year: int) -> str:
        padded = len(a) == len(b) == 2
        return sep.join([f"{first:02d}" if padded else str(first), f"{second:02d}" if padded else str(second), f"{year:04d}"])

    def dotted(self, v: str) -> str | None:
        a, b, year = v.split(".")
        date = self._day(year, b, a, self._same_width(a, b))
        return date and self._short(a, b, date.day, date.month, ".", date.year)

    def slashed(self, v: str) -> str | None:
        a, b, year = v.split("/")
        if int(a) > 12:                                   # only day/month is possible, and must stay so
            date = self._day(year, b, a, lambda d: d.day > 12 and self._same_width(a, b)(d))
            return date and self._short(a, b, date.day, date.month, "/", date.year)
        date = self._day(year, a, b, self._same_width(a, b))
        return date and self._short(a, b, date.month, date.day, "/", date.year)

    @staticmethod
    def _same_width(a: str, b: str):
        """Unpadded dates stay recognisably unpadded, padded ones are free."""
        if len(a) == len(b) == 2:
            return lambda d: True
        return lambda d: d.day < 10 or d.month < 10

    def phone(self, v: str) -> str | None:
        code = re.match(r"\+[0-9]{1,3}", v)
        lead = code[0] if code else ""
        rest = v[len(lead):]
        digits = re.sub(r"\D", "", rest)
        if not 10 <= len(digits) + len(lead[1:]) <= 15 or len(digits) < 7:
            return None
        n = 10 ** len(digits)
        return lead + _poured(rest, f"{self._number('phone' + lead, n, int(digits)):0{len(digits)}d}")

    def card(self, v: str) -> str | None:
        digits = re.sub(r"\D", "", v)
        body = digits[:-1]
        if not 13 <= len(digits) <= 19 or luhn_digit(body) != digits[-1]:
            return None
        def whole(x: int) -> str:
            new = f"{x:0{len(body)}d}"
            return new + luhn_digit(new)
        short = _short_card(digits)
        return _poured(v, whole(self._number("card", 10 ** len(body), int(body), lambda x: _short_card(whole(x)) == short)))

    def _cut(self, kind: str, v: str) -> tuple[int, str] | None:
        """(characters used, pseudonym) of the match or, where it has taken in
        what follows the value, of its first groups; None if nothing passes."""
        ends = [m.start() for m in _CUT.finditer(v)] + [len(v)]
        if kind == "iban":
            n = IBAN_LENGTH.get(v[:2])
            ends = [e for e in ends if len(v[:e].replace(" ", "")) == n] + [len(v)] if n else ends
        elif kind == "phone":
            # A shorter number only where no other value starts inside the match.
            new = self.phone(v)
            if new is not None:
                return len(v), new
            inner = (CARD.match(v, c.end()) for c in _CUT.finditer(v))
            if any(m and self._cut("card", m[0]) for m in inner):
                return None
            ends = [e for e in reversed(ends[:-1]) if PHONE.fullmatch(v[:e])]
        elif kind != "card":
            ends = ends[-1:]
        for e in ends:
            new = getattr(self, kind)(v[:e])
            if new is not None:
                return e, new
        return None

    def replace(self, text: str) -> str:
        """The text with every validated value replaced."""
        self.found = Counter()
        if _MAYBE.search(text) is None:
            return text

        out, done, at = [], 0, 0
        while (m := PATTERN.search(text, at)) is not None:
            kind = m.lastgroup
            got = self._cut(kind, m[kind])
            if got is None:
                at = m.start() + 1                          # another value may start inside the match
                continue
            self.found["date" if kind in ("iso", "dotted", "slashed") else kind] += 1
            out += [text[done:m.start(kind)], got[1]]
            done = at = m.start(kind) + got[0]
        return "".join([*out, text[done:]])


def find_and_replace(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (with pseudonyms), n_found, kinds ("card:1,email:2")."""
    def run(batches):
        p = Pseudonyms(key)
        for b, texts in (x for b in batches for x in batch_slices(b, 1)):
            text, n, kinds = [], [], []
            for t in texts:
                text.append(p.replace(t))
                n.append(sum(p.found.values()))
                kinds.append(",".join(f"{k}:{c}" for k, c in sorted(p.found.items())))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(kinds, pa.string())],
                                             names=["doc_id", "text", "n_found", "kinds"])
    return map_batches(texts_of(docs, id_col, text_col), run, "doc_id long, text string, n_found long, kinds string")


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", undo: bool = False) -> DataFrame:
    """All columns of ``docs`` with the values of ``text_col`` replaced (or,
    with ``undo``, put back); null text becomes empty."""
    at = docs.columns.index(text_col)

    def run(batches):
        p = Pseudonyms(key, undo)
        for b, texts in (x for b in batches for x in batch_slices(b, at)):
            text = pa.array([p.replace(t) for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([text if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)
    schema = T.StructType([T.StructField(f.name, T.StringType() if i == at else f.dataType) for i, f in enumerate(docs.schema.fields)])
    return map_batches(docs, run, schema)
