"""PII: format-preserving Feistel pseudonyms.

Values are found by pattern and validated: card numbers (Luhn), IBANs (mod 97), social security
numbers (assignable), phone numbers (length), IPv4 addresses (octets), calendar dates, and mail
addresses. Each valid value is replaced by another of its own format: its digits go through a keyed
Feistel permutation of the digit strings of that length; dates through one of the days from 1900 to
2099; the local parts of mail addresses through one of strings of letters and digits. Check digits
are computed anew and walks go on until the value is valid, so a pseudonym passes the validation
that found it. The same key gives equal values equal pseudonyms in all documents, however they are
punctuated, and different values of one format different ones. A phone number with + keeps its country
code, which its digits tell; written without + and code it is another value. What fails validation stays.

Nulls: a null text stays null and counts as empty. Repeated rows are treated each. Other columns
stay as they are. An empty table gives an empty result.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, packed, pieces, unpacked

#: For tests and examples; a deployment passes its own.
EXAMPLE_KEY = b"example key, replace it"
ROUNDS = 10
FIRST_DAY, DAYS = dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal() - dt.date(1900, 1, 1).toordinal()
KINDS = ["email", "ip", "iban", "card", "ssn", "date", "phone"]
_ALNUM = "0123456789abcdefghijklmnopqrstuvwxyz"

# Country codes of one and of two digits (ITU-T E.164); all others have three.
COUNTRY_CODES = {
    "1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49",
    "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86",
    "90", "91", "92", "93", "94", "95", "98",
}


def country_code(digits: str) -> str:
    """The country code at the beginning of an international number."""
    return next((digits[:n] for n in (1, 2) if digits[:n] in COUNTRY_CODES), digits[:3])


_START = re.compile(r"(?<![\w.+])(?:[+(]?\d|[A-Z]{2}\d{2})", re.A)
_MAIL = re.compile(r"[\w.%+-]*\w@\w[\w-]*(?:\.[\w-]+)*\.[^\W\d_]{2,}")
_PATTERNS = {
    "ip": re.compile(r"\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", re.A),
    "iban": re.compile(r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])", re.A),
    "card": re.compile(r"(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?!\w)", re.A),
    "ssn": re.compile(r"\d{3}-\d{2}-\d{4}(?![\w-])", re.A),
    "date": re.compile(r"(?:(\d{4})([-/.])(\d{1,2})\2(\d{1,2})|(\d{1,2})([-/.])(\d{1,2})\6(\d{4}))(?![\w]|[-/.]\d)", re.A),
    "phone": re.compile(
        r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}([ .-])\d{3}\1\d{4}|\+\d{8,15})(?![\w]|[.-]\d)", re.A
    ),
}


def _halves(n: int) -> tuple[int, int]:
    return n // 2, n - n // 2


class Feistel:
    """Keyed permutations of numbers below radix ** n, and of any range by walking on."""

    def __init__(self, key: bytes):
        self.key = key

    def _mix(self, label: str, step: int, half: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{label}|{step}|{half}".encode(), key=self.key[:64], digest_size=16).digest(), "big")

    def number(self, x: int, radix: int, n: int, label: str, back: bool = False) -> int:
        """The image of x, a number of n digits (two or more); ``back`` undoes it."""
        u, v = (radix**k for k in _halves(n))
        label = f"{label}|{radix}|{n}"
        a, b = divmod(x, v)
        for step in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if step % 2 == 0:
                a = (a + (-1 if back else 1) * self._mix(label, step, b)) % u
            else:
                b = (b + (-1 if back else 1) * self._mix(label, step, a)) % v
        return a * v + b

    def digits(self, s: str, label: str, back: bool = False) -> str:
        """The image of a digit string of the same length; one digit alone is shifted by the key."""
        if len(s) == 1:
            return str((int(s) + (-1 if back else 1) * self._mix(label, 0, 0)) % 10)
        return str(self.number(int(s), 10, len(s), label, back)).zfill(len(s))

    def below(self, x: int, limit: int, label: str, back: bool = False) -> int:
        """A permutation of 0 .. limit - 1: images outside are permuted again."""
        n = max(2, len(str(limit - 1)))
        while True:
            x = self.number(x, 10, n, label, back)
            if x < limit:
                return x

    def word(self, s: str, label: str, back: bool = False) -> str:
        """The image of a string of letters a-z and digits of the same length."""
        n = max(2, len(s))
        x = int(s, 36)
        while True:
            x = self.number(x, 36, n, label, back)
            if x < 36 ** len(s):
                break
        out = ""
        for _ in s:
            x, r = divmod(x, 36)
            out = _ALNUM[r] + out
        return out


def luhn(s: str) -> int:
    """The sum whose last digit is 0 for valid numbers."""
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s)))


def iban_rest(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def refill(shape: str, chars: str) -> str:
    """``shape`` with its letters and digits replaced by ``chars`` in turn."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _ssn_valid(s: str) -> bool:
    return s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"


def _date_of(m) -> dt.date | None:
    y, a, b = (m[1], m[3], m[4]) if m[1] else (m[8], m[7], m[5])
    try:
        # year last: day first unless only month first is a date, or a slash says so
        if not m[1] and (m[6] == "/" or int(a) > 12):
            try:
                d = dt.date(int(y), int(m[5]), int(m[7]))
            except ValueError:
                d = dt.date(int(y), int(m[7]), int(m[5]))
        else:
            d = dt.date(int(y), int(a), int(b))
    except ValueError:
        return None
    return d if 1900 <= d.year <= 2099 else None


def _month_first(m, d: dt.date) -> bool:
    return not m[1] and int(m[5]) == d.month and (m[6] == "/" or int(m[7]) == d.day)


def _date_text(m, old: dt.date, new: dt.date) -> str:
    fill = lambda x, like: str(x).zfill(2) if len(like) == 2 else str(x)
    if m[1]:
        return f"{new.year}{m[2]}{fill(new.month, m[3])}{m[2]}{fill(new.day, m[4])}"
    first, second = (new.month, new.day) if _month_first(m, old) and not (m[6] != "/" and int(m[5]) == old.day) else (new.day, new.month)
    return f"{fill(first, m[5])}{m[6]}{fill(second, m[7])}{m[6]}{new.year}"


def mails(text: str):
    """The matches of _MAIL, left to right: from each @ to the left, so that long runs without one cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and (text[start - 1] in ".%+-_" or text[start - 1].isalnum()):
            start -= 1
        m = _MAIL.match(text, start)
        if m:
            yield m
            end = m.end()
        at = text.find("@", max(at + 1, end))


class Pseudonyms:
    """Finds values in texts and replaces them."""

    def __init__(self, key: bytes):
        self.f = Feistel(key)

    def replacement(self, kind: str, m) -> str | None:
        """The pseudonym of a match, or None if it isn't valid."""
        s = m[0]
        digits = "".join(c for c in s if c.isdigit())
        if kind == "ip":
            parts = [int(p) for p in s.split(".")]
            if max(parts) > 255:
                return None
            x = self.f.below(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip")
            return ".".join(map(str, x.to_bytes(4, "big")))
        if kind == "card":
            if luhn(digits) % 10 or len(set(digits)) == 1:
                return None
            body = self.f.digits(digits[:-1], "card")
            return refill(s, body + str(-luhn(body + "0") % 10))
        if kind == "iban":
            flat = s.replace(" ", "")
            if not 15 <= len(flat) <= 34 or iban_rest(flat) != 1:
                return None
            own = [c for c in flat[4:] if c.isdigit()]
            new = iter(self.f.digits("".join(own), "iban" + flat[:2])) if own else iter("")
            tail = "".join(next(new) if c.isdigit() else c for c in flat[4:])
            return refill(s, f"{flat[:2]}{98 - iban_rest(flat[:2] + '00' + tail):02d}{tail}")
        if kind == "ssn":
            if not _ssn_valid(digits):
                return None
            x = digits
            while True:
                x = self.f.digits(x, "ssn")
                if _ssn_valid(x):
                    return refill(s, x)
        if kind == "date":
            d = _date_of(m)
            if d is None:
                return None
            new = dt.date.fromordinal(FIRST_DAY + self.f.below(d.toordinal() - FIRST_DAY, DAYS, "date"))
            return _date_text(m, d, new)
        if kind == "phone":
            if not 8 <= len(digits) <= 15:
                return None
            keep = len(country_code(digits)) if s[0] == "+" else 0
            return refill(s, digits[:keep] + self.f.digits(digits[keep:], "phone" + digits[:keep]))
        local, _, domain = s.rpartition("@")
        lower = "".join(c for c in local.lower() if c in _ALNUM)
        if not lower:
            return "x" * len(local) + "@" + domain
        new = iter(self.f.word(lower, "email|" + domain.lower()))
        return "".join(next(new) if c.lower() in _ALNUM else c for c in local) + "@" + domain

    def find(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym) of the valid values, in order, none overlapping."""
        out = []
        for m in mails(text):
            out.append((m.start(), m.end(), "email", self.replacement("email", m)))
        taken = [(a, b) for a, b, _, _ in out]
        pos = n = 0
        while start := _START.search(text, pos):
            at = start.start()
            while n < len(taken) and taken[n][1] <= at:
                n += 1
            if n < len(taken) and taken[n][0] <= at:
                pos = taken[n][1]
                continue
            pos = start.end()
            for kind in KINDS[1:]:
                m = _PATTERNS[kind].match(text, at)
                if m and (n >= len(taken) or m.end() <= taken[n][0]):
                    new = self.replacement(kind, m)
                    if new is not None:
                        out.append((at, m.end(), kind, new))
                        pos = m.end()
                        break
            else:
                while pos < len(text) and (text[pos].isalnum() or text[pos] == "_"):
                    pos += 1
        return sorted(out)


def replaced(text: str, found: list[tuple[int, int, str, str]]) -> str:
    parts, last = [], 0
    for a, b, _, new in found:
        parts += [text[last:a], new]
        last = b
    return "".join(parts) + text[last:]


def pseudonymised(docs: DataFrame, key: bytes = EXAMPLE_KEY) -> DataFrame:
    """The documents with pseudonyms in their texts; n_chars follows where it is there; all columns stay.

    Added: _found (spans kind:start:end in the old text, comma-joined).
    """
    used = ["text", "n_chars"] if "n_chars" in docs.columns else ["text"]
    rows = packed(docs, *used).withColumn("text", F.col("text").cast("string"))

    def run(batches):
        names = Pseudonyms(key)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts, spans = [], []
            for (part,) in pieces([pa.record_batch([batch.column(at)], ["text"])], ["text"]):
                for t in part:
                    found = names.find(t) if t else []
                    texts.append(replaced(t, found) if found else t)
                    spans.append(",".join(f"{k}:{a}:{b}" for a, b, k, _ in found))
            cols = list(batch.columns)
            cols[at] = pa.array(texts, pa.string())
            yield pa.record_batch([*cols, pa.array(spans, pa.string())], [*batch.schema.names, "_found"])

    out = arrow_map(rows, run, T.StructType([*rows.schema.fields, T.StructField("_found", T.StringType())]))
    if "n_chars" in used:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("_found") != "", F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return unpacked(out, docs, *used, added=["_found"])


def scan(docs: DataFrame, key: bytes = EXAMPLE_KEY) -> DataFrame:
    """doc_id, text (with pseudonyms), counts by kind, and the spans in the old text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = [F.regexp_count("_found", F.lit(rf"(?:^|,){k}:")).cast("long").alias(f"n_{k}") for k in KINDS]
    return pseudonymised(rows, key).select("doc_id", "text", *counts, F.col("_found").alias("spans"))
