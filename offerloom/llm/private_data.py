"""Personal data by anchor expansion.

An Aho-Corasick automaton runs once over a text and finds what personal data is anchored at: at-signs, plus signs, digits, schemes
and cues of identifiers. From each anchor a small parser walks left and right to the borders of the candidate and validates it. No parser
looks at a place twice, so a text costs time in proportion to its length, however long or odd it is.

Base kinds, leftmost and without overlap among their own: email, ip, card, phone, each as its pattern in `digest`'s contract says.
Beyond these: `email` with letters beyond ASCII and a last label of letters, `login` (user and password in front of a host), `iban` (length of the
country and check digits), `account` (6 to 18 digits after a cue such as "account no."). They are added only where no base span is equal.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone", "login", "iban", "account")
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))

DIGITS = frozenset("0123456789")
CAPITALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
WIDE_HOST = re.compile(r"[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)*\.[^\W\d_]{2,}")
QUADS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])*")
DIALLED = re.compile(r"[0-9][ ().0-9-]+[0-9]")
USER = re.compile(r"[^\s/?#@:]+:[^\s/?#@]+@(?=[A-Za-z0-9\[])")
NUMBER = re.compile(r"\s*(?:(?:no|nr|number|num|n°|nº)\b\.?)?\s*[:#=]?\s*([0-9](?:[ -]?[0-9])*)(?![0-9A-Za-z])", re.I)

# Lengths of account numbers by country (ISO 13616), and the words that announce an account.
IBAN_LENGTH = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21,
    "HU": 28, "IE": 22, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}
CUES = ("account", "acct", "compte", "konto", "cuenta", "ssn", "social security", "passport", "passeport", "reisepass", "pasaporte")


@lru_cache(1)
def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for text, kind in [("@", "email"), ("+", "phone"), ("://", "login"), *[(d, "digit") for d in sorted(DIGITS)], *[(c + d, "iban") for c in IBAN_LENGTH for d in sorted(DIGITS)]]:
        found.add_word(text, (kind, len(text)))
    for cue in CUES:
        for text in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            found.add_word(text, ("account", len(text)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    """The check digit of card numbers holds."""
    doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(x) for x in reversed(digits))]
    return sum(doubled) % 10 == 0


def iban(text: str) -> bool:
    """The check digits of an account number hold: letters count 10 to 35, the first four characters go last, modulo 97 is 1."""
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) < 256


def find(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, place of the kind in KINDS, end, whether it is a base span), in order, of a text; places are code points, end exclusive."""
    base: set[tuple[int, int, int]] = set()
    more: set[tuple[int, int, int]] = set()
    after_email = after_digits = 0
    for last, (kind, size) in _anchors().iter(text):
        if kind == "digit":
            if last >= after_digits:  # a chain holds the quads in it whole, or they begin in it
                after_digits = _numbers(text, last, base)
        elif kind == "email":
            after_email = _email(text, last, after_email, base, more)
        elif kind == "phone":
            m = DIALLED.match(text, last + 1)
            if m and 10 <= sum(c in DIGITS for c in m[0]) <= 15:
                base.add((last, 3, m.end()))
        elif kind == "login":
            m = USER.match(text, last + 1)
            if m and last > 2 and text[last - 3].isalpha():
                more.add((last + 1, 4, m.end() - 1))
        elif kind == "iban":
            _iban(text, last - size + 1, more)
        elif last - size < 0 or not text[last - size].isalnum():
            m = NUMBER.match(text, last + 1)
            if m and 6 <= sum(c in DIGITS for c in m[1]) <= 18:
                more.add((m.start(1), 6, m.end(1)))
    return sorted([(*x, True) for x in base] + [(*x, False) for x in more - base])


def _numbers(text: str, at: int, base: set) -> int:
    """Cards and addresses that begin in the run of digits, single spaces, hyphens and dots at `at`; returns the place after it."""
    end = at
    while True:
        chain = CHAIN.match(text, end)
        digits = chain[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            base.add((end, 2, chain.end()))
        end = chain.end()
        if text[end : end + 1] != "." or text[end + 1 : end + 2] not in DIGITS:
            break
        end += 1
    for m in QUADS.finditer(text, at, end):
        parts = m[0].split(".")
        place = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(map(_small, four)):
                base.add((place, 1, place + size))
            place += size + 1
    return end


def _email(text: str, at: int, after: int, base: set, more: set) -> int:
    """The address around the at-sign at `at`; returns where the next one may begin."""
    host = HOST.match(text, at + 1)
    start = at
    while start > after and text[start - 1] in LOCAL:
        start -= 1
    wide = start
    while wide > after and (text[wide - 1] in LOCAL or text[wide - 1].isalnum()):
        wide -= 1
    m = WIDE_HOST.match(text, at + 1) if wide < at else None
    if m and not text[wide : m.end()].isascii():
        more.add((wide, 0, m.end()))
    if host and start < at:
        base.add((start, 0, host.end()))
        return host.end()
    return after


def _iban(text: str, at: int, more: set) -> None:
    if at and text[at - 1].isalnum():
        return
    need, place = IBAN_LENGTH[text[at : at + 2]], at
    while need and place < len(text) and (text[place] in CAPITALS or text[place] in DIGITS or text[place] == " " != text[place - 1]):
        need -= text[place] != " "
        place += 1
    if not need and not text[place : place + 1].isalnum() and iban(text[at:place].replace(" ", "")):
        more.add((at, 5, place))


def _texts(column: pa.Array) -> Iterator[str]:
    return (x.as_py() or "" for x in column)


@F.arrow_udf(SPANS)
def _spans(column: pa.Array) -> pa.Array:
    rows = [[{"kind": KINDS[k], "start": a, "end": b, "base": own} for a, k, b, own in find(text)] for text in _texts(column)]
    return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])))


@F.arrow_udf(T.StringType())
def _masked(column: pa.Array) -> pa.Array:
    out = []
    for value in column:
        text, parts, at, kind = value.as_py(), [], 0, None
        for a, k, b, _ in find(text or ""):
            if a >= at:
                parts += [text[at:a], f"[{KINDS[k]}]"]
            at = max(at, b)
        out.append(None if text is None else "".join(parts) + text[at:])
    return pa.array(out, pa.string())


def private_spans(docs: DataFrame, text: str = "text", name: str = "private") -> DataFrame:
    """Add `name`: what personal data the text holds (kind, start, end, base), by start and then by kind.

    A narrow pass: no row moves. Null and empty texts hold nothing, repeated rows hold alike, a column `name` of docs is replaced.
    """
    return docs.withColumn(name, _spans(text))


def masked(docs: DataFrame, text: str = "text", name: str = "text") -> DataFrame:
    """Put [kind] in the place of personal data; spans that overlap become one, of the first's kind. Null stays null."""
    return docs.withColumn(name, _masked(text))


def private_digest(docs: DataFrame) -> DataFrame:
    """Per document: counts of base spans, the SHA-256 of their list, and the list of all spans as kind:start:end."""
    rows = private_spans(docs.select("doc_id", "text")).select("doc_id", "private")
    own = F.filter("private", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def counted(kind: str) -> Column:
        return F.size(F.filter(own, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [counted(kind) for kind in KINDS[:4]]
    return rows.select("doc_id", *counts, F.sha2(listed(own), 256).alias("base_sha256"), listed(F.col("private")).alias("spans"))
