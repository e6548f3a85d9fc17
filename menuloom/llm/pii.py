"""Personal data: patterns propose spans, checksums (Luhn, mod-97) and value ranges
confirm them, and words nearby raise or lower a score.

Base kinds (email, ip, card, phone) are leftmost, non-overlapping matches per kind;
a match that its check refuses is dropped without another try, and one that passes
stays whatever its score. Further kinds stand only if their score reaches
``THRESHOLD``: iban (mod-97 confirms it, so no word nearby speaks against it) and national_id (a
written number that only words nearby can confirm). An iban may be followed by capital words or numbers: it ends
where its country's fixed length says or, for codes without one, at the last end
between two words that mod-97 confirms; the search goes on after it, or else just after the
failed start.

All patterns take time in proportion to the text: starts inside a run that already
failed are ruled out by look-behinds, and addresses are sought from their @ sign.

Cases: null and empty texts have no spans; repeated rows are searched each; null ids
are kept; texts are read whole, offsets are code points, ends exclusive."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .common import map_texts, rewrite_texts

#: Kinds in the order in which spans with one start are listed.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "national_id")
THRESHOLD = 0.7
#: Characters on both sides in which words count as nearby.
NEARBY = 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Every start, with the longest text that could be a number from there.
_IBAN = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9]))")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile(r"[^0-9]")

# Fixed lengths of account numbers by country code (fixed values of the IBAN registry).
IBAN_LENGTH = {
    code: length
    for length, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for code in codes.split()
}

# Context words that make a kind likelier or less likely (fixed values).
FOR = {
    "email": ("mail", "email", "contact", "write", "schreib", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "login", "connect"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "pay", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "telephone", "tel", "call", "mobile", "fax", "cell", "anruf", "appel", "llama"),
    "iban": ("iban", "account", "bank", "konto", "bankkonto", "compte", "cuenta", "transfer"),
    "national_id": ("ssn", "social security", "national id", "tax id", "taxpayer"),
}
# Words count whole, also with an s at the end. Those against weigh on kinds only that no checksum has confirmed.
AGAINST = ("version", "release", "isbn", "order", "invoice", "build", "part no", "example", "serial")
# What a span scores before the words nearby are looked at.
START = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "national_id": 0.5}


#: Kinds whose spans have passed a checksum.
CONFIRMED = ("card", "iban")
_whole = lambda words: re.compile(rf"(?<!\w)(?:{'|'.join(words)})s?(?!\w)")
_FOR, _AGAINST = {kind: _whole(words) for kind, words in FOR.items()}, _whole(AGAINST)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def iban_length(text: str) -> int:
    """Characters from the start of ``text`` that are an account number, 0 if none are. In the
    check letters are 10 to 35, the head goes last, and mod 97 is 1; one walk checks all ends."""
    head = int(f"{int(text[0], 36)}{int(text[1], 36)}{text[2:4]}")
    fixed = IBAN_LENGTH.get(text[:2])
    rest, n, fits = 0, 4, 0
    for i in range(4, len(text) + 1):
        if i == len(text) or text[i] == " ":
            if n >= 15 and n == (fixed or n) and (rest * 1_000_000 + head) % 97 == 1:
                fits = i
        else:
            value = int(text[i], 36)
            rest = (rest * (10 if value < 10 else 100) + value) % 97
            n += 1
    return fits


def ibans(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in _IBAN.finditer(text):
        if m.start() >= done and (length := iban_length(m[1])):
            done = m.start() + length
            yield m.start(), done


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain.tld, sought from each @: what stands before it
    up to a character no local part has, or up to the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        tail = _DOMAIN.match(text, at + 1) if start < at else None
        if tail:
            yield start, tail.end()
            done = tail.end()
        else:
            done = at + 1  # no local part reaches over an @
        at = text.find("@", done)


def _parts_fit(match: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base kinds that pass their checks."""
    out = [(a, "email", b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if _parts_fit(m[0]):
            out.append((m.start(), "ip", m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), "card", m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), "phone", m.end()))
    return out


def score(text: str, kind: str, start: int, end: int) -> float:
    """Between 0 and 1: what the kind starts with, raised or lowered by words nearby."""
    near = f"{text[max(0, start - NEARBY) : start]} {text[end : end + NEARBY]}".lower()
    value = START[kind]
    if _FOR[kind].search(near):
        value += 0.3
    if kind not in CONFIRMED and _AGAINST.search(near):
        value -= 0.25
    return min(1.0, max(0.0, value))


def spans(text: str) -> list[tuple[int, str, int, float]]:
    """All spans by start, then by kind in the order of ``KINDS``."""
    found = [(a, k, b, score(text, k, a, b)) for a, k, b in base_spans(text)]
    further = [("iban", *span) for span in ibans(text)] + [("national_id", *m.span()) for m in _NATIONAL.finditer(text)]
    for kind, start, end in further:
        value = score(text, kind, start, end)
        if value >= THRESHOLD:
            found.append((start, kind, end, value))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


SPAN = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("score", DoubleType())])


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, spans); no shuffle."""

    def make() -> Callable[[list], list]:
        one = lambda t: [{"kind": k, "start": a, "end": b, "score": s} for a, k, b, s in spans(t)] if t else []
        return lambda texts: [[one(t) for t in texts]]

    return map_texts(docs, [doc_id], [StructField("spans", ArrayType(SPAN))], make, text)


def redact(text: str) -> str:
    """Every span becomes its kind in angle brackets; overlapping spans become one, named
    by the first."""
    out, at = [], 0
    for start, kind, end, _ in spans(text):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def without_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns, with personal data in the text replaced."""
    return rewrite_texts(docs, lambda: lambda texts: ([True] * len(texts), [redact(t) if t else t for t in texts]), text)
