"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Base kinds, found leftmost and without overlap within a kind, stay whatever
their score: email, ip, card (16 to 19 digits passing Luhn) and phone. Kinds
that the method adds stay if their score reaches `LEAST_SCORE`: iban (mod 97),
card_short (13 to 15 digits passing Luhn, near a card word), ssn (near its
words) and secret (a long value given to a word such as token).

Spans are in code points, the end exclusive. Every pattern takes time in
proportion to the text: runs are possessive or anchored at their first
character, and an email grows from its @.

Defined cases: a null text is the empty text, without spans; repeated rows are
searched as often as they come; an empty table gives an empty result; further
columns pass through `redact` untouched and are not read by `find`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, slices, text_of

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "card_short", "ssn", "secret")
LEAST_SCORE = 0.5
#: Characters before and after a span in which context words count.
CONTEXT = 48

Span = tuple[str, int, int, float]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}")
#: Characters of an IBAN by its country.
IBAN_LENGTHS = {
    code: length
    for length, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for code in codes.split()
}
#: What follows the first four characters, by the length; of a country without one, the longest run.
IBAN_RESTS = {n: re.compile(rf"(?: ?[A-Z0-9]){{{n - 4}}}+(?![A-Za-z0-9])") for n in set(IBAN_LENGTHS.values())} | {0: re.compile(r"(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])")}
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"\b(?:token|secret|password|passwd|api[_ -]?key|access[_ -]?key)\b[\"']?\s{0,4}[=:]\s{0,4}[\"']?([A-Za-z0-9+/_=-]{16,})", re.IGNORECASE)

#: What a kind scores by its pattern alone, by its checksum, and by a context word.
SCORES = {"email": (0.8, 0.0, 0.1), "ip": (0.5, 0.1, 0.3), "card": (0.3, 0.4, 0.2), "phone": (0.5, 0.1, 0.3), "iban": (0.2, 0.5, 0.2), "card_short": (0.1, 0.3, 0.3), "ssn": (0.3, 0.0, 0.4), "secret": (0.6, 0.0, 0.2)}
WORDS = {
    "email": r"e-?mail|contact|write to",
    "ip": r"ip|address|host|server|login",
    "card": r"card|visa|mastercard|credit|debit|payment",
    "phone": r"phone|call|tel|mobile|fax",
    "iban": r"iban|account|bank|transfer",
    "card_short": r"card|visa|amex|american express|diners|credit|debit|payment",
    "ssn": r"ssn|social security",
    "secret": r"token|secret|key|password|auth",
}
NEAR = {kind: re.compile(rf"\b(?:{words})\b", re.IGNORECASE) for kind, words in WORDS.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    text = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Each start is tried once, at its country's length."""
    done = 0
    for m in IBAN.finditer(text):
        if m.start() >= done and (rest := IBAN_RESTS[IBAN_LENGTHS.get(m[1], 0)].match(text, m.end())) and mod97(text[m.start() : rest.end()]):
            done = rest.end()
            yield m.start(), done


def emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def octets(found: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in found.split("."))


def proposed(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, checksum passed) of each span that its validator lets through, kind by kind in order."""
    yield from (("email", a, b, False) for a, b in emails(text))
    if not re.search("[0-9]", text):
        digits: list[tuple[int, int, str]] = []
    else:
        yield from (("ip", m.start(), m.end(), True) for m in IP.finditer(text) if octets(m[0]))
        digits = [(m.start(), m.end(), m[0].replace(" ", "").replace("-", "")) for m in DIGITS.finditer(text)]
        yield from (("card", a, b, True) for a, b, d in digits if 16 <= len(d) <= 19 and luhn(d))
        if "+" in text:
            yield from (("phone", m.start(), m.end(), True) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15)
        yield from (("iban", a, b, True) for a, b in ibans(text))
        yield from (("card_short", a, b, True) for a, b, d in digits if 13 <= len(d) <= 15 and luhn(d))
        yield from (("ssn", m.start(), m.end(), False) for m in SSN.finditer(text))
    if "=" in text or ":" in text:
        yield from (("secret", m.start(1), m.end(1), False) for m in SECRET.finditer(text))


def spans(text: str) -> list[Span]:
    """(kind, start, end, score) by kind in the order of the kinds, then by start."""
    found = []
    for kind, start, end, checked in proposed(text):
        pattern, checksum, context = SCORES[kind]
        near = NEAR[kind]
        around = near.search(text, max(0, start - CONTEXT), start) or near.search(text, end, min(len(text), end + CONTEXT))
        score = min(1.0, pattern + checksum * checked + context * bool(around))
        if kind in BASE_KINDS or score >= LEAST_SCORE:
            found.append((kind, start, end, round(score, 3)))
    return found


def redacted(text: str, found: list[Span]) -> str:
    """The text with each span replaced by its kind; of overlapping spans, the first and longest names the whole."""
    parts, done, merged = [], 0, []
    for kind, start, end, _ in sorted(found, key=lambda s: (s[1], -s[2])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        parts += [text[done:start], f"[{kind.upper()}]"]
        done = end
    return "".join([*parts, text[done:]])


SPAN_TYPE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of each row."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans(text)] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, ARROW_SPANS)], names=[id_col, "spans"])

    narrow = docs.select(F.col(id_col), text_of(text_col).alias("text"))
    return bounded(narrow).mapInArrow(kernel, T.StructType([narrow.schema[id_col], T.StructField("spans", SPAN_TYPE)]))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of a text replaced by its kind in brackets; a null text stays null."""
    at = docs.columns.index(text_col)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [None if t is None else redacted(t, found) if (found := spans(t)) else t for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 :]], names=batch.schema.names)

    return bounded(docs).mapInArrow(kernel, docs.schema)


def listed(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
