"""Personal data against plain patterns."""

from __future__ import annotations

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twinpath.llm import pii, queries


def plain(text):
    """The base spans by the contract's own patterns."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    return [(k, m.start(), m.end()) for k, m in found]


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0


CASES = [
    "", "a@b.c.d%x@e.f", "x@@y.z", "mail me: é.o@x-1.example.org!", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4.5.6.7.8 and 256.1.1.1 and 001.2.3.255",
    "+1 (286) 555-5136 +49-30.1234567 +1 +12", "9" * 3000, "1.1.1.1" * 50, "a" * 2000 + "@", "token = \"f0ddae3b09ae356cbefecdd3232fa5489bb400d6\"",
]


@pytest.mark.parametrize("text", CASES)
def test_base_spans(text):
    assert [s[:3] for s in pii.spans(text) if s[0] in pii.BASE_KINDS] == plain(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1029.@+- ()%é\n", max_size=60))
def test_base_spans_of_any_text(text):
    assert [s[:3] for s in pii.spans(text) if s[0] in pii.BASE_KINDS] == plain(text)


def test_checksums_and_context():
    kinds = lambda text: [s[0] for s in pii.spans(text)]
    assert kinds("pay to DE89 3704 0044 0532 0130 00") == ["iban"] and kinds("pay to DE89 3704 0044 0532 0130 01") == []
    assert kinds("my amex is 378282246310005") == ["card_short"] and kinds("order 378282246310005") == []
    assert kinds("ssn 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    assert kinds('token = "f0ddae3b09ae356cbefecdd3232fa5489bb400d6"') == ["secret"]


def test_redaction_of_overlapping_spans():
    text = "mail a@b.cd or +1 (286) 555-5136!"
    assert pii.redacted(text, pii.spans(text)) == "mail [EMAIL] or [PHONE]!"
    assert pii.redacted("abcdef", [("x", 1, 3, 1.0), ("y", 2, 5, 1.0)]) == "a[X]f"


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (3, "a@b.cd", None), (None, "1.2.3.4", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    found = sorted(((r["doc_id"], len(r["spans"])) for r in pii.find(docs).collect()), key=str)
    assert found == sorted([(1, 0), (2, 0), (2, 0), (3, 1), (None, 1)], key=str)
    redacted = {(r["doc_id"], r["text"], r["spans"]) for r in pii.redact(docs).collect()}
    assert (1, None, "x") in redacted and (3, "[EMAIL]", None) in redacted
    assert pii.find(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark, tables):
    rows = {r["doc_id"]: r for r in queries.op1_pii(spark, tables).collect()}
    docs = spark.read.parquet(f"{tables}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        base = plain(d["text"] or "")
        r = rows[d["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(b[0] == k for b in base) for k in pii.BASE_KINDS]


@pytest.mark.parametrize(
    ("text", "iban"),
    [
        ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "DE89 3704 0044 0532 0130 00"),
        ("IBAN DE89370400440532013000 Please pay", "DE89370400440532013000"),
        ("DE89370400440532013000 5 days", "DE89370400440532013000"),
        ("NO93 8601 1117 947 DE89370400440532013001", "NO93 8601 1117 947"),
        ("DE89370400440532013000X", None),
    ],
)
def test_ibans_end_at_their_countrys_length(text, iban):
    assert [text[a:b] for kind, a, b, _ in pii.spans(text) if kind == "iban"] == ([iban] if iban else [])
    assert iban is None or pii.redacted(text, pii.spans(text)).count("[IBAN]") == 1
