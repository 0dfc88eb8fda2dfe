"""Merkle fingerprints against hashlib."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from twinpath.llm import merkle, queries


def sha(kind, text):
    return hashlib.sha256((kind + text).encode()).hexdigest()


def leaves(paragraph):
    return [sha("", x) for x in re.findall(merkle.LEAF, paragraph, re.ASCII)]


def plain_root(text):
    return sha("r", "".join(sha("s", "".join(sha("p", "".join(leaves(p))) for p in s.split("\n"))) for s in text.split("\n\n")))


def plain_near(a, b):
    x, y = ({n for p in t.split("\n") for n in leaves(p)} | {plain_root(t)} for t in (a, b))
    return 2 * len(x & y) / (len(x) + len(y))


TEXTS = ["", "a", "a\nb", "a\n\nb", "a\n\n\nb", "\n", " a", "a ", " ", "\t \n x", "é " * 50, "w" * 200, "a b c d  e f\u00a0g h i j", "🎉" * 40]


def test_roots(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    rows = merkle.fingerprints(df).collect()
    assert all(r["fingerprint"] == plain_root(r["text"]) for r in rows)
    assert len({r["fingerprint"] for r in rows}) == len(TEXTS)


def test_leaves_cover_every_paragraph():
    assert all("".join(re.findall(merkle.LEAF, p, re.ASCII)) == p for t in TEXTS for p in t.split("\n"))


A = "one two three four five\nsix seven\n\neight nine ten\n\nlast"


@pytest.mark.parametrize(
    ("a", "b", "removed", "added"),
    [
        (A, A, [], []),
        ("", "", [], []),
        (A, A.replace("nine", "9"), [(1, 0)], [(1, 0)]),
        (A, A.replace("six", "put in\nsix"), [], [(0, 1)]),
        (A, "put in\n\n" + A, [], [(0, 0)]),
        (A, A.replace("six seven\n\n", "\n"), [(0, 1)], []),
        (A, "", [(0, 0), (0, 1), (1, 0), (2, 0)], [(0, 0)]),
        (A, A + "\n\nlast", [], [(3, 0)]),
        ("a\n\nb\n\nc", "c\n\nb\n\na", [(0, 0), (1, 0), (2, 0)], [(0, 0), (1, 0), (2, 0)]),
        ("a\nb", "a\n\nb", [(0, 0), (0, 1)], [(0, 0), (1, 0)]),
        ("a\nb\n\nc", "a\nb\nb\n\nc", [(0, 0), (0, 1)], [(0, 0), (0, 1), (0, 2)]),
        ("\n".join(map(str, range(400))), "\n".join(str(i) if i % 3 else f"x{i}" for i in range(400)), [(0, i) for i in range(0, 400, 3)], [(0, i) for i in range(0, 400, 3)]),
    ],
)
def test_likeness_and_differences(spark, a, b, removed, added):
    both = merkle.fingerprints(merkle.fingerprints(spark.createDataFrame([(a, b)], "text string, other string")), "other", "o_")
    near = merkle.likeness(F.col("leaves"), F.col("fingerprint"), F.col("o_leaves"), F.col("o_fingerprint"))
    row = both.select(near.alias("near"), merkle.differences(F.col("sections"), F.col("o_sections")).alias("d")).first()
    assert row["near"] == pytest.approx(plain_near(a, b))
    assert [[tuple(x) for x in side] for side in row["d"]] == [removed, added]


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_next_rows(spark, buckets):
    rows = [(i * 7 % 31, f"t{i}") for i in range(31)] + [(5, "again"), (None, "null"), (40, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash"))
    order = [t or "" for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))]
    found = sorted((r["text"], r["next_text"]) for r in merkle.with_next(df, buckets=buckets).collect())
    assert found == sorted(zip(order, [*order[1:], order[0]], strict=True))


def test_few_rows(spark):
    one = spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")
    assert [tuple(r) for r in merkle.with_next(one).collect()] == [(1, "abcdefgh", "abcdefgh")]
    assert merkle.with_next(one.limit(0)).count() == 0


def test_query_against_brute_force(spark, tables):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{tables}/documents.parquet").orderBy("doc_id").collect()]
    rows = {r["doc_id"]: r for r in queries.op6_merkle(spark, tables).collect()}
    assert len(rows) == len(docs)
    for i, (doc_id, text) in enumerate(docs):
        quarter, following = len(text) // 4, docs[(i + 1) % len(docs)][1]
        changed = text[: len(text) - quarter] + following[:quarter]
        r = rows[doc_id]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == plain_root(text) and r["edited_fingerprint"] == plain_root(changed)
        assert r["near_edited"] == pytest.approx(plain_near(text, changed)) and r["near_next"] == pytest.approx(plain_near(text, following))
