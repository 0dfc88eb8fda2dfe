"""License scans against a plain search."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from twinpath.llm import license_scan, queries


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def places(text):
    words = words_of(text)
    return [(i, label) for phrase, label in license_scan.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]


MIT = dict((label, text) for text, label in license_scan.TEMPLATES)["mit-text"]
CASES = [
    "", None, "one", "MIT License", "mit-license MIT  LICENSE apache license", "The GNU General Public License and the GNU general public", "cc by cc by cc by",
    "É mit license", "Released under the MIT License.", "kit license", "mit apache license", MIT, MIT.replace("deal in", "really deal in").upper(), " ".join(MIT.split()[:20]), "mİt license",
]


def test_pair_hash_is_spark_s(spark):
    row = spark.createDataFrame([("ab", "é")], "a string, b string").select(F.xxhash64("a", "b").alias("h")).first()
    assert row["h"] == license_scan.pair_hash("ab", "é")


def check(row, text):
    base = places(text or "")
    assert row["n_words"] == len(words_of(text or "")) and row["n_base"] == len(base)
    assert row["base_labels"] == ",".join(sorted({label for _, label in base}))
    assert (row["first_word"], row["last_word"]) == ((min(base)[0], max(base)[0]) if base else (None, None))
    assert set(row["base_labels"].split(",")) - {""} <= set(row["labels"].split(",")) and 0 <= row["score"] <= 1


def test_rows(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string").withColumn("row", F.lit("clash"))
    rows = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    assert len(rows) == len(CASES)
    for i, text in enumerate(CASES):
        check(rows[i], text)
    assert all(license_scan.scan(spark.createDataFrame([(1, f"x {text} y")], "doc_id long, text string")).first()["labels"].find(label) >= 0 for text, label in license_scan.TEMPLATES[-4:])
    assert "mit-notice" in rows[8]["labels"] and rows[11]["labels"] == "mit-text" and rows[11]["score"] == 1.0
    assert rows[12]["labels"] == "mit-text" and 0.9 < rows[12]["score"] < 1.0 and rows[13]["labels"] == ""


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "mit license"), (1, "mit license"), (None, "cc by")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_base"]) for r in license_scan.scan(df).collect()) == [("1", 1), ("1", 1), ("None", 1)]
    assert license_scan.scan(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 5000])
def test_long_texts(spark, n):
    text = "mit license and " * n
    row = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    check(row, text)


def test_query_against_brute_force(spark, tables):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    rows = queries.op10_licenses(spark, tables).collect()
    assert len(rows) == len(docs)
    for r in rows:
        check(r, docs[r["doc_id"]])
