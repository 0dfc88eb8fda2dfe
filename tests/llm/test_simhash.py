"""SimHash fingerprints, links and components against brute force."""

from __future__ import annotations

import random
import re
from itertools import islice

import pytest
import xxhash
from pyspark.sql import functions as F

from twinpath.llm import queries, simhash


def plain(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, most):
    """(id, smallest reachable id) by comparing all fingerprints."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", ["", " \n", "One", "one TWO", "a b c", "É a b c d", "x\x0by\x0cz w", "a b c a b c a b c", "日本 語 テスト a"])
def test_fingerprints(text):
    assert simhash.fingerprint(text.encode(), 3) == plain(text)


def test_long_texts_in_pieces(monkeypatch):
    text = " ".join(random.Random(1).choices(["ab", "cd", "ef", "gh", "i"], k=3000))
    whole = simhash.fingerprint(text.encode(), 3)
    monkeypatch.setattr(simhash, "PIECE", 500)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    assert simhash.fingerprint(text.encode(), 3) == whole == plain(text)


def near_prints(n, seed, flips):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)]
    return {i: rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, flips))) for i in range(n)}


@pytest.mark.parametrize(("most", "limit"), [(1, 64), (2, 64), (2, 1), (3, 64), (3, 2)])
def test_links_reach_what_brute_force_reaches(spark, most, limit):
    prints = near_prints(60, most, 5)
    signed = [(i, v - (1 << 64) if v >> 63 else v) for i, v in prints.items()]
    df = spark.createDataFrame(signed, "doc_id long, fingerprint long")
    classes = df.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id"))
    edges = simhash.links(classes, most, 3 * most + 1, limit)
    assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= most for r in edges.collect())
    root = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    least = {}
    for i, v in signed:
        r = root.get(v, v)
        least[r] = min(least.get(r, i), i)
    assert {i: least[root.get(v, v)] for i, v in signed} == components(prints, most)


def test_chain_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    root = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert root == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert simhash.components(edges.limit(0)).count() == 0


def test_rows(spark):
    rows = [(5, "a b c d e f g"), (2, "A b c d e f g"), (9, None), (8, ""), (7, "x"), (7, "x"), (None, "y"), (3, "q r s t u v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("clash"))
    found = sorted(((r["doc_id"], r["component_id"]) for r in simhash.groups(docs, shingle_words=3, max_bits=2).collect()), key=str)
    assert found == sorted([(5, 2), (2, 2), (9, 8), (8, 8), (7, 7), (7, 7), (None, None), (3, 3)], key=str)
    assert simhash.groups(docs.limit(0), max_bits=2).count() == 0


def test_query_against_brute_force(spark, tables):
    prints = {r["doc_id"]: plain(r["text"] or "") for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    expected = components(prints, 2)
    rows = queries.op7_simhash(spark, tables).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{v:016x}", expected[i]) for i, v in prints.items()}


def test_a_word_of_several_pieces_behind_a_short_one(monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 10)
    text = b"a " + b"x" * 35 + b" b c"
    assert list(islice(simhash.words_of(text), 10)) == text.split()
