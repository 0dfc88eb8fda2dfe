"""Near copies against the shingle Jaccard of all pairs."""

from __future__ import annotations

import random

import pytest

from twinpath.llm import near_copies, simhash


def corpus():
    """Unlike texts, and chains and stars of planted near copies whose fingerprints differ widely."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = []
    for family in range(12):
        base = [word() for _ in range(150)]
        texts.append(" ".join(base))
        for _ in range(8):
            copy = list(rng.choice([base, texts[-1].split()]))
            for at in rng.sample(range(len(copy)), rng.randint(0, 6)):
                copy[at] = word()
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return dict(enumerate(texts))


def expected(texts, least, most):
    sets = {i: set(near_copies.shingle_set(t.encode(), 5).tolist()) for i, t in texts.items()}
    prints = {i: simhash.fingerprint(t.encode(), 5) for i, t in texts.items()}
    root, far = {i: i for i in texts}, 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in range(i):
            like, bits = len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]), (prints[i] ^ prints[j]).bit_count()
            far += like and bits > most
            if like or bits <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert far > 20
    return {i: find(i) for i in texts}


@pytest.mark.parametrize(("limit", "block"), [(64, 128), (2, 3)])
def test_planted_near_copies(spark, monkeypatch, limit, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    texts = corpus()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in near_copies.groups(docs, bucket_limit=limit, pair_limit=limit).collect()}
    assert found == expected(texts, 0.8, 2)


def test_stars_connect_what_their_edges_connect():
    rng = random.Random(4)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(25)]
    made = near_copies.stars(iter(edges))
    assert made == near_copies.stars(iter(sorted(made))) and all(a < b for a, b in made)
    assert len(made) <= 39 and {x for e in edges if e[0] != e[1] for x in e} == {x for e in made for x in e}
