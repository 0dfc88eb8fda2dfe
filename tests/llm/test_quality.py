"""The rule ensemble: fitting, compiling and held-out accuracy."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinpath.llm import quality, queries


def sample(n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.random((n, len(quality.NAMES)))
    return x, ((x[:, 2] > 0.4) & (x[:, 5] <= 0.7)).astype(float)


def test_rules_learn_a_conjunction():
    x, y = sample()
    model = quality.RuleModel.fit(x, y)
    fresh, truth = sample(seed=1)
    assert ((model.scores(fresh) >= 0.5) == truth).mean() > 0.97
    assert len(model.rules) < 60
    assert str(quality.RuleModel.fit(x, y)) == str(model)


def test_compiled_rules_give_the_same_scores(spark):
    x, y = sample(200)
    model = quality.RuleModel.fit(x, y)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["i", *quality.NAMES])
    rows = df.select("i", model.column(F.col).alias("s")).orderBy("i").collect()
    assert np.allclose([r["s"] for r in rows], model.scores(x))


@pytest.mark.parametrize(("labels", "score"), [([], 1.0), ([1, 1], 1.0), ([0, 0], 0.0)])
def test_without_both_labels(spark, labels, score):
    x = np.zeros((len(labels), len(quality.NAMES)))
    model = quality.RuleModel.fit(x, np.array(labels, dtype=float))
    docs = spark.createDataFrame([(1, "a"), (2, None), (3, ""), (3, "")], "doc_id long, text string")
    assert [r["score"] for r in quality.scored(docs, model).collect()] == [score] * 4


def test_features_against_plain_counts(spark):
    texts = ["", None, "THE end!!", "a a a b", "x | y | z\nx | y | z", "Ünï ### 12.5%"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    rows = {r["doc_id"]: r["_features"] for r in quality.with_features(df).collect()}
    for i, t in enumerate(t or "" for t in texts):
        words = t.split()
        assert rows[i]["upper_share"] == pytest.approx(sum(c.isupper() for c in t) / max(len(t), 1))
        assert rows[i]["distinct_share"] == pytest.approx(len(set(words)) / max(len(words), 1))
        assert rows[i]["repeat_share"] == pytest.approx(sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(len(words), 1))
        assert rows[i]["bar_share"] == pytest.approx(t.count("|") / max(len(words), 1))


def test_query_on_held_out_labels(spark, tables):
    rows = {r["doc_id"]: r for r in queries.op8_quality(spark, tables).collect()}
    docs = spark.read.parquet(f"{tables}/documents.parquet").count()
    assert len(rows) == docs and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())


def test_held_out_labels_are_told_apart(spark, tables):
    """Over a table with some hundred of them: the order of the scores, and the smaller class."""
    larger = os.path.join(os.path.dirname(tables), "sf0.01")
    rows = {r["doc_id"]: r for r in queries.op8_quality(spark, larger if os.path.isdir(larger) else tables).collect()}
    labels = spark.read.parquet(f"{larger if os.path.isdir(larger) else tables}/labels.parquet").collect()
    found = [(rows[r["doc_id"]]["score"], rows[r["doc_id"]]["predicted"], r["quality"]) for r in labels if rows[r["doc_id"]]["held_out"]]
    good, bad = ([f for f in found if f[2] == q] for q in (1, 0))
    assert min(len(good), len(bad)) >= 5
    auc = sum((g[0] > b[0]) + 0.5 * (g[0] == b[0]) for g in good for b in bad) / (len(good) * len(bad))
    assert auc >= 0.97
    for q, rows_of in ((1, good), (0, bad)):
        assert sum(f[1] == q for f in rows_of) >= 0.9 * len(rows_of)


def test_repeated_documents_train_once(spark):
    docs = spark.createDataFrame([(i % 40, f"word {i % 40} and more" * (1 + i % 3)) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2, "doc_id long, quality int")
    x, y = quality.sample(docs, labels)
    assert len(x) == len(y) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(40))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.scored(docs, quality.train(docs, labels)).count() == 0
