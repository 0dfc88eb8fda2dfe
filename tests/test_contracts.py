"""Contracts, pictures and the entry without the llm folder."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from twinpath.operators import contracts, pictures, similarity


def test_mapping_contract(spark):
    good = [("c", i, i, "accepted") for i in range(4)]
    bad = [("d", 0, 5, "accepted"), ("d", 0, 4, ""), ("d", 2, None, None), ("d", 5, 3, "accepted")]
    rows = {r["k"]: r for r in contracts.mapping_contract(spark.createDataFrame(good + bad, "k string, a long, b long, status string"), ["k"], "a", "b", "status").collect()}
    assert tuple(rows["c"])[1:] == (4, 0, 0, 0, 0)
    assert rows["d"]["duplicate_keys"] == 1 and rows["d"]["blank_status"] == 2 and rows["d"]["key_gaps"] == 2 and rows["d"]["decreasing"] == 2


def test_drift_and_gates(spark):
    side = lambda rows: spark.createDataFrame(rows, "name string, v int")
    found = contracts.drift(side([("a", 1), ("b", 2), ("c", None)]), side([("a", 1), ("b", 3), ("d", None)]), "name", "v").collect()
    assert sorted(tuple(r) for r in found if r) == sorted([("b", 2, 3), ("c", None, None), ("d", None, None)])
    results = spark.createDataFrame([("a", True), ("b", False), ("c", False)], "gate string, passed boolean")
    waivers = spark.createDataFrame([("a", "x"), ("b", "y")], "gate string, reason string")
    assert sorted((r["gate"], r["verdict"], r["reason"]) for r in contracts.gates(results, waivers, ["gate"]).collect()) == [("a", "pass", None), ("b", "waived", "y"), ("c", "FAIL", None)]


def test_seals_follow_rows_and_order(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, None)], "k string, o long, v string")
    seal = lambda d: contracts.sealed(d, ["k"], "o", ["v"]).first()["seal"]
    assert seal(df) == seal(df.orderBy(F.desc("o"))) != seal(df.withColumn("o", -F.col("o")))


@pytest.mark.parametrize(("points", "cells", "rows", "columns"), [([(10, 10), (800, 10), (10, 600), (800, 600)], 4, 2, 2), ([(22 * i, 300) for i in range(40)], 4, 1, 4)])
def test_spatial_support(spark, points, cells, rows, columns):
    df = spark.createDataFrame([("k", float(x), float(y)) for x, y in points], "k string, x double, y double")
    r = pictures.supported(pictures.spatial_support(df, ["k"], "x", "y", 896, 672)).first()
    assert (r["cells"], r["rows_"], r["columns_"]) == (cells, rows, columns) and r["supported"] == (rows >= 2)


def test_similarity_operators(spark):
    vectors = [("k", i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(6)]
    a = spark.createDataFrame(vectors, "k string, ordinal long, v array<double>")
    pairs = similarity.pairs(a, a, ["k"])
    assert pairs.count() == 36 and {r["s"] for r in pairs.collect()} == {0.0, 1.0}
    best = similarity.top_k(a, a, ["k"], "k string", 2).filter("a <> b AND rank = 2").orderBy("a").collect()
    assert [(r["a"], r["b"]) for r in best] == [(0, 2), (1, 3), (4, 2), (5, 3)]
    weights = similarity.same_place(a, a, ["k"], "k string", 2, 0.5).groupBy("a").agg(F.sum("weight").alias("w")).collect()
    assert len(weights) == 6 and all(r["w"] == 1.0 for r in weights)
    assert similarity.alike(a, ["k"], "k string", 4, 0.5).orderBy("a").collect() == [("k", 0, 4, 1.0), ("k", 1, 5, 1.0)]
    assert similarity.distant_ranks(a, ["k"], "k string", (3,), 2).first()["rank"] == 3
    assert similarity.top_k(a.limit(0), a.limit(0), ["k"], "k string", 2).count() == 0


def test_entry_without_the_llm_folder(tmp_path):
    """The driver deletes that folder and the pipeline; the rest must import and answer."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/twinpath", tmp_path / "twinpath", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'stream_summary' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})
