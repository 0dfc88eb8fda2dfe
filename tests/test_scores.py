"""Scalar functions and scoring operators on small cases."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from twinpath.functions import scores, text
from twinpath.operators import scoring


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize(("mean", "p99", "flag"), [(12.0, 40.0, "ok"), (11.99, 40.0, "too_dark"), (12.0, 39.9, "too_dark"), (200.0, 250.0, "ok")])
def test_exposure_bounds_are_strict(spark, mean, p99, flag):
    assert one(spark, f=scores.exposure_flag(F.lit(mean), F.lit(p99)))["f"] == flag


@pytest.mark.parametrize(("value", "distance", "signed"), [(5, 0, 0), (4, 0, 0), (7, 0, 0), (9, 2, 2), (1, 3, -3), (None, None, None)])
def test_interval_distances(spark, value, distance, signed):
    v = F.lit(value).cast("bigint")
    row = one(spark, d=scores.interval_distance(v, F.lit(4), F.lit(7)), s=scores.signed_interval_distance(v, F.lit(4), F.lit(7)))
    assert (row["d"], row["s"]) == (distance, signed)


@pytest.mark.parametrize(("k", "n"), [(23, 32), (0, 5), (5, 5), (12, 32)])
def test_wilson_against_the_formula(spark, k, n):
    z, p = scores.Z95, k / n
    centre, margin, scale = p + z * z / (2 * n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    row = one(spark, low=scores.wilson(F.lit(k), F.lit(n), False), high=scores.wilson(F.lit(k), F.lit(n), True))
    assert row["low"] == pytest.approx(max(0, (centre - margin) / scale), abs=6e-5)
    assert row["high"] == pytest.approx(min(1, (centre + margin) / scale), abs=6e-5)


def test_wilson_without_trials_is_null(spark):
    assert one(spark, low=scores.wilson(F.lit(0), F.lit(0), False))["low"] is None


@pytest.mark.parametrize(("margins", "tier"), [([0.1, 0.1, 0.1, 0.1], "strong"), ([-0.1, 0.1, 0.1, 0.1], "supported"), ([0.1, 0.1, 0.1, -0.1], "failed"), ([-0.1, -0.1, 0.1, 0.1], "failed")])
def test_sequence_tiers(spark, margins, tier):
    assert one(spark, t=scores.sequence_tier(F.array(*map(F.lit, margins))))["t"] == tier


def test_linear_prior_rounds_half_to_even(spark):
    row = one(spark, a=scores.linear_prior(F.lit(1), F.lit(0), F.lit(2), F.lit(0), F.lit(5)), b=scores.linear_prior(F.lit(1), F.lit(0), F.lit(2), F.lit(0), F.lit(3)))
    assert (row["a"], row["b"]) == (2, 2)


def test_upper_median(spark):
    assert one(spark, m=scores.upper_median(F.array(F.lit(4), F.lit(1), F.lit(3), F.lit(2))))["m"] == 3


def test_text(spark):
    row = one(
        spark,
        a=text.listed(F.array(F.lit("a"), F.lit("b"), F.lit("c"))), b=text.listed(F.array(F.lit("a"))), c=text.percent(F.lit(0.1234)), d=text.signed(F.lit(2.0)), e=text.thousands(F.lit(1234567)),
        f=text.parts(F.lit("x"), F.lit(""), F.lit("y")), g=text.int_or(F.lit(" 7 ")), h=text.int_or(F.lit(">10")), i=text.blank_to_null(F.lit("  ")),
    )
    assert tuple(row) == ("a, b and c", "a", "12.3%", "+2.0", "1,234,567", "x+y", 7, 999, None)


def case_rows(spark):
    rows = [("m", "q1", "match", 10, 10, 12, 11), ("m", "q2", "match", 15, 10, 12, 11), ("m", "q3", "match", None, 10, 12, 11), ("m", "q4", "no_correspondence", 3, None, None, None), ("m", "q5", "undetermined", 4, None, None, None)]
    labels = spark.createDataFrame([(r[1], r[2], *r[4:]) for r in rows], "query_id string, label string, low long, high long, preferred long")
    methods = spark.createDataFrame([(r[0], r[1], r[3]) for r in rows], "method string, query_id string, predicted long")
    return labels, methods


def test_undetermined_leaves_the_denominator_and_gates_come_in_order(spark):
    labels, methods = case_rows(spark)
    found = scoring.cases(labels, methods, ["query_id"]).groupBy("method").agg(*scoring.measures()).first()
    assert (found["accepted"], found["correct"], found["false_accepts"], found["determinable"]) == (3, 1, 1, 4)
    gates = [(name, spark.createDataFrame([("q1",)], "query_id string"), "query_id") for name in ("first", "second")]
    gated = {r["query_id"]: r["gated_by"] for r in scoring.cases(labels, methods, ["query_id"], gates).collect()}
    assert gated["q1"] == "first" and gated["q2"] is None


def test_curves(spark):
    labels, methods = case_rows(spark)
    cases = scoring.cases(labels, methods, ["query_id"])
    curve = [(r["tolerance"], r["hits"]) for r in scoring.tolerance_curve(cases, ["method"]).orderBy("tolerance").collect()]
    assert curve == [(0, 1), (1, 1), (2, 1), (5, 2), (10, 2)]
    sweep = scoring.shift_sweep(cases, ["method"], range(-4, 5))
    assert scoring.peak_shift(sweep, ["method"]).first()["peak"] == 0
    risk = scoring.risk_coverage(cases.filter("interval_distance IS NOT NULL").withColumn("m", F.col("predicted").cast("double")), ["method"], "m", F.col("interval_distance") == 0)
    assert sorted((r["accepted"], r["wrong"]) for r in risk.collect()) == [(0, 0), (1, 1), (2, 1)]
