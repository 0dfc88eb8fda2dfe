"""Runs, steps, medians and gaps against plain loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinpath.operators import agreement, sequences as seq


def frames(spark, values, keys=("s",)):
    return spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "k string, o long, v double")


def collected(df, *columns, order="o"):
    return [tuple(r[c] for c in columns) for r in df.orderBy(order).collect()]


@pytest.mark.parametrize(("ordinals", "least", "expected"), [([1, 2, 3, 7, 8, 20], 2, [(1, 3, 3), (7, 8, 2)]), ([9, 8, 7], 1, [(7, 9, 3)]), ([], 1, [])])
def test_islands(spark, ordinals, least, expected):
    df = spark.createDataFrame([("s", o) for o in ordinals], "k string, o long")
    assert collected(seq.islands(df, ["k"], "o", least), "start", "end", "length", order="start") == expected


def test_steps_cross_neither_gaps_nor_nulls(spark):
    df = spark.createDataFrame([("s", 0, 5), ("s", 1, 7), ("s", 2, None), ("s", 3, 9), ("s", 5, 20), ("s", 6, 18)], "k string, o long, b long")
    assert collected(seq.steps(df, ["k"], "o", "b"), "o", "increment") == [(1, 2), (6, -2)]


@pytest.mark.parametrize("width", [3, 7])
def test_running_median_repeats_the_edges(spark, width):
    rng = np.random.default_rng(1)
    values = rng.normal(size=23).round(3)
    padded = np.pad(values, width // 2, mode="edge")
    expected = [np.median(padded[i : i + width]) for i in range(len(values))]
    found = [r[0] for r in collected(seq.running_median(frames(spark, values.tolist()), ["k"], "o", "v", width), "median")]
    assert np.allclose(found, expected)


def test_moving_average_has_zeros_beyond_the_edges(spark):
    values = [3.0, 6.0, 9.0, 12.0]
    found = [r[0] for r in collected(seq.moving_average(frames(spark, values), ["k"], "o", "v", 3), "average")]
    assert np.allclose(found, np.convolve(values, np.ones(3) / 3, mode="same"))


def test_events_merge_and_round_half_to_even(spark):
    df = spark.createDataFrame([("s", o) for o in (1, 4, 10, 11, 30)], "k string, o long")
    assert collected(seq.merged_events(df, ["k"], "o", 3), "event", "members", order="event") == [(2, 2), (10, 2), (30, 1)]


def test_onset_needs_a_full_window(spark):
    active = [0] * 5 + [1] * 4
    assert seq.sustained_onset(frames(spark, [float(a) for a in active]), ["k"], "o", F.col("v") > 0, 3, 4).first()["onset"] == 4
    assert seq.sustained_onset(frames(spark, [1.0, 1.0]), ["k"], "o", F.col("v") > 0, 1, 4).first()["onset"] is None


def test_interpolation(spark):
    found = [r[0] for r in collected(seq.interpolated(frames(spark, [None, 2.0, None, None, 5.0, None]), ["k"], "o", "v"), "filled")]
    assert found == [None, 2.0, 3.0, 4.0, 5.0, 5.0]


def test_bridging(spark):
    rows = [("s", i, b, c, st) for i, (b, c, st) in enumerate([(10, 10, "ok"), (None, 11, "gap"), (None, 12, "gap"), (13, 13, "ok"), (None, 99, "gap"), (15, 15, "ok"), (None, 16, "idle"), (17, 17, "ok"), (None, 18, "gap")])]
    df = spark.createDataFrame(rows, "k string, o long, b long, c long, status string")
    found = collected(seq.bridged(df, ["k"], "o", "b", "c", 10, F.col("status") == "idle"), "b", "bridged")
    assert found == [(10, False), (11, True), (12, True), (13, False), (None, False), (15, False), (None, False), (17, False), (None, False)]


def test_densify_matches_numpy(spark):
    nodes = [(0, 0), (4, 6), (7, 7), (12, 20)]
    df = spark.createDataFrame([("s", a, b) for a, b in nodes], "k string, o long, c long")
    expected = np.rint(np.interp(np.arange(13), [n[0] for n in nodes], [n[1] for n in nodes])).astype(int)
    assert [r[0] for r in collected(seq.densified(df, ["k"], "o", "c"), "estimate")] == expected.tolist()


def test_ranges_and_completion(spark):
    df = spark.createDataFrame([("s", o) for o in (1, 2, 3, 7, 9, 10)], "k string, o long")
    assert seq.range_text(df, ["k"], "o").first()["ranges"] == "1-3,7,9-10"
    lengths = spark.createDataFrame([("s", 4)], "k string, n long")
    assert seq.completed(df.withColumn("there", F.lit(True)), lengths, ["k"], "o", "n").count() == 4


def test_nearest_takes_the_earlier_of_two_as_near(spark):
    events = spark.createDataFrame([("s", 10), ("s", 20)], "k string, e long")
    rows = spark.createDataFrame([("s", 15), ("s", 18), ("s", 99)], "k string, o long")
    assert collected(agreement.nearest(rows, events, ["k"], "o", "e", 8), "o", "e") == [(15, 10), (18, 20)]


def bump(i):
    return 12 if 200 <= i < 240 else 0


@pytest.mark.parametrize(("lag", "n", "checks"), [(lambda i: 20, 400, {i: 0 for i in range(400)}), (bump, 600, {205: 12, 20: 0})])
def test_residual_about_the_running_lag(spark, lag, n, checks):
    rows = [("r", c, i, i + (lag(i) if c == "cam5" else 0)) for i in range(n) for c in ("cam0", "cam5")]
    df = spark.createDataFrame(rows, "k string, camera string, a long, b long")
    found = {r["frame"]: r["residual"] for r in agreement.cross_camera_residual(df, ["k"], "camera", ("cam0", "cam5"), "a", "b", 201).collect()}
    assert len(found) == n and all(found[i] == v for i, v in checks.items())


def test_residual_needs_enough_shared_frames(spark):
    rows = [("r", c, i, i) for i in range(10) for c in ("cam0", "cam5")]
    df = spark.createDataFrame(rows, "k string, camera string, a long, b long")
    assert agreement.cross_camera_residual(df, ["k"], "camera", ("cam0", "cam5"), "a", "b", 201).count() == 0
