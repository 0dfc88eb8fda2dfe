"""Geometry of matched points, hold-outs and channels, on cases whose answer is known."""

from __future__ import annotations

import numpy as np
import pytest

from twinpath.functions import dynamic, images
from twinpath.operators import geometry, kernels


def scene(n, seed, flat=False):
    """Points of a scene seen by two cameras, the second moved and turned; flat: all on one plane."""
    rng = np.random.default_rng(seed)
    world = np.column_stack([rng.uniform(-2, 2, (n, 2)), np.full(n, 5.0) if flat else rng.uniform(4, 9, n)])
    turn = 0.05
    r = np.array([[np.cos(turn), 0, np.sin(turn)], [0, 1, 0], [-np.sin(turn), 0, np.cos(turn)]])
    view = lambda x: 600 * x[:, :2] / x[:, 2:] + [448, 336]
    return view(world), view(world @ r.T + [0.4, 0.05, 0.1])


def test_epipolar_map_of_exact_matches():
    p, q = scene(30, 1)
    f = images.fundamental(p, q)
    assert images.epipolar_errors(f, p, q).max() < 1e-6 and np.linalg.matrix_rank(f / np.abs(f).max(), tol=1e-9) == 2
    assert np.isnan(images.fundamental(np.ones((8, 2)), q[:8])).all()
    several = images.fundamental(np.stack([p[:8], p[8:16]]), np.stack([q[:8], q[8:16]]))
    assert np.allclose(several[1], images.fundamental(p[8:16], q[8:16])) and images.epipolar_errors(several, p, q).shape == (2, 30)


@pytest.mark.parametrize("flat", [False, True])
def test_wrong_matches_are_told_apart(flat):
    p, q = scene(80, 2, flat)
    rng = np.random.default_rng(5)
    q = q.copy()
    q[60:] = rng.uniform([0, 0], [896, 672], (20, 2))
    inside = images.agreeing(p, q, 300)
    assert inside[:60].all() and inside[60:].sum() <= 5


def test_support_needs_every_clause(spark):
    p, q = scene(60, 3)
    near = p * 0.1 + 200, q * 0.1 + 200  # all in one cell
    few = p[:15], q[:15]
    rows = [(k, *map(float, a), *map(float, b)) for k, (x, y) in (("good", (p, q)), ("near", near), ("few", few)) for a, b in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, "k string, ax double, ay double, bx double, by double")
    found = {r["k"]: r for r in geometry.verified(df, ["k"], "k string", (896, 672), (896, 672), 100).collect()}
    assert found["good"]["supported"] and found["good"]["inliers"] == 60 and found["good"]["inlier_ratio"] == 1.0
    assert not found["near"]["supported"] and found["near"]["spread_x"] < 0.2
    assert not found["few"]["supported"] and found["few"]["matches"] == 15
    lone = geometry.verified(df.limit(3), ["k"], "k string", (896, 672), (896, 672), 20).first()
    assert (lone["matches"], lone["inliers"], lone["cells"], lone["supported"]) == (3, 0, 0, False)


def test_resolution_study_marks_one_best(spark):
    p, q = scene(40, 4)
    df = spark.createDataFrame([(k, *map(float, a), *map(float, b)) for k in (1, 2) for a, b in zip(p, q, strict=True)], "k long, ax double, ay double, bx double, by double")
    rows = geometry.resolution_study(df, ["k"], "k long", (896, 672), [(448, 336), (896, 672)], 60).collect()
    assert len(rows) == 2 and sum(r["best"] for r in rows) == 1 and all(r["pairs"] == 2 for r in rows)


def test_holdout_detects_what_it_takes_away(spark):
    rng = np.random.default_rng(6)
    signal = np.cumsum(rng.normal(size=260)) * 8
    frames = spark.createDataFrame([(1, run, i, float(v)) for run in ("runA", "runB") for i, v in enumerate(signal)], "k long, run string, ordinal long, value double")
    mapping = spark.createDataFrame([(1, i, i) for i in range(260)], "k long, runA_frame long, runB_frame long")
    trials = kernels.holdout(frames, mapping, ["k"], "k long", "value", widths=(60, 500), edge=30, guard=10)
    rows = trials.collect()
    assert [r["width"] for r in rows] == [60] * 3 and all(r["orphaned"] == 40 and r["unaffected"] == 260 - 80 for r in rows)
    rate = kernels.holdout_rates(trials, ["k"]).first()
    assert rate["trials"] == 3 and rate["detection_rate"] > rate["false_alarm_rate"]


def test_channels():
    events = dynamic.event_channel(np.arange(0, 40, 4), np.arange(0, 40, 4), np.array([8]), np.array([20]))
    assert set(np.unique(events)) == {1.0, 2.5} and events[2, 5] == 2.5 and events[2, 0] == 1.0
    assert (dynamic.event_channel(np.arange(3), np.arange(3), np.array([]), np.array([1])) == 1).all()
    rng = np.random.default_rng(1)
    v = rng.uniform(size=300)
    speed = dynamic.speed_channel(v, v, np.arange(300))
    assert speed.shape == (300, 300) and np.diag(speed).mean() > 1.5 > speed.mean() and speed.min() >= 0.25 and speed.max() <= 4
    shape = dynamic.structure_channel(v, v, np.arange(300))
    assert np.diag(shape).min() > 1 and shape[0, 50] == 1.0


def test_absence_by_row_equals_the_constant():
    rng = np.random.default_rng(2)
    e = rng.random((6, 5)) + 0.1
    for x, y in zip(dynamic.forward_backward(e, 0.5), dynamic.forward_backward(e, np.full(6, 0.5)), strict=True):
        assert np.allclose(x, y)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "k long, ax double, ay double, bx double, by double")
    assert geometry.verified(empty, ["k"], "k long", (10, 10), (10, 10)).count() == 0
