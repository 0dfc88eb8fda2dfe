"""The composed alignment on recordings whose answer is known."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinpath.operators import alignment, kernels


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(4)
    signal = np.cumsum(rng.normal(size=400)) * 8
    rows = [(r, run, i, float(v)) for r in (1, 2) for run, values in (("runA", signal), ("runB", np.concatenate([signal, signal[-1] + np.zeros(20)]))) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "recording long, run string, ordinal long, value double")


def test_alignment_finds_the_identity(frames):
    found = alignment.align(frames, ["recording"], "recording long", "value", F.col("ordinal") % 97 == 5, F.lit(True)).toPandas()
    assert len(found) == 800 and found.groupby("recording").size().tolist() == [400, 400]
    mapped = found.dropna(subset=["runB_frame"])
    assert (np.abs(mapped["runB_frame"] - mapped["runA_frame"]) <= 2).mean() > 0.9
    for _, one in mapped.sort_values("runA_frame").groupby("recording"):
        assert (np.diff(one["runB_frame"]) >= 0).all()
    assert set(found.loc[found["runA_frame"] % 97 == 5, "status"]) <= {"blocked"}


def test_posterior_finds_the_identity(frames):
    found = alignment.closed_posterior(frames, ["recording"], "recording long", "value").toPandas()
    assert (np.abs(found["row"] - found["column"]) <= 8).mean() > 0.9
    assert found["window"].between(0, 1 + 1e-9).all() and found["absent"].between(0, 1 + 1e-9).all()


def test_one_run_alone_gives_nothing(frames):
    alone = frames.filter("run = 'runA'")
    assert kernels.dtw(alone, ["recording"], "recording long", "value").count() == 0
    assert kernels.posterior(alone, ["recording"], "recording long", "value").count() == 0
    assert kernels.refined(frames.limit(0), ["recording"], "recording long", "value", "ratchet").count() == 0


def test_corrections(spark):
    m = spark.createDataFrame([("c", i, 10 + i) for i in range(5)] + [("c", 5, None)], "k string, runA_frame long, runB_frame long")
    rate = F.when(F.col("runA_frame") == 0, 1.0).otherwise(3.0)
    rows = alignment.corrected(m, ["k"], F.lit(-6.0), rate).orderBy("runA_frame").collect()
    assert [r["corrected"] for r in rows] == [10, 10, 10, 11, 12, None]
    labels = spark.createDataFrame([(5, 9, -2.5), (5, 9, 50.0), (5, 9, None)], "low long, high long, shift double")
    assert [(r["wide_low"], r["wide_high"]) for r in alignment.widened(labels, F.col("shift")).collect()] == [(2, 9), (5, 19), (5, 9)]
