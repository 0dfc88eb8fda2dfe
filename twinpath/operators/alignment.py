"""The alignment and the posterior as compositions of kernels and relational operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dynamic, scores
from . import agreement, kernels
from . import sequences as seq


def refined_around(frames: DataFrame, estimates: DataFrame, keys: list[str], key_schema: str, value: str, rule: str = "sloped") -> DataFrame:
    """(keys, runA_frame, candidate): refinement around given estimates; both tables meet in one grouping."""
    rows = kernels.two_runs(frames, keys, value).unionByName(estimates.select(*keys, F.lit("estimate").alias("run"), F.col("runA_frame").alias("ordinal"), F.col("estimate").cast("double").alias("value")))

    def kernel(pdf: pd.DataFrame) -> dict:
        a, b = kernels.split(pdf)
        centres = pdf[pdf["run"] == "estimate"].sort_values("ordinal")
        at = centres["ordinal"].to_numpy(np.int64)
        at = at[at < len(a)]
        if not len(at) or not len(b):
            return {"runA_frame": at[:0], "candidate": at[:0]}
        candidates, found = dynamic.window_scores(a[at], b, centres["value"].to_numpy(np.int64)[: len(at)])
        picks = dynamic.ratchet(candidates, found) if rule == "ratchet" else dynamic.sloped(at, candidates, found)
        return {"runA_frame": at, "candidate": np.clip(picks, 0, len(b) - 1)}

    return kernels.per_group(rows, keys, f"{key_schema}, runA_frame long, candidate long", kernel)


def align(frames: DataFrame, keys: list[str], key_schema: str, value: str, blocked: Column, supported: Column, bridge: int = 10, stride: int = 4, separation: int = 12, rule: str = "sloped") -> DataFrame:
    """(keys, runA_frame, estimate, candidate, tier, status, runB_frame, bridged): coarse path, dense estimate, refinement, uniqueness, typed decision, bridging.

    blocked, supported: conditions on a frame of run A that refuse it outright,
    and that the check of its geometry passed. Only the three kernels are
    sequential; everything between them is joins and windows within a recording.
    """
    coarse = kernels.dtw(frames, keys, key_schema, value, stride)
    estimates = seq.densified(coarse, keys, "row", "column").withColumnRenamed("row", "runA_frame")
    picks = refined_around(frames, estimates, keys, key_schema, value, rule)
    nodes = kernels.uniqueness(frames, keys, key_schema, value, stride, separation).select(*keys, F.col("row").alias("node"), scores.sequence_tier(F.col("margins")).alias("tier"))
    near = agreement.nearest(picks, nodes, keys, "runA_frame", "node", 4 * stride).join(nodes, [*keys, "node"]).drop("node")
    joined = picks.join(estimates, [*keys, "runA_frame"]).join(near, [*keys, "runA_frame"], "left")
    judged = frames.filter("run = 'runA'").select(*keys, F.col("ordinal").alias("runA_frame"), blocked.alias("_blocked"), supported.alias("_supported")).join(joined, [*keys, "runA_frame"], "left")
    status = agreement.ladder([("blocked", F.col("_blocked")), ("no_estimate", F.col("candidate").isNull()), ("sequence_failed", F.coalesce("tier", F.lit("failed")) == "failed"), ("geometry_failed", ~F.col("_supported"))])
    decided = judged.withColumn("status", status).withColumn("runB_frame", F.when(F.col("status") == "accepted", F.col("candidate"))).drop("_blocked", "_supported")
    filled = seq.bridged(decided, keys, "runA_frame", "runB_frame", "candidate", bridge, F.col("status") == "blocked")
    return filled.select(*keys, "runA_frame", "estimate", "candidate", "tier", F.when(F.col("bridged"), "bridged").otherwise(F.col("status")).alias("status"), "runB_frame", "bridged")


def closed_posterior(frames: DataFrame, keys: list[str], key_schema: str, value: str, stride: int = 4, rounds: int = 2, separation: int = 40, least: float = 0.97, most: int = 40, events: DataFrame | None = None, speed: str | None = None, structure: bool = False) -> DataFrame:
    """(keys, row, column, window, absent, accepted, revisits): the posterior with its channels, after loop closure.

    events: (keys, run, event); where both runs have one nearby, the evidence is
    multiplied. speed: a measure of each frame; the evidence is multiplied by how
    much likelier the bins of two frames meet than by chance along the first
    posterior's peaks. Then distant rows of run A that look alike are one place;
    each passes on, through the kernel of columns of run B that look alike, where
    its partner was found. structure: a last pass weighs the frames in a band
    about each peak by their own likeness.
    """
    rows_of, with_events = kernels.two_runs(frames, keys, value), events is not None
    if speed:
        rows_of = rows_of.unionByName(kernels.two_runs(frames, keys, speed).withColumn("run", F.concat(F.lit("speed "), "run")))
    if with_events:
        rows_of = rows_of.unionByName(events.select(*keys, F.concat(F.lit("event "), "run").alias("run"), F.col("event").alias("ordinal"), F.lit(1.0).alias("value")))

    def kernel(pdf: pd.DataFrame) -> dict:
        a, b = kernels.split(pdf)
        names = ("row", "column", "window", "absent", "accepted", "revisits")
        if not len(a) or not len(b):
            return {n: [] for n in names}
        of = lambda kind, run: pdf[pdf["run"] == f"{kind} {run}"].sort_values("ordinal")
        own = kernels.smooth_similarity(a, a, stride)
        i, j = np.nonzero(np.triu(own >= least, separation))
        pairs = dynamic.thinned([(int(x), int(y), float(own[x, y])) for x, y in zip(i, j, strict=True)], 15, most)
        other = kernels.smooth_similarity(b, b, stride)
        cut = np.sort(other, axis=1)[:, -min(15, other.shape[1])][:, None]
        same = np.where((other >= cut) & (other > 0.88), other, 0.0)
        same /= np.maximum(same.sum(axis=1, keepdims=True), 1e-12)
        emission = kernels.emission_of(a, b, stride)
        if with_events:
            emission = emission * dynamic.event_channel(*(np.arange(n) * stride for n in emission.shape), *(of("event", run)["ordinal"].to_numpy() for run in ("runA", "runB")))
        solve = lambda e: dynamic.forward_backward(e, e.mean(axis=1))
        mapped, gone = solve(emission)
        if speed:
            emission = emission * dynamic.speed_channel(*(of("speed", run)["value"].to_numpy(float)[::stride] for run in ("runA", "runB")), mapped.argmax(axis=1))
            mapped, gone = solve(emission)
        for _ in range(rounds if pairs else 0):
            emission = dynamic.closed(emission, mapped, [(x, y) for x, y, _ in pairs], same)
            mapped, gone = solve(emission)
        if structure:
            mapped, gone = solve(emission * dynamic.structure_channel(a[::stride], b[::stride], mapped.argmax(axis=1)))
        peak = mapped.argmax(axis=1)
        window, absent = dynamic.window_mass(mapped, peak), gone.sum(axis=1)
        return dict(zip(names, (np.arange(len(mapped)) * stride, peak * stride, window, absent, (absent <= 0.05) & (window >= 0.30), np.full(len(mapped), len(pairs))), strict=True))

    return kernels.per_group(rows_of, keys, f"{key_schema}, row long, column long, window double, absent double, accepted boolean, revisits long", kernel)


def corrected(mapping: DataFrame, keys: list[str], shift: Column, rate: Column, most: int = 10, least_rate: float = 2.0) -> DataFrame:
    """Partners moved by shift / rate frames, at most so many, not at all where the rate is too small; then made non-decreasing."""
    frames = F.when(F.abs(rate) >= least_rate, F.greatest(F.least(F.rint(shift / rate), F.lit(float(most))), F.lit(-float(most)))).otherwise(F.lit(0.0)).cast("bigint")
    moved = mapping.withColumn("moved", F.col("runB_frame") + frames)
    return seq.running_max(moved, keys, "runA_frame", "moved", "corrected").drop("moved")


def widened(labels: DataFrame, shift: Column, most: float = 10.0) -> DataFrame:
    """Label intervals that hold both criteria: as they are, and moved by a clipped shift."""
    clipped = F.greatest(F.least(F.coalesce(shift, F.lit(0.0)), F.lit(most)), F.lit(-most))
    return labels.withColumn("wide_low", F.floor(F.col("low") + F.least(clipped, F.lit(0.0)))).withColumn("wide_high", F.ceil(F.col("high") + F.greatest(clipped, F.lit(0.0))))
