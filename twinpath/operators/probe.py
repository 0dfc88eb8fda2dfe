"""Where a mapping's jumps come from: the refinement replayed in a window, beside what it would pick freely."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels


def replayed(frames: DataFrame, mapping: DataFrame, keys: list[str], key_schema: str, value: str, low: int, high: int, radius: int = 8) -> DataFrame:
    """(keys, runA_frame, coarse, submitted, replayed, free, score_at_pick, score_at_free, admissible, candidates) of the mapped frames in [low, high).

    The estimate is the line between the ends. The replay takes the best
    candidate about it that isn't before its last pick, and begins behind the
    partner of the frame before the window; free is the best of all candidates.
    """
    signals = kernels.two_runs(frames, keys, value)
    partners = kernels.partners_of(mapping, keys)
    names = ("runA_frame", "coarse", "submitted", "replayed", "free", "score_at_pick", "score_at_free", "admissible", "candidates")

    def kernel(pdf: pd.DataFrame) -> dict:
        a, b = kernels.split(pdf)
        to = {int(o): int(v) for o, v in pdf.loc[pdf["run"] == "mapped", ["ordinal", "value"]].itertuples(index=False)}
        asked = [f for f in range(low, min(high, len(a))) if f in to]
        rows, last = [], to.get(asked[0] - 1, -1) if asked else -1
        for f in asked if len(b) else []:
            centre = int(np.rint(f * (len(b) - 1) / max(len(a) - 1, 1)))
            around = np.arange(max(centre - radius, 0), min(centre + radius, len(b) - 1) + 1)
            found = -np.abs(a[f] - b[around])
            free = int(np.argmax(found))
            allowed = around >= last
            pick = int(around[np.argmax(np.where(allowed, found, -np.inf))]) if allowed.any() else max(centre, last)
            at = found[pick - around[0]] if around[0] <= pick <= around[-1] else np.nan
            rows.append((f, centre, to[f], pick, int(around[free]), float(at), float(found[free]), int(allowed.sum()), len(around)))
            last = pick
        return dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else {n: [] for n in names}

    schema = f"{key_schema}, runA_frame long, coarse long, submitted long, replayed long, free long, score_at_pick double, score_at_free double, admissible long, candidates long"
    return kernels.per_group(signals.unionByName(partners), keys, schema, kernel)


def median(column: Column) -> Column:
    return F.percentile(column, F.lit(0.5))


def summary(replay: DataFrame, keys: list[str], radius: int = 8, jump: int = 6) -> DataFrame:
    """(keys, frames, matching, forced, behind, …): what the replay says of each mapping."""
    w = Window.partitionBy(*keys).orderBy("runA_frame")
    step = lambda c: F.when(F.lag("runA_frame").over(w) == F.col("runA_frame") - 1, F.col(c) - F.lag(c).over(w))
    rows = replay
    for c in ("coarse", "submitted", "free"):
        rows = rows.withColumn(f"_{c}", step(c))
    behind, residual = F.col("free") < F.col("submitted"), F.col("submitted") - F.col("coarse")
    there = lambda c: F.when(behind, F.col(c))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if(F.col("replayed") == F.col("submitted")).alias("matching"),
        F.count_if(F.col("replayed") != F.col("free")).alias("forced"),
        F.count_if(behind).alias("behind"),
        median(F.when(behind, F.col("submitted") - F.col("free"))).alias("median_behind"),
        median(there("score_at_pick")).alias("median_score_at_pick"),
        median(there("score_at_free")).alias("median_score_at_free"),
        F.min("admissible").alias("least_admissible"),
        *[F.max(f"_{c}").alias(f"largest_{c}_step") for c in ("coarse", "submitted", "free")],
        *[F.count_if(F.col(f"_{c}") >= jump).alias(f"{c}_jumps") for c in ("coarse", "submitted", "free")],
        F.min(residual).alias("least_residual"),
        F.max(residual).alias("most_residual"),
        F.count_if(residual >= radius).alias("pinned"),
    )


def scored_others(others: DataFrame, replay: DataFrame, frames: DataFrame, keys: list[str], value: str, radius: int = 8, jump: int = 6) -> DataFrame:
    """(keys, method, frames, …): other mappings' picks (keys, method, runA_frame, predicted) in the window, scored on the same signals."""
    side = lambda run, frame, name: frames.filter(F.col("run") == run).select(*keys, F.col("ordinal").alias(frame), F.col(value).cast("double").alias(name))
    picks = others.filter(F.col("predicted").isNotNull()).select(*keys, "method", "runA_frame", "predicted")
    rows = picks.join(replay, [*keys, "runA_frame"]).join(side("runA", "runA_frame", "_a"), [*keys, "runA_frame"]).join(side("runB", "predicted", "_b"), [*keys, "predicted"])
    w = Window.partitionBy(*keys, "method").orderBy("runA_frame")
    rows = rows.withColumn("_step", F.when(F.lag("runA_frame").over(w) == F.col("runA_frame") - 1, F.col("predicted") - F.lag("predicted").over(w))).withColumn("_s", -F.abs(F.col("_a") - F.col("_b")))
    residual = F.col("predicted") - F.col("coarse")
    return rows.groupBy(*keys, "method").agg(
        F.count(F.lit(1)).alias("frames"),
        F.max("_step").alias("largest_step"),
        F.count_if(F.col("_step") >= jump).alias("jumps"),
        F.min(residual).alias("least_residual"),
        F.max(residual).alias("most_residual"),
        F.count_if(residual >= radius).alias("pinned"),
        median(F.col("_s")).alias("median_score"),
        median(F.col("score_at_pick")).alias("median_submitted_score"),
        median(F.col("score_at_free")).alias("median_free_score"),
        F.count_if(F.col("_s") >= F.col("score_at_pick")).alias("at_least_submitted"),
        F.count_if(F.col("predicted") == F.col("free")).alias("equal_free"),
    )
