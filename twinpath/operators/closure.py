"""Whether views of one place are mapped to one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from . import similarity as sim


def confirmed(pairs: DataFrame, others: DataFrame, keys: list[str], tolerance: int = 6) -> DataFrame:
    """The pairs (a, b) that have one of the others within so many frames at both ends; the band becomes equal keys."""
    near = others.select(*keys, F.explode(F.sequence(F.col("a") - tolerance, F.col("a") + tolerance)).alias("a"), F.col("b").alias("_b"))
    met = pairs.select(*keys, "a", "b").join(near, [*keys, "a"]).filter(F.abs(F.col("b") - F.col("_b")) <= tolerance)
    return pairs.join(met.select(*keys, "a", "b").distinct(), [*keys, "a", "b"], "left_semi")


def partner_ranks(pairs: DataFrame, vectors: DataFrame, keys: list[str], separation: int) -> DataFrame:
    """pairs (keys, p, q, s: their likeness) with the rank of q among the distant frames of p; 1 where they are not distant themselves.

    Only the frames that are asked for are paired with the others.
    """
    asked = vectors.join(pairs.select(*keys, F.col("p").alias("ordinal")).distinct(), [*keys, "ordinal"], "left_semi")
    around = sim.pairs(asked, vectors, keys).select(*keys, F.col("a").alias("p"), F.col("b").alias("_x"), F.col("s").alias("_s"))
    met = pairs.join(around, [*keys, "p"])
    better = F.count(F.when((F.abs(F.col("_x") - F.col("p")) >= separation) & (F.col("_s") > F.col("s")), 1))
    ranked = met.groupBy(*pairs.columns).agg(better.alias("_better"))
    local = F.abs(F.col("p") - F.col("q")) < separation
    return ranked.withColumn("rank", F.when(local, F.lit(1).cast("bigint")).otherwise(F.col("_better") + 1)).drop("_better")


def closure(revisits: DataFrame, mapping: DataFrame, vectors: DataFrame, keys: list[str], key_schema: str, apart: int = 60, most: int = 40, separation: int = 150, same_frames: int = 12, same_rank: int = 25) -> DataFrame:
    """(keys, a, b, s, partner_a, partner_b, gap, rank, verdict) of thinned revisits (a, b, s) of run A.

    Consistent are pairs whose partners lie within `same_frames`, or look so
    alike that they rank among each other's `same_rank` best distant frames.
    mapping: (keys, runA_frame, runB_frame); vectors: (keys, ordinal, v) of run B.
    """
    thinned = kernels.thinned(revisits, keys, key_schema, apart, most)
    to = lambda end: mapping.filter(F.col("runB_frame").isNotNull()).select(*keys, F.col("runA_frame").alias(end), F.col("runB_frame").alias(f"partner_{end}"))
    ends = thinned.join(to("a"), [*keys, "a"], "left").join(to("b"), [*keys, "b"], "left")
    p, q = F.col("partner_a"), F.col("partner_b")
    mapped = ends.filter(p.isNotNull() & q.isNotNull()).select(*keys, p.alias("p"), q.alias("q")).distinct()
    side = lambda frame, name: vectors.select(*keys, F.col("ordinal").alias(frame), F.col("v").alias(name))
    likeness = mapped.join(side("p", "_vp"), [*keys, "p"]).join(side("q", "_vq"), [*keys, "q"]).select(*keys, "p", "q", F.round(sim.dot(F.col("_vp"), F.col("_vq")), 6).alias("s"))
    ranks = partner_ranks(likeness, vectors, keys, separation).select(*keys, F.col("p").alias("partner_a"), F.col("q").alias("partner_b"), "rank")
    judged = ends.join(ranks, [*keys, "partner_a", "partner_b"], "left").withColumn("gap", F.abs(p - q))
    verdict = F.when(F.col("gap").isNull(), "not_both_mapped").when((F.col("gap") <= same_frames) | (F.col("rank") <= same_rank), "consistent").otherwise("INCONSISTENT")
    return judged.select(*keys, "a", "b", "s", "partner_a", "partner_b", "gap", "rank", verdict.alias("verdict"))
