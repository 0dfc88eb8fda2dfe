"""Queries of the sequential kernels; SQL gives no rows for them, tests hold them against plain loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alignment, geometry, kernels
from ..sources import adapter
from ..sources.adapter import PAIR, STREAM, with_sql
from .catalog import query
from .sequences import events

PAIR_SCHEMA = "recording long, camera string"
STREAM_SCHEMA = "recording long, run string, camera string"


@query()
def sequence_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniqueness margins along the coarse path."""
    return kernels.uniqueness(adapter.frames(spark, sf_dir), PAIR, PAIR_SCHEMA, "luma")


def holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings here are shorter than those that the defaults are made for."""
    return kernels.holdout(adapter.frames(spark, sf_dir), adapter.mapping(spark, sf_dir), PAIR, PAIR_SCHEMA, "luma", widths=(20, 40, 80), edge=12, guard=3)


@query()
def abstention_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstention where seeded holes take the evidence away, and elsewhere."""
    return holes(spark, sf_dir)


@query()
def holdout_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection and false alarms by the width of the hole."""
    return kernels.holdout_rates(holes(spark, sf_dir), PAIR)


@query()
def vlad_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residual descriptors of vectors cut into eight tokens."""
    d = adapter.descriptors(spark, sf_dir)
    tokens = d.withColumn("tokens", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("v", i * 8 + 1, 8)))
    return kernels.vlad(tokens, ["recording", "run"], "recording long, run string", "ordinal", "tokens")


@query()
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded frames from ten strata of each stream, apart from the dark ones."""
    f = adapter.flags(spark, sf_dir).withColumn("blocked", (F.col("flag") == "too_dark") & (F.col("ordinal") % 4 == 0))
    return kernels.stratified_sample(f, STREAM, STREAM_SCHEMA, "ordinal", "blocked", 10, 5, 20260902)


@query()
def bootstrap_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median luma with a seeded interval."""
    return kernels.bootstrap_median(adapter.frames(spark, sf_dir), STREAM, STREAM_SCHEMA, "luma")


def point_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched points for each supplier: a map plus outliers, by arithmetic."""
    rows = adapter.table(spark, sf_dir, "lineitem")
    x, y = (F.col("l_extendedprice") % 896), (F.col("l_quantity") * 13 % 672)
    wrong = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_partkey") % 200).otherwise(0)
    return rows.select("l_suppkey", x.alias("ax"), y.alias("ay"), (x * 1.02 + 5 + wrong).alias("bx"), (y * 0.98 - 3 - wrong * 7 % 150).alias("by"))


@query()
def geometry_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support of matched points for the better of two models, by eight clauses."""
    return geometry.verified(point_pairs(spark, sf_dir), ["l_suppkey"], "l_suppkey long", (896, 672), (896, 672))


@query()
def resolution_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs verified at four rasters, and the raster that passes most."""
    return geometry.resolution_study(point_pairs(spark, sf_dir), ["l_suppkey"], "l_suppkey long", (896, 672), [(448, 336), (640, 480), (896, 672), (1440, 1080)], trials=200)


@query()
def phase_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifts between adjacent eight by eight images made of the vectors."""
    return kernels.shifts(adapter.descriptors(spark, sf_dir), ["recording", "run"], "recording long, run string", "ordinal", "v", 8, 8)


@query()
def reliability_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static and sky pixels of the eight by eight images made of the vectors."""
    return kernels.masks(adapter.descriptors(spark, sf_dir), ["recording", "run"], "recording long, run string", "ordinal", "v", 8, 8, 0.12, 0.15, 2)


@query()
def align_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole alignment: path, estimate, refinement, uniqueness, decision, bridging."""
    f = adapter.flags(spark, sf_dir)
    return alignment.align(f, PAIR, PAIR_SCHEMA, "luma", (F.col("flag") == "too_dark") & (F.col("ordinal") % 3 == 0), (F.col("ordinal") * 31) % 100 < 85)


@query()
def posterior_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posterior with events, speeds, loop closure and the pass by structure, and its decision."""
    return alignment.closed_posterior(adapter.frames(spark, sf_dir), PAIR, PAIR_SCHEMA, "luma", events=events(spark, sf_dir), speed="p99", structure=True)


@query(
    with_sql("mapping")
    + """SELECT recording, camera, runA_frame, CASE WHEN runB_frame IS NOT NULL THEN max(moved) OVER (PARTITION BY recording, camera ORDER BY runA_frame) END AS corrected FROM
(SELECT *, runB_frame + CASE WHEN runA_frame % 7 >= 2 THEN CAST(greatest(least(round_even(9.0 / (runA_frame % 7), 0), 10.0), -10.0) AS BIGINT) ELSE 0 END AS moved FROM mapping)"""
)
def corrected_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partners moved by a measured offset over the sweep rate, monotone again."""
    m = adapter.mapping(spark, sf_dir)
    made = alignment.corrected(m, PAIR, F.lit(9.0), (F.col("runA_frame") % 7).cast("double"))
    return made.select(*PAIR, "runA_frame", F.when(F.col("runB_frame").isNotNull(), F.col("corrected")).alias("corrected"))


@query(
    with_sql("labels_v")
    + """SELECT query_id, CAST(floor(low + least(shift, 0.0)) AS BIGINT) AS wide_low, CAST(ceil(high + greatest(shift, 0.0)) AS BIGINT) AS wide_high FROM (SELECT *, CAST(greatest(least((runA_frame % 30 - 15) / 2.0, 10.0), -10.0) AS DOUBLE) AS shift FROM labels_v)"""
)
def widened_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label intervals under either of two criteria."""
    rows = adapter.labels(spark, sf_dir)
    return alignment.widened(rows, (F.col("runA_frame") % 30 - 15) / 2.0).select("query_id", "wide_low", "wide_high")
