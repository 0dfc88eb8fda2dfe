"""Aggregates over matched points (ax, ay) and (bx, by) of two images: how far the scene moved, and at what rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fewer matches than these measure nothing.
LEAST_MATCHES = 15


def median(column: str) -> Column:
    return F.percentile(column, F.lit(0.5))


def displacements(matches: DataFrame, keys: list[str], least: int = LEAST_MATCHES) -> DataFrame:
    """(keys, matches, dx, dy): medians of the points' displacements, null where there are too few."""
    moved = matches.select(*keys, (F.col("bx") - F.col("ax")).alias("_dx"), (F.col("by") - F.col("ay")).alias("_dy"))
    found = moved.groupBy(*keys).agg(F.count(F.lit(1)).alias("matches"), median("_dx").alias("dx"), median("_dy").alias("dy"))
    enough = F.col("matches") >= least
    return found.select(*keys, "matches", F.when(enough, F.col("dx")).alias("dx"), F.when(enough, F.col("dy")).alias("dy"))


def sweep_rates(measured: DataFrame, frames: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """(keys, frame, rate, interpolated): pixels by which the scene sweeps from each frame to the next.

    measured: (keys, frame, dx), dx null or the row missing where it could not be
    measured. Gaps are filled between their neighbours, the ends are held, and
    the last frame repeats the one before it.
    """
    rows = frames.select(*keys, frame).distinct().join(measured.select(*keys, frame, F.abs("dx").alias("_rate")), [*keys, frame], "left")
    # the last frame has no next one: a gap like those at an end
    w = Window.partitionBy(*keys).orderBy(frame)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("_rate").isNotNull(), F.struct(F.col(frame).alias("f"), F.col("_rate").alias("r")))
    placed = rows.withColumn("_before", F.last(known, ignorenulls=True).over(back)).withColumn("_after", F.first(known, ignorenulls=True).over(ahead))
    share = (F.col(frame) - F.col("_before.f")) / (F.col("_after.f") - F.col("_before.f"))
    between = F.col("_before.r") + share * (F.col("_after.r") - F.col("_before.r"))
    return placed.select(*keys, frame, F.coalesce("_rate", between, "_before.r", "_after.r").alias("rate"), F.col("_rate").isNull().alias("interpolated"))


def at_partners(pairs: DataFrame, measured: DataFrame, keys: list[str], a: str, b: str, span: int = 3) -> DataFrame:
    """pairs with matches, dx, dy at the partner, and the rate of dx for each frame of run B around it.

    measured: (keys, a, b, matches, dx, dy). The rate needs both frames `span` away.
    """
    offsets = F.array(*[F.lit(o).cast("bigint") for o in (-span, 0, span)])
    wanted = pairs.select(*keys, a, F.col(b).alias("_partner")).distinct().withColumn("_offset", F.explode(offsets)).withColumn(b, F.col("_partner") + F.col("_offset"))
    at = lambda offset, column: F.max(F.when(F.col("_offset") == offset, F.col(column)))
    found = wanted.join(measured, [*keys, a, b], "left").groupBy(*keys, a, F.col("_partner").alias(b)).agg(at(0, "matches").alias("matches"), at(0, "dx").alias("dx"), at(0, "dy").alias("dy"), at(-span, "dx").alias("_low"), at(span, "dx").alias("_high"))
    return pairs.join(found.withColumn("dx_per_frame", (F.col("_high") - F.col("_low")) / (2 * span)).drop("_low", "_high"), [*keys, a, b], "left")


def convention(measured: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """(keys, sampled, measured, dx and dy with their spread, trend of dx in 1000 frames, sweep): what all sampled pairs say together.

    The spread is 1.4826 times the median distance from the median; the trend
    needs more than three pairs.
    """
    middle = measured.groupBy(*keys).agg(median("dx").alias("_mx"), median("dy").alias("_my"))
    near = measured.join(middle, keys).withColumn("_ax", F.abs(F.col("dx") - F.col("_mx"))).withColumn("_ay", F.abs(F.col("dy") - F.col("_my")))
    there = F.count("dx")
    return near.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sampled"),
        there.alias("measured"),
        median("dx").alias("dx"),
        median("dy").alias("dy"),
        (1.4826 * median("_ax")).alias("dx_mad"),
        (1.4826 * median("_ay")).alias("dy_mad"),
        F.when(there > 3, 1000 * F.regr_slope("dx", F.col(frame).cast("double"))).alias("trend"),
        median("dx_per_frame").alias("sweep"),
    )


def rechecked(mapping: DataFrame, measured: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, measured, dx): displacement left at the partners that a corrected mapping gives."""
    return mapping.filter(F.col(b).isNotNull()).join(measured, [*keys, a, b]).groupBy(*keys).agg(F.count("dx").alias("measured"), median("dx").alias("dx"))


def compensation(measured: DataFrame, raster: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """measured with dx_px and dy_px: the move at another raster that undoes a displacement, so of the opposite sign."""
    undone = lambda d, size, new: (-F.rint(F.col(d) / size * new)).cast("bigint")
    return measured.withColumn("dx_px", undone("dx", raster[0], target[0])).withColumn("dy_px", undone("dy", raster[1], target[1]))
