"""Joins between runs, cameras and events: bands become equal keys, never a comparison of all pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sequences as seq


def windows(df: DataFrame, keys: list[str], frame: str, radius: int) -> DataFrame:
    """The distinct (keys, frame) within `radius` of a row."""
    return df.select(*keys, F.explode(F.sequence(F.col(frame) - radius, F.col(frame) + radius)).alias(frame)).distinct()


def near(df: DataFrame, events: DataFrame, keys: list[str], frame: str, event: str, radius: int, name: str = "near") -> DataFrame:
    """df with whether an event lies within `radius` of each row."""
    marks = windows(events.select(*keys, F.col(event).alias(frame)), keys, frame, radius).withColumn(name, F.lit(True))
    return df.join(marks, [*keys, frame], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def nearest(df: DataFrame, events: DataFrame, keys: list[str], frame: str, event: str, radius: int) -> DataFrame:
    """(keys, frame, event): the event nearest to each distinct frame within `radius`, the earlier of two as near; rows without one are left out."""
    spread = events.select(*keys, event, F.explode(F.sequence(F.col(event) - radius, F.col(event) + radius)).alias(frame))
    distance = F.abs(F.col(event) - F.col(frame))
    return df.select(*keys, frame).distinct().join(spread, [*keys, frame]).groupBy(*keys, frame).agg(F.min_by(event, F.struct(distance, F.col(event))).alias(event))


def cross_camera_residual(mapping: DataFrame, keys: list[str], camera: str, cameras: tuple[str, str], frame: str, value: str, width: int) -> DataFrame:
    """(keys, frame, lagged, median, residual) of the frames that both cameras map; keys with fewer than `width` of them are left out.

    The two cameras meet in one aggregation by frame, not in a self join.
    """
    side = lambda c: F.max(F.when(F.col(camera) == c, F.col(value)))
    shared = mapping.filter(F.col(value).isNotNull() & F.col(camera).isin(*cameras)).groupBy(*keys, F.col(frame).alias("frame")).agg(side(cameras[0]).alias("_a"), side(cameras[1]).alias("_b"))
    lagged = shared.filter("_a IS NOT NULL AND _b IS NOT NULL").select(*keys, "frame", (F.col("_b") - F.col("_a")).alias("lagged"))
    sized = lagged.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter(F.col("_n") >= width).drop("_n")
    return seq.running_median(sized, keys, "frame", "lagged", width).withColumn("residual", F.abs(F.col("lagged") - F.col("median"))).select(*keys, "frame", "lagged", "median", "residual")


def missing_keys(wanted: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted keys that aren't found."""
    return wanted.select(*keys).distinct().join(found.select(*keys), keys, "left_anti")


def overlapping(stretches: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Stretches (start, end) that overlap a span (low, high) of their keys: closed intervals."""
    return stretches.join(spans, keys).filter((F.col("start") <= F.col("high")) & (F.col("end") >= F.col("low")))


def ladder(refusals: list[tuple[str, Column]], accepted: str = "accepted") -> Column:
    """The name of the first refusal that holds, else `accepted`."""
    if not refusals:
        return F.lit(accepted)
    (name, condition), *rest = refusals
    return reduce(lambda chain, r: chain.when(r[1], r[0]), rest, F.when(condition, name)).otherwise(accepted)


def partner_places(mapping: DataFrame, columns: DataFrame, keys: list[str], partner: str, place: str) -> DataFrame:
    """mapping with the place of each partner among columns (keys, partner, place), -1 where there is none."""
    return mapping.join(columns.select(*keys, partner, place), [*keys, partner], "left").withColumn(place, F.coalesce(place, F.lit(-1)))
