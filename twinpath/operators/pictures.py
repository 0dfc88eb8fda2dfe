"""Aggregates over points and pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pixels
from . import kernels
from . import sequences as seq


def _tiles(df: DataFrame, x: str, y: str, width: int, height: int, rows: int, columns: int) -> DataFrame:
    return df.withColumn("_cx", (F.col(x) * columns / width).cast("bigint")).withColumn("_cy", (F.col(y) * rows / height).cast("bigint"))


def spatial_support(points: DataFrame, keys: list[str], x: str, y: str, width: int, height: int, rows: int = 3, columns: int = 4) -> DataFrame:
    """(keys, points, cells, rows_, columns_, spread_x, spread_y): where points lie on a grid, and the range of their middle 80 %."""
    q = lambda c: F.percentile(c, F.array(F.lit(0.1), F.lit(0.9)))
    cells = F.collect_set(F.col("_cy") * columns + F.col("_cx"))  # at most rows * columns members
    made = _tiles(points, x, y, width, height, rows, columns).groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), cells.alias("_cells"), q(x).alias("_qx"), q(y).alias("_qy"))
    distinct = lambda f: F.size(F.array_distinct(F.transform("_cells", f))).cast("bigint")
    return made.select(
        *keys, "points", F.size("_cells").cast("bigint").alias("cells"), distinct(lambda c: F.floor(c / columns)).alias("rows_"), distinct(lambda c: c % columns).alias("columns_"),
        F.round((F.get("_qx", F.lit(1)) - F.get("_qx", F.lit(0))) / width, 6).alias("spread_x"), F.round((F.get("_qy", F.lit(1)) - F.get("_qy", F.lit(0))) / height, 6).alias("spread_y"),
    )


def supported(support: DataFrame) -> DataFrame:
    """Support whose points lie in three cells, two rows and two columns, over a fifth of the width and most of that of the height."""
    return support.withColumn("supported", (F.col("cells") >= 3) & (F.col("rows_") >= 2) & (F.col("columns_") >= 2) & (F.col("spread_x") >= 0.20) & (F.col("spread_y") >= 0.18))


def tile_coverage(points: DataFrame, keys: list[str], x: str, y: str, changed: str, width: int, height: int, least: float = 0.035, rows: int = 3, columns: int = 4) -> DataFrame:
    """(keys, tiles, moving, coverage): the share of all tiles in which at least such a share of pixels changed."""
    tiles = _tiles(points, x, y, width, height, rows, columns).groupBy(*keys, "_cx", "_cy").agg(F.round(F.avg(F.col(changed).cast("double")), 9).alias("_share"))
    moving = F.count(F.when(F.col("_share") >= least, 1))
    return tiles.groupBy(*keys).agg(F.count(F.lit(1)).alias("tiles"), moving.alias("moving"), F.round(moving / F.lit(float(rows * columns)), 6).alias("coverage"))


def temporal_statistics(frames: DataFrame, keys: list[str], images: str) -> DataFrame:
    """(keys, pixel, median, sd, most) of each element of an array column."""
    exploded = frames.select(*keys, F.posexplode(images).alias("pixel", "_x"))
    return exploded.groupBy(*keys, F.col("pixel").cast("bigint").alias("pixel")).agg(F.round(F.percentile("_x", F.lit(0.5)), 6).alias("median"), F.round(F.stddev_pop("_x"), 6).alias("sd"), F.round(F.max("_x"), 6).alias("most"))


def reference(frames: DataFrame, keys: list[str], images: str, how: str) -> DataFrame:
    """(keys, reference): the mean or the median of each pixel over a group, as one array."""
    of = {"mean": F.avg("_x"), "median": F.percentile("_x", F.lit(0.5))}[how]
    each = frames.select(*keys, F.posexplode(images).alias("_i", "_x")).groupBy(*keys, "_i").agg(of.alias("_x"))
    return each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_all")).select(*keys, F.col("_all._x").alias("reference"))


def motion_rows(frames: DataFrame, keys: list[str], order: str, images: str, rows: int, columns: int, threshold: float, tile_least: float, width: int) -> DataFrame:
    """(keys, order, changed_fraction, tile_coverage, smoothed_changed): what changed in each image against the one before it."""
    w = Window.partitionBy(*keys).orderBy(order)
    pairs = frames.select(*keys, order, F.col(images).alias("_now"), F.lag(images).over(w).alias("_last")).filter(F.col("_last").isNotNull())
    masks = pairs.select(*keys, order, pixels.changed(F.col("_last"), F.col("_now"), threshold).alias("_mask"))
    shares = masks.select(*keys, order, pixels.average(F.transform("_mask", lambda x: x.cast("double"))).alias("changed_fraction"), pixels.coverage(F.col("_mask"), rows, columns, least=tile_least).alias("tile_coverage"))
    return seq.running_median(shares, keys, order, "changed_fraction", width, "smoothed_changed")


def phase_rows(frames: DataFrame, keys: list[str], key_schema: str, order: str, images: str, rows: int, columns: int, width: int) -> DataFrame:
    """(keys, order, dy, dx, magnitude, smoothed_magnitude): how the edges of each image moved against the one before it."""
    drawn = frames.select(*keys, order, pixels.edges(F.col(images), rows, columns).alias("_edges"))
    moved = kernels.shifts(drawn, keys, key_schema, order, "_edges", rows, columns)
    return seq.running_median(moved.withColumn("magnitude", F.sqrt(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx"))), keys, order, "magnitude", width, "smoothed_magnitude")
