"""Whether matched points of two images support that they show one place."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import images
from . import kernels, pictures

#: Matches, inliers and their share that support needs; what its points must cover is `pictures.supported`.
LEAST_MATCHES, LEAST_INLIERS, LEAST_RATIO = 20, 12, 0.25
SPREAD = ("cells", "rows_", "columns_", "spread_x", "spread_y")


def matched(features: DataFrame, keys: list[str], key_schema: str, ratio: float = 0.8) -> DataFrame:
    """(keys, i, j, ax, ay, bx, by) of features (keys, run, number, x, y, v) of two images that are each other's nearest, clearly nearer than the next.

    v are unit descriptors; run tells the images apart. A pair of images is one
    matrix of distances.
    """

    def kernel(pdf: pd.DataFrame) -> dict:
        a, b = (pdf[pdf["run"] == run].sort_values("number") for run in ("runA", "runB"))
        stacked = lambda df: np.stack(df["v"].to_numpy()).astype(float) if len(df) else np.zeros((0, 1))
        found = images.mutual_matches(stacked(a), stacked(b), ratio) if len(a) and len(b) else np.zeros((0, 2), dtype=int)
        p, q = a.iloc[found[:, 0]], b.iloc[found[:, 1]]
        return {"i": p["number"].to_numpy(), "j": q["number"].to_numpy(), **{f"{side}{c}": df[c].to_numpy(float) for side, df in (("a", p), ("b", q)) for c in ("x", "y")}}

    rows = features.select(*keys, "run", "number", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("v").cast("array<double>").alias("v"))
    return kernels.per_group(rows, keys, f"{key_schema}, i long, j long, ax double, ay double, bx double, by double", kernel)


def verified(points: DataFrame, keys: list[str], key_schema: str, raster_a: tuple[int, int], raster_b: tuple[int, int], trials: int = 750) -> DataFrame:
    """(keys, matches, inliers, inlier_ratio, cells, rows_, columns_, spread_x, spread_y, supported) of matched points (ax, ay, bx, by).

    The better of an epipolar and a projective model tells the inliers; what they
    cover is the lesser of both images. Support needs all eight: matches,
    inliers, their share, cells, rows, columns and both spreads.
    """
    inside = kernels.inlying(points, keys, key_schema, trials)
    seen = lambda name, raster: F.struct(F.lit(name).alias("image"), (F.col(f"{name}x") / raster[0]).alias("x"), (F.col(f"{name}y") / raster[1]).alias("y"))
    both = inside.select(*keys, "matches", F.explode(F.array(seen("a", raster_a), seen("b", raster_b))).alias("p")).select(*keys, "matches", "p.*")
    covered = pictures.spatial_support(both, [*keys, "matches", "image"], "x", "y", 1, 1)
    lesser = covered.groupBy(*keys, "matches").agg(F.max(F.when(F.col("cells") > 0, F.col("points")).otherwise(0)).alias("inliers"), *[F.coalesce(F.min(c), F.lit(0)).alias(c) for c in SPREAD])
    rated = pictures.supported(lesser.withColumn("inlier_ratio", F.round(F.col("inliers") / F.col("matches"), 4)))
    enough = (F.col("matches") >= LEAST_MATCHES) & (F.col("inliers") >= LEAST_INLIERS) & (F.col("inliers") / F.col("matches") >= LEAST_RATIO)
    return rated.select(*keys, "matches", "inliers", "inlier_ratio", *SPREAD, (enough & F.col("supported")).alias("supported"))


def resolution_study(points: DataFrame, keys: list[str], key_schema: str, raster: tuple[int, int], rasters: list[tuple[int, int]], trials: int = 750) -> DataFrame:
    """(width, height, pairs, median_matches, median_inliers, mean_inlier_ratio, passed, best) of verifying the same pairs at several rasters.

    Points are rounded to the pixels of each. The best raster passes most pairs;
    of equals, the smaller one costs less.
    """
    found = []
    for width, height in rasters:
        scale = lambda c, size, own: F.rint(F.col(c) / own * size).alias(c)
        sized = points.select(*keys, scale("ax", width, raster[0]), scale("ay", height, raster[1]), scale("bx", width, raster[0]), scale("by", height, raster[1]))
        found.append(verified(sized, keys, key_schema, (width, height), (width, height), trials).withColumn("width", F.lit(width)).withColumn("height", F.lit(height)))
    median = lambda c: F.percentile(c, F.lit(0.5))
    rows = reduce(DataFrame.unionByName, found).groupBy("width", "height").agg(F.count(F.lit(1)).alias("pairs"), median("matches").alias("median_matches"), median("inliers").alias("median_inliers"), F.round(F.avg("inlier_ratio"), 4).alias("mean_inlier_ratio"), F.count_if("supported").alias("passed"))
    best = F.max_by(F.struct("width", "height"), F.struct("passed", -F.col("width") * F.col("height"))).over(Window.partitionBy(F.lit(0)))  # a row for each raster
    return rows.withColumn("best", F.struct("width", "height") == best)
