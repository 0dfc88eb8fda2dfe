"""Where the files of recordings lie: either a folder for each run, or all in one with the second run's names suffixed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

#: The runs and cameras, the names of their files, and what the second run's have in the flat layout.
RUNS, CAMERAS = ("runA", "runB"), ("cam0", "cam5")
STREAM_NAME, SIDECAR_NAME, SECOND = "{camera}_20_yuv420p_output.hevc", "{camera}_20_yuv420p_output.hevc.timestamps.txt", " (1)"


def candidates(root: str, run: str, camera: str, name: str = STREAM_NAME) -> list[str]:
    """The places of a file in the two layouts, that which counts first before the other."""
    if run not in RUNS or camera not in CAMERAS:
        raise ValueError(f"there is no stream {run}/{camera}")
    own = name.format(camera=camera)
    stem, _, kind = own.rpartition(".")
    return [f"{root}/{run}/{own}", f"{root}/{stem}{SECOND if run == 'runB' else ''}.{kind}"]


def first_existing(spark: SparkSession, *paths: str) -> str:
    for path in paths:
        if files.exists(spark, path):
            return path
    raise FileNotFoundError(f"none of these is there: {', '.join(paths)}")


def source_path(spark: SparkSession, root: str, run: str, camera: str) -> str:
    return first_existing(spark, *candidates(root, run, camera))


def sidecar_path(spark: SparkSession, root: str, run: str, camera: str) -> str:
    return first_existing(spark, *candidates(root, run, camera, SIDECAR_NAME))


def source_available(spark: SparkSession, root: str, run: str, camera: str) -> bool:
    """Whether a stream is here: what needs it is left out where it isn't, and doesn't fail."""
    return any(files.exists(spark, p) for p in candidates(root, run, camera))


def resolved(roots: DataFrame, listing: DataFrame, name: str = STREAM_NAME) -> DataFrame:
    """(root, run, camera, path, length) of every stream of many recordings, the path null where there is none: one listing, no look at single files.

    roots: (root) of each recording; listing: (path, length) of all files.
    """
    field = lambda value, name: F.lit(value).alias(name)
    tails = [F.struct(field(run, "run"), field(camera, "camera"), field(place, "place"), field(path, "tail")) for run in RUNS for camera in CAMERAS for place, path in enumerate(candidates("", run, camera, name))]
    wanted = roots.select("root", F.explode(F.array(*tails)).alias("s")).select("root", "s.*")
    met = wanted.withColumn("path", F.concat("root", "tail")).join(listing, "path", "left")
    best = F.min(F.when(F.col("length").isNotNull(), F.struct("place", "path", "length")))
    return met.groupBy("root", "run", "camera").agg(best.alias("b")).select("root", "run", "camera", "b.path", "b.length")
