"""Versioned Parquet tables: a version that was never written is refused, one that was is read again instead of computed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import normalised
from . import files


def place(root: str, name: str, version: str) -> str:
    return f"{root}/{name}/version={version}"


def available(spark: SparkSession, root: str, name: str, version: str) -> bool:
    """Whether a version was written to its end."""
    return files.exists(spark, f"{place(root, name, version)}/_SUCCESS")


def stored(df: DataFrame, root: str, name: str, version: str, force: bool = False) -> DataFrame:
    """The table of a version, which names all that its content depends on: written the first time, read ever after."""
    spark = df.sparkSession
    if force or not available(spark, root, name, version):
        df.write.mode("overwrite").parquet(place(root, name, version))
    return spark.read.parquet(place(root, name, version))


def load(spark: SparkSession, root: str, name: str, version: str, optional: dict[str, str] | None = None) -> DataFrame:
    """The table of a version; optional columns (name: type) that it lacks are null."""
    if not available(spark, root, name, version):
        raise FileNotFoundError(f"{name} was never written as version {version} below {root}")
    found = spark.read.parquet(place(root, name, version))
    for column, kind in (optional or {}).items():
        if column not in found.columns:
            found = found.withColumn(column, F.lit(None).cast(kind))
    return found


def vectors(spark: SparkSession, root: str, name: str, version: str, column: str = "v") -> DataFrame:
    """A table of vectors, of unit length again."""
    return load(spark, root, name, version).withColumn(column, normalised(F.col(column)))
