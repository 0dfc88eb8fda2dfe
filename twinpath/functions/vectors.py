"""Array functions for vectors: folds in index order over doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column, floor: float = 1e-8) -> Column:
    length = F.greatest(norm(v), F.lit(floor))
    return F.transform(doubles(v), lambda x: x / length)


def mean(v: Column) -> Column:
    return F.try_divide(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x), F.size(v).cast("double"))


def ncc(a: Column, b: Column) -> Column:
    """Zero-mean normalised cross-correlation; 0 for constant vectors."""
    ma, mb = mean(a), mean(b)
    ca, cb = F.transform(doubles(a), lambda x: x - ma), F.transform(doubles(b), lambda x: x - mb)
    scale = norm(ca) * norm(cb)
    return F.when(scale > 1e-12, dot(ca, cb) / scale).otherwise(F.lit(0.0))


def remove_static(frame: Column, reference: Column, mode: str) -> Column:
    """frame / (reference + 1) for mode mean, frame - reference for mode median, the frame itself for none."""
    if mode == "none":
        return doubles(frame)
    if mode == "mean":
        return F.zip_with(doubles(frame), doubles(reference), lambda x, r: x / (r + 1.0))
    if mode == "median":
        return F.zip_with(doubles(frame), doubles(reference), lambda x, r: x - r)
    raise ValueError(f"no mode {mode}")
