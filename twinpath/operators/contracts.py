"""Contracts: rules are queries for violations, and frozen artifacts are hashes that must not drift."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violations(df: DataFrame, key: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """(key, rule) of each rule that a row breaks: one scan for all rules."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(condition, F.lit(False)), F.lit(name)) for name, condition in rules]))
    return df.select(F.col(key), F.explode(broken).alias("rule"))


def mapping_contract(mapping: DataFrame, keys: list[str], order: str, value: str, status: str) -> DataFrame:
    """(keys, rows, duplicate_keys, key_gaps, blank_status, decreasing): all but rows must be 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    back = w.rowsBetween(Window.unboundedPreceding, -1)
    looked = mapping.withColumn("_place", F.row_number().over(w) - 1).withColumn("_before", F.lag(order).over(w)).withColumn("_last", F.last(value, True).over(back))
    n = lambda c: F.count(F.when(c, 1))
    return looked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        n(F.col("_before") == F.col(order)).alias("duplicate_keys"),
        n(F.col("_place") != F.col(order)).alias("key_gaps"),
        n(F.coalesce(F.trim(status), F.lit("")) == "").alias("blank_status"),
        n(F.col(value) < F.col("_last")).alias("decreasing"),
    )


def drift(frozen: DataFrame, live: DataFrame, key: str, value: str) -> DataFrame:
    """(key, frozen, live) of every parameter that isn't the same on both sides, missing ones included."""
    joined = frozen.select(F.col(key), F.col(value).alias("frozen"), F.lit(True).alias("_f")).join(live.select(F.col(key), F.col(value).alias("live"), F.lit(True).alias("_l")), key, "full")
    return joined.filter(~(F.col("_f").eqNullSafe(F.col("_l")) & F.col("frozen").eqNullSafe(F.col("live")))).select(key, "frozen", "live")


def sealed(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """(keys, rows, seal): SHA-256 of each group's rows in order; the hashes of the rows are hashed, so a group holds 64 characters a row."""
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    hashed = df.select(*keys, F.struct(F.col(order).alias("o"), row.alias("h")).alias("r"))
    return hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["h"]), ""), 256).alias("seal"))


def gates(results: DataFrame, waivers: DataFrame, keys: list[str]) -> DataFrame:
    """Adds verdict and reason: pass, waived, or FAIL; a waiver never alters a pass."""
    joined = results.join(waivers.withColumnRenamed("reason", "_reason"), keys, "left")
    verdict = F.when(F.col("passed"), "pass").when(F.col("_reason").isNotNull(), "waived").otherwise("FAIL")
    return joined.withColumn("verdict", verdict).withColumn("reason", F.when(verdict == "waived", F.col("_reason"))).drop("_reason")


def in_order(*stages: Column) -> Column:
    """Whether stages follow each other; null if one is missing."""
    return reduce(lambda x, y: x & y, [a <= b for a, b in zip(stages, stages[1:], strict=False)])
