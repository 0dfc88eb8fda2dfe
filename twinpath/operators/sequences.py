"""Runs, gaps, first differences and windows over ordered sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(keys: list[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def islands(df: DataFrame, keys: list[str], order: str, least: int = 1, peak: str | None = None) -> DataFrame:
    """(keys, start, end, length[, peak]) of each run of consecutive values of `order`, of at least so many rows."""
    numbered = df.withColumn("_island", F.col(order) - F.row_number().over(ordered(keys, order)))
    more = [F.max(peak).alias("peak")] if peak else []
    return numbered.groupBy(*keys, "_island").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count(F.lit(1)).alias("length"), *more).filter(F.col("length") >= least).drop("_island")


def flagged_runs(df: DataFrame, keys: list[str], order: str, flag: Column, value: str) -> DataFrame:
    """(keys, start, end, length, peak) of each run of flagged rows among the rows that there are, whatever gaps `order` has."""
    w = ordered(keys, order)
    placed = df.withColumn("_flag", flag).withColumn("_place", F.row_number().over(w))
    runs = placed.filter("_flag").withColumn("_run", F.col("_place") - F.row_number().over(w))
    return runs.groupBy(*keys, "_run").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count(F.lit(1)).alias("length"), F.max(value).alias("peak")).drop("_run")


def steps(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, previous, order, previous_value, value, increment) where a row and the one right before it both have a value."""
    w = ordered(keys, order)
    looked = df.withColumn("previous", F.lag(order).over(w)).withColumn("previous_value", F.lag(value).over(w))
    adjacent = looked.filter((F.col(order) - F.col("previous") == 1) & F.col(value).isNotNull() & F.col("previous_value").isNotNull())
    return adjacent.withColumn("increment", F.col(value) - F.col("previous_value"))


def edge_padded(df: DataFrame, keys: list[str], order: str, value: str, half: int) -> DataFrame:
    """The rows with `half` copies of the first before them and of the last behind them, in the column `_pad` (null: the row itself)."""
    up, down = ordered(keys, order), Window.partitionBy(*keys).orderBy(F.col(order).desc())
    ends = df.withColumn("_first", F.row_number().over(up) == 1).withColumn("_last", F.row_number().over(down) == 1)
    none = F.array().cast("array<int>")
    before = F.when(F.col("_first"), F.sequence(F.lit(-half), F.lit(-1))).otherwise(none)
    behind = F.when(F.col("_last"), F.sequence(F.lit(1), F.lit(half))).otherwise(none)
    return ends.withColumn("_pad", F.explode(F.concat(before, F.array(F.lit(0)), behind))).drop("_first", "_last")


def running_median(df: DataFrame, keys: list[str], order: str, value: str, width: int, name: str = "median") -> DataFrame:
    """A centred median over `width` rows, the edges repeated."""
    half = width // 2
    w = Window.partitionBy(*keys).orderBy(order, "_pad").rowsBetween(-half, half)
    return edge_padded(df, keys, order, value, half).withColumn(name, F.percentile(value, F.lit(0.5)).over(w)).filter("_pad = 0").drop("_pad")


def moving_average(df: DataFrame, keys: list[str], order: str, value: str, width: int, name: str = "average") -> DataFrame:
    """A centred sum over `width` rows divided by width: beyond the edges lie zeros."""
    half = width // 2
    return df.withColumn(name, F.sum(value).over(ordered(keys, order).rowsBetween(-half, half)) / F.lit(float(width)))


def merged_events(df: DataFrame, keys: list[str], order: str, gap: int) -> DataFrame:
    """(keys, event, members): rows no more than `gap` apart are one event, at the middle rounded half to even."""
    w = ordered(keys, order)
    new = F.coalesce((F.col(order) - F.lag(order).over(w) > gap).cast("int"), F.lit(1))
    numbered = df.withColumn("_new", new).withColumn("_event", F.sum("_new").over(w))
    return numbered.groupBy(*keys, "_event").agg(F.rint((F.min(order) + F.max(order)) / 2).cast("bigint").alias("event"), F.count(F.lit(1)).alias("members")).drop("_event")


def outliers(df: DataFrame, keys: list[str], value: str, deviations: float) -> DataFrame:
    """Rows more than so many population deviations from the mean of their sequence."""
    w = Window.partitionBy(*keys)
    centred = df.withColumn("_mean", F.avg(value).over(w)).withColumn("_deviation", F.stddev_pop(value).over(w))
    return centred.filter((F.col("_deviation") > 0) & (F.abs(F.col(value) - F.col("_mean")) > deviations * F.col("_deviation"))).drop("_mean", "_deviation")


def sustained_onset(df: DataFrame, keys: list[str], order: str, active: Column, needed: int, window: int, start: int = 0) -> DataFrame:
    """(keys, onset): the first row from `start` on with `needed` active rows among the next `window`, itself included; the window must be full."""
    w = ordered(keys, order).rowsBetween(0, window - 1)
    counted = df.withColumn("_active", F.sum(active.cast("int")).over(w)).withColumn("_rows", F.count(F.lit(1)).over(w))
    good = (F.col("_active") >= needed) & (F.col("_rows") == window) & (F.col(order) >= start)
    return counted.groupBy(*keys).agg(F.min(F.when(good, F.col(order))).alias("onset"))


def still_tail(df: DataFrame, keys: list[str], order: str, value: str, share: float) -> DataFrame:
    """(keys, onset): where the tail begins in which no value reaches `share` of the sequence's median."""
    median = df.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("_median"))
    joined = df.join(median, keys)
    return joined.groupBy(*keys).agg((F.coalesce(F.max(F.when(F.col(value) >= share * F.col("_median"), F.col(order))), F.lit(-1)) + 1).alias("onset"))


def interpolated(df: DataFrame, keys: list[str], order: str, value: str, name: str = "filled") -> DataFrame:
    """Nulls between two values on the line between them; behind the last value that value, before the first null."""
    w = ordered(keys, order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.col(order))
    looked = df.withColumn("_v0", F.last(value, True).over(back)).withColumn("_o0", F.last(known, True).over(back)).withColumn("_v1", F.first(value, True).over(ahead)).withColumn("_o1", F.first(known, True).over(ahead))
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * ((F.col(order) - F.col("_o0")).cast("double") / (F.col("_o1") - F.col("_o0")))
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_v1").isNull(), F.col("_v0")).when(F.col("_v0").isNotNull(), line)
    return looked.withColumn(name, filled).drop("_v0", "_o0", "_v1", "_o1")


def running_max(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """Non-decreasing values: the largest so far, where there is a value."""
    return df.withColumn(name, F.when(F.col(value).isNotNull(), F.max(value).over(ordered(keys, order))))


def cumulative(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """The sum of the values before and at a row."""
    return df.withColumn(name, F.sum(value).over(ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def bridged(df: DataFrame, keys: list[str], order: str, value: str, candidate: str, most: int, blocked: Column) -> DataFrame:
    """Runs of up to `most` rows without a value between two values take their candidates, if all lie between the two and the run's first row isn't blocked.

    Adds `bridged`; the blocking status is read on the first row of the run only.
    """
    w = ordered(keys, order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    looked = df.withColumn("_low", F.last(value, True).over(back)).withColumn("_high", F.first(value, True).over(ahead)).withColumn("_gap", F.sum(F.col(value).isNotNull().cast("int")).over(w)).withColumn("_empty", F.col(value).isNull()).withColumn("_blocked", blocked)
    run = Window.partitionBy(*keys, "_gap", "_empty")
    first = run.orderBy(order)
    fits = F.col("_low").isNotNull() & F.col("_high").isNotNull() & F.coalesce(F.col(candidate).between(F.col("_low"), F.col("_high")), F.lit(False))
    judged = looked.withColumn("_size", F.count(F.lit(1)).over(run)).withColumn("_fit", F.min(fits.cast("int")).over(run)).withColumn("_stop", F.first("_blocked").over(first))
    takes = F.col("_empty") & (F.col("_size") <= most) & (F.col("_fit") == 1) & ~F.coalesce(F.col("_stop"), F.lit(False))
    made = judged.withColumn("bridged", takes).withColumn(value, F.when(F.col("bridged"), F.col(candidate)).otherwise(F.col(value)))
    return made.drop("_low", "_high", "_gap", "_empty", "_blocked", "_size", "_fit", "_stop")


def densified(nodes: DataFrame, keys: list[str], row: str, column: str) -> DataFrame:
    """(keys, row, estimate) for every row from the first node to the last, on the lines between nodes, rounded half to even."""
    w = ordered(keys, row)
    segments = nodes.select(*keys, F.col(row).alias("_r0"), F.col(column).alias("_c0"), F.lead(row).over(w).alias("_r1"), F.lead(column).over(w).alias("_c1"))
    last = F.col("_r1").isNull()
    rows = segments.withColumn(row, F.explode(F.when(last, F.array("_r0")).otherwise(F.sequence("_r0", F.col("_r1") - 1))))
    line = F.col("_c0") + (F.col("_c1") - F.col("_c0")) * ((F.col(row) - F.col("_r0")).cast("double") / (F.col("_r1") - F.col("_r0")))
    return rows.select(*keys, row, F.rint(F.when(F.col("_r1").isNull(), F.col("_c0")).otherwise(line)).cast("bigint").alias("estimate"))


def range_text(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, ranges): the distinct values as 'a' and 'a-b', comma-joined."""
    runs = islands(df.select(*keys, order).distinct(), keys, order)
    text = F.when(F.col("start") == F.col("end"), F.col("start").cast("string")).otherwise(F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string")))
    return runs.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("start"), text.alias("text")))), lambda s: s["text"]), ",").alias("ranges"))


def completed(df: DataFrame, lengths: DataFrame, keys: list[str], order: str, length: str) -> DataFrame:
    """Every ordinal from 0 to length - 1 of each sequence, with the columns of df where it has the row."""
    spine = lengths.filter(F.col(length) > 0).select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(length) - 1)).alias(order))
    return spine.join(df, [*keys, order], "left")


def otsu(df: DataFrame, keys: list[str], value: str, bins: int = 256) -> DataFrame:
    """(keys, threshold_bin, threshold): the bin edge with the largest variance between the two classes; the first of equals."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    place = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))).otherwise(F.lit(0)).cast("bigint")
    counted = df.join(ends, keys).withColumn("bin", place).groupBy(*keys, "_lo", "_hi", "bin").agg(F.count(F.lit(1)).alias("_n"))
    w = ordered(keys, "bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    sums = counted.withColumn("_w0", F.sum("_n").over(w)).withColumn("_s0", F.sum(F.col("_n") * F.col("bin")).over(w)).withColumn("_w", F.sum("_n").over(whole)).withColumn("_s", F.sum(F.col("_n") * F.col("bin")).over(whole))
    w1 = F.col("_w") - F.col("_w0")
    gap = F.try_divide(F.col("_s0").cast("double"), F.col("_w0").cast("double")) - F.try_divide((F.col("_s") - F.col("_s0")).cast("double"), w1.cast("double"))
    between = F.coalesce(F.round(F.col("_w0").cast("double") * w1 * gap * gap, 3), F.lit(0.0))
    best = sums.withColumn("_between", between).groupBy(*keys, "_lo", "_hi").agg(F.max_by("bin", F.struct("_between", -F.col("bin"))).alias("threshold_bin"))
    return best.select(*keys, "threshold_bin", (F.col("_lo") + (F.col("threshold_bin") + 1) * (F.col("_hi") - F.col("_lo")) / bins).alias("threshold"))
