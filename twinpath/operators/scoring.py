"""Cases of labels and methods, and the measures over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores


def cases(labels: DataFrame, methods: DataFrame, keys: list[str], gates: list[tuple[str, DataFrame, str]] = ()) -> DataFrame:
    """One row for each label and method: accepted, distances, and the gate that refused.

    methods: (method, keys, predicted). gates: (name, keys of refused rows, the
    column that they refuse by: a key of the label, or `predicted`), in order.
    """
    joined = labels.join(methods, keys)
    gated = F.lit(None).cast("string")
    for name, refused, _ in reversed(gates):
        joined = joined.join(refused.withColumn(f"_{name}", F.lit(True)), [c for c in refused.columns], "left")
    for name, _, _ in reversed(gates):
        gated = F.when(F.col(f"_{name}"), name).otherwise(gated)
    made = joined.withColumn("gated_by", gated).withColumn("accepted", F.col("predicted").isNotNull() & F.col("gated_by").isNull())
    match = F.col("accepted") & (F.col("label") == "match")
    low, high, p = F.col("low"), F.col("high"), F.col("predicted")
    made = made.withColumn("interval_distance", F.when(match, scores.interval_distance(p, low, high))).withColumn("signed_distance", F.when(match, scores.signed_interval_distance(p, low, high))).withColumn("preferred_error", F.when(match, F.abs(p - F.col("preferred"))))
    return made.drop(*[f"_{name}" for name, _, _ in gates])


def measures() -> list[Column]:
    """The aggregates that any slice of cases is scored by; undetermined labels leave the denominators."""
    asked = F.col("label") != "undetermined"
    accepted = F.col("accepted") & asked
    correct = F.col("interval_distance") == 0
    n, k = F.count(F.when(accepted, 1)), F.count(F.when(correct, 1))
    return [
        F.count(F.lit(1)).alias("labels"),
        F.count(F.when(asked, 1)).alias("determinable"),
        n.alias("accepted"),
        k.alias("correct"),
        F.count(F.when(accepted & (F.col("label") == "no_correspondence"), 1)).alias("false_accepts"),
        F.round(scores.ratio(k, n), 4).alias("precision"),
        F.round(scores.ratio(n, F.count(F.when(asked, 1))), 4).alias("coverage"),
        scores.wilson(k, n, False).alias("wilson_low"),
        scores.wilson(k, n, True).alias("wilson_high"),
        F.count(F.when(F.col("interval_distance") <= 2, 1)).alias("within_2"),
        F.percentile("interval_distance", F.lit(0.5)).alias("median_distance"),
        F.max("interval_distance").alias("largest_distance"),
    ]


def grouping_sets(rows: DataFrame, method: str, camera: str, stratum: str) -> DataFrame:
    """Measures by method alone, with camera, with stratum, and with both: one aggregation over the expanded rows."""
    cube = rows.groupingSets([[F.col(method), F.col(camera)], [F.col(method), F.col(camera), F.col(stratum)], [F.col(method)], [F.col(method), F.col(stratum)]], F.col(method), F.col(camera), F.col(stratum))
    return cube.agg(F.grouping_id().cast("bigint").alias("level"), *measures())


def tolerance_curve(rows: DataFrame, keys: list[str], tolerances: tuple[int, ...] = (0, 1, 2, 5, 10)) -> DataFrame:
    """(keys, tolerance, n, hits, fraction, bounds): cumulative hits of accepted match labels."""
    spread = rows.filter("interval_distance IS NOT NULL").withColumn("tolerance", F.explode(F.array(*[F.lit(t).cast("bigint") for t in tolerances])))
    n, k = F.count(F.lit(1)), F.count(F.when(F.col("interval_distance") <= F.col("tolerance"), 1))
    return spread.groupBy(*keys, "tolerance").agg(n.alias("n"), k.alias("hits"), F.round(scores.ratio(k, n), 4).alias("fraction"), scores.wilson(k, n, False).alias("low"), scores.wilson(k, n, True).alias("high"))


def shift_sweep(rows: DataFrame, keys: list[str], shifts: range) -> DataFrame:
    """(keys, shift, n, correct, precision): predictions of accepted match labels moved by constants."""
    spread = rows.filter("interval_distance IS NOT NULL").withColumn("shift", F.explode(F.sequence(F.lit(shifts.start).cast("bigint"), F.lit(shifts.stop - 1).cast("bigint"))))
    moved = scores.interval_distance(F.col("predicted") + F.col("shift"), F.col("low"), F.col("high"))
    n, k = F.count(F.lit(1)), F.count(F.when(moved == 0, 1))
    return spread.groupBy(*keys, "shift").agg(n.alias("n"), k.alias("correct"), F.round(scores.ratio(k, n), 4).alias("precision"))


def peak_shift(sweep: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, peak, precision): the shift with most correct, the smallest in size of equals, then the smaller."""
    order = F.struct(F.col("correct"), -F.abs(F.col("shift")), -F.col("shift"))
    return sweep.groupBy(*keys).agg(F.max_by("shift", order).alias("peak"), F.max("precision").alias("precision"))


def risk_coverage(rows: DataFrame, keys: list[str], margin: str, right: Column, places: int | None = None) -> DataFrame:
    """(keys, threshold, accepted, wrong, risk, coverage) at each distinct margin, accepting from the largest down, and one row that rejects all.

    A key's curve is one task's work and has as many rows as there are distinct
    margins; `places` rounds these down to so many decimals, which bounds them.
    """
    cut = F.col(margin) if places is None else F.floor(F.col(margin) * 10**places) / 10**places
    counted = rows.groupBy(*keys, cut.alias("threshold")).agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(~right, 1)).alias("_wrong"))
    w = Window.partitionBy(*keys).orderBy(F.col("threshold").desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = counted.select(*keys, "threshold", "_n", F.sum("_n").over(w).alias("accepted"), F.sum("_wrong").over(w).alias("wrong"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_all"))
    point = F.struct("threshold", "accepted", "wrong", F.round(scores.ratio(F.col("wrong"), F.col("accepted")), 4).alias("risk"), F.round(scores.ratio(F.col("accepted"), F.col("_all")), 4).alias("coverage"))
    none = F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(0).cast("bigint").alias("accepted"), F.lit(0).cast("bigint").alias("wrong"), F.lit(None).cast("double").alias("risk"), F.lit(0.0).alias("coverage"))
    points = F.when(F.col("accepted") == F.col("_n"), F.array(point, none)).otherwise(F.array(point))  # a curve's first point brings the one that rejects all
    return summed.select(*keys, F.explode(points).alias("p")).select(*keys, "p.*")


#: Edges of the reliability bins, each closed below and open above.
RELIABILITY_EDGES = (0.0, 0.4, 0.55, 0.7, 0.8, 0.9, 0.95, 1.01)


def reliability(rows: DataFrame, keys: list[str], stated: str, right: Column) -> DataFrame:
    """(keys, bin_low, bin_high, n, stated, observed) of each bin that has rows."""
    edges = list(zip(RELIABILITY_EDGES, RELIABILITY_EDGES[1:], strict=False))
    bin_low, bin_high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for low, high in edges:
        inside = (F.col(stated) >= low) & (F.col(stated) < high)
        bin_low, bin_high = F.when(inside, low).otherwise(bin_low), F.when(inside, high).otherwise(bin_high)
    placed = rows.withColumn("bin_low", bin_low).withColumn("bin_high", bin_high).filter("bin_low IS NOT NULL")
    return placed.groupBy(*keys, "bin_low", "bin_high").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(stated), 6).alias("stated"), F.round(F.avg(right.cast("double")), 6).alias("observed"))


def calibration_error(bins: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, ece): the mean gap between stated and observed, weighted by rows."""
    gap = F.sum(F.col("n") * F.abs(F.col("stated") - F.col("observed")))
    return bins.groupBy(*keys).agg(F.sum("n").alias("n"), F.round(scores.ratio(gap, F.sum("n")), 5).alias("ece"))


def signed_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, later, earlier, inside, mean, median, least, most, median_outside) of signed distances."""
    s = F.col("signed_distance")
    return rows.filter("signed_distance IS NOT NULL").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(s > 0, 1)).alias("later"), F.count(F.when(s < 0, 1)).alias("earlier"), F.count(F.when(s == 0, 1)).alias("inside"),
        F.round(F.avg(s), 4).alias("mean"), F.percentile(s, F.lit(0.5)).alias("median"), F.min(s).alias("least"), F.max(s).alias("most"), F.percentile(F.when(s != 0, s), F.lit(0.5)).alias("median_outside"),
    )


def offset_gone(summary: DataFrame) -> DataFrame:
    """Whether the median is within one frame and later and earlier errors balance."""
    later, earlier = F.col("later"), F.col("earlier")
    slack = F.greatest(F.lit(2.0), F.rint(0.25 * (later + earlier)))
    return summary.withColumn("gone", (F.abs("median") <= 1) & (F.abs(later - earlier) <= slack))
