"""Scalar functions of scoring, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the normal quantile of a two-sided 95 % interval.
Z95 = 1.959963984540054


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null if there is nothing to divide by."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def wilson(successes: Column, total: Column, upper: bool) -> Column:
    """One bound of the Wilson score interval, rounded to 4 places; null without trials."""
    n, p = total.cast("double"), ratio(successes, total)
    centre = p + Z95 * Z95 / (2 * n)
    margin = Z95 * F.sqrt(p * (1 - p) / n + Z95 * Z95 / (4 * n * n))
    bound = (centre + margin if upper else centre - margin) / (1 + Z95 * Z95 / n)
    return F.when(total > 0, F.round(F.least(F.greatest(bound, F.lit(0.0)), F.lit(1.0)), 4))


def interval_distance(value: Column, low: Column, high: Column) -> Column:
    """0 inside the closed interval, else the gap to its nearer end."""
    return F.when(value.isNotNull(), F.greatest(low - value, value - high, F.lit(0)))


def signed_interval_distance(value: Column, low: Column, high: Column) -> Column:
    """Positive behind the interval, negative before it, 0 inside."""
    return F.when(value > high, value - high).when(value < low, value - low).when(value.isNotNull(), F.lit(0))


def linear_prior(frame: Column, a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """The frame at the same share of the other range, rounded half to even."""
    share = ratio(frame - a_start, a_end - a_start)
    return F.rint(b_start + share * (b_end - b_start)).cast("bigint")


def upper_median(values: Column) -> Column:
    """The element at position n // 2 of the sorted values of an array, from 0."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def sequence_tier(margins: Column) -> Column:
    """strong with all four margins positive, supported with three of which the last is one, else failed."""
    positive = F.size(F.filter(margins, lambda m: m > 0))
    last = F.element_at(margins, -1) > 0
    return F.when(last & (positive >= 4), "strong").when(last & (positive >= 3), "supported").otherwise("failed")


def exposure_flag(mean: Column, p99: Column, mean_floor: float = 12.0, p99_floor: float = 40.0) -> Column:
    """too_dark strictly below either floor, else ok."""
    return F.when((mean < mean_floor) | (p99 < p99_floor), "too_dark").otherwise("ok")


def route_phase(frame: Column, transition: Column, start: Column) -> Column:
    return F.when(frame < transition, "parked").when(frame < start, "transition").otherwise("route")


def evidence_verdict(median: Column, spread: Column, n: Column, errors: float = 4.0) -> Column:
    """shifted if the median lies more than so many standard errors from 0, else consistent; no_data without rows."""
    return F.when((n == 0) | n.isNull(), "no_data").when(F.abs(median) > errors * 1.4826 * spread / F.sqrt(n.cast("double")), "shifted").otherwise("consistent")
