"""Scalar functions that make or read text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(value: Column) -> Column:
    """Trimmed text; empty text is null, as in CSV tables."""
    return F.nullif(F.trim(value), F.lit(""))


def optional_int(value: Column) -> Column:
    return blank_to_null(value).try_cast("bigint")


def optional_double(value: Column) -> Column:
    return blank_to_null(value).try_cast("double")


def int_or(value: Column, default: int = 999) -> Column:
    """A sort key: the number that a text holds, else the default."""
    return F.coalesce(optional_int(value), F.lit(default).cast("bigint"))


def percent(value: Column, places: int = 1) -> Column:
    return F.concat(F.format_number(value * 100, places), F.lit("%"))


def thousands(value: Column) -> Column:
    return F.format_number(value, 0)


def signed(value: Column, places: int = 1) -> Column:
    return F.format_string(f"%+.{places}f", value.cast("double"))


def listed(values: Column) -> Column:
    """'a', 'a and b', 'a, b and c'."""
    n = F.size(values)
    head = F.array_join(F.slice(values, F.lit(1), F.greatest(n - 1, F.lit(1))), ", ")
    return F.when(n == 0, "").when(n == 1, head).otherwise(F.concat(head, F.lit(" and "), F.element_at(values, -1)))


def raster(width: Column, height: Column) -> Column:
    return F.concat(width.cast("string"), F.lit("×"), height.cast("string"))


def parts(*values: Column, separator: str = "+") -> Column:
    """The non-empty values joined."""
    return F.concat_ws(separator, *[F.nullif(v, F.lit("")) for v in values])


def histogram_text(counts: Column) -> Column:
    """A map as 'k=v;k=v', by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), ";")


def digest(*values: Column, characters: int = 12) -> Column:
    """The first hex digits of the SHA-256 of values joined by line ends, nulls as empty text."""
    return F.substring(F.sha2(F.concat_ws("\n", *[F.coalesce(v.cast("string"), F.lit("")) for v in values]), 256), 1, characters)


def cache_key(run: Column, camera: Column, width: Column, height: Column, source_digest: Column, colour: str) -> Column:
    """The name of what is made from a source: it changes with the source, the raster and the colours."""
    return F.concat_ws("_", run, camera, F.substring(source_digest, 1, 12), F.concat(width.cast("string"), F.lit("x"), height.cast("string")), F.lit(colour))


def mapping_suffix(motion: Column, loops: Column, speed: Column, variant: Column, usual: str) -> Column:
    """What names a variant of the posterior: the channels that it lacks, those that it adds, an unusual way to motion."""
    part = lambda condition, text: F.when(condition, text).otherwise("")
    return F.concat(part(~motion, "_no_motion"), part(~loops, "_no_loop"), part(speed, "_speed"), F.when(motion & (variant != usual), F.concat(F.lit("_motion-"), variant)).otherwise(""))


def mode_suffix(mode: Column, usual: str) -> Column:
    """The usual mode has plain names."""
    return F.when(mode == usual, "").otherwise(F.concat(F.lit("_"), mode))
