"""Label sets for many routes at once: what is known of a route meets in one group, whose rows its length bounds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores, selection
from .kernels import per_group

#: The kinds of facts of a route and the columns that they fill.
FACTS = ("route", "blocked", "occlusion", "dark", "partner", "kink")


def facts(rows: DataFrame, keys: list[str], kind: str, x: str | Column, y: str | Column | None = None, flag: str | Column | None = None) -> DataFrame:
    """(keys, kind, x, y, flag): facts of one kind; route (start, end), blocked (frame), occlusion and dark (first, last), partner (a, b), kink (frame, increment, dark)."""
    column = lambda c, of: F.lit(None).cast(of) if c is None else (F.col(c) if isinstance(c, str) else c).cast(of)
    return rows.select(*keys, F.lit(kind).alias("kind"), column(x, "bigint").alias("x"), column(y, "bigint").alias("y"), column(flag, "boolean").alias("flag"))


def route_of(pdf: pd.DataFrame) -> selection.Route | None:
    """The route that a group's facts describe; without its bounds there is none."""
    ordered = pdf.sort_values(["kind", "x", "y"])
    of = lambda kind: ordered[ordered["kind"] == kind]
    bounds = of("route")
    if bounds.empty:
        return None
    pairs = lambda kind: [(int(a), int(b)) for a, b in zip(of(kind)["x"], of(kind)["y"], strict=True)]
    return selection.Route(int(bounds["x"].iloc[0]), int(bounds["y"].iloc[0]), [int(x) for x in of("blocked")["x"]], pairs("occlusion"), pairs("dark"), pairs("partner"), [(int(r.x), int(r.y), bool(r.flag)) for r in of("kink").itertuples()])


def label_sets(found: DataFrame, keys: list[str], key_schema: str, wanted: dict[str, int], seed: int | None = None) -> DataFrame:
    """(keys, number, runA_frame, stratum, low, high, source, planned, placed): the chosen frames by frame, and a row without one for each stratum that fell short.

    The seed is the same for every group, as their routes differ.
    """

    def kernel(pdf: pd.DataFrame) -> dict:
        route = route_of(pdf)
        chosen, short = selection.label_set(route, wanted, seed) if route else ([], [])
        rows = [(i, *c, None, None) for i, c in enumerate(chosen)] + [(None, None, stratum, None, None, None, planned, placed) for stratum, planned, placed in short]
        names = ("number", "runA_frame", "stratum", "low", "high", "source", "planned", "placed")
        made = pd.DataFrame(rows, columns=names)
        return {n: made[n] if n == "stratum" else made[n].astype("Int64") for n in names}

    return per_group(found, keys, f"{key_schema}, number long, runA_frame long, stratum string, low long, high long, source long, planned long, placed long", kernel)


def assembled(chosen: DataFrame, routes: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """The chosen frames as queries: (keys, query_id, runA_frame, stratum, linear_prior), with how many of its stratum the group has.

    routes: (keys, a_start, a_end, b_start, b_end), the ends included.
    """
    picked = chosen.filter(F.col("runA_frame").isNotNull())
    counts = picked.groupBy(*keys, "stratum").agg(F.count(F.lit(1)).alias("of_stratum"))
    prior = scores.linear_prior(F.col("runA_frame"), F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))
    name = F.concat_ws("_", *[F.col(k).cast("string") for k in keys], F.lit(tag), F.lpad(F.col("number").cast("string"), 2, "0"))
    return picked.join(routes, keys).join(counts, [*keys, "stratum"]).select(*keys, name.alias("query_id"), "runA_frame", "stratum", prior.alias("linear_prior"), "of_stratum")
