"""Vectors of two runs, blocked by place: pairs, ranks and evidence."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot


def pairs(a: DataFrame, b: DataFrame, keys: list[str], vector: str = "v", order: str = "ordinal") -> DataFrame:
    """(keys, a, b, s): cosine of the unit vectors of each pair within a block, rounded to 6 places.

    The block is the bound of the square; there is no pair across blocks.
    """
    left = a.select(*keys, F.col(order).alias("a"), F.col(vector).alias("_va"))
    right = b.select(*keys, F.col(order).alias("b"), F.col(vector).alias("_vb"))
    return left.join(right, keys).select(*keys, "a", "b", F.round(dot(F.col("_va"), F.col("_vb")), 6).alias("s"))


def blocks(a: DataFrame, b: DataFrame, keys: list[str], schema: str, kernel: Callable[[np.ndarray, np.ndarray, np.ndarray], dict], vector: str = "v", order: str = "ordinal") -> DataFrame:
    """What a kernel makes of each block's similarities: it gets the ordinals of both sides and their matrix, rounded to 6 places.

    A block is one matrix product in one task; pairs are never rows, only what
    the kernel keeps of them.
    """
    side = lambda df, n: df.select(*keys, F.lit(n).alias("_side"), F.col(order).alias("_order"), F.col(vector).cast("array<double>").alias("_v"))

    def run(pdf: pd.DataFrame) -> dict:
        parts = [pdf[pdf["_side"] == n].sort_values("_order") for n in (0, 1)]
        orders = [p["_order"].to_numpy() for p in parts]
        if not all(map(len, orders)):
            return {}
        x, y = (np.stack(p["_v"].to_numpy()).astype(float) for p in parts)
        return kernel(*orders, np.round(x @ y.T, 6))

    names = [f.split()[0] for f in schema.split(", ")][len(keys) :]

    def made(pdf: pd.DataFrame) -> pd.DataFrame:
        found = pd.DataFrame(run(pdf) or {n: [] for n in names})[names]
        for i, key in enumerate(keys):
            found.insert(i, key, pdf[key].iloc[0])
        return found

    return side(a, 0).unionByName(side(b, 1)).groupBy(*keys).applyInPandas(made, schema)


def ranks_of(s: np.ndarray) -> np.ndarray:
    """The rank of each place in its row, from 1; of equals the first is better."""
    order = np.argsort(-s, axis=1, kind="stable")
    ranks = np.empty_like(order)
    np.put_along_axis(ranks, order, np.arange(1, s.shape[1] + 1)[None, :].repeat(len(s), axis=0), axis=1)
    return ranks


def top_k(a: DataFrame, b: DataFrame, keys: list[str], key_schema: str, k: int) -> DataFrame:
    """(keys, a, b, s, rank): the k most similar of b for each of a, the smaller ordinal first among equals."""

    def kernel(oa: np.ndarray, ob: np.ndarray, s: np.ndarray) -> dict:
        ranks = ranks_of(s)
        i, j = np.nonzero(ranks <= k)
        return {"a": oa[i], "b": ob[j], "s": s[i, j], "rank": ranks[i, j]}

    return blocks(a, b, keys, f"{key_schema}, a long, b long, s double, rank long", kernel)


def mutual(a: DataFrame, keys: list[str], key_schema: str, k: int, separation: int, least: float) -> DataFrame:
    """(keys, a, b, s, rank_a, rank_b): pairs of one run at least `separation` apart that are among each other's k best, with at least such a score."""

    def kernel(oa: np.ndarray, ob: np.ndarray, s: np.ndarray) -> dict:
        far = (np.abs(oa[:, None] - ob[None, :]) >= separation) & (s >= least)
        scores = np.where(far, s, -np.inf)
        by_row, by_column = ranks_of(scores), ranks_of(scores.T).T
        i, j = np.nonzero(far & (by_row <= k) & (by_column <= k) & (oa[:, None] < ob[None, :]))
        return {"a": oa[i], "b": ob[j], "s": s[i, j], "rank_a": by_row[i, j], "rank_b": by_column[i, j]}

    return blocks(a, a, keys, f"{key_schema}, a long, b long, s double, rank_a long, rank_b long", kernel)


def alike(a: DataFrame, keys: list[str], key_schema: str, separation: int, least: float) -> DataFrame:
    """(keys, a, b, s): pairs of one run, the later one at least `separation` behind, with at least such a score."""

    def kernel(oa: np.ndarray, ob: np.ndarray, s: np.ndarray) -> dict:
        i, j = np.nonzero((ob[None, :] - oa[:, None] >= separation) & (s >= least))
        return {"a": oa[i], "b": ob[j], "s": s[i, j]}

    return blocks(a, a, keys, f"{key_schema}, a long, b long, s double", kernel)


def aliasing(a: DataFrame, keys: list[str], key_schema: str, apart: int, thresholds: dict[str, float]) -> DataFrame:
    """(keys, pairs, …): pairs of one run more than `apart` apart, and how many are above each threshold."""

    def kernel(oa: np.ndarray, ob: np.ndarray, s: np.ndarray) -> dict:
        far = s[ob[None, :] - oa[:, None] > apart]
        return {"pairs": [len(far)], **{name: [int((far > t).sum())] for name, t in thresholds.items()}}

    return blocks(a, a, keys, f"{key_schema}, pairs long, {', '.join(f'{n} long' for n in thresholds)}", kernel)


def distant_ranks(a: DataFrame, keys: list[str], key_schema: str, offsets: tuple[int, ...], separation: int) -> DataFrame:
    """(keys, a, b, rank) of the frames so far behind each: 1 and the distant frames that are more similar."""

    def kernel(oa: np.ndarray, ob: np.ndarray, s: np.ndarray) -> dict:
        gap = ob[None, :] - oa[:, None]
        i, j = np.nonzero(np.isin(gap, offsets) & (np.abs(gap) >= separation))
        better = (np.where(np.abs(gap) >= separation, s, -np.inf)[i] > s[i, j][:, None]).sum(axis=1)
        return {"a": oa[i], "b": ob[j], "rank": better + 1}

    return blocks(a, a, keys, f"{key_schema}, a long, b long, rank long", kernel)


def robust_z(scored: DataFrame, keys: list[str], row: str = "a", score: str = "s", floor: float = 1e-4, clip: float = 8.0) -> DataFrame:
    """(…, z): (s - median) / max(1.4826 MAD, floor) within each row, clipped."""
    w = Window.partitionBy(*keys, row)
    centred = scored.withColumn("_m", F.percentile(score, F.lit(0.5)).over(w)).withColumn("_d", F.abs(F.col(score) - F.col("_m")))
    spread = F.greatest(1.4826 * F.percentile("_d", F.lit(0.5)).over(w), F.lit(floor))
    return centred.withColumn("_w", spread).withColumn("z", F.greatest(F.least((F.col(score) - F.col("_m")) / F.col("_w"), F.lit(clip)), F.lit(-clip))).drop("_m", "_d", "_w")


def same_place(a: DataFrame, b: DataFrame, keys: list[str], key_schema: str, k: int, least: float) -> DataFrame:
    """(keys, a, b, weight): each row's k best above a score, their weights summing to 1."""

    def kernel(oa: np.ndarray, ob: np.ndarray, s: np.ndarray) -> dict:
        kept = np.where((s > least) & (ranks_of(np.where(s > least, s, -np.inf)) <= k), s, 0.0)
        i, j = np.nonzero(kept)
        return {"a": oa[i], "b": ob[j], "weight": np.round(kept[i, j] / kept.sum(axis=1)[i], 6)}

    return blocks(a, b, keys, f"{key_schema}, a long, b long, weight double", kernel)


def spearman(df: DataFrame, keys: list[str], x: str, y: str, tie: str) -> DataFrame:
    """(keys, n, rho): correlation of ranks, ties in the order of `tie`; null without variance."""
    rank = lambda c: F.row_number().over(Window.partitionBy(*keys).orderBy(c, tie)).cast("double")
    return df.withColumn("_x", rank(x)).withColumn("_y", rank(y)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("_x", "_y"), 6).alias("rho"))


def likelihood_table(joint: DataFrame, keys: list[str], a: str, b: str, exponent: float = 0.5, low: float = 0.25, high: float = 4.0) -> DataFrame:
    """(keys, a, b, n, ratio): how much likelier two bins meet than by chance, tempered and clipped."""
    counted = joint.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("n"))
    by = lambda *c: F.sum("n").over(Window.partitionBy(*keys, *c))
    chance = counted.withColumn("_ratio", F.col("n").cast("double") * by() / (by(a) * by(b)))
    return chance.select(*keys, a, b, "n", F.round(F.greatest(F.least(F.pow("_ratio", F.lit(exponent)), F.lit(high)), F.lit(low)), 6).alias("ratio"))
