"""Sequential kernels over recordings: one group, bounded by a recording's length, is one call.

Work spreads over recordings; within one the dynamic programs are sequential by
nature. Each group is sorted inside the kernel, so no order of rows is assumed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dynamic, images


def per_group(df: DataFrame, keys: list[str], schema: str, kernel: Callable[[pd.DataFrame], dict]) -> DataFrame:
    """Applies a kernel that gives columns; the keys are put before them. schema: the types of keys and columns."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made = pd.DataFrame(kernel(pdf))
        for i, key in enumerate(keys):
            made.insert(i, key, pdf[key].iloc[0])
        return made

    # a number that is asked for isn't merged at run time: kernels take long over few bytes
    dealt = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    return dealt.groupBy(*keys).applyInPandas(run, schema)


def two_runs(frames: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, run, ordinal, value): what the kernels over two runs need, and no more."""
    return frames.select(*keys, "run", "ordinal", F.col(value).cast("double").alias("value"))


def split(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    ordered = pdf.sort_values("ordinal")
    return tuple(ordered.loc[ordered["run"] == run, "value"].to_numpy(float) for run in ("runA", "runB"))  # type: ignore[return-value]


def smooth_similarity(a: np.ndarray, b: np.ndarray, stride: int) -> np.ndarray:
    """Similarity of strided, smoothed signals, between 0 and 1."""
    soft = [np.convolve(x, np.ones(5) / 5, mode="same")[::stride] for x in (a, b)]
    return np.exp(-np.abs(soft[0][:, None] - soft[1][None, :]) / 20.0)


def dtw(frames: DataFrame, keys: list[str], key_schema: str, value: str, stride: int = 4) -> DataFrame:
    """(keys, position, row, column): the coarse monotone path."""

    def kernel(pdf: pd.DataFrame) -> dict:
        a, b = split(pdf)
        path = dynamic.monotone_path(smooth_similarity(a, b, stride), len(b) / max(len(a), 1)) if len(a) and len(b) else []
        return {"position": np.arange(len(path)), "row": [p[0] * stride for p in path], "column": [p[1] * stride for p in path]}

    return per_group(two_runs(frames, keys, value), keys, f"{key_schema}, position long, row long, column long", kernel)


def refined(frames: DataFrame, keys: list[str], key_schema: str, value: str, rule: str) -> DataFrame:
    """(keys, runA_frame, runB_frame): picks around the linear estimate, by the ratchet or the sloped rule."""

    def kernel(pdf: pd.DataFrame) -> dict:
        a, b = split(pdf)
        frames_a = np.arange(len(a))
        if not len(a) or not len(b):
            return {"runA_frame": frames_a[:0], "runB_frame": frames_a[:0]}
        centres = np.rint(frames_a * (len(b) - 1) / max(len(a) - 1, 1)).astype(np.int64)
        candidates, scores = dynamic.window_scores(a, b, centres)
        picks = dynamic.ratchet(candidates, scores) if rule == "ratchet" else dynamic.sloped(frames_a, candidates, scores)
        return {"runA_frame": frames_a, "runB_frame": picks}

    return per_group(two_runs(frames, keys, value), keys, f"{key_schema}, runA_frame long, runB_frame long", kernel)


def emission_of(a: np.ndarray, b: np.ndarray, stride: int) -> np.ndarray:
    s = smooth_similarity(a, b, stride)
    middle = np.median(s, axis=1, keepdims=True)
    spread = np.maximum(1.4826 * np.median(np.abs(s - middle), axis=1, keepdims=True), 1e-4)
    return np.exp(np.clip((s - middle) / spread, -8, 8))


def posterior(frames: DataFrame, keys: list[str], key_schema: str, value: str, stride: int = 4, least_window: float = 0.30, most_absent: float = 0.05) -> DataFrame:
    """(keys, row, column, window, absent, accepted): the peak of the posterior of each strided row, and the decision."""

    def kernel(pdf: pd.DataFrame) -> dict:
        a, b = split(pdf)
        if not len(a) or not len(b):
            return {"row": [], "column": [], "window": [], "absent": [], "accepted": []}
        emission = emission_of(a, b, stride)
        mapped, gone = dynamic.forward_backward(emission, emission.mean(axis=1))
        peak = mapped.argmax(axis=1)
        window, absent = dynamic.window_mass(mapped, peak), gone.sum(axis=1)
        return {"row": np.arange(len(mapped)) * stride, "column": peak * stride, "window": window, "absent": absent, "accepted": (absent <= most_absent) & (window >= least_window)}

    return per_group(two_runs(frames, keys, value), keys, f"{key_schema}, row long, column long, window double, absent double, accepted boolean", kernel)


def uniqueness(frames: DataFrame, keys: list[str], key_schema: str, value: str, stride: int = 4, separation: int = 12) -> DataFrame:
    """(keys, row, column, margins): how much better the path is than its translated copies, at four scales."""

    def kernel(pdf: pd.DataFrame) -> dict:
        a, b = split(pdf)
        s = smooth_similarity(a, b, stride) if len(a) and len(b) else np.zeros((0, 0))
        path = dynamic.monotone_path(s, len(b) / max(len(a), 1)) if s.size else []
        found = dynamic.margins(s, path, separation=separation) if path else np.zeros((0, 4))
        return {"row": [p[0] * stride for p in path], "column": [p[1] * stride for p in path], "margins": [list(m) for m in found]}

    return per_group(two_runs(frames, keys, value), keys, f"{key_schema}, row long, column long, margins array<double>", kernel)


def partners_of(mapping: DataFrame, keys: list[str]) -> DataFrame:
    """A mapping's partners in the form of `two_runs`, as the run `mapped`."""
    return mapping.filter(F.col("runB_frame").isNotNull()).select(*keys, F.lit("mapped").alias("run"), F.col("runA_frame").alias("ordinal"), F.col("runB_frame").cast("double").alias("value"))


TRIAL = ("width", "low", "orphaned", "unaffected", "abstained_orphaned", "abstained_unaffected", "self_abstained_orphaned", "median_absent_orphaned", "median_absent_unaffected")


def holdout(frames: DataFrame, mapping: DataFrame, keys: list[str], key_schema: str, value: str, widths: tuple[int, ...] = (60, 150, 400), holes: int = 3, edge: int = 250, guard: int = 10, seed: int = 20260902, stride: int = 1, least_window: float = 0.30, most_absent: float = 0.05) -> DataFrame:
    """(keys, width, low, orphaned, unaffected, shares that abstained, medians of absence) of each hole in run B.

    Seeded holes keep `edge` frames from the ends. What a hole orphans, and what
    it can't touch, is told by another method's mapping, `guard` frames from its
    bounds; the model's own opinion is given beside it. Holes that orphan fewer
    than five rows, and widths that don't fit, are left out.
    """
    rows_of = two_runs(frames, keys, value).unionByName(partners_of(mapping, keys))

    def kernel(pdf: pd.DataFrame) -> dict:
        a, b = split(pdf)
        rows: list[tuple] = []
        if len(a) and len(b):
            emission = emission_of(a, b, stride)
            n, columns = emission.shape
            own = dynamic.forward_backward(emission, emission.mean(axis=1))[0].argmax(axis=1)
            other = np.full(n, -1)
            for o, v in pdf.loc[pdf["run"] == "mapped", ["ordinal", "value"]].itertuples(index=False):
                if o % stride == 0 and o // stride < n and 0 <= v // stride < columns:
                    other[int(o // stride)] = int(v // stride)
            rng = np.random.default_rng(seed)
            for width in widths:
                for _ in range(holes if columns - 2 * edge - width > 0 else 0):
                    low = int(rng.integers(edge, columns - edge - width))
                    high = low + width
                    holed = dynamic.with_hole(emission, low, high)
                    mapped, gone = dynamic.forward_backward(holed, holed.mean(axis=1))
                    absent = gone.sum(axis=1)
                    abstains = (absent > most_absent) | (dynamic.window_mass(mapped, mapped.argmax(axis=1)) < least_window)
                    inside = lambda at: (at >= low + guard) & (at < high - guard)  # noqa: B023, E731
                    clear = (other >= 0) & ((other < low - guard) | (other >= high + guard))
                    orphaned = inside(other)
                    if orphaned.sum() >= 5:
                        share = lambda of: float(abstains[of].mean()) if of.any() else np.nan  # noqa: B023, E731
                        rows.append((width, low * stride, int(orphaned.sum()), int(clear.sum()), share(orphaned), share(clear), share(inside(own)), float(np.median(absent[orphaned])), float(np.median(absent[clear])) if clear.any() else np.nan))
        return dict(zip(TRIAL, zip(*rows, strict=True), strict=True)) if rows else {n: [] for n in TRIAL}

    return per_group(rows_of, keys, f"{key_schema}, {', '.join(f'{n} long' for n in TRIAL[:4])}, {', '.join(f'{n} double' for n in TRIAL[4:])}", kernel)


def holdout_rates(trials: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, width, trials, detection_rate, detection_rate_self, false_alarm_rate): the holes of each width together."""
    mean = lambda c: F.avg(F.when(~F.isnan(c), F.col(c)))
    return trials.groupBy(*keys, "width").agg(F.count(F.lit(1)).alias("trials"), mean("abstained_orphaned").alias("detection_rate"), mean("self_abstained_orphaned").alias("detection_rate_self"), mean("abstained_unaffected").alias("false_alarm_rate"))


def vlad(tokens: DataFrame, keys: list[str], key_schema: str, order: str, vector: str, k: int = 4, seed: int = 0) -> DataFrame:
    """(keys, order, descriptor): residual descriptors of each row's tokens against the group's own vocabulary of every eighth row."""

    def kernel(pdf: pd.DataFrame) -> dict:
        ordered = pdf.sort_values(order)
        rows = [np.asarray([np.asarray(t, float) for t in r]) for r in ordered[vector]]
        centres = dynamic.spherical_kmeans(np.concatenate(rows[::8]), k, seed=seed)
        return {order: ordered[order].to_numpy(), "descriptor": [dynamic.vlad(r / np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-8), centres).tolist() for r in rows]}

    return per_group(tokens.select(*keys, order, vector), keys, f"{key_schema}, {order} long, descriptor array<double>", kernel)


def stratified_sample(df: DataFrame, keys: list[str], key_schema: str, order: str, blocked: str, count: int, spacing: int, seed: int) -> DataFrame:
    """(keys, number, order): a seeded draw from each of `count` strata, apart from blocked rows and from each other."""

    def kernel(pdf: pd.DataFrame) -> dict:
        stop = pdf.loc[pdf[blocked], order].to_numpy()
        taken = dynamic.stratified(int(pdf[order].min()), int(pdf[order].max()) + 1, count, stop, spacing, seed)
        return {"number": np.arange(len(taken)), order: taken}

    return per_group(df.select(*keys, order, blocked), keys, f"{key_schema}, number long, {order} long", kernel)


def farthest_first(df: DataFrame, keys: list[str], key_schema: str, value: str) -> DataFrame:
    """(keys, number, value): distinct values, each farthest from those before it."""

    def kernel(pdf: pd.DataFrame) -> dict:
        order = dynamic.farthest_first(pdf[value].to_numpy())
        return {"number": np.arange(len(order)), value: order}

    return per_group(df.select(*keys, value), keys, f"{key_schema}, number long, {value} long", kernel)


def bootstrap_median(df: DataFrame, keys: list[str], key_schema: str, value: str, seed: int = 0) -> DataFrame:
    """(keys, n, median, low, high): a median with its bootstrap interval."""

    def kernel(pdf: pd.DataFrame) -> dict:
        x = np.sort(pdf[value].dropna().to_numpy(float))
        low, high = dynamic.bootstrap_median(x, seed) if len(x) else (np.nan, np.nan)
        return {"n": [len(x)], "median": [float(np.median(x)) if len(x) else np.nan], "low": [low], "high": [high]}

    return per_group(df.select(*keys, value), keys, f"{key_schema}, n long, median double, low double, high double", kernel)


def thinned(pairs: DataFrame, keys: list[str], key_schema: str, apart: int = 60, most: int = 40) -> DataFrame:
    """(keys, a, b, s): the best pairs, thinned greedily."""

    def kernel(pdf: pd.DataFrame) -> dict:
        taken = dynamic.thinned(list(zip(pdf["a"], pdf["b"], pdf["s"], strict=True)), apart, most)
        return {"a": [t[0] for t in taken], "b": [t[1] for t in taken], "s": [t[2] for t in taken]}

    return per_group(pairs.select(*keys, "a", "b", "s"), keys, f"{key_schema}, a long, b long, s double", kernel)


def inlying(points: DataFrame, keys: list[str], key_schema: str, trials: int = 750) -> DataFrame:
    """(keys, matches, ax, ay, bx, by): the matched points that agree with the model of their group, and how many there were; a group without any has one row of nulls."""
    columns = ["ax", "ay", "bx", "by"]

    def kernel(pdf: pd.DataFrame) -> dict:
        ordered = pdf.sort_values(columns)
        inside = images.agreeing(ordered[columns[:2]].to_numpy(float), ordered[columns[2:]].to_numpy(float), trials)
        kept = ordered.loc[inside, columns] if inside.any() else pd.DataFrame([[np.nan] * 4], columns=columns)
        return {"matches": len(ordered), **{c: [None if np.isnan(x) else x for x in kept[c]] for c in columns}}

    return per_group(points.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]), keys, f"{key_schema}, matches long, {', '.join(f'{c} double' for c in columns)}", kernel)


def shifts(frames: DataFrame, keys: list[str], key_schema: str, order: str, pixels: str, rows: int, columns: int) -> DataFrame:
    """(keys, order, dy, dx): sub-pixel shift of each small image against the one before it."""

    def kernel(pdf: pd.DataFrame) -> dict:
        ordered = pdf.sort_values(order)
        stack = np.stack([np.asarray(p, float).reshape(rows, columns) for p in ordered[pixels]])
        moved = [images.phase_shift(a, b) for a, b in zip(stack, stack[1:], strict=False)]
        return {order: ordered[order].to_numpy()[1:], "dy": [m[0] for m in moved], "dx": [m[1] for m in moved]}

    return per_group(frames.select(*keys, order, pixels), keys, f"{key_schema}, {order} long, dy double, dx double", kernel)


def masks(frames: DataFrame, keys: list[str], key_schema: str, order: str, pixels: str, rows: int, columns: int, still: float, bright: float, least: int) -> DataFrame:
    """(keys, static, sky, pixels): static and sky pixels of every eighth small image of a group."""

    def kernel(pdf: pd.DataFrame) -> dict:
        ordered = pdf.sort_values(order).iloc[::8]
        stack = np.stack([np.asarray(p, float).reshape(rows, columns) for p in ordered[pixels]])
        middle = np.median(stack, axis=0)
        return {"static": [int(images.static_mask(stack, still, bright, least).sum())], "sky": [int(images.sky(middle, np.quantile(middle, 0.8), np.quantile(images.gradient(middle), 0.5)).sum())], "pixels": [rows * columns]}

    return per_group(frames.select(*keys, order, pixels), keys, f"{key_schema}, static long, sky long, pixels long", kernel)
