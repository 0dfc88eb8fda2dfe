"""A quality classifier made of sparse rules.

Statistics of a text are Spark columns. Boosted shallow trees are grown on them
for a bounded sample of labelled rows; every path from a root to a node is a
rule, a conjunction of thresholds; a logistic regression with an L1 penalty
weighs the rules and leaves most of them without a weight; and what remains is
compiled into one Spark expression, so scoring stays in the JVM and never
shuffles.

The sample is the one thing with a bound: about `SAMPLE` labelled rows, chosen
by a hash of the id, whatever the size of the tables. Neither labels, nor
language, source or id are among the statistics.

Defined cases: a null text is the empty text, whose statistics are 0, and has a
score like any other; rows without a label, or with a null one, don't train;
without labels of both kinds every score is the share of label 1, or 1 if there
is no label at all; repeated rows are scored as often as they come, and repeated
labels count once; an empty table gives an empty result; further columns pass
through, but for `score`, `predicted` and those beginning with `_` that are used
on the way (`_text`, `_counts`, `_features`). Of documents that share an id, the
one of the least features trains.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Labelled rows to train on, at most about so many; a tenth more can come by chance.
SAMPLE = 20_000
TREES, DEPTH, SHRINKAGE, BINS, LEAST_LEAF = 24, 3, 0.3, 48, 8
PENALTY, STEPS = 0.002, 600
SEED = 42


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text, none of them null; `text` must be a plain column."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    kept = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    return {
        "chars": F.length(text),
        "words": F.size(words),
        "distinct": F.size(F.array_distinct(words)),
        "repeats": F.size(F.filter(F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: a == b), lambda same: same)),
        "upper": kept(r"[^A-ZÀ-ÖØ-Þ]+"),
        "symbols": kept(r"[^#$%&*^~<>{}\[\]\\=_@]+"),
        "digits": kept(r"[^0-9]+"),
        "stops": kept(r"[^.,;:?]+"),
        "bars": F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit(""))),
        "bangs": F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))),
        "lines": F.size(F.split(text, "\n")),
        "distinct_lines": F.size(F.array_distinct(F.split(text, "\n"))),
    }


FEATURES: dict[str, Callable[[Callable[[str], Column]], Column]] = {
    "log_words": lambda c: F.log1p(c("words")),
    "word_length": lambda c: c("chars") / F.greatest(c("words"), F.lit(1)),
    "distinct_share": lambda c: c("distinct") / F.greatest(c("words"), F.lit(1)),
    "repeat_share": lambda c: c("repeats") / F.greatest(c("words"), F.lit(1)),
    "upper_share": lambda c: c("upper") / F.greatest(c("chars"), F.lit(1)),
    "symbol_share": lambda c: c("symbols") / F.greatest(c("chars"), F.lit(1)),
    "digit_share": lambda c: c("digits") / F.greatest(c("chars"), F.lit(1)),
    "stop_share": lambda c: c("stops") / F.greatest(c("words"), F.lit(1)),
    "bar_share": lambda c: c("bars") / F.greatest(c("words"), F.lit(1)),
    "bang_share": lambda c: c("bangs") / F.greatest(c("words"), F.lit(1)),
    "words_a_line": lambda c: c("words") / F.greatest(c("lines"), F.lit(1)),
    "distinct_line_share": lambda c: c("distinct_lines") / F.greatest(c("lines"), F.lit(1)),
}
NAMES = list(FEATURES)

Rule = tuple[tuple[int, bool, float], ...]


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a struct of the statistics' features in the column `_features`."""
    plain = docs.withColumn("_text", text_of(text_col))
    counted = plain.withColumn("_counts", F.struct(*[c.alias(n) for n, c in statistics(F.col("_text")).items()])).drop("_text")
    return counted.withColumn("_features", F.struct(*[f(lambda n: F.col(f"_counts.{n}")).cast("double").alias(n) for n, f in FEATURES.items()])).drop("_counts")


def grow(x: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, depth: int, path: Rule, rules: list[Rule], out: np.ndarray) -> None:
    """A regression tree by Newton gains over binned features; adds the paths of its nodes to rules and its steps to out."""
    g, h = gradient[rows].sum(), hessian[rows].sum()
    best = None
    if depth and len(rows) >= 2 * LEAST_LEAF:
        for f, bounds in enumerate(edges):
            if not len(bounds):
                continue
            place = np.searchsorted(bounds, x[rows, f])  # x <= bounds[i] for place <= i
            size = len(bounds) + 1
            gs, hs, n = (np.cumsum(np.bincount(place, w, size))[:-1] for w in (gradient[rows], hessian[rows], None))
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(n < LEAST_LEAF) | (len(rows) - n < LEAST_LEAF)] = 0
            i = int(np.argmax(gain))
            if gain[i] > 1e-6 and (best is None or gain[i] > best[0]):
                best = gain[i], f, float(bounds[i])
    if best is None:
        out[rows] -= SHRINKAGE * g / (h + 1)
        return
    _, f, bound = best
    below = x[rows, f] <= bound
    for side, part in ((True, rows[below]), (False, rows[~below])):
        longer = (*path, (f, side, bound))
        rules.append(longer)
        grow(x, edges, gradient, hessian, part, depth - 1, longer, rules, out)


def simplified(rule: Rule) -> Rule:
    """One bound for each feature and side, in a fixed order."""
    tight: dict[tuple[int, bool], float] = {}
    for f, below, bound in rule:
        old = tight.get((f, below), bound)
        tight[f, below] = min(old, bound) if below else max(old, bound)
    return tuple(sorted((f, below, bound) for (f, below), bound in tight.items()))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    found = np.ones(len(x), dtype=bool)
    for f, below, bound in rule:
        found &= (x[:, f] <= bound) == below
    return found


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on all but the intercept, by accelerated proximal steps."""
    n, k = z.shape
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    b, w = float(np.log(share / (1 - share))), np.zeros(k)
    if not k:
        return b, w
    v = np.ones(k)
    for _ in range(30):  # largest singular value of the rules, for the step
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v) or 1.0
    step = 1 / (0.25 * (np.linalg.norm(z @ v) ** 2 / n + 1) + 1e-9)
    bb, ww, t = b, w.copy(), 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(z @ ww + bb))) - y
        b_new = bb - step * error.mean()
        raw = ww - step * (z.T @ error) / n
        w_new = np.sign(raw) * np.maximum(np.abs(raw) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        bb, ww = b_new + (t - 1) / t_new * (b_new - b), w_new + (t - 1) / t_new * (w_new - w)
        b, w, t = b_new, w_new, t_new
    return float(b), w


class RuleModel:
    """An intercept and weighted rules."""

    def __init__(self, intercept: float, rules: list[tuple[Rule, float]]) -> None:
        self.intercept, self.rules = intercept, rules

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> RuleModel:
        if not len(y):
            return cls(float("inf"), [])
        if y.min() == y.max():
            return cls(float("inf") if y[0] else float("-inf"), [])
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        share = y.mean()
        margin, found = np.full(len(y), np.log(share / (1 - share))), []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            grow(x, edges, p - y, p * (1 - p), np.arange(len(y)), DEPTH, (), found, margin)
        distinct: dict[bytes, tuple[Rule, np.ndarray]] = {}
        for rule in sorted({simplified(r) for r in found}, key=lambda r: (len(r), r)):
            column = holds(rule, x)
            if LEAST_LEAF <= column.sum() <= len(y) - LEAST_LEAF:
                distinct.setdefault(np.packbits(column).tobytes(), (rule, column))
        kept = list(distinct.values())
        z = np.stack([c for _, c in kept], axis=1).astype(float) if kept else np.zeros((len(y), 0))
        intercept, weights = lasso(z, y.astype(float), PENALTY)
        return cls(intercept, [(rule, float(w)) for (rule, _), w in zip(kept, weights, strict=True) if abs(w) > 1e-6])

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, w in self.rules:
            total += w * holds(rule, x)
        return 1 / (1 + np.exp(-total))

    def column(self, feature: Callable[[str], Column]) -> Column:
        """The score as one expression over the features."""
        if np.isinf(self.intercept):
            return F.lit(float(self.intercept > 0))
        total = F.lit(self.intercept)
        for rule, w in self.rules:
            tests = [feature(NAMES[f]) <= bound if below else feature(NAMES[f]) > bound for f, below, bound in rule]
            condition = tests[0]
            for test in tests[1:]:
                condition &= test
            total = total + F.when(condition, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def __str__(self) -> str:
        return "\n".join([f"{self.intercept:+.3f}", *(f"{w:+.3f} if " + " and ".join(f"{NAMES[f]} {'<=' if below else '>'} {bound:.4g}" for f, below, bound in rule) for rule, w in self.rules)])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bound: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of about `bound` labelled rows at most, in a fixed order."""
    usable = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).dropna().filter(~held_out("_id")).distinct()  # a repeated label is one row
    total = usable.count()
    if not total:
        return np.zeros((0, len(NAMES))), np.zeros(0)
    scale = 1_000_000
    chosen = usable.filter(F.pmod(F.xxhash64(F.lit(SEED), "_id"), F.lit(scale)) < int(scale * min(1.0, bound / total)))
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")
    # of documents that share an id, one: else their number, not the bound, would size the sample
    rows = with_features(joined, "text").groupBy("_id", "_label").agg(F.min("_features").alias("_features")).select("_id", "_label", "_features.*").toPandas()
    rows = rows.sort_values([*NAMES, "_label"], kind="stable")
    return rows[NAMES].to_numpy(dtype=float), rows["_label"].to_numpy(dtype=float)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bound: int = SAMPLE) -> RuleModel:
    return RuleModel.fit(*sample(docs, labels, id_col, text_col, label_col, bound))


def scored(docs: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """docs with score and predicted."""
    made = with_features(docs, text_col).withColumn("score", model.column(lambda n: F.col(f"_features.{n}"))).drop("_features")
    return made.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
