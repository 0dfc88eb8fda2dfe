"""Queries over vectors and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import agreement, similarity as sim
from ..sources import adapter
from ..sources.adapter import PAIR, STREAM, with_sql
from .catalog import query
from .sequences import EVENTS_SQL, P, S, events, mapping_steps, with_steps

KEYS, KEY_SCHEMA = ["recording"], "recording long"
CROSS = "pairs AS (SELECT a.recording, a.ordinal AS a, b.ordinal AS b, round(list_dot_product(a.v, b.v), 6) AS s FROM descriptors a JOIN descriptors b ON a.recording = b.recording AND a.run = 'runA' AND b.run = 'runB')\n"
SELF = "pairs AS (SELECT a.recording, a.ordinal AS a, b.ordinal AS b, round(list_dot_product(a.v, b.v), 6) AS s FROM descriptors a JOIN descriptors b ON a.recording = b.recording AND a.run = 'runA' AND b.run = 'runA' AND a.ordinal <> b.ordinal)\n"
CROSS_SQL = with_sql("descriptors").rstrip() + ",\n" + CROSS
SELF_SQL = with_sql("descriptors").rstrip() + ",\n" + SELF


def cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapter.descriptors(spark, sf_dir)
    return sim.pairs(d.filter("run = 'runA'"), d.filter("run = 'runB'"), KEYS)


def side(spark: SparkSession, sf_dir: str, run: str) -> DataFrame:
    return adapter.descriptors(spark, sf_dir).filter(F.col("run") == run)


@query(CROSS_SQL + "SELECT recording, a, b, s, rank FROM (SELECT *, row_number() OVER (PARTITION BY recording, a ORDER BY s DESC, b) AS rank FROM pairs) WHERE rank <= 5")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar frames of run B for each of run A, within a recording."""
    return sim.top_k(side(spark, sf_dir, "runA"), side(spark, sf_dir, "runB"), KEYS, KEY_SCHEMA, 5)


@query(
    CROSS_SQL
    + """SELECT recording, a, b, round(greatest(least((s - m) / greatest(1.4826 * mad, 0.0001), 8.0), -8.0), 4) AS z FROM (SELECT *, quantile_cont(d, 0.5) OVER (PARTITION BY recording, a) AS mad FROM
(SELECT *, abs(s - m) AS d FROM (SELECT *, quantile_cont(s, 0.5) OVER (PARTITION BY recording, a) AS m FROM pairs)))"""
)
def robust_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of each pair: a robust z score within its row, clipped."""
    return sim.robust_z(cross(spark, sf_dir), KEYS).select("recording", "a", "b", F.round("z", 4).alias("z"))


MUTUAL = """far AS (SELECT * FROM pairs WHERE abs(a - b) >= 20 AND s >= 0.1),
mutual AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recording, a ORDER BY s DESC, b) AS rank_a, row_number() OVER (PARTITION BY recording, b ORDER BY s DESC, a) AS rank_b FROM far) WHERE rank_a <= 5 AND rank_b <= 5 AND a < b)
"""


@query(SELF_SQL.rstrip() + ",\n" + MUTUAL + "SELECT recording, a, b, s, rank_a, rank_b FROM mutual")
def mutual_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distant pairs of run A among each other's five best."""
    return sim.mutual(side(spark, sf_dir, "runA"), KEYS, KEY_SCHEMA, 5, 20, 0.1)


@query(CROSS_SQL + "SELECT recording, a, b, round(s / sum(s) OVER (PARTITION BY recording, a), 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY recording, a ORDER BY s DESC, b) AS rank FROM pairs WHERE s > 0.1) WHERE rank <= 15")
def same_place_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse rows of the fifteen best pairs, summing to one."""
    return sim.same_place(side(spark, sf_dir, "runA"), side(spark, sf_dir, "runB"), KEYS, KEY_SCHEMA, 15, 0.1)


@query(SELF_SQL + "SELECT recording, count(*) FILTER (b - a > 10) AS pairs, count(*) FILTER (b - a > 10 AND s > 0.1) AS over_10, count(*) FILTER (b - a > 10 AND s > 0.2) AS over_20, count(*) FILTER (b - a > 10 AND s > 0.3) AS over_30 FROM pairs GROUP BY recording")
def aliasing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-alike pairs far apart, at three thresholds."""
    return sim.aliasing(side(spark, sf_dir, "runA"), KEYS, KEY_SCHEMA, 10, {"over_10": 0.1, "over_20": 0.2, "over_30": 0.3})


@query(SELF_SQL + "SELECT recording, arg_max(a, s * 1000000000 - a * 1000 - b) AS tail, arg_max(b, s * 1000000000 - a * 1000 - b) AS head, max(s) AS s FROM pairs WHERE a >= 70 AND b < 30 GROUP BY recording")
def revisit_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best match of the last frames among the first."""
    a = side(spark, sf_dir, "runA")
    rows = sim.pairs(a.filter("ordinal >= 70"), a.filter("ordinal < 30"), KEYS)
    best = F.struct(F.col("s"), -F.col("a"), -F.col("b"))
    return rows.groupBy("recording").agg(F.max_by("a", best).alias("tail"), F.max_by("b", best).alias("head"), F.max("s").alias("s"))


@query(SELF_SQL + "SELECT p.recording, p.a, p.b, count(*) FILTER (q.s > p.s) + 1 AS rank FROM pairs p JOIN pairs q ON q.recording = p.recording AND q.a = p.a AND abs(q.a - q.b) >= 20 WHERE p.b = p.a + 30 OR p.b = p.a + 40 GROUP BY p.recording, p.a, p.b, p.s")
def nonlocal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank of certain candidates among the distant matches of a frame."""
    return sim.distant_ranks(side(spark, sf_dir, "runA"), KEYS, KEY_SCHEMA, (30, 40), 20)


@query(with_sql("frames") + f"SELECT {S}, count(*) AS n, round(corr(x, y), 6) AS rho FROM (SELECT {S}, CAST(row_number() OVER (PARTITION BY {S} ORDER BY luma, ordinal) AS DOUBLE) AS x, CAST(row_number() OVER (PARTITION BY {S} ORDER BY p99, ordinal) AS DOUBLE) AS y FROM frames) GROUP BY {S}")
def spearman_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of the two exposure measures."""
    return sim.spearman(adapter.frames(spark, sf_dir), STREAM, "luma", "p99", "ordinal")


@query(with_sql("frames") + f"SELECT {S}, round(1000 * regr_slope(luma, ordinal), 4) AS slope_per_1000, round(regr_r2(luma, ordinal), 6) AS r2 FROM frames GROUP BY {S}")
def trend_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trend of each stream."""
    o = F.col("ordinal").cast("double")
    return adapter.frames(spark, sf_dir).groupBy(*STREAM).agg(F.round(1000 * F.regr_slope("luma", o), 4).alias("slope_per_1000"), F.round(F.regr_r2("luma", o), 6).alias("r2"))


@query(
    with_sql("descriptors")
    + """SELECT recording, ordinal, round(CASE WHEN sa * sb > 1e-12 THEN (list_dot_product(ca, cb)) / (sa * sb) ELSE 0.0 END, 5) AS ncc FROM (SELECT *, sqrt(list_dot_product(ca, ca)) AS sa, sqrt(list_dot_product(cb, cb)) AS sb FROM
(SELECT a.recording, a.ordinal, list_transform(a.v, lambda x: x - list_avg(a.v)) AS ca, list_transform(b.v, lambda x: x - list_avg(b.v)) AS cb FROM descriptors a JOIN descriptors b USING (recording, ordinal) WHERE a.run = 'runA' AND b.run = 'runB'))"""
)
def band_ncc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-mean correlation of the two runs' vectors at equal ordinals."""
    d = adapter.descriptors(spark, sf_dir)
    joined = d.filter("run = 'runA'").select("recording", "ordinal", F.col("v").alias("a")).join(d.filter("run = 'runB'").select("recording", "ordinal", F.col("v").alias("b")), ["recording", "ordinal"])
    return joined.select("recording", "ordinal", F.round(vectors.ncc(F.col("a"), F.col("b")), 5).alias("ncc"))


@query(
    with_steps()
    + f"""SELECT {P}, step, coalesce(n, 0) AS n, round((coalesce(n, 0) + 1) / (sum(coalesce(n, 0) + 1) OVER (PARTITION BY {P})), 6) AS probability FROM (SELECT DISTINCT {P}, step FROM steps, (VALUES (CAST(0 AS BIGINT)), (1), (2), (3), (4)) t(step)) LEFT JOIN (SELECT {P}, increment AS step, count(*) AS n FROM steps WHERE increment BETWEEN 0 AND 4 GROUP BY ALL) USING ({P}, step)"""
)
def step_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed probabilities of steps from zero to four."""
    steps = mapping_steps(spark, sf_dir)
    counted = steps.groupBy(*PAIR).agg(*[F.count(F.when(F.col("increment") == i, 1)).alias(f"_{i}") for i in range(5)])
    rows = counted.select(*PAIR, F.posexplode(F.array(*[f"_{i}" for i in range(5)])).alias("step", "n"))
    return rows.select(*PAIR, F.col("step").cast("bigint").alias("step"), "n", F.round((F.col("n") + 1) / F.sum(F.col("n") + 1).over(Window.partitionBy(*PAIR)), 6).alias("probability"))


@query(
    with_sql("mapping", "frames").rstrip() + ",\n"
    + f"""joint AS (SELECT m.{P.replace(", ", ", m.")}, least(CAST(floor(a.luma / 30) AS BIGINT), 5) AS bin_a, least(CAST(floor(b.luma / 30) AS BIGINT), 5) AS bin_b, count(*) AS n FROM mapping m
  JOIN frames a ON a.recording = m.recording AND a.camera = m.camera AND a.run = 'runA' AND a.ordinal = m.runA_frame JOIN frames b ON b.recording = m.recording AND b.camera = m.camera AND b.run = 'runB' AND b.ordinal = m.runB_frame GROUP BY ALL)
SELECT {P}, bin_a, bin_b, n, round(greatest(least(pow(n * sum(n) OVER (PARTITION BY {P}) / (CAST(sum(n) OVER (PARTITION BY {P}, bin_a) AS DOUBLE) * sum(n) OVER (PARTITION BY {P}, bin_b)), 0.5), 4.0), 0.25), 6) AS ratio FROM joint"""
)
def speed_lr_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tempered likelihood ratios of binned measures that the mapping pairs."""
    f = adapter.frames(spark, sf_dir).select(*PAIR, "run", "ordinal", F.least(F.floor(F.col("luma") / 30), F.lit(5)).cast("bigint").alias("bin"))
    side = lambda run, frame, name: f.filter(F.col("run") == run).select(*PAIR, F.col("ordinal").alias(frame), F.col("bin").alias(name))
    m = adapter.mapping(spark, sf_dir).filter("runB_frame IS NOT NULL").select(*PAIR, "runA_frame", "runB_frame")
    joint = m.join(side("runA", "runA_frame", "bin_a"), [*PAIR, "runA_frame"]).join(side("runB", "runB_frame", "bin_b"), [*PAIR, "runB_frame"])
    return sim.likelihood_table(joint, PAIR, "bin_a", "bin_b")


@query(
    with_sql("mapping").rstrip()
    + EVENTS_SQL.removeprefix(with_sql("frames").rstrip()).rstrip() + ",\n"
    + f"""judged AS (SELECT m.{P.replace(", ", ", m.")}, EXISTS (SELECT 1 FROM merged e WHERE e.recording = m.recording AND e.camera = m.camera AND e.run = 'runA' AND abs(e.event - m.runA_frame) <= 5) AS near_a,
  EXISTS (SELECT 1 FROM merged e WHERE e.recording = m.recording AND e.camera = m.camera AND e.run = 'runB' AND abs(e.event - m.runB_frame) <= 5) AS near_b FROM mapping m WHERE m.runB_frame IS NOT NULL)
SELECT {P}, count(*) AS pairs, count(*) FILTER (near_a) AS near_a, count(*) FILTER (near_b) AS near_b, count(*) FILTER (near_a AND near_b) AS near_both,
  round(CAST(count(*) FILTER (near_a AND near_b) AS DOUBLE) / nullif(count(*) FILTER (near_a), 0), 6) AS hit_rate, round(CAST(count(*) FILTER (near_b) AS DOUBLE) / count(*), 6) AS chance_rate FROM judged GROUP BY {P}"""
)
def likelihood_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often events of the two runs meet along the mapping, and how often by chance."""
    e = events(spark, sf_dir)
    m = adapter.mapping(spark, sf_dir).filter("runB_frame IS NOT NULL").select(*PAIR, "runA_frame", "runB_frame")
    rows = agreement.near(m, e.filter("run = 'runA'"), PAIR, "runA_frame", "event", 5, "_a")
    rows = agreement.near(rows, e.filter("run = 'runB'"), PAIR, "runB_frame", "event", 5, "_b")
    n = lambda c: F.count(F.when(c, 1))
    a, b = F.col("_a"), F.col("_b")
    ratio = lambda x, y: F.round(F.try_divide(x.cast("double"), y.cast("double")), 6)
    return rows.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("pairs"), n(a).alias("near_a"), n(b).alias("near_b"), n(a & b).alias("near_both"), ratio(n(a & b), n(a)).alias("hit_rate"), ratio(n(b), F.count(F.lit(1))).alias("chance_rate"))


@query(
    with_sql("decisions", "frames")
    + f"""SELECT {P}, runA_frame, b, round(exp(0.8 * greatest(least(z, 3.0), -3.0)), 4) AS multiplier FROM (SELECT *, (s - avg(s) OVER w) / nullif(stddev_pop(s) OVER w, 0) AS z, count(*) OVER w AS n FROM
(SELECT d.{P.replace(", ", ", d.")}, d.runA_frame, f.ordinal AS b, -abs(f.luma - a.luma) AS s FROM decisions d JOIN frames a ON a.recording = d.recording AND a.camera = d.camera AND a.run = 'runA' AND a.ordinal = d.runA_frame JOIN frames f ON f.recording = d.recording AND f.camera = d.camera AND f.run = 'runB' AND f.ordinal BETWEEN d.candidate - 8 AND d.candidate + 8) WINDOW w AS (PARTITION BY {P}, runA_frame)) WHERE n >= 3 AND z IS NOT NULL"""
)
def structure_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised scores of the candidates in a band, as multipliers; the band is exploded and joined on equal keys."""
    f = adapter.frames(spark, sf_dir)
    a = f.filter("run = 'runA'").select(*PAIR, F.col("ordinal").alias("runA_frame"), F.col("luma").alias("_a"))
    b = f.filter("run = 'runB'").select(*PAIR, F.col("ordinal").alias("b"), F.col("luma").alias("_b"))
    band = adapter.decisions(spark, sf_dir).select(*PAIR, "runA_frame", F.explode(F.sequence(F.col("candidate") - 8, F.col("candidate") + 8)).alias("b"))
    scored = band.join(a, [*PAIR, "runA_frame"]).join(b, [*PAIR, "b"]).withColumn("s", -F.abs(F.col("_b") - F.col("_a")))
    w = Window.partitionBy(*PAIR, "runA_frame")
    z = scored.withColumn("z", F.try_divide(F.col("s") - F.avg("s").over(w), F.stddev_pop("s").over(w))).withColumn("n", F.count(F.lit(1)).over(w)).filter("n >= 3 AND z IS NOT NULL")
    return z.select(*PAIR, "runA_frame", "b", F.round(F.exp(0.8 * F.greatest(F.least(F.col("z"), F.lit(3.0)), F.lit(-3.0))), 4).alias("multiplier"))
