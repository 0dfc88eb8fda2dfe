"""Queries that score methods against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as fn
from ..operators import agreement, scoring
from ..sources import adapter
from ..sources.adapter import PAIR, with_sql
from .catalog import query
from .sequences import P, STEPS, mapping_steps

CASES = f"""demoted AS (SELECT DISTINCT {P}, unnest(generate_series(runA_frame - 10, runA_frame + 10)) AS runA_frame FROM steps WHERE increment >= 6),
joined AS (SELECT l.*, x.method, x.predicted, CASE WHEN d.runA_frame IS NOT NULL THEN 'near_kink' WHEN a.ordinal IS NOT NULL THEN 'runA_too_dark' WHEN b.ordinal IS NOT NULL THEN 'runB_too_dark' END AS gated_by
  FROM labels_v l JOIN methods x USING ({P}, runA_frame) LEFT JOIN demoted d USING ({P}, runA_frame)
  LEFT JOIN flags a ON a.recording = l.recording AND a.camera = l.camera AND a.run = 'runA' AND a.ordinal = l.runA_frame AND a.flag = 'too_dark'
  LEFT JOIN flags b ON b.recording = l.recording AND b.camera = l.camera AND b.run = 'runB' AND b.ordinal = x.predicted AND b.flag = 'too_dark'),
accepted AS (SELECT *, predicted IS NOT NULL AND gated_by IS NULL AS accepted FROM joined),
cases AS (SELECT *, CASE WHEN accepted AND label = 'match' THEN greatest(low - predicted, predicted - high, 0) END AS interval_distance,
  CASE WHEN accepted AND label = 'match' THEN CASE WHEN predicted > high THEN predicted - high WHEN predicted < low THEN predicted - low ELSE 0 END END AS signed_distance,
  CASE WHEN accepted AND label = 'match' THEN abs(predicted - preferred) END AS preferred_error FROM accepted)
"""
CASES_SQL = with_sql("mapping", "flags", "labels_v", "methods").rstrip() + ",\n" + STEPS.rstrip() + ",\n" + CASES


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    dark = adapter.flags(spark, sf_dir).filter("flag = 'too_dark'")
    demoted = agreement.windows(mapping_steps(spark, sf_dir).filter("increment >= 6"), PAIR, "runA_frame", 10)
    gates = [
        ("near_kink", demoted, "runA_frame"),
        ("runA_too_dark", dark.filter("run = 'runA'").select(*PAIR, F.col("ordinal").alias("runA_frame")), "runA_frame"),
        ("runB_too_dark", dark.filter("run = 'runB'").select(*PAIR, F.col("ordinal").alias("predicted")), "predicted"),
    ]
    return scoring.cases(adapter.labels(spark, sf_dir), adapter.methods(spark, sf_dir), [*PAIR, "runA_frame"], gates)


@query(CASES_SQL + "SELECT method, query_id, label, stratum, predicted, gated_by, accepted, interval_distance, signed_distance, preferred_error FROM cases")
def case_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each label and method, with the first gate that refuses it."""
    return cases(spark, sf_dir).select("method", "query_id", "label", "stratum", "predicted", "gated_by", "accepted", "interval_distance", "signed_distance", "preferred_error")


@query(CASES_SQL + "SELECT query_id, method, interval_distance, signed_distance FROM cases WHERE interval_distance IS NOT NULL")
def interval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of accepted predictions to the closed intervals of right answers."""
    return cases(spark, sf_dir).filter("interval_distance IS NOT NULL").select("query_id", "method", "interval_distance", "signed_distance")


Z = fn.Z95


def wilson_sql(k: str, n: str, sign: str) -> str:
    p = f"(CAST({k} AS DOUBLE) / {n})"
    return f"CASE WHEN {n} > 0 THEN round(least(greatest(({p} + {Z * Z} / (2 * CAST({n} AS DOUBLE)) {sign} {Z} * sqrt({p} * (1 - {p}) / {n} + {Z * Z} / (4 * CAST({n} AS DOUBLE) * {n}))) / (1 + {Z * Z} / {n}), 0.0), 1.0), 4) END"


N_SQL, K_SQL = "count(*) FILTER (accepted AND label <> 'undetermined')", "count(*) FILTER (interval_distance = 0)"
MEASURES = f"""count(*) AS labels, count(*) FILTER (label <> 'undetermined') AS determinable, {N_SQL} AS accepted, {K_SQL} AS correct, count(*) FILTER (accepted AND label = 'no_correspondence') AS false_accepts,
  round(CAST({K_SQL} AS DOUBLE) / nullif({N_SQL}, 0), 4) AS precision, round(CAST({N_SQL} AS DOUBLE) / nullif(count(*) FILTER (label <> 'undetermined'), 0), 4) AS coverage,
  {wilson_sql(K_SQL, N_SQL, "-")} AS wilson_low, {wilson_sql(K_SQL, N_SQL, "+")} AS wilson_high, count(*) FILTER (interval_distance <= 2) AS within_2, quantile_cont(interval_distance, 0.5) AS median_distance, max(interval_distance) AS largest_distance"""


@query(CASES_SQL + f"SELECT method, camera, stratum, CAST(grouping(method, camera, stratum) AS BIGINT) AS level, {MEASURES} FROM cases GROUP BY GROUPING SETS ((method, camera), (method, camera, stratum), (method), (method, stratum))")
def metrics_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of each method by camera, by stratum, by both and alone, in one aggregation."""
    return scoring.grouping_sets(cases(spark, sf_dir), "method", "camera", "stratum")


@query(CASES_SQL + f"SELECT method, count(*) AS n, {K_SQL} AS correct, {wilson_sql(K_SQL, 'count(*)', '-')} AS low, {wilson_sql(K_SQL, 'count(*)', '+')} AS high FROM cases WHERE interval_distance IS NOT NULL GROUP BY method")
def wilson_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score intervals of each method's precision."""
    n, k = F.count(F.lit(1)), F.count(F.when(F.col("interval_distance") == 0, 1))
    return cases(spark, sf_dir).filter("interval_distance IS NOT NULL").groupBy("method").agg(n.alias("n"), k.alias("correct"), fn.wilson(k, n, False).alias("low"), fn.wilson(k, n, True).alias("high"))


HITS = "count(*) FILTER (interval_distance <= tolerance)"


@query(
    CASES_SQL
    + f"SELECT method, camera, tolerance, count(*) AS n, {HITS} AS hits, round(CAST({HITS} AS DOUBLE) / count(*), 4) AS fraction, {wilson_sql(HITS, 'count(*)', '-')} AS low, {wilson_sql(HITS, 'count(*)', '+')} AS high FROM cases, (VALUES (CAST(0 AS BIGINT)), (1), (2), (5), (10)) t(tolerance) WHERE interval_distance IS NOT NULL GROUP BY method, camera, tolerance"
)
def tolerance_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative hits at five tolerances."""
    return scoring.tolerance_curve(cases(spark, sf_dir), ["method", "camera"])


SHIFTED = "greatest(low - (predicted + shift), predicted + shift - high, 0)"
SWEEP = f"sweep AS (SELECT method, camera, shift, count(*) AS n, count(*) FILTER ({SHIFTED} = 0) AS correct, round(count(*) FILTER ({SHIFTED} = 0) / CAST(count(*) AS DOUBLE), 4) AS precision FROM cases, (SELECT unnest(generate_series(-4, 4)) AS shift) t WHERE interval_distance IS NOT NULL GROUP BY method, camera, shift)\n"


@query(CASES_SQL.rstrip() + ",\n" + SWEEP + "SELECT method, camera, shift, n, correct, precision FROM sweep")
def shift_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision when every prediction is moved by a constant."""
    return scoring.shift_sweep(cases(spark, sf_dir), ["method", "camera"], range(-4, 5))


@query(CASES_SQL.rstrip() + ",\n" + SWEEP + "SELECT method, camera, shift AS peak, precision FROM (SELECT *, row_number() OVER (PARTITION BY method, camera ORDER BY correct DESC, abs(shift), shift) AS r FROM sweep) WHERE r = 1")
def shift_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The constant that would fit each method and camera best."""
    return scoring.peak_shift(scoring.shift_sweep(cases(spark, sf_dir), ["method", "camera"], range(-4, 5)), ["method", "camera"])


MARGIN = "CAST((runA_frame * 37) % 50 AS DOUBLE) / 50"


@query(
    CASES_SQL.rstrip() + ",\n"
    + f"""margins AS (SELECT method, camera, {MARGIN} AS threshold, count(*) AS n, count(*) FILTER (interval_distance > 0) AS bad FROM cases WHERE interval_distance IS NOT NULL GROUP BY ALL),
summed AS (SELECT method, camera, threshold, CAST(sum(n) OVER w AS BIGINT) AS accepted, CAST(sum(bad) OVER w AS BIGINT) AS wrong, sum(n) OVER (PARTITION BY method, camera) AS whole FROM margins WINDOW w AS (PARTITION BY method, camera ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))
SELECT method, camera, threshold, accepted, wrong, round(CAST(wrong AS DOUBLE) / accepted, 4) AS risk, round(CAST(accepted AS DOUBLE) / whole, 4) AS coverage FROM summed
UNION ALL SELECT DISTINCT method, camera, CAST(NULL AS DOUBLE), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS DOUBLE), CAST(0.0 AS DOUBLE) FROM margins"""
)
def risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk against coverage when accepting from the largest margin down."""
    rows = cases(spark, sf_dir).filter("interval_distance IS NOT NULL").withColumn("margin", ((F.col("runA_frame") * 37) % 50).cast("double") / 50)
    return scoring.risk_coverage(rows, ["method", "camera"], "margin", F.col("interval_distance") == 0)


STATED = "CAST((runA_frame * 29) % 100 AS DOUBLE) / 100"
EDGES = ", ".join(f"(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for a, b in zip(scoring.RELIABILITY_EDGES, scoring.RELIABILITY_EDGES[1:], strict=False))
BINS = f"bins AS (SELECT method, camera, bin_low, bin_high, count(*) AS n, round(avg(stated), 6) AS stated, round(avg(CASE WHEN interval_distance = 0 THEN 1.0 ELSE 0.0 END), 6) AS observed FROM (SELECT *, {STATED} AS stated FROM cases WHERE interval_distance IS NOT NULL), (VALUES {EDGES}) e(bin_low, bin_high) WHERE stated >= bin_low AND stated < bin_high GROUP BY method, camera, bin_low, bin_high)\n"


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir).filter("interval_distance IS NOT NULL").withColumn("stated", ((F.col("runA_frame") * 29) % 100).cast("double") / 100)
    return scoring.reliability(rows, ["method", "camera"], "stated", F.col("interval_distance") == 0)


@query(CASES_SQL.rstrip() + ",\n" + BINS + "SELECT method, camera, bin_low, bin_high, n, stated, observed FROM bins")
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated against observed in seven fixed bins."""
    return bins(spark, sf_dir)


@query(CASES_SQL.rstrip() + ",\n" + BINS + "SELECT method, camera, CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(stated - observed)) / sum(n), 5) AS ece FROM bins GROUP BY method, camera")
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected calibration error over the reliability bins."""
    return scoring.calibration_error(bins(spark, sf_dir), ["method", "camera"])


SIGNED = """signed AS (SELECT method, camera, count(*) AS n, count(*) FILTER (s > 0) AS later, count(*) FILTER (s < 0) AS earlier, count(*) FILTER (s = 0) AS inside, round(avg(s), 4) AS mean, quantile_cont(s, 0.5) AS median, min(s) AS least, max(s) AS most, quantile_cont(s, 0.5) FILTER (s <> 0) AS median_outside
  FROM (SELECT *, signed_distance AS s FROM cases WHERE signed_distance IS NOT NULL) GROUP BY method, camera)
"""


@query(CASES_SQL.rstrip() + ",\n" + SIGNED + "SELECT *, abs(median) <= 1 AND abs(later - earlier) <= greatest(2.0, round_even(0.25 * (later + earlier), 0)) AS gone FROM signed")
def signed_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed errors, and whether an offset is gone from them."""
    return scoring.offset_gone(scoring.signed_summary(cases(spark, sf_dir), ["method", "camera"]))


@query(
    CASES_SQL
    + """SELECT method, camera, round(max(rate) FILTER (stratum = 'kink'), 4) AS kink, round(max(rate) FILTER (stratum = 'corridor'), 4) AS corridor, round(max(rate) FILTER (stratum = 'kink') - max(rate) FILTER (stratum = 'corridor'), 4) AS difference FROM
(SELECT method, camera, stratum, round(CAST(count(*) FILTER (interval_distance > 0) AS DOUBLE) / count(*), 6) AS rate FROM cases WHERE interval_distance IS NOT NULL GROUP BY ALL) GROUP BY method, camera"""
)
def kink_against_corridor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Miss rates of two strata and their difference."""
    rate = F.round(fn.ratio(F.count(F.when(F.col("interval_distance") > 0, 1)), F.count(F.lit(1))), 6)
    made = cases(spark, sf_dir).filter("interval_distance IS NOT NULL").groupBy("method", "camera").pivot("stratum", ["kink", "corridor"]).agg(rate)
    return made.select("method", "camera", F.round("kink", 4).alias("kink"), F.round("corridor", 4).alias("corridor"), F.round(F.col("kink") - F.col("corridor"), 4).alias("difference"))


OFFSETS = """offsets AS (SELECT method, camera, runA_frame, CAST(predicted - preferred AS DOUBLE) AS x, row_number() OVER (PARTITION BY method, camera ORDER BY recording, runA_frame) AS i, count(*) OVER (PARTITION BY method, camera) AS n FROM cases WHERE interval_distance IS NOT NULL),
centred AS (SELECT *, quantile_cont(x, 0.5) OVER (PARTITION BY method, camera) AS m FROM offsets)
"""


@query(
    CASES_SQL.rstrip() + ",\n" + OFFSETS
    + """SELECT method, camera, count(*) AS n, quantile_cont(x, 0.5) AS median, quantile_cont(abs(x - m), 0.5) AS mad, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, quantile_cont(x, 0.5) FILTER (i <= n // 2) AS first_half, quantile_cont(x, 0.5) FILTER (i > n // 2) AS second_half,
  round(1000 * regr_slope(x, runA_frame), 4) AS slope_per_1000, count(*) FILTER (x = 0) AS at_zero, count(*) FILTER (sign(x) = sign(m)) AS same_sign FROM centred GROUP BY method, camera"""
)
def label_convention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets from the preferred frame: middle, spread, halves, trend and signs. The middle is aggregated and joined back."""
    from pyspark.sql import Window

    rows = cases(spark, sf_dir).filter("interval_distance IS NOT NULL").withColumn("x", (F.col("predicted") - F.col("preferred")).cast("double"))
    middle = rows.groupBy("method", "camera").agg(F.percentile("x", F.lit(0.5)).alias("m"), F.count(F.lit(1)).alias("n"))
    placed = rows.withColumn("i", F.row_number().over(Window.partitionBy("method", "camera").orderBy("recording", "runA_frame"))).join(middle, ["method", "camera"])
    half = F.floor(F.col("n") / 2)
    q = lambda c, p: F.percentile(c, F.lit(p))
    x = F.col("x")
    return placed.groupBy("method", "camera").agg(
        F.count(F.lit(1)).alias("n"), q(x, 0.5).alias("median"), q(F.abs(x - F.col("m")), 0.5).alias("mad"), (q(x, 0.75) - q(x, 0.25)).alias("iqr"), q(F.when(F.col("i") <= half, x), 0.5).alias("first_half"), q(F.when(F.col("i") > half, x), 0.5).alias("second_half"),
        F.round(1000 * F.regr_slope(x, F.col("runA_frame").cast("double")), 4).alias("slope_per_1000"), F.count(F.when(x == 0, 1)).alias("at_zero"), F.count(F.when(F.signum(x) == F.signum("m"), 1)).alias("same_sign"),
    )


@query(
    CASES_SQL
    + """SELECT camera, a.method AS first_method, b.method AS second_method, count(*) AS both_accepted, count(*) FILTER (a.interval_distance = 0 AND b.interval_distance > 0) AS first_only, count(*) FILTER (a.interval_distance > 0 AND b.interval_distance = 0) AS second_only FROM cases a JOIN cases b USING (query_id, camera) WHERE a.method < b.method AND a.interval_distance IS NOT NULL AND b.interval_distance IS NOT NULL GROUP BY ALL"""
)
def head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two methods on the labels that both accept: a label's methods meet in one aggregation, not in a self join."""
    rows = cases(spark, sf_dir).filter("interval_distance IS NOT NULL").groupBy("camera", "query_id").agg(F.array_sort(F.collect_list(F.struct("method", "interval_distance"))).alias("m"))
    first = rows.select("camera", "m", F.posexplode("m").alias("i", "a"))
    pairs = first.select("camera", "a", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("b"))
    hit, miss = (lambda c: F.col(f"{c}.interval_distance") == 0), (lambda c: F.col(f"{c}.interval_distance") > 0)
    return pairs.groupBy("camera", F.col("a.method").alias("first_method"), F.col("b.method").alias("second_method")).agg(F.count(F.lit(1)).alias("both_accepted"), F.count(F.when(hit("a") & miss("b"), 1)).alias("first_only"), F.count(F.when(miss("a") & hit("b"), 1)).alias("second_only"))


@query(
    CASES_SQL
    + f"""SELECT method, camera, {N_SQL} AS accepted, {K_SQL} AS correct, round(CAST({K_SQL} AS DOUBLE) / nullif(count(*) FILTER (accepted), 0), 4) AS precision_all_labels, round(CAST({K_SQL} AS DOUBLE) / nullif({N_SQL}, 0), 4) AS precision_determinable FROM cases GROUP BY method, camera"""
)
def precision_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision with and without the undetermined labels in its denominator."""
    asked = F.col("accepted") & (F.col("label") != "undetermined")
    n, k = F.count(F.when(asked, 1)), F.count(F.when(F.col("interval_distance") == 0, 1))
    return cases(spark, sf_dir).groupBy("method", "camera").agg(n.alias("_n"), k.alias("correct"), F.round(fn.ratio(k, F.nullif(F.count(F.when(F.col("accepted"), 1)), F.lit(0))), 4).alias("precision_all_labels"), F.round(fn.ratio(k, F.nullif(n, F.lit(0))), 4).alias("precision_determinable")).withColumnRenamed("_n", "accepted")
