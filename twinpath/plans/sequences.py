"""Queries over mappings and signals: steps, kinks, medians, runs, gaps and onsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import agreement, sequences as seq
from ..sources import adapter
from ..sources.adapter import PAIR, STREAM, with_sql
from .catalog import query

P = "recording, camera"
S = "recording, run, camera"
STEPS = f"""steps AS (SELECT * FROM (SELECT *, runB_frame - lag(runB_frame) OVER w AS increment, lag(runA_frame) OVER w AS previous, lag(runB_frame) OVER w AS previous_value FROM mapping
  WINDOW w AS (PARTITION BY {P} ORDER BY runA_frame)) WHERE runA_frame - previous = 1 AND runB_frame IS NOT NULL AND previous_value IS NOT NULL)
"""


def with_steps(*names: str) -> str:
    return with_sql("mapping", *names).rstrip() + ",\n" + STEPS


def mapping_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.steps(adapter.mapping(spark, sf_dir), PAIR, "runA_frame", "runB_frame")


@query(with_steps() + f"SELECT {P}, runA_frame, previous_value, runB_frame, increment FROM steps")
def first_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of the mapping between adjacent mapped frames."""
    return mapping_steps(spark, sf_dir).select(*PAIR, "runA_frame", "previous_value", "runB_frame", "increment")


@query(with_steps() + f"SELECT {P}, CASE WHEN increment <= 10 THEN CAST(increment AS VARCHAR) ELSE '>10' END AS bucket, count(*) AS n FROM steps GROUP BY ALL")
def step_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of steps, those above ten together."""
    bucket = F.when(F.col("increment") <= 10, F.col("increment").cast("string")).otherwise(">10")
    return mapping_steps(spark, sf_dir).groupBy(*PAIR, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    with_steps()
    + f"""SELECT {P}, count(*) AS n, min(increment) AS least, max(increment) AS most, round(avg(increment), 6) AS mean, quantile_cont(increment, 0.5) AS median, round(quantile_cont(increment, 0.9), 6) AS p90,
  round(quantile_cont(increment, 0.99), 6) AS p99, count(*) FILTER (increment < 0) AS negative FROM steps GROUP BY {P}"""
)
def step_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments and quantiles of steps."""
    q = F.percentile("increment", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99))).alias("_q")
    made = mapping_steps(spark, sf_dir).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"), F.min("increment").alias("least"), F.max("increment").alias("most"), F.round(F.avg("increment"), 6).alias("mean"), q, F.count(F.when(F.col("increment") < 0, 1)).alias("negative"))
    return made.select(*PAIR, "n", "least", "most", "mean", F.get("_q", F.lit(0)).alias("median"), F.round(F.get("_q", F.lit(1)), 6).alias("p90"), F.round(F.get("_q", F.lit(2)), 6).alias("p99"), "negative")


DARK = "dark AS (SELECT recording, camera, run, ordinal FROM flags WHERE flag = 'too_dark')\n"
KINK_ROWS = f"""kinks AS (SELECT s.{P.replace(", ", ", s.")}, s.runA_frame, s.increment,
  EXISTS (SELECT 1 FROM dark d WHERE d.recording = s.recording AND d.camera = s.camera AND d.run = 'runA' AND d.ordinal IN (s.previous, s.runA_frame)) AS dark_a,
  EXISTS (SELECT 1 FROM dark d WHERE d.recording = s.recording AND d.camera = s.camera AND d.run = 'runB' AND d.ordinal BETWEEN s.previous_value AND s.runB_frame) AS dark_b
  FROM steps s WHERE s.increment >= 4)
"""
KINK_SQL = with_steps("flags").rstrip() + ",\n" + DARK.rstrip() + ",\n" + KINK_ROWS


def kinks(spark: SparkSession, sf_dir: str, least: int) -> DataFrame:
    """Steps of at least so much, with darkness on either side; the span in run B is exploded and joined on equal keys."""
    dark = adapter.flags(spark, sf_dir).filter("flag = 'too_dark'").select(*PAIR, "run", F.col("ordinal").alias("frame"))
    found = mapping_steps(spark, sf_dir).filter(F.col("increment") >= least)
    a = F.array(*[F.struct(F.lit("runA").alias("run"), F.col(c).alias("frame")) for c in ("previous", "runA_frame")])
    b = F.transform(F.sequence("previous_value", "runB_frame"), lambda x: F.struct(F.lit("runB").alias("run"), x.alias("frame")))
    looked = found.select(*PAIR, "runA_frame", "increment", F.explode(F.concat(a, b)).alias("at")).select(*PAIR, "runA_frame", "increment", "at.*")
    marked = looked.join(dark.withColumn("_dark", F.lit(True)), [*PAIR, "run", "frame"], "left")
    side = lambda run: F.coalesce(F.bool_or(F.col("_dark") & (F.col("run") == run)), F.lit(False))
    return marked.groupBy(*PAIR, "runA_frame", "increment").agg(side("runA").alias("dark_a"), side("runB").alias("dark_b"))


@query(KINK_SQL + f"SELECT {P}, runA_frame, increment, dark_a, dark_b FROM kinks WHERE increment >= 6")
def kink_rows_dark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinks of six frames and more, and whether either run is dark there."""
    return kinks(spark, sf_dir, 6)


@query(
    KINK_SQL
    + f"""SELECT {P}, threshold, count(*) FILTER (increment >= threshold) AS kinks, count(*) FILTER (increment >= threshold AND NOT (dark_a OR dark_b)) AS lit, count(*) FILTER (increment >= threshold AND (dark_a OR dark_b)) AS dark
FROM kinks, (VALUES (CAST(4 AS BIGINT)), (6), (8), (10)) t(threshold) GROUP BY {P}, threshold"""
)
def kink_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinks at four nested thresholds, lit and dark."""
    rows = kinks(spark, sf_dir, 4).withColumn("threshold", F.explode(F.array(*[F.lit(t).cast("bigint") for t in (4, 6, 8, 10)])))
    over, dark = F.col("increment") >= F.col("threshold"), F.col("dark_a") | F.col("dark_b")
    return rows.groupBy(*PAIR, "threshold").agg(F.count(F.when(over, 1)).alias("kinks"), F.count(F.when(over & ~dark, 1)).alias("lit"), F.count(F.when(over & dark, 1)).alias("dark"))


@query(with_steps() + f"SELECT {P}, count(DISTINCT frame) AS demoted FROM (SELECT {P}, unnest(generate_series(runA_frame - 10, runA_frame + 10)) AS frame FROM steps WHERE increment >= 6) GROUP BY {P}")
def demote_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct frames within ten of a kink."""
    found = agreement.windows(mapping_steps(spark, sf_dir).filter("increment >= 6"), PAIR, "runA_frame", 10)
    return found.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("demoted"))


#: The lag is taken about the median over so many shared frames; half of them are repeated at each edge.
LAG_WIDTH = 201
HALF = LAG_WIDTH // 2
RESIDUAL = f"""shared AS (SELECT a.recording, a.runA_frame AS frame, b.runB_frame - a.runB_frame AS lagged FROM mapping a JOIN mapping b ON a.recording = b.recording AND a.runA_frame = b.runA_frame AND a.camera = 'cam0' AND b.camera = 'cam5'
  WHERE a.runB_frame IS NOT NULL AND b.runB_frame IS NOT NULL),
ends AS (SELECT recording, min(frame) AS f0, max(frame) AS f1, count(*) AS n FROM shared GROUP BY recording),
padded AS (SELECT recording, frame, lagged, 0 AS pad FROM shared UNION ALL
  SELECT s.recording, s.frame, s.lagged, CAST(p AS BIGINT) FROM shared s JOIN ends e ON s.recording = e.recording AND s.frame = e.f0, generate_series(-{HALF}, -1) t(p) UNION ALL
  SELECT s.recording, s.frame, s.lagged, CAST(p AS BIGINT) FROM shared s JOIN ends e ON s.recording = e.recording AND s.frame = e.f1, generate_series(1, {HALF}) t(p)),
medians AS (SELECT recording, frame, lagged, pad, quantile_cont(lagged, 0.5) OVER (PARTITION BY recording ORDER BY frame, pad ROWS BETWEEN {HALF} PRECEDING AND {HALF} FOLLOWING) AS median FROM padded),
residual AS (SELECT m.recording, frame, lagged, median, abs(lagged - median) AS residual FROM medians m JOIN ends e USING (recording) WHERE pad = 0 AND n >= {LAG_WIDTH})
"""
RESIDUAL_SQL = with_sql("mapping").rstrip() + ",\n" + RESIDUAL


def residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = adapter.mapping(spark, sf_dir)
    return agreement.cross_camera_residual(m, ["recording"], "camera", ("cam0", "cam5"), "runA_frame", "runB_frame", LAG_WIDTH)


@query(RESIDUAL_SQL + "SELECT recording, frame, lagged, median, residual FROM residual")
def cross_camera_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disagreement of the two cameras about the running median of their lag."""
    return residual(spark, sf_dir)


@query(
    RESIDUAL_SQL
    + """SELECT recording, min(frame) AS start, max(frame) AS "end", count(*) AS length, max(residual) AS peak FROM
(SELECT *, place - row_number() OVER (PARTITION BY recording ORDER BY frame) AS run FROM (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY frame) AS place FROM residual) WHERE residual >= 2) GROUP BY recording, run"""
)
def disagreement_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of disagreement in the sequence of shared frames."""
    return seq.flagged_runs(residual(spark, sf_dir), ["recording"], "frame", F.col("residual") >= 2, "residual")


@query(
    RESIDUAL_SQL
    + """SELECT recording, rank, start, "end", peak FROM (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY peak DESC, start) AS rank FROM (SELECT recording, min(frame) AS start, max(frame) AS "end", max(residual) AS peak FROM
(SELECT *, place - row_number() OVER (PARTITION BY recording ORDER BY frame) AS run FROM (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY frame) AS place FROM residual) WHERE residual >= 2) GROUP BY recording, run)) WHERE rank <= 10"""
)
def disagreement_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten worst regions of each recording."""
    runs = seq.flagged_runs(residual(spark, sf_dir), ["recording"], "frame", F.col("residual") >= 2, "residual")
    rank = F.row_number().over(Window.partitionBy("recording").orderBy(F.desc("peak"), "start"))
    return runs.withColumn("rank", rank.cast("bigint")).filter("rank <= 10").select("recording", "rank", "start", "end", "peak")


@query(RESIDUAL_SQL + "SELECT recording, count(*) AS shared, quantile_cont(residual, 0.5) AS median, round(quantile_cont(residual, 0.9), 6) AS p90, round(quantile_cont(residual, 0.95), 6) AS p95, max(residual) AS most, round(avg(CASE WHEN residual > 2 THEN 1.0 ELSE 0.0 END), 6) AS large_share FROM residual GROUP BY recording")
def disagreement_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of the disagreement."""
    q = F.percentile("residual", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95))).alias("_q")
    made = residual(spark, sf_dir).groupBy("recording").agg(F.count(F.lit(1)).alias("shared"), q, F.max("residual").alias("most"), F.round(F.avg((F.col("residual") > 2).cast("double")), 6).alias("large_share"))
    return made.select("recording", "shared", F.get("_q", F.lit(0)).alias("median"), F.round(F.get("_q", F.lit(1)), 6).alias("p90"), F.round(F.get("_q", F.lit(2)), 6).alias("p95"), "most", "large_share")


@query(RESIDUAL_SQL + "SELECT recording, frame, max(residual) OVER (PARTITION BY recording ORDER BY frame RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS near_residual FROM residual")
def local_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest disagreement within ten frames."""
    w = Window.partitionBy("recording").orderBy("frame").rangeBetween(-10, 10)
    return residual(spark, sf_dir).select("recording", "frame", F.max("residual").over(w).alias("near_residual"))


SIGNAL = f"""signal AS (SELECT {S}, ordinal, luma, luma - sum(luma) OVER (PARTITION BY {S} ORDER BY ordinal ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) / 15.0 AS residual FROM frames)
"""
SIGNAL_SQL = with_sql("frames").rstrip() + ",\n" + SIGNAL


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = seq.moving_average(adapter.frames(spark, sf_dir).select(*STREAM, "ordinal", "luma"), STREAM, "ordinal", "luma", 15)
    return made.withColumn("residual", F.col("luma") - F.col("average"))


@query(SIGNAL_SQL + f"SELECT {S}, ordinal, round(residual, 6) AS residual FROM signal")
def moving_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal less its moving average over fifteen rows, zeros beyond the edges."""
    return signal(spark, sf_dir).select(*STREAM, "ordinal", F.round("residual", 6).alias("residual"))


EVENTS = f"""spikes AS (SELECT {S}, ordinal FROM (SELECT *, avg(residual) OVER (PARTITION BY {S}) AS m, stddev_pop(residual) OVER (PARTITION BY {S}) AS sd FROM signal) WHERE sd > 0 AND abs(residual - m) > 3 * sd),
merged AS (SELECT {S}, CAST(round_even((min(ordinal) + max(ordinal)) / 2.0, 0) AS BIGINT) AS event, count(*) AS members FROM
  (SELECT *, sum(new) OVER (PARTITION BY {S} ORDER BY ordinal) AS g FROM (SELECT *, CASE WHEN ordinal - lag(ordinal) OVER (PARTITION BY {S} ORDER BY ordinal) <= 3 THEN 0 ELSE 1 END AS new FROM spikes)) GROUP BY {S}, g)
"""
EVENTS_SQL = SIGNAL_SQL.rstrip() + ",\n" + EVENTS


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.merged_events(seq.outliers(signal(spark, sf_dir), STREAM, "residual", 3.0), STREAM, "ordinal", 3)


@query(EVENTS_SQL + f"SELECT {S}, event, members FROM merged")
def event_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outliers of the signal, merged when at most three rows apart."""
    return events(spark, sf_dir)


@query(
    with_sql("frames")
    + f"""SELECT {S}, min(ordinal) FILTER (active >= 6 AND n = 10 AND ordinal >= 30) AS onset FROM
(SELECT *, sum(CASE WHEN luma > 40 THEN 1 ELSE 0 END) OVER w AS active, count(*) OVER w AS n FROM frames WINDOW w AS (PARTITION BY {S} ORDER BY ordinal ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)) GROUP BY {S}"""
)
def persistence_onset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first frame from 30 on with six active frames among ten."""
    return seq.sustained_onset(adapter.frames(spark, sf_dir), STREAM, "ordinal", F.col("luma") > 40, 6, 10, 30)


@query(
    with_sql("frames")
    + f"""SELECT {S}, coalesce(max(ordinal) FILTER (luma >= 2 * m), -1) + 1 AS onset FROM frames JOIN (SELECT {S}, quantile_cont(luma, 0.5) AS m FROM frames GROUP BY {S}) USING ({S}) GROUP BY {S}"""
)
def still_tail_onset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the tail begins in which nothing reaches twice the median."""
    return seq.still_tail(adapter.frames(spark, sf_dir), STREAM, "ordinal", "luma", 2.0)


@query(
    with_sql("flags")
    + f"""SELECT {S}, ordinal, round(CASE WHEN v IS NOT NULL THEN v WHEN v1 IS NULL THEN v0 WHEN v0 IS NOT NULL THEN v0 + (v1 - v0) * (CAST(ordinal - o0 AS DOUBLE) / (o1 - o0)) END, 6) AS filled FROM
(SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(o IGNORE NULLS) OVER b AS o0, first_value(v IGNORE NULLS) OVER a AS v1, first_value(o IGNORE NULLS) OVER a AS o1 FROM
 (SELECT *, CASE WHEN flag = 'ok' THEN luma END AS v, CASE WHEN flag = 'ok' THEN ordinal END AS o FROM flags)
 WINDOW b AS (PARTITION BY {S} ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY {S} ORDER BY ordinal ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
)
def gap_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Luma of dark frames on the line between the lit ones around them."""
    known = adapter.flags(spark, sf_dir).withColumn("v", F.when(F.col("flag") == "ok", F.col("luma")))
    return seq.interpolated(known, STREAM, "ordinal", "v").select(*STREAM, "ordinal", F.round("filled", 6).alias("filled"))


@query(
    with_sql("mapping")
    + f"""SELECT {P}, runA_frame, CASE WHEN takes THEN candidate ELSE runB_frame END AS runB_frame, takes AS bridged FROM
(SELECT *, empty AND size <= 10 AND fit = 1 AND NOT coalesce(stop, false) AS takes FROM
 (SELECT *, count(*) OVER r AS size, min(CASE WHEN low IS NOT NULL AND high IS NOT NULL AND candidate BETWEEN low AND high THEN 1 ELSE 0 END) OVER r AS fit, first_value(status IN ('idle')) OVER (PARTITION BY {P}, gap, empty ORDER BY runA_frame) AS stop FROM
  (SELECT *, last_value(runB_frame IGNORE NULLS) OVER b AS low, first_value(runB_frame IGNORE NULLS) OVER a AS high, sum(CASE WHEN runB_frame IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY {P} ORDER BY runA_frame) AS gap, runB_frame IS NULL AS empty FROM mapping
   WINDOW b AS (PARTITION BY {P} ORDER BY runA_frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY {P} ORDER BY runA_frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  WINDOW r AS (PARTITION BY {P}, gap, empty)))"""
)
def bridge_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short gaps of the mapping filled with candidates that fit between their neighbours."""
    made = seq.bridged(adapter.mapping(spark, sf_dir), PAIR, "runA_frame", "runB_frame", "candidate", 10, F.col("status").isin("idle"))
    return made.select(*PAIR, "runA_frame", "runB_frame", "bridged")


@query(
    with_sql("decisions")
    + f"""SELECT {P}, min(runA_frame) FILTER (checked AND geometry) AS first_pass, max(runA_frame) FILTER (checked AND geometry) AS last_pass, count(*) FILTER (checked) AS checked, count(*) FILTER (checked AND geometry) AS passed,
  greatest(coalesce(max(runA_frame) FILTER (checked AND geometry) - min(runA_frame) FILTER (checked AND geometry) + 1, 0), 0) AS supported FROM decisions GROUP BY {P}"""
)
def support_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The span from the first passing check to the last; a failed check between them does not break it."""
    passed = F.when(F.col("checked") & F.col("geometry"), F.col("runA_frame"))
    return adapter.decisions(spark, sf_dir).groupBy(*PAIR).agg(F.min(passed).alias("first_pass"), F.max(passed).alias("last_pass"), F.count(F.when(F.col("checked"), 1)).alias("checked"), F.count(passed).alias("passed"), F.coalesce(F.max(passed) - F.min(passed) + 1, F.lit(0)).alias("supported"))


@query(with_sql("mapping") + f"SELECT {P}, runA_frame, CASE WHEN runB_frame IS NOT NULL THEN max(runB_frame) OVER (PARTITION BY {P} ORDER BY runA_frame) END AS monotone FROM mapping")
def monotone_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapping made non-decreasing by its running maximum."""
    return seq.running_max(adapter.mapping(spark, sf_dir), PAIR, "runA_frame", "runB_frame", "monotone").select(*PAIR, "runA_frame", "monotone")


PROGRESS = f"""moved AS (SELECT {S}, ordinal, sum(d) OVER (PARTITION BY {S} ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS done FROM
  (SELECT *, coalesce(abs(luma - lag(luma) OVER (PARTITION BY {S} ORDER BY ordinal)), 0.0) AS d FROM frames)),
progress AS (SELECT *, done / nullif(max(done) OVER (PARTITION BY {S}), 0) AS share FROM moved)
"""
PROGRESS_SQL = with_sql("frames", "mapping").rstrip() + ",\n" + PROGRESS


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = adapter.frames(spark, sf_dir)
    moved = f.withColumn("d", F.coalesce(F.abs(F.col("luma") - F.lag("luma").over(seq.ordered(STREAM, "ordinal"))), F.lit(0.0)))
    done = seq.cumulative(moved, STREAM, "ordinal", "d", "done")
    return done.withColumn("share", F.try_divide(F.col("done"), F.max("done").over(Window.partitionBy(*STREAM))))


@query(PROGRESS_SQL + f"SELECT {S}, ordinal, round(done, 6) AS done, round(share, 6) AS share FROM progress")
def cumulative_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motion summed along each stream, and as a share of the whole."""
    return progress(spark, sf_dir).select(*STREAM, "ordinal", F.round("done", 6).alias("done"), F.round("share", 6).alias("share"))


@query(
    PROGRESS_SQL
    + f"""SELECT {P}, count(*) AS n, round(quantile_cont(e, 0.5), 6) AS median, round(quantile_cont(e, 0.9), 6) AS p90, round(max(e), 6) AS most, round(avg(CASE WHEN e > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS over_5_percent FROM
(SELECT {P}, round(abs(a.share - b.share), 9) AS e FROM mapping m JOIN (SELECT {P}, ordinal AS runA_frame, share FROM progress WHERE run = 'runA') a USING ({P}, runA_frame) JOIN (SELECT {P}, ordinal AS runB_frame, share FROM progress WHERE run = 'runB') b USING ({P}, runB_frame)) GROUP BY {P}"""
)
def path_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far apart the two runs' progress is along the mapping."""
    shares = progress(spark, sf_dir)
    side = lambda run, frame, name: shares.filter(F.col("run") == run).select(*PAIR, F.col("ordinal").alias(frame), F.col("share").alias(name))
    m = adapter.mapping(spark, sf_dir).filter("runB_frame IS NOT NULL").select(*PAIR, "runA_frame", "runB_frame")
    joined = m.join(side("runA", "runA_frame", "a"), [*PAIR, "runA_frame"]).join(side("runB", "runB_frame", "b"), [*PAIR, "runB_frame"])
    e = joined.withColumn("e", F.round(F.abs(F.col("a") - F.col("b")), 9))
    made = e.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"), F.percentile("e", F.array(F.lit(0.5), F.lit(0.9))).alias("_q"), F.round(F.max("e"), 6).alias("most"), F.round(F.avg((F.col("e") > 0.05).cast("double")), 6).alias("over_5_percent"))
    return made.select(*PAIR, "n", F.round(F.get("_q", F.lit(0)), 6).alias("median"), F.round(F.get("_q", F.lit(1)), 6).alias("p90"), "most", "over_5_percent")


NODES = f"nodes AS (SELECT {P}, runA_frame AS r0, candidate AS c0, lead(runA_frame) OVER w AS r1, lead(candidate) OVER w AS c1 FROM decisions WHERE runA_frame % 16 = 0 WINDOW w AS (PARTITION BY {P} ORDER BY runA_frame))\n"


@query(
    with_sql("decisions").rstrip() + ",\n" + NODES
    + f"""SELECT {P}, runA_frame, CAST(round_even(CASE WHEN r1 IS NULL THEN c0 ELSE c0 + (c1 - c0) * (CAST(runA_frame - r0 AS DOUBLE) / (r1 - r0)) END, 0) AS BIGINT) AS estimate FROM
(SELECT *, unnest(CASE WHEN r1 IS NULL THEN [r0] ELSE generate_series(r0, r1 - 1) END) AS runA_frame FROM nodes)"""
)
def densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame's estimate on the lines between every sixteenth."""
    nodes = adapter.decisions(spark, sf_dir).filter("runA_frame % 16 = 0")
    return seq.densified(nodes, PAIR, "runA_frame", "candidate")


@query(
    with_sql("decisions")
    + f"""SELECT d.{P.replace(", ", ", d.")}, d.runA_frame, arg_min(n.runA_frame, abs(n.runA_frame - d.runA_frame) * 1000000 + n.runA_frame) AS node FROM decisions d JOIN decisions n ON d.recording = n.recording AND d.camera = n.camera AND n.runA_frame % 50 = 0 AND abs(n.runA_frame - d.runA_frame) <= 50 GROUP BY ALL"""
)
def nearest_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of the coarse nodes, the earlier of two as near."""
    rows = adapter.decisions(spark, sf_dir)
    nodes = rows.filter("runA_frame % 50 = 0").select(*PAIR, F.col("runA_frame").alias("node"))
    return agreement.nearest(rows.select(*PAIR, "runA_frame"), nodes, PAIR, "runA_frame", "node", 50)


@query(
    with_sql("frames")
    + f"""SELECT {S}, arg_max(ordinal, m * 1000000000 - ordinal) AS best_start, round(max(m), 6) AS best_mean, arg_min(ordinal, m * 1000000000 + ordinal) AS worst_start, round(min(m), 6) AS worst_mean FROM
(SELECT *, round(avg(luma) OVER w, 6) AS m, count(*) OVER w AS n FROM frames WINDOW w AS (PARTITION BY {S} ORDER BY ordinal ROWS BETWEEN CURRENT ROW AND 99 FOLLOWING)) WHERE n = 100 GROUP BY {S}"""
)
def segment_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of a hundred frames with the best and the worst mean; the first of equals."""
    w = seq.ordered(STREAM, "ordinal").rowsBetween(0, 99)
    slid = adapter.frames(spark, sf_dir).withColumn("m", F.round(F.avg("luma").over(w), 6)).withColumn("n", F.count(F.lit(1)).over(w)).filter("n = 100")
    return slid.groupBy(*STREAM).agg(F.max_by("ordinal", F.struct("m", -F.col("ordinal"))).alias("best_start"), F.round(F.max("m"), 6).alias("best_mean"), F.min_by("ordinal", F.struct("m", "ordinal")).alias("worst_start"), F.round(F.min("m"), 6).alias("worst_mean"))


@query(
    with_sql("frames")
    + f"""SELECT {S}, count(*) AS frames, count(*) FILTER (present) AS present FROM (SELECT n.{S.replace(", ", ", n.")}, f.ordinal IS NOT NULL AS present FROM
(SELECT {S}, unnest(generate_series(0, max(ordinal))) AS ordinal FROM frames GROUP BY {S}) n LEFT JOIN (SELECT * FROM frames WHERE ordinal % 9 <> 4) f ON n.recording = f.recording AND n.run = f.run AND n.camera = f.camera AND n.ordinal = f.ordinal) GROUP BY {S}"""
)
def spine_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams with missing rows completed to every ordinal."""
    f = adapter.frames(spark, sf_dir)
    lengths = f.groupBy(*STREAM).agg((F.max("ordinal") + 1).alias("n"))
    full = seq.completed(f.filter("ordinal % 9 <> 4").select(*STREAM, "ordinal", F.lit(True).alias("present")), lengths, STREAM, "ordinal", "n")
    return full.groupBy(*STREAM).agg(F.count(F.lit(1)).alias("frames"), F.count("present").alias("present"))


OTSU = f"""ends AS (SELECT {S}, min(luma) AS lo, max(luma) AS hi FROM frames GROUP BY {S}),
binned AS (SELECT {S}, lo, hi, CAST(CASE WHEN hi > lo THEN least(floor((luma - lo) / (hi - lo) * 256), 255) ELSE 0 END AS BIGINT) AS bin, count(*) AS n FROM frames JOIN ends USING ({S}) GROUP BY ALL),
sums AS (SELECT *, sum(n) OVER u AS w0, sum(n * bin) OVER u AS s0, sum(n) OVER a AS w, sum(n * bin) OVER a AS s FROM binned WINDOW u AS (PARTITION BY {S} ORDER BY bin ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY {S})),
scored AS (SELECT *, coalesce(round(CAST(w0 AS DOUBLE) * (w - w0) * pow(CAST(s0 AS DOUBLE) / w0 - CAST(s - s0 AS DOUBLE) / nullif(w - w0, 0), 2), 3), 0.0) AS between_classes FROM sums)
"""


@query(with_sql("frames").rstrip() + ",\n" + OTSU + f"SELECT {S}, bin AS threshold_bin, round(lo + (bin + 1) * (hi - lo) / 256, 4) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY {S} ORDER BY between_classes DESC, bin) AS r FROM scored) WHERE r = 1")
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The luma that parts each stream's histogram into two classes best."""
    return seq.otsu(adapter.frames(spark, sf_dir), STREAM, "luma").select(*STREAM, "threshold_bin", F.round("threshold", 4).alias("threshold"))
