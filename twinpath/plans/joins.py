"""Queries that join mappings, flags, labels and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import agreement, sequences as seq
from ..sources import adapter
from ..sources.adapter import PAIR, with_sql
from .catalog import query
from .sequences import EVENTS_SQL, P, S, events, mapping_steps, with_steps

DEMOTED = f"demoted AS (SELECT DISTINCT {P}, unnest(generate_series(runA_frame - 10, runA_frame + 10)) AS runA_frame FROM steps WHERE increment >= 6)\n"


def kink_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping_steps(spark, sf_dir).filter("increment >= 6")


@query(
    with_steps("labels_v").rstrip() + ",\n" + DEMOTED
    + f"""SELECT {P}, count(*) AS labels, count(*) FILTER (mapped) AS accepted_before, count(*) FILTER (hit) AS correct_before, count(*) FILTER (mapped AND NOT gate) AS accepted_after, count(*) FILTER (hit AND NOT gate) AS correct_after,
  round(count(*) FILTER (hit) / CAST(nullif(count(*) FILTER (mapped), 0) AS DOUBLE), 4) AS precision_before, round(count(*) FILTER (hit AND NOT gate) / CAST(nullif(count(*) FILTER (mapped AND NOT gate), 0) AS DOUBLE), 4) AS precision_after
FROM (SELECT l.{P.replace(", ", ", l.")}, m.runB_frame IS NOT NULL AS mapped, coalesce(m.runB_frame BETWEEN l.low AND l.high, false) AS hit, d.runA_frame IS NOT NULL AS gate
  FROM labels_v l JOIN mapping m USING ({P}, runA_frame) LEFT JOIN demoted d USING ({P}, runA_frame) WHERE l.label = 'match') GROUP BY {P}"""
)
def slope_gate_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What refusing the frames near kinks costs in coverage and gains in precision."""
    m = adapter.mapping(spark, sf_dir).select(*PAIR, "runA_frame", "runB_frame")
    rows = adapter.labels(spark, sf_dir).filter("label = 'match'").join(m, [*PAIR, "runA_frame"])
    rows = agreement.near(rows, kink_steps(spark, sf_dir).withColumnRenamed("runA_frame", "kink"), PAIR, "runA_frame", "kink", 10, "gate")
    mapped, hit, free = F.col("runB_frame").isNotNull(), F.coalesce(F.col("runB_frame").between(F.col("low"), F.col("high")), F.lit(False)), ~F.col("gate")
    n = lambda c: F.count(F.when(c, 1))
    return rows.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("labels"), n(mapped).alias("accepted_before"), n(hit).alias("correct_before"), n(mapped & free).alias("accepted_after"), n(hit & free).alias("correct_after"),
        F.round(scores.ratio(n(hit), n(mapped)), 4).alias("precision_before"), F.round(scores.ratio(n(hit & free), n(mapped & free)), 4).alias("precision_after"),
    )


@query(
    with_steps("labels_v").rstrip() + ",\n"
    + f"""judged AS (SELECT l.{P.replace(", ", ", l.")}, l.runA_frame, m.runB_frame, CASE WHEN m.runB_frame IS NOT NULL THEN greatest(low - m.runB_frame, m.runB_frame - high, 0) END AS distance,
  EXISTS (SELECT 1 FROM steps s WHERE s.recording = l.recording AND s.camera = l.camera AND s.increment >= 6 AND abs(s.runA_frame - l.runA_frame) <= 15) AS near FROM labels_v l JOIN mapping m USING ({P}, runA_frame) WHERE l.label = 'match')
SELECT {P}, CASE WHEN near THEN 'near' ELSE 'away' END AS side, count(*) FILTER (distance IS NOT NULL) AS n, count(*) FILTER (distance IS NULL) AS abstained, count(*) FILTER (distance > 0) AS misses,
  round(count(*) FILTER (distance > 0) / CAST(nullif(count(*) FILTER (distance IS NOT NULL), 0) AS DOUBLE), 4) AS miss_rate, quantile_cont(distance, 0.5) AS median, max(distance) AS most FROM judged GROUP BY ALL"""
)
def near_away_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misses of labels within fifteen frames of a kink, and of the others."""
    m = adapter.mapping(spark, sf_dir).select(*PAIR, "runA_frame", "runB_frame")
    rows = adapter.labels(spark, sf_dir).filter("label = 'match'").join(m, [*PAIR, "runA_frame"])
    rows = agreement.near(rows, kink_steps(spark, sf_dir).withColumnRenamed("runA_frame", "kink"), PAIR, "runA_frame", "kink", 15)
    rows = rows.withColumn("distance", scores.interval_distance(F.col("runB_frame"), F.col("low"), F.col("high")))
    n, misses = F.count("distance"), F.count(F.when(F.col("distance") > 0, 1))
    side = F.when(F.col("near"), "near").otherwise("away").alias("side")
    return rows.groupBy(*PAIR, side).agg(n.alias("n"), F.count(F.when(F.col("distance").isNull(), 1)).alias("abstained"), misses.alias("misses"), F.round(scores.ratio(misses, n), 4).alias("miss_rate"), F.percentile("distance", F.lit(0.5)).alias("median"), F.max("distance").alias("most"))


TWO_FLAGS = f"""judged AS (SELECT m.{P.replace(", ", ", m.")}, m.runA_frame, a.flag = 'too_dark' AS dark_a, coalesce(b.flag = 'too_dark', false) AS dark_b FROM mapping m
  JOIN flags a ON a.recording = m.recording AND a.camera = m.camera AND a.run = 'runA' AND a.ordinal = m.runA_frame
  LEFT JOIN flags b ON b.recording = m.recording AND b.camera = m.camera AND b.run = 'runB' AND b.ordinal = m.runB_frame WHERE m.runB_frame IS NOT NULL)
"""


@query(with_sql("mapping", "flags").rstrip() + ",\n" + TWO_FLAGS + f"SELECT {P}, count(*) AS accepted, count(*) FILTER (dark_a) AS dark_a, count(*) FILTER (dark_b) AS dark_b, count(*) FILTER (dark_a AND dark_b) AS dark_both, count(*) FILTER (dark_a OR dark_b) AS dark_either FROM judged GROUP BY {P}")
def flag_cross_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted rows of the mapping that are dark in either run."""
    f = adapter.flags(spark, sf_dir).select(*PAIR, "run", "ordinal", (F.col("flag") == "too_dark").alias("dark"))
    side = lambda run, frame, name: f.filter(F.col("run") == run).select(*PAIR, F.col("ordinal").alias(frame), F.col("dark").alias(name))
    m = adapter.mapping(spark, sf_dir).filter("runB_frame IS NOT NULL").select(*PAIR, "runA_frame", "runB_frame")
    rows = m.join(side("runA", "runA_frame", "a"), [*PAIR, "runA_frame"]).join(side("runB", "runB_frame", "b"), [*PAIR, "runB_frame"], "left")
    a, b = F.col("a"), F.coalesce("b", F.lit(False))
    n = lambda c: F.count(F.when(c, 1))
    return rows.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("accepted"), n(a).alias("dark_a"), n(b).alias("dark_b"), n(a & b).alias("dark_both"), n(a | b).alias("dark_either"))


@query(
    with_sql("mapping", "flags", "labels_v")
    + f"""SELECT l.query_id, m.runB_frame AS predicted, l.preferred, coalesce(p.flag = 'too_dark', false) AS dark_predicted, coalesce(q.flag = 'too_dark', false) AS dark_preferred FROM labels_v l JOIN mapping m USING ({P}, runA_frame)
LEFT JOIN flags p ON p.recording = m.recording AND p.camera = m.camera AND p.run = 'runB' AND p.ordinal = m.runB_frame LEFT JOIN flags q ON q.recording = m.recording AND q.camera = m.camera AND q.run = 'runB' AND q.ordinal = l.preferred
WHERE p.flag = 'too_dark' OR q.flag = 'too_dark'"""
)
def label_flag_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels whose predicted or preferred frame is dark."""
    dark = adapter.flags(spark, sf_dir).filter("run = 'runB' AND flag = 'too_dark'")
    at = lambda frame, name: dark.select(*PAIR, F.col("ordinal").alias(frame), F.lit(True).alias(name))
    m = adapter.mapping(spark, sf_dir).select(*PAIR, "runA_frame", F.col("runB_frame").alias("predicted"))
    rows = adapter.labels(spark, sf_dir).join(m, [*PAIR, "runA_frame"]).join(at("predicted", "dark_predicted"), [*PAIR, "predicted"], "left").join(at("preferred", "dark_preferred"), [*PAIR, "preferred"], "left")
    p, q = F.coalesce("dark_predicted", F.lit(False)), F.coalesce("dark_preferred", F.lit(False))
    return rows.filter(p | q).select("query_id", "predicted", "preferred", p.alias("dark_predicted"), q.alias("dark_preferred"))


@query(with_sql("mapping") + f"SELECT {P}, count(*) AS rows, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS sharing, max(n) AS most, round(avg(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END), 6) AS share, round(sum(1.0 / n), 6) AS weight FROM (SELECT *, count(*) OVER (PARTITION BY {P}, runB_frame) AS n FROM mapping WHERE runB_frame IS NOT NULL) GROUP BY {P}")
def partner_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows share a partner: the partner is no key. Counts by partner come first, so no window over rows is needed."""
    counted = adapter.mapping(spark, sf_dir).filter("runB_frame IS NOT NULL").groupBy(*PAIR, "runB_frame").agg(F.count(F.lit(1)).alias("n"))
    shared = F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))
    return counted.groupBy(*PAIR).agg(F.sum("n").alias("rows"), shared.alias("sharing"), F.max("n").alias("most"), F.round(scores.ratio(shared, F.sum("n")), 6).alias("share"), F.count(F.lit(1)).cast("double").alias("weight"))


@query(
    with_sql("flags", "mapping")
    + f"""SELECT f.recording, f.camera, frames, dark, coalesce(mapped, 0) AS mapped, frames - coalesce(mapped, 0) AS unmapped, round(coalesce(mapped, 0) / CAST(frames AS DOUBLE), 4) AS coverage FROM
(SELECT recording, camera, count(*) FILTER (run = 'runA') AS frames, count(*) FILTER (run = 'runA' AND flag = 'too_dark') AS dark FROM flags GROUP BY ROLLUP (recording, camera)) f
LEFT JOIN (SELECT recording, camera, count(runB_frame) AS mapped FROM mapping GROUP BY ROLLUP (recording, camera)) m ON f.recording IS NOT DISTINCT FROM m.recording AND f.camera IS NOT DISTINCT FROM m.camera"""
)
def policy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames, dark and mapped frames of each recording and camera, with totals by roll-up; one aggregation of one union."""
    f = adapter.flags(spark, sf_dir).filter("run = 'runA'").select(*PAIR, F.lit(1).alias("frame"), (F.col("flag") == "too_dark").cast("int").alias("dark"), F.lit(0).alias("mapped"))
    m = adapter.mapping(spark, sf_dir).select(*PAIR, F.lit(0).alias("frame"), F.lit(0).alias("dark"), F.col("runB_frame").isNotNull().cast("int").alias("mapped"))
    made = f.unionByName(m).rollup(*PAIR).agg(F.sum("frame").alias("frames"), F.sum("dark").alias("dark"), F.sum("mapped").alias("mapped"))
    return made.select(*PAIR, "frames", "dark", "mapped", (F.col("frames") - F.col("mapped")).alias("unmapped"), F.round(scores.ratio(F.col("mapped"), F.col("frames")), 4).alias("coverage"))


TIER = "CASE WHEN margins[4] > 0 AND positive >= 4 THEN 'strong' WHEN margins[4] > 0 AND positive >= 3 THEN 'supported' ELSE 'failed' END"


@query(
    with_sql("decisions")
    + f"""SELECT {P}, runA_frame, tier, CASE WHEN idle THEN 'idle' WHEN runA_frame < 30 THEN 'out_of_route' WHEN tier = 'failed' AND (candidate < 0.12 * n_b OR candidate >= 0.88 * n_b) THEN 'loop_ambiguous' WHEN tier = 'failed' THEN 'sequence_failed' WHEN NOT geometry THEN 'geometry_failed' ELSE 'accepted' END AS status
FROM (SELECT *, {TIER} AS tier FROM (SELECT *, len(list_filter(margins, lambda x: x > 0)) AS positive FROM decisions))"""
)
def decision_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accept or one typed refusal for each frame, in order."""
    rows = adapter.decisions(spark, sf_dir).withColumn("tier", scores.sequence_tier(F.col("margins")))
    failed = F.col("tier") == "failed"
    ends = (F.col("candidate") < 0.12 * F.col("n_b")) | (F.col("candidate") >= 0.88 * F.col("n_b"))
    status = agreement.ladder([("idle", F.col("idle")), ("out_of_route", F.col("runA_frame") < 30), ("loop_ambiguous", failed & ends), ("sequence_failed", failed), ("geometry_failed", ~F.col("geometry"))])
    return rows.select(*PAIR, "runA_frame", "tier", status.alias("status"))


@query(
    with_sql("mapping").rstrip()
    + EVENTS_SQL.removeprefix(with_sql("frames").rstrip())
    + f"""SELECT m.{P.replace(", ", ", m.")}, m.runA_frame, arg_min(e.event, abs(e.event - m.runB_frame) * 1000000 + e.event) AS event FROM mapping m JOIN merged e ON e.recording = m.recording AND e.camera = m.camera AND e.run = 'runB' AND abs(e.event - m.runB_frame) <= 15 GROUP BY ALL"""
)
def nearest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event of run B nearest to each partner, within fifteen frames."""
    b = events(spark, sf_dir).filter("run = 'runB'").select(*PAIR, "event")
    m = adapter.mapping(spark, sf_dir).filter("runB_frame IS NOT NULL").select(*PAIR, "runA_frame", "runB_frame")
    found = agreement.nearest(m, b, PAIR, "runB_frame", "event", 15)
    return m.join(found, [*PAIR, "runB_frame"]).select(*PAIR, "runA_frame", "event")


@query(with_sql("mapping", "lengths") + f"SELECT {P}, runB_frame FROM (SELECT {P}, unnest(generate_series(0, n_b - 1)) AS runB_frame FROM lengths WHERE n_b > 0) ANTI JOIN mapping USING ({P}, runB_frame)")
def anti_join_missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of run B that no row of the mapping reaches."""
    m = adapter.mapping(spark, sf_dir)
    wanted = m.groupBy(*PAIR).agg(F.first("n_b").alias("n_b")).filter("n_b > 0").select(*PAIR, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_b") - 1)).alias("runB_frame"))
    return agreement.missing_keys(wanted, m.filter("runB_frame IS NOT NULL"), [*PAIR, "runB_frame"])


@query(
    with_sql("flags").rstrip() + ",\n"
    + f"""islands AS (SELECT {S}, min(ordinal) AS start, max(ordinal) AS "end" FROM (SELECT *, ordinal - row_number() OVER (PARTITION BY {S} ORDER BY ordinal) AS g FROM flags WHERE flag = 'too_dark') GROUP BY {S}, g HAVING count(*) >= 3)
SELECT {S}, start, "end" FROM islands WHERE start <= 200 + 50 * recording AND "end" >= 100 + 50 * recording"""
)
def exposure_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dark stretches that overlap the recording's occlusion window."""
    stretches = seq.islands(adapter.flags(spark, sf_dir).filter("flag = 'too_dark'"), ["recording", "run", "camera"], "ordinal", 3)
    spans = stretches.select("recording").distinct().select("recording", (100 + 50 * F.col("recording")).alias("low"), (200 + 50 * F.col("recording")).alias("high"))
    return agreement.overlapping(stretches, spans, ["recording"]).select("recording", "run", "camera", "start", "end")


@query(with_sql("mapping") + f"SELECT {P}, status, count(*) AS n, count(runB_frame) AS mapped, round(count(*) / sum(count(*)) OVER (PARTITION BY {P}), 6) AS share FROM mapping GROUP BY {P}, status")
def coverage_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each status and their share."""
    counted = adapter.mapping(spark, sf_dir).groupBy(*PAIR, "status").agg(F.count(F.lit(1)).alias("n"), F.count("runB_frame").alias("mapped"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*PAIR)), 6))


@query(
    with_sql("mapping")
    + """SELECT recording, count(*) AS both_, count(*) FILTER (a = b) AS equal, count(*) FILTER (abs(a - b) > 2) AS apart FROM (SELECT recording, runA_frame, max(runB_frame) FILTER (camera = 'cam0') AS a, max(runB_frame) FILTER (camera = 'cam5') AS b FROM mapping GROUP BY recording, runA_frame) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY recording"""
)
def key_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that both cameras map."""
    m = adapter.mapping(spark, sf_dir).groupBy("recording", "runA_frame").pivot("camera", ["cam0", "cam5"]).agg(F.max("runB_frame")).filter("cam0 IS NOT NULL AND cam5 IS NOT NULL")
    return m.groupBy("recording").agg(F.count(F.lit(1)).alias("both_"), F.count(F.when(F.col("cam0") == F.col("cam5"), 1)).alias("equal"), F.count(F.when(F.abs(F.col("cam0") - F.col("cam5")) > 2, 1)).alias("apart"))
