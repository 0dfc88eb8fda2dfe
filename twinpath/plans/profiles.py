"""Queries over streams of frames: flags, summaries, cadence and picture order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import histogram_text
from ..operators import sequences as seq
from ..sources import adapter
from ..sources.adapter import STREAM, with_sql
from .catalog import query

KEYS = "recording, run, camera"
ISLANDS = f"""islands AS (SELECT {KEYS}, min(ordinal) AS start, max(ordinal) AS "end", count(*) AS length FROM
  (SELECT *, ordinal - row_number() OVER (PARTITION BY {KEYS} ORDER BY ordinal) AS g FROM flags WHERE flag = 'too_dark') GROUP BY {KEYS}, g HAVING count(*) >= 3)
"""


@query(with_sql("flags") + f"SELECT {KEYS}, ordinal, luma, p99, flag FROM flags")
def luma_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure flag of each frame."""
    return adapter.flags(spark, sf_dir)


@query(with_sql("flags").rstrip() + ",\n" + ISLANDS + f'SELECT {KEYS}, start, "end", length FROM islands')
def dark_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of at least three dark frames."""
    return seq.islands(adapter.flags(spark, sf_dir).filter("flag = 'too_dark'"), STREAM, "ordinal", 3)


@query(
    with_sql("flags").rstrip() + ",\n" + ISLANDS
    + f"""SELECT {KEYS}, frames, dark, round(dark / CAST(frames AS DOUBLE), 6) AS dark_fraction, round(median_luma, 6) AS median_luma, min_luma, coalesce(stretches, 0) AS stretches, coalesce(longest, 0) AS longest
FROM (SELECT {KEYS}, count(*) AS frames, count(*) FILTER (flag = 'too_dark') AS dark, quantile_cont(luma, 0.5) AS median_luma, min(luma) AS min_luma FROM flags GROUP BY {KEYS})
LEFT JOIN (SELECT {KEYS}, count(*) AS stretches, max(length) AS longest FROM islands GROUP BY {KEYS}) USING ({KEYS})"""
)
def stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames, dark share, luma and dark stretches of each stream; one partitioning by stream serves all of it."""
    flags = adapter.flags(spark, sf_dir)
    w = Window.partitionBy(*STREAM, "flag").orderBy("ordinal")
    numbered = flags.withColumn("_island", F.when(F.col("flag") == "too_dark", F.col("ordinal") - F.row_number().over(w)))
    sized = numbered.withColumn("_length", F.when(F.col("flag") == "too_dark", F.count(F.lit(1)).over(Window.partitionBy(*STREAM, "flag", "_island"))))
    long = F.col("_length") >= 3
    made = sized.groupBy(*STREAM).agg(
        F.count(F.lit(1)).alias("frames"),
        F.count(F.when(F.col("flag") == "too_dark", 1)).alias("dark"),
        F.round(F.percentile("luma", F.lit(0.5)), 6).alias("median_luma"),
        F.min("luma").alias("min_luma"),
        F.size(F.collect_set(F.when(long, F.col("_island")))).cast("bigint").alias("stretches"),
        F.coalesce(F.max(F.when(long, F.col("_length"))), F.lit(0)).cast("bigint").alias("longest"),
    )
    return made.select(*STREAM, "frames", "dark", F.round(F.col("dark") / F.col("frames"), 6).alias("dark_fraction"), "median_luma", "min_luma", "stretches", "longest")


@query(with_sql("flags") + f"SELECT {KEYS}, count(*) FILTER (flag = 'ok') AS ok, count(*) FILTER (flag = 'too_dark') AS too_dark FROM flags GROUP BY {KEYS}")
def flag_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of each stream, one column for each."""
    return adapter.flags(spark, sf_dir).groupBy(*STREAM).pivot("flag", ["ok", "too_dark"]).count().na.fill(0, ["ok", "too_dark"])


@query(
    with_sql("frames")
    + f"""SELECT {KEYS}, n, span_us, round((n - 1) / (span_us / 1000000.0), 6) AS mean_hz, not_increasing, largest_gap_us, n - distinct_ts AS duplicates
FROM (SELECT {KEYS}, count(*) AS n, max(us) - min(us) AS span_us, count(*) FILTER (d <= 0) AS not_increasing, max(d) AS largest_gap_us, count(DISTINCT us) AS distinct_ts
  FROM (SELECT *, us - lag(us) OVER (PARTITION BY {KEYS} ORDER BY ordinal) AS d FROM (SELECT *, epoch_us(ts) AS us FROM frames)) GROUP BY {KEYS}) WHERE n > 1"""
)
def cadence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cadence of each stream's timestamps: span, mean rate, steps that don't increase, the largest gap, duplicates."""
    timed = adapter.frames(spark, sf_dir).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    stepped = timed.withColumn("d", F.col("us") - F.lag("us").over(seq.ordered(STREAM, "ordinal")))
    made = stepped.groupBy(*STREAM).agg(F.count(F.lit(1)).alias("n"), (F.max("us") - F.min("us")).alias("span_us"), F.count(F.when(F.col("d") <= 0, 1)).alias("not_increasing"), F.max("d").alias("largest_gap_us"), F.countDistinct("us").alias("_distinct"))
    rate = F.round((F.col("n") - 1) / (F.col("span_us") / F.lit(1e6)), 6)
    return made.filter("n > 1").select(*STREAM, "n", "span_us", rate.alias("mean_hz"), "not_increasing", "largest_gap_us", (F.col("n") - F.col("_distinct")).alias("duplicates"))


@query(
    with_sql("frames")
    + f"""SELECT {KEYS}, count(*) AS n, round(quantile_cont(luma, 0.5), 6) AS median, round(quantile_cont(luma, 0.9), 6) AS p90, round(quantile_cont(luma, 0.95), 6) AS p95, max(luma) AS "max",
  count(*) FILTER (luma <= 1) AS within_1, count(*) FILTER (luma <= 2) AS within_2, round(avg(luma), 6) AS mean, round(stddev_pop(luma), 6) AS sd,
  round(count(*) FILTER (luma = 0) / CAST(count(*) AS DOUBLE), 6) AS zero_fraction FROM frames GROUP BY {KEYS}"""
)
def value_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles and moments of each stream."""
    q = F.percentile("luma", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95))).alias("_q")
    made = adapter.frames(spark, sf_dir).groupBy(*STREAM).agg(F.count(F.lit(1)).alias("n"), q, F.max("luma").alias("max"), F.count(F.when(F.col("luma") <= 1, 1)).alias("within_1"), F.count(F.when(F.col("luma") <= 2, 1)).alias("within_2"), F.round(F.avg("luma"), 6).alias("mean"), F.round(F.stddev_pop("luma"), 6).alias("sd"), F.round(F.avg((F.col("luma") == 0).cast("double")), 6).alias("zero_fraction"))
    quantiles = [F.round(F.get("_q", F.lit(i)), 6).alias(n) for i, n in enumerate(("median", "p90", "p95"))]
    return made.select(*STREAM, "n", *quantiles, "max", "within_1", "within_2", "mean", "sd", "zero_fraction")


#: Pictures by arithmetic: groups of twelve, in each the order of a four-frame pyramid.
PICTURES = f"""pictures AS (SELECT {KEYS}, ordinal AS decode_index, ordinal % 12 = 0 AS is_idr, event_type AS slice_type,
  (ordinal % 12) // 4 * 4 + CASE ordinal % 4 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS poc FROM frames),
gops AS (SELECT *, sum(CASE WHEN is_idr THEN 1 ELSE 0 END) OVER (PARTITION BY {KEYS} ORDER BY decode_index) AS gop FROM pictures)
"""


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = adapter.frames(spark, sf_dir).selectExpr(*STREAM, "ordinal AS decode_index", "ordinal % 12 = 0 AS is_idr", "event_type AS slice_type", "(ordinal % 12) div 4 * 4 + CASE ordinal % 4 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS poc")
    return made.withColumn("gop", F.sum(F.col("is_idr").cast("int")).over(seq.ordered(STREAM, "decode_index")))


@query(with_sql("frames").rstrip() + ",\n" + PICTURES + f"SELECT {KEYS}, length, count(*) AS gops FROM (SELECT {KEYS}, gop, count(*) AS length FROM gops GROUP BY {KEYS}, gop) GROUP BY {KEYS}, length")
def gop_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of the segments between key pictures."""
    return pictures(spark, sf_dir).groupBy(*STREAM, "gop").agg(F.count(F.lit(1)).alias("length")).groupBy(*STREAM, "length").agg(F.count(F.lit(1)).alias("gops"))


@query(
    with_sql("frames").rstrip() + ",\n" + PICTURES
    + f"SELECT {KEYS}, decode_index, row_number() OVER (PARTITION BY {KEYS} ORDER BY gop, poc) - 1 AS display_index FROM gops"
)
def display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display rank of each picture: by group, then by picture order count."""
    rank = F.row_number().over(Window.partitionBy(*STREAM).orderBy("gop", "poc")) - 1
    return pictures(spark, sf_dir).select(*STREAM, "decode_index", rank.cast("bigint").alias("display_index"))


@query(
    with_sql("frames").rstrip() + ",\n" + PICTURES
    + f"""SELECT {KEYS}, count(*) AS pictures, count(*) FILTER (is_idr) AS key_pictures, count(*) FILTER (display_index <> decode_index) AS reordered, bool_and(unique_poc) AS unique_poc, min(display_index) = 0 AND max(display_index) = count(*) - 1 AND count(DISTINCT display_index) = count(*) AS permutation
FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY gop, poc) - 1 AS display_index, count(*) OVER (PARTITION BY {KEYS}, gop, poc) = 1 AS unique_poc FROM gops) GROUP BY {KEYS}"""
)
def permutation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether display order is a permutation, and how many pictures it moves."""
    rank = (F.row_number().over(Window.partitionBy(*STREAM).orderBy("gop", "poc")) - 1).cast("bigint")
    made = pictures(spark, sf_dir).withColumn("display_index", rank).withColumn("_unique", F.count(F.lit(1)).over(Window.partitionBy(*STREAM, "gop", "poc")) == 1)
    n = F.count(F.lit(1))
    return made.groupBy(*STREAM).agg(
        n.alias("pictures"),
        F.count(F.when(F.col("is_idr"), 1)).alias("key_pictures"),
        F.count(F.when(F.col("display_index") != F.col("decode_index"), 1)).alias("reordered"),
        F.bool_and("_unique").alias("unique_poc"),
        ((F.min("display_index") == 0) & (F.max("display_index") == n - 1) & (F.countDistinct("display_index") == n)).alias("permutation"),
    )


@query(
    with_sql("frames").rstrip() + ",\n" + PICTURES
    + f"SELECT {KEYS}, CAST(sum(n) AS BIGINT) AS pictures, string_agg(slice_type || '=' || n, ';' ORDER BY slice_type) AS slice_types FROM (SELECT {KEYS}, slice_type, count(*) AS n FROM gops GROUP BY {KEYS}, slice_type) GROUP BY {KEYS}"
)
def bitstream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory of each stream, its histogram of slice types as text."""
    counted = pictures(spark, sf_dir).groupBy(*STREAM, "slice_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*STREAM).agg(F.sum("n").alias("pictures"), histogram_text(F.map_from_entries(F.collect_list(F.struct("slice_type", "n")))).alias("slice_types"))


@query(with_sql("flags") + f"SELECT {KEYS}, CASE WHEN ordinal < 30 THEN 'parked' WHEN ordinal < 60 THEN 'transition' ELSE 'route' END AS phase, count(*) AS frames, min(ordinal) AS first_frame FROM flags GROUP BY ALL")
def phase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by phase, in half-open ranges."""
    from ..functions.scores import route_phase

    phase = route_phase(F.col("ordinal"), F.lit(30), F.lit(60))
    return adapter.flags(spark, sf_dir).groupBy(*STREAM, phase.alias("phase")).agg(F.count(F.lit(1)).alias("frames"), F.min("ordinal").alias("first_frame"))


@query(
    with_sql("flags")
    + f"""SELECT {KEYS}, string_agg(CASE WHEN s = e THEN CAST(s AS VARCHAR) ELSE s || '-' || e END, ',' ORDER BY s) AS ranges FROM
(SELECT {KEYS}, min(ordinal) AS s, max(ordinal) AS e FROM (SELECT *, ordinal - row_number() OVER (PARTITION BY {KEYS} ORDER BY ordinal) AS g FROM flags WHERE flag = 'too_dark') GROUP BY {KEYS}, g) GROUP BY {KEYS}"""
)
def dark_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dark frames of each stream as a list of ranges."""
    return seq.range_text(adapter.flags(spark, sf_dir).filter("flag = 'too_dark'"), STREAM, "ordinal")
