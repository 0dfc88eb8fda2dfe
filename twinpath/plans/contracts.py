"""Queries that check contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import contracts
from ..sources import adapter
from ..sources.adapter import PAIR, STREAM, with_sql
from .catalog import query
from .sequences import P, S


@query(
    with_sql("mapping")
    + f"""SELECT {P}, count(*) AS rows, count(*) FILTER (runA_frame = before) AS duplicate_keys, count(*) FILTER (place <> runA_frame) AS key_gaps, count(*) FILTER (coalesce(trim(status), '') = '') AS blank_status, count(*) FILTER (runB_frame < last) AS decreasing FROM
(SELECT *, row_number() OVER w - 1 AS place, lag(runA_frame) OVER w AS before, last_value(runB_frame IGNORE NULLS) OVER (PARTITION BY {P} ORDER BY runA_frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM mapping WINDOW w AS (PARTITION BY {P} ORDER BY runA_frame)) GROUP BY {P}"""
)
def mapping_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys without gap or duplicate, a status everywhere, partners that don't decrease."""
    return contracts.mapping_contract(adapter.mapping(spark, sf_dir), PAIR, "runA_frame", "runB_frame", "status")


@query(
    with_sql("labels_v")
    + """SELECT query_id, rule FROM (SELECT query_id, unnest(CASE WHEN low > high THEN ['empty_interval'] ELSE [] END || CASE WHEN preferred NOT BETWEEN low AND high THEN ['preferred_outside'] ELSE [] END || CASE WHEN low < 0 THEN ['out_of_range'] ELSE [] END || CASE WHEN label = 'no_correspondence' AND runA_frame % 20 = 15 THEN ['answer_on_abstention'] ELSE [] END || CASE WHEN label NOT IN ('match', 'no_correspondence') THEN ['vocabulary'] ELSE [] END) AS rule FROM labels_v)"""
)
def label_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that labels break, some by construction here."""
    rules = [
        ("empty_interval", F.col("low") > F.col("high")),
        ("preferred_outside", ~F.col("preferred").between(F.col("low"), F.col("high"))),
        ("out_of_range", F.col("low") < 0),
        ("answer_on_abstention", (F.col("label") == "no_correspondence") & (F.col("runA_frame") % 20 == 15)),
        ("vocabulary", ~F.col("label").isin("match", "no_correspondence")),
    ]
    return contracts.violations(adapter.labels(spark, sf_dir), "query_id", rules)


@query(
    """WITH frozen AS (SELECT p_partkey AS name, p_size AS v FROM part WHERE p_partkey % 11 <> 0), live AS (SELECT p_partkey AS name, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS v FROM part WHERE p_partkey % 13 <> 0)
SELECT name, f.v AS frozen, l.v AS live FROM frozen f FULL JOIN live l USING (name) WHERE f.v IS DISTINCT FROM l.v"""
)
def parameter_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters that differ between a frozen and a live set."""
    part = adapter.table(spark, sf_dir, "part")
    frozen = part.filter("p_partkey % 11 <> 0").selectExpr("p_partkey AS name", "p_size AS v")
    live = part.filter("p_partkey % 13 <> 0").selectExpr("p_partkey AS name", "CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS v")
    return contracts.drift(frozen, live, "name", "v")


@query(with_sql("labels_v") + f"SELECT {P}, count(*) AS rows, sha256(string_agg(h, '' ORDER BY runA_frame)) AS seal FROM (SELECT *, sha256(concat_ws('|', query_id, label, CAST(low AS VARCHAR), CAST(high AS VARCHAR), CAST(preferred AS VARCHAR))) AS h FROM labels_v) GROUP BY {P}")
def label_seals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seals of each camera's labels."""
    return contracts.sealed(adapter.labels(spark, sf_dir), PAIR, "runA_frame", ["query_id", "label", "low", "high", "preferred"])


@query("SELECT c_custkey, substr(sha256(concat_ws(chr(10), c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR))), 1, 12) AS digest FROM customer")
def artifact_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short digests of artifacts' contents."""
    return adapter.table(spark, sf_dir, "customer").select("c_custkey", text.digest(F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey")).alias("digest"))


@query("SELECT o_orderstatus, count(*) AS sets, count(*) FILTER (o_orderdate <= first_ship AND first_ship <= last_ship) AS ordered FROM (SELECT o_orderkey, o_orderstatus, o_orderdate, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL) GROUP BY o_orderstatus")
def stage_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether stages of a set follow each other in time."""
    shipped = adapter.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))
    rows = adapter.table(spark, sf_dir, "orders").join(shipped, "o_orderkey")
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("sets"), F.count(F.when(contracts.in_order(F.col("o_orderdate"), F.col("first_ship"), F.col("last_ship")), 1)).alias("ordered"))


@query(
    with_sql("flags")
    + f"""SELECT {S}, passed, CASE WHEN passed THEN 'pass' WHEN w.reason IS NOT NULL THEN 'waived' ELSE 'FAIL' END AS verdict, CASE WHEN NOT passed THEN w.reason END AS reason FROM (SELECT {S}, avg(CASE WHEN flag = 'too_dark' THEN 1.0 ELSE 0.0 END) < 0.28 AS passed FROM flags GROUP BY {S})
LEFT JOIN (VALUES ('cam5', 'known lens fault')) w(camera, reason) USING (camera)"""
)
def gate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass, waived or FAIL for each stream."""
    results = adapter.flags(spark, sf_dir).groupBy(*STREAM).agg((F.avg((F.col("flag") == "too_dark").cast("double")) < 0.28).alias("passed"))
    waivers = spark.createDataFrame([("cam5", "known lens fault")], "camera string, reason string")
    return contracts.gates(results, F.broadcast(waivers), ["camera"]).select(*STREAM, "passed", "verdict", "reason")


@query(
    with_sql("mapping")
    + f"""SELECT {P}, concat_ws('+', nullif(CASE WHEN {P.split(', ')[0]} % 2 = 0 THEN 'motion' ELSE '' END, ''), nullif(CASE WHEN camera = 'cam5' THEN 'loop' ELSE '' END, '')) AS variant, printf('%+.1f', CAST(max(runB_frame) - max(runA_frame) AS DOUBLE)) AS signed, CASE WHEN count(DISTINCT status) = 1 THEN min(status) ELSE array_to_string(list_sort(list(DISTINCT status))[1:-2], ', ') || ' and ' || max(status) END AS statuses FROM mapping GROUP BY {P}"""
)
def variant_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of names, signed numbers and lists."""
    made = adapter.mapping(spark, sf_dir).groupBy(*PAIR).agg((F.max("runB_frame") - F.max("runA_frame")).alias("d"), F.sort_array(F.collect_set("status")).alias("s"))
    variant = text.parts(F.when(F.col("recording") % 2 == 0, "motion").otherwise(""), F.when(F.col("camera") == "cam5", "loop").otherwise(""))
    return made.select(*PAIR, variant.alias("variant"), text.signed(F.col("d")).alias("signed"), text.listed(F.col("s")).alias("statuses"))


@query(
    """SELECT l_suppkey, count(*) AS points, count(DISTINCT cy * 4 + cx) AS cells, count(DISTINCT cy) AS rows_, count(DISTINCT cx) AS columns_, round((quantile_cont(x, 0.9) - quantile_cont(x, 0.1)) / 896, 6) AS spread_x, round((quantile_cont(y, 0.9) - quantile_cont(y, 0.1)) / 672, 6) AS spread_y FROM
(SELECT *, CAST(trunc(x * 4 / 896) AS BIGINT) AS cx, CAST(trunc(y * 3 / 672) AS BIGINT) AS cy FROM (SELECT l_suppkey, l_extendedprice % 896 AS x, l_quantity * 13 % 672 AS y FROM lineitem)) GROUP BY l_suppkey"""
)
def spatial_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells, rows, columns and spread of points on a grid of three by four."""
    from ..operators import pictures

    rows = adapter.table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_extendedprice") % 896).alias("x"), (F.col("l_quantity") * 13 % 672).alias("y"))
    return pictures.spatial_support(rows, ["l_suppkey"], "x", "y", 896, 672)


@query(
    """SELECT l_suppkey, count(*) AS tiles, count(*) FILTER (share >= 0.3) AS moving, round(count(*) FILTER (share >= 0.3) / 12.0, 6) AS coverage FROM (SELECT l_suppkey, cx, cy, round(avg(changed), 9) AS share FROM
(SELECT l_suppkey, CAST(trunc((l_extendedprice % 896) * 4 / 896) AS BIGINT) AS cx, CAST(trunc((l_quantity * 13 % 672) * 3 / 672) AS BIGINT) AS cy, CASE WHEN l_discount > 0.065 THEN 1.0 ELSE 0.0 END AS changed FROM lineitem) GROUP BY ALL) GROUP BY l_suppkey"""
)
def tile_motion_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of tiles in which enough pixels changed."""
    from ..operators import pictures

    rows = adapter.table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_extendedprice") % 896).alias("x"), (F.col("l_quantity") * 13 % 672).alias("y"), (F.col("l_discount") > 0.065).alias("changed"))
    return pictures.tile_coverage(rows, ["l_suppkey"], "x", "y", "changed", 896, 672, 0.3)


@query(
    with_sql("descriptors")
    + """SELECT recording, run, pixel, round(quantile_cont(x, 0.5), 6) AS median, round(stddev_pop(x), 6) AS sd, round(max(x), 6) AS most FROM (SELECT recording, run, unnest(generate_series(0, 63)) AS pixel, unnest(v) AS x FROM descriptors WHERE ordinal % 8 = 0) GROUP BY ALL"""
)
def temporal_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, deviation and maximum of each pixel over every eighth image."""
    from ..operators import pictures

    return pictures.temporal_statistics(adapter.descriptors(spark, sf_dir).filter("ordinal % 8 = 0"), ["recording", "run"], "v")
