"""Queries that write the driver's tables as files of the studied formats, below the shared folder, and read them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import agreement
from ..session import shared_folder
from ..sources import adapter, artifacts, elementary, files, recordings, synthetic, tables
from ..sources.adapter import PAIR, STREAM, with_sql
from .catalog import query
from .sequences import KINK_SQL, P, S, kinks

#: A camera's name where a file holds those of many recordings.
NAMED = "camera || '-' || recording"


def named() -> Column:
    return F.concat("camera", F.lit("-"), F.col("recording").cast("string"))


def written(df: DataFrame, name: str, columns: list[str] | None = None) -> str:
    """Writes a CSV table to a fresh folder and gives its path."""
    path = shared_folder(df.sparkSession, name)
    tables.write_csv(df, path, columns)
    return path


def texts(df: DataFrame, name: str) -> str:
    """Writes (name, content) as files below a fresh folder and gives its path."""
    path = shared_folder(df.sparkSession, name)
    files.write_each(df, path)
    return path


@query(
    with_sql("mapping")
    + f"""SELECT 'unified' AS mapping, {NAMED} AS camera, runA_frame, runB_frame, status, CASE WHEN confidence >= 0.6 THEN 'strong' ELSE 'supported' END AS tier, confidence FROM mapping
UNION ALL SELECT 'variant', {NAMED}, runA_frame, runB_frame, status, NULL, confidence FROM mapping WHERE runA_frame % 2 = 0"""
)
def mapping_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping tables of three vocabularies under one; the family that lacks a camera is left out."""
    m = adapter.mapping(spark, sf_dir).withColumn("camera", named())
    unified = written(m.withColumn("tier", F.when(F.col("confidence") >= 0.6, "strong").otherwise("supported")), "unified", ["camera", "runA_frame", "runB_frame", "status", "tier", "confidence"])
    variant = written(m.filter("runA_frame % 2 = 0").selectExpr("camera AS camera_id", "runA_frame AS run_a_frame", "runB_frame AS predicted_runB_frame", "status", "confidence AS posterior"), "variant")
    partial = written(m.filter("camera = 'cam0-0'"), "partial", ["camera", "runA_frame", "runB_frame"])
    return tables.complete_families(tables.mappings(spark, {"unified": unified, "variant": variant, "partial": partial}))


def label_file(spark: SparkSession, sf_dir: str) -> str:
    rows = adapter.labels(spark, sf_dir)
    match = lambda c: F.when(F.col("label") == "match", F.col(c))
    return written(rows.select("query_id", named().alias("camera_id"), "runA_frame", "label", "stratum", match("preferred").alias("runB_frame"), match("low").alias("runB_min"), match("high").alias("runB_max")), "labels")


@query(with_sql("labels_v") + f"SELECT query_id, {NAMED} AS camera_id, runA_frame, label, stratum, CASE WHEN label = 'match' THEN preferred END AS runB_frame, CASE WHEN label = 'match' THEN low END AS runB_min, CASE WHEN label = 'match' THEN high END AS runB_max FROM labels_v")
def label_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with their nullable integers."""
    return tables.labels(spark, label_file(spark, sf_dir))


@query(with_sql("labels_v") + f"SELECT camera_id, runA_frame, runB_frame FROM (SELECT {NAMED} AS camera_id, runA_frame, preferred AS runB_frame, row_number() OVER (PARTITION BY recording, camera ORDER BY runA_frame, preferred) AS n FROM labels_v WHERE label = 'match') WHERE n <= 6")
def labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six matches of each camera."""
    return tables.labelled_pairs(tables.labels(spark, label_file(spark, sf_dir)), 6)


@query(with_sql("labels_v") + f"SELECT {NAMED} AS camera_id, runA_frame, preferred AS runB_frame FROM labels_v WHERE label = 'match'")
def calibration_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches of each camera."""
    return tables.labelled_pairs(tables.labels(spark, label_file(spark, sf_dir)))


CASES = f"""cases AS (SELECT query_id, {NAMED} AS camera, l.runA_frame, stratum, label, low, high, m.runB_frame IS NOT NULL AS accepted, m.runB_frame AS predicted, CASE WHEN label = 'match' THEN coalesce(m.runB_frame BETWEEN low AND high, false) END AS correct FROM labels_v l JOIN mapping m USING (recording, camera, runA_frame))
"""
CASES_SQL = with_sql("labels_v", "mapping").rstrip() + ",\n" + CASES


def case_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases written in two vocabularies and read under one."""
    m = adapter.mapping(spark, sf_dir).select(*PAIR, "runA_frame", F.col("runB_frame").alias("predicted"))
    found = adapter.labels(spark, sf_dir).join(m, [*PAIR, "runA_frame"]).withColumn("accepted", F.col("predicted").isNotNull())
    found = found.withColumn("correct", F.when(F.col("label") == "match", F.coalesce(F.col("predicted").between(F.col("low"), F.col("high")), F.lit(False))))
    old = written(found.select("query_id", named().alias("camera_id"), "runA_frame", F.col("label").alias("ground_truth_label"), F.col("low").alias("ground_truth_runB_min"), F.col("high").alias("ground_truth_runB_max"), "accepted", F.col("predicted").alias("predicted_runB_frame"), F.col("correct").alias("accepted_correct")), "old")
    new = written(found.select(F.lit("viterbi").alias("method"), "query_id", named().alias("camera_id"), "runA_frame", "stratum", F.col("label").alias("ground_truth_label"), F.col("low").alias("runB_min"), F.col("high").alias("runB_max"), F.initcap(F.col("accepted").cast("string")).alias("accepted"), F.col("predicted").alias("predicted_runB_frame"), "correct"), "new")
    return tables.cases(spark, old).unionByName(tables.cases(spark, new))


@query(CASES_SQL + "SELECT 'shipped' AS method, query_id, camera, runA_frame, NULL AS stratum, label, low, high, accepted, predicted, correct FROM cases UNION ALL SELECT 'viterbi', query_id, camera, runA_frame, stratum, label, low, high, accepted, predicted, correct FROM cases")
def case_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored cases of two vocabularies."""
    return case_rows(spark, sf_dir).drop("interval_distance")


@query(CASES_SQL + "SELECT predicted AS prediction, low, high FROM cases WHERE camera = 'cam5-0' AND label = 'match' AND accepted")
def control_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A method's accepted matches of one camera, whatever its table calls them."""
    return tables.control_cases(case_rows(spark, sf_dir), "cam5-0", "viterbi")


@query(with_sql("flags") + f"SELECT run, {NAMED} AS camera, ordinal, flag, CASE WHEN ordinal % 9 = 0 THEN 'stall' ELSE '' END AS slope_gate FROM flags UNION ALL SELECT run, 'plain', ordinal, flag, '' FROM flags WHERE recording = 0 AND camera = 'cam0'")
def flag_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two flags by one key; a table without the second, and one that isn't there."""
    f = adapter.flags(spark, sf_dir)
    full = written(f.select("run", named().alias("camera"), "ordinal", "flag", F.when(F.col("ordinal") % 9 == 0, "stall").alias("slope_gate")), "flags")
    plain = written(f.filter("recording = 0 AND camera = 'cam0'").select("run", F.lit("plain").alias("camera"), "ordinal", "flag"), "plain")
    absent = shared_folder(spark, "absent")
    return tables.quality_flags(spark, full).unionByName(tables.quality_flags(spark, plain)).unionByName(tables.quality_flags(spark, absent))


@query(
    with_sql("labels_v")
    + f"""SELECT source, runA_frame FROM (SELECT DISTINCT 'labels' AS source, runA_frame FROM labels_v WHERE {NAMED} = 'cam0-0' UNION ALL SELECT DISTINCT 'anchors', runA_frame + 1 FROM labels_v WHERE {NAMED} = 'cam0-0' AND runA_frame % 5 = 0)"""
)
def label_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that people were shown before, by source; a source that isn't there has none."""
    columns = ["camera_id", "runA_frame"]
    anchors = written(adapter.labels(spark, sf_dir).filter("runA_frame % 5 = 0").select(named().alias("camera_id"), (F.col("runA_frame") + 1).alias("runA_frame")), "anchors")
    paths = {"labels": label_file(spark, sf_dir), "anchors": anchors, "manual": shared_folder(spark, "manual")}
    return tables.exclusions({name: tables.key_set(tables.optional_csv(spark, path, columns), "cam0-0") for name, path in paths.items()})


KINK_COLUMNS = ["mapping", "camera_id", "runA_prev", "runA_frame", "runB_before", "runB_after", "increment", "status", "tier", "confidence", "runA_too_dark", "runB_span_too_dark", "dark", "max_cross_camera_disagreement_within_10", "cross_camera_disagreement_over_6"]


@query(KINK_SQL + f"SELECT {NAMED} AS camera_id, runA_frame, increment, dark_a OR dark_b AS dark FROM kinks WHERE increment >= 6")
def submitted_kinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinks of one mapping from a table of fifteen columns, most of them blank."""
    found = kinks(spark, sf_dir, 4).select(F.lit("submitted").alias("mapping"), named().alias("camera_id"), "runA_frame", "increment", F.initcap((F.col("dark_a") | F.col("dark_b")).cast("string")).alias("dark"))
    other = found.withColumn("mapping", F.lit("posterior"))
    path = written(tables.with_columns(found.unionByName(other), KINK_COLUMNS), "kinks", KINK_COLUMNS)
    return tables.kinks(spark, path, "submitted")


@query("SELECT CAST(r_regionkey AS VARCHAR) AS a, r_name AS b, NULL AS c FROM region UNION ALL SELECT CAST(n_nationkey AS VARCHAR), NULL, n_name FROM nation")
def union_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of different columns in one table under their union, sorted."""
    region = adapter.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("a"), F.col("r_name").alias("b"))
    nation = adapter.table(spark, sf_dir, "nation").select(F.col("n_name").alias("c"), F.col("n_nationkey").cast("string").alias("a"))
    return tables.csv(spark, written(tables.union_of([region, nation]), "union"))


@query(with_sql("frames") + "SELECT ordinal AS line, count(*) AS files, CAST(sum(epoch_us(ts) % 1000000007) AS BIGINT) AS total FROM frames GROUP BY ordinal")
def stream_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the streams' timestamp files, numbered within each; blank lines don't count."""
    f = adapter.frames(spark, sf_dir)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")))), lambda x: (x["us"] % 1000000007).cast("string")), "\n\n")
    content = f.groupBy(*STREAM).agg(lines.alias("content"))
    path = texts(content.select(F.concat_ws("_", *STREAM).alias("name"), "content"), "timestamps")
    return tables.timestamps(spark, path).groupBy("line").agg(F.count(F.lit(1)).alias("files"), F.sum("ns").alias("total"))


def region_files(spark: SparkSession, sf_dir: str) -> str:
    nations = adapter.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), "\n").alias("content"))
    regions = adapter.table(spark, sf_dir, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"))
    return texts(regions.select(F.concat(F.lower("r_name"), F.lit(".txt")).alias("name"), "content"), "regions")


@query("SELECT lower(r_name) || '.txt' AS name, CAST(octet_length(encode(content)) AS BIGINT) AS bytes, sha256(content) AS digest, r_regionkey <> 1 AS published FROM region JOIN (SELECT n_regionkey, string_agg(n_name, chr(10) ORDER BY n_name) AS content FROM nation GROUP BY n_regionkey) ON r_regionkey = n_regionkey")
def verified_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of files against a manifest that lacks one of them."""
    found = tables.file_digests(spark, region_files(spark, sf_dir)).withColumn("name", F.element_at(F.split("path", "/"), -1))
    skipped = adapter.table(spark, sf_dir, "region").filter("r_regionkey = 1").select(F.concat(F.lower("r_name"), F.lit(".txt")).alias("name"))
    manifest = shared_folder(spark, "manifest")
    found.join(skipped, "name", "left_anti").select(F.concat(F.upper("digest"), F.lit("  "), "name")).write.text(manifest)
    listed = tables.checksums(spark, manifest).withColumnRenamed("path", "name").withColumnRenamed("digest", "_listed")
    return found.join(listed, "name", "left").select("name", "bytes", "digest", F.coalesce(F.col("_listed") == F.col("digest"), F.lit(False)).alias("published"))


@query("SELECT r_name AS gate, 'known since ' || r_regionkey AS reason FROM region WHERE r_regionkey > 0")
def waiver_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waivers of a small document, which is written in one step."""
    rows = adapter.table(spark, sf_dir, "region").filter("r_regionkey > 0").collect()  # a table of a fixed handful of rows
    path = f"{shared_folder(spark, 'waivers')}/waivers.json"
    tables.write_json(spark, path, {"waivers": [{"gate": r["r_name"], "reason": f"known since {r['r_regionkey']}"} for r in rows]})
    return tables.waivers(spark, path)


def documents(spark: SparkSession, rows: DataFrame, name: str) -> str:
    """One JSON document for each recording, from its column `document`."""
    return texts(rows.select(F.concat(F.col("recording").cast("string"), F.lit(".json")).alias("name"), F.to_json("document").alias("content")), name)


@query(with_sql("labels_v") + f"SELECT {NAMED} AS camera, query_id, stratum FROM labels_v")
def label_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata of the queries of nested manifests."""
    queries = adapter.labels(spark, sf_dir).groupBy("recording", named().alias("name")).agg(F.collect_list(F.struct(F.col("query_id").alias("queryId"), "stratum")).alias("queries"))
    rows = queries.groupBy("recording").agg(F.struct(F.map_from_entries(F.collect_list(F.struct("name", F.struct("queries")))).alias("cameras")).alias("document"))
    return tables.strata(spark, documents(spark, rows, "strata"))


@query(with_sql("frames") + f"SELECT {NAMED} AS camera, round(dx, 6) AS dx, round(dy, 6) AS dy, round(dx * 0.5, 6) AS half_dx, round(dy * 0.5, 6) AS half_dy FROM (SELECT recording, camera, round(quantile_cont(luma, 0.5), 3) AS dx, round(quantile_cont(p99, 0.5), 3) AS dy FROM frames GROUP BY ALL)")
def pose_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displacements from nested diagnostics, as they are and at half the raster."""
    middle = lambda c: F.struct(F.round(F.percentile(c, F.lit(0.5)), 3).alias("median"))
    cameras = adapter.frames(spark, sf_dir).groupBy("recording", named().alias("name")).agg(middle("luma").alias("dx_px"), middle("p99").alias("dy_px"))
    entry = F.struct("name", F.struct(F.struct("dx_px", "dy_px").alias("matcher_convention")))
    path = documents(spark, cameras.groupBy("recording").agg(F.struct(F.map_from_entries(F.collect_list(entry)).alias("cameras")).alias("document")), "poses")
    half = tables.pose_shifts(spark, path, 0.5).withColumnsRenamed({"dx": "half_dx", "dy": "half_dy"})
    found = tables.pose_shifts(spark, path).join(half, "camera")
    return found.select("camera", *[F.round(c, 6).alias(c) for c in ("dx", "dy", "half_dx", "half_dy")])


@query(with_sql("mapping") + f"SELECT {NAMED} AS camera, min(runA_frame) AS runA_first, max(runA_frame) AS runA_last, min(runB_frame) AS runB_start, max(runB_frame) AS runB_end FROM mapping WHERE runB_frame IS NOT NULL AND camera = 'cam0' AND runA_frame BETWEEN 60 AND 120 GROUP BY recording, camera")
def occlusion_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of audits of confirmed occlusions."""
    inside = adapter.mapping(spark, sf_dir).filter("runB_frame IS NOT NULL AND camera = 'cam0' AND runA_frame BETWEEN 60 AND 120").groupBy("recording", named().alias("name"))
    ends = lambda c, a, b: F.struct(F.min(c).alias(a), F.max(c).alias(b))
    spans = inside.agg(ends("runA_frame", "first", "last").alias("a"), ends("runB_frame", "start", "end").alias("b"))
    document = F.struct(F.col("name").alias("camera"), F.struct(F.col("a").alias("runA_frames")).alias("unified_mapping"), F.col("b").alias("interval"))
    return tables.occlusion_windows(spark, documents(spark, spans.withColumn("document", document), "occlusions"))


@query(with_sql("frames") + "SELECT min(ordinal) FILTER (run = 'runA' AND luma > 50) AS \"runA_start\", min(ordinal) FILTER (run = 'runB' AND luma > 50) AS \"runB_start\", min(ordinal) FILTER (run = 'runA' AND luma > 90) AS \"runA_stationary_end\", min(ordinal) FILTER (run = 'runB' AND luma > 90) AS \"runB_stationary_end\" FROM frames")
def route_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where both runs' routes begin, from a table with a row for each."""
    first = lambda least: F.min(F.when(F.col("luma") > least, F.col("ordinal")))
    rows = adapter.frames(spark, sf_dir).groupBy("run").agg(first(50).alias("route_start"), first(90).alias("stationary_end"))
    return tables.route_bounds(spark, written(rows, "bounds"))


CATALOG = """streams AS (SELECT recording, run, camera, count(*) AS frames FROM frames GROUP BY ALL)
"""


def recording_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder for each recording, of even ones with a folder for each run; of every third one a stream is missing, of every second its sidecar."""
    streams = adapter.frames(spark, sf_dir).groupBy(*STREAM).agg(F.count(F.lit(1)).alias("frames"))
    there = streams.filter("NOT (recording % 3 = 0 AND run = 'runB' AND camera = 'cam5')")
    own = F.concat("camera", F.lit("_20_yuv420p_output.hevc"))
    flat = F.when(F.col("run") == "runB", F.concat("camera", F.lit("_20_yuv420p_output (1).hevc"))).otherwise(own)
    name = F.concat(F.col("recording").cast("string"), F.lit("/"), F.when(F.col("recording") % 2 == 0, F.concat("run", F.lit("/"), own)).otherwise(flat))
    return texts(there.select(name.alias("name"), F.repeat(F.lit("x"), F.col("frames").cast("int")).alias("content")), "recordings")


@query(
    with_sql("frames").rstrip() + ",\n" + CATALOG
    + """SELECT recording, run, camera, CASE WHEN NOT there THEN NULL WHEN recording % 2 = 0 THEN '/' || run || '/' || camera || '_20_yuv420p_output.hevc' WHEN run = 'runB' THEN '/' || camera || '_20_yuv420p_output (1).hevc' ELSE '/' || camera || '_20_yuv420p_output.hevc' END AS place, CASE WHEN there THEN frames END AS length
FROM (SELECT *, NOT (recording % 3 = 0 AND run = 'runB' AND camera = 'cam5') AS there FROM streams)"""
)
def stream_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file of every stream in either layout, null where it isn't there."""
    folder = recording_files(spark, sf_dir)
    roots = adapter.frames(spark, sf_dir).select("recording").distinct().withColumn("root", F.concat(F.lit(f"{folder}/"), F.col("recording").cast("string")))
    found = recordings.resolved(roots, files.listed(spark, folder))
    return found.join(roots, "root").select("recording", "run", "camera", F.substring_index("path", folder, -1).alias("place"), "length").withColumn("place", F.regexp_replace("place", "^/[0-9]+", ""))


@query(with_sql("frames") + "SELECT run, camera, count(*) AS frames FROM frames GROUP BY ALL")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of each stream from a summary that must name all four."""
    rows = adapter.frames(spark, sf_dir).groupBy("run", "camera").agg(F.count(F.lit(1)).alias("canonical_decoded_images"))
    return tables.stream_counts(spark, written(rows, "summary"), [(r, c) for r in recordings.RUNS for c in recordings.CAMERAS])


@query(with_sql("frames") + f"SELECT {S}, ordinal, luma FROM frames WHERE ordinal % 10 = 3")
def keyed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of wanted keys, all of which must be there."""
    f = adapter.frames(spark, sf_dir).select(*STREAM, "ordinal", "luma")
    return tables.keyed(f, f.filter("ordinal % 10 = 3"), [*STREAM, "ordinal"])


@query(with_sql("descriptors") + "SELECT recording, run, ordinal, 1.0 AS length, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, CAST(NULL AS DOUBLE) AS speed, 'runA_cam0_' || substr(sha256('source'), 1, 12) || '_8x8_bt709' AS version FROM descriptors")
def versioned_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stored under a version that names their source, read again at unit length; a column that an old table lacks is null."""
    key = spark.range(1).select(text.cache_key(F.lit("runA"), F.lit("cam0"), F.lit(8), F.lit(8), F.sha2(F.lit("source"), 256), "bt709").alias("k")).first()["k"]
    root = shared_folder(spark, "artifacts")
    grown = adapter.descriptors(spark, sf_dir).withColumn("v", F.transform("v", lambda x: x * 3.0))
    artifacts.stored(grown, root, "vectors", key)
    artifacts.stored(grown.limit(0), root, "vectors", key)  # there already: not written again
    found = artifacts.vectors(spark, root, "vectors", key).join(artifacts.load(spark, root, "vectors", key, {"speed": "double"}).select("recording", "run", "ordinal", "speed"), ["recording", "run", "ordinal"])
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return found.select("recording", "run", "ordinal", F.round(length, 6).alias("length"), F.round(F.get("v", F.lit(0)), 6).alias("first"), "speed", F.lit(key).alias("version"))


@query(
    with_sql("mapping").rstrip()
    + f""",
inside AS (SELECT {P}, runA_frame, status, confidence FROM mapping WHERE runB_frame BETWEEN 40 AND 90),
totals AS (SELECT {P}, count(*) AS rows, min(runA_frame) AS first, max(runA_frame) AS last FROM inside GROUP BY ALL),
stats AS (SELECT {P}, min(confidence) AS low, list_sort(list(confidence))[len(list(confidence)) // 2 + 1] AS middle, max(confidence) AS high FROM inside GROUP BY ALL)
SELECT {P}, rows, first, last, 'confidence' AS "column", unnest(['min', 'median', 'max']) AS kind, CAST(CAST(unnest([low, middle, high]) AS DOUBLE) AS VARCHAR) AS value, CAST(NULL AS BIGINT) AS n FROM totals JOIN stats USING ({P})
UNION ALL SELECT {P}, rows, first, last, 'status', 'count', status, n FROM totals JOIN (SELECT {P}, status, count(*) AS n FROM inside GROUP BY ALL) USING ({P})"""
)
def interval_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is mapped into an interval of run B: numbers by their spread, words by their counts."""
    return tables.described(adapter.mapping(spark, sf_dir), PAIR, 40, 90, ["confidence", "status"])


@query(with_sql("mapping") + f"SELECT {P}, runA_frame, CASE WHEN runB_frame >= 20 AND runB_frame < 150 THEN runB_frame - 20 ELSE -1 END AS place FROM mapping")
def partner_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each frame's partner among the columns of a matrix, -1 for those without."""
    m = adapter.mapping(spark, sf_dir).select(*PAIR, "runA_frame", "runB_frame")
    columns = m.select(*PAIR).distinct().select(*PAIR, F.posexplode(F.sequence(F.lit(20).cast("bigint"), F.lit(149).cast("bigint"))).alias("place", "runB_frame"))
    return agreement.partner_places(m, columns, PAIR, "runB_frame", "place").select(*PAIR, "runA_frame", F.col("place").cast("bigint").alias("place"))


@query(
    """SELECT p_partkey, printf('%.1f%%', round(p_retailprice / 20, 1)) AS percent, CASE WHEN p_size >= 1 THEN format('{:,}', CAST(p_size AS BIGINT) * 12345) END AS thousands, p_size || '×' || (p_size + 1) AS raster, coalesce(TRY_CAST(trim(split_part(p_name, ' ', 1)) AS BIGINT), 999) AS number, TRY_CAST(nullif(trim(CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE CAST(p_size AS VARCHAR) END), '') AS DOUBLE) AS optional,
  CASE WHEN p_size % 2 = 0 THEN '' ELSE '_no_motion' END || CASE WHEN p_size % 3 = 0 THEN '' ELSE '_no_loop' END || CASE WHEN p_size % 5 = 0 THEN '_speed' ELSE '' END || CASE WHEN p_size % 2 = 0 AND p_size % 4 = 0 THEN '_motion-none' ELSE '' END AS suffix, CASE WHEN p_size % 4 = 0 THEN '_none' ELSE '' END AS mode FROM part"""
)
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and names as text."""
    p, size = adapter.table(spark, sf_dir, "part"), F.col("p_size")
    variant = F.when(size % 4 == 0, "none").otherwise("mean-divide")
    return p.select(
        "p_partkey",
        text.percent(F.round(F.col("p_retailprice") / 20, 1) / 100).alias("percent"),
        text.thousands(size.cast("bigint") * 12345).alias("thousands"),
        text.raster(size, size + 1).alias("raster"),
        text.int_or(F.substring_index("p_name", " ", 1)).alias("number"),
        text.optional_double(F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(size.cast("string"))).alias("optional"),
        text.mapping_suffix(size % 2 == 0, size % 3 == 0, size % 5 == 0, variant, "mean-divide").alias("suffix"),
        text.mode_suffix(variant, "mean-divide").alias("mode"),
    )


@query(with_sql("mapping") + "SELECT status AS value, count(*) AS rows FROM mapping GROUP BY status")
def published_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping published with its manifest, and what the manifest says."""
    path = shared_folder(spark, "published")
    tables.publish(adapter.mapping(spark, sf_dir).select(*PAIR, "runA_frame", "runB_frame", "status", "confidence"), path, "status", {"bridge": 10, "rule": "sloped"})
    return tables.published(spark, path)


# -- elementary streams and raw frames

PICTURES = f"""coded AS (SELECT {S}, ordinal AS decode_index, CASE WHEN ordinal % 32 = 0 THEN 19 ELSE 1 END AS nal_type, CASE WHEN ordinal % 32 = 0 THEN 'I' WHEN (ordinal % 32 - 1) % 4 = 0 THEN 'P' ELSE 'B' END AS slice_type,
  CASE WHEN ordinal % 32 = 0 THEN 0 ELSE (ordinal % 32 - 1) // 4 * 4 + [4, 2, 1, 3][(ordinal % 32 - 1) % 4 + 1] END AS poc, ordinal % 32 = 0 AS is_idr, 5 + CASE WHEN ordinal % 32 = 0 THEN 4 + ordinal % 5 ELSE 5 + ordinal % 5 END AS byte_size FROM frames)
"""
PICTURES_SQL = with_sql("frames").rstrip() + ",\n" + PICTURES


def stream_files(spark: SparkSession, sf_dir: str) -> str:
    counts = adapter.frames(spark, sf_dir).groupBy(F.concat_ws("_", *STREAM).alias("name")).agg(F.count(F.lit(1)).alias("frames"))
    return texts(synthetic.streams(counts, "name", "frames"), "streams")


def with_stream(rows: DataFrame) -> DataFrame:
    """The stream that a file's name says, instead of its path."""
    parts = F.split(F.element_at(F.split("path", "/"), -1), "_")
    return rows.withColumn("recording", F.get(parts, F.lit(0)).cast("bigint")).withColumn("run", F.get(parts, F.lit(1))).withColumn("camera", F.get(parts, F.lit(2))).drop("path")


def coded_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_stream(elementary.pictures(spark, stream_files(spark, sf_dir), 1 << 10))


@query(PICTURES_SQL + f"SELECT {S}, decode_index, nal_type, slice_type, CAST(poc AS BIGINT) AS poc, is_idr, byte_size, 1440 AS width, 1080 AS height FROM coded")
def picture_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of coded streams, from ranges of a kilobyte."""
    return coded_pictures(spark, sf_dir).select(*STREAM, "decode_index", "nal_type", "slice_type", "poc", "is_idr", "byte_size", "width", "height")


@query(
    PICTURES_SQL.rstrip()
    + f""",
totals AS (SELECT {S}, count(*) AS n FROM frames GROUP BY ALL),
messages AS (SELECT {S}, ['pic_timing', 'user_data_unregistered', 'type_300'][g % 3 + 1] AS message, count(*) AS units FROM (SELECT {S}, unnest(range((n + 31) // 32)) AS g FROM totals) GROUP BY ALL)
SELECT {S}, nal_type, NULL AS message, count(*) AS units FROM coded GROUP BY {S}, nal_type UNION ALL SELECT {S}, unnest([33, 34]), NULL, 1 FROM totals UNION ALL SELECT {S}, 39, message, units FROM messages"""
)
def unit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Network units of coded streams by type, supplemental ones by their first message."""
    return with_stream(elementary.unit_counts(spark, stream_files(spark, sf_dir), 1 << 10)).select(*STREAM, "nal_type", "message", "units")


@query(PICTURES_SQL + f"SELECT {S}, count(*) AS pictures, array_to_string(list(decode_index ORDER BY decode_index) FILTER (is_idr), ',') AS idr_indices FROM coded GROUP BY ALL")
def picture_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of each stream, and where its intra pictures stand."""
    indices = F.array_sort(F.collect_list(F.when(F.col("is_idr"), F.col("decode_index"))))
    return coded_pictures(spark, sf_dir).groupBy(*STREAM).agg(F.count(F.lit(1)).alias("pictures"), F.array_join(F.transform(indices, lambda i: i.cast("string")), ",").alias("idr_indices"))


RAW = """raw AS (SELECT recording, run, ordinal, list_transform(v[1:63], lambda x: CAST(floor(least(greatest((x + 0.5) * 255, 0), 255)) AS INTEGER)) AS p FROM descriptors),
grey AS (SELECT recording, run, ordinal, list_transform(range(21), lambda i: p[i * 3 + 1] * 0.2126e0 + p[i * 3 + 2] * 0.7152e0 + p[i * 3 + 3] * 0.0722e0) AS y FROM raw)
"""
RAW_SQL = with_sql("descriptors").rstrip() + ",\n" + RAW


def raw_files(spark: SparkSession, sf_dir: str) -> str:
    """Raw frames of seven by three pixels, a file for each run of a recording."""
    level = lambda x: F.floor(F.least(F.greatest((x + 0.5) * 255, F.lit(0.0)), F.lit(255.0))).cast("int")
    coded = F.array_join(F.transform(F.slice("v", 1, 63), lambda x: F.lpad(F.hex(level(x).cast("bigint")), 2, "0")), "")
    frames = adapter.descriptors(spark, sf_dir).select("recording", "run", F.struct("ordinal", coded.alias("hex")).alias("f"))
    whole = F.unhex(F.array_join(F.array_sort(F.collect_list("f"))["hex"], ""))
    return texts(frames.groupBy("recording", "run").agg(whole.alias("content")).select(F.concat_ws("_", "recording", "run", F.lit("cam0")).alias("name"), "content"), "raw")


@query(RAW_SQL + "SELECT recording, run, ordinal, round(list_avg(y), 6) AS mean_luma, round(list_aggregate(y, 'quantile_cont', 0.99), 6) AS p99_luma FROM grey WHERE ordinal < 60")
def raw_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Luma of the first sixty raw frames of each file."""
    found = with_stream(elementary.raw_frames(spark, raw_files(spark, sf_dir), 7, 3, stop_after=60))
    return found.select("recording", "run", "ordinal", F.round("mean_luma", 6).alias("mean_luma"), F.round("p99_luma", 6).alias("p99_luma"))


@query(RAW_SQL + "SELECT recording, run, ordinal, round(list_sum(y), 5) AS total, round(y[1], 6) AS corner FROM grey")
def grey_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey frames of whole files, which may not hold more than their capacity."""
    found = with_stream(elementary.grey_frames(spark, raw_files(spark, sf_dir), 7, 3, capacity=1000))
    return found.select("recording", "run", "ordinal", F.round(F.aggregate("grey", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.round(F.get("grey", F.lit(0)), 6).alias("corner"))


@query(
    with_sql("flags")
    + f"SELECT {S}, CASE WHEN abs(quantile_cont(luma - 50, 0.5)) > 4 * 1.4826 * mad / sqrt(count(*)) THEN 'shifted' ELSE 'consistent' END AS verdict FROM flags JOIN (SELECT {S}, quantile_cont(abs(luma - m), 0.5) AS mad FROM flags JOIN (SELECT {S}, quantile_cont(luma, 0.5) AS m FROM flags GROUP BY ALL) USING ({S}) GROUP BY ALL) USING ({S}) GROUP BY {S}, mad"
)
def criterion_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a stream's median lies more than four standard errors from where it should."""
    f = adapter.flags(spark, sf_dir)
    middle = f.groupBy(*STREAM).agg(F.percentile("luma", F.lit(0.5)).alias("_m"))
    spread = f.join(middle, STREAM).groupBy(*STREAM).agg(F.percentile(F.col("luma") - 50, F.lit(0.5)).alias("m"), F.percentile(F.abs(F.col("luma") - F.col("_m")), F.lit(0.5)).alias("mad"), F.count(F.lit(1)).alias("n"))
    return spread.select(*STREAM, scores.evidence_verdict(F.col("m"), F.col("mad"), F.col("n")).alias("verdict"))
