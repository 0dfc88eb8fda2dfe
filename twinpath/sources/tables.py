"""CSV, JSON and text tables with fixed schemas, read as text and cast: an empty field is null, and nothing is inferred."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import upper_median
from ..functions.text import blank_to_null, optional_double, optional_int
from . import files

#: The names that mapping tables of three kinds use for a column, the first that is there counts.
MAPPING_NAMES = {
    "camera": ("camera", "camera_id"),
    "runA_frame": ("runA_frame", "run_a_frame"),
    "runB_frame": ("runB_frame", "run_b_frame", "predicted_runB_frame"),
    "status": ("status",),
    "tier": ("tier", "sequence_tier"),
    "confidence": ("confidence", "posterior"),
}
LABEL_INTS = ("runA_frame", "runB_frame", "runB_min", "runB_max")
TRUE, FALSE = ("true", "True", "1"), ("false", "False", "0")


def csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns as text; empty text is null."""
    found = spark.read.csv(path, header=True, inferSchema=False)
    return found.select(*[blank_to_null(F.col(f"`{c}`")).alias(c) for c in found.columns])


def first_of(df: DataFrame, names: tuple[str, ...]) -> Column:
    there = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def boolean(column: Column) -> Column:
    return F.when(column.isin(*TRUE), True).when(column.isin(*FALSE), False)


def mapping(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(mapping, camera, runA_frame, runB_frame, status, tier, confidence) of a table of any of the three kinds."""
    rows = csv(spark, path)
    column = {n: first_of(rows, names) for n, names in MAPPING_NAMES.items()}
    return rows.select(F.lit(name).alias("mapping"), column["camera"].alias("camera"), optional_int(column["runA_frame"]).alias("runA_frame"), optional_int(column["runB_frame"]).alias("runB_frame"), column["status"].alias("status"), column["tier"].alias("tier"), optional_double(column["confidence"]).alias("confidence"))


def mappings(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Mapping tables by name, under one schema."""
    (first, path), *rest = paths.items()
    found = mapping(spark, path, first)
    for name, other in rest:
        found = found.unionByName(mapping(spark, other, name))
    return found


def complete_families(found: DataFrame, cameras: int = 2) -> DataFrame:
    """Rows of the mappings that every camera has."""
    whole = found.groupBy("mapping").agg(F.countDistinct("camera").alias("_n")).filter(F.col("_n") >= cameras).select("mapping")
    return found.join(whole, "mapping", "left_semi")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels with their nullable integers; other columns stay text."""
    rows = csv(spark, path)
    return rows.select(*[optional_int(F.col(c)).alias(c) if c in LABEL_INTS else F.col(c) for c in rows.columns])


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Scored cases under one vocabulary, whichever of the two their columns have."""
    rows = csv(spark, path)
    of = lambda *names: first_of(rows, names)
    return rows.select(
        F.coalesce(of("method"), F.lit("shipped")).alias("method"), of("query_id").alias("query_id"), of("camera_id", "camera").alias("camera"), optional_int(of("runA_frame")).alias("runA_frame"), of("stratum").alias("stratum"),
        of("ground_truth_label", "label").alias("label"), optional_int(of("runB_min", "ground_truth_runB_min")).alias("low"), optional_int(of("runB_max", "ground_truth_runB_max")).alias("high"),
        boolean(of("accepted")).alias("accepted"), optional_int(of("predicted_runB_frame")).alias("predicted"), boolean(of("correct", "accepted_correct")).alias("correct"), optional_int(of("interval_distance")).alias("interval_distance"),
    )


def timestamps(spark: SparkSession, path: str, least: int = 2) -> DataFrame:
    """(line, ns): one integer of nanoseconds for each line that isn't blank, numbered from 0 within its file, of which each must have `least`."""
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())  # rows of a block are read in order
    rows = spark.read.text(path).filter(F.trim("value") != "").select(F.col("_metadata.file_path").alias("_file"), place.alias("_place"), F.trim("value").cast("bigint").alias("ns"))
    w = Window.partitionBy("_file")
    numbered = rows.withColumn("line", (F.row_number().over(w.orderBy("_place")) - 1).cast("bigint")).withColumn("_n", F.count(F.lit(1)).over(w))
    enough = F.assert_true(F.col("_n") >= least, F.concat(F.lit("too few timestamps in "), "_file"))
    return numbered.filter(enough.isNull()).select("line", "ns")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, digest) of a manifest of digests and paths parted by white space."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    return spark.read.text(path).filter(F.trim("value") != "").select(F.get(parts, F.lit(1)).alias("path"), F.lower(F.get(parts, F.lit(0))).alias("digest"))


def waivers(spark: SparkSession, path: str) -> DataFrame:
    """(gate, reason) of {"waivers": [{"gate": …, "reason": …}]}."""
    rows = spark.read.schema("waivers array<struct<gate string, reason string>>").json(path, multiLine=True)
    return rows.select(F.explode("waivers").alias("w")).select("w.gate", "w.reason")


def strata(spark: SparkSession, path: str) -> DataFrame:
    """(camera, query_id, stratum) of {"cameras": {camera: {"queries": [{"queryId": …, "stratum": …}]}}}."""
    rows = spark.read.schema("cameras map<string, struct<queries array<struct<queryId string, stratum string>>>>").json(path, multiLine=True)
    return rows.select(F.explode("cameras").alias("camera", "c")).select("camera", F.explode("c.queries").alias("q")).select("camera", F.col("q.queryId").alias("query_id"), "q.stratum")


def optional_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns of a table of texts; of a file that isn't there, no rows."""
    if not files.exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    return csv(spark, path).select(*columns)


def key_set(rows: DataFrame, camera: str, column: str = "runA_frame") -> DataFrame:
    """The distinct numbers that a camera has in a column."""
    return rows.filter(F.col("camera_id") == camera).select(optional_int(F.col(column)).alias(column)).filter(F.col(column).isNotNull()).distinct()


def exclusions(named: dict[str, DataFrame], column: str = "runA_frame") -> DataFrame:
    """(source, column): the keys of every source under its name."""
    (first, rows), *rest = named.items()
    found = rows.select(F.lit(first).alias("source"), column)
    for name, other in rest:
        found = found.unionByName(other.select(F.lit(name).alias("source"), column))
    return found


def quality_flags(spark: SparkSession, path: str) -> DataFrame:
    """(run, camera, ordinal, flag, slope_gate): two flags by one key; no rows without the file, an empty gate without its column."""
    columns = ["run", "camera", "ordinal", "flag"]
    if not files.exists(spark, path):
        return spark.createDataFrame([], "run string, camera string, ordinal bigint, flag string, slope_gate string")
    rows = csv(spark, path)
    gate = F.coalesce(first_of(rows, ("slope_gate",)), F.lit(""))
    return rows.select(*columns, gate.alias("slope_gate")).withColumn("ordinal", optional_int(F.col("ordinal")))


def labelled_pairs(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """(camera_id, runA_frame, runB_frame) of the labels that name a match; of each camera the first ones, by frame."""
    found = rows.filter("label = 'match' AND runB_frame IS NOT NULL").select("camera_id", "runA_frame", "runB_frame")
    if limit is None:
        return found
    first = F.row_number().over(Window.partitionBy("camera_id").orderBy("runA_frame", "runB_frame"))
    return found.withColumn("_n", first).filter(F.col("_n") <= limit).drop("_n")


def kinks(spark: SparkSession, path: str, mapping_name: str, least: int = 6) -> DataFrame:
    """(camera_id, runA_frame, increment, dark) of a mapping's kinks of `least` frames or more."""
    rows = csv(spark, path).filter(F.col("mapping") == mapping_name)
    typed = rows.select("camera_id", optional_int(F.col("runA_frame")).alias("runA_frame"), optional_int(F.col("increment")).alias("increment"), (F.lower("dark") == "true").alias("dark"))
    return typed.filter(F.abs("increment") >= least)


def control_cases(found: DataFrame, camera: str, method: str) -> DataFrame:
    """(prediction, low, high) of a method's accepted matches of a camera, from `cases`."""
    kept = found.filter((F.col("camera") == camera) & (F.col("method") == method) & (F.col("label") == "match") & F.col("accepted"))
    return kept.select(F.col("predicted").alias("prediction"), "low", "high")


def route_bounds(spark: SparkSession, path: str) -> DataFrame:
    """One row (runA_start, runB_start, runA_stationary_end, runB_stationary_end) of a table with a row for each run."""
    rows = csv(spark, path)
    of = lambda run, column: F.max(F.when(F.col("run") == run, optional_int(F.col(column))))
    return rows.agg(of("runA", "route_start").alias("runA_start"), of("runB", "route_start").alias("runB_start"), of("runA", "stationary_end").alias("runA_stationary_end"), of("runB", "stationary_end").alias("runB_stationary_end"))


def pose_shifts(spark: SparkSession, path: str, scale: float = 1.0) -> DataFrame:
    """(camera, dx, dy): the median displacements that a diagnostic holds for each camera, at another scale."""
    middle = "struct<median double>"
    rows = spark.read.schema(f"cameras map<string, struct<matcher_convention struct<dx_px {middle}, dy_px {middle}>>>").json(path, multiLine=True)
    found = rows.select(F.explode("cameras").alias("camera", "c")).select("camera", "c.matcher_convention.*")
    return found.select("camera", (F.col("dx_px.median") * scale).alias("dx"), (F.col("dy_px.median") * scale).alias("dy"))


def occlusion_windows(spark: SparkSession, path: str) -> DataFrame:
    """(camera, runA_first, runA_last, runB_start, runB_end) of an audit of a confirmed occlusion, or of several."""
    rows = spark.read.schema("camera string, unified_mapping struct<runA_frames struct<first bigint, last bigint>>, interval struct<start bigint, end bigint>").json(path, multiLine=True)
    return rows.select("camera", F.col("unified_mapping.runA_frames.first").alias("runA_first"), F.col("unified_mapping.runA_frames.last").alias("runA_last"), F.col("interval.start").alias("runB_start"), F.col("interval.end").alias("runB_end"))


def described(rows: DataFrame, keys: list[str], low: int, high: int, columns: list[str]) -> DataFrame:
    """(keys, rows, first, last, column, kind, value, n): what is mapped into an interval of run B.

    A column of numbers alone gives its min, upper median and max, any other one
    the count of each value; blank texts count in neither.
    """
    inside = rows.filter(F.col("runB_frame").between(low, high))
    totals = inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.min("runA_frame").alias("first"), F.max("runA_frame").alias("last"))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), blank_to_null(F.col(c).cast("string")).alias("text")) for c in columns])).alias("e")
    texts = inside.select(*keys, each).select(*keys, "e.*").filter("text IS NOT NULL").withColumn("number", optional_double(F.col("text")))
    numeric = texts.groupBy(*keys, "column").agg(F.count_if(F.col("number").isNull()).alias("_other"), F.min("number").alias("min"), upper_median(F.collect_list("number")).alias("median"), F.max("number").alias("max"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value"), F.lit(None).cast("bigint").alias("n")) for k in ("min", "median", "max")])).alias("s")
    spread = numeric.filter("_other = 0").select(*keys, "column", kinds).select(*keys, "column", "s.*")
    counted = texts.join(numeric.filter("_other > 0").select(*keys, "column"), [*keys, "column"]).groupBy(*keys, "column", F.lit("count").alias("kind"), F.col("text").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return spread.unionByName(counted).join(totals, keys).select(*keys, "rows", "first", "last", "column", "kind", "value", "n")


def keyed(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the wanted keys, every one of which must be there."""
    asked = wanted.select(*keys).distinct().withColumn("_asked", F.lit(True))
    met = asked.join(rows.withColumn("_there", F.lit(True)), keys, "left")
    there = F.assert_true(F.coalesce(F.col("_there"), F.lit(False)), F.concat(F.lit("wanted keys are not there, such as "), F.concat_ws("/", *keys)))
    return met.filter(there.isNull()).select(*rows.columns)


def stream_counts(spark: SparkSession, path: str, streams: list[tuple[str, str]], column: str = "canonical_decoded_images") -> DataFrame:
    """(run, camera, frames) of a summary that must name just these streams."""
    rows = csv(spark, path).select("run", "camera", optional_int(F.col(column)).alias("frames"))
    asked = F.broadcast(spark.createDataFrame(streams, "run string, camera string").withColumn("_asked", F.lit(True)))
    met = rows.join(asked, ["run", "camera"], "full")
    same = F.assert_true(F.col("_asked").isNotNull() & F.col("frames").isNotNull(), F.concat(F.lit("unexpected or missing stream "), "run", F.lit("/"), "camera"))
    return met.filter(same.isNull()).select("run", "camera", "frames")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, digest): SHA-256 of whole files."""
    return files.digests(spark, path)


def union_of(frames: list[DataFrame]) -> DataFrame:
    """All rows under the union of the columns, by name; what a table lacks is null."""
    found = frames[0]
    for other in frames[1:]:
        found = found.unionByName(other, allowMissingColumns=True)
    return found.select(*sorted(found.columns))


def with_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """These columns in this order; those that rows lack are null."""
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, single: bool = False) -> None:
    """CSV files with headers in a folder, columns in the order asked for or by name; committed whole or not at all.

    single: one file, for small tables that another program reads; all rows then
    pass one task.
    """
    rows = df.select(*(columns or sorted(df.columns)))
    (rows.coalesce(1) if single else rows).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """A small JSON document, written beside its place and renamed, on any store of the cluster."""
    jvm = spark.sparkContext._jvm
    target, temporary = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(temporary, True)
    out.write(bytearray(json.dumps(value, indent=1, sort_keys=True).encode()))
    out.close()
    fs.delete(target, False)
    if not fs.rename(temporary, target):
        raise OSError(f"{path} could not be renamed")


def publish(df: DataFrame, path: str, by: str, parameters: dict) -> None:
    """A table as CSV below path/rows, and path/manifest.json with its parameters and how many rows each value of a column has; the manifest comes last."""
    write_csv(df, f"{path}/rows")
    counts = csv(df.sparkSession, f"{path}/rows").groupBy(F.coalesce(by, F.lit("")).alias("value")).count().collect()  # a column of few values
    write_json(df.sparkSession, f"{path}/manifest.json", {"parameters": parameters, "columns": sorted(df.columns), "rows": sum(r["count"] for r in counts), "counts": {r["value"]: r["count"] for r in counts}})


def published(spark: SparkSession, path: str) -> DataFrame:
    """(value, rows) of a manifest; a table without one was never finished."""
    rows = spark.read.schema("rows bigint, counts map<string, bigint>").json(f"{path}/manifest.json", multiLine=True)
    return rows.select(F.explode("counts").alias("value", "rows"))
