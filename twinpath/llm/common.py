"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python kernel turns into Python objects at a time.
SLICE_ROWS = 128


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables.

    The cluster's own setting is used when there is one. An unset one is replaced
    by a temporary folder where all of Spark is one process, as in tests;
    elsewhere nothing that executors write there would be found again.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = sc.getConf().get("spark.checkpoint.dir")
    if not configured and not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="twinpath-checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, path: str, delete: bool = False) -> None:
    """Has a folder deleted when the application ends, or now."""
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.delete(hadoop, True) if delete else fs.deleteOnExit(hadoop)


def checkpoint_file(df: DataFrame) -> str | None:
    """Where the rows of what `cut` returned lie."""
    plan = df._jdf.queryExecution().analyzed()
    found = plan.rdd().getCheckpointFile() if plan.nodeName().startswith("Scan") or "LogicalRDD" in plan.getClass().getName() else None
    return found.get() if found is not None and found.isDefined() else None


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder until the application ends, so that no lost executor repeats what made it."""
    ensure_checkpoint_dir(df.sparkSession)
    made = df.checkpoint()
    if path := checkpoint_file(made):
        shared_path(df.sparkSession, path)
    return made


def dropped(df: DataFrame) -> None:
    """Deletes what `cut` wrote for df, which nothing may read any more."""
    if path := checkpoint_file(df):
        shared_path(df.sparkSession, path, delete=True)


#: A key that more than one in so many rows have is hot; fewer than so many keys are.
HOT = 1000


def joined(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """rows joined to keyed, which holds each key once with the number of its rows in `count`, of `total` in all.

    Fewer than `HOT` rows of keyed, those of hot keys, are broadcast; rows that
    meet one go anywhere in the shuffle for the others, so no key is much of a
    task. The last key must be a long.
    """
    values = [c for c in keyed.columns if c not in keys]
    hot = keyed.filter(F.col(count) * HOT > total).select(*keys, F.struct(*values).alias("_hot"))
    cold = keyed.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*values).alias("_cold"))
    marked = rows.join(F.broadcast(hot), keys, "left")
    spread = [F.col(k) for k in keys[:-1]] + [F.when(F.col("_hot").isNotNull(), F.xxhash64(*rows.columns)).otherwise(F.col(keys[-1]))]
    met = marked.join(cold, [s == F.col(f"_{k}") for k, s in zip(keys, spread, strict=True)], "left").withColumn("_found", F.coalesce("_hot", "_cold"))
    return met.filter(F.col("_found").isNotNull()).select(*rows.columns, *[F.col(f"_found.{v}").alias(v) for v in values])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(column: str | Column) -> Column:
    """A text column whose nulls are the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Short slices, so that few texts at a time exist as Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


#: Bytes of a batch between the JVM and Python: a batch is held on both sides at once.
BATCH_BYTES = 8 << 20


def bounded(docs: DataFrame) -> DataFrame:
    """docs as they are; from now on the session cuts their batches for Python by bytes, where it would allow larger ones."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    size = conf.get(key).removesuffix("b")
    if not size.isdigit() or int(size) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return docs


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_order_bucket(df: DataFrame, key: str, buckets: int, name: str = "bucket") -> DataFrame:
    """Adds an int that grows with the key: about equal rows in each bucket, nulls in bucket -1.

    Only the quantiles of the key column come to the driver, one long for each
    bucket; the scan for them reads that column alone. Equal keys share a bucket.
    """
    probabilities = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(key, probabilities, max(10_000, 20 * buckets)).alias("q")).first()["q"] if probabilities else None
    bounds = sorted(set(found or []))
    if not bounds:
        return df.withColumn(name, F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.lit(0)))
    # binary search: the number of bounds below the key
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    middle = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    halve = lambda s, _: F.when(s["lo"] >= s["hi"], s).when(F.get(table, middle(s)) < F.col(key), F.struct((middle(s) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), middle(s).alias("hi")))
    steps = F.sequence(F.lit(0), F.lit(len(bounds).bit_length()))
    place = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), halve)["lo"]
    return df.withColumn(name, F.when(F.col(key).isNull(), F.lit(-1)).otherwise(place))
