"""Files as tables of their names and lengths; Python workers read them by ranges and write them whole."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a worker holds of a file at a time.
BLOCK = 1 << 20


def located(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store and the path in it of a URI as Hadoop writes it."""
    scheme, _, rest = uri.partition(":") if re.match("[a-z0-9]+:/", uri) else ("file", "", uri)
    host, path = (rest[2:].split("/", 1) if rest.startswith("//") else ("", rest.lstrip("/")))
    return pyarrow.fs.FileSystem.from_uri(f"{scheme}://{host}/{quote(path)}")


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files at a path; nothing of them is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def ranges(files: DataFrame, size: int) -> DataFrame:
    """(path, length, start, stop): files cut into ranges of at most `size` bytes, dealt evenly; empty files have none."""
    cut = files.filter("length > 0").withColumn("start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(size).cast("bigint"))))
    return cut.withColumn("stop", F.least(F.col("start") + size, F.col("length"))).repartition("path", "start")


def read(uri: str, start: int, stop: int) -> bytes:
    store, path = located(uri)
    with store.open_input_file(path) as file:
        file.seek(start)
        return file.read(max(0, stop - start))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, digest): SHA-256 of whole files, each in one pass over blocks."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for uri, length in zip(batch["path"], batch["length"], strict=True):
                digest = hashlib.sha256()
                store, name = located(uri)
                with store.open_input_stream(name) as file:
                    while block := file.read(BLOCK):
                        digest.update(block)
                rows.append((uri, length, digest.hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "bytes", "digest"])

    return listed(spark, path).mapInPandas(each, "path string, bytes long, digest string")


def write_each(contents: DataFrame, folder: str) -> int:
    """Writes each row (name, content) as a file below a folder; a task that runs again writes the same. Returns the number of files."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            store, root = located(folder)
            for name, content in zip(batch["name"], batch["content"], strict=True):
                store.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{root}/{name}") as file:
                    file.write(bytes(content))
            yield pd.DataFrame({"files": [len(batch)]})

    return contents.select("name", F.col("content").cast("binary").alias("content")).mapInPandas(each, "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]
