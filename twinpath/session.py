"""Session helpers."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).parent


def local(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session on one machine, for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("twinpath")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return builder.config(map=settings | conf).getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that the driver and all executors see, deleted when the application ends: below spark.checkpoint.dir, or a temporary one where all of Spark is one process."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="twinpath-")
    folder = sc._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}-{uuid.uuid4().hex}")
    fs = folder.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.deleteOnExit(folder)
    return fs.makeQualified(folder).toString()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, unless their PYTHONPATH leads to it.

    The driver's own working folder and sys.path say nothing about theirs.
    """
    root = PACKAGE.parent
    sc = spark.sparkContext
    if root in map(Path, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))) or getattr(sc, "_twinpath_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="twinpath-")
    sc.addPyFile(shutil.make_archive(f"{folder}/twinpath", "zip", root, PACKAGE.name))
    sc._twinpath_shipped = True
