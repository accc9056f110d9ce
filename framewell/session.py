"""Session helpers shared by all operators."""

from __future__ import annotations

import gc
import os
import tempfile
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where neither the setting nor a checkpoint folder exists and all tasks run on
    this machine (a local test session) a temporary folder is created and set.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="framewell-"))
    return spark.sparkContext.getCheckpointDir()


def reach(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver has it; a cluster installs it or gets it with ``--py-files``."""
    place, held = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if place not in held.get("PYTHONPATH", "").split(os.pathsep):
        held["PYTHONPATH"] = os.pathsep.join(filter(None, [place, held.get("PYTHONPATH")]))


#: Seconds between two collections of the driver's garbage at least, and when the last one was.
PAUSE, _last = 2.0, [0.0]


def tidy(spark: SparkSession) -> None:
    """Let Spark drop shuffle files and checkpoints that nothing refers to any more.

    It does so when the driver's garbage is collected, which a driver with little to do seldom does by
    itself, so a loop of shuffles would fill the disks.
    """
    if time.monotonic() - _last[0] >= PAUSE:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _last[0] = time.monotonic()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return a frame that reads it."""
    checkpoint_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    tidy(df.sparkSession)
    return kept


def partitions(spark: SparkSession) -> int:
    """The session's shuffle partition count."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
