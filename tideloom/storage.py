"""Tables in the folder that driver and executors share, to cut lineage between rounds."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset and all runs in one process, as in tests, a new local
    one.  Executors elsewhere would each write to a disk of their own, so without the setting that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", master := spark.sparkContext.master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="tideloom-"))
        atexit.register(shutil.rmtree, _local[0], True)
    return "file://" + _local[0]


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application's JVM ends."""
    path = f"{shared_dir(spark)}/tideloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    fs, where = _hadoop(spark, path)
    fs.deleteOnExit(where)
    return path


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _hadoop(spark, path)
    fs.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _hadoop(spark, path)
    return fs.exists(where)


def written(df: DataFrame, path: str) -> int:
    """Write ``df`` to ``path`` and return its number of rows, counted as it is written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    return seen.get["rows"]


def table(spark: SparkSession, like: DataFrame, *paths: str) -> DataFrame:
    return spark.read.schema(like.schema).parquet(*paths)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return table(df.sparkSession, df, path)
