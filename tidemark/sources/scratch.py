"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import suppress

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


_MADE: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; a local master without that setting gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    _MADE.append(f"{base.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Writes a frame as Parquet in the shared folder and returns it reread: lineage ends there, and a lost executor loses nothing."""
    path = shared_dir(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """A handle on the shared store that tasks can use for flat files (file, s3, hdfs, gs)."""
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri else "file://" + uri)


def drop_dir(spark: SparkSession, path: str) -> None:
    """Deletes a folder given by shared_dir, if it is there."""
    if path in _MADE:
        _MADE.remove(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    with suppress(Exception):  # one that was never written, or that another job holds, is no reason to stop
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear_scratch(spark: SparkSession) -> int:
    """Deletes all folders that this process was given by shared_dir, and returns how many there were. Results that read from them must be done with."""
    made = list(_MADE)
    for path in made:
        drop_dir(spark, path)
    return len(made)
