"""Tables written to the folder that driver and executors share, to cut lineage, and bounded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.scratch import file_system, shared_dir  # noqa: F401  (file_system is used from here)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and returns it reread: lineage ends there, and a lost executor loses nothing."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_sample(frame: DataFrame, key: str, limit: int, n: int | None = None) -> DataFrame:
    """The rows with the `limit` smallest hashes of a key, all if fewer; keys that repeat much may leave fewer.

    Of large tables only about twice the limit's rows get to the sort, so what it gathers doesn't grow with the table. n: their rows, if known.
    """
    n, h = frame.count() if n is None else n, F.xxhash64(key)
    if n > 2 * limit:
        frame = frame.filter(h <= -(2**63) + int(2**64 * 2 * limit / n))
    return frame.orderBy(h, key).limit(limit)
