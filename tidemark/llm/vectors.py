"""Preparation shared by the searches over vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, vec_id: str, embedding: str, *more: str) -> DataFrame:
    """vec_id (long), v (array of double) and more columns of vectors without null or non-finite components, with an id and of one component at least."""
    v = F.col(f"`{embedding}`").cast("array<double>")
    frame = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("v"), *more)
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return frame.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & whole)


def common_length(vectors: DataFrame) -> tuple[int, int]:
    """The commonest length of the vectors v (of equally common ones the larger) and how many have it; zeros for none."""
    row = vectors.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return (row["n"], row["count"]) if row else (0, 0)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def lists(rows: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32)), pa.array(rows.ravel()))


def in_slices(asked: DataFrame, most: int, n: int) -> tuple[DataFrame, int]:
    """Queries with their slice, of about `most` of all n at most, and the number of slices."""
    slices = max(1, -(-n // most))
    return asked.withColumn("slice", F.pmod(F.xxhash64(F.lit("slice"), "query_id"), F.lit(slices).cast("long")).cast("int")), slices


def for_slices(rows: DataFrame, routed: DataFrame, unit: list[str], slices: int) -> DataFrame:
    """Rows of blocks once for each slice whose queries reach their block: routed has unit, slice and a query a row."""
    if slices == 1:
        return rows.withColumn("slice", F.lit(0))
    return rows.join(routed.select(*[F.col(c).alias(c) for c in unit], F.col("slice").alias("slice")).distinct(), unit)
