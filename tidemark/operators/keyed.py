"""Per key: latest rows, ranks, retention, dedupe, batches, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.runs import ranked


def latest_per_key(frame: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is largest by order. One aggregate with map-side combine (a sort-based one, as whole rows are kept): rows of a key don't meet in one task."""
    rest = [c for c in frame.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return frame.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*frame.columns)


def first_per_key(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by order; Spark drops later rows on the map side."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return frame.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def top_per_key(frame: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key with their rank, from 1."""
    return frame.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def beyond_newest(frame: DataFrame, keys: list[str], order: list[Column], keep: int, referenced: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Rows that retention may delete: beyond the newest `keep` of a key and not referenced by another table. The column `key` is unique.

    Only the newest of a key are ranked (Spark drops others on the map side); all rows then meet those few, so no key is sorted as a whole.
    """
    newest = top_per_key(frame, keys, order, keep, "__rank").select(key)
    rows = frame.join(newest, key, "left_anti")
    return rows if referenced is None else rows.join(referenced, key, "left_anti")


def batches(frame: DataFrame, keys: list[str], order: list[Column], size: int, name: str = "batch") -> DataFrame:
    """Numbers rows of each key in runs of at most `size`, from 0. A key of very many rows is ranked over several tasks."""
    placed = ranked(frame, keys, order, "__place")
    return placed.withColumn(name, F.floor((F.col("__place") - 1) / size).cast("int")).drop("__place")


def occurrences(frame: DataFrame, keys: list[str], order: list[Column], name: str = "occurrence") -> DataFrame:
    """Which row of its key each one is, from 1: unique suffixes for equal slugs."""
    return frame.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def with_previous_id(frame: DataFrame, keys: list[str], id: str, name: str = "previous", width: int = 100_000) -> DataFrame:
    """Adds the next smaller id of the row's key, null for its smallest. Ids are whole numbers, unique in their key.

    A key is cut into runs of `width` ids, which are sorted each on its own; the last id of each run goes on to the next, so a key of a third of all rows
    is spread over its runs, and only one row a run meets in a key's window.
    """
    run = F.floor(F.col(id) / width)
    rows = frame.withColumn("__run", run)
    within = F.lag(id).over(Window.partitionBy(*keys, "__run").orderBy(id))
    ends = rows.groupBy(*keys, "__run").agg(F.max(id).alias("__end"))
    before = ends.withColumn("__before", F.lag("__end").over(Window.partitionBy(*keys).orderBy("__run"))).drop("__end")
    same = F.lit(True)
    for k in [*keys, "__run"]:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"e.{k}"))
    joined = rows.withColumn("__within", within).alias("r").join(before.alias("e"), same, "left")
    return joined.select(*[F.col(f"r.{c}") for c in frame.columns], F.coalesce("__within", "__before").alias(name))


def merge_fields(frame: DataFrame, keys: list[str], order: list[str], best: dict[str, str]) -> DataFrame:
    """One row a key: each field is taken from the first row by order that has it. best: field to 'first', 'max' or 'min'."""
    kinds = {"max": F.max, "min": F.min}
    fields = [
        kinds[how](c).alias(c) if how in kinds else F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c, how in best.items()
    ]
    return frame.groupBy(*keys).agg(*fields)
