"""Scans: whole tables, keyset pages, bounded and incremental scans, and idempotent sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the folder; only the named columns are read."""
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def after(keys: list[str], values: list, descending: bool = False) -> Column:
    """Rows that follow the cursor (values of keys) in the order of keys, compared as a tuple; null keys never follow."""
    step = (lambda c, v: F.col(c) < F.lit(v)) if descending else (lambda c, v: F.col(c) > F.lit(v))
    out = F.lit(False)
    for c, v in reversed(list(zip(keys, values))):
        out = step(c, v) | ((F.col(c) == F.lit(v)) & out)
    return F.coalesce(out, F.lit(False))


def keyset_page(frame: DataFrame, keys: list[str], cursor: list | None, size: int, descending: bool = False) -> DataFrame:
    """The next page after a cursor in a total order of keys, nulls last."""
    if cursor is not None:
        frame = frame.filter(after(keys, cursor, descending))
    order = [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last() for c in keys]
    return frame.orderBy(*order).limit(size)


def clamped_page(frame: DataFrame, order: list[Column], page: int, size: int, most: int = 500) -> DataFrame:
    """A numbered page; page and size are brought into range first. One count and one top-k, no full sort to the driver."""
    size = max(1, min(size, most))
    pages = max(1, -(-frame.count() // size))
    page = min(max(1, page), pages)
    return frame.orderBy(*order).offset((page - 1) * size).limit(size)


def bounded_scan(frame: DataFrame, at: str, run_start) -> DataFrame:
    """Rows strictly before the start of the run: rows at that very instant wait for the next one."""
    return frame.filter(F.col(at) < F.lit(run_start))


def append_new(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't there yet, once each: what an insert that ignores conflicts adds. Null keys are equal to each other."""
    fresh = rows.dropDuplicates(keys)
    taken = existing.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return fresh.join(taken, same, "left_anti")


def upsert(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table after a last-writer-wins merge; rows hold each key once."""
    same = F.lit(True)
    new = rows.select(*[F.col(k).alias(f"__{k}") for k in keys])
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return existing.join(new, same, "left_anti").unionByName(rows, allowMissingColumns=True)


def submissions(lines: DataFrame, value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """One submission a line: `url | award | notes`, with the columns to keep; blank lines and lines without a url go."""
    parts = F.split(F.trim(F.col(value)), r"\s*\|\s*")
    part = lambda k: F.nullif(F.trim(F.get(parts, F.lit(k))), F.lit(""))
    return lines.select(*(keep or []), part(0).alias("url"), part(1).alias("award_name"), part(2).alias("notes")).filter("url IS NOT NULL")


def csv_field(c: Column) -> Column:
    """A field quoted where commas, quotes or line ends ask for it; null is empty."""
    value = F.coalesce(c.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[",\\r\\n]'), quoted).otherwise(value)
