"""Facts: unpivot candidates, reconcile them by field, find conflicts, pivot, fill with the last known good."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpivot_facts(frame: DataFrame, keys: list[str], fields: dict[str, Column]) -> DataFrame:
    """One row a field that isn't null or blank: keys, field_name, raw_value."""
    pairs = F.array(*[F.struct(F.lit(n).alias("field_name"), c.cast("string").alias("raw_value")) for n, c in fields.items()])
    rows = frame.select(*keys, F.explode(pairs).alias("f")).select(*keys, "f.field_name", "f.raw_value")
    return rows.filter(F.trim("raw_value") != "")


def reconcile(candidates: DataFrame, keys: list[str], value: str, score: str, tie: str) -> DataFrame:
    """For each key and field the value of the best score (ties: smallest tie column), and how many different values compete.

    Aggregated by normalised value, then by field, with map-side combine: partial counts and best rows travel, not candidates. Both aggregates
    are sort-based, as values are strings.
    """
    by = [*keys, "field_name"]
    rank = F.struct(F.col(score), -F.col(tie))
    groups = candidates.groupBy(*by, F.lower(F.trim(value)).alias("__key")).agg(
        F.max_by(F.col(value), rank).alias("value"), F.max(rank).alias("rank"), F.count("*").alias("n")
    )
    return groups.groupBy(*by).agg(
        F.max_by("value", "rank").alias("value"), F.count("*").alias("n_values"), F.sum("n").alias("n_candidates")
    ).withColumn("conflict", F.col("n_values") > 1)


def pivot_facts(selected: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row a key with a column for each of the named fields."""
    return selected.groupBy(*keys).agg(*[F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f) for f in fields])


def last_known_good(new: DataFrame, old: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """New rows, their blank columns filled from old ones; preserved names the filled columns."""
    was = old.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    blank = {c: F.col(c).isNull() & F.col(f"__{c}").isNotNull() for c in columns}
    kept = F.array_compact(F.array(*[F.when(blank[c], F.lit(c)) for c in columns]))
    filled = [F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) for c in columns]
    return new.join(was, keys, "left").select(*keys, *filled, F.array_join(kept, ",").alias("preserved"))
