"""Rollups: conditional measures, facets, histograms, coverage, identity digests, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.runs import same
from tidemark.sources.scratch import stored


def counts_by(frame: DataFrame, key: Column, name: str = "key", blank: str = "unknown") -> DataFrame:
    """Rows by key; null and blank keys count as one of their own."""
    value = F.coalesce(F.nullif(F.trim(key.cast("string")), F.lit("")), F.lit(blank))
    return frame.groupBy(value.alias(name)).agg(F.count("*").alias("n"))


def facets(frame: DataFrame, columns: dict[str, Column], extra: Column | None = None) -> DataFrame:
    """facet, value and n for several groupings in one pass: every row is expanded to its facets and pre-aggregated before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(name).alias("facet"), c.cast("string").alias("value")) for name, c in columns.items()])
    return frame.select(F.explode(pairs).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def measures(frame: DataFrame, keys: list[str], conditions: dict[str, Column]) -> DataFrame:
    """Counts of rows that fulfil each condition, in one aggregate; without keys a row of totals."""
    return frame.groupBy(*keys).agg(F.count("*").alias("total"), *[F.count_if(c).alias(name) for name, c in conditions.items()])


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """part as a percentage of whole; 0 of nothing."""
    return F.when(whole > 0, F.round(part * 100.0 / whole, digits)).otherwise(F.lit(0.0))


def identity_digest(frame: DataFrame, keys: list[str], item: str, n: str = "n", width: int = 1_000) -> DataFrame:
    """Count and SHA-256 of each key's items (whole numbers), in order: equal for equal multisets.

    Items are digested in runs of `width` numbers (those of a run joined by newlines), the runs' digests again by `width` runs that follow each other in
    number, and so on until a key has one: a tree of as many levels as the key's range asks for, where no value holds more than a run's items or `width` digests.
    An item that comes more than once is written with its count, so repeats don't swell a run.
    """
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__v"))), lambda r: r["__v"]), "\n")
    once = frame.groupBy(*keys, F.col(item).alias("__at")).agg(F.count("*").alias(n))
    node = once.withColumn("__v", F.concat(F.col("__at").cast("string"), F.when(F.col(n) > 1, F.concat(F.lit("x"), F.col(n).cast("string"))).otherwise("")))
    done = None
    while True:
        node = node.groupBy(*keys, F.floor(F.col("__at") / width).alias("__at")).agg(F.sum(n).alias(n), F.sha2(ordered, 256).alias("__v"))
        node = stored(node, "digests")
        runs = node.groupBy(*keys).agg(F.count("*").alias("__runs"))
        whole = node.alias("r").join(runs.alias("s"), same(keys, "r", "s")).select("r.*", "s.__runs")
        ended = whole.filter("__runs = 1").select(*keys, n, F.col("__v").alias("digest"))
        done = ended if done is None else done.unionByName(ended)
        node = whole.filter("__runs > 1").select(*keys, "__at", n, "__v")
        if node.isEmpty():
            return done


def remaining_budget(reservations: DataFrame, keys: list[str], cap: int, reserved: Column, spent: Column) -> DataFrame:
    """Reserved, spent and what remains of a cap for each key; never below zero."""
    sums = reservations.groupBy(*keys).agg(F.sum(reserved).alias("reserved"), F.sum(spent).alias("spent"))
    return sums.withColumn("remaining", F.greatest(F.lit(cap) - F.col("reserved") - F.col("spent"), F.lit(0)))


def calendar_gaps(frame: DataFrame, day: str, first: str, last: str) -> DataFrame:
    """Every day from first to last with the rows it has, 0 included."""
    days = frame.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("day"))
    seen = frame.groupBy(F.col(day).alias("day")).agg(F.count("*").alias("n"))
    return days.join(seen, "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
