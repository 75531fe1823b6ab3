"""Order within a key when one key may hold a third of all rows.

Rows are dealt by range of key and order into runs, each sorted on its own and written; one row a run and key
then tells the runs after it what came before. No window sees more of the rows than such summaries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import stored

#: Bits of monotonically_increasing_id below the number of the partition.
PLACE_BITS = 33


def in_runs(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows with __run (numbers that rise with keys and order) and __at (rises within a run), written to the shared folder.

    Rows equal in keys and order are in one run, in any order: let order end in something unique.
    """
    by = [F.col(k).asc_nulls_first() for k in keys] + order
    placed = frame.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    return stored(placed.withColumn("__run", F.shiftright("__at", PLACE_BITS).cast("int")), "runs")


def same(keys: list[str], left: str, right: str) -> Column:
    """Equality of all keys of two aliased frames, null equal to null."""
    return reduce(lambda a, k: a & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")), keys, F.lit(True))


def earlier(keys: list[str]):
    """The window over a key's runs before each run."""
    return Window.partitionBy(*keys).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)


def with_summaries(runs: DataFrame, keys: list[str], summaries: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of runs with columns of the summary of their key and run."""
    joined = runs.alias("r").join(summaries.alias("s"), same([*keys, "__run"], "r", "s"))
    return joined.select("r.*", *[F.col(f"s.{c}") for c in columns])


def ranked(frame: DataFrame, keys: list[str], order: list[Column], name: str = "rank", count: str | None = None) -> DataFrame:
    """Adds each row's place in its key from 1 (long), and the key's rows as `count` if named. No keys: the place among all rows.

    Places of rows that are equal in keys and order are dealt among them in any order.
    """
    runs = in_runs(frame, keys, order)
    of_run = runs.groupBy(*keys, "__run").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    every = Window.partitionBy(*keys)
    of_run = of_run.select(*keys, "__run", "__first", F.coalesce(F.sum("__n").over(earlier(keys)), F.lit(0)).alias("__before"), F.sum("__n").over(every).alias("__all"))
    rows = with_summaries(runs, keys, of_run, ["__first", "__before", "__all"])
    out = [F.col(c) for c in frame.columns] + [(F.col("__before") + F.col("__at") - F.col("__first") + 1).alias(name)]
    return rows.select(*out, *([F.col("__all").alias(count)] if count else []))


def with_previous(frame: DataFrame, keys: list[str], order: list[Column], columns: dict[str, str]) -> DataFrame:
    """Adds values of the row before in the order of its key, null for the first. columns: new name to old name."""
    runs = in_runs(frame, keys, order)
    olds = [F.col(old).alias(f"__v{k}") for k, old in enumerate(columns.values())]
    of_run = runs.groupBy(*keys, "__run").agg(F.min("__at").alias("__first"), F.max_by(F.struct(*olds), "__at").alias("__last"))
    of_run = of_run.withColumn("__before", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__run"))).drop("__last")
    within = Window.partitionBy(*keys, "__run").orderBy("__at")
    rows = with_summaries(runs.withColumns({f"__w{k}": F.lag(old).over(within) for k, old in enumerate(columns.values())}), keys, of_run, ["__first", "__before"])
    first = F.col("__at") == F.col("__first")
    made = [F.when(first, F.col(f"__before.__v{k}")).otherwise(F.col(f"__w{k}")).alias(new) for k, new in enumerate(columns)]
    return rows.select(*[c for c in frame.columns if c not in columns], *made)


def blocked_by_older(frame: DataFrame, keys: list[str], order: list[Column], open_row: Column, name: str = "blocked") -> DataFrame:
    """Whether an earlier row of the key is still open: later ones must wait."""
    runs = in_runs(frame.withColumn("__open", F.coalesce(open_row, F.lit(False))), keys, order)
    of_run = runs.groupBy(*keys, "__run").agg(F.min(F.when(F.col("__open"), F.col("__at"))).alias("__since"))
    of_run = of_run.withColumn("__still", F.coalesce(F.max(F.col("__since").isNotNull()).over(earlier(keys)), F.lit(False)))
    rows = with_summaries(runs, keys, of_run, ["__since", "__still"])
    return rows.select(*frame.columns, (F.col("__still") | F.coalesce(F.col("__since") < F.col("__at"), F.lit(False))).alias(name))


def rolling_count(frame: DataFrame, keys: list[str], at: str, seconds: int, name: str = "recent") -> DataFrame:
    """Rows of the key within so many seconds up to each row, itself and others of its instant included; rows without a time count each other.

    Every row marks where its span begins and where it ends; what lies between is the difference of two running counts, so a span may reach over any number of runs.
    """
    rows = stored(frame.withColumn("__id", F.monotonically_increasing_id()), "rows")
    time = F.unix_micros(F.col(at).cast("timestamp"))
    mark = lambda t, kind: F.struct(t.alias("__t"), F.lit(kind).alias("__kind"))  # noqa: E731  0: begins, 1: the row, 2: ends
    marks = rows.select(*keys, "__id", F.explode(F.array(mark(time - seconds * 1_000_000, 0), mark(time, 1), mark(time, 2))).alias("__m")).select(*keys, "__id", "__m.*")
    runs = in_runs(marks, keys, [F.col("__t").asc_nulls_first(), F.col("__kind").asc(), F.col("__id").asc()])
    counted = (F.col("__kind") == 1).cast("long")
    of_run = runs.groupBy(*keys, "__run").agg(F.sum(counted).alias("__n"))
    of_run = of_run.withColumn("__before", F.coalesce(F.sum("__n").over(earlier(keys)), F.lit(0)))
    within = Window.partitionBy(*keys, "__run").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    so_far = with_summaries(runs.withColumn("__w", F.sum(counted).over(within)), keys, of_run, ["__before"]).filter("__kind <> 1")
    upto = F.col("__before") + F.col("__w")
    spans = so_far.groupBy("__id").agg(F.sum(F.when(F.col("__kind") == 2, upto).otherwise(-upto)).alias(name))
    return rows.join(spans, "__id").select(*frame.columns, name)
