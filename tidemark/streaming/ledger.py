"""Streams that lose nothing: late and repeated rows meet a ledger that is kept as a table, instead of a watermark that drops them.

Every micro-batch writes one folder, batch=N, and replaces it if it is run again after a failure; what it looks up are the batches
before it only. A batch that ended halfway leaves nothing behind that the next attempt would take for done.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import states
from tidemark.operators.runs import same


def ledger_table(spark: SparkSession, path: str, columns: str, keys: list[str], buckets: int) -> str:
    """Name of a table over the ledger's folder, bucketed by keys; batches that earlier runs have written there belong to it."""
    name = "ledger_" + hashlib.sha256(path.encode()).hexdigest()[:20]
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}, batch BIGINT) USING parquet PARTITIONED BY (batch) CLUSTERED BY ({', '.join(f'`{k}`' for k in keys)}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return name


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there, batch by batch, then stops; the next run goes on from the checkpoint."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def deliver_once(stream: DataFrame, to: str, checkpoint: str, keys: list[str], buckets: int = 8, after: Callable[[int], None] | None = None) -> DataFrame:
    """The ledger after a run: each key's row once, however often and however late it comes again. Rows with a null in keys can have no receipt and are delivered each.

    A batch loses repeats within itself by an aggregate, then those that the ledger holds by an anti-join; the ledger is bucketed by keys, so only
    the batch is shuffled. after(batch) is called once a batch is written.
    """
    spark = stream.sparkSession
    columns = stream.columns
    name = ledger_table(spark, to, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields), keys, buckets)
    whole = reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.lit(True))

    def write(rows: DataFrame, batch: int) -> None:
        session = rows.sparkSession
        session.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")  # of this batch's folder alone
        done = session.table(name).filter(F.col("batch") < batch).select(*keys)
        fresh = rows.filter(whole).dropDuplicates(keys).join(done, keys, "left_anti").select(*columns).unionByName(rows.filter(~whole))
        fresh.withColumn("batch", F.lit(batch).cast("bigint")).write.insertInto(name, overwrite=True)
        if after:
            after(batch)

    run_batches(stream, write, checkpoint)
    spark.catalog.refreshTable(name)
    return spark.table(name).select(*columns)


def count_batches(stream: DataFrame, to: str, checkpoint: str, keys: list[str], after: Callable[[int], None] | None = None) -> DataFrame:
    """keys and n, the rows of each, after a run. Counts add up, so every batch keeps its own and nothing is too late for its window."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.groupBy(*keys).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{to}/batch={batch}")
        if after:
            after(batch)

    spark = stream.sparkSession
    schema = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys) + ", n bigint"
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{to}/batch=-1")  # there is a table before the first batch
    run_batches(stream, write, checkpoint)
    return spark.read.schema(schema + ", batch bigint").parquet(to).groupBy(*keys).agg(F.sum("n").alias("n"))


def admit_batches(stream: DataFrame, to: str, checkpoint: str, keys: list[str], order: list[str], amount: str, cap: int, after: Callable[[int], None] | None = None) -> DataFrame:
    """Requests with admitted after a run: whether each fits in what its key's earlier admitted ones have left of a cap.

    Within a batch requests are taken in order, spread over tasks (states.admitted); what keys have spent in the batches before is summed from what these have written.
    """
    spark = stream.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields) + ", admitted boolean"
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{to}/batch=-1")  # there is a table before the first batch

    def write(rows: DataFrame, batch: int) -> None:
        before = rows.sparkSession.read.schema(schema + ", batch bigint").parquet(to).filter((F.col("batch") < batch) & F.col("admitted"))
        spent = before.groupBy(*keys).agg(F.sum(amount).alias("spent"))
        states.admitted(rows, keys, order, amount, cap, spent).write.mode("overwrite").parquet(f"{to}/batch={batch}")
        if after:
            after(batch)

    run_batches(stream, write, checkpoint)
    return spark.read.schema(schema + ", batch bigint").parquet(to).drop("batch")


def decisions(spark: SparkSession, to: str, keys: list[str]) -> DataFrame:
    """keys and decision: the newest of each key that policy_sweep has written."""
    rows = spark.read.parquet(f"{to}/decisions")
    return rows.groupBy(*keys).agg(F.max_by("decision", F.struct("generation", "batch")).alias("decision"))


def policy_sweep(stream: DataFrame, decide: Callable[[DataFrame], Column], policy: object, to: str, keys: list[str]) -> DataFrame:
    """keys and decision after a sweep under a policy (anything that json can say, with whose change decisions may change).

    Progress belongs to the policy's hash: while it stays the same, a run goes on with new rows; when it has changed, also back to one used before,
    a new generation goes through all rows again. Only decisions that differ from the newest one of their key are written, so a change
    of the policy shows as the changes that it makes. Of rows of one key in a batch any one decides.
    """
    spark = stream.sparkSession
    mark = hashlib.sha256(json.dumps(policy, sort_keys=True).encode()).hexdigest()[:20]
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{to}/progress")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    known = sorted((int(g), h) for g, h in (f.getPath().getName().split("-") for f in (fs.listStatus(where) if fs.exists(where) else [])))
    generation = known[-1][0] if known and known[-1][1] == mark else (known[-1][0] if known else 0) + 1
    schema = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys) + ", decision string"
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{to}/decisions/generation=0/batch=0")  # there is a table before the first batch

    def write(rows: DataFrame, batch: int) -> None:
        before = rows.sparkSession.read.schema(schema + ", generation int, batch bigint").parquet(f"{to}/decisions")
        before = before.filter((F.col("generation") < generation) | (F.col("generation") == generation) & (F.col("batch") < batch))
        newest = before.groupBy(*keys).agg(F.max_by(F.struct("decision"), F.struct("generation", "batch")).alias("was"))
        decided = rows.withColumn("decision", decide(rows).cast("string")).select(*keys, "decision").dropDuplicates(keys)
        joined = decided.alias("r").join(newest.alias("s"), same(keys, "r", "s"), "left").select("r.*", "s.was")
        changed = joined.filter(F.col("was").isNull() | ~F.col("was.decision").eqNullSafe(F.col("decision"))).drop("was")
        changed.write.mode("overwrite").parquet(f"{to}/decisions/generation={generation}/batch={batch}")

    run_batches(stream, write, f"{to}/progress/{generation}-{mark}")
    return decisions(spark, to, keys)
