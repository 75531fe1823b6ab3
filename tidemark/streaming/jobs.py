"""Streams over event files: resumable sweeps, windowed counts, first-seen rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Event files as a stream; ts becomes a timestamp, as watermarks ask for."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_rate(events: DataFrame, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Events by user and window; windows close once the watermark has passed them."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "user_id").count()
    return counted.select(F.col("w.start").alias("hour"), "user_id", F.col("count").alias("n"))


def first_deliveries(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def sweep(stream: DataFrame, to: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there into Parquet, then stops. Progress is kept in the checkpoint, so the next run goes on from there."""
    query = stream.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).outputMode(mode)
    query.trigger(availableNow=True).start().awaitTermination()


def sweep_updates(stream: DataFrame, to: str, checkpoint: str) -> None:
    """Runs an aggregating stream over all that is there. Every batch writes the rows that it has changed to a folder of its number, so a batch that is
    run again after a failure replaces what it wrote before."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{to}/batch={batch}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()


def newest(spark: SparkSession, to: str, keys: list[str]) -> DataFrame:
    """The latest state of every key among the batches that sweep_updates has written."""
    rows = spark.read.parquet(to)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in rest])
