"""Leases as a stream with timers agree with the fold over all events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans import flows
from tidemark.streaming import jobs, leases

DATA = "/root/testdata/sf0.001"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_leases_agree_with_the_fold(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("lane"), "event_type")
    kind = F.when(F.col("event_type") == "view", "claim").when(F.col("event_type") == "click", "beat").when(F.col("event_type") == "error", "fail").otherwise("done")
    rows = events.withColumn("kind", kind).drop("event_type").orderBy("ts", "event_id").collect()
    schema = "event_id long, ts timestamp, lane string, kind string"
    source = f"file://{tmp_path}/in"
    step = -(-len(rows) // 5)
    for k in range(0, len(rows), step):
        spark.createDataFrame(rows[k : k + step], schema).coalesce(1).write.mode("append").parquet(source)
    for day in ("2024-01-31 00:00:00", "2024-01-31 00:00:01"):  # the clock goes on, and lanes that nobody renews end by timer
        spark.sql(f"SELECT -1L event_id, timestamp'{day}' ts, 'clock' lane, 'done' kind").coalesce(1).write.mode("append").parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        changed = leases.lease_changes(stream, "lane", "ts", "event_id", "kind", 86_400, 21_600, 864_000, late="0 seconds")
        jobs.sweep(changed, f"file://{tmp_path}/to", f"file://{tmp_path}/progress")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    moment = 1_706_659_200_000
    out = spark.read.parquet(f"file://{tmp_path}/to").filter(f"lane <> 'clock' AND at <= {moment}")
    last: dict = {}
    for r in out.collect():
        rank = (r["at"], r.state in ("expired", "idle"))
        if r.lane not in last or rank >= last[r.lane][0]:
            last[r.lane] = rank, (r.state, r.failures)
    want = {str(r.user_id): (r.state, r.failures) for r in flows.lane_leases(spark, DATA).collect()}
    assert {k: v[1] for k, v in last.items()} == want
    assert {s for s, _ in want.values()} >= {"expired", "idle"} and out.filter("state = 'expired'").count() > 0


def test_deadlines():
    lane = leases.Leases(60, 10, 100)
    assert lane.deadline(5_000_000, "claim", 0) == 65_000 and lane.deadline(5_000_001, "beat", 0) == 65_001 and lane.deadline(0, "done", 0) is None
    assert [lane.deadline(0, "fail", n) for n in (1, 2, 4, 9)] == [10_000, 20_000, 80_000, 100_000]
