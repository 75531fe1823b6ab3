"""Streams over many files in any order, several batches, and a stop in between: nothing is lost, nothing comes twice."""

from __future__ import annotations

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidemark.streaming import jobs, ledger

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """The events in 48 files, dealt without regard to time."""
    folder = f"file://{tmp_path_factory.mktemp('events')}/in"
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.repartition(48, F.xxhash64("event_id", F.lit(7))).write.parquet(folder)
    return folder


class Stop:
    """Fails once after the given batch has been written."""

    def __init__(self, batch):
        self.left = batch

    def __call__(self, batch):
        if batch == self.left:
            self.left = None
            raise RuntimeError("stopped")


@pytest.mark.parametrize("stop", [0, 1])
def test_deliveries(spark, files, tmp_path, stop):
    to, progress, after = f"file://{tmp_path}/to", f"file://{tmp_path}/progress", Stop(stop)
    stream = jobs.event_stream(spark, files).union(jobs.event_stream(spark, files)).select("event_id", "user_id")
    with pytest.raises(StreamingQueryException):
        ledger.deliver_once(stream, to, progress, ["event_id"], after=after)
    out = ledger.deliver_once(stream, to, progress, ["event_id"], after=after)
    want = {(r.event_id, r.user_id) for r in spark.read.parquet(f"{DATA}/events.parquet").collect()}
    got = [tuple(r) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)
    assert spark.read.parquet(to).select("batch").distinct().count() >= 3
    again = ledger.deliver_once(stream, to, progress, ["event_id"])  # nothing new
    assert again.count() == len(want)


def test_rates(spark, files, tmp_path):
    to, progress, after = f"file://{tmp_path}/to", f"file://{tmp_path}/progress", Stop(1)
    stream = jobs.event_stream(spark, files).select(F.date_trunc("hour", "ts").alias("hour"), "user_id")
    with pytest.raises(StreamingQueryException):
        ledger.count_batches(stream, to, progress, ["hour", "user_id"], after)
    out = ledger.count_batches(stream, to, progress, ["hour", "user_id"], after)
    want = spark.read.parquet(f"{DATA}/events.parquet").groupBy(F.date_trunc("hour", "ts").alias("hour"), "user_id").count()
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_ledger_is_not_shuffled(spark, tmp_path):
    name = ledger.ledger_table(spark, f"file://{tmp_path}/kept", "id bigint, x int", ["id"], 8)
    spark.range(1000).selectExpr("id", "1 x", "0L batch").write.insertInto(name)
    rows = spark.range(500, 1500).repartition(3)
    joined = rows.join(spark.table(name).filter("batch < 1").select("id").hint("merge"), "id", "left_anti")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 500
    assert plan.count("hashpartitioning") == 1 and "SelectedBucketsCount: 8 out of 8" in plan  # of the batch alone


def test_nulls_nothing_and_late_files(spark, tmp_path):
    to, progress, source = (f"file://{tmp_path}/{x}" for x in ("to", "progress", "in"))
    schema = "k long, v string"
    spark.createDataFrame([], schema).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    assert ledger.deliver_once(stream, to, progress, ["k"]).count() == 0
    assert ledger.count_batches(stream, f"{to}-n", f"{progress}-n", ["v"]).count() == 0
    for rows in ([(1, "a"), (1, "b"), (None, "c")], [(None, "c"), (2, "a"), (1, "z")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        got = ledger.deliver_once(stream, to, progress, ["k"]).collect()
        n = {r.v: r.n for r in ledger.count_batches(stream, f"{to}-n", f"{progress}-n", ["v"]).collect()}
    assert sorted(str(r.k) for r in got) == ["1", "2", "None", "None"] and n == {"a": 2, "b": 1, "c": 2, "z": 1}


def test_a_changed_policy_sweeps_again(spark, files, tmp_path):
    """Old events are decided anew, and only decisions that the change moves are written."""
    to = f"file://{tmp_path}/swept"
    events = {r.event_id: r for r in spark.read.parquet(f"{DATA}/events.parquet").collect()}

    def run(policy):
        stream = jobs.event_stream(spark, files)
        decide = lambda rows: F.when(F.col("event_type").isin(policy["types"]) & (F.col("value") >= policy["least"]), "hidden")
        out = ledger.policy_sweep(stream, decide, policy, to, ["event_id"])
        got = {r.event_id: r.decision for r in out.collect()}
        assert got == {k: "hidden" if r.event_type in policy["types"] and r.value >= policy["least"] else None for k, r in events.items()}
        return spark.read.parquet(f"{to}/decisions").groupBy("generation").count().orderBy("generation").collect()

    first, second = {"types": ["error"], "least": 0}, {"types": ["error", "click"], "least": 5}
    assert [tuple(r) for r in run(first)] == [(1, len(events))]
    assert [tuple(r) for r in run(first)] == [(1, len(events))]  # the same policy goes on where it was
    moved = sum((r.event_type == "error") != (r.event_type in second["types"] and r.value >= 5) for r in events.values())
    assert 0 < moved < len(events) and [tuple(r) for r in run(second)] == [(1, len(events)), (2, moved)]
    assert [tuple(r) for r in run(first)] == [(1, len(events)), (2, moved), (3, moved)]  # and back
