"""Ranks, previous rows, open rows and rolling counts within hot keys, against windows over whole keys."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import keyed, rollups, runs


@pytest.fixture(scope="module", autouse=True)
def many_runs(spark):
    """Small partitions stay apart, so that keys lie in several runs."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def rows(spark):
    """6,000 rows, a third of one key, with null keys and times and many at the same instant."""
    key = F.expr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE 'k' || (id % 20) END")
    at = F.expr("CASE WHEN id % 97 <> 0 THEN timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, CAST((id * 7919) % 4000 AS INT) * 30) END")
    return spark.range(6000).select("id", key.alias("k"), at.alias("ts"), (F.col("id") % 7 == 0).alias("open"), F.when(F.col("id") % 5 > 0, F.col("id") % 11).alias("v")).cache()


def as_set(frame):
    return sorted(map(str, frame.collect()))


def order():
    return [F.desc("ts"), F.asc("id")]


def test_ranks_and_batches(spark, rows):
    own = Window.partitionBy("k")
    want = rows.withColumns({"rank": F.row_number().over(own.orderBy(*order())).cast("long"), "n": F.count("*").over(own)})
    assert as_set(runs.ranked(rows, ["k"], order(), count="n").select(*want.columns)) == as_set(want)
    every = rows.withColumn("rank", F.row_number().over(Window.orderBy(*order())).cast("long"))
    assert as_set(runs.ranked(rows, [], order())) == as_set(every)
    got = keyed.batches(rows, ["k"], order(), 12)
    assert as_set(got) == as_set(want.withColumn("batch", F.floor((F.col("rank") - 1) / 12).cast("int")).select(*got.columns))
    assert runs.ranked(rows.limit(0), ["k"], order()).count() == 0


def test_a_hot_key_lies_in_many_runs(rows):
    placed = runs.in_runs(rows, ["k"], order())
    sizes = {r["__run"]: r["count"] for r in placed.groupBy("__run").count().collect()}
    assert len(sizes) == 8 and max(sizes.values()) < 2 * 6000 / 8
    assert placed.filter("k = 'hot'").select("__run").distinct().count() >= 3


def test_previous_rows(rows):
    by = [F.asc("ts"), F.desc("id")]
    before = Window.partitionBy("k").orderBy(*by)
    want = rows.withColumns({"pv": F.lag("v").over(before), "pid": F.lag("id").over(before)})
    assert as_set(runs.with_previous(rows, ["k"], by, {"pv": "v", "pid": "id"})) == as_set(want)


def test_blocked(rows):
    before = Window.partitionBy("k").orderBy(*order()).rowsBetween(Window.unboundedPreceding, -1)
    for is_open in (F.col("open"), F.col("v") == 3, F.lit(False)):
        want = rows.withColumn("blocked", F.coalesce(F.max(is_open).over(before), F.lit(False)))
        assert as_set(runs.blocked_by_older(rows, ["k"], order(), is_open)) == as_set(want)


@pytest.mark.parametrize("seconds", [0, 30, 3600, 10**6])
def test_rolling_counts(rows, seconds):
    span = Window.partitionBy("k").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    assert as_set(runs.rolling_count(rows, ["k"], "ts", seconds)) == as_set(rows.withColumn("recent", F.count("*").over(span)))


def test_digests_are_a_tree(spark):
    H = lambda parts: hashlib.sha256("\n".join(parts).encode()).hexdigest()

    def digest(items, width):
        level = {i: f"{i}" + (f"x{items.count(i)}" if items.count(i) > 1 else "") for i in items}
        while True:
            level = {run: H([level[i] for i in sorted(level) if i // width == run]) for run in {i // width for i in level}}
            if len(level) == 1:
                return next(iter(level.values()))

    keys = {"a": list(range(100)), "b": [5], None: [3, 3, 990], "c": [7, 12, 999, 1000, 100_000]}
    frame = spark.createDataFrame([(k, i) for k, items in keys.items() for i in items], "k string, i long")
    got = {r.k: (r.n, r.digest) for r in rollups.identity_digest(frame, ["k"], "i", width=4).collect()}
    assert got == {k: (len(v), digest(v, 4)) for k, v in keys.items()}
    assert rollups.identity_digest(frame.limit(0), ["k"], "i").count() == 0
