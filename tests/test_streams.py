"""Streams give what the batch gives, once, and go on from where they stopped."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators.facts import last_known_good, reconcile
from tidemark.sources import tables
from tidemark.streaming import jobs

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_sweep_resumes_and_drops_repeats(spark, tmp_path):
    source, to, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    rows = spark.range(100).selectExpr("id event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(id AS INT)) ts", "id % 5 user_id", "'x' event_type", "1.0D value", "'{}' props")
    rows.filter("event_id < 60").write.parquet(source)
    for _ in range(2):
        jobs.sweep(jobs.first_deliveries(jobs.event_stream(spark, source)), to, progress)
    rows.filter("event_id >= 40").write.mode("append").parquet(source)  # 20 of them come again
    jobs.sweep(jobs.first_deliveries(jobs.event_stream(spark, source)), to, progress)
    got = spark.read.parquet(to)
    assert got.count() == got.select("event_id").distinct().count() == 100


def test_tumbling_rate_closes_windows(spark, tmp_path):
    source, to = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.range(0, 10 * 3600, 600).selectExpr("id event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) ts", "1L user_id", "'x' event_type", "1.0D value", "'{}' props")
    rows.write.parquet(source)
    jobs.sweep(jobs.tumbling_rate(jobs.event_stream(spark, source)), to, str(tmp_path / "progress"))
    assert {r.n for r in spark.read.parquet(to).collect()} == {6}


def test_urls_and_text(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first()[0]

    lit = F.lit
    assert one(U.canonical_key(lit("HTTPS://www.Ex.org:80/A/index.html?utm_x=1&b=2&a=1&page=1&s=#f"))) == "ex.org/a?a=1&b=2"
    assert one(U.canonical_key(lit("http://ex.org//"))) == "ex.org/" and one(U.canonical_key(lit(" No Url/ "))) == "no url"
    assert one(U.repeats_segment(lit("http://e.org/news/news/x/news"))) and not one(U.repeats_segment(lit("http://e.org/a/a/a")))
    assert one(T.slug(lit("R&D -- Prize!"))) == "r-and-d-prize" and one(T.slug(lit("??"))) == "award"
    assert one(T.date_phrases(lit("Due Jan. 5, 2024 or 3/4/24, not 2024-01-0"))) == ["Jan. 5, 2024", "3/4/24"]
    assert one(T.without_relative_age(lit("posted 8 days ago here"))) == "posted here"
    assert one(T.cut_at_word(lit("one two three"), 9)) == "one two..." and one(T.http_status(lit("HTTP 404: gone"))) == 404
    assert one(T.jaccard(F.array(lit("a"), lit("b")), F.array(lit("b")))) == 0.5
    assert one(U.canonical_key(lit(None).cast("string"))) is None


def test_sinks_and_cursors(spark):
    old = spark.createDataFrame([(1, "a"), (None, "n")], "k long, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "c"), (None, "m")], "k long, v string")
    assert [r.k for r in tables.append_new(old, new, ["k"]).collect()] == [2]
    assert {(r.k, r.v) for r in tables.upsert(old, new.dropDuplicates(["k"]), ["k"]).collect()} == {(1, "b"), (2, "c"), (None, "m")}
    page = tables.keyset_page(spark.range(10).selectExpr("id % 3 a", "id b"), ["a", "b"], [1, 4], 3)
    assert [(r.a, r.b) for r in page.collect()] == [(1, 7), (2, 2), (2, 5)]
    assert tables.clamped_page(spark.range(10).toDF("x"), [F.asc("x")], 99, 4).count() == 2
    lines = spark.createDataFrame([("http://a | Prize | note",), ("  ",), ("| x",), ("http://b",)], "value string")
    assert [tuple(r) for r in tables.submissions(lines).collect()] == [("http://a", "Prize", "note"), ("http://b", None, None)]


def test_facts(spark):
    rows = [(1, "d", "X", 2.0, 1), (1, "d", "x ", 5.0, 2), (1, "d", "y", 5.0, 3), (2, "d", None, 1.0, 1)]
    got = {r.id: r for r in reconcile(spark.createDataFrame(rows, "id long, field_name string, raw string, score double, tie int"), ["id"], "raw", "score", "tie").collect()}
    assert (got[1].value, got[1].n_values, got[1].n_candidates, got[1].conflict) == ("x ", 2, 3, True) and not got[2].conflict
    new, old = (spark.createDataFrame([r], "id long, a string, b string") for r in ((1, None, "n"), (1, "o", "p")))
    assert tuple(last_known_good(new, old, ["id"], ["a", "b"]).first()) == (1, "o", "n", "a")
