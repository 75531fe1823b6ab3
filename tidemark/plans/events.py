"""Queries over the change events, queues, budgets and deliveries that the events table stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import times
from tidemark.operators import keyed, rollups, runs
from tidemark.sources import tables

from .registry import query

START, CURSOR = "2024-01-20 00:00:00", "2024-01-15 12:00:00"


def k_of_props():
    return F.get_json_object("props", "$.k").cast("long")


def events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return tables.table(spark, sf_dir, "events", *columns)


@query("SELECT user_id, event_type, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_event_per_key(spark, sf_dir):
    rows = events(spark, sf_dir, "user_id", "event_type", "event_id", "ts", "value")
    return keyed.latest_per_key(rows, ["user_id", "event_type"], ["ts", "event_id"])


@query("""
    WITH open AS (SELECT * FROM events e WHERE event_type IN ('click', 'view') AND NOT EXISTS (
        SELECT 1 FROM events d WHERE d.event_type = 'purchase' AND d.user_id = e.user_id AND d.ts::DATE = e.ts::DATE))
    SELECT user_id, event_id, (floor((row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1) / 12))::INTEGER AS batch FROM open""")
def digest_batches(spark, sf_dir):
    rows = events(spark, sf_dir, "user_id", "event_id", "ts", "event_type").withColumn("day", F.to_date("ts"))
    sent = rows.filter("event_type = 'purchase'").select("user_id", "day").distinct()
    pending = rows.filter(F.col("event_type").isin("click", "view")).join(sent, ["user_id", "day"], "left_anti")
    return keyed.batches(pending, ["user_id"], [F.desc("ts"), F.desc("event_id")], 12).select("user_id", "event_id", "batch")


@query("""
    WITH s AS (SELECT user_id, min(ts) FILTER (WHERE event_type = 'signup') AS started FROM events GROUP BY user_id)
    SELECT e.user_id, count(*)::BIGINT AS pending FROM events e JOIN s USING (user_id)
    WHERE e.event_type <> 'signup' AND e.ts >= s.started GROUP BY e.user_id""")
def pending_per_subscriber(spark, sf_dir):
    rows = events(spark, sf_dir, "user_id", "ts", "event_type")
    started = rows.filter("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("started"))
    after = rows.filter("event_type <> 'signup'").join(started, "user_id").filter("ts >= started")
    return after.groupBy("user_id").agg(F.count("*").alias("pending"))


@query(f"""SELECT event_id, ts, user_id FROM events WHERE ts < TIMESTAMP '{CURSOR}' OR (ts = TIMESTAMP '{CURSOR}' AND event_id < 100)
    ORDER BY ts DESC, event_id DESC LIMIT 200""")
def keyset_page(spark, sf_dir):
    rows = events(spark, sf_dir, "event_id", "ts", "user_id")
    return tables.keyset_page(rows, ["ts", "event_id"], [F.expr(f"TIMESTAMP_NTZ '{CURSOR}'"), 100], 200, descending=True)


@query(f"SELECT user_id, count(*)::BIGINT AS n, max(ts) AS newest FROM events WHERE ts < TIMESTAMP '{START}' GROUP BY user_id")
def bounded_scan(spark, sf_dir):
    rows = tables.bounded_scan(events(spark, sf_dir, "user_id", "ts"), "ts", F.expr(f"TIMESTAMP_NTZ '{START}'"))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("newest"))


@query("""SELECT (timezone('America/Chicago', ts AT TIME ZONE 'UTC') - INTERVAL 18 HOUR)::DATE AS day, event_type, count(*)::BIGINT AS n, min(event_id) AS first_id
    FROM events GROUP BY 1, 2""")
def monitoring_day_rollup(spark, sf_dir):
    rows = events(spark, sf_dir, "ts", "event_type", "event_id").withColumn("day", times.monitoring_day(F.col("ts")))
    return rows.groupBy("day", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("""WITH days AS (SELECT unnest(generate_series(DATE '2023-12-30', DATE '2024-02-02', INTERVAL 1 DAY))::DATE AS day)
    SELECT day, count(event_id)::BIGINT AS n FROM days LEFT JOIN events ON ts::DATE = day GROUP BY day""")
def calendar_gap_report(spark, sf_dir):
    rows = events(spark, sf_dir, "ts").select(F.to_date("ts").alias("at"))
    return rollups.calendar_gaps(rows, "at", "2023-12-30", "2024-02-02")


@query("""SELECT user_id, n, round(n * 100.0 / total, 3) AS share FROM (SELECT user_id, count(*)::BIGINT AS n FROM events GROUP BY user_id), (SELECT count(*) AS total FROM events)""")
def one_row_cross_totals(spark, sf_dir):
    rows = events(spark, sf_dir, "user_id")
    total = rows.agg(F.count("*").alias("total"))  # one row
    per = rows.groupBy("user_id").agg(F.count("*").alias("n"))
    return per.join(F.broadcast(total)).select("user_id", "n", F.round(F.col("n") * F.lit(100.0) / F.col("total"), 3).alias("share"))


@query("""SELECT user_id, count(*)::BIGINT AS total, count(*) FILTER (WHERE event_type = 'error')::BIGINT AS errors,
    count(*) FILTER (WHERE event_type = 'purchase')::BIGINT AS purchases, count(*) FILTER (WHERE value > 50)::BIGINT AS large FROM events GROUP BY user_id""")
def filtered_measures(spark, sf_dir):
    rows = events(spark, sf_dir, "user_id", "event_type", "value")
    kind = F.col("event_type")
    return rollups.measures(rows, ["user_id"], {"errors": kind == "error", "purchases": kind == "purchase", "large": F.col("value") > 50})


@query("""SELECT 'type' AS facet, event_type AS value, count(*)::BIGINT AS n FROM events GROUP BY 2
    UNION ALL SELECT 'day', strftime(ts, '%Y-%m-%d'), count(*)::BIGINT FROM events GROUP BY 2
    UNION ALL SELECT 'size', CASE WHEN value < 10 THEN 'small' WHEN value < 100 THEN 'medium' ELSE 'large' END, count(*)::BIGINT FROM events GROUP BY 2""")
def facet_counts(spark, sf_dir):
    rows = events(spark, sf_dir, "event_type", "ts", "value")
    size = F.when(F.col("value") < 10, "small").when(F.col("value") < 100, "medium").otherwise("large")
    return rollups.facets(rows, {"type": F.col("event_type"), "day": F.date_format("ts", "yyyy-MM-dd"), "size": size})


@query("SELECT event_type AS key, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def dynamic_group_key(spark, sf_dir):
    return rollups.counts_by(events(spark, sf_dir, "event_type"), F.col("event_type"))


@query("""WITH RECURSIVE t AS (
        SELECT day, pos, n, v, 2::BIGINT AS runs FROM (SELECT ts::DATE AS day, event_id AS pos, 1::HUGEINT AS n, event_id::VARCHAR AS v FROM events)
        UNION ALL SELECT day, pos // 1000, sum(n), sha256(string_agg(v, chr(10) ORDER BY pos)), count(*) OVER (PARTITION BY day) FROM t WHERE runs > 1 GROUP BY day, pos // 1000)
    SELECT day, n::BIGINT AS n, v AS digest FROM t WHERE runs = 1""")
def ordered_identity_digest(spark, sf_dir):
    rows = events(spark, sf_dir, "ts", "event_id").withColumn("day", F.to_date("ts"))
    return rollups.identity_digest(rows, ["day"], "event_id")


@query("""SELECT event_type, count(*)::BIGINT AS n, sum((props ->> '$.k')::BIGINT)::BIGINT AS k_sum, max((props ->> '$.k')::BIGINT) AS k_max FROM events GROUP BY event_type""")
def json_map_sum(spark, sf_dir):
    rows = events(spark, sf_dir, "event_type", "props").withColumn("k", k_of_props())
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k_sum"), F.max("k").alias("k_max"))


@query("SELECT event_type, count(DISTINCT user_id)::BIGINT AS users, count(DISTINCT ts::DATE)::BIGINT AS days FROM events GROUP BY event_type")
def exact_distinct_counts(spark, sf_dir):
    rows = events(spark, sf_dir, "event_type", "user_id", "ts")
    return rows.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.to_date("ts")).alias("days"))


@query("""SELECT 'errors' AS lane, count(*)::BIGINT AS depth, min(ts) AS oldest FROM events WHERE event_type = 'error'
    UNION ALL SELECT 'purchases', count(*)::BIGINT, min(ts) FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'signups', count(*)::BIGINT, min(ts) FROM events WHERE event_type = 'signup'""")
def queue_depth_by_lane(spark, sf_dir):
    lanes = {"error": "errors", "purchase": "purchases", "signup": "signups"}
    rows = events(spark, sf_dir, "event_type", "ts").filter(F.col("event_type").isin(*lanes))
    lane = F.create_map(*[F.lit(x) for pair in lanes.items() for x in pair])[F.col("event_type")]
    return rows.groupBy(lane.alias("lane")).agg(F.count("*").alias("depth"), F.min("ts").alias("oldest"))


@query("""SELECT user_id, sum(CASE WHEN event_type = 'click' THEN (props ->> '$.k')::BIGINT ELSE 0 END)::BIGINT AS reserved,
    sum(CASE WHEN event_type = 'purchase' THEN (props ->> '$.k')::BIGINT ELSE 0 END)::BIGINT AS spent,
    greatest(1500 - sum(CASE WHEN event_type IN ('click', 'purchase') THEN (props ->> '$.k')::BIGINT ELSE 0 END), 0)::BIGINT AS remaining FROM events GROUP BY user_id""")
def budget_remaining(spark, sf_dir):
    rows = events(spark, sf_dir, "user_id", "event_type", "props")
    of = lambda kind: F.when(F.col("event_type") == kind, k_of_props()).otherwise(F.lit(0))
    return rollups.remaining_budget(rows, ["user_id"], 1500, of("click"), of("purchase"))


@query("SELECT date_trunc('hour', ts) AS hour, user_id, count(*)::BIGINT AS n, count(*) > 3 AS limited FROM events GROUP BY 1, 2")
def tumbling_rate(spark, sf_dir):
    rows = events(spark, sf_dir, "ts", "user_id").groupBy(F.window("ts", "1 hour").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("hour"), "user_id", "n", (F.col("n") > 3).alias("limited"))


@query("""SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW)::BIGINT AS recent FROM events""")
def rolling_rate(spark, sf_dir):
    return runs.rolling_count(events(spark, sf_dir, "event_id", "user_id", "ts"), ["user_id"], "ts", 3600).select("event_id", "user_id", "recent")


@query("""SELECT user_id, props AS signature, min(ts) AS first_seen, max(ts) AS last_seen, count(*)::BIGINT AS seen_count FROM events WHERE event_type = 'error' GROUP BY 1, 2""")
def rejection_ledger(spark, sf_dir):
    rows = events(spark, sf_dir, "user_id", "props", "ts", "event_type").filter("event_type = 'error'")
    return rows.groupBy("user_id", F.col("props").alias("signature")).agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("seen_count")
    )


@query("""SELECT event_type, k // 10 AS code, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users, min(event_id) AS example
    FROM (SELECT *, (props ->> '$.k')::BIGINT AS k FROM events) GROUP BY 1, 2""")
def failure_groups(spark, sf_dir):
    rows = events(spark, sf_dir, "event_type", "props", "user_id", "event_id").withColumn("code", F.floor(k_of_props() / 10))
    return rows.groupBy("event_type", "code").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.min("event_id").alias("example"))


@query("""SELECT event_id, greatest(1, (props ->> '$.k')::BIGINT // 10)::BIGINT AS attempts,
    least(3600.0, 60.0 * pow(2, least(greatest(greatest(1, (props ->> '$.k')::BIGINT // 10) - 1, 0), 20)))::DOUBLE AS wait_s,
    CASE WHEN date_diff('day', ts::DATE, DATE '2024-02-01') < 1 THEN 'today' WHEN date_diff('day', ts::DATE, DATE '2024-02-01') < 7 THEN 'week'
         WHEN date_diff('day', ts::DATE, DATE '2024-02-01') < 30 THEN 'month' ELSE 'older' END AS age FROM events""")
def backoff_and_age(spark, sf_dir):
    rows = events(spark, sf_dir, "event_id", "props", "ts").withColumn("attempts", F.greatest(F.lit(1), F.floor(k_of_props() / 10)))
    age = times.age_bucket(F.datediff(F.to_date(F.lit("2024-02-01")), F.to_date("ts")))
    return rows.select("event_id", "attempts", times.backoff(F.col("attempts"), 60, 3600).alias("wait_s"), age.alias("age"))


@query("""SELECT user_id, count(*)::BIGINT AS n, bool_and(event_type <> 'error') AS healthy, bool_or(event_type = 'purchase') AS bought,
    arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY user_id""")
def shard_health(spark, sf_dir):
    rows = events(spark, sf_dir, "user_id", "event_type", "ts", "event_id")
    return rows.groupBy("user_id").agg(
        F.count("*").alias("n"), F.bool_and(F.col("event_type") != "error").alias("healthy"), F.bool_or(F.col("event_type") == "purchase").alias("bought"),
        F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"),
    )


@query("""SELECT event_id, user_id, ts FROM events e WHERE event_type = 'error' AND NOT EXISTS (
    SELECT 1 FROM events r WHERE r.user_id = e.user_id AND r.event_type = 'purchase' AND (r.ts > e.ts OR (r.ts = e.ts AND r.event_id > e.event_id)))""")
def unresolved_errors(spark, sf_dir):
    """Errors that no later reset follows: the last reset of each key is aggregated, so rows meet one row."""
    rows = events(spark, sf_dir, "event_id", "user_id", "ts", "event_type")
    reset = rows.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("reset"))
    open_rows = rows.filter("event_type = 'error'").join(reset, "user_id", "left")
    return open_rows.filter(F.col("reset").isNull() | (F.struct("ts", "event_id") > F.col("reset"))).select("event_id", "user_id", "ts")


@query("""SELECT event_type, grouping(event_type)::INTEGER AS is_total, count(*)::BIGINT AS n FROM events GROUP BY ROLLUP (event_type)""")
def totals_row(spark, sf_dir):
    rows = events(spark, sf_dir, "event_type")
    return rows.rollup("event_type").agg(F.grouping("event_type").cast("int").alias("is_total"), F.count("*").alias("n"))
