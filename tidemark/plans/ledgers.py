"""Queries that merge, claim, sample and report: sinks, read state, leases, run health, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import changes, keyed, rollups
from tidemark.sources import tables
from tidemark.sources.scratch import shared_dir
from tidemark.streaming import jobs, ledger

from .registry import query


@query("""SELECT e.user_id, count(*)::BIGINT AS unread FROM events e JOIN (SELECT user_id, min(ts) + INTERVAL 5 DAY AS baseline FROM events GROUP BY 1) b USING (user_id)
    WHERE e.ts > b.baseline AND e.event_type <> 'view' AND NOT EXISTS (SELECT 1 FROM events r WHERE r.user_id = e.user_id AND r.event_type = 'view' AND r.ts::DATE = e.ts::DATE)
    GROUP BY e.user_id""")
def unread_changes(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "events", "user_id", "ts", "event_type").withColumn("day", F.to_date("ts"))
    baseline = rows.groupBy("user_id").agg((F.min("ts") + F.expr("INTERVAL 5 DAYS")).alias("baseline"))
    receipts = rows.filter("event_type = 'view'").select("user_id", "day").distinct()
    new = rows.filter("event_type <> 'view'").join(baseline, "user_id").filter("ts > baseline").join(receipts, ["user_id", "day"], "left_anti")
    return new.groupBy("user_id").agg(F.count("*").alias("unread"))


@query("""SELECT user_id, ts::DATE AS day, min(event_id) AS event_id FROM events e WHERE event_type = 'click' AND NOT EXISTS (
    SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts::DATE = e.ts::DATE) GROUP BY 1, 2""")
def insert_if_absent(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "events", "user_id", "ts", "event_type", "event_id").withColumn("day", F.to_date("ts"))
    there = rows.filter("event_type = 'purchase'").select("user_id", "day")
    candidates = rows.filter("event_type = 'click'").groupBy("user_id", "day").agg(F.min("event_id").alias("event_id"))
    return tables.append_new(there, candidates, ["user_id", "day"])


@query("""SELECT c_custkey, coalesce(o.price, c_acctbal) AS balance FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS price FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o
    ON o_custkey = c_custkey""")
def upsert_merge(spark, sf_dir):
    existing = tables.table(spark, sf_dir, "customer", "c_custkey", "c_acctbal").withColumnRenamed("c_acctbal", "balance")
    orders = tables.table(spark, sf_dir, "orders", "o_custkey", "o_totalprice", "o_orderstatus").filter("o_orderstatus = 'P'")
    new = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("balance"))
    return tables.upsert(existing, new.join(existing.select("c_custkey"), "c_custkey", "left_semi"), ["c_custkey"])


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '[",\\r\\n]') THEN sha256('"' || replace(text, '"', '""') || '"') ELSE sha256(text) END AS field FROM documents""")
def csv_fields(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.sha2(tables.csv_field(F.col("text")), 256).alias("field"))


@query("""SELECT sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://[^ ]+', '<url>', 'g'), '[0-9a-f]{32,64}', '<hash>', 'g'),
    '[0-9]{4}-[0-9]{2}-[0-9]{2}', '<date>', 'g'), '[0-9]+', '<n>', 'g')) AS cluster, lang, count(*)::BIGINT AS members, min(doc_id) AS first_id FROM documents GROUP BY 1, 2""")
def feedback_clusters(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    hashed = rows.select("doc_id", "lang", F.sha2(T.templated(F.col("text")), 256).alias("cluster"))
    return hashed.groupBy("cluster", "lang").agg(F.count("*").alias("members"), F.min("doc_id").alias("first_id"))


@query("""SELECT event_type, event_id, rank FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id)::INTEGER AS rank FROM events) WHERE rank <= 3""")
def examples_per_group(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "events", "event_type", "event_id", "value")
    return keyed.top_per_key(rows, ["event_type"], [F.desc_nulls_last("value"), F.asc("event_id")], 3).select("event_type", "event_id", "rank")


@query("""SELECT o_custkey, CASE WHEN max(o_totalprice) >= 400000 AND bool_or(o_orderstatus = 'F') THEN 'high' WHEN max(o_totalprice) >= 200000 THEN 'medium' ELSE 'low' END AS confidence
    FROM orders GROUP BY o_custkey""")
def confidence_fold(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "orders", "o_custkey", "o_totalprice", "o_orderstatus")
    folded = rows.groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"), F.bool_or(F.col("o_orderstatus") == "F").alias("useful"))
    rules = [("high", (F.col("top") >= 400000) & F.col("useful")), ("medium", F.col("top") >= 200000)]
    return folded.select("o_custkey", changes.first_rule(rules, "low").alias("confidence"))


@query("""SELECT user_id, last_ts, CASE WHEN last_type = 'purchase' THEN 'done' WHEN TIMESTAMP '2024-01-30 12:00:00' - last_ts >= INTERVAL 15 MINUTE THEN 'stalled' ELSE 'running' END AS state
    FROM (SELECT user_id, max(ts) AS last_ts, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY user_id)""")
def stalled_runs(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "events", "user_id", "ts", "event_type", "event_id")
    last = rows.groupBy("user_id").agg(F.max("ts").alias("last_ts"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))
    silent = F.col("last_ts") <= F.expr("TIMESTAMP_NTZ '2024-01-30 12:00:00' - INTERVAL 15 MINUTES")
    return last.select("user_id", "last_ts", changes.first_rule([("done", F.col("last_type") == "purchase"), ("stalled", silent)], "running").alias("state"))


@query("""SELECT doc_id, k::INTEGER AS position, word FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM (
    SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents)) WHERE word <> ''""")
def words_with_position(spark, sf_dir):
    return words_of(tables.table(spark, sf_dir, "documents", "doc_id", "text"))


@query("""SELECT doc_id, k::INTEGER AS position, word FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM (
    SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents)) WHERE word <> ''""")
def words_with_position(spark, sf_dir):
    return words_of(tables.table(spark, sf_dir, "documents", "doc_id", "text"))


@query("""SELECT doc_id, k::INTEGER AS position, word FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM (
    SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents)) WHERE word <> ''""")
def all_words_with_position(spark, sf_dir):
    return words_of(tables.table(spark, sf_dir, "documents", "doc_id", "text"))


def words_of(rows):
    """doc_id, position from 1 and word of every word of all texts."""
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " ")
    return rows.select("doc_id", F.posexplode(words).alias("k", "word")).select("doc_id", (F.col("k") + 1).alias("position"), "word").filter("word <> ''")


@query("""WITH w AS (SELECT doc_id, lag(doc_id) OVER (PARTITION BY source, lang ORDER BY doc_id) AS other, list_distinct(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) AS a,
      lag(list_distinct(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '))) OVER (PARTITION BY source, lang ORDER BY doc_id) AS b FROM documents)
    SELECT doc_id, other, round(len(list_intersect(a, b)) / greatest(len(a), len(b)), 6) AS overlap FROM w WHERE other IS NOT NULL""")
def token_similarity(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text")
    words = F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " "))
    pairs = keyed.with_previous_id(rows.select("doc_id", "source", "lang"), ["source", "lang"], "doc_id", "other").filter("other IS NOT NULL")
    own = rows.select("doc_id", words.alias("a"))  # words are looked up by id once the pairs are known
    pairs = pairs.join(own, "doc_id").join(own.select(F.col("doc_id").alias("other"), F.col("a").alias("b")), "other")
    return pairs.select("doc_id", "other", F.round(T.overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


@query("""SELECT p_brand, count(*)::BIGINT AS total, count(*) FILTER (WHERE p_size > 25)::BIGINT AS large, CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE p_size > 25) * 100.0 / count(*), 1)
    ELSE 0.0 END AS percent_large FROM part GROUP BY p_brand""")
def brand_health(spark, sf_dir):
    rows = rollups.measures(tables.table(spark, sf_dir, "part", "p_brand", "p_size"), ["p_brand"], {"large": F.col("p_size") > 25})
    return rows.withColumn("percent_large", rollups.percent(F.col("large"), F.col("total")))


@query("""SELECT event_id, user_id, event_type, ts FROM events WHERE event_type = 'error'""")
def streaming_sweep(spark, sf_dir):
    """A resumable sweep over the event files as a stream, run to its end into Parquet."""
    stream = jobs.event_stream(spark, f"{sf_dir}/event[s].parquet").filter("event_type = 'error'").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))
    to = shared_dir(spark, "sweep")
    jobs.sweep(stream, to, shared_dir(spark, "sweep-progress"))
    return spark.read.parquet(to)


@query("SELECT date_trunc('hour', ts) AS hour, user_id, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def streaming_rates(spark, sf_dir):
    """Hourly counts as a stream, kept up to date batch by batch; rows may come in any order."""
    stream = jobs.event_stream(spark, f"{sf_dir}/event[s].parquet").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "user_id")
    return ledger.count_batches(stream, shared_dir(spark, "rates"), shared_dir(spark, "rates-progress"), ["hour", "user_id"])


@query("SELECT event_id, user_id FROM events")
def streaming_deliveries(spark, sf_dir):
    """Events delivered twice arrive once, whatever the order in which they come."""
    stream = jobs.event_stream(spark, f"{sf_dir}/event[s].parquet").union(jobs.event_stream(spark, f"{sf_dir}/event[s].parquet"))
    return ledger.deliver_once(stream.select("event_id", "user_id"), shared_dir(spark, "deliveries"), shared_dir(spark, "deliveries-progress"), ["event_id"])


@query("SELECT event_id, CASE WHEN event_type IN ('error', 'click') AND value >= 5 THEN 'hidden' END AS decision FROM events")
def streaming_policy(spark, sf_dir):
    """Decisions on events under a policy, then under a wider one: its change sweeps the events again and writes what it moves."""
    to = shared_dir(spark, "policy")
    for types, least in ((["error"], 0), (["error", "click"], 5)):
        stream = jobs.event_stream(spark, f"{sf_dir}/event[s].parquet").select("event_id", "event_type", "value")
        decide = lambda rows, types=types, least=least: F.when(F.col("event_type").isin(types) & (F.col("value") >= least), "hidden")
        found = ledger.policy_sweep(stream, decide, {"types": types, "least": least}, to, ["event_id"])
    return found
