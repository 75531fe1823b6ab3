"""Queries of whole flows: changes from two texts to a digest, awards from facts to a page, queues, leases, budgets and releases."""

from __future__ import annotations

from contextlib import suppress
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import documents as D
from tidemark.functions import patterns as P
from tidemark.functions import text as T
from tidemark.operators import changes, keyed, states
from tidemark.operators import gates as G
from tidemark.sources import publication, tables
from tidemark.sources.scratch import shared_dir

from .gates import CHANGES, REVIEWED, SUPPRESSED, VALIDATED, cycle, matches, sources, suppressed, useful_sql, validated
from .gates import changes as change_events
from . import ledgers  # noqa: F401  (its queries are fed on)
from .registry import ORACLE_SQL, QUERIES, query
from .values import AWARD_TEXTS

# --- sources and sinks


FLAGS = [("popup", True, "chrome"), ("job-board", True, "source"), ("fine", False, None)]


@query("""SELECT event_id, flag, flag IN ('popup', 'job-board') AS blocking, CASE flag WHEN 'popup' THEN 'chrome' WHEN 'job-board' THEN 'source' END AS family FROM (
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'popup' WHEN 1 THEN 'job-board' WHEN 2 THEN 'fine' END AS flag FROM events) WHERE flag IS NOT NULL""")
def policy_flags(spark, sf_dir):
    """Events' flags looked up in a policy that is kept as JSON and read with a schema: a table of a few dozen rows, so it is broadcast."""
    path = shared_dir(spark, "policy")
    spark.createDataFrame(FLAGS, "flag string, blocking boolean, family string").write.json(path)
    policy = spark.read.schema("flag string, blocking boolean, family string").json(path)
    rows = tables.table(spark, sf_dir, "events", "event_id").selectExpr("event_id", cycle("event_id", ["popup", "job-board", "fine"], n=4) + " AS flag").filter("flag IS NOT NULL")
    return rows.join(F.broadcast(policy), "flag", "left").select("event_id", "flag", "blocking", "family")


@query("""SELECT ts::DATE AS day, user_id % 3 AS shard, count(*)::BIGINT AS checked, count(*) FILTER (WHERE event_type = 'error')::BIGINT AS failed FROM events GROUP BY 1, 2""")
def run_reports(spark, sf_dir):
    """Run reports written as JSON files and read back with a schema, a file or more a task."""
    rows = tables.table(spark, sf_dir, "events", "ts", "user_id", "event_type").select(F.to_date("ts").alias("day"), (F.col("user_id") % 3).alias("shard"), (F.col("event_type") == "error").alias("bad"))
    reports = rows.groupBy("day", "shard").agg(F.count("*").alias("checked"), F.count_if("bad").alias("failed"))
    path = shared_dir(spark, "run-reports")
    reports.write.mode("overwrite").json(path)
    return spark.read.schema("day date, shard long, checked long, failed long").json(path)


@query("SELECT c_custkey, c_name || ', \"x\"' AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'line ' || c_custkey END AS note FROM customer")
def csv_round_trip(spark, sf_dir):
    """A review export as CSV, read back: quotes, commas and nulls survive."""
    rows = tables.table(spark, sf_dir, "customer", "c_custkey", "c_name").selectExpr("c_custkey", "c_name || ', \"x\"' AS name", "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'line ' || c_custkey END AS note")
    path = shared_dir(spark, "review-export")
    rows.write.option("header", True).option("quoteAll", False).option("escape", '"').csv(path)
    return spark.read.option("header", True).option("escape", '"').schema("c_custkey long, name string, note string").csv(path)


@query("""WITH d AS (SELECT user_id AS subscriber, ts::DATE AS digest, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS body FROM events WHERE event_type = 'click' GROUP BY 1, 2)
    SELECT subscriber, digest, sha256(body) AS payload_hash, count(*)::BIGINT AS deliveries FROM d GROUP BY 1, 2, 3""")
def digest_outbox(spark, sf_dir):
    """Frozen digests keyed by subscriber, day and payload: enqueued twice, they are there once."""
    rows = tables.table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type").filter("event_type = 'click'")
    body = F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",")  # one subscriber's day
    frozen = rows.groupBy(F.col("user_id").alias("subscriber"), F.to_date("ts").alias("digest")).agg(F.sha2(body, 256).alias("payload_hash"))
    key = ["subscriber", "digest", "payload_hash"]
    first = tables.append_new(frozen.limit(0), frozen, key)
    queued = first.unionByName(tables.append_new(first, frozen, key))
    return queued.groupBy(*key).agg(F.count("*").alias("deliveries"))


# --- changes


@query(f"""SELECT event_id, {matches("concat_ws(' ', link, title, page_type)", P.BAD_SOURCE)} OR {matches("concat_ws(' ', link, title, page_type)", P.SHAPE_SOURCE)} AS odd_source, CASE WHEN page_id IS NULL THEN 'missing'
    WHEN status <> 'open' THEN 'closed' ELSE 'open' END AS source_state FROM {CHANGES} LEFT JOIN {REVIEWED} ON page_id = source_id""")
def open_source_filter(spark, sf_dir):
    """Whether a change's source is open, and of an odd shape."""
    of = sources(spark, sf_dir).select("page_id", "status", F.concat_ws(" ", "link", "title", "page_type").alias("words"))
    rows = change_events(spark, sf_dir).join(of, F.col("source_id") == F.col("page_id"), "left")
    odd = F.coalesce("words", F.lit("")).rlike(P.BAD_SOURCE) | F.coalesce("words", F.lit("")).rlike(P.SHAPE_SOURCE)
    state = F.when(F.col("page_id").isNull(), "missing").when(F.col("status") != "open", "closed").otherwise("open")
    return rows.select("event_id", odd.alias("odd_source"), state.alias("source_state"))


@query(f"SELECT s.event_id FROM {SUPPRESSED} s JOIN (SELECT event_id AS e FROM events WHERE event_type IN ('click', 'view', 'purchase')) ON e = s.event_id WHERE reason IS NULL AND {useful_sql()}")
def public_changes(spark, sf_dir):
    """Changes that the public sees: published by the gates, of an allowed kind, with a useful summary."""
    kinds = tables.table(spark, sf_dir, "events", "event_id", "event_type").filter(F.col("event_type").isin("click", "view", "purchase")).select("event_id")
    rows = suppressed(spark, sf_dir).filter(F.col("reason").isNull() & G.useful_summary(F.col("summary")))
    return rows.join(kinds, "event_id", "left_semi").select("event_id")


TEXTS = [t.replace("'", "") for t in AWARD_TEXTS]
OLD, NEW = cycle("event_id", TEXTS), cycle("(event_id + user_id)", TEXTS)
DATES = [None, "March 3, 2025", "2025-04-01", None]
VERSIONS = f"(SELECT event_id, {OLD} || coalesce(' ' || {cycle('event_id', DATES)}, '') AS old, {NEW} || coalesce(' ' || {cycle('user_id', DATES)}, '') AS new FROM events)"


def versions(spark, sf_dir):
    return tables.table(spark, sf_dir, "events", "event_id", "user_id").selectExpr(
        "event_id", f"{OLD} || coalesce(' ' || {cycle('event_id', DATES)}, '') AS old", f"{NEW} || coalesce(' ' || {cycle('user_id', DATES)}, '') AS new"
    )


def found_sql(pattern: str, c: str) -> str:
    return f"regexp_extract_all({c}, '{pattern}')"


MONEY_NEW = f"[x for x, k in {found_sql(T.MONEY, 'new')} if list_position({found_sql(T.MONEY, 'new')}, x) = k AND NOT list_contains({found_sql(T.MONEY, 'old')}, x)]"
DATES_NEW = f"[x for x, k in {found_sql(T.DATE, 'new')} if list_position({found_sql(T.DATE, 'new')}, x) = k AND NOT list_contains({found_sql(T.DATE, 'old')}, x)]"


@query(f"""SELECT event_id, CASE WHEN old = new THEN 'No award-relevant wording changed in the stored excerpt.' WHEN len({MONEY_NEW}) > 0 THEN 'New funding amount language appeared: ' || array_to_string({MONEY_NEW}[1:3], ', ') || '.'
    WHEN len({DATES_NEW}) > 0 THEN 'Added date context: ' || array_to_string({DATES_NEW}[1:4], ', ') || '.' WHEN len(new) >= 35 AND NOT contains(old, new) THEN 'Added text includes: "' || new || '".'
    WHEN len(old) >= 35 AND NOT contains(new, old) THEN 'Removed text includes: "' || old || '".' ELSE 'No award-relevant wording changed in the stored excerpt.' END AS summary FROM {VERSIONS}""")
def change_summary(spark, sf_dir):
    rows = versions(spark, sf_dir)
    return rows.select("event_id", changes.summary(F.col("old"), F.col("new")).alias("summary"))


@query(f"""SELECT event_id, CASE WHEN len({MONEY_NEW}) > 0 THEN 'amount' WHEN len({DATES_NEW}) > 0 THEN 'date' WHEN old <> new AND len(new) >= 35 THEN 'added_text' WHEN old <> new AND len(old) >= 35 THEN 'removed_text' ELSE 'none' END AS class,
    CASE WHEN len({MONEY_NEW}) > 0 OR len({DATES_NEW}) > 0 THEN 'high' WHEN old <> new AND regexp_matches(lower(new), '{P.FUNDING}') THEN 'medium' ELSE 'low' END AS confidence FROM {VERSIONS}""")
def change_details(spark, sf_dir):
    """The kind of a change and how sure it is, from its structured diff."""
    diff = changes.structured_diff(versions(spark, sf_dir), "old", "new")
    confidence = F.when(F.col("class").isin("amount", "date"), "high").when((F.col("old") != F.col("new")) & F.lower("new").rlike(P.FUNDING), "medium").otherwise("low")
    return diff.withColumn("class", changes.change_class()).select("event_id", "class", confidence.alias("confidence"))


GROWN = """(SELECT doc_id, old, CASE doc_id % 3 WHEN 0 THEN old || ' ' || text WHEN 1 THEN 'x' || old || text ELSE text END AS new FROM (
    SELECT doc_id, text, lag(text) OVER (PARTITION BY source, lang ORDER BY doc_id) AS old FROM documents) WHERE old IS NOT NULL AND text IS NOT NULL)"""


@query(f"""SELECT doc_id, len(old) >= 500 AND len(new) > len(old) + 80 AND (starts_with(new, old) OR starts_with(regexp_replace(lower(new), '[^a-z0-9]+', '', 'g'), regexp_replace(lower(old), '[^a-z0-9]+', '', 'g'))
    OR (contains(new, trim(right(old, 180))) AND len(trim(right(old, 180))) >= 60 AND strpos(new, trim(right(old, 180))) - 1 + len(trim(right(old, 180))) < len(new) - 40)) AS expanded FROM {GROWN}""")
def sample_expansion(spark, sf_dir):
    """Whether a newer capture only holds more of the same page: whole texts of consecutive documents, a third of them grown by the next one's."""
    pairs = changes.version_pairs(tables.table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text"), ["source", "lang"], "doc_id", "text")
    rows = pairs.filter("previous_text IS NOT NULL AND text IS NOT NULL").selectExpr(
        "doc_id", "previous_text AS old", "CASE doc_id % 3 WHEN 0 THEN previous_text || ' ' || text WHEN 1 THEN 'x' || previous_text || text ELSE text END AS new"
    )
    return rows.select("doc_id", changes.expands(F.col("old"), F.col("new")).alias("expanded"))


@query("""SELECT user_id, event_id, rank::INTEGER AS rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM (
    SELECT user_id, max(event_id) AS event_id, max(ts) AS ts FROM events WHERE event_type <> 'error' GROUP BY user_id, event_type, ts::DATE)) WHERE rank <= 12""")
def digest_assembly(spark, sf_dir):
    """The newest twelve of each subscriber, once for each kind and day."""
    rows = tables.table(spark, sf_dir, "events", "user_id", "event_id", "ts", "event_type").filter("event_type <> 'error'")
    once = rows.groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.max("event_id").alias("event_id"), F.max("ts").alias("ts"))
    return keyed.top_per_key(once, ["user_id"], [F.desc("ts"), F.desc("event_id")], 12).select("user_id", "event_id", "rank")


SEVERITY = "CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END"


@query(f"""WITH a AS (SELECT user_id, 'event' AS feed, {SEVERITY} AS severity, min(ts) AS oldest, count(*)::BIGINT AS n FROM events GROUP BY 1, 3 UNION ALL SELECT o_custkey, 'order', 1, min(o_orderdate), count(*)::BIGINT FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
    b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY severity, n DESC, oldest, feed) AS place FROM a) SELECT user_id, feed, severity::INTEGER AS severity, oldest, n FROM b WHERE place = 1""")
def operator_inbox(spark, sf_dir):
    """Feeds stacked, the most severe action of each owner kept."""
    kind = F.col("event_type")
    events = tables.table(spark, sf_dir, "events", "user_id", "event_type", "ts").withColumn("severity", F.when(kind == "error", 0).when(kind == "purchase", 1).otherwise(2))
    orders = tables.table(spark, sf_dir, "orders", "o_custkey", "o_orderstatus", "o_orderdate").filter("o_orderstatus = 'P'")
    feeds = [
        events.groupBy("user_id", F.lit("event").alias("feed"), "severity").agg(F.min("ts").alias("oldest"), F.count("*").alias("n")),
        orders.groupBy(F.col("o_custkey").alias("user_id"), F.lit("order").alias("feed"), F.lit(1).alias("severity")).agg(F.min("o_orderdate").cast("timestamp_ntz").alias("oldest"), F.count("*").alias("n")),
    ]
    stacked = feeds[0].unionByName(feeds[1])
    return keyed.first_per_key(stacked, ["user_id"], [F.asc("severity"), F.desc("n"), F.asc("oldest"), F.asc("feed")])


@query(f"""SELECT page_type, count(*)::BIGINT AS total, {', '.join(f"count(*) FILTER (WHERE {c})::BIGINT AS {n}" for n, c in [('unreviewed', "review = 'unreviewed'"), ('failed', "review = 'review_failed'"),
    ('incomplete', "review = 'reviewed_invalid_or_incomplete'"), ('unclear', "review = 'reviewed_unclear_needs_manual_review'"), ('rejected', "starts_with(review, 'reviewed_rejected')"), ('accepted', 'usable'),
    ('no_link', 'link IS NULL'), ('no_title', "coalesce(title, '') = ''"), ('in_error', "status = 'error'"), ('unchecked', 'checked IS NULL')])} FROM {REVIEWED} GROUP BY page_type""")
def completion_blockers(spark, sf_dir):
    """Eleven counts of what keeps a page type's sources from being complete."""
    rows = sources(spark, sf_dir).withColumn("r", G.review_status(F.col("metadata")))
    review = F.col("r.status")
    counts = {
        "unreviewed": review == "unreviewed", "failed": review == "review_failed", "incomplete": review == "reviewed_invalid_or_incomplete", "unclear": review == "reviewed_unclear_needs_manual_review",
        "rejected": review.startswith("reviewed_rejected"), "accepted": F.col("r.usable"), "no_link": F.col("link").isNull(), "no_title": F.coalesce("title", F.lit("")) == "",
        "in_error": F.col("status") == "error", "unchecked": F.col("checked").isNull(),
    }
    return rows.groupBy("page_type").agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in counts.items()])


# --- awards


@query("""WITH s AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 200000) AS useful, count(*) FILTER (WHERE o_orderstatus = 'P') AS tracked, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS updates FROM orders GROUP BY 1)
    SELECT c_custkey, coalesce(useful, 0)::BIGINT AS useful, (CASE WHEN c_mktsegment = 'BUILDING' THEN 1000 ELSE 0 END + CASE WHEN coalesce(tracked, 0) > 0 THEN 500 ELSE 0 END + CASE WHEN coalesce(updates, 0) > 0 THEN 200 ELSE 0 END
      + CASE WHEN coalesce(useful, 0) = 0 THEN 100 ELSE 50 END)::INTEGER AS priority FROM customer LEFT JOIN s ON o_custkey = c_custkey WHERE coalesce(useful, 0) <= 1""")
def low_coverage_awards(spark, sf_dir):
    """Awards with at most one useful source, and how pressing each is."""
    orders = tables.table(spark, sf_dir, "orders", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    status = F.col("o_orderstatus")
    counts = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count_if((status == "F") & (F.col("o_totalprice") > 200000)).alias("useful"), F.count_if(status == "P").alias("tracked"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("updates")
    )
    rows = tables.table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").join(counts, "c_custkey", "left").fillna(0, ["useful", "tracked", "updates"]).filter("useful <= 1")
    points = F.when(F.col("c_mktsegment") == "BUILDING", 1000).otherwise(0) + F.when(F.col("tracked") > 0, 500).otherwise(0) + F.when(F.col("updates") > 0, 200).otherwise(0)
    return rows.select("c_custkey", "useful", (points + F.when(F.col("useful") == 0, 100).otherwise(50)).alias("priority"))


@query("""SELECT c_custkey, left(concat_ws(' ', 'Name: ' || c_name || '.', 'Segment: ' || c_mktsegment || '.', CASE WHEN c_acctbal < 0 THEN 'Overdrawn.' END), 60) AS summary FROM customer""")
def award_summary(spark, sf_dir):
    said = F.concat_ws(" ", F.concat(F.lit("Name: "), "c_name", F.lit(".")), F.concat(F.lit("Segment: "), "c_mktsegment", F.lit(".")), F.when(F.col("c_acctbal") < 0, "Overdrawn."))
    return tables.table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment", "c_acctbal").select("c_custkey", F.substring(said, 1, 60).alias("summary"))


@query("""SELECT n_nationkey, n_name, coalesce((SELECT to_json(list({'id': s_suppkey, 'name': s_name} ORDER BY s_suppkey)) FROM supplier WHERE s_nationkey = n_nationkey), '[]')::VARCHAR AS sources,
    (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey)::BIGINT AS followers FROM nation""")
def public_award_page(spark, sf_dir):
    """An award with its sources as a list and its followers counted."""
    suppliers = tables.table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(
        F.to_json(F.array_sort(F.collect_list(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))))).alias("sources")
    )  # an award's sources
    followers = tables.table(spark, sf_dir, "customer", "c_nationkey").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("followers"))
    rows = tables.table(spark, sf_dir, "nation", "n_nationkey", "n_name").join(suppliers, "n_nationkey", "left").join(followers, "n_nationkey", "left")
    return rows.select("n_nationkey", "n_name", F.coalesce("sources", F.lit("[]")).alias("sources"), F.coalesce("followers", F.lit(0)).cast("long").alias("followers"))


FACTS = "'{\"deadline\":\"2025-0' || (1 + event_id % 9) || '-01\",\"levels\":\"' || " + cycle("event_id", ["graduate", "junior or senior", "postdoc", ""]) + " || '\"' || " + cycle("event_id", [',"amounts":"$5,000"'], "''", 3) + " || '}'"


@query(f"""SELECT event_id, facts ->> '$.deadline' AS deadline, coalesce(facts ->> '$.amounts', 'unknown') AS amounts, array_to_string([x for x in [{', '.join(f"CASE WHEN {matches("facts ->> '$.levels'", p)} THEN '{n}' END" for n, p in P.LEVELS)}]
    if x IS NOT NULL], ', ') AS levels FROM (SELECT event_id, {FACTS} AS facts FROM events)""")
def award_facts_view(spark, sf_dir):
    """Facts read from JSON with a schema, academic levels inferred from words."""
    rows = tables.table(spark, sf_dir, "events", "event_id").selectExpr("event_id", FACTS + " AS facts").withColumn("f", F.from_json("facts", "deadline string, levels string, amounts string"))
    return rows.select("event_id", "f.deadline", F.coalesce("f.amounts", F.lit("unknown")).alias("amounts"), F.array_join(T.labels(F.col("f.levels"), P.LEVELS), ", ").alias("levels"))


@query(f"""SELECT event_id, e.key AS field, e.value AS raw_value, sha256(e.key || '|' || lower(trim(e.value))) AS value_hash FROM (SELECT event_id, unnest([{{'key': k, 'value': json_extract_string(facts, '$.' || k)}} for k in json_keys(facts)]) AS e
    FROM (SELECT event_id, {FACTS} AS facts FROM events)) WHERE trim(e.value) <> ''""")
def intake_candidates(spark, sf_dir):
    """A review's facts as candidate rows with the hash of each value."""
    rows = tables.table(spark, sf_dir, "events", "event_id").selectExpr("event_id", FACTS + " AS facts").select("event_id", F.explode(D.entries(F.col("facts"))).alias("e")).filter(F.trim("e.value") != "")
    return rows.select("event_id", F.col("e.key").alias("field"), F.col("e.value").alias("raw_value"), F.sha2(F.concat("e.key", F.lit("|"), F.lower(F.trim("e.value"))), 256).alias("value_hash"))


@query(f"""SELECT page_id, CASE WHEN link IS NULL THEN 'rejected' WHEN flag IS NOT NULL OR starts_with(review, 'reviewed_rejected') THEN 'rejected' WHEN usable AND status = 'open' THEN 'accepted' ELSE 'manual' END AS status,
    CASE WHEN link IS NULL THEN 'missing_url' WHEN flag IS NOT NULL THEN 'flag_' || flag WHEN usable AND status <> 'open' THEN 'source_' || status ELSE why END AS reason FROM {REVIEWED}""")
def intake_review(spark, sf_dir):
    """What becomes of a submitted source without a person looking."""
    rows = sources(spark, sf_dir).withColumn("r", G.review_status(F.col("metadata")))
    flags = F.transform(F.from_json(F.coalesce(F.get_json_object("metadata", "$.quality_flags"), F.lit("[]")), "array<string>"), G.clean_key)
    flag = F.get(F.filter(flags, lambda f: f.isin(P.REJECTED_SOURCE_FLAGS)), F.lit(0))
    status = F.when(F.col("link").isNull() | flag.isNotNull() | F.col("r.status").startswith("reviewed_rejected"), "rejected").when(F.col("r.usable") & (F.col("status") == "open"), "accepted").otherwise("manual")
    reason = F.when(F.col("link").isNull(), "missing_url").when(flag.isNotNull(), F.concat(F.lit("flag_"), flag)).when(F.col("r.usable") & (F.col("status") != "open"), F.concat(F.lit("source_"), "status"))
    return rows.select("page_id", status.alias("status"), F.coalesce(reason, F.col("r.reason")).alias("reason"))


# --- windows


@query("""SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE 's' || (event_id % 50) END, user_id || '|' || event_type) ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 2""")
def keep_two_by_fallback_key(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts")
    key = F.coalesce(F.expr("CASE WHEN event_id % 3 = 0 THEN NULL ELSE 's' || (event_id % 50) END"), F.concat_ws("|", "user_id", "event_type"))
    return keyed.top_per_key(rows.withColumn("key", key), ["key"], [F.desc("ts"), F.desc("event_id")], 2).select("event_id")


@query("SELECT user_id, (props ->> '$.k')::BIGINT AS k, min(event_id) AS canonical, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def canonical_by_json_key(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "events", "user_id", "event_id", "props").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return rows.groupBy("user_id", "k").agg(F.min("event_id").alias("canonical"), F.count("*").alias("n"))


SECTIONS = "string_split(lower(p_name || ' ' || p_type || ' ' || p_name), ' ')"


@query(f"""WITH s AS (SELECT p_partkey, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM (SELECT p_partkey, {SECTIONS} AS w FROM part))
    SELECT p_partkey, k::INTEGER AS position, word || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS key FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey, word ORDER BY k) AS n FROM s)""")
def section_keys(spark, sf_dir):
    """Keys of a page's sections: the nth section of one name gets -n. Counted inside the row's array, without a shuffle."""
    rows = tables.table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    words = F.split(F.lower(F.concat_ws(" ", "p_name", "p_type", "p_name")), " ")
    rows = rows.select("p_partkey", words.alias("w"))
    nth = F.transform("w", lambda x, k: F.struct((k + 1).alias("position"), x.alias("word"), F.size(F.filter(F.slice("w", F.lit(1), k + 1), lambda y: y == x)).alias("n")))
    return rows.select("p_partkey", F.explode(nth).alias("s")).select(
        "p_partkey", "s.position", F.concat("s.word", F.when(F.col("s.n") > 1, F.concat(F.lit("-"), F.col("s.n").cast("string"))).otherwise(F.lit(""))).alias("key")
    )


@query("SELECT event_id, ts FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 1")
def latest_artifact(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "events", "event_id", "ts", "event_type").filter("event_type = 'purchase'")
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select("event_id", "ts")


# --- states


@query("""WITH l AS (SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS kind FROM events GROUP BY 1), g AS (SELECT user_id, max((ts, event_id)) AS good FROM events WHERE event_type <> 'error' GROUP BY 1),
    f AS (SELECT user_id, count(*) AS failures FROM events LEFT JOIN g USING (user_id) WHERE event_type = 'error' AND (good IS NULL OR (ts, event_id) > good) GROUP BY 1),
    a AS (SELECT user_id, CASE kind WHEN 'view' THEN 'claim' WHEN 'click' THEN 'beat' WHEN 'error' THEN 'fail' ELSE 'done' END AS kind, epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(ts) AS age, coalesce(failures, 0) AS failures FROM l LEFT JOIN f USING (user_id))
    SELECT user_id, failures::BIGINT AS failures, CASE WHEN kind IN ('claim', 'beat') AND age < 86400 THEN 'claimed' WHEN kind IN ('claim', 'beat') THEN 'expired'
      WHEN kind = 'fail' AND age < least(864000.0, 21600.0 * pow(2, least(greatest(failures - 1, 0), 20))) THEN 'backoff' ELSE 'idle' END AS state FROM a""")
def lane_leases(spark, sf_dir):
    """The lease state of each lane at a given time, folded from its events."""
    rows = tables.table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    last = rows.groupBy("user_id").agg(F.max("ts").alias("ts"), F.max_by("event_type", F.struct("ts", "event_id")).alias("type"))
    failing = states.failures_in_a_row(rows, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")
    kind = F.when(F.col("type") == "view", "claim").when(F.col("type") == "click", "beat").when(F.col("type") == "error", "fail").otherwise("done")
    joined = last.join(failing, "user_id", "left").withColumn("failures", F.coalesce("failures", F.lit(0)).cast("long"))
    age = (F.unix_micros(F.expr("TIMESTAMP '2024-01-31 00:00:00'")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    return joined.select("user_id", "failures", states.lease_state(kind, age, F.col("failures"), 86_400, 21_600, 864_000).alias("state"))


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, ts::DATE AS day, (props ->> '$.k')::BIGINT AS amount, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS k FROM events),
      r AS (SELECT event_id, user_id, day, amount, k, amount <= 150 AS admitted, 150 - CASE WHEN amount <= 150 THEN amount ELSE 0 END AS rest FROM e WHERE k = 1 UNION ALL
            SELECT e.event_id, e.user_id, e.day, e.amount, e.k, e.amount <= rest, rest - CASE WHEN e.amount <= rest THEN e.amount ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.day = r.day AND e.k = r.k + 1)
    SELECT event_id, user_id, day, amount, admitted FROM r""")
def budget_admission(spark, sf_dir):
    """Requests admitted under a lane's cap for a UTC day, in order; a request that doesn't fit is passed over."""
    rows = tables.table(spark, sf_dir, "events", "event_id", "user_id", "ts", "props").select(
        "event_id", "user_id", F.to_date("ts").alias("day"), "ts", F.get_json_object("props", "$.k").cast("long").alias("amount")
    )
    return states.admitted(rows, ["user_id", "day"], ["ts", "event_id"], "amount", 150).drop("ts")


@query("""WITH s AS (SELECT user_id, (props ->> '$.k')::BIGINT AS event, min(ts) FILTER (WHERE event_type = 'purchase') AS sent, max(ts) FILTER (WHERE event_type <> 'purchase') AS tried, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT user_id, event, CASE WHEN sent IS NOT NULL THEN 'sent' WHEN TIMESTAMP '2024-01-30 12:00:00' - tried < INTERVAL 23 HOUR THEN 'retry' ELSE 'abandoned' END AS state, n::BIGINT AS attempts FROM s""")
def delivery_ledger(spark, sf_dir):
    """A receipt for each subscriber and event: sent once, tried again within 23 hours, or given up."""
    rows = tables.table(spark, sf_dir, "events", "user_id", "props", "ts", "event_type").withColumn("event", F.get_json_object("props", "$.k").cast("long"))
    done = F.col("event_type") == "purchase"
    sums = rows.groupBy("user_id", "event").agg(F.min(F.when(done, F.col("ts"))).alias("sent"), F.max(F.when(~done, F.col("ts"))).alias("tried"), F.count("*").alias("attempts"))
    state = F.when(F.col("sent").isNotNull(), "sent").when(F.col("tried") > F.expr("TIMESTAMP_NTZ '2024-01-30 12:00:00' - INTERVAL 23 HOURS"), "retry").otherwise("abandoned")
    return sums.select("user_id", "event", state.alias("state"), "attempts")


@query("""WITH p AS (SELECT user_id, max(ts) AS since, arg_max(event_id, (ts, event_id)) AS latest, count(*) AS version FROM events WHERE event_type = 'view' GROUP BY 1), c AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events
    WHERE event_type = 'click' GROUP BY 1) SELECT user_id, CASE WHEN ts >= since AND version % 2 = 0 THEN event_id ELSE latest END AS latest, ts >= since AND version % 2 = 0 AS advanced FROM p JOIN c USING (user_id)""")
def advance_pointer(spark, sf_dir):
    """Pointers that advance if the caller saw the current version (an even one) and its capture isn't older."""
    rows = tables.table(spark, sf_dir, "events", "user_id", "event_id", "ts", "event_type")
    best = F.max_by("event_id", F.struct("ts", "event_id"))
    now = rows.filter("event_type = 'view'").groupBy("user_id").agg(F.max("ts").alias("at"), best.alias("latest"), F.count("*").alias("version"))
    new = rows.filter("event_type = 'click'").groupBy("user_id").agg(best.alias("event_id"), F.max("ts").alias("ts"))
    moves = (F.col("ts") >= F.col("at")) & (F.col("version") % 2 == 0)
    return now.join(new, "user_id").select("user_id", F.when(moves, F.col("event_id")).otherwise(F.col("latest")).alias("latest"), moves.alias("advanced"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1996-01-01' THEN 'O' ELSE o_orderstatus END AS status, o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1996-01-01' AS recovered FROM orders")
def stale_claims(spark, sf_dir):
    """Claims older than the timeout go back to open; nothing is deleted."""
    stale = (F.col("o_orderstatus") == "P") & (F.col("o_orderdate") < F.expr("TIMESTAMP_NTZ '1996-01-01 00:00:00'"))
    rows = tables.table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderdate")
    return rows.select("o_orderkey", F.when(stale, "O").otherwise(F.col("o_orderstatus")).alias("status"), stale.alias("recovered"))


STAGE = "CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END"


@query(f"""SELECT event_id, previous::INTEGER AS previous, stage::INTEGER AS stage, stage = 0 OR coalesce(stage = previous + 1, false) AS legal FROM (SELECT event_id, {STAGE} AS stage, lag({STAGE}) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS previous FROM events)""")
def stage_transitions(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type").selectExpr("event_id", "user_id", "ts", "CAST(ts AS DATE) AS day", STAGE + " AS stage")
    return states.misplaced(rows, ["user_id", "day"], [F.asc("ts"), F.asc("event_id")], "stage").select("event_id", "previous", "stage", "legal")


@query("""WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey, o_orderstatus, o_totalprice + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS o_totalprice FROM orders WHERE o_orderkey % 6 <> 0)
    SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'insert' WHEN b.o_orderkey IS NULL THEN 'delete' ELSE 'update' END AS change FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey
    WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_totalprice <> b.o_totalprice OR a.o_orderstatus <> b.o_orderstatus""")
def captured_changes(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    later = rows.filter("o_orderkey % 6 <> 0").withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0))
    return states.captured(rows.filter("o_orderkey % 5 <> 0"), later, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


@query("""WITH a AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS audit, max(ts) AS latest FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1), o AS (SELECT user_id, count(*) AS attempts, min(ts) AS opened FROM events WHERE event_type = 'error' GROUP BY 1)
    SELECT user_id, CASE WHEN audit = 'error' THEN 'open' ELSE 'resolved' END AS state, coalesce(attempts, 0)::BIGINT AS attempts, opened, latest AS last_seen FROM a LEFT JOIN o USING (user_id)""")
def quarantine_registry(spark, sf_dir):
    """Cases by key: open while the latest audit failed, resolved once it passed, with attempts and times."""
    rows = tables.table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type").filter(F.col("event_type").isin("error", "purchase"))
    bad = F.col("event_type") == "error"
    sums = rows.groupBy("user_id").agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("audit"), F.count_if(bad).alias("attempts"), F.min(F.when(bad, F.col("ts"))).alias("opened"), F.max("ts").alias("last_seen")
    )
    return sums.select("user_id", F.when(F.col("audit") == "error", "open").otherwise("resolved").alias("state"), "attempts", "opened", "last_seen")


@query("""WITH c AS (SELECT n_regionkey, count(*) AS members, sha256(string_agg(n_nationkey || ':' || n_name, chr(10) ORDER BY n_nationkey)) AS identity, bool_and(n_nationkey < 100) AS eligible FROM nation GROUP BY 1)
    SELECT n_regionkey, members::BIGINT AS members, identity, CASE WHEN NOT eligible THEN 'blocked' WHEN members <> 5 THEN 'incomplete' ELSE 'published' END AS decision FROM c""")
def effective_publication(spark, sf_dir):
    """A cohort's decision with the hash of its members: whole, eligible, or not."""
    rows = tables.table(spark, sf_dir, "nation", "n_regionkey", "n_nationkey", "n_name")
    identity = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda r: F.concat_ws(":", r["n_nationkey"], r["n_name"])), "\n"), 256)  # a cohort of 25 at most
    sums = rows.groupBy("n_regionkey").agg(F.count("*").alias("members"), identity.alias("identity"), F.bool_and(F.col("n_nationkey") < 100).alias("eligible"))
    decision = changes.first_rule([("blocked", ~F.col("eligible")), ("incomplete", F.col("members") != 5)], "published")
    return sums.select("n_regionkey", "members", "identity", decision.alias("decision"))


@query("""WITH d AS (SELECT unnest(generate_series(DATE '2024-01-10', DATE '2024-01-13', INTERVAL 1 DAY))::DATE AS day), r AS (SELECT ts::DATE AS day, user_id % 3 AS shard, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY 1, 2),
    s AS (SELECT d.day, count(r.shard) AS shards, coalesce(bool_and(last <> 'error'), false) AS healthy FROM d LEFT JOIN r ON r.day = d.day GROUP BY 1)
    SELECT day, shards::BIGINT AS shards, healthy, healthy AND shards = 3 AS passes, (SELECT bool_and(healthy AND shards = 3) FROM s) AS release FROM s""")
def release_gate(spark, sf_dir):
    """Whether the latest run of every shard was healthy on each required day, and so whether a release may go."""
    rows = tables.table(spark, sf_dir, "events", "ts", "user_id", "event_type", "event_id").select(F.to_date("ts").alias("day"), (F.col("user_id") % 3).alias("shard"), "ts", "event_id", "event_type")
    rows = rows.filter("day BETWEEN DATE '2024-01-10' AND DATE '2024-01-13'")
    runs = rows.groupBy("day", "shard").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit("2024-01-10")), F.to_date(F.lit("2024-01-13")))).alias("day"))
    health = days.join(runs, "day", "left").groupBy("day").agg(F.count("shard").alias("shards"), F.coalesce(F.bool_and(F.col("last") != "error"), F.lit(False)).alias("healthy"))
    passed = health.withColumn("passes", F.col("healthy") & (F.col("shards") == 3))
    whole = passed.agg(F.bool_and("passes").alias("release"))  # one row
    return passed.join(F.broadcast(whole))


# --- mutation and integrity


@query("""SELECT 'duplicate_keys' AS rule, count(*)::BIGINT AS violations FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT 'missing_parent', count(*)::BIGINT FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'status_domain', count(*)::BIGINT FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT 'discount_range', count(*)::BIGINT FROM lineitem WHERE l_discount NOT BETWEEN 0 AND 0.05""")
def publication_checks(spark, sf_dir):
    """What must hold before several tables are published together: unique keys, parents, domains and ranges."""
    lines, orders = tables.table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_discount"), tables.table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    count = lambda frame, rule: frame.agg(F.lit(rule).alias("rule"), F.count("*").alias("violations"))
    checks = [
        count(lines.groupBy("l_orderkey", "l_linenumber").count().filter("count > 1"), "duplicate_keys"),
        count(lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"), "missing_parent"),
        count(orders.filter(~F.col("o_orderstatus").isin("F", "O")), "status_domain"), count(lines.filter("l_discount NOT BETWEEN 0 AND 0.05D"), "discount_range"),
    ]
    out = checks[0]
    for more in checks[1:]:
        out = out.unionByName(more)
    return out


@query("""SELECT 2::BIGINT AS version, 'orders' AS name, o_orderstatus AS status, count(*)::BIGINT AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY o_orderstatus
    UNION ALL SELECT 2, 'totals', 'O', count(*)::BIGINT, sum(o_custkey)::BIGINT FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O')""")
def atomic_publication(spark, sf_dir):
    """Orders and totals of customers published together, twice; a writer that began too early and one whose rows break a rule leave no trace."""
    root, orders = shared_dir(spark, "publication"), tables.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    totals = lambda status: orders.filter(F.col("o_orderstatus") == status).groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderstatus").alias("o_orderstatus"))
    checks = {"status_domain": ("orders", F.col("o_orderstatus").isin("F", "O", "P")), "some": ("totals", F.col("n") > 0)}
    first = publication.publish(spark, root, {"orders": orders.filter("o_orderstatus = 'F'"), "totals": totals("F")}, 0, checks)
    second = publication.publish(spark, root, {"orders": orders, "totals": totals("O")}, first, checks)
    for expected, rows in ((first, orders), (second, orders.withColumn("o_orderstatus", F.lit("?")))):
        with suppress(publication.Refused):
            publication.publish(spark, root, {"orders": rows.limit(1), "totals": totals("P")}, expected, checks)
    version = publication.current(spark, root)
    of = lambda name, key: publication.read(spark, root, name, version).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.sum(key).alias("keys")).withColumn("name", F.lit(name))
    return of("orders", "o_orderkey").unionByName(of("totals", "o_custkey")).select(F.lit(version).cast("long").alias("version"), "name", "status", "n", "keys")


@query("""WITH w AS (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS winner FROM customer) SELECT o_orderkey, winner AS o_custkey, winner <> c_custkey AS moved FROM orders JOIN w ON c_custkey = o_custkey""")
def repointed_children(spark, sf_dir):
    """Children moved to the winner of their parent's duplicates; winners come from an aggregate."""
    parents = tables.table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    winners = parents.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("winner"))
    of = parents.join(winners, ["c_nationkey", "c_mktsegment"]).select("c_custkey", "winner")
    orders = tables.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").join(of, F.col("o_custkey") == F.col("c_custkey"))
    return orders.select("o_orderkey", F.col("winner").alias("o_custkey"), (F.col("winner") != F.col("c_custkey")).alias("moved"))


@query("""SELECT count(*)::BIGINT AS n, sum(('0x' || sha256(coalesce(o_orderkey::VARCHAR, '~') || '|' || coalesce(o_orderstatus, '~'))[1:8])::BIGINT)::BIGINT AS revision FROM orders""")
def backlog_revision(spark, sf_dir):
    return states.revision(tables.table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus"), ["o_orderkey", "o_orderstatus"])


@query("SELECT event_id, reason IS NOT NULL AS hidden, CASE WHEN reason IS NOT NULL THEN TIMESTAMP '2024-02-01 00:00:00' END AS suppressed_at FROM " + SUPPRESSED)
def soft_delete(spark, sf_dir):
    """Flags instead of deletions."""
    hidden = F.col("reason").isNotNull()
    return suppressed(spark, sf_dir).select("event_id", hidden.alias("hidden"), F.when(hidden, F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'")).alias("suppressed_at"))


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END, o.priority) AS segment, greatest(c_acctbal, coalesce(o.price, c_acctbal)) AS confidence FROM customer LEFT JOIN (
    SELECT o_custkey, max(o_totalprice) AS price, arg_max(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")
def merge_fill(spark, sf_dir):
    """Blank fields are filled and the confidence only rises; nothing that is there is overwritten."""
    orders = tables.table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")
    new = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("price"), F.max_by("o_orderpriority", "o_orderkey").alias("priority"))
    old = tables.table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment", "c_acctbal").withColumn("segment", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")))
    return old.join(new, "c_custkey", "left").select("c_custkey", F.coalesce("segment", "priority").alias("segment"), F.greatest("c_acctbal", F.coalesce("price", "c_acctbal")).alias("confidence"))


@query(f"SELECT reason, count(*)::BIGINT AS n, count(DISTINCT l_orderkey)::BIGINT AS awards FROM {VALIDATED} GROUP BY reason")
def candidate_rejections(spark, sf_dir):
    return validated(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("awards"))


INBOX = f"""(SELECT 'runs' AS feed, false AS retrying, 'delayed' AS impact FROM ({ORACLE_SQL['stalled_runs']}) WHERE state = 'stalled'
    UNION ALL SELECT 'deliveries', state = 'retry', CASE state WHEN 'retry' THEN 'none' ELSE 'unknown' END FROM ({ORACLE_SQL['delivery_ledger']}) WHERE state <> 'sent'
    UNION ALL SELECT 'quarantine', false, 'blocked' FROM ({ORACLE_SQL['quarantine_registry']}) WHERE state = 'open'
    UNION ALL SELECT 'lanes', state = 'backoff', CASE state WHEN 'backoff' THEN 'delayed' ELSE 'blocked' END FROM ({ORACLE_SQL['lane_leases']}) WHERE state IN ('expired', 'backoff')
    UNION ALL SELECT feed, severity = 2, CASE severity WHEN 0 THEN 'blocked' WHEN 1 THEN 'unknown' ELSE 'none' END FROM ({ORACLE_SQL['operator_inbox']}))"""


@query(f"""SELECT coalesce(feed, 'all') AS feed, count(*)::BIGINT AS total, count(*) FILTER (WHERE NOT retrying)::BIGINT AS needs_operator, count(*) FILTER (WHERE retrying)::BIGINT AS auto_retrying,
    count(*) FILTER (WHERE impact = 'blocked')::BIGINT AS public_blockers, count(*) FILTER (WHERE impact = 'unknown')::BIGINT AS public_impact_unknown FROM {INBOX} GROUP BY ROLLUP (feed)""")
def inbox_summary(spark, sf_dir):
    """Five counts of the items of six feeds, by feed and over all: what waits for an operator, tries again by itself, blocks the public or may do so."""
    state, severity = F.col("state"), F.col("severity")
    item = lambda name, frame, retrying, impact: frame.select((F.lit(name) if isinstance(name, str) else name).alias("feed"), retrying.alias("retrying"), impact.alias("impact"))
    feeds = [
        item("runs", QUERIES["stalled_runs"](spark, sf_dir).filter("state = 'stalled'"), F.lit(False), F.lit("delayed")),
        item("deliveries", QUERIES["delivery_ledger"](spark, sf_dir).filter("state <> 'sent'"), state == "retry", F.when(state == "retry", "none").otherwise("unknown")),
        item("quarantine", QUERIES["quarantine_registry"](spark, sf_dir).filter("state = 'open'"), F.lit(False), F.lit("blocked")),
        item("lanes", QUERIES["lane_leases"](spark, sf_dir).filter("state IN ('expired', 'backoff')"), state == "backoff", F.when(state == "backoff", "delayed").otherwise("blocked")),
        item(F.col("feed"), QUERIES["operator_inbox"](spark, sf_dir), severity == 2, F.when(severity == 0, "blocked").when(severity == 1, "unknown").otherwise("none")),
    ]
    items = reduce(DataFrame.unionByName, feeds)
    counts = {"needs_operator": ~F.col("retrying"), "auto_retrying": F.col("retrying"), "public_blockers": F.col("impact") == "blocked", "public_impact_unknown": F.col("impact") == "unknown"}
    return items.rollup("feed").agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in counts.items()]).withColumn("feed", F.coalesce("feed", F.lit("all")))
