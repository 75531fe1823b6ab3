"""Queries on the health of sources, runs and awards."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import patterns as P
from tidemark.operators import changes, rollups
from tidemark.operators import gates as G
from tidemark.sources import tables

from .flows import DATES_NEW, MONEY_NEW, VERSIONS, versions
from .gates import BUCKET, REVIEWED, SOURCES, VALIDATED, allowed_sql, host_sql, judged_sources, listed, matches, path_sql, quality_sql, sources, validated
from .registry import query

MESSAGES = ["", "HTTP 404", "file too large", "HTTP 403 forbidden", "page not found", "HTTP 401 unauthorized", "robot challenge"]
MESSAGE = "CASE page_id % 9 " + " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(MESSAGES)) + " ELSE '' END"
CHECKED = "CASE page_id % 13 WHEN 0 THEN 'https://www.facebook.com/a' WHEN 1 THEN 'https://x.org/aaaa/aaaa/aaaa' WHEN 2 THEN 'https://docs.google.com/document/d/1' WHEN 3 THEN 'https://x.org/a.zip' WHEN 4 THEN 'https://osti.gov/a' ELSE link END"


def hygiene_sql() -> str:
    host, path = f"coalesce({host_sql('link')}, '')", f"lower(coalesce({path_sql('link')}, ''))"
    words = "lower(concat_ws(' ', link, title))"
    repeats = f"len([p for p in string_split({path}, '/') if len(p) >= 4 AND len(list_filter(string_split({path}, '/'), lambda q: q = p)) >= 3]) > 0"
    return f"""CASE WHEN {host} = '' THEN 'invalid_url' WHEN {matches(host, P.of_hosts(P.SOCIAL_HOSTS))} OR {matches(words, P.SOCIAL_TEXT)} OR {matches(path, '/share(?:/|$)')} THEN 'social_or_share_link'
      WHEN {matches(path, P.MEDIA_PATH)} THEN 'media_or_archive_file' WHEN {repeats} THEN 'recursive_or_cyclic_url' WHEN {matches(path, P.SEARCH_PATH)} OR {matches(path, P.LISTING_PATH)} THEN 'generic_source_shape'
      WHEN {host} IN {listed(P.DOWNLOAD_HOSTS)} THEN 'software_download' WHEN {matches(words, P.BOILERPLATE_TEXT)} THEN 'boilerplate_or_policy_link' WHEN {matches('message', P.TOO_LARGE)} THEN 'oversized_file'
      WHEN {matches(host, P.of_hosts(P.PRIVATE_HOSTS))} AND {matches('message', P.PRIVATE_FAILURE)} THEN 'private_document' WHEN {matches('message', P.PERMANENT_FAILURE)} THEN 'permanent_http_failure'
      WHEN {matches('message', P.SOFT_404)} THEN 'soft_404' WHEN {matches(host, P.of_hosts(P.BLOCKED_HOSTS))} AND {matches('message', P.BLOCKED_FAILURE)} THEN 'blocked_third_party' WHEN {matches('message', P.BLOCKED_FAILURE)} THEN 'blocked_by_source' END"""


@query(f"SELECT page_id, {hygiene_sql()} AS reason FROM (SELECT page_id, title, {CHECKED} AS link, {MESSAGE} AS message FROM {SOURCES})")
def hygiene_gate(spark, sf_dir):
    rows = sources(spark, sf_dir).selectExpr("page_id", "title", CHECKED + " AS link", MESSAGE + " AS message")
    return rows.select("page_id", G.hygiene_reason(F.col("link"), F.col("title"), F.col("message")).alias("reason"))


CLASS = f"CASE WHEN len({MONEY_NEW}) > 0 THEN 'amount' WHEN len({DATES_NEW}) > 0 THEN 'date' WHEN old <> new AND len(new) >= 35 THEN 'added_text' WHEN old <> new AND len(old) >= 35 THEN 'removed_text' ELSE 'none' END"


def review_sql() -> str:
    words, text = "concat_ws(' ', link, title, page_type)", "new"
    shape, applicant = matches(words, P.SHAPE_SOURCE), matches(text, P.APPLICANT)
    noise = " ".join(f"WHEN {matches(text, p)} AND NOT {applicant} THEN '{n}'" for n, p in P.NOISE_SUMMARIES)
    escapes = f"(quality = 'url_not_monitorable' AND {shape} AND {applicant})"
    return f"""CASE WHEN NOT {allowed_sql('quality')} AND NOT {escapes} THEN 'source_quality_' || quality WHEN ({matches(words, P.BAD_SOURCE)} OR {shape}) AND NOT {escapes} THEN 'source_shape_noise'
      WHEN class = 'none' THEN 'missing_added_or_removed_text_evidence' {noise} WHEN class IN ('amount', 'date') THEN 'applicant_fact_signal' WHEN {applicant} THEN 'text_only_applicant_signal'
      ELSE 'text_only_noise_without_applicant_signal' END"""


@query(f"""SELECT event_id, reason IN ('applicant_fact_signal', 'text_only_applicant_signal') AS allowed, reason FROM (SELECT event_id, {review_sql()} AS reason FROM (SELECT event_id, new, {CLASS} AS class FROM {VERSIONS})
    JOIN (SELECT page_id, link, title, page_type, {quality_sql('monitoring')} AS quality FROM {REVIEWED}) ON page_id = event_id % 50)""")
def review_gate(spark, sf_dir):
    """Which changes go to review, and why not the others."""
    judged = judged_sources(spark, sf_dir).select("page_id", "words", "quality")
    diff = changes.structured_diff(versions(spark, sf_dir), "old", "new").withColumn("class", changes.change_class()).select("event_id", "new", "class")
    rows = diff.join(judged, F.col("event_id") % 50 == F.col("page_id"))
    return rows.select("event_id", G.review_gate(F.col("quality"), F.col("words"), F.col("class"), F.col("new")).alias("v")).select("event_id", "v.allowed", "v.reason")


POINTS = f"""CASE WHEN starts_with(lower(link), 'https:') THEN 8 ELSE 0 END + CASE WHEN page_type IN {listed(P.PROTECTED_PAGE_TYPES)} THEN 18 ELSE 0 END + CASE WHEN {matches("lower(concat_ws(' ', link, title))", P.INTENT)} THEN 28 ELSE 0 END
    + CASE WHEN shared >= 2 THEN 45 WHEN shared = 1 THEN 20 ELSE 0 END + CASE WHEN trim(coalesce(error, '')) = '' THEN 8 ELSE -10 END - CASE WHEN regexp_extract(link, '^[^?#]*\\?([^#]*)', 1) <> '' THEN 8 ELSE 0 END
    - CASE WHEN coalesce(title, '') = '' THEN 18 ELSE 0 END - CASE WHEN page_type = 'other' THEN 6 ELSE 0 END"""


@query(f"SELECT page_id, ({POINTS})::INTEGER AS score FROM (SELECT *, CASE WHEN title = 'Great Award' THEN 2 ELSE page_id % 2 END AS shared FROM {SOURCES})")
def source_scores(spark, sf_dir):
    shared = F.when(F.col("title") == "Great Award", 2).otherwise(F.col("page_id") % 2)
    scored = G.source_score(F.col("link"), F.col("page_type"), F.concat_ws(" ", "link", "title"), shared, F.col("error"), F.coalesce("title", F.lit("")) == "")
    return sources(spark, sf_dir).select("page_id", scored.alias("s")).select("page_id", F.col("s.score").alias("score"))


@query(f"""WITH s AS (SELECT page_type, page_id, {BUCKET} AS bucket, ({POINTS}) AS score FROM (SELECT *, page_id % 2 AS shared FROM {SOURCES}))
    SELECT page_type, bucket, count(*)::BIGINT AS sources, arg_max(page_id, (score, -page_id)) AS replacement, max(score)::INTEGER AS best FROM s GROUP BY 1, 2""")
def post_crawl_model(spark, sf_dir):
    """Sources by page type and failure, each with the best one to replace others by."""
    scored = G.source_score(F.col("link"), F.col("page_type"), F.concat_ws(" ", "link", "title"), F.col("page_id") % 2, F.col("error"), F.coalesce("title", F.lit("")) == "")
    rows = sources(spark, sf_dir).select("page_type", "page_id", G.failure_bucket(F.col("error")).alias("bucket"), scored["score"].alias("score"))
    best = F.max_by("page_id", F.struct("score", -F.col("page_id")))
    return rows.groupBy("page_type", "bucket").agg(F.count("*").alias("sources"), best.alias("replacement"), F.max("score").alias("best"))


@query("SELECT user_id % 4 AS run, count(*)::BIGINT AS checked, count(*) FILTER (WHERE event_type = 'error')::BIGINT AS failed, max((props ->> '$.k')::BIGINT) AS deepest, min(ts) AS started, max(ts) AS finished FROM events GROUP BY 1")
def merged_runs(spark, sf_dir):
    """Related runs as one: some counters are summed, of others the largest counts."""
    rows = tables.table(spark, sf_dir, "events", "user_id", "event_type", "props", "ts").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return rows.groupBy((F.col("user_id") % 4).alias("run")).agg(
        F.count("*").alias("checked"), F.count_if(F.col("event_type") == "error").alias("failed"), F.max("k").alias("deepest"), F.min("ts").alias("started"), F.max("ts").alias("finished")
    )


@query(f"""WITH f AS (SELECT l_orderkey, reason, count(*) AS n FROM {VALIDATED} WHERE reason <> 'accepted' GROUP BY 1, 2) SELECT reason AS code, CASE WHEN reason = 'missing_exact_evidence' THEN 'critical' ELSE 'warning' END AS severity,
    count(*)::BIGINT AS awards, sum(n)::BIGINT AS findings FROM f GROUP BY 1""")
def page_audit_rollup(spark, sf_dir):
    """Findings by code: their severity, how many awards have them and how often.

    An award's findings are counted by code at once. A filter on the verdict would be pushed below what it is made of, and judge each row many times over.
    """
    counts = validated(spark, sf_dir).groupBy("l_orderkey").agg(*[F.count_if(F.col("reason") == code).alias(code) for code in G.CANDIDATE_FAULTS])
    found = counts.select(F.explode(F.array(*[F.struct(F.lit(code).alias("code"), F.col(code).alias("n")) for code in G.CANDIDATE_FAULTS])).alias("f")).select("f.code", "f.n").filter("n > 0")
    severity = F.when(F.col("code") == "missing_exact_evidence", "critical").otherwise("warning")
    return found.groupBy("code", severity.alias("severity")).agg(F.count("*").alias("awards"), F.sum("n").alias("findings"))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS F, count(*) FILTER (WHERE o_orderstatus = 'O')::BIGINT AS O, count(*) FILTER (WHERE o_orderstatus = 'P')::BIGINT AS P FROM orders GROUP BY 1")
def status_pivot(spark, sf_dir):
    """A queue's rows by status, one column each."""
    rows = tables.table(spark, sf_dir, "orders", "o_orderpriority", "o_orderstatus")
    return rows.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)


@query("""WITH r AS (SELECT ts::DATE AS day, user_id % 3 AS shard, count(*) AS n, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY 1, 2), d AS (SELECT DISTINCT day FROM r), g AS (SELECT day, s AS shard FROM d, range(0, 4) t(s))
    SELECT g.day, sum(coalesce(n, 0))::BIGINT AS checked, string_agg(CASE WHEN r.shard IS NULL THEN g.shard::VARCHAR END, ',' ORDER BY g.shard) AS missing, CASE WHEN count(r.shard) < 4 THEN 'incomplete' WHEN bool_or(last = 'error') THEN 'failed' ELSE 'ok' END AS status
    FROM g LEFT JOIN r ON r.day = g.day AND r.shard = g.shard GROUP BY 1""")
def nightly_report(spark, sf_dir):
    """A night's shards as one report: what was checked, which shards are missing, and what that makes of the night."""
    rows = tables.table(spark, sf_dir, "events", "ts", "user_id", "event_type", "event_id").select(F.to_date("ts").alias("day"), (F.col("user_id") % 3).alias("shard"), "ts", "event_id", "event_type")
    runs = rows.groupBy("day", "shard").agg(F.count("*").alias("n"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    nights = runs.groupBy("day").agg(F.sum("n").alias("checked"), F.collect_set("shard").alias("there"), F.bool_or(F.col("last") == "error").alias("bad"))  # four shards
    missing = F.array_except(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")), "there")
    status = F.when(F.size(missing) > 0, "incomplete").when(F.col("bad"), "failed").otherwise("ok")
    return nights.select("day", "checked", F.nullif(F.array_join(missing.cast("array<string>"), ","), F.lit("")).alias("missing"), status.alias("status"))


@query("""WITH v AS (SELECT o_custkey, o_orderpriority AS v, min(o_orderdate) AS d, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, d, v) AS k FROM v), c AS (SELECT o_custkey, max(o_totalprice) AS confidence FROM orders GROUP BY 1)
    SELECT o_custkey, string_agg(v, '; ' ORDER BY k) AS priorities, any_value(confidence) AS confidence FROM r JOIN c USING (o_custkey) WHERE k <= 3 GROUP BY 1""")
def award_rollup(spark, sf_dir):
    """An award's three weightiest values in order, and its best confidence."""
    orders = tables.table(spark, sf_dir, "orders", "o_custkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    values = orders.groupBy("o_custkey", F.col("o_orderpriority").alias("v")).agg(F.min("o_orderdate").alias("d"), F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "d", "v")))  # few values an award
    return values.groupBy("o_custkey").agg(F.array_join(F.transform(F.slice(ranked, 1, 3), lambda r: r["v"]), "; ").alias("priorities"), F.max("top").alias("confidence"))


@query(f"SELECT page_type, count(*)::BIGINT AS total, count(*) FILTER (WHERE usable)::BIGINT AS reviewed, CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE usable) * 100.0 / count(*), 1) ELSE 0.0 END AS percent FROM {REVIEWED} GROUP BY 1")
def review_coverage(spark, sf_dir):
    rows = sources(spark, sf_dir).withColumn("usable", G.review_status(F.col("metadata"))["usable"])
    return rollups.measures(rows, ["page_type"], {"reviewed": F.col("usable")}).withColumn("percent", rollups.percent(F.col("reviewed"), F.col("total")))
