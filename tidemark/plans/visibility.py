"""Queries of what the public sees: changes of open sources by id or address, and all conditions of a public change."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import gates as G
from tidemark.operators import visibility
from tidemark.sources import tables

from .gates import REVIEWED, SUPPRESSED, allowed_sql, judged_sources, quality_sql, suppressed, useful_sql
from .registry import query
from .web import KEY, PARTS

#: An event's source by id (some have none, some a wrong one), and the address that it gives, in several spellings.
SOURCE_ID = "CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 43 = 0 THEN -1 ELSE event_id % 200 END"
SPELT = "CASE event_id % 5 WHEN 0 THEN upper(url) WHEN 1 THEN url || '#part' WHEN 2 THEN NULL ELSE url END"
TOLD = f"""(SELECT event_id, user_id, {SOURCE_ID} AS source_id, {SPELT} AS source_url, reason IS NOT NULL AS hidden, {useful_sql()} AS useful
    FROM (SELECT event_id, user_id, event_type, url FROM events LEFT JOIN pages ON page_id = event_id % 200) JOIN (SELECT event_id AS e, reason, summary FROM {SUPPRESSED}) ON e = event_id)"""
OPEN = f"(SELECT page_id FROM (SELECT page_id, status, {quality_sql('monitoring')} AS reason FROM {REVIEWED}) WHERE status = 'open' AND {allowed_sql('reason')})"


def keys_of(rows: str) -> str:
    """Canonical keys of rows with a url."""
    return f"(SELECT *, {KEY} AS url_key FROM ({PARTS.replace('FROM pages', f'FROM {rows}')}))"


def told(spark, sf_dir):
    """Changes with the source that they name."""
    events = tables.table(spark, sf_dir, "events", "event_id", "user_id").withColumn("page", F.col("event_id") % 200)
    pages = tables.table(spark, sf_dir, "pages", "page_id", "url")
    rows = events.join(pages, F.col("page") == F.col("page_id"), "left").selectExpr("event_id", "user_id", SOURCE_ID + " AS source_id", SPELT + " AS source_url")
    judged = suppressed(spark, sf_dir).select("event_id", F.col("reason").isNotNull().alias("hidden"), G.useful_summary(F.col("summary")).alias("useful"))
    return rows.join(judged, "event_id")


@query(f"""WITH t AS (SELECT event_id, source_id, hidden, source_url AS url FROM {TOLD}), k AS (SELECT event_id, source_id, hidden, url, url_key FROM {keys_of('t')}),
    o AS (SELECT DISTINCT url_key FROM {keys_of(f'(SELECT page_id, url FROM pages WHERE page_id IN {OPEN})')})
    SELECT event_id, NOT hidden AND CASE WHEN source_id IS NOT NULL THEN source_id IN {OPEN} WHEN coalesce(url, '') = '' THEN false ELSE url_key IN (SELECT url_key FROM o) END AS open FROM k""")
def open_changes(spark, sf_dir):
    """Whether a change belongs to an open source, by id or else by the canonical key of its address."""
    active = judged_sources(spark, sf_dir).filter((F.col("status") == "open") & F.col("quality.allowed")).select(F.col("page_id").alias("id"))
    sources = tables.table(spark, sf_dir, "pages", "page_id", "url").join(active, F.col("page_id") == F.col("id"), "left_semi").select(F.col("page_id").alias("id"), "url")
    return visibility.with_open_source(told(spark, sf_dir), sources).select("event_id", "open")


AWARD = "CASE WHEN event_id % 11 = 0 OR source_id IS NULL THEN user_id % 10 ELSE source_id % 10 END"
AWARDS = """(SELECT user_id % 10 AS award, count(*) FILTER (WHERE event_type = 'signup') >= count(*) FILTER (WHERE event_type = 'purchase') AS verified,
    count(*) FILTER (WHERE event_type = 'error') <= count(*) FILTER (WHERE event_type = 'click') AS active FROM events GROUP BY 1)"""


@query(f"""WITH t AS (SELECT *, {AWARD} AS award FROM {TOLD}), s AS (SELECT p.page_id, p.url, q.status = 'open' AS open, q.public AND q.monitored AS allowed FROM pages p JOIN (
      SELECT page_id, status, {allowed_sql('a')} AS public, {allowed_sql('b')} AS monitored FROM (SELECT page_id, status, {quality_sql('public')} AS a, {quality_sql('monitoring')} AS b FROM {REVIEWED})) q USING (page_id))
    SELECT event_id AS id, CASE WHEN NOT coalesce(verified, false) THEN 'not_verified' WHEN NOT active THEN 'award_not_active' WHEN s.page_id IS NULL THEN 'source_missing' WHEN NOT coalesce(open, false) THEN 'source_not_open'
      WHEN page_id % 10 <> award THEN 'source_of_another_award' WHEN source_url IS DISTINCT FROM url THEN 'another_url' WHEN source_id % 7 = 3 THEN 'source_not_published'
      WHEN event_id % 6 IN (0, 5) THEN 'no_evidence' WHEN hidden THEN 'hidden' WHEN NOT allowed THEN 'source_not_allowed' WHEN NOT useful THEN 'not_useful' END AS why_not
    FROM t LEFT JOIN {AWARDS} a USING (award) LEFT JOIN s ON s.page_id = source_id""")
def public_visibility(spark, sf_dir):
    """Why the public doesn't see a change, by all conditions of a public one; null if it does."""
    changes = told(spark, sf_dir).withColumnRenamed("event_id", "id").withColumn("award", F.expr(AWARD.replace("event_id", "id")))
    of = lambda purpose, name: judged_sources(spark, sf_dir, purpose).select("page_id", "status", F.col("quality.allowed").alias(name))
    pages = tables.table(spark, sf_dir, "pages", "page_id", "url").join(of("public", "public"), "page_id").join(of("monitoring", "monitored").drop("status"), "page_id")
    sources = pages.select(F.col("page_id").alias("id"), (F.col("page_id") % 10).alias("award"), "url", (F.col("status") == "open").alias("open"), (F.col("public") & F.col("monitored")).alias("allowed"))
    kind = F.col("event_type")
    events = tables.table(spark, sf_dir, "events", "user_id", "event_type").groupBy((F.col("user_id") % 10).alias("award"))
    publications = events.agg((F.count_if(kind == "signup") >= F.count_if(kind == "purchase")).alias("verified"), (F.count_if(kind == "error") <= F.count_if(kind == "click")).alias("active"))
    members = sources.filter("id % 7 <> 3").select("award", F.col("id").alias("source_id"))
    shown = F.when(F.col("id") % 6 == 5, "visual-event-evidence-v0").when(F.col("id") % 2 == 0, "visual-event-evidence-v1").otherwise("visual-event-evidence-v2")
    evidence = changes.filter("id % 6 <> 0").select("id", "award", "source_id", shown.alias("schema"))
    return visibility.public(changes, sources, publications, members, evidence).select("id", "why_not")
