"""Queries over urls, sources, change events and facts that gates judge. Sources, changes and candidates are made from pages, events and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import patterns as P
from tidemark.operators import gates as G
from tidemark.operators import rollups
from tidemark.operators.runs import same
from tidemark.sources import tables
from tidemark.sources.scratch import stored

from .registry import query
from .web import HOST as HOST_OF_URL
from .web import PATH as PATH_OF_URL


def cycle(key: str, values: list[str | None], otherwise: str = "NULL", n: int | None = None) -> str:
    """SQL text: the value of key's remainder, as both engines read it."""
    cases = " ".join(f"WHEN {k} THEN {'NULL' if v is None else quoted(v)}" for k, v in enumerate(values))
    return f"CASE {key} % {n or len(values)} {cases} ELSE {otherwise} END"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values: list[str]) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


LINKS = [
    None, "http://h.example.org/login", "ftp://h.example.org/a", "https://a.cms.omniupdate.com/x", "https://onsa.asu.edu/award", "https://x.org/careers/", "https://x.org/billing",
    "https://x.org/news/2024", "https://x.org/award?utm_source=y", "https://x.org/photo.JPG", "https://x.org/call/+1(555)010-9999-11/", "https://x.org/wp-content/uploads/2020/01/cheap.html",
    "https://x.org/program-search", "https://x.org/award/profile", "no address",
]
TITLES = ["Great Award", "Buy pills today", "", "List of current fellows", None]
ERRORS = [
    None, "HTTP 404 Not Found", "status: 403", "HTTP 429", "certificate has expired", "getaddrinfo ENOTFOUND x", "fetch failed", "No readable text", "Timed out after 60 s", "HTTP 503",
    "odd failure", "", "HTTP 410", "HTTP 405 Method", "socket hang up",
]
METADATA = (
    "'{\"n\":' || page_id || " + cycle("page_id", [""], "',\"generated_at\":\"2024-01-01\"'", 11) + " || " + cycle("page_id", [""], "',\"model\":\"m\"'", 13)
    + " || " + cycle("page_id", ["", ',"status":"Failed"', ',"error":"bad thing"'], "''", 17)
    + " || " + cycle("page_id", [',"quality_flags":["fine","job_board"]', ',"quality_flags":["Access Error","spam"]'], "''", 23)
    + " || " + cycle("page_id", [',"baseline_facts_rejected":true,"rejection_reason":"Archived page"', ',"baseline_facts_rejected":true'], "''", 29)
    + " || ',\"baseline_facts\":{\"x\":1' || " + cycle("page_id", ["", ',"award_relevance":"unclear"', ',"award_relevance":"Unrelated"', ',"award_relevance":"odd one"',
                                                           ',"award_relevance":"supporting"'], "',\"award_relevance\":\"primary\"'", 19)
    + " || " + cycle("page_id", ["", ',"cycle_relevance":"unclear"', ',"cycle_relevance":"not program page"', ',"cycle_relevance":"archived_or_past"'], "',\"cycle_relevance\":\"current\"'", 31)
    + " || " + cycle("page_id", [',"confidence":"low"'], "''", 37) + " || '}}'"
)
#: Sources made from pages: page_id, link, title, page_type, error, checked, status and metadata.
SOURCE_COLUMNS = [
    "page_id", cycle("page_id", LINKS, "url", 40) + " AS link", cycle("page_id // 3", TITLES).replace("page_id // 3", "(page_id + 3)") + " AS title",
    cycle("page_id", [*P.PROTECTED_PAGE_TYPES, "other"]) + " AS page_type", cycle("page_id", ERRORS, "NULL", 21) + " AS error",
    "CASE WHEN page_id % 3 = 0 THEN NULL ELSE page_id END AS checked", cycle("page_id", ["error", "open", "open", "closed"], "'open'", 10) + " AS status", METADATA + " AS metadata",
]
SOURCES = f"(SELECT {', '.join(SOURCE_COLUMNS)} FROM pages)"


def sources(spark, sf_dir):
    return tables.table(spark, sf_dir, "pages", "page_id", "url").selectExpr(*SOURCE_COLUMNS)


def judged_sources(spark, sf_dir, purpose: str = "monitoring"):
    """Sources with quality (for a purpose) and words; the review is worked out once, in a column of its own."""
    rows = sources(spark, sf_dir).withColumn("review", G.review_status(F.col("metadata")))
    quality = G.source_quality(F.col("link"), F.col("title"), F.col("metadata"), purpose, F.col("review"))
    return rows.withColumns({"quality": quality, "words": F.concat_ws(" ", "link", "title", "page_type")})


def host_sql(c: str) -> str:
    return HOST_OF_URL.replace("url", c)


def path_sql(c: str) -> str:
    return PATH_OF_URL.replace("url", c)


def key_sql(x: str) -> str:
    """clean_key."""
    return f"regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce({x}, ''))), '[\\s_]+', '-', 'g'), '[^a-z0-9-]+', '', 'g'), '-+', '-', 'g')"


def matches(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {quoted(pattern)})"


def blocked_sql(c: str) -> str:
    h, p = host_sql(c), path_sql(c)
    on_path = [P.PHONE_PATH, P.HARD_PATH, P.CAREER_PATH, P.PAYMENT_PATH, P.SEARCH_PATH, P.LISTING_PATH]
    return (
        f"(NOT {matches(c, '(?i)^https?://')} OR {h} = '' OR {h} IN {listed(P.CMS_HOSTS + P.DOWNLOAD_HOSTS)} OR {matches(c, P.TRACKING_QUERY)} OR " + " OR ".join(matches(p, x) for x in on_path) + ")"
    )


def trackable_sql(c: str) -> str:
    return f"(coalesce({c}, '') <> '' AND {host_sql(c)} NOT IN {listed(P.DISCOVERY_HOSTS)} AND NOT {blocked_sql(c)} AND NOT {matches(path_sql(c), P.ASSET_PATH)})"


@query(f"""SELECT page_id, coalesce({host_sql('link')} IN {listed(P.DISCOVERY_HOSTS)}, false) AS discovery, coalesce({blocked_sql('link')}, false) AS blocked,
    coalesce({blocked_sql('link')} OR {matches(path_sql('link'), P.ASSET_PATH)}, false) AS non_award, coalesce({trackable_sql('link')}, false) AS trackable,
    page_type IN {listed(P.PROTECTED_PAGE_TYPES)} AS protected FROM {SOURCES}""")
def url_policy(spark, sf_dir):
    link = F.col("link")
    return sources(spark, sf_dir).select(
        "page_id", G.discovery_only(link).alias("discovery"), G.hard_blocked(link).alias("blocked"), G.non_award(link).alias("non_award"), G.trackable(link).alias("trackable"),
        F.col("page_type").isin(P.PROTECTED_PAGE_TYPES).alias("protected"),
    )


def rejected_sql(s: str) -> str:
    has = lambda *parts: "(" + " OR ".join(f"contains({s}, '{p}')" for p in parts) + ")"
    return (
        f"CASE WHEN {has('sibling', 'unrelated-program')} THEN 'reviewed_rejected_sibling_program' WHEN {has('archive', 'past')} THEN 'reviewed_rejected_archived_or_past' "
        f"WHEN {has('not-program')} THEN 'reviewed_rejected_not_program_page' WHEN {has('access', 'captcha', 'security', 'login')} THEN 'reviewed_rejected_access_error' "
        f"WHEN {has('generic', 'listing', 'search', 'job', 'career', 'payment', 'profile', 'recipient', 'news')} THEN 'reviewed_rejected_generic_listing' ELSE 'reviewed_rejected_unrelated' END"
    )


def at(path: str) -> str:
    return f"json_extract_string(metadata, '$.{path}')"


REVIEWED = f"""(SELECT *, split_part(found, '|', 1) AS review, split_part(found, '|', 2) AS why, starts_with(found, 'reviewed_accepted') AS usable FROM (
    SELECT *, CASE WHEN NOT generated AND NOT rejected AND false THEN ''
      WHEN state IN ('failed', 'error') THEN 'review_failed|review_status_' || state WHEN failure <> '' THEN 'review_failed|review_error_' || failure
      WHEN NOT generated THEN 'reviewed_invalid_or_incomplete|missing_page_metadata_generated_at' WHEN NOT modelled THEN 'reviewed_invalid_or_incomplete|missing_page_metadata_model'
      WHEN flag IS NOT NULL THEN {rejected_sql('flag')} || '|quality_flag_' || flag
      WHEN rejected AND cause = '' THEN 'reviewed_invalid_or_incomplete|baseline_facts_rejected_missing_rejection_reason'
      WHEN rejected THEN {rejected_sql('cause')} || '|baseline_facts_rejected_' || cause
      WHEN relevance = '' THEN 'reviewed_invalid_or_incomplete|missing_award_relevance' WHEN relevance = 'unclear' THEN 'reviewed_unclear_needs_manual_review|award_relevance_unclear'
      WHEN relevance = 'unrelated' THEN 'reviewed_rejected_unrelated|award_relevance_unrelated'
      WHEN relevance NOT IN ('primary', 'supporting') THEN 'reviewed_invalid_or_incomplete|unknown_award_relevance_' || relevance
      WHEN cycle = '' THEN 'reviewed_invalid_or_incomplete|missing_cycle_relevance' WHEN cycle = 'unclear' THEN 'reviewed_unclear_needs_manual_review|cycle_relevance_unclear'
      WHEN cycle = 'not-program-page' THEN 'reviewed_rejected_not_program_page|cycle_relevance_not_program_page'
      WHEN cycle = 'archived-or-past' THEN 'reviewed_rejected_archived_or_past|cycle_relevance_archived_or_past'
      WHEN {key_sql(at('baseline_facts.confidence'))} = 'low' THEN 'reviewed_unclear_needs_manual_review|confidence_low'
      WHEN relevance = 'primary' THEN 'reviewed_accepted_primary|accepted' ELSE 'reviewed_accepted_supporting|accepted' END AS found FROM (
    SELECT *, {at('generated_at')} IS NOT NULL AS generated, {at('model')} IS NOT NULL AS modelled, coalesce({at('baseline_facts_rejected')} = 'true', false) AS rejected,
      {key_sql(at('status'))} AS state, {key_sql(at('error'))} AS failure, {key_sql(at('rejection_reason'))} AS cause,
      {key_sql(at('baseline_facts.award_relevance'))} AS relevance, {key_sql(at('baseline_facts.cycle_relevance'))} AS cycle,
      [k for k in [{key_sql('f')} for f in json_extract_string(metadata, '$.quality_flags[*]')] if k IN {listed(P.REJECTED_SOURCE_FLAGS)}][1] AS flag FROM {SOURCES})))"""


@query(f"SELECT page_id, review AS status, why AS reason, usable FROM {REVIEWED}")
def review_status(spark, sf_dir):
    return sources(spark, sf_dir).select("page_id", G.review_status(F.col("metadata")).alias("r")).select("page_id", "r.*")


def quality_sql(purpose: str) -> str:
    """The reason by which a source is allowed or not, over REVIEWED."""
    spam = f"({matches(path_sql('link'), P.UPLOAD_PATH)} AND {matches('concat_ws(chr(32), title, ' + path_sql('link') + ')', P.SPAM_TITLE)})"
    first = f"""CASE WHEN coalesce(link, '') = '' THEN 'missing_url' WHEN NOT {trackable_sql('link')} THEN 'url_not_{'monitorable' if purpose in ('monitoring', 'discovery') else 'public_trackable'}'
      WHEN {spam} THEN 'url_spam_upload_html' """
    if purpose in ("public", "facts", "monitoring"):
        return first + "WHEN usable THEN 'ai_review_' || review ELSE 'ai_review_' || review || '_' || why END"
    strict = "true" if purpose == "discovery" else "false"
    return first + f"""WHEN rejected THEN 'baseline_facts_rejected' WHEN flag IS NOT NULL THEN 'quality_flag_' || flag WHEN relevance = 'unrelated' THEN 'award_relevance_unrelated'
      WHEN relevance IN ('', 'unclear') AND {strict} THEN 'award_relevance_unclear' WHEN cycle = 'not-program-page' THEN 'cycle_relevance_not_program_page'
      WHEN cycle = 'archived-or-past' THEN 'cycle_relevance_archived_or_past' WHEN cycle IN ('', 'unclear') AND {strict} THEN 'cycle_relevance_unclear' ELSE 'allowed' END"""


def allowed_sql(reason: str) -> str:
    return f"({reason} = 'allowed' OR starts_with({reason}, 'ai_review_reviewed_accepted'))"


PURPOSES = ["public", "facts", "monitoring", "discovery", "admin", "debug"]


@query(" UNION ALL ".join(f"SELECT page_id, '{p}' AS purpose, {allowed_sql('reason')} AS allowed, reason FROM (SELECT page_id, {quality_sql(p)} AS reason FROM {REVIEWED})" for p in PURPOSES))
def source_quality(spark, sf_dir):
    rows = sources(spark, sf_dir).withColumn("review", G.review_status(F.col("metadata")))
    of = lambda p: G.source_quality(F.col("link"), F.col("title"), F.col("metadata"), p, F.col("review"))
    gates = [F.struct(F.lit(p).alias("purpose"), of(p).alias("v")) for p in PURPOSES]
    return rows.select("page_id", F.explode(F.array(*gates)).alias("g")).select("page_id", "g.purpose", "g.v.allowed", "g.v.reason")


@query(f"""SELECT reason, allowed, count(*)::BIGINT AS n FROM (SELECT reason, {allowed_sql('reason')} AS allowed FROM (SELECT {quality_sql('monitoring')} AS reason FROM {REVIEWED})) GROUP BY 1, 2""")
def source_quality_summary(spark, sf_dir):
    return judged_sources(spark, sf_dir).groupBy("quality.reason", "quality.allowed").agg(F.count("*").alias("n"))


def health_sql() -> str:
    t = "lower(trim(coalesce(error, '')))"
    http = f"try_cast(nullif(regexp_extract({t}, '\\b(?:http|status)\\s*:?[\\s-]*([0-9]{{3}})\\b', 1), '') AS INTEGER)"
    parts = " ".join(f"WHEN {' OR '.join(f'contains({t}, {quoted(x)})' for x in texts)} THEN '{kind}'" for kind, texts in P.HEALTH_TEXTS)
    return f"""CASE WHEN {t} = '' AND status = 'error' THEN 'failed' WHEN {t} = '' AND checked IS NOT NULL THEN 'ok' WHEN {t} = '' THEN 'pending' WHEN contains({t}, 'certificate') OR contains({t}, 'cert_has_expired')
      THEN 'certificate' WHEN {http} IN (404, 410) THEN 'missing' WHEN {http} IN (401, 403, 405) THEN 'blocked' WHEN {http} = 429 THEN 'rate_limited' WHEN {http} >= 500 THEN 'server_error' {parts} ELSE 'failed' END"""


@query(f"SELECT page_id, {health_sql()} AS kind FROM {SOURCES}")
def source_health(spark, sf_dir):
    return sources(spark, sf_dir).select("page_id", G.health_kind(F.col("error"), F.col("status"), F.col("checked")).alias("kind"))


KINDS = ["ok", "pending", "blocked", "missing", "rate_limited", "certificate", "no_text", "timeout", "dns"]


@query(f"""SELECT page_type, count(*)::BIGINT AS total, count(*) FILTER (WHERE kind NOT IN ('ok', 'pending'))::BIGINT AS review,
    {', '.join(f"count(*) FILTER (WHERE kind = '{k}')::BIGINT AS n_{k}" for k in KINDS)} FROM (SELECT page_type, {health_sql()} AS kind FROM {SOURCES}) GROUP BY page_type""")
def source_health_summary(spark, sf_dir):
    rows = sources(spark, sf_dir).withColumn("kind", G.health_kind(F.col("error"), F.col("status"), F.col("checked")))
    counted = {"review": ~F.col("kind").isin("ok", "pending")} | {f"n_{k}": F.col("kind") == k for k in KINDS}
    return rollups.measures(rows, ["page_type"], counted)


BUCKET = "CASE WHEN trim(coalesce(error, '')) = '' THEN 'none' " + " ".join(f"WHEN {matches('error', p)} THEN '{n}'" for n, p in P.FAILURE_BUCKETS) + " ELSE 'other_failure' END"


@query(f"""WITH s AS (SELECT page_id, page_type, {BUCKET} AS bucket, row_number() OVER (PARTITION BY coalesce(link, '') ORDER BY page_id) > 1 AS duplicate,
      CASE WHEN coalesce({blocked_sql('link')}, true) THEN 'blocked_url' END AS policy FROM {SOURCES}),
    u AS (SELECT page_type, count(*) FILTER (WHERE NOT duplicate AND policy IS NULL AND bucket NOT IN ('404_gone', '410_gone', 'dead_dns')) AS useful FROM s GROUP BY 1)
    SELECT page_id, CASE WHEN duplicate OR policy IS NOT NULL OR (bucket IN ('404_gone', '410_gone', 'dead_dns') AND useful > 0) THEN 'safe_to_remove' WHEN bucket IN ('404_gone', '410_gone', 'dead_dns')
      THEN 'needs_replacement' WHEN bucket <> 'none' THEN 'keep_but_blocked' ELSE 'no_action' END AS action,
      CASE WHEN duplicate THEN 'duplicate_source' WHEN policy IS NOT NULL THEN policy WHEN bucket <> 'none'
      THEN bucket ELSE 'healthy_or_unchecked' END AS reason FROM s JOIN u USING (page_type)""")
def source_cleanup(spark, sf_dir):
    """What cleanup does with each source, knowing duplicates and how many useful sources its page type has."""
    rows = sources(spark, sf_dir).withColumn("key", F.coalesce("link", F.lit("")))
    first = rows.groupBy("key").agg(F.min("page_id").alias("first_id"))  # an aggregate: equal links don't meet in one task
    rows = rows.join(first, "key").withColumns({
        "duplicate": F.col("page_id") > F.col("first_id"), "bucket": G.failure_bucket(F.col("error")),
        "policy": F.when(F.coalesce(G.hard_blocked(F.col("link")), F.lit(True)) | F.col("link").isNull(), "blocked_url"),
    })
    alive = ~F.col("duplicate") & F.col("policy").isNull() & ~F.col("bucket").isin("404_gone", "410_gone", "dead_dns")
    useful = rows.groupBy("page_type").agg(F.count_if(alive).alias("useful"))
    judged = rows.join(useful, "page_type").select("page_id", G.cleanup_action(F.col("duplicate"), F.col("policy"), F.col("bucket"), F.col("useful")).alias("c"))
    return judged.select("page_id", "c.*")


def text_at(path: str) -> str:
    return f"json_extract_string(details, '$.{path}')"


SUMMARIES = [
    "The application deadline moved to May 3, 2025 for all applicants", "Page content changed", "Current fellows and testimonial updated on this page", "A security question now guards the page",
    "Related links were added to the page for visitors", "version 3 changed", "PDF file size changed on the server today", "Essay and transcript are now required documents", "Something changed",
    "New terms found: alpha, beta, gamma and delta", "Follow us on facebook for all the latest award information", "The fund now covers travel to the", "Stipend rises for the coming academic year, says the award page",
]
DETAILS = (
    "'{\"n\":' || event_id || " + cycle("event_id", [',"suppression_reason":"old one"', ',"suppressed_at":"2024"'], "''", 53) + " || " + cycle("event_id", [',"is_alert_worthy":false'], "''", 31)
    + " || " + cycle("event_id", [',"generation_status":"Rejected"'], "''", 37) + " || " + cycle("event_id", [',"quality_flags":["fine","Job Board"]', ',"quality_flags":["popup"]'], "''", 29)
    + " || " + cycle("event_id", [',"structured_diff":{"added_text":["Applications open","now"]}', ',"structured_diff":{"added_text":["deadline"]}'], "''", 7) + " || '}'"
)
#: Change events made from events, one source (a page) each, some without one that exists.
CHANGE_COLUMNS = [
    "event_id", "CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 43 = 0 THEN -1 ELSE event_id % 200 END AS source_id", "CASE WHEN event_id % 61 = 0 THEN event_id END AS suppressed_at",
    cycle("event_id", SUMMARIES) + " AS summary", DETAILS + " AS details",
]
CHANGES = f"(SELECT {', '.join(CHANGE_COLUMNS)} FROM events)"


def changes(spark, sf_dir):
    return tables.table(spark, sf_dir, "events", "event_id").selectExpr(*CHANGE_COLUMNS)


def suppression_sql() -> str:
    evidence = "array_to_string(coalesce(json_extract_string(details, '$.structured_diff.added_text[*]'), []), ' ')"
    words = f"concat_ws(' ', summary, {text_at('reader_summary')}, {evidence})"
    source_text = "concat_ws(' ', link, title, page_type)"
    shape, proven, applicant = matches(source_text, P.SHAPE_SOURCE), matches(evidence, P.APPLICANT), matches(words, P.APPLICANT)
    flag = f"[k for k in [{key_sql('f')} for f in json_extract_string(details, '$.quality_flags[*]')] if k IN {listed(P.REJECTED_CHANGE_FLAGS)}][1]"
    noise = " ".join(f"WHEN {matches(words, p)} AND NOT {applicant} THEN '{n}'" for n, p in P.NOISE_SUMMARIES)
    return f"""CASE WHEN suppressed_at IS NOT NULL OR coalesce({text_at('suppressed_at')}, '') <> '' OR coalesce({text_at('suppression_reason')}, '') <> ''
      THEN coalesce({text_at('suppression_reason')}, 'already_suppressed') WHEN source_id IS NOT NULL AND page_id IS NULL THEN 'source_missing'
      WHEN page_id IS NOT NULL AND coalesce(status, 'open') <> 'open' THEN 'source_status_' || {key_sql('status')}
      WHEN page_id IS NOT NULL AND NOT {allowed_sql('reason')} AND NOT (reason = 'url_not_monitorable' AND {shape} AND {proven}) THEN 'source_quality_' || reason
      WHEN {text_at('is_alert_worthy')} = 'false' THEN 'not_alert_worthy' WHEN {key_sql(text_at('generation_status'))} = 'rejected' THEN 'generation_status_rejected'
      WHEN {flag} IS NOT NULL THEN 'quality_flag_' || replace({flag}, '-', '_') WHEN {matches(source_text, P.BAD_SOURCE)} OR ({shape} AND NOT {proven}) THEN 'source_shape_noise' {noise} END"""


SUPPRESSED = f"""(SELECT event_id, summary, {suppression_sql()} AS reason FROM {CHANGES} LEFT JOIN (SELECT page_id, link, title, page_type, status, {quality_sql('monitoring')} AS reason FROM {REVIEWED})
    ON page_id = source_id)"""


def suppressed(spark, sf_dir):
    """Change events with the reason of their suppression; sources are judged once, before they meet their events."""
    judged = judged_sources(spark, sf_dir).select("page_id", "status", F.col("words").alias("source_text"), "quality")
    rows = changes(spark, sf_dir).join(judged, F.col("source_id") == F.col("page_id"), "left")
    reason = G.suppression_reason(
        F.col("suppressed_at"), F.col("source_id"), F.col("page_id").isNotNull(), F.col("status"), F.coalesce("source_text", F.lit("")), F.col("quality"), F.col("details"), F.col("summary")
    )
    return rows.select("event_id", "summary", reason.alias("reason"))


@query(f"SELECT event_id, reason IS NOT NULL AS suppressed, reason FROM {SUPPRESSED}")
def suppression_gate(spark, sf_dir):
    return suppressed(spark, sf_dir).select("event_id", F.col("reason").isNotNull().alias("suppressed"), "reason")


@query(f"SELECT coalesce(reason, 'published') AS reason, count(*)::BIGINT AS n, min(event_id) AS first_id FROM {SUPPRESSED} GROUP BY 1")
def suppression_summary(spark, sf_dir):
    rows = suppressed(spark, sf_dir)
    return rows.groupBy(F.coalesce("reason", F.lit("published")).alias("reason")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def useful_sql() -> str:
    c = "trim(regexp_replace(regexp_replace(coalesce(summary, ''), chr(0), ''), '[ \\t\\n\\r\\f]+', ' ', 'g'))"
    low = f"lower({c})"
    words = f"[w for w in string_split({low}, ' ') if w <> '']"
    last = f"regexp_replace(coalesce({words}[-1], ''), '[^a-z0-9]+', '', 'g')"
    empty = " OR ".join([f"starts_with({low}, {quoted(x)})" for x in P.EMPTY_OPENINGS] + [f"contains({low}, {quoted(x)})" for x in P.EMPTY_PHRASES])
    quotes = f"(len({c}) - len(replace({c}, chr(34), '')))"
    return f"(len({c}) >= 28 AND len({words}) >= 6 AND NOT ({quotes} % 2 = 1 AND len({c}) < 120) AND {last} NOT IN {listed(P.LAST_WORDS)} AND NOT ({empty}) AND NOT {matches(low, P.BOILERPLATE)})"


@query(f"""SELECT event_id, {useful_sql()} AS useful, coalesce(len([f for f in json_extract_string(details, '$.quality_flags[*]') if f IN {listed(P.NOT_ALERT_WORTHY)}]), 0) = 0 AS alert_worthy FROM {CHANGES}""")
def summary_usefulness(spark, sf_dir):
    flags = F.from_json(F.get_json_object("details", "$.quality_flags"), "array<string>")
    return changes(spark, sf_dir).select("event_id", G.useful_summary(F.col("summary")).alias("useful"), G.alert_worthy(flags).alias("alert_worthy"))


FACT_FIELDS = ["deadline", "overview", "award_amounts", "application_url", "eligibility", "documents", "contacts", "stipend"]
NAMES = ["Red Widget Research Award", "The Blue Gadget (Senior) Fellowship", "Green & Gold Scholarship", "Program for the Awards"]
SEEN = ["Red Widget research page", "Blue gadget overview", "gold news listing", "green gold prize", "", "red widget research profile"]
#: Candidate facts made from lineitem.
CANDIDATE_COLUMNS = [
    "l_orderkey", "l_linenumber", cycle("(l_partkey + l_linenumber)", FACT_FIELDS) + " AS field", cycle("l_partkey", [*P.PROTECTED_PAGE_TYPES, "other"]) + " AS page_type",
    cycle("l_suppkey", ["primary", "supporting", "primary", ""]) + " AS relevance", cycle("l_orderkey", NAMES) + " AS name", cycle("l_suppkey", SEEN, "NULL", 6) + " AS seen",
    cycle("l_partkey", [" ; ", "", None], "'May 3, 2025.'", 17) + " AS value", cycle("l_partkey", ["", None, " "], "'quoted'", 13) + " AS evidence", "l_suppkey % 5 = 0 AS home", "l_extendedprice",
]
CANDIDATES = f"(SELECT {', '.join(CANDIDATE_COLUMNS)} FROM lineitem)"


def tokens_sql(c: str) -> str:
    plain = f"regexp_replace(regexp_replace(replace(lower(coalesce({c}, '')), '&', ' and '), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')"
    return f"[w for w in string_split(trim({plain}), ' ') if len(w) > 2 AND w NOT IN {listed(P.IDENTITY_STOP_WORDS)}][1:30]"


def candidates_sql() -> str:
    own, other = tokens_sql("name"), tokens_sql("seen")
    score = f"""CASE WHEN len({own}) = 0 THEN 0.0 ELSE least(1.0, greatest(0.0, len([t for t in {own} if list_contains({other}, t)]) / len({own})
      + CASE relevance WHEN 'primary' THEN 0.25 WHEN 'supporting' THEN 0.12 ELSE 0.0 END + CASE WHEN home THEN 0.2 ELSE 0.0 END - CASE WHEN {matches("coalesce(seen, '')", P.GENERIC_SOURCE)} THEN 0.15 ELSE 0.0 END)) END"""
    by_type = " ".join(f"WHEN '{k}' THEN field IN {listed(v)}" for k, v in P.FIELDS_OF_PAGE_TYPE.items())
    return f"""(SELECT *, identity >= 0.35 AND NOT {matches("coalesce(seen, '')", P.GENERIC_SOURCE)} AND CASE WHEN field IN {listed(P.PRIMARY_FIELDS)} THEN relevance = 'primary' AND page_type IN
      ('homepage', 'deadline', 'eligibility', 'requirements', 'faq') ELSE CASE page_type {by_type} ELSE true END END AS fits FROM (SELECT *, ({score})::DOUBLE AS identity FROM {CANDIDATES}))"""


def candidates(spark, sf_dir):
    """Candidate facts with identity and fits. Each different pair of a name and a source is judged once, and met by its candidates."""
    lines = tables.table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").selectExpr(*CANDIDATE_COLUMNS)
    about, seen = ["name", "seen", "relevance", "home"], F.coalesce("seen", F.lit(""))
    judged = lines.select(*about).distinct().withColumn("identity", G.identity_score(F.col("name"), seen, F.col("relevance"), F.col("home")))
    judged = stored(judged, "judged-sources")  # few as a rule: with their size known, the candidates needn't be shuffled to meet them
    scored = lines.alias("l").join(judged.alias("j"), same(about, "l", "j")).select("l.*", "j.identity")
    return scored.withColumn("fits", G.may_give(F.col("field"), F.col("page_type"), F.col("relevance"), seen, F.col("identity")))


@query(f"SELECT l_orderkey, l_linenumber, round(identity, 6) AS identity, fits FROM {candidates_sql()}")
def fact_eligibility(spark, sf_dir):
    return candidates(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round("identity", 6).alias("identity"), "fits")


VALIDATED = f"""(SELECT *, CASE WHEN regexp_replace(trim(coalesce(value, '')), '[.;:\\s]+$', '') = '' THEN 'empty_value' WHEN NOT fits AND identity < 0.35 THEN 'sibling_program_identity_mismatch'
    WHEN NOT fits THEN 'field_not_allowed_for_source_role' WHEN trim(coalesce(evidence, '')) = '' AND field NOT IN {listed(P.URL_FIELDS)} THEN 'missing_exact_evidence' ELSE 'accepted' END AS reason FROM {candidates_sql()})"""


def validated(spark, sf_dir):
    found = candidates(spark, sf_dir)
    judged = G.candidate_verdict(F.col("value"), F.col("evidence"), F.col("field"), F.col("fits"), F.col("identity"))
    return found.withColumn("v", judged).withColumns({"reason": F.col("v.reason"), "allowed": F.col("v.allowed")}).drop("v")


@query(f"SELECT l_orderkey, l_linenumber, field, reason = 'accepted' AS allowed, reason FROM {VALIDATED}")
def fact_validate(spark, sf_dir):
    return validated(spark, sf_dir).select("l_orderkey", "l_linenumber", "field", "allowed", "reason")


SEVERITIES = ["info", "warning", "error", "critical"]


@query(f"""WITH v AS (SELECT * FROM {VALIDATED}), a AS (SELECT l_orderkey, count(*) FILTER (WHERE reason = 'accepted' AND field = 'overview') AS overviews,
      count(*) FILTER (WHERE field = 'deadline' AND reason = 'missing_exact_evidence') AS bare, count(*) FILTER (WHERE field = 'award_amounts' AND fits) AS offered,
      count(*) FILTER (WHERE field = 'award_amounts' AND reason = 'accepted') AS amounts, count(DISTINCT page_type) FILTER (WHERE field = 'deadline' AND reason = 'accepted') AS deadlines FROM v GROUP BY 1),
    f AS (SELECT l_orderkey, [x for x in [CASE WHEN overviews = 0 THEN 'missing_description' END, CASE WHEN bare > 0 THEN 'deadline_missing_evidence' END, CASE WHEN deadlines > 1 THEN 'field_conflict' END,
      CASE WHEN amounts = 0 AND offered > 0 THEN 'missing_amount_with_official_evidence' END] if x IS NOT NULL] AS codes,
      greatest(CASE WHEN bare > 0 OR deadlines > 1 THEN 3 ELSE 0 END, CASE WHEN overviews = 0 OR (amounts = 0 AND offered > 0) THEN 1 ELSE 0 END) AS level FROM a)
    SELECT l_orderkey, array_to_string(codes, ',') AS codes, ['info', 'warning', 'error', 'critical'][level + 1] AS severity, level >= 2 AS blocked,
      CASE WHEN level >= 2 THEN 'failed' WHEN len(codes) > 0 THEN 'warnings' ELSE 'passed' END AS status FROM f""")
def page_audit_findings(spark, sf_dir):
    """Findings on each award's validated facts, the worst severity, and whether they block publication. Conflicts are counted, never paired."""
    of = lambda field, more: F.count_if((F.col("field") == field) & more)
    sums = validated(spark, sf_dir).groupBy("l_orderkey").agg(
        of("overview", F.col("allowed")).alias("overviews"), of("deadline", F.col("reason") == "missing_exact_evidence").alias("bare"), of("award_amounts", F.col("fits")).alias("offered"),
        of("award_amounts", F.col("allowed")).alias("amounts"), F.count_distinct(F.when((F.col("field") == "deadline") & F.col("allowed"), F.col("page_type"))).alias("deadlines"),
    )
    rules = [
        ("missing_description", 1, F.col("overviews") == 0), ("deadline_missing_evidence", 3, F.col("bare") > 0), ("field_conflict", 3, F.col("deadlines") > 1),
        ("missing_amount_with_official_evidence", 1, (F.col("amounts") == 0) & (F.col("offered") > 0)),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"))) for code, level, c in rules]))
    level = F.coalesce(F.array_max(F.transform("found", lambda f: f["level"])), F.lit(0))
    rows = sums.select("l_orderkey", found.alias("found")).withColumn("level", level)
    return rows.select(
        "l_orderkey", F.array_join(F.transform("found", lambda f: f["code"]), ",").alias("codes"), F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("level") + 1).alias("severity"),
        (F.col("level") >= 2).alias("blocked"), F.when(F.col("level") >= 2, "failed").when(F.size("found") > 0, "warnings").otherwise("passed").alias("status"),
    )
