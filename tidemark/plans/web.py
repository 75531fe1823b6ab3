"""Queries over captured pages and document versions: pages, documents, labels, benchmark, conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators import changes, evidence, keyed, rollups, runs
from tidemark.sources import tables
from tidemark.sources.captures import captures

from .registry import query

HOST = "regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\\.', '')"
PATH = "regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)"
KEY = f"""{HOST} || coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower({PATH}), '/index\\.(?:html?|php|aspx?)$', '/'), '\\.aspx$', ''), '/+$', ''), ''), '/')
    || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END"""
PARTS = r"""SELECT *, list_sort([p for p in string_split(lower(regexp_extract(url, '^[^?#]*\?([^#]*)', 1)), '&') if regexp_extract(p, '^([^=]*)', 1) <> ''
    AND NOT starts_with(p, 'utm_') AND regexp_extract(p, '^([^=]*)', 1) NOT IN ('fbclid', 'gclid', 'msclkid', 'mc_cid', 'mc_eid', 'share', 'replytocom', 'lang', 'locale', 'view',
    'campaign', 'sort') AND NOT (p IN ('page', 'page=', 'page=1')) AND NOT (p IN ('s', 's='))]) AS kept FROM pages"""


@query(f"SELECT page_id, {KEY} AS url_key FROM ({PARTS})")
def url_canonical_key(spark, sf_dir):
    return tables.table(spark, sf_dir, "pages", "page_id", "url").select("page_id", U.canonical_key(F.col("url")).alias("url_key"))


@query(f"SELECT page_id, {HOST} AS domain, (('0x' || sha256({HOST})[1:12])::BIGINT % 3)::INTEGER AS shard FROM pages")
def url_domain_shard(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "pages", "page_id", "url").withColumn("domain", U.host(F.col("url")))
    return rows.select("page_id", "domain", U.shard(F.col("domain"), 3).alias("shard"))


@query(f"""SELECT {HOST} || regexp_replace(regexp_replace(lower({PATH}), '/[0-9a-f]{{8,}}', '/:id', 'g'), '/[0-9]+', '/:n', 'g') AS template, count(*)::BIGINT AS n FROM pages GROUP BY 1""")
def url_template(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "pages", "url").select(U.template(F.col("url")).alias("template"))
    return rows.groupBy("template").agg(F.count("*").alias("n"))


SCORE = "CASE WHEN starts_with(lower(url), 'https:') THEN 2 ELSE 1 END + CASE WHEN regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) = '' THEN 20 ELSE -20 END"


@query(f"SELECT url_key, arg_max(page_id, (score, -page_id)) AS winner, count(*)::BIGINT AS members FROM (SELECT page_id, {KEY} AS url_key, {SCORE} AS score FROM ({PARTS})) GROUP BY url_key")
def url_group_winner(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "pages", "page_id", "url").select("page_id", U.canonical_key(F.col("url")).alias("url_key"), U.preference(F.col("url")).alias("score"))
    return rows.groupBy("url_key").agg(F.max_by("page_id", F.struct("score", -F.col("page_id"))).alias("winner"), F.count("*").alias("members"))


@query(f"""SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY url_key ORDER BY score DESC, page_id) AS place
    FROM (SELECT page_id, {KEY} AS url_key, {SCORE} AS score FROM ({PARTS}))) WHERE place > 1""")
def duplicate_losers(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "pages", "page_id", "url").select("page_id", U.canonical_key(F.col("url")).alias("url_key"), U.preference(F.col("url")).alias("score"))
    return keyed.occurrences(rows, ["url_key"], [F.desc("score"), F.asc("page_id")], "place").filter("place > 1").select("page_id")


@query(f"""SELECT prefix, count(*)::BIGINT AS sources FROM (SELECT unnest([{HOST} || array_to_string(s[1:k], '') for k in range(0, len(s) + 1)]) AS prefix
    FROM (SELECT url, ['/' || x for x in string_split(lower({PATH}), '/') if x <> ''] AS s FROM pages)) GROUP BY prefix""")
def source_tree_paths(spark, sf_dir):
    url = F.col("url")
    parts = F.transform(F.filter(F.split(F.lower(U.path(url)), "/"), lambda p: p != ""), lambda p: F.concat(F.lit("/"), p))
    prefixes = F.transform(F.sequence(F.lit(0), F.size("parts")), lambda k: F.concat("host", F.array_join(F.slice("parts", F.lit(1), k), "")))
    rows = tables.table(spark, sf_dir, "pages", "url").select(U.host(url).alias("host"), parts.alias("parts"))
    return rows.select(F.explode(prefixes).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("sources"))


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href="([^"]*)"', 1))::INTEGER AS links,
    array_to_string(list_sort(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))), ' ') AS targets FROM pages""")
def html_extract_links(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)
    rows = tables.table(spark, sf_dir, "pages", "page_id", "html")
    return rows.select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(found).alias("links"),
        F.array_join(F.array_sort(F.array_distinct(found)), " ").alias("targets"),
    )


PAGE_TYPES = [("listing", "[?&]page="), ("pdf", r"\.pdf(?:$|[?#])"), ("feed", "utm_source=feed"), ("anchor", "#"), ("document", r"\.html$")]


@query("""SELECT page_id, CASE WHEN regexp_matches(url, '[?&]page=') THEN 'listing' WHEN regexp_matches(url, '\\.pdf(?:$|[?#])') THEN 'pdf' WHEN contains(url, 'utm_source=feed') THEN 'feed'
    WHEN contains(url, '#') THEN 'anchor' WHEN regexp_matches(url, '\\.html$') THEN 'document' ELSE 'homepage' END AS page_type FROM pages""")
def page_type_inference(spark, sf_dir):
    return tables.table(spark, sf_dir, "pages", "page_id", "url").select("page_id", T.first_match(PAGE_TYPES, F.col("url"), "homepage").alias("page_type"))


@query("""SELECT doc_id, previous_id, hash <> previous_hash AS changed FROM (SELECT doc_id, sha256(text) AS hash, lag(sha256(text)) OVER w AS previous_hash, lag(doc_id) OVER w AS previous_id
    FROM documents WINDOW w AS (PARTITION BY source, lang ORDER BY doc_id))""")
def previous_version_hash_change(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text")
    hashed = rows.select("doc_id", "source", "lang", F.sha2("text", 256).alias("hash"))  # only hashes are shuffled
    pairs = keyed.with_previous_id(hashed, ["source", "lang"], "doc_id", "previous_id")
    before = hashed.select(F.col("doc_id").alias("previous_id"), F.col("hash").alias("previous_hash"))
    return pairs.join(before, "previous_id", "left").select("doc_id", "previous_id", (F.col("hash") != F.col("previous_hash")).alias("changed"))


@query("""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) AS place FROM documents) d
    WHERE place > 2 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def keep_n_retention(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "documents", "doc_id", "source", "lang")
    referenced = tables.table(spark, sf_dir, "labels", "doc_id")
    return keyed.beyond_newest(rows, ["source", "lang"], [F.desc("doc_id")], 2, referenced, "doc_id").select("doc_id")


@query("""SELECT source, count(*)::BIGINT AS total, count(l.doc_id)::BIGINT AS reviewed, count(*) FILTER (WHERE l.quality = 0)::BIGINT AS failed,
    CASE WHEN count(*) > 0 THEN round(count(l.doc_id) * 100.0 / count(*), 1) ELSE 0.0 END AS percent_reviewed FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source""")
def coverage_percent(spark, sf_dir):
    docs, labels = tables.table(spark, sf_dir, "documents", "doc_id", "source"), tables.table(spark, sf_dir, "labels", "doc_id", "quality")
    joined = docs.join(labels.withColumn("seen", F.lit(True)), "doc_id", "left")
    rows = rollups.measures(joined, ["source"], {"reviewed": F.col("seen"), "failed": F.col("quality") == 0})
    return rows.withColumn("percent_reviewed", rollups.percent(F.col("reviewed"), F.col("total")))


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unreviewed' WHEN l.toxic = 1 THEN 'blocked' WHEN l.quality = 0 THEN 'low_quality' WHEN d.n_chars < 100 THEN 'too_short'
    ELSE 'allowed' END AS reason FROM documents d LEFT JOIN labels l USING (doc_id)""")
def suppression_decision(spark, sf_dir):
    docs, labels = tables.table(spark, sf_dir, "documents", "doc_id", "n_chars"), tables.table(spark, sf_dir, "labels")
    joined = docs.join(labels.withColumn("seen", F.lit(True)), "doc_id", "left")
    rules = [("unreviewed", F.col("seen").isNull()), ("blocked", F.col("toxic") == 1), ("low_quality", F.col("quality") == 0), ("too_short", F.col("n_chars") < 100)]
    return joined.select("doc_id", changes.first_rule(rules, "allowed").alias("reason"))


@query("""SELECT quality, toxic, count(*)::BIGINT AS n, count(DISTINCT source)::BIGINT AS sources FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2""")
def audit_rollup(spark, sf_dir):
    docs, labels = tables.table(spark, sf_dir, "documents", "doc_id", "source"), tables.table(spark, sf_dir, "labels")
    return labels.join(docs, "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


COLLAPSED = "trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'))"


@query(f"""SELECT doc_id, sha256({COLLAPSED}) AS collapsed, sha256(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')) AS alnum,
    len({COLLAPSED})::INTEGER AS n_collapsed FROM documents""")
def text_normalize_keys(spark, sf_dir):
    flat = T.collapse(F.col("text"))
    rows = tables.table(spark, sf_dir, "documents", "doc_id", "text")
    return rows.select("doc_id", F.sha2(flat, 256).alias("collapsed"), F.sha2(T.alnum_key(F.col("text")), 256).alias("alnum"), F.length(flat).alias("n_collapsed"))


@query(rf"""SELECT doc_id, array_to_string(regexp_extract_all(text, '{T.DATE}'), '; ') AS dates, array_to_string(regexp_extract_all(text, '{T.MONEY}'), '; ') AS amounts FROM documents""")
def date_money_phrases(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "documents", "doc_id", "text")
    return rows.select("doc_id", F.array_join(T.date_phrases(F.col("text")), "; ").alias("dates"), F.array_join(T.money_phrases(F.col("text")), "; ").alias("amounts"))


SENTENCES = "[s for s in string_split(regexp_replace({0}, '([.!?]) +', '\\1' || chr(10), 'g'), chr(10)) if len(s) BETWEEN 35 AND 320]"


@query(f"""WITH p AS (SELECT doc_id, {COLLAPSED} AS new, lag({COLLAPSED}) OVER (PARTITION BY source, lang ORDER BY doc_id) AS old FROM documents),
    s AS (SELECT doc_id, {SENTENCES.format('new')} AS a, {SENTENCES.format('old')} AS b FROM p WHERE old IS NOT NULL)
    SELECT doc_id, len(list_distinct([x for x in a if NOT list_contains(b, x)]))::INTEGER AS n_added, len(list_distinct([x for x in b if NOT list_contains(a, x)]))::INTEGER AS n_removed FROM s""")
def structured_diff(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text")
    return changes.sentence_counts(rows, ["source", "lang"], "doc_id", "text")


@query("""WITH t AS (SELECT text AS k, min(doc_id) AS first_id, count(*)::BIGINT AS copies FROM documents GROUP BY text) SELECT first_id, copies, sha256(k) AS hash FROM t WHERE copies > 1""")
def exact_change_dedupe(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("hash"))
    return rows.groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1")


@query("""SELECT conv_id, turn, role, coalesce(bool_or(role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS blocked FROM conversations""")
def publication_order_block(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "conversations", "conv_id", "turn", "role")
    return runs.blocked_by_older(rows, ["conv_id"], [F.asc("turn")], F.col("role") == "user")


@query("""SELECT coalesce(previous, 'start') AS previous, role, count(*)::BIGINT AS n FROM (SELECT role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations) GROUP BY 1, 2""")
def state_stage_order(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "conversations", "conv_id", "turn", "role")
    pairs = runs.with_previous(rows, ["conv_id"], [F.asc("turn")], {"previous": "role"})
    return pairs.groupBy(F.coalesce("previous", F.lit("start")).alias("previous"), "role").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<script>.*?</script>|<style>.*?</style>', '', 'g'), '<title>[^<]*</title>', '') AS shown FROM pages),
    t AS (SELECT *, CASE WHEN contains(shown, '<article>') THEN regexp_extract(shown, '(?s)<article>(.*?)(?:</article>|$)', 1) ELSE shown END AS part, regexp_extract_all(shown, '<a href="([^"]*)"', 1) AS hrefs FROM c)
    SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(title), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS title, len(list_distinct([lower(x) for x in hrefs]))::INTEGER AS links, url AS canonical,
      len(trim(regexp_replace(regexp_replace(regexp_replace(part, '<[^>]*>', '', 'g'), '&(?:amp|lt|gt|quot);?|&[#a-z0-9]+;', '&', 'g'), '\\s+', ' ', 'g')))::INTEGER AS n_chars FROM t""")
def captured_pages(spark, sf_dir):
    """Title, number of all links by address, canonical address and length of the text of all pages, from their tags. &amp, &lt, &gt and &quot count without a semicolon too, as in HTML."""
    rows = captures(tables.table(spark, sf_dir, "pages", "page_id", "url", "html"), "page_id")
    return rows.select("page_id", "title", F.size("all_links").alias("links"), "canonical", F.length("text").alias("n_chars"))


@query()
def change_evidence(spark, sf_dir):
    """Words added and removed between consecutive documents of a source and language, with snippets and the place of what was added; a diff isn't SQL's to say."""
    pairs = changes.version_pairs(tables.table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text"), ["source", "lang"], "doc_id", "text").filter("previous_id IS NOT NULL")
    return evidence.change_evidence(pairs.select("doc_id", "previous_id", "previous_text", "text"), "previous_text", "text")
