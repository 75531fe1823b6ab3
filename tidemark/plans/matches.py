"""Queries that search, match, rank, sort and dedupe."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import documents as D
from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators import keyed, near, search
from tidemark.sources import tables
from tidemark.sources.scratch import stored

from .gates import cycle, matches
from .registry import query
from .web import KEY, PARTS


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1995-03-10' OR (o_orderdate = TIMESTAMP '1995-03-10' AND o_orderkey > 700) ORDER BY o_orderdate, o_orderkey LIMIT 150")
def ascending_keyset_page(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    return tables.keyset_page(rows, ["o_orderdate", "o_orderkey"], [F.expr("TIMESTAMP_NTZ '1995-03-10 00:00:00'"), 700], 150)


@query("""SELECT p_partkey FROM part WHERE p_brand ILIKE '%brand#1%' AND contains(lower(concat_ws(' ', p_name, p_type, p_brand)), 'et') AND p_size >= 5""")
def multi_column_search(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_brand", "p_size").filter(F.col("p_brand").ilike("%brand#1%") & (F.col("p_size") >= 5))
    return rows.filter(F.instr(F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")), "et") > 0).select("p_partkey")


@query("SELECT event_id, user_id FROM events WHERE props ->> '$.k' = '7' AND json_type(props, '$.k') IN ('UBIGINT', 'BIGINT')")
def json_contains(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "events", "event_id", "user_id", "props")
    return rows.filter((F.get_json_object("props", "$.k") == "7") & (D.kind(F.col("props"), "$.k") == "number")).select("event_id", "user_id")


@query(f"""WITH p AS (SELECT page_id, {KEY} AS url_key FROM ({PARTS})), k AS (SELECT url_key, min(page_id) AS page_id FROM p GROUP BY 1),
    c AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 7 = 0 THEN -1 ELSE event_id % 60 END AS source_id, event_id % 50 AS about FROM events)
    SELECT event_id, coalesce(i.page_id, k.page_id) AS page_id FROM c LEFT JOIN p i ON i.page_id = c.source_id LEFT JOIN p a ON a.page_id = c.about LEFT JOIN k ON k.url_key = a.url_key""")
def fallback_key_join(spark, sf_dir):
    """Each candidate's source by id, otherwise the first page of its url's key."""
    pages = tables.table(spark, sf_dir, "pages", "page_id", "url").select("page_id", "url", U.canonical_key(F.col("url")).alias("url_key"))
    candidates = tables.table(spark, sf_dir, "events", "event_id").selectExpr(
        "event_id", "CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 7 = 0 THEN -1 ELSE event_id % 60 END AS source_id", "event_id % 50 AS about"
    )
    urls = candidates.join(pages.select(F.col("page_id").alias("about"), F.col("url").alias("source_url")), "about", "left")
    by_id = urls.join(pages.select(F.col("page_id").alias("source_id"), F.col("page_id").alias("own")), "source_id", "left").withColumn("url_key", U.canonical_key(F.col("source_url")))
    first = pages.groupBy("url_key").agg(F.min("page_id").alias("first_page"))
    return by_id.join(first, "url_key", "left").select("event_id", F.coalesce("own", "first_page").alias("page_id"))


TITLE_WORDS = "list_distinct([w for w in string_split(trim(regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[^a-z0-9]+', ' ', 'g')), ' ') if w <> ''])"


@query(f"""WITH p AS (SELECT page_id, {TITLE_WORDS} AS words, CASE WHEN url LIKE '%://%' THEN [lower(regexp_extract(url, '://([^/?#]*)', 1))] ELSE [] END AS host,
      list_distinct([x for x in string_split(lower(regexp_extract(url, '://[^/?#]*([^?#]*)', 1)), '/') if x <> '']) AS path FROM pages),
    s AS (SELECT a.page_id AS request, b.page_id AS award, round(CASE WHEN greatest(len(a.words), len(b.words)) > 0 THEN 0.8 * len(list_intersect(a.words, b.words)) / greatest(len(a.words), len(b.words)) ELSE 0 END
      + CASE WHEN greatest(len(a.host), len(b.host)) > 0 THEN 0.05 * len(list_intersect(a.host, b.host)) / greatest(len(a.host), len(b.host)) ELSE 0 END
      + CASE WHEN greatest(len(a.path), len(b.path)) > 0 THEN 0.35 * len(list_intersect(a.path, b.path)) / greatest(len(a.path), len(b.path)) ELSE 0 END, 9) AS score FROM p a JOIN p b ON a.page_id <> b.page_id)
    SELECT request, award, round(score, 6) AS score FROM s WHERE score >= 0.2 QUALIFY row_number() OVER (PARTITION BY request ORDER BY score DESC, award) = 1""")
def best_weighted_match(spark, sf_dir):
    """The other page that is most like a page by words of the title, host and path, each with its weight."""
    rows = tables.table(spark, sf_dir, "pages", "page_id", "url", "html")
    title = F.trim(F.regexp_replace(F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), "[^a-z0-9]+", " "))
    filled = lambda c: F.array_distinct(F.filter(c, lambda x: x != ""))
    host, path = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)), F.split(F.lower(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1)), "/")
    sets = [filled(F.split(title, " ")).alias("words"), F.when(F.contains("url", F.lit("://")), F.array(host)).otherwise(F.array()).alias("host"), filled(path).alias("path")]
    pages = stored(rows.select("page_id", *sets), "sets-of-pages")  # the HTML is read once
    requests, awards = pages.withColumnRenamed("page_id", "request"), pages.withColumnRenamed("page_id", "award")
    found = near.best_weighted(requests, awards, "request", "award", {"words": 0.8, "host": 0.05, "path": 0.35}, 0.2, others_only=True, null_unlike=True)
    return found.withColumn("score", F.round("score", 6))


REQUESTS = "lower(p_name || ' ' || p_type)"


@query(f"""WITH a AS (SELECT min(p_partkey) AS award, list_distinct(string_split(lower(p_name), ' ')) AS w FROM part GROUP BY list_distinct(string_split(lower(p_name), ' '))),
    r AS (SELECT p_partkey AS request, list_distinct(string_split({REQUESTS}, ' ')) AS w FROM part),
    s AS (SELECT request, award, round(len(list_intersect(r.w, a.w)) / greatest(len(r.w), len(a.w)), 6) AS score FROM r, a)
    SELECT request, award, score FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, award) AS place FROM s WHERE score >= 0.3) WHERE place = 1""")
def best_match(spark, sf_dir):
    """The award whose name shares most words with a request."""
    rows = tables.table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    awards = rows.groupBy(words(F.col("p_name")).alias("words")).agg(F.min("p_partkey").alias("award"))
    requests = rows.select(F.col("p_partkey").alias("request"), words(F.concat_ws(" ", "p_name", "p_type")).alias("words"))
    return near.best_by_tokens(requests, awards, "request", "award", "words", 0.3)


ALIASES = [search.Alias(["rw", "red one"], ["red", "widget"], ["red widget", "red"], ["gear"]), search.Alias(["gadget prize"], ["gadget"], [], ["blue"])]


@query("""WITH k AS (SELECT p_partkey, p_name, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS n, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS t FROM part),
    r AS (SELECT *, CASE WHEN contains(n, 'red') OR contains(n, 'widget') THEN CASE WHEN starts_with(n, 'red widget') THEN 1.0 WHEN starts_with(n, 'red') THEN 1.1 WHEN contains(n, 'gear') THEN 2.0 ELSE 5.0 END END AS a,
      CASE WHEN contains(n || ' ' || t, 'red') OR contains(n || ' ' || t, 'widget') THEN CASE WHEN starts_with(n, 'red widget') THEN 1.0 WHEN starts_with(n || ' ' || t, 'red') THEN 1.1 WHEN contains(n || ' ' || t, 'gear') THEN 2.0 ELSE 5.0 END END + 1 AS b,
      CASE WHEN n = 'rw' THEN 0.0 WHEN starts_with(n, 'rw') THEN 2.0 WHEN contains(n, 'rw') THEN 3.0 WHEN contains(t, 'rw') THEN 6.0 END AS p FROM k)
    SELECT p_partkey, least(a, b, p)::DOUBLE AS rank FROM r WHERE least(a, b, p) IS NOT NULL""")
def alias_search(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    return search.ranked_search(rows, "RW", "p_name", "p_type", ["p_partkey"], ALIASES).select("p_partkey", "rank")


ORGANIZATIONS = "regexp_replace(c_name, '#0*', ' - ') || CASE WHEN c_custkey % 4 = 0 THEN ', Inc' ELSE '' END"
ORG_KEY = f"lower(trim(regexp_replace({ORGANIZATIONS}, '[ \\t\\n\\r\\f]+', ' ', 'g')))"
ORG_LOOSE = f"lower(trim(regexp_replace(regexp_replace({ORGANIZATIONS}, '[-,]', ' ', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g')))"
ORG_RANKED = f"""(SELECT c_custkey, c_acctbal, loose, CASE WHEN k = 'customer - 1' OR loose = 'customer 1' THEN 0 WHEN starts_with(k, 'customer - 1') THEN 1 WHEN starts_with(loose, 'customer 1') THEN 2
    WHEN contains(loose, 'customer') THEN 3 ELSE 10 END AS rank FROM (SELECT c_custkey, c_acctbal, {ORG_KEY} AS k, {ORG_LOOSE} AS loose FROM customer))"""


def organizations(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal")
    ending = F.when(F.col("c_custkey") % 4 == 0, ", Inc").otherwise("")
    named = rows.withColumn("name", F.concat(F.regexp_replace("c_name", "#0*", " - "), ending))
    return named.select("c_custkey", "c_acctbal", search.loose_key(F.col("name")).alias("loose"), search.organization_rank("Customer - 1", F.col("name")).alias("rank"))


@query(f"SELECT c_custkey, rank::INTEGER AS rank FROM {ORG_RANKED} WHERE rank < 10 ORDER BY rank, c_acctbal DESC, c_custkey LIMIT 100")
def organization_match(spark, sf_dir):
    found = organizations(spark, sf_dir).filter("rank < 10").orderBy("rank", F.desc("c_acctbal"), "c_custkey")
    return found.limit(100).select("c_custkey", "rank")  # a report of the best hundred


@query(f"SELECT c_custkey FROM {ORG_RANKED} WHERE rank <= 2 ORDER BY rank, c_acctbal DESC, c_custkey LIMIT 1")
def best_organization(spark, sf_dir):
    return organizations(spark, sf_dir).filter("rank <= 2").orderBy("rank", F.desc("c_acctbal"), "c_custkey").limit(1).select("c_custkey")


@query(f"SELECT loose[1:10] AS key, arg_min(c_custkey, (rank, -c_acctbal, c_custkey)) AS kept, count(*)::BIGINT AS n FROM {ORG_RANKED} GROUP BY 1")
def best_wins_dedupe(spark, sf_dir):
    best = F.min_by("c_custkey", F.struct("rank", -F.col("c_acctbal"), "c_custkey"))
    return organizations(spark, sf_dir).groupBy(F.substring("loose", 1, 10).alias("key")).agg(best.alias("kept"), F.count("*").alias("n"))


@query("""WITH b AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity::DOUBLE AS x1, l_quantity + 3.5 AS x2, l_extendedprice / 1000 AS y1, l_extendedprice / 1000 + 2 AS y2 FROM lineitem),
    c AS (SELECT s_suppkey, s_suppkey % 30 AS x1, s_suppkey % 30 + 4 AS x2, 20.0 AS y1, 40.0 AS y2 FROM supplier)
    SELECT l_orderkey, l_linenumber, s_suppkey AS crop FROM b JOIN c ON s_suppkey = l_suppkey AND b.x1 < c.x2 AND c.x1 < b.x2 AND b.y1 < c.y2 AND c.y1 < b.y2""")
def interval_overlap_join(spark, sf_dir):
    boxes = tables.table(spark, sf_dir, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").selectExpr(
        "l_suppkey AS page", "l_orderkey", "l_linenumber", "CAST(l_quantity AS DOUBLE) AS x1", "l_quantity + 3.5D AS x2", "l_extendedprice / 1000 AS y1", "l_extendedprice / 1000 + 2 AS y2"
    )
    crops = tables.table(spark, sf_dir, "supplier", "s_suppkey").selectExpr("s_suppkey AS page", "s_suppkey AS id", "CAST(s_suppkey % 30 AS DOUBLE) AS x1", "CAST(s_suppkey % 30 + 4 AS DOUBLE) AS x2", "20.0D AS y1", "40.0D AS y2")
    return near.overlapping(boxes, crops, "page", 10.0).select("l_orderkey", "l_linenumber", F.col("crop_id").alias("crop"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000)")
def delete_using(spark, sf_dir):
    gone = tables.table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice").filter("o_orderstatus = 'F' AND o_totalprice > 100000").select(F.col("o_orderkey").alias("l_orderkey"))
    return tables.table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").join(gone, "l_orderkey", "left_anti")


SORTS = {"oldest": ["o_orderdate", "o_orderkey"], "priority": ["o_orderpriority", "o_orderdate", "o_orderkey"]}


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 40")
def claim_order(spark, sf_dir):
    """The next forty to be claimed, in the order that the caller names."""
    rows = tables.table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_orderdate", "o_orderstatus").filter("o_orderstatus = 'P'")
    return tables.clamped_page(rows, [F.asc(c) for c in SORTS["priority"]], 1, max(1, min(40, 500))).select("o_orderkey", "o_orderpriority")


@query("SELECT source, arg_min(doc_id, (abs(n_chars - 500), n_chars, doc_id)) AS best, count(*)::BIGINT AS n FROM documents GROUP BY source")
def best_description(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "documents", "doc_id", "source", "n_chars")
    return rows.groupBy("source").agg(F.min_by("doc_id", F.struct(F.abs(F.col("n_chars") - 500), "n_chars", "doc_id")).alias("best"), F.count("*").alias("n"))


@query("""SELECT s_suppkey, (SELECT o.s_suppkey FROM supplier o WHERE o.s_nationkey = s.s_nationkey AND o.s_suppkey <> s.s_suppkey ORDER BY o.s_acctbal DESC, o.s_suppkey LIMIT 1) AS replacement FROM supplier s""")
def best_replacement(spark, sf_dir):
    """The best other member of each one's group; only the two best of a group travel, never its pairs."""
    rows = tables.table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    top = keyed.top_per_key(rows, ["s_nationkey"], [F.desc("s_acctbal"), F.asc("s_suppkey")], 2)
    best = top.groupBy("s_nationkey").agg(F.max(F.when(F.col("rank") == 1, F.col("s_suppkey"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("s_suppkey"))).alias("second"))
    return rows.join(best, "s_nationkey").select("s_suppkey", F.when(F.col("first") == F.col("s_suppkey"), F.col("second")).otherwise(F.col("first")).alias("replacement"))


LINK = r'<a href="([^"]*)">[^<]*</a>'


@query(f"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '{LINK}', 1)) AS href FROM pages), s AS (SELECT DISTINCT page_id, href, 4 + len(href) % 7 + CASE WHEN {matches('href', '(?i)th')} THEN 2 ELSE 0 END AS score FROM l)
    SELECT page_id, href, score::INTEGER AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, href) AS rank FROM s WHERE score >= 7) WHERE rank <= 3""")
def listing_opportunities(spark, sf_dir):
    """The three best links of each page by score, of those that reach seven."""
    links = tables.table(spark, sf_dir, "pages", "page_id", "html").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), 1))).alias("href"))
    score = F.lit(4) + F.length("href") % 7 + F.when(F.col("href").rlike("(?i)th"), 2).otherwise(0)
    return keyed.top_per_key(links.withColumn("score", score).filter("score >= 7"), ["page_id"], [F.desc("score"), F.asc("href")], 3).select("page_id", "href", "score", "rank")


SUBMITTED_LINES = "'x.org/p' || (event_id % 40) || CASE WHEN event_id % 2 = 0 THEN '/' ELSE '' END || ' | Award ' || user_id || CASE WHEN event_id % 5 = 0 THEN ' |  note ' ELSE '' END"


@query(f"""WITH l AS (SELECT event_id, 'https://x.org/p' || (event_id % 40) AS url, 'Award ' || user_id AS award_name, CASE WHEN event_id % 5 = 0 THEN 'note' END AS notes FROM events WHERE event_id % 11 <> 0)
    SELECT url, arg_min(award_name, event_id) AS award_name, arg_min_null(notes, event_id) AS notes, min(event_id) AS event_id FROM l GROUP BY url""")
def first_submissions(spark, sf_dir):
    """Submitted lines, parsed, once for each url: the first wins. Blank lines go."""
    lines = tables.table(spark, sf_dir, "events", "event_id", "user_id").selectExpr("event_id", f"CASE WHEN event_id % 11 = 0 THEN ' | ' ELSE {SUBMITTED_LINES} END AS value")
    parsed = tables.submissions(lines, keep=["event_id"]).withColumn("url", U.intake(F.col("url")))
    first = parsed.groupBy("url").agg(F.min_by(F.struct("award_name", "notes", "event_id"), "event_id").alias("f"))
    return first.select("url", "f.award_name", "f.notes", "f.event_id")


ITEMS = "string_split(lower(o_orderpriority || '; ' || o_orderstatus || ' (' || (o_custkey % 3) || '); ' || o_orderpriority || '!; ' || o_orderstatus), '; ')"
KEYED = "trim(regexp_replace(regexp_replace(lower(x), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH i AS (SELECT o_orderkey, unnest(s) AS x, generate_subscripts(s, 1) AS k FROM (SELECT o_orderkey, {ITEMS} AS s FROM orders)), g AS (SELECT o_orderkey, {KEYED} AS key, min(k) AS k, arg_min(x, k) AS first, arg_max(x, (len(x), -k)) AS longest FROM i
    GROUP BY 1, 2) SELECT o_orderkey, string_agg(first, '|' ORDER BY k) AS first_wins, string_agg(longest, '|' ORDER BY k) AS longest_wins FROM g WHERE key <> '' GROUP BY 1""")
def semantic_items(spark, sf_dir):
    """Items of a list, once for each normal form: the first, and the longest."""
    rows = tables.table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_custkey")
    items = F.split(F.expr("lower(o_orderpriority || '; ' || o_orderstatus || ' (' || (o_custkey % 3) || '); ' || o_orderpriority || '!; ' || o_orderstatus)"), "; ")
    rows = rows.select("o_orderkey", items.alias("items"))
    return rows.select("o_orderkey", F.array_join(T.first_by_key(F.col("items"), T.name_key), "|").alias("first_wins"), F.array_join(T.longest_by_key(F.col("items"), T.name_key), "|").alias("longest_wins"))


@query("""WITH g AS (SELECT o_custkey, list(o_orderkey % 10) AS k, list(DISTINCT o_orderstatus) AS s FROM orders GROUP BY 1)
    SELECT o_custkey, list_has_any(k, [1, 3]) AS overlaps, len(k) = len(list_distinct(k)) AS unique_keys, len(k)::INTEGER AS n, coalesce(list_position(list_sort(s), 'P'), 0)::BIGINT AS at FROM g""")
def array_checks(spark, sf_dir):
    """Overlap, freedom from duplicates, size and place in the arrays of a customer's orders."""
    groups = tables.table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderstatus").groupBy("o_custkey").agg(
        F.collect_list(F.col("o_orderkey") % 10).alias("k"), F.collect_set("o_orderstatus").alias("s")
    )  # one customer's orders
    same = F.size("k") == F.size(F.array_distinct("k"))
    wanted = F.array(F.lit(1).cast("long"), F.lit(3).cast("long"))
    return groups.select("o_custkey", F.arrays_overlap("k", wanted).alias("overlaps"), same.alias("unique_keys"), F.size("k").alias("n"), F.array_position(F.array_sort("s"), "P").alias("at"))


SUBJECTS = ["deadline", "stipend", "transcript", "recommendation"]
CHANGE_TEXT = (
    "'the ' || " + cycle("event_id // 40", SUBJECTS) + " || ' ' || repeat(CASE WHEN event_id % 9 < 4 THEN 'alpha bravo charlie deltas echoes foxtrot golfing hotels indigo juliet kilos ' ELSE 'moving targets always change their places without much notice ' END, 1)"
    " || 'variant' || (event_id % 5) || CASE WHEN event_id % 13 = 0 THEN ' however different endings apply throughout several regions' ELSE '' END"
)


def change_rows(spark, sf_dir):
    """Changes made from events: scope (user and subject), order (ts, id), key, words and concepts."""
    rows = tables.table(spark, sf_dir, "events", "event_id", "user_id", "ts").selectExpr("event_id", "user_id", "ts", CHANGE_TEXT.replace("event_id // 40", "(event_id DIV 40)") + " AS text")
    concept = F.when(F.contains("text", F.lit("alpha")), F.array(F.lit("alphabet"))).otherwise(F.array().cast("array<string>"))
    return rows.select("event_id", "user_id", "ts", F.col("event_id").alias("n"), F.substring_index("text", " ", 2).alias("subject"), T.alnum_key(F.col("text")).alias("key"), near.change_words(F.col("text")).alias("words"), concept.alias("concepts"))


@query()
def near_duplicate_changes(spark, sf_dir):
    """Changes that tell something new within their user and subject; which stay depends on the order, so SQL can't say it."""
    found = near.without_near_duplicates(change_rows(spark, sf_dir).drop("event_id"), ["user_id", "subject"], ["ts", "n"], "key", "words", "concepts")
    return found.select(F.col("n").alias("event_id"), "user_id", "subject")


