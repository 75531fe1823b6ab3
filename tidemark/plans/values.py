"""Queries that apply column functions: texts, names, dates, urls, JSON documents and hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import documents as D
from tidemark.functions import patterns as P
from tidemark.functions import text as T
from tidemark.functions import times
from tidemark.functions import urls as U
from tidemark.operators import changes
from tidemark.sources import tables

from .gates import cycle, listed, matches, path_sql, quoted
from .registry import query
from .web import COLLAPSED


def chain(c: str, steps: list[tuple[str, str]]) -> str:
    """SQL text of replacements, one after the other."""
    for pattern, by in steps:
        c = f"regexp_replace({c}, {quoted(pattern)}, {quoted(by)}, 'g')"
    return c


def collapsed(c: str) -> str:
    return f"trim(regexp_replace(replace({c}, chr(0), ''), '[ \\t\\n\\r\\f]+', ' ', 'g'))"


DISPLAY = chain("coalesce(text, '')", [
    *T.MOJIBAKE, ("([a-z])([A-Z])", r"\1 \2"), ("([A-Za-z])([0-9])", r"\1 \2"), ("([0-9])([A-Za-z])", r"\1 \2"), ("([.!?])([A-Z0-9])", r"\1 \2"),
    (r"(?i)\bArticle\s+[0-9]+\s+hours?\s+ago\s+[0-9]+\s+min\s+read\b", ""), (r"(?i)\b(?:Article\s+)?[0-9]+\s+min\s+read\b", ""), (r"\s*;\s*", "; "), (r"\s+([.,;:!?])", r"\1"),
    (r"([.!?])\s*-\s*(The\b)", r"\1 \2"), (r"\bM\.\s*D\.", "M.D."), (r"(?i)\bPh\.\s*D\.", "Ph.D."), (r"\bU\.\s*S\.", "U.S."), (r"\bU\.\s*K\.", "U.K."), (r"(?i)\bi\.\s*e\.", "i.e."), (r"(?i)\be\.\s*g\.", "e.g."),
    (r"\s+", " "),
])


@query(f"SELECT doc_id, sha256(trim({DISPLAY})) AS shown, len(trim({DISPLAY}))::INTEGER AS n FROM documents")
def display_text(spark, sf_dir):
    shown = T.display(F.col("text"))
    return tables.table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.sha2(shown, 256).alias("shown"), F.length(shown).alias("n"))


@query(f"""SELECT doc_id, sha256(trim({chain('text', [(chr(0xA0), ' '), (chr(13) + chr(10) + '?', chr(10)), ('[ ' + chr(9) + ']+', ' '), (chr(10) + '{3,}', chr(10) * 2)])}, ' ')) AS visible,
    sha256(lower({collapsed('text')})) AS lookup, sha256(trim({chain("replace(lower(text), '&', ' and ')", [(r'\([^)]*\)', ' '), ('[^a-z0-9]+', ' ')])})) AS name FROM documents""")
def text_keys(spark, sf_dir):
    text = F.col("text")
    keys = {"visible": T.visible(text), "lookup": T.lookup_key(text), "name": T.name_key(text)}
    return tables.table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", *[F.sha2(k, 256).alias(n) for n, k in keys.items()])


ABBREVIATED = chain(COLLAPSED, [(r"\b(M)\. ?(D)\.", "\\1\x01\\2\x01"), (r"(?i)\b(Ph)\. ?(D)\.", "\\1\x01\\2\x01"), (r"\b(U)\. ?(S)\.", "\\1\x01\\2\x01"), (r"\b(U)\. ?(K)\.", "\\1\x01\\2\x01"),
                                (r"(?i)\b(i)\. ?(e)\.", "\\1\x01\\2\x01"), (r"(?i)\b(e)\. ?(g)\.", "\\1\x01\\2\x01"), ("([.!?]) +", "\\1\n"), ("(:) +([A-Z0-9])", "\\1\n\\2")])


@query(f"""SELECT doc_id, len(s)::INTEGER AS sentences, sha256(array_to_string(s, '|')) AS digest FROM (
    SELECT doc_id, [x for x in [replace(y, chr(1), '.') for y in string_split({ABBREVIATED}, chr(10))] if len(x) BETWEEN 35 AND 320] AS s FROM documents)""")
def sentence_split(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.whole_sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").alias("sentences"), F.sha2(F.array_join("s", "|"), 256).alias("digest"))


AWARD_TEXTS = [
    "The stipend is $5,000 for research", "Buy tickets for $20 at the shop", "Award amount: $1,250.50 and a travel grant of $300", "No amounts here", "Prize money $ 7,000; see our store: $9 shirts cost little",
    "HTTP 404 since 3 days ago", "status: 503, updated just now", "Yesterday the page said $12", "graduate students of biology", "U.S. citizens and permanent residents in medicine",
]
NOTES = f"(SELECT event_id, user_id, {cycle('event_id', AWARD_TEXTS)} || ' (' || event_id || ')' AS note FROM events)"


def notes(spark, sf_dir):
    return tables.table(spark, sf_dir, "events", "event_id", "user_id").selectExpr("event_id", "user_id", cycle("event_id", AWARD_TEXTS) + " || ' (' || event_id || ')' AS note")


@query(f"""SELECT event_id, CASE WHEN len(note) <= 24 THEN note ELSE regexp_replace(note[1:24], ' [^ ]*$', '') || '...' END AS cut,
    try_cast(nullif(regexp_extract(note, '(?i)(?:http|status)[: ]+([1-5][0-9]{{2}})', 1), '') AS INTEGER) AS status,
    trim(regexp_replace(regexp_replace(note, {quoted(T.RELATIVE_AGE)}, '', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g')) AS ageless FROM {NOTES}""")
def cut_status_age(spark, sf_dir):
    note = F.col("note")
    return notes(spark, sf_dir).select("event_id", T.cut_at_word(note, 24).alias("cut"), T.http_status(note).alias("status"), T.without_relative_age(note).alias("ageless"))


@query(f"""WITH n AS (SELECT event_id, lower({collapsed('note')}) AS low, {collapsed('note')} AS flat FROM {NOTES}),
    m AS (SELECT event_id, low, unnest(regexp_extract_all(flat, {quoted(T.MONEY)})) AS amount, generate_subscripts(regexp_extract_all(flat, {quoted(T.MONEY)}), 1) AS k, string_split_regex(flat, {quoted(T.MONEY)}) AS parts,
      regexp_extract_all(flat, {quoted(T.MONEY)}) AS found FROM n),
    p AS (SELECT event_id, amount, k, low, len(array_to_string(parts[1:k], '')) + len(array_to_string(found[1:k - 1], '')) AS place FROM m),
    c AS (SELECT event_id, amount, k, low[greatest(place - 180, 0) + 1:place + 220] AS context FROM p),
    g AS (SELECT event_id, amount, min(k) AS k FROM c WHERE {matches('context', P.FUNDING)} AND NOT {matches('context', P.SHOPPING)} GROUP BY 1, 2)
    SELECT n.event_id, coalesce(string_agg(amount, '; ' ORDER BY k), '') AS amounts FROM n LEFT JOIN g ON g.event_id = n.event_id GROUP BY 1""")
def funding_amounts(spark, sf_dir):
    accepts = lambda context: context.rlike(P.FUNDING) & ~context.rlike(P.SHOPPING)
    return notes(spark, sf_dir).select("event_id", F.array_join(T.amounts_in_context(F.col("note"), accepts), "; ").alias("amounts"))


def labels_sql(rules: list[tuple[str, str]]) -> str:
    return "array_to_string([x for x in [" + ", ".join(f"CASE WHEN {matches('lower(note)', p)} THEN {quoted(n)} END" for n, p in rules) + "] if x IS NOT NULL], ', ')"


@query(f"SELECT event_id, {labels_sql(P.LEVELS)} AS levels, {labels_sql(P.DISCIPLINES)} AS disciplines, {labels_sql(P.CITIZENSHIP)} AS citizenship FROM {NOTES}")
def facet_inference(spark, sf_dir):
    low = F.lower("note")
    facets = {"levels": P.LEVELS, "disciplines": P.DISCIPLINES, "citizenship": P.CITIZENSHIP}
    return notes(spark, sf_dir).select("event_id", *[F.array_join(T.labels(low, rules), ", ").alias(n) for n, rules in facets.items()])


COMMON = ["widget", "gadget", "part"]


def words_sql(c: str) -> str:
    return f"list_filter(string_split_regex(replace(lower({c}), '&', ' and '), '[^a-z0-9]+'), lambda w: w NOT IN {listed(COMMON)} AND (len(w) >= 4 OR list_contains([lower(a) for a in regexp_extract_all({c}, '\\b[A-Z0-9]{{2,}}\\b')], w)))"


@query(f"""WITH t AS (SELECT p_partkey, p_name || ' NS' || (p_size % 4) || ' X of ' || p_type AS title FROM part), w AS (SELECT p_partkey, {words_sql('title')} AS w FROM t)
    SELECT p_partkey, array_to_string([x for x, k in w if list_position(w, x) = k][1:14], ' ') AS words FROM w""")
def distinctive_words(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size", "p_type").selectExpr("p_partkey", "p_name || ' NS' || (p_size % 4) || ' X of ' || p_type AS title")
    return rows.select("p_partkey", F.array_join(T.distinctive(F.col("title"), COMMON), " ").alias("words"))


@query("""WITH t AS (SELECT o_orderkey, list_distinct(string_split(lower(o_orderpriority || ' ' || o_orderstatus), ' ')) AS a, list_distinct(string_split(lower(strftime(o_orderdate, '%Y %m') || ' ' || o_orderstatus), ' ')) AS b FROM orders)
    SELECT o_orderkey, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) < 0.16 AND len(list_intersect(a, b)) / least(len(a), len(b)) < 0.28 AS diverges FROM t""")
def token_divergence(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate")
    words = lambda *c: F.array_distinct(F.split(F.lower(F.concat_ws(" ", *c)), " "))
    return rows.select("o_orderkey", T.diverge(words("o_orderpriority", "o_orderstatus"), words(F.date_format("o_orderdate", "yyyy MM"), "o_orderstatus")).alias("diverges"))


WRITTEN = """CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%-m/%-d/%Y') WHEN 2 THEN strftime(o_orderdate, '%B %-d, %Y') WHEN 3 THEN strftime(o_orderdate, '%b %-d, %Y')
    WHEN 4 THEN strftime(o_orderdate, '%-d %B %Y') WHEN 5 THEN 'by the end of ' || strftime(o_orderdate, '%B') || ' 2nd' ELSE 'essay due in ' || strftime(o_orderdate, '%B %Y') END"""


def written():
    """Order dates as people write them."""
    forms = ["yyyy-MM-dd", "M/d/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy"]
    out = F.concat(F.lit("essay due in "), F.date_format("o_orderdate", "MMMM yyyy"))
    for k, form in enumerate(forms):
        out = F.when(F.col("o_orderkey") % 7 == k, F.date_format("o_orderdate", form)).otherwise(out)
    return F.when(F.col("o_orderkey") % 7 == 5, F.concat(F.lit("by the end of "), F.date_format("o_orderdate", "MMMM"), F.lit(" 2nd"))).otherwise(out)


BARE = chain("lower(w)", [(rf"\b(?:{T.MONTHS})\b", " "), (rf"\b(?:{'|'.join(T.DATE_WORDS)})\b", " "), (r"\b[0-9]{1,4}(?:st|nd|rd|th)?\b", " "), (r"[,\-/().:\s]+", " ")])
PARSED = "coalesce(" + ", ".join(f"try_strptime(w, '{f}')" for f in ("%Y-%m-%d", "%m/%d/%Y", "%B %d, %Y", "%b %d, %Y", "%d %B %Y")) + ")::DATE"


@query(f"""SELECT o_orderkey, {PARSED} AS day, trim({BARE}) = '' AND regexp_matches(w, '[0-9]') AS bare, CASE o_orderkey % 3 WHEN 0 THEN CASE WHEN {PARSED} < DATE '1996-06-01' THEN 'deadline_passed'
      WHEN {PARSED} IS NOT NULL THEN 'upcoming' ELSE 'unknown' END WHEN 1 THEN 'deadline_passed' ELSE 'rolling' END AS cycle FROM (SELECT o_orderkey, {WRITTEN} AS w FROM orders)""")
def date_reading(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").withColumn("w", written())
    state = F.when(F.col("o_orderkey") % 3 == 1, "Closed").when(F.col("o_orderkey") % 3 == 2, "rolling")
    return rows.select(
        "o_orderkey", times.lenient_date(F.col("w")).alias("day"), T.bare_date(F.col("w")).alias("bare"), times.cycle_status(state, F.col("w"), F.to_date(F.lit("1996-06-01"))).alias("cycle")
    )


@query(f"""WITH d AS (SELECT o_orderkey, strftime(o_orderdate, '%B %-d, %Y') AS deadline, {WRITTEN} AS w FROM orders)
    SELECT o_orderkey, array_to_string(list_distinct([x for x in [CASE WHEN o_orderkey % 7 = 6 THEN w WHEN o_orderkey % 7 IN (2, 3, 5) AND contains(lower(replace(deadline, ',', '')), trim({chain('lower(w)', [(rf"\b(?:{'|'.join(T.DATE_LABELS)})\b", ' '),
      (r'\b([0-9]{1,2})(?:st|nd|rd|th)\b', r'\1'), ('[^a-z0-9]+', ' ')])})) THEN 'Application deadline: ' || w END] if x IS NOT NULL]), '; ') AS dates FROM d""")
def date_labels(spark, sf_dir):
    """Dates beside an order's deadline: bare ones are labelled if they are the deadline, else dropped."""
    rows = tables.table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").withColumn("deadline", F.date_format("o_orderdate", "MMMM d, yyyy"))
    found = T.important_dates(F.array(written(), written(), F.lit(" ")), F.col("deadline"), F.lit(None).cast("string"))
    return rows.select("o_orderkey", F.array_join(found, "; ").alias("dates"))


@query("""WITH h AS (SELECT event_id, ts, greatest(0, round(date_diff('microsecond', ts, TIMESTAMP '2024-01-30 12:00:00') / 3600000000.0))::INTEGER AS h FROM events)
    SELECT event_id, CASE WHEN h < 1 THEN 'Just now' WHEN h < 24 THEN h || 'h ago' WHEN round(h / 24.0) <= 14 THEN round(h / 24.0)::INTEGER || 'd ago' ELSE strftime(timezone('America/Chicago', ts AT TIME ZONE 'UTC'), '%b %-d') END AS label FROM h""")
def relative_labels(spark, sf_dir):
    at = F.col("ts").cast("timestamp")
    now = F.expr("TIMESTAMP '2024-01-30 12:00:00'")
    return tables.table(spark, sf_dir, "events", "event_id", "ts").select("event_id", times.relative_label(at, now).alias("label"))


READABLE = chain(f"coalesce([p for p in string_split({path_sql('url')}, '/') if len(p) > 1 AND NOT {matches('p', U.PLAIN_SEGMENTS)}][-1], '')", [(r"(?i)\.(html?|php|aspx?|pdf)$", "")])


@query(f"""SELECT page_id, CASE WHEN last = '' THEN 'Homepage' ELSE array_to_string([CASE WHEN lower(w) IN {listed(U.CAPITALS)} THEN upper(w) ELSE upper(w[1]) || w[2:] END for w in string_split(
    {chain('last', [('([a-z])([A-Z])', chr(92) + '1 ' + chr(92) + '2'), ('[-_]+', ' ')])}, ' ') if w <> ''], ' ') END AS title FROM (SELECT page_id, {READABLE} AS last FROM pages)""")
def readable_titles(spark, sf_dir):
    return tables.table(spark, sf_dir, "pages", "page_id", "url").select("page_id", U.readable(F.col("url")).alias("title"))


SUBMITTED = ["  Example.ORG//a///b/?b=2&utm_x=1&a=1#top ", "http://x.org", "ftp://x.org/a", "https://x.org/?gclid=1", "mailto:me@x.org", "x.org/a/?c"]


@query(f"""WITH s AS (SELECT page_id, {cycle('page_id', SUBMITTED, 'url', 9)} AS raw, url FROM pages), w AS (SELECT page_id, CASE WHEN regexp_matches(trim(raw), '(?i)^[a-z][a-z0-9+.-]*:') THEN trim(raw) ELSE 'https://' || trim(raw) END AS u FROM s),
    p AS (SELECT page_id, lower(regexp_extract(u, '(?i)^(https?://[^/?#]+)', 1)) AS start, {chain(path_sql('u'), [('/{2,}', '/'), ('/+$', '')])} AS place, list_sort([q for q in string_split(regexp_extract(u, '^[^?#]*\\?([^#]*)', 1), '&')
      if q <> '' AND NOT starts_with(lower(q), 'utm_') AND lower(regexp_extract(q, '^([^=]*)', 1)) NOT IN {listed(U.TRACKING)}]) AS kept FROM w)
    SELECT page_id, CASE WHEN start <> '' THEN start || CASE WHEN place = '' THEN '/' ELSE place END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS intake FROM p""")
def intake_urls(spark, sf_dir):
    return tables.table(spark, sf_dir, "pages", "page_id", "url").selectExpr("page_id", cycle("page_id", SUBMITTED, "url", 9) + " AS raw").select("page_id", U.intake(F.col("raw")).alias("intake"))


@query(f"""SELECT page_id, CASE WHEN NOT ends_with(lower({path_sql('url')}), '.pdf') THEN regexp_replace(url, '#.*$', '') || '#:~:text=' || url_encode('great award ' || page_id || ' & more') END AS link,
    coalesce(len(list_filter([p for p in string_split(lower({path_sql("url || '/aaaa/b/aaaa/' || CASE page_id % 2 WHEN 0 THEN 'AAAA' ELSE 'x' END")}), '/') if len(p) >= 4], lambda p: p = 'aaaa')), 0) >= 3 AS circular FROM pages""")
def fragment_links(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "pages", "page_id", "url")
    text = F.expr("'great award ' || page_id || ' & more'")
    longer = F.expr("url || '/aaaa/b/aaaa/' || CASE page_id % 2 WHEN 0 THEN 'AAAA' ELSE 'x' END")
    return rows.select("page_id", U.text_fragment(F.col("url"), text).alias("link"), U.repeats_segment(longer).alias("circular"))


@query("""SELECT p_partkey, printf('%08x', list_reduce([2166136261::BIGINT] || [ord(x)::BIGINT for x in string_split(p_name, '')], lambda h, u: (((xor(h, u) * 16777619) & 4294967295) * 16777619) & 4294967295))
    || printf('%08x', list_reduce([2654435769::BIGINT] || [ord(x)::BIGINT for x in string_split(p_name, '')], lambda h, u: (((xor(h, u) * 16777619) & 4294967295) * 16777619) & 4294967295)) AS hash FROM part""")
def policy_hash(spark, sf_dir):
    return tables.table(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", T.fnv_hash(F.col("p_name")).alias("hash"))


KEY = b"signing key"
INNER, OUTER = ("".join(f"{b ^ x:02X}" for b in KEY.ljust(64, b"\0")) for x in (0x36, 0x5C))


@query(f"SELECT c_custkey, sha256(unhex('{OUTER}') || unhex(sha256(unhex('{INNER}') || encode(c_name)))) AS token FROM customer")
def signed_tokens(spark, sf_dir):
    return tables.table(spark, sf_dir, "customer", "c_custkey", "c_name").select("c_custkey", T.hmac_sha256(KEY, F.col("c_name")).alias("token"))


@query("""WITH p AS (SELECT p_partkey, p_name AS a, lag(p_name) OVER (ORDER BY p_partkey) AS b FROM part), s AS (SELECT *, (SELECT max(k) FROM range(0, least(len(a), len(b)) + 1) r(k) WHERE a[1:k] = b[1:k]) AS n FROM p WHERE b IS NOT NULL),
    e AS (SELECT *, (SELECT max(k) FROM range(0, least(len(a), len(b)) - n + 1) r(k) WHERE right(a, k) = right(b, k)) AS m FROM s)
    SELECT p_partkey, n::INTEGER AS common, b[n + 1:len(b) - m] AS old, a[n + 1:len(a) - m] AS new FROM e""")
def changed_excerpt(spark, sf_dir):
    """What differs between the names of a part and of the one before, which are joined by number."""
    rows = tables.table(spark, sf_dir, "part", "p_partkey", "p_name")
    before = rows.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_name").alias("was"))
    return rows.join(before, "p_partkey").select("p_partkey", D.excerpt("was", "p_name").alias("e")).select("p_partkey", "e.*")


DOCUMENTS = ['{"b":1,"a":"x"}', "[1,\"two\"]", '"alone"', "no json {", "3.5", "true", "null", '["p","q"]', '{"a":{"z":[1],"user_id":4,"k":null},"url":"u","f":false}', ""]
DOC = cycle("event_id", DOCUMENTS)
OBJECT = f"(try_cast({DOC} AS JSON) IS NOT NULL AND json_type(try_cast({DOC} AS JSON)) = 'OBJECT')"


def json_rows(spark, sf_dir):
    return tables.table(spark, sf_dir, "events", "event_id", "props").selectExpr("event_id", "props", f"{DOC} AS doc")


@query(f"""SELECT event_id, CASE json_type(try_cast({DOC} AS JSON)) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE
    CASE WHEN try_cast({DOC} AS JSON) IS NOT NULL THEN 'number' END END AS kind, {OBJECT} AS is_object, CASE WHEN json_type(try_cast({DOC} AS JSON)) = 'OBJECT' THEN
    CASE json_type(try_cast({DOC} AS JSON), '$.a') WHEN 'VARCHAR' THEN 'string' WHEN 'OBJECT' THEN 'object' END END AS kind_a FROM events""")
def json_kinds(spark, sf_dir):
    doc = F.col("doc")
    return json_rows(spark, sf_dir).select("event_id", D.kind(doc).alias("kind"), D.parsed_object(doc).isNotNull().alias("is_object"), D.kind(doc, "$.a").alias("kind_a"))


@query(f"""SELECT event_id, item FROM (SELECT event_id, unnest(CASE json_type(try_cast({DOC} AS JSON)) WHEN 'ARRAY' THEN json_extract_string({DOC}, '$[*]') WHEN 'VARCHAR' THEN [json_extract_string({DOC}, '$')] ELSE [] END) AS item FROM
    (SELECT * FROM events WHERE event_id % 10 IN (0, 1, 2, 3, 7)))""")
def json_text_items(spark, sf_dir):
    rows = json_rows(spark, sf_dir).filter(F.col("event_id") % 10 < 4).union(json_rows(spark, sf_dir).filter(F.col("event_id") % 10 == 7))
    return rows.select("event_id", F.explode(D.items(F.col("doc"))).alias("item"))


@query("""SELECT event_id, k.key AS name, json_extract_string(props, '$.' || k.key) AS value FROM (SELECT event_id, props, unnest([{'key': x} for x in json_keys(props)]) AS k FROM events)""")
def json_entries(spark, sf_dir):
    rows = json_rows(spark, sf_dir).select("event_id", F.explode(D.entries(F.col("props"))).alias("e"))
    return rows.select("event_id", F.col("e.key").alias("name"), F.col("e.value").alias("value"))


@query("""SELECT event_id, '{"a":"x",' || CASE WHEN event_id % 3 = 0 THEN '' ELSE '"k":' || (props ->> '$.k') || ',' END || '"z":' || event_id || '}' AS doc FROM events""")
def json_merge(spark, sf_dir):
    more = F.expr("CASE WHEN event_id % 3 = 0 THEN '{\"z\":' || event_id || ',\"k\":null,\"a\":\"x\"}' ELSE '{\"z\":' || event_id || ',\"a\":\"x\"}' END")
    return json_rows(spark, sf_dir).select("event_id", D.merged(F.expr("'{\"k\":' || get_json_object(props, '$.k') || '}'"), more).alias("doc"))


CANONICAL = ['{"a":"x","b":1}', '[1,"two"]', '"alone"', None, "3.5", "true", "null", '["p","q"]', '{"a":{"k":null,"user_id":4,"z":[1]},"f":false,"url":"u"}', None]
SHAPES = ['{"a":"string","b":"number"}', "{}", "{}", None, "{}", "{}", "{}", "{}", '{"a":{"k":"null","z":"array"},"f":"boolean"}', None]


@query(f"SELECT event_id, {cycle('event_id', CANONICAL)} AS canonical, {cycle('event_id', SHAPES)} AS shape, sha256(coalesce({cycle('event_id', CANONICAL)}, '')) AS signature FROM events")
def json_canonical(spark, sf_dir):
    rows = json_rows(spark, sf_dir).select("event_id", D.canonical("doc").alias("canonical"), D.shape("doc").alias("shape"))
    return rows.withColumn("signature", F.sha2(F.coalesce("canonical", F.lit("")), 256))


PRICES = {"small": (0.1, 0.4), "large": (1.25, 10.0)}


@query("""SELECT conv_id, round(sum((octet_length(encode(coalesce(text, ''))) + 3) // 4 * CASE WHEN role = 'assistant' THEN out ELSE into_ END) / 1000000, 9) AS cost FROM conversations JOIN (SELECT 0 AS m, 0.1 AS into_, 0.4 AS out UNION ALL SELECT 1, 1.25, 10.0)
    ON m = conv_id % 2 GROUP BY conv_id""")
def cost_estimate(spark, sf_dir):
    """Dollars a conversation costs: tokens, four bytes each, by a table of prices a million that is broadcast for its two rows."""
    rows = tables.table(spark, sf_dir, "conversations", "conv_id", "role", "text")
    prices = spark.createDataFrame([(k, *p) for k, p in enumerate(PRICES.values())], "m long, into_ double, out double")
    tokens = F.floor((F.coalesce(F.octet_length("text"), F.lit(0)) + 3) / 4)
    priced = rows.join(F.broadcast(prices), F.col("conv_id") % 2 == F.col("m"))
    cost = F.sum(tokens * F.when(F.col("role") == "assistant", F.col("out")).otherwise(F.col("into_"))) / 1_000_000
    return priced.groupBy("conv_id").agg(F.round(cost, 9).alias("cost"))


REASONS = ["invalid_ai_json:x", "manual_recovery_required_possible_external_batch_created", "  ", "Some Odd: reason", None, "latest_reconciliation_failed", "page_audit_retry_limit_reached"]
CASES = f"(SELECT event_id, {cycle('event_id', ['visual_review', 'page_audit'])} AS category, {cycle('event_id', REASONS)} AS reason, {cycle('event_id', ['protected', 'delayed', 'blocked', 'unknown', 'none'])} AS impact FROM events)"


@query(f"""SELECT event_id, CASE WHEN category = 'visual_review' AND reason LIKE 'invalid_ai_json:%' THEN 'invalid_ai_json' WHEN category = 'visual_review' AND reason = 'manual_recovery_required_possible_external_batch_created' THEN 'possible_external_batch'
      WHEN trim(coalesce(reason, '')) <> '' THEN trim(regexp_replace(lower(reason), '[^a-z0-9]+', '_', 'g'), '_') WHEN category = 'visual_review' THEN 'visual_review_terminal_failure' ELSE 'unknown_evidence_failure' END AS failure,
    CASE WHEN impact = 'protected' THEN 'last_known_good_protection' WHEN category = 'visual_review' AND impact = 'delayed' THEN 'changed_page_publication_hold' WHEN impact = 'blocked' THEN 'unsafe_publication_blocked'
      WHEN impact = 'unknown' THEN 'public_impact_verification' WHEN impact = 'none' THEN 'evidence_retention_only' ELSE 'operator_policy_review' END AS policy,
    CASE WHEN category = 'visual_review' THEN CASE WHEN reason = 'manual_recovery_required_possible_external_batch_created' THEN 'reconcile_existing_paid_batch' WHEN reason LIKE 'invalid_ai_json:%' THEN 'inspect_invalid_visual_review_result'
      ELSE 'inspect_visual_evidence_before_paid_retry' END WHEN reason = 'latest_reconciliation_failed' THEN 'repair_award_then_reconcile' WHEN reason = 'page_audit_retry_limit_reached' THEN 'repair_page_evidence_then_audit'
      ELSE 'inspect_evidence_then_repair_one_case' END AS repair FROM {CASES}""")
def quarantine_codes(spark, sf_dir):
    columns = CASES[len("(SELECT ") : -len(" FROM events)")]
    rows = tables.table(spark, sf_dir, "events", "event_id").selectExpr("event_id", *_split_columns(columns)[1:])
    visual, reason, impact = F.col("category") == "visual_review", F.lower(F.coalesce("reason", F.lit(""))), F.col("impact")
    external, invalid = reason == "manual_recovery_required_possible_external_batch_created", reason.startswith("invalid_ai_json:")
    key = F.nullif(F.regexp_replace(F.regexp_replace(F.trim(reason), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit(""))
    failure = F.when(visual & invalid, "invalid_ai_json").when(visual & external, "possible_external_batch").otherwise(
        F.coalesce(key, F.when(visual, "visual_review_terminal_failure").otherwise("unknown_evidence_failure"))
    )
    policy = changes.first_rule([
        ("last_known_good_protection", impact == "protected"), ("changed_page_publication_hold", visual & (impact == "delayed")), ("unsafe_publication_blocked", impact == "blocked"),
        ("public_impact_verification", impact == "unknown"), ("evidence_retention_only", impact == "none"),
    ], "operator_policy_review")
    repair = changes.first_rule([
        ("reconcile_existing_paid_batch", visual & external), ("inspect_invalid_visual_review_result", visual & invalid), ("inspect_visual_evidence_before_paid_retry", visual),
        ("repair_award_then_reconcile", reason == "latest_reconciliation_failed"), ("repair_page_evidence_then_audit", reason.isin("latest_page_audit_requires_review", "page_audit_retry_limit_reached")),
    ], "inspect_evidence_then_repair_one_case")
    return rows.select("event_id", failure.alias("failure"), policy.alias("policy"), repair.alias("repair"))


def _split_columns(columns: str) -> list[str]:
    """Column texts at their commas outside brackets and quotes; these have none inside."""
    return columns.replace(", CASE", "\x00CASE").split("\x00")


