"""Text: normal forms, keys, phrases, tokens, similarity. Patterns keep to what Java and RE2 share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names, their short forms, and kinds of dates and amounts.
MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
SHORT_MONTHS = ["jan", "feb", "mar", "apr", "jun", "jul", "aug", "sept", "sep", "oct", "nov", "dec"]
MONTHS = "|".join(MONTH_NAMES + SHORT_MONTHS)
DATE = rf"(?i)\b(?:(?:{MONTHS})\.? +[0-9]{{1,2}}(?:, *[0-9]{{4}})?|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})\b"
MONEY = r"\$ ?[0-9][0-9,]*(?:\.[0-9]{2})?"
RELATIVE_AGE = r"(?i)\b(?:[0-9]+ (?:second|minute|hour|day|week|month|year)s? ago|yesterday|today|just now)\b"


def collapse(c: Column) -> Column:
    """White space as single spaces, NUL dropped, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "\u0000", ""), "[ \\t\\n\\r\\f]+", " "))


def visible(c: Column) -> Column:
    """No-break spaces and line ends made plain, blanks collapsed, at most two line ends in a row."""
    plain = F.regexp_replace(F.regexp_replace(c, " ", " "), "\\r\\n?", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "[ \\t]+", " "), "\\n{3,}", "\n\n"))


def lookup_key(c: Column) -> Column:
    """Collapsed and lower-cased."""
    return F.lower(collapse(c))


def search_key(c: Column) -> Column:
    """Lower case, `&` spelled out, apostrophes dropped, all but a-z and 0-9 as spaces."""
    spelled = F.replace(F.lower(c), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(F.regexp_replace(spelled, "['’]", ""), "[^a-z0-9]+", " "))


def alnum_key(c: Column) -> Column:
    """Lower-cased letters and digits alone."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def slug(c: Column, default: str = "award") -> Column:
    """A url part; the default if nothing is left."""
    spelled = F.replace(F.lower(c), F.lit("&"), F.lit(" and "))
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(spelled, "[^a-z0-9]+", "-"), "^-|-$", ""), F.lit("")), F.lit(default))


def date_phrases(c: Column) -> Column:
    """Dates as written, in order."""
    return F.regexp_extract_all(c, F.lit(DATE), 0)


def money_phrases(c: Column) -> Column:
    """Dollar amounts as written, in order."""
    return F.regexp_extract_all(c, F.lit(MONEY), 0)


def without_relative_age(c: Column) -> Column:
    """Without `3 days ago`, `yesterday` and the like."""
    return collapse(F.regexp_replace(c, RELATIVE_AGE, ""))


def templated(c: Column) -> Column:
    """Urls, hashes, dates and numbers as tokens, so that texts of one pattern agree."""
    out = F.regexp_replace(F.lower(c), "https?://[^ ]+", "<url>")
    out = F.regexp_replace(out, "[0-9a-f]{32,64}", "<hash>")
    out = F.regexp_replace(out, "[0-9]{4}-[0-9]{2}-[0-9]{2}", "<date>")
    return F.regexp_replace(out, "[0-9]+", "<n>")


def sentences(c: Column) -> Column:
    """Sentences of 35 to 320 characters, split after `.`, `!` and `?`."""
    cut = F.split(F.regexp_replace(collapse(c), "([.!?]) +", "$1\n"), "\n")
    return F.filter(cut, lambda s: F.length(s).between(35, 320))


def tokens(c: Column, least: int = 1) -> Column:
    """Distinct words of the search key with at least so many characters."""
    return F.array_distinct(F.filter(F.split(search_key(c), " "), lambda w: F.length(w) >= least))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over those of the larger set; 0 if one is empty."""
    larger = F.greatest(F.size(a), F.size(b))
    return F.when(larger > 0, F.size(F.array_intersect(a, b)) / larger).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared tokens over all of both; 0 for two empty sets."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def cut_at_word(c: Column, most: int) -> Column:
    """At most so many characters, cut at the last space and marked by three dots."""
    head = F.substring(c, 1, most)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(head, " [^ ]*$", ""), F.lit("...")))


def http_status(c: Column) -> Column:
    """The status named in an error text, else null."""
    return F.nullif(F.regexp_extract(c, r"(?i)(?:http|status)[: ]+([1-5][0-9]{2})", 1), F.lit("")).cast("int")


def first_match(rules: list[tuple[str, str]], text: Column, otherwise: str) -> Column:
    """The name of the first rule (name, pattern) that the text matches."""
    out = F.lit(otherwise)
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


# Wrongly decoded characters and what they stand for, abbreviations whose dots end no sentence, words around dates.
MOJIBAKE = [("\u00e2\u20ac(?:\u2122|\u02dc)", "'"), ("\u00e2\u20ac\u0153|\u00e2\u20ac", '"'), ("\u00c2\u00a9", "(c)"), ("\u00c2\u00b7", "-"), ("\u00c2", "")]
ABBREVIATIONS = [("M", "D", ""), ("Ph", "D", "(?i)"), ("U", "S", ""), ("U", "K", ""), ("i", "e", "(?i)"), ("e", "g", "(?i)")]
DATE_WORDS = ["spring", "summer", "fall", "autumn", "winter", "early", "mid", "late", "end", "beginning", "start", "through", "to", "and", "or", "of", "the", "by", "on", "at"]
DATE_LABELS = ["deadline", "due", "opens", "open", "opening", "applications", "application", "date", "by", "on", "at"]


def display(c: Column) -> Column:
    """A text fit to show: wrong characters mended, words run together split, spaces around marks put right."""
    out = F.coalesce(c, F.lit(""))
    for wrong, right in MOJIBAKE:
        out = F.regexp_replace(out, wrong, right)
    for pattern, by in (
        ("([a-z])([A-Z])", "$1 $2"), ("([A-Za-z])([0-9])", "$1 $2"), ("([0-9])([A-Za-z])", "$1 $2"), ("([.!?])([A-Z0-9])", "$1 $2"), (r"(?i)\bArticle\s+[0-9]+\s+hours?\s+ago\s+[0-9]+\s+min\s+read\b", ""),
        (r"(?i)\b(?:Article\s+)?[0-9]+\s+min\s+read\b", ""), (r"\s*;\s*", "; "), (r"\s+([.,;:!?])", "$1"), (r"([.!?])\s*-\s*(The\b)", "$1 $2"),
    ):
        out = F.regexp_replace(out, pattern, by)
    for first, second, how in ABBREVIATIONS:
        out = F.regexp_replace(out, rf"{how}\b{first}\.\s*{second}\.", f"{first}.{second}.")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def name_key(c: Column) -> Column:
    """An award's name without brackets: words of a-z and 0-9."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), r"\([^)]*\)", " "), "[^a-z0-9]+", " "))


def whole_sentences(c: Column) -> Column:
    """Sentences of 35 to 320 characters: split after `.`, `!`, `?`, and after `:` before a capital or digit, but not within abbreviations."""
    kept = collapse(c)
    for first, second, how in ABBREVIATIONS:
        kept = F.regexp_replace(kept, rf"{how}\b({first})\. ?({second})\.", "$1\u0001$2\u0001")
    cut = F.split(F.regexp_replace(F.regexp_replace(kept, "([.!?]) +", "$1\n"), "(:) +([A-Z0-9])", "$1\n$2"), "\n")
    return F.filter(F.transform(cut, lambda s: F.replace(s, F.lit("\u0001"), F.lit("."))), lambda s: F.length(s).between(35, 320))


def amounts_in_context(c: Column, accepts, before: int = 180, after: int = 220) -> Column:
    """Different dollar amounts, in order, around which the text (lower case) is accepted: accepts(context) is a condition."""
    flat = collapse(c)
    found, parts = F.regexp_extract_all(flat, F.lit(MONEY), 0), F.split(flat, MONEY)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("all"))
    width = lambda k: F.length(F.element_at(found, k)) + F.length(F.element_at(parts, k))
    place = lambda acc, k: acc["at"] + F.length(F.element_at(parts, k))
    at = F.aggregate(F.sequence(F.lit(1), F.size(found)), start, lambda acc, k: F.struct((acc["at"] + width(k)).alias("at"), F.array_append(acc["all"], place(acc, k)).alias("all")))["all"]
    low = F.lower(flat)
    context = lambda p: F.substring(low, F.greatest(p - before, F.lit(0)).cast("int") + 1, (F.least(p, F.lit(before)) + after).cast("int"))
    pairs = F.filter(F.arrays_zip(found.alias("amount"), at.alias("at")), lambda z: accepts(context(z["at"])))
    return F.when(F.size(found) > 0, F.array_distinct(F.transform(pairs, lambda z: z["amount"]))).otherwise(F.array().cast("array<string>"))


def distinctive(c: Column, common: list[str], most: int = 14) -> Column:
    """Telling words of a name: four characters or an acronym, none of the common ones; at most so many."""
    acronyms = F.transform(F.regexp_extract_all(c, F.lit(r"\b[A-Z0-9]{2,}\b"), 0), F.lower)
    words = F.split(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+")
    return F.slice(F.array_distinct(F.filter(words, lambda w: ((F.length(w) >= 4) | F.array_contains(acronyms, w)) & ~w.isin(common))), 1, most)


def diverge(a: Column, b: Column) -> Column:
    """Whether two sets of tokens have little in common: by Jaccard and by how much of the smaller is covered."""
    smaller = F.least(F.size(a), F.size(b))
    covered = F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller).otherwise(F.lit(0.0))
    return (jaccard(a, b) < 0.16) & (covered < 0.28)


def bare_date(c: Column) -> Column:
    """Whether a text is nothing but a date."""
    low = F.regexp_replace(F.lower(collapse(c)), rf"\b(?:{MONTHS})\b", " ")
    low = F.regexp_replace(F.regexp_replace(low, rf"\b(?:{'|'.join(DATE_WORDS)})\b", " "), r"\b[0-9]{1,4}(?:st|nd|rd|th)?\b", " ")
    return (F.trim(F.regexp_replace(low, r"[,\-/().:\s]+", " ")) == "") & c.rlike("[0-9]")


def date_key(c: Column) -> Column:
    """The words of a date without labels and ordinals."""
    low = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), rf"\b(?:{'|'.join(DATE_LABELS)})\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"\b([0-9]{1,2})(?:st|nd|rd|th)\b", "$1"), "[^a-z0-9]+", " "))


def same_date(a: Column, b: Column) -> Column:
    """Whether one date's words are part of the other's."""
    x, y = date_key(a), date_key(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def important_dates(items: Column, deadline: Column, opening: Column) -> Column:
    """Items with words stay; bare dates get the label of the deadline or opening date that they equal, others go. Each once."""
    labelled = lambda v: (
        F.when(~bare_date(v), v).when(same_date(v, deadline), F.concat(F.lit("Application deadline: "), v)).when(same_date(v, opening), F.concat(F.lit("Applications open: "), v))
    )
    return F.array_distinct(F.filter(F.transform(F.filter(F.transform(items, collapse), lambda v: v != ""), labelled), lambda v: v.isNotNull()))


def labels(c: Column, rules: list[tuple[str, str]]) -> Column:
    """All labels whose pattern the text (lower case) matches, in the rules' order."""
    return F.array_compact(F.array(*[F.when(c.rlike(pattern), F.lit(name)) for name, pattern in rules]))


def first_by_key(items: Column, key) -> Column:
    """Items whose key no earlier one has; blank keys go. key(item) is a column."""
    keys = F.transform(items, key)
    return F.filter(items, lambda x, k: (key(x) != "") & (F.array_position(keys, key(x)) == k + 1))


def longest_by_key(items: Column, key) -> Column:
    """Of items with one key the longest, of equally long ones the first, where the first of them stood."""
    best = lambda x: F.array_max(F.transform(F.filter(items, lambda y: key(y) == key(x)), lambda y: F.length(y)))
    longest = lambda x: F.get(F.filter(items, lambda y: (key(y) == key(x)) & (F.length(y) == best(x))), F.lit(0))
    return F.transform(first_by_key(items, key), longest)


def fnv_hash(c: Column) -> Column:
    """Two 32-bit FNV-1a hashes of the text's UTF-16 units, low byte first, as 16 hexadecimal digits; for texts of U+0000 to U+FFFF."""
    codes = F.transform(F.filter(F.split(c, ""), lambda s: s != ""), lambda s: F.ascii(s).cast("long"))
    step = lambda h, b: (h.bitwiseXOR(b) * F.lit(0x01000193)).bitwiseAND(F.lit(0xFFFFFFFF))
    one = lambda seed: F.aggregate(codes, F.lit(seed).cast("long"), lambda h, u: step(step(h, u.bitwiseAND(F.lit(255))), F.shiftright(u, 8)))
    return F.concat(*[F.lpad(F.lower(F.hex(one(seed))), 8, "0") for seed in (0x811C9DC5, 0x9E3779B9)])


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA-256 of a text in hexadecimal digits, for keys of at most 64 bytes."""
    padded = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ x for b in padded)) for x in (0x36, 0x5C))
    digest = lambda b: F.unhex(F.sha2(b, 256))
    return F.sha2(F.concat(outer, digest(F.concat(inner, F.encode(message, "utf-8")))), 256)
