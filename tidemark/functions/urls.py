"""URLs: hosts, canonical keys, templates, shards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that don't tell pages apart.
TRACKING = ["fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "share", "replytocom"]
PRESENTATION = ["lang", "locale", "view", "campaign", "sort"]


def host(url: Column) -> Column:
    """The lower-cased host without `www.`, user, or port; null without a scheme."""
    found = F.regexp_extract(F.lower(url), "^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(found, "^www\\.", ""), F.lit(""))


def path(url: Column) -> Column:
    """The path, empty if there is none."""
    return F.regexp_extract(url, "^[^:/?#]+://[^/?#]*([^?#]*)", 1)


def query_string(url: Column) -> Column:
    """What stands between `?` and `#`, empty if nothing does."""
    return F.regexp_extract(url, "^[^?#]*\\?([^#]*)", 1)


def kept_parameters(url: Column) -> Column:
    """Parameters that tell pages apart, lower-cased and sorted."""
    name = lambda p: F.regexp_extract(p, "^([^=]*)", 1)
    empty = lambda p: ~p.rlike("^[^=]*=.")
    return F.array_sort(
        F.filter(
            F.split(F.lower(query_string(url)), "&"),
            lambda p: (name(p) != "")
            & ~name(p).startswith("utm_")
            & ~name(p).isin(TRACKING + PRESENTATION)
            & ~((name(p) == "page") & (empty(p) | p.endswith("=1") & (F.length(p) == 6)))
            & ~((name(p) == "s") & empty(p)),
        )
    )


def canonical_key(url: Column) -> Column:
    """Equal for urls of one page: no scheme, `www.`, index files, `.aspx`, end slashes or telling-nothing parameters; lower case."""
    place = F.regexp_replace(F.lower(path(url)), "/index\\.(?:html?|php|aspx?)$", "/")
    place = F.regexp_replace(F.regexp_replace(place, "\\.aspx$", ""), "/+$", "")
    place = F.when(place == "", F.lit("/")).otherwise(place)
    kept = kept_parameters(url)
    search = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.coalesce(F.concat(host(url), place, search), F.regexp_replace(F.lower(F.trim(url)), "/+$", ""))


def preference(url: Column) -> Column:
    """Which of several urls of a page to show: https before http, those without parameters first."""
    scheme = F.when(F.lower(url).startswith("https:"), 2).otherwise(1)
    return scheme + F.when(query_string(url) == "", 20).otherwise(-20)


def template(url: Column) -> Column:
    """Host and path with numbers and long hexadecimal ids as tokens."""
    place = F.regexp_replace(F.lower(path(url)), "/[0-9a-f]{8,}", "/:id")
    return F.concat(F.coalesce(host(url), F.lit("")), F.regexp_replace(place, "/[0-9]+", "/:n"))


def shard(name: Column, n: int) -> Column:
    """One of n shards by the first 12 hexadecimal digits of SHA-256."""
    return F.pmod(F.conv(F.substring(F.sha2(name, 256), 1, 12), 16, 10).cast("long"), F.lit(n)).cast("int")


def repeats_segment(url: Column, times: int = 3, least: int = 4) -> Column:
    """Whether a path segment of at least so many characters occurs so often: the path runs in circles."""
    parts = F.filter(F.split(F.lower(path(url)), "/"), lambda p: F.length(p) >= least)
    return F.exists(parts, lambda p: F.size(F.filter(parts, lambda q: p == q)) >= times)


# Path segments that name nothing, words written in capitals.
PLAIN_SEGMENTS = r"(?i)^(page|pages|resources?|view|programs?|awards?|scholarships?|fellowships?|grants?|index\.(html?|php|aspx?))$"
CAPITALS = ["faq", "faqs", "pdf", "nsf", "grfp", "usa", "us", "uk", "phd", "nasa", "rd"]


def readable(url: Column) -> Column:
    """A title from the last telling segment of a url's path; Homepage without one."""
    segments = F.filter(F.split(path(url), "/"), lambda p: (F.length(p) > 1) & ~p.rlike(PLAIN_SEGMENTS))
    last = F.regexp_replace(F.coalesce(F.get(segments, F.size(segments) - 1), F.lit("")), r"(?i)\.(html?|php|aspx?|pdf)$", "")
    words = F.filter(F.split(F.regexp_replace(F.regexp_replace(last, "([a-z])([A-Z])", "$1 $2"), "[-_]+", " "), " "), lambda w: w != "")
    titled = F.transform(words, lambda w: F.when(F.lower(w).isin(CAPITALS), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 10_000))))
    return F.when(last == "", "Homepage").otherwise(F.array_join(titled, " "))


def intake(c: Column) -> Column:
    """A submitted url made plain: https if it names no scheme, no fragment or tracking, sorted parameters, single slashes, none at the end; null if it isn't http."""
    raw = F.trim(c)
    whole = F.when(raw.rlike("(?i)^[a-z][a-z0-9+.-]*:"), raw).otherwise(F.concat(F.lit("https://"), raw))
    place = F.regexp_replace(F.regexp_replace(path(whole), "/{2,}", "/"), "/+$", "")
    name = lambda p: F.lower(F.regexp_extract(p, "^([^=]*)", 1))
    kept = F.array_sort(F.filter(F.split(query_string(whole), "&"), lambda p: (p != "") & ~name(p).startswith("utm_") & ~name(p).isin(TRACKING)))
    where = F.lower(F.regexp_extract(whole, "(?i)^(https?://[^/?#]+)", 1))
    out = F.concat(where, F.when(place == "", "/").otherwise(place), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))
    return F.when(where != "", out)


def text_fragment(url: Column, text: Column) -> Column:
    """A link to a passage of a page; null for pdf files and other schemes than http."""
    plain = F.regexp_replace(url, "#.*$", "")
    coded = F.replace(F.url_encode(F.trim(text)), F.lit("+"), F.lit("%20"))
    return F.when(url.rlike("(?i)^https?://") & ~F.lower(path(url)).endswith(".pdf") & (F.trim(text) != ""), F.concat(plain, F.lit("#:~:text="), coded))
