"""Captured pages: title, description, canonical address, text and links of HTML as it comes, by one pass over its tags."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from urllib.parse import unquote, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import urls as U

# Links and PDF links in a page's short lists, and characters of a description and of a link's title.
LINKS, PDF_LINKS, DESCRIPTION, LINK_TITLE = 80, 40, 500, 180
PDF = r"(?i)\.pdf(?:$|[?#])"
#: Elements whose content is no text.
HIDDEN = {"script", "style", "noscript", "template", "svg"}
#: Of these, those whose content is not markup either.
RAW = {"script", "style"}
#: Elements that end a paragraph which is still open.
BLOCKS = {"p", "div", "ul", "ol", "table", "section", "article", "main", "header", "footer", "nav", "aside", "form", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "hr"}
SPACE = re.compile(r"\s+")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?)?")
END_OF_TAG = re.compile(r"[\s/]*>")


def tags(page: str) -> Iterator[tuple[str, str | dict]]:
    """Tokens in order: ('text', text), ('open' + name, attributes) and ('close' + name, {}), names in small letters. Comments and declarations go; what is no tag is text.

    A tag, comment or quoted value that doesn't end takes the rest of the page with it. Each character is passed once.
    """
    at, n, lowered = 0, len(page), page.lower()
    while at < n:
        start = page.find("<", at)
        if start < 0:
            yield "text", page[at:]
            return
        if start > at:
            yield "text", page[at:start]
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        if page[start + 1 : start + 2] in ("!", "?"):
            end = page.find(">", start)
            at = n if end < 0 else end + 1
            continue
        closing = page[start + 1 : start + 2] == "/"
        name = NAME.match(page, start + 1 + closing)
        if not name:
            yield "text", "<"
            at = start + 1
            continue
        at, attributes, tag = name.end(), {}, name.group().lower()
        while not (end := END_OF_TAG.match(page, at)):
            found = ATTRIBUTE.match(page, at)
            if not found or found.end() >= n:
                return
            value = found.group(2) or ""
            quoted = value[:1] in "\"'" and value != ""
            if not quoted and page[found.end() : found.end() + 1] in ("'", '"') and found.group(0).rstrip().endswith("="):
                return  # a quoted value without an end
            attributes.setdefault(found.group(1).lower(), entities.unescape(value[1:-1] if quoted else value))
            at = found.end()
        at = end.end()
        yield ("close " if closing else "open ") + tag, attributes
        if tag in RAW and not closing:
            end_of_raw = lowered.find("</" + tag, at)
            at = n if end_of_raw < 0 else end_of_raw


def clean(parts: list[str]) -> str:
    """Text of its pieces, with white space as one space."""
    return SPACE.sub(" ", entities.unescape("".join(parts))).strip()


def title_of(url: str) -> str:
    """The last part of an address in words, its host if there is none."""
    try:
        parts = urlsplit(url)
        last = [p for p in parts.path.split("/") if p][-1:]
        return SPACE.sub(" ", re.sub(r"[-_]+", " ", unquote(last[0]))).strip() or (parts.hostname or "") if last else parts.hostname or "Source page"
    except ValueError:
        return "Source page"


def absolute(href: str | None, base: str) -> str:
    """The address that a link leads to, empty if it is none of http or https."""
    try:
        url = urljoin(base, (href or "").strip())
        return url if (href or "").strip() and urlsplit(url).scheme.lower() in ("http", "https") and urlsplit(url).hostname else ""
    except ValueError:
        return ""


def capture_of(page: str | None, url: str | None) -> dict:
    """title, description, canonical, text and links (url, title) of a page that was read at url. A null page is empty."""
    url, base = url or "", url or ""
    texts: dict[str, list[str]] = {k: [] for k in ("title", "h1", "p", "main", "article", "body")}
    done, depth, hidden, links, meta = set(), dict.fromkeys(texts, 0), 0, [], {}
    link: tuple[str, list[str]] | None = None
    based = False

    def end_link() -> None:
        nonlocal link
        if link and link[0]:
            links.append({"url": link[0], "title": clean(link[1])[:LINK_TITLE] or title_of(link[0])})
        link = None

    for kind, value in tags(page or ""):
        if kind == "text":
            if hidden:
                continue
            for k in ("title", "h1", "p", "main", "article"):
                if depth[k]:
                    texts[k].append(value)
            if not depth["title"]:
                texts["body"].append(value)
            if link:
                link[1].append(value)
            continue
        opens, tag = kind.startswith("open"), kind.split(" ", 1)[1]
        if tag in HIDDEN:
            hidden = max(0, hidden + (1 if opens else -1))
        if hidden:
            continue
        if tag in BLOCKS and depth["p"] and (opens or tag != "p"):
            depth["p"], done = 0, done | {"p"}
        if tag in ("title", "h1", "p"):  # the first one counts
            if opens and tag not in done:
                depth[tag] = 1
            elif not opens and depth[tag]:
                depth[tag], done = 0, done | {tag}
        elif tag in ("main", "article"):
            depth[tag] = max(0, depth[tag] + (1 if opens else -1))
        elif tag == "a":
            end_link()
            if opens and "href" in value:
                link = absolute(value["href"], base), []
        elif tag == "base" and opens and not based and value.get("href"):
            base, based = absolute(value["href"], url) or base, True
        elif tag == "meta" and opens and value.get("name") == "description":
            meta.setdefault("description", value.get("content", ""))
        elif tag == "link" and opens and "canonical" in value.get("rel", "").split():
            meta.setdefault("canonical", value.get("href", ""))
    end_link()
    return {
        "title": clean(texts["title"]) or clean(texts["h1"]) or title_of(url),
        "description": (SPACE.sub(" ", meta.get("description", "")).strip() or clean(texts["p"]))[:DESCRIPTION],
        "canonical": absolute(meta.get("canonical"), base) or url,
        "text": clean(texts["main"]) or clean(texts["article"]) or clean(texts["body"]),
        "links": links,
    }


CAPTURE = "title string, description string, canonical string, text string, links array<struct<url:string,title:string>>"


def captures(pages: DataFrame, key: str, html: str = "html", url: str = "url") -> DataFrame:
    """key, the fields of capture_of for every whole page, and in place of its links the first of each address, in the page's order.

    all_links (url, title, pdf) holds every one of them; links and pdf_links (url, title) are short lists, so many of all_links at most. key is unique.
    Addresses are compared by their canonical key.
    """
    kind = pages.schema[key].dataType.simpleString()
    struct = pa.struct([("url", pa.string()), ("title", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [capture_of(a.as_py(), b.as_py()) for a, b in zip(batch.column(1), batch.column(2))]
            fields = [pa.array([f[n] for f in found], pa.string()) for n in ("title", "description", "canonical", "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *fields, pa.array([f["links"] for f in found], pa.list_(struct))], names=[key, "title", "description", "canonical", "text", "links"])

    rows = pages.select(key, F.col(html).cast("string"), F.col(url).cast("string")).mapInArrow(run, f"`{key}` {kind}, {CAPTURE}")
    fields = lambda x: [x["url"].alias("url"), x["title"].alias("title")]
    keyed = F.transform("links", lambda x, k: F.struct(U.canonical_key(x["url"]).alias("key"), k.alias("at"), *fields(x), x["url"].rlike(PDF).alias("pdf")))
    first = F.filter("links", lambda x, k: (k == 0) | (F.get("links", k - 1)["key"] != x["key"]))  # equal keys lie together, in the page's order
    placed = F.array_sort(F.transform(first, lambda x: F.struct(x["at"].alias("at"), *fields(x), x["pdf"].alias("pdf"))))
    rows = rows.withColumn("links", F.array_sort(keyed)).withColumn("all_links", F.transform(placed, lambda x: F.struct(*fields(x), x["pdf"].alias("pdf"))))
    short = lambda pdf, most: F.slice(F.transform(F.filter("all_links", lambda x: x["pdf"] == F.lit(pdf)), lambda x: F.struct(*fields(x))), 1, most)
    return rows.withColumns({"pdf_links": short(True, PDF_LINKS), "links": short(False, LINKS)})
