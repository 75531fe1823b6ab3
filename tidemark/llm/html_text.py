"""Main text of web pages: site templates found by counting subtrees in Spark, then the page's own structure.

Each page is parsed once, in time linear in its length. Every block element's subtree is hashed from its tag,
attributes, texts and the hashes of its children, before any rule by tag or class is applied. Spark counts on how many
different pages of a host each hash occurs, and the blocks of subtrees that recur on many are deleted. Structure
decides the rest: what stands outside the article, and elements that are furniture by tag, role or class.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linkgraph import with_host_and_path
from .shared import materialize, shared_dir

#: A subtree is a template if it stands on this many different pages of its host at least, and on this share of them or on MANY_PAGES.
MIN_PAGES, MIN_SHARE, MANY_PAGES = 4, 0.2, 50
#: Share that paragraphs, headings and the like inside an article need instead, whatever their number: short ones and quotations recur by themselves.
MIN_SHARE_INSIDE = 0.5

# HTML element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul legend caption option".split()
)
CLOSES_P = BLOCK - frozenset("head html body li dd dt tr tbody thead tfoot option summary caption legend figcaption".split())
CLOSES_SELF = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr",), "option": ("option",), "p": ("p",)}
SCOPE = "ul ol dl menu table select article section div body html td th".split()
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr tbody figcaption".split())
FURNITURE = frozenset(
    "nav footer aside form script style noscript template iframe svg canvas button select dialog menu head title textarea object audio video fieldset".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words of class and id that name furniture.
NAMES = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr "
    "notice notices notification alert newsletter subscribe subscription signup sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer "
    "comment comments reply replies disqus respond share sharing social related recommended recommendations popup modal overlay "
    "pagination pager login masthead topbar toolbar widget widgets skip paywall".split()
)
#: Such words that count only outside the article.
OUTER_NAMES = frozenset(["header", "head", "branding"])

MARK = re.compile(r"<(?=[a-zA-Z!?/])")
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
REST = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
TELLING = re.compile(r"class|id|role|style|hidden", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def furniture(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is furniture by itself; inside: it stands in an article."""
    if tag in FURNITURE or tag == "header" and not inside:
        return True
    if not attributes or not TELLING.search(attributes):
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), entities.unescape(value.strip("\"'")).lower()
        if name == "hidden" and value != "until-found" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            return True
        if name == "style" and HIDDEN.search(value):
            return True
        if name in ("class", "id"):
            for part in value.split():
                words = re.split(r"[-_]+", part)
                if words[0] in ("no", "has", "with", "without", "is"):
                    continue
                if any(w in NAMES or w in OUTER_NAMES and not inside for w in (words[0], words[-1])):
                    return True
    return False


@dataclass
class Tree:
    """A parsed page: elements in page order with parent, hash and whether they are furniture or stand in an article, and runs of text."""

    tags: list[str] = field(default_factory=lambda: ["#root"])
    parents: list[int] = field(default_factory=lambda: [-1])
    hashes: list[int] = field(default_factory=lambda: [0])
    own: list[bool] = field(default_factory=lambda: [False])
    core: list[bool] = field(default_factory=lambda: [False])
    runs: list[tuple[int, str, int]] = field(default_factory=list)  # element, text, number of its block


def parse(page: str) -> Tree:
    """The elements and texts of a page, in one pass without walks over open elements.

    A tag that isn't closed before the page ends hides the rest of it; after the first tag whose quotes don't close, tags end at their first `>`.
    """
    tree = Tree()
    tags, parents, runs = tree.tags, tree.parents, tree.runs
    stack, hashers = [0], [xxhash.xxh64()]
    open_at: defaultdict[str, list[int]] = defaultdict(list)  # places in the stack, by tag
    number, position, size, loose = 0, 0, len(page), False

    def close(upto: int) -> None:
        nonlocal number
        while len(stack) > upto:
            node, hasher = stack.pop(), hashers.pop()
            open_at[tags[node]].pop()
            tree.hashes[node] = hasher.intdigest() - 2**63
            hashers[-1].update(hasher.digest())
            number += tags[node] in BLOCK

    def text_of(where: int, text: str) -> None:
        runs.append((where, text, number))
        hashers[-1].update(" ".join(text.split()).encode("utf-8", "replace"))

    while position <= size:
        found = MARK.search(page, position)
        start = found.start() if found else size
        if start > position:
            text_of(stack[-1], page[position:start])
        if not found:
            break
        named = NAME.match(page, start)
        if not named:
            mark = "-->" if page.startswith("<!--", start) else ">"
            end = page.find(mark, start + len(mark) + 1 if mark == "-->" else start)
            position = end + len(mark) if end >= 0 else size
            continue
        rest = None if loose else REST.match(page, named.end())
        if rest:
            attributes, position = rest.group(1), rest.end()
        else:
            loose = True
            end = page.find(">", named.end())
            if end < 0:
                break
            attributes, position = page[named.end() : end], end + 1
        tag = named.group(2).lower()
        if named.group(1):
            if open_at[tag]:
                close(open_at[tag][-1])
            else:
                number += tag == "p"
            continue
        if tag in CLOSES_P and open_at["p"]:
            close(open_at["p"][-1])
        if tag in CLOSES_SELF:
            last = max((open_at[t][-1] for t in CLOSES_SELF[tag] if open_at[t]), default=0)
            if last > max((open_at[t][-1] for t in SCOPE if open_at[t]), default=0):
                close(last)
        if tag in VOID:
            number += tag == "hr"
            hashers[-1].update(tag.encode("utf-8", "replace"))
            if tag == "br":
                text_of(stack[-1], " ")
            continue
        if tag in ("td", "th"):
            text_of(stack[-1], " ")
        node, inside = len(tags), tree.core[stack[-1]]
        tags.append(tag)
        parents.append(stack[-1])
        tree.hashes.append(0)
        tree.own.append(furniture(tag, attributes, inside))
        tree.core.append(inside or tag in ("article", "main"))
        hasher = xxhash.xxh64(f"<{tag} {' '.join(attributes.split())}>".encode("utf-8", "replace"))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, position)
            hasher.update(page[position : end.start() if end else size].encode("utf-8", "replace"))
            position = end.end() if end else size
        if tag in RAW or attributes.endswith("/") and tag in ("svg", "path"):
            tree.hashes[node] = hasher.intdigest() - 2**63
            hashers[-1].update(hasher.digest())
            continue
        number += tag in BLOCK
        open_at[tag].append(len(stack))
        stack.append(node)
        hashers.append(hasher)
    close(1)
    return tree


def upwards(tree: Tree, marks: list[bool]) -> list[bool]:
    """Marks passed on to all elements around those marked."""
    for node in range(len(marks) - 1, 0, -1):
        if marks[node]:
            marks[tree.parents[node]] = True
    return marks


def blocks_of(page: str | None) -> tuple[list[str], list[tuple[int, int, int, bool]]]:
    """The blocks of a page's main part by its structure, in page order, and the subtrees that may be templates.

    A subtree is its hash, its first block, the one after its last, and whether it is a text element inside the article. Block elements
    with text are listed, furniture too, but for html, body, article, main and what an article stands in.
    """
    tree = parse(page or "")
    tags, parents, n = tree.tags, tree.parents, len(tree.tags)
    holds = upwards(tree, [tags[k] in ("article", "main") and not tree.own[k] for k in range(n)])  # itself, or an article stands in it
    removed = [False] * n
    for k in range(1, n):
        around = holds[k] and tags[k] not in ("article", "main")
        removed[k] = removed[parents[k]] or tree.own[k] and not around and tags[k] not in ("html", "body")
    worded, kept = [False] * n, [False] * n
    for node, text, _ in tree.runs:
        if not text.isspace():
            worded[node] = True
            kept[node] = kept[node] or not removed[node]
    worded, kept = upwards(tree, worded), upwards(tree, kept)
    wanted = next((t for t in ("article", "main") if any(tags[k] == t and kept[k] and not removed[k] for k in range(1, n))), None)
    region = [wanted is None] * n
    for k in range(1, n):
        region[k] = region[k] or region[parents[k]] or tags[k] == wanted

    blocks: list[str] = []
    first, last, end = [n] * n, [0] * n, None
    held: list[str] = []
    for node, text, number in [*tree.runs, (-1, "", -1)]:
        if held and number != end:
            words = entities.unescape("".join(held)).split()
            if words:
                first[head], last[head] = min(first[head], len(blocks)), len(blocks) + 1
                blocks.append(" ".join(words))
            held = []
        if node >= 0 and not removed[node] and region[node]:
            if not held:
                head, end = node, number
            held.append(text)
    for k in range(n - 1, 0, -1):
        up = parents[k]
        first[up], last[up] = min(first[up], first[k]), max(last[up], last[k])
    subtrees = [
        (tree.hashes[k], first[k] if last[k] else 0, last[k], wanted is not None and region[k] and tags[k] in TEXT)
        for k in range(1, n)
        if worded[k] and not holds[k] and tags[k] in BLOCK and tags[k] not in ("html", "body", "head", "article", "main")
    ]
    return blocks, subtrees


def main_text(
    pages: DataFrame, html: str = "html", url: str = "url",
    min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many_pages: int = MANY_PAGES, min_share_inside: float = MIN_SHARE_INSIDE,
) -> DataFrame:
    """Adds text and n_chars (code points) to pages, in place of columns of these names and of html.

    text joins the main blocks of the page by newlines, white space inside a block being one space;
    it is empty for null or empty html and for pages without main text. A subtree is a template of its host if it recurs on
    min_pages different pages (by main text, so that mirrored articles count once) and on min_share of the host's or on many_pages; text elements
    inside an article need min_share_inside. Pages without a host lose no templates. Repeated rows are pages of their own but count once as contents.
    """
    others = [f for f in pages.schema.fields if f.name not in ("text", "n_chars", html)]
    read = [F.col(f"`{url}`").cast("string").alias("__url"), F.col(f"`{html}`").cast("string").alias("__html")]
    host = with_host_and_path(pages.select(*read, *[F.col(f"`{f.name}`").alias(f"o_{f.name}") for f in others]), "__url")
    host = host.select("__html", "host", *[f"`o_{f.name}`" for f in others])
    schema = ", ".join(
        ["host string", "blocks array<string>", "subtrees array<struct<hash:bigint,first:int,last:int,inside:boolean>>", "body bigint"]
        + [f"`o_{f.name}` {f.dataType.simpleString()}" for f in others]
    )
    kind = pa.struct([("hash", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("inside", pa.bool_())])

    def parsed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, cuts, flat, bodies = [], [0], [], []
            for page in batch.column(0):
                texts, subtrees = blocks_of(page.as_py())
                blocks.append(texts)
                flat += subtrees
                cuts.append(len(flat))
                bodies.append(xxhash.xxh64_intdigest("\n".join(texts).encode("utf-8", "replace")) - 2**63)
            columns = list(zip(*flat)) or [[], [], [], []]
            structs = pa.StructArray.from_arrays([pa.array(c, kind[k].type) for k, c in enumerate(columns)], fields=list(kind))
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), structs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(blocks, pa.list_(pa.string())), lists, pa.array(bodies, pa.int64()), *batch.columns[2:]],
                names=["host", "blocks", "subtrees", "body", *[f"o_{f.name}" for f in others]],
            )

    spark = pages.sparkSession
    path = shared_dir(spark, "parsed-pages")
    host.mapInArrow(parsed_batches, schema).withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    parsed = spark.read.parquet(path)
    sited = parsed.filter("host != ''")
    templates = materialize(templates_of(sited, min_pages, min_share, many_pages, min_share_inside), "templates")
    rows = sited.select("row", "host", F.explode(F.filter("subtrees", lambda s: s["last"] > 0)).alias("s"))
    rows = rows.select("row", "host", F.col("s.hash").alias("subtree"), F.col("s.inside").alias("inside"), F.struct("s.first", "s.last").alias("blocks"))
    deleted = rows.join(templates, ["host", "subtree", "inside"]).groupBy(F.col("row").alias("of")).agg(F.collect_list("blocks").alias("deleted"))
    deleted = materialize(deleted, "deleted-subtrees")
    joined = parsed.join(deleted, F.col("row") == F.col("of"), "left")
    whole = lambda k: ~F.exists("deleted", lambda d: (d["first"] <= k) & (k < d["last"]))
    kept = F.when(F.col("deleted").isNull(), F.col("blocks")).otherwise(F.filter("blocks", lambda b, k: whole(k)))
    text = F.array_join(kept, "\n")
    return joined.withColumn("text", text).select(*[F.col(f"`o_{f.name}`").alias(f.name) for f in others], "text", F.length("text").cast("long").alias("n_chars"))


def templates_of(parsed: DataFrame, min_pages: int, min_share: float, many_pages: int, min_share_inside: float) -> DataFrame:
    """host, subtree and inside of the templates among parsed(host, subtrees, body); bodies that differ are different pages."""
    occurring = parsed.select("host", "body", F.explode("subtrees").alias("s")).select("host", "body", F.col("s.hash").alias("subtree"), F.col("s.inside").alias("inside"))
    once = occurring.groupBy("host", "subtree", "inside", "body").agg(F.lit(1).alias("one"))
    often = once.groupBy("host", "subtree", "inside").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)
    bodies = parsed.groupBy("host", "body").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("bodies"))
    share = F.col("pages") / F.col("bodies")
    recurs = F.when(F.col("inside"), share >= min_share_inside).otherwise((share >= min_share) | (F.col("pages") >= many_pages))
    return often.join(bodies, "host").filter(recurs).select("host", "subtree", "inside")
