"""The thin queries opN_ on sf0.001 against brute force: columns, splits, thresholds, ties."""

from __future__ import annotations

import base64
import hashlib
import zlib
from html.parser import HTMLParser

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from tests.llm.test_text_ops import components, naive_fingerprint
from tests.llm.test_vector_and_page_ops import brute_verdicts
from tests.oracle import connect, difference
from tidemark.llm.queries import ORACLE_SQL, QUERIES, RULES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def coder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def rows(spark, name):
    return QUERIES[name](spark, DATA)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees_with_sql(spark, name):
    assert not difference(rows(spark, name).toArrow(), connect(DATA).execute(ORACLE_SQL[name]).to_arrow_table())


def test_tokens(spark, docs, coder):
    want = {k: coder.encode_ordinary(r.text or "") for k, r in docs.items()}
    counted = rows(spark, "op1_token_counts")
    assert {r.doc_id: r.n_tokens for r in counted.collect()} == {k: len(v) for k, v in want.items()}
    coded = rows(spark, "op4_byte_bpe")
    assert dict(coded.dtypes) == {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    for r in coded.collect():
        raw = np.array(want[r.doc_id], dtype="<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want[r.doc_id]), hashlib.sha256(raw).hexdigest(), hashlib.sha256((docs[r.doc_id].text or "").encode()).hexdigest())


def test_nearest(spark):
    vectors = {r.vec_id: np.array(r.embedding, dtype=float) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect() if r.embedding}
    out = rows(spark, "op2_nearest_neighbours")
    assert dict(out.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    found: dict = {}
    for r in out.collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    cosine = lambda a, b: float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)))
    hit = 0
    assert sorted(found) == [k for k in sorted(vectors) if k % 50 == 0]
    for q, got in found.items():
        best = sorted((-cosine(vectors[q], v), k) for k, v in vectors.items() if k != q)[:5]
        hit += len({k for _, k in best} & {k for _, k, _ in got})
        assert sorted(got) == got and len(got) == 5 and all(abs(s - cosine(vectors[q], vectors[k])) < 1e-12 for _, k, s in got)
    assert hit >= 0.9 * 5 * len(found)


def test_toxicity_split(spark, docs):
    out = rows(spark, "op5_toxicity").collect()
    assert {r.doc_id for r in out} == set(docs) and len(out) == len(docs)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_mixing(spark, docs):
    out = {r.doc_id: r for r in rows(spark, "op7_mix_sources").collect()}
    sizes: dict = {}
    for k, r in docs.items():
        n = len((r.text or "").encode().split())  # ASCII white space but for \\x1c-\\x1f
        assert out[k].size == n and out[k].taken in (0, n, 2 * n)
        sizes[r.source] = sizes.get(r.source, 0) + n
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left = {}, set(names)
    while left:
        level = (1.5 * sum(sizes.values()) - sum(target.values())) / sum(weight[s] for s in left)
        full = {s for s in left if level * weight[s] >= 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in full} if full else {s: level * weight[s] for s in left}
        left = left - full if full else set()
    for s in names:
        mine = [out[k] for k, r in docs.items() if r.source == s]
        assert all(r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= max(max(r.size for r in mine), 0.02 * target[s])


def test_simhash(spark, docs):
    ids = sorted(docs)
    fps = [naive_fingerprint(docs[k].text, 3) for k in ids]
    near = {a for a in set(fps) for b in set(fps) if a != b and bin(a ^ b).count("1") <= 3}
    some = sorted({f for f in fps if f in near or fps.count(f) > 1})  # others are alone
    label = dict(zip(some, components(some, 3)))
    first: dict = {}
    for k, f in zip(ids, fps):
        first.setdefault(label.get(f, ("alone", f)), k)
    out = {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, "op8_simhash_dedup").collect()}
    assert out == {k: (f"{f:016x}", first[label.get(f, ("alone", f))]) for k, f in zip(ids, fps)}


class PlainArticle(HTMLParser):
    """Blocks of articles by another way: what lies in an article and not in a part that is named after something else."""

    BLOCKS = set("p h1 h2 h3 h4 h5 h6 li ul ol div article section table tr td th blockquote pre br hr main".split())
    APART = set("script style nav aside form footer header".split())

    def __init__(self):
        super().__init__()
        self.blocks, self.held, self.open, self.articles, self.apart = [], [], [], 0, 0

    def end_block(self):
        text, self.held = " ".join("".join(self.held).split()), []
        self.blocks += [text] if text else []

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self.end_block()
        if tag not in ("br", "hr", "img", "meta", "link", "input"):
            self.open.append((tag, tag in self.APART or "ad" in (dict(attrs).get("class") or "").split()))
            self.apart += self.open[-1][1]
            self.articles += tag == "article"

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.end_block()
        at = max((k for k, (t, _) in enumerate(self.open) if t == tag), default=len(self.open))
        for t, apart in self.open[at:]:
            self.apart -= apart
            self.articles -= t == "article"
        del self.open[at:]

    def handle_data(self, data):
        if self.articles and not self.apart:
            self.held.append(data)


def article_of(page):
    parser = PlainArticle()
    parser.feed(page or "")
    parser.close()
    parser.end_block()
    return "\n".join(parser.blocks)


def test_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    main = rows(spark, "op9_main_text")
    assert main.columns == ["page_id", "url", "text", "n_chars"]
    got = {r.page_id: r for r in main.collect()}
    assert {k: (r.url, r.text, r.n_chars) for k, r in got.items()} == {k: (r.url, text, len(text)) for k, r in pages.items() for text in [article_of(r.html)]}
    verdicts = brute_verdicts([tuple(r) for r in spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html").collect()], RULES)
    for r in rows(spark, "op10_url_filters").collect():
        rest = (pages[r.page_id].url or "").partition("://")[2]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(rule), rule, v) for v, rule in RULES for h, p in [rule.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        best = max(fits, default=(0, None, verdicts[r.page_id]))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[1], best[2])
