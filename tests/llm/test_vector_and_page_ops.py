"""op2, op3, op6, op9 and op10 against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import struct
import time

import numpy as np
import pytest
import zstandard

from tidemark.llm.ann import chi_square_quantile, nearest
from tidemark.llm.components import component_roots
from tidemark.llm.html_text import blocks_of, main_text
from tidemark.llm.linkgraph import judge_urls, propagate
from tidemark.llm.queries import RULES
from tidemark.llm.topk import top_products
from tidemark.llm.warc import WarcError, frames_of, parse_record, warc_round_trip


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    rows = [(k, rng.standard_normal(16).tolist()) for k in range(900)]
    rows[11] = (11, rows[10][1])  # equal rows tie
    rows[12] = (12, rows[10][1])
    rows += [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [None] + [1.0] * 15), (1080, [float("inf")] * 16), (1100, [1.0] * 3), (None, [1.0] * 16), (1120, [])]
    return rows


def frame_of(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")


def test_nearest(spark, vectors):
    frame = frame_of(spark, vectors)
    out = nearest(frame, frame.filter("vec_id % 10 = 0"), k=5, cell=128).collect()
    good = {i: np.array(v) for i, v in vectors[:900]}
    ids = np.array(sorted(good))
    unit = np.stack([good[i] / np.linalg.norm(good[i]) for i in ids])
    hit = total = 0
    by: dict = {}
    for r in out:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(by) == [i for i in ids if i % 10 == 0]
    for q, found in by.items():
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        scores = unit @ unit[ids == q][0]
        scores[ids == q] = -9
        hit += len({f[1] for f in found} & set(ids[np.lexsort((ids, -scores))[:5]]))
        total += 5
        for _, i, s in found:
            assert abs(s - scores[ids == i][0]) < 1e-12
    assert hit / total >= 0.9
    assert [f[1] for f in by[10][:2]] == [11, 12]


def test_nearest_finds_all_of_parallel_rows(spark):
    rng = np.random.default_rng(12)
    rows = [((6 * g + k), (v * s).tolist()) for g, v in enumerate(rng.standard_normal((200, 16))) for k, s in enumerate(rng.uniform(0.1, 9, 6))]
    frame = frame_of(spark, rows)
    out = nearest(frame, frame, k=5, cell=256).collect()
    by: dict = {}
    for r in out:
        by.setdefault(r.query_id, set()).add(r.vec_id)
    assert by == {q: {6 * (q // 6) + k for k in range(6)} - {q} for q, _ in rows} and len(out) == 5 * len(rows)


def test_queries_in_slices_give_the_same(spark, vectors, monkeypatch):
    """A block meets so many queries at once that a task's memory depends on neither table; results don't change."""
    frame = frame_of(spark, vectors)
    asked = frame.filter("vec_id % 3 = 0")
    for search, more in ((nearest, {"cell": 128}), (top_products, {})):
        whole = sorted(map(tuple, search(frame, asked, k=5, **more).collect()))
        monkeypatch.setattr(f"{search.__module__}.QUERIES", 40)
        assert sorted(map(tuple, search(frame, asked, k=5, **more).collect())) == whole


def test_queries_of_another_common_length(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.standard_normal(3).tolist()) for k in range(1, 30)] + [(100, [1.0] * 5), (200, [2.0] * 5), (300, rng.standard_normal(3).tolist())]
    frame = frame_of(spark, rows)
    for search in (nearest, top_products):
        out = search(frame, frame.filter("vec_id % 100 = 0"), k=5).collect()
        assert {r.query_id for r in out} == {300} and len(out) == 5


def test_nearest_recall_on_many_rows(spark):
    rng = np.random.default_rng(30)
    centres = rng.standard_normal((300, 64))
    rows = centres[rng.integers(0, 300, 30_000)] + 0.4 * rng.standard_normal((30_000, 64))
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(rows.tolist())], "vec_id long, embedding array<double>")
    out = nearest(frame, frame.filter("vec_id % 100 = 0"), k=5).collect()
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    asked = np.arange(0, 30_000, 100)
    scores = unit[asked] @ unit.T
    scores[np.arange(300), asked] = -9
    best = np.argsort(-scores, axis=1)[:, :5]
    found = {(r.query_id, r.vec_id) for r in out}
    assert len(out) == 1500 and sum((q, v) in found for q, five in zip(asked.tolist(), best.tolist()) for v in five) >= 0.9 * 1500


def test_vector_searches_of_little(spark):
    none = frame_of(spark, [])
    one = frame_of(spark, [(0, [1.0, 2.0]), (0, [1.0, 3.0]), (None, None)])
    two = frame_of(spark, [(0, [1.0, 2.0]), (3, [2.0, 1.0])])
    for search in (nearest, top_products):
        assert search(none, none).count() == 0
        assert search(one, one.filter("vec_id = 0")).count() == 0
        assert [(r.query_id, r["rank"], r.vec_id) for r in search(two, two.filter("vec_id = 0")).collect()] == [(0, 1, 3)]


def test_chi_square_quantile():
    assert abs(chi_square_quantile(0.95, 2) - 5.991465) < 1e-5 and abs(chi_square_quantile(0.9, 8) - 13.361566) < 1e-5


def test_top_products(spark, vectors, monkeypatch):
    from tidemark.llm import topk

    monkeypatch.setattr(topk, "BLOCK", 100)
    frame = frame_of(spark, [*vectors, (77, [3.0] * 16)])
    rows = [(i, np.floor(64 * np.array(v)).astype(np.int64)) for i, v in [*vectors[:900], (1020, [0.0] * 16), (77, [3.0] * 16)]]
    want = []
    for q, v in [(i, v) for i, v in rows if i % 20 == 0]:
        best = sorted(((-int(v @ w), i) for i, w in rows if i != q))[:20]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in top_products(frame, frame.filter("vec_id % 20 = 0"), k=20, scale=64).collect()]
    assert sorted(got) == sorted(want)


def test_component_roots(spark):
    chain = [(k + 1, k) for k in range(40)] + [(5, 5), (101, 100), (101, 100), (102, 101)] + [(k, 200) for k in range(201, 260)]
    roots = {r.node: r.root for r in component_roots(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert roots == {k: 0 for k in range(1, 41)} | {101: 100, 102: 100} | {k: 200 for k in range(201, 260)}
    assert component_roots(spark.createDataFrame([], "a long, b long")).count() == 0


def test_warc_round_trip(spark):
    long = "<p>" + "payload " * 40
    rows = [(5, "http://a/é b", long), (3, None, long), (9, "u", long), (1, "x", None), (2, "x", ""), (4, "x", "short"), (6, "x", "short"), (3, "again", long), (None, "n", long)]
    rows += [(100 + k, f"http://h/{k}", f"<html>{k} " + "common words of a page " * 30) for k in range(40)] + [(7, "big", "é" * 900_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    out = warc_round_trip(pages, keep_payload=True).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.page_id in (None, 5, 9):
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", 3, None)
            assert r.payload_bytes == len(long) and r.payload_digest == hashlib.sha256(long.encode()).hexdigest()
        else:
            assert (r.record_type, r.refers_to) == ("response", None)
            assert hashlib.sha256(bytes(r.payload)).hexdigest() == r.payload_digest and r.payload_bytes == len(r.payload)
    assert {bytes(r.payload) for r in out if r.page_id in (1, 2)} == {b""}
    assert warc_round_trip(pages.limit(0)).count() == 0


def test_warc_of_any_page_id(spark):
    ids = ["None", "a>b", "line\r\nend", "é %41", "", None]
    pages = spark.createDataFrame([(i, "u", f"payload {k}") for k, i in enumerate(ids)], "page_id string, url string, html string")
    out = {r.payload_digest: r.page_id for r in warc_round_trip(pages).collect()}
    assert out == {hashlib.sha256(f"payload {k}".encode()).hexdigest(): i for k, i in enumerate(ids)}


def test_damaged_archives(tmp_path):
    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Date: x\r\nWARC-Payload-Digest: sha256:%b\r\nContent-Length: 26\r\n\r\nH\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    good = good % hashlib.sha256(b"ab").hexdigest().encode()
    assert parse_record(good)["payload"] == b"ab"
    for bad in (good.replace(b"Length: 26", b"Length: 27"), good.replace(b"ab\r\n\r\n", b"ac\r\n\r\n"), b"junk" + good, good.replace(b"WARC-Date: x\r\n", b"")):
        with pytest.raises(WarcError):
            parse_record(bad)
    frame = zstandard.ZstdCompressor().compress(good)
    head = struct.pack("<II", 0x184D2A5D, 0)
    for k, raw in enumerate((frame, head + frame[:-3], head[:5])):
        (tmp_path / f"{k}").write_bytes(raw)
        with pytest.raises(WarcError):
            list(frames_of(f"file://{tmp_path}/{k}"))
    (tmp_path / "good").write_bytes(head + frame + frame)
    assert len(list(frames_of(f"file://{tmp_path}/good"))) == 2


def text(page):
    return "\n".join(blocks_of(page)[0])


def test_main_blocks():
    assert text(None) == text("") == text("<html><body></body></html>") == ""
    page = "<html><head><title>T</title></head><body><nav>menu</nav><article><h1>A &amp; B</h1><p>one<br>two\n three<p>four <b>fi</b>ve</p></article><footer>f</footer></body>"
    assert text(page) == "A & B\none two three\nfour five"
    page = "<body><header>top</header><div id='content'><p>keep</p><div class='ad'>buy</div><script>if (a < b) x()</script><form><p>mail</p></form><aside>side</aside></div>"
    assert text(page) == "keep"
    assert text("<article><p>x</p><section class='comments'><p>first!</p></section><div class='cookie-notice'>ok</div></article>") == "x"
    assert text("<p>caf&eacute; &#233; &lt;b&gt;") == "café é <b>"


def test_main_text_deletes_site_templates(spark):
    repeated = "<div><p>Join our club today</p></div>"
    rows = [(k, f"http://a.example/{k}", f"<body>{repeated}<div><p>Own text {k}</p></div></body>", "x") for k in range(12)]
    rows += [(50, None, f"<body>{repeated}</body>", "x"), (51, "http://b.example/", None, None), (52, "http://b.example/x", "", "y"), (53, "http://c.example/", f"<body>{repeated}</body>", None)]
    rows += [(54, "http://d.example/", "<p>" + "long " * 50_000, None)]
    out = {r.page_id: r for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert len(out) == len(rows)
    for k in range(12):
        assert out[k].text == f"Own text {k}" and out[k].n_chars == len(out[k].text)
    assert out[50].text == out[53].text == "Join our club today" and out[51].text == out[52].text == ""
    assert out[54].n_chars == 5 * 50_000 - 1
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_templates_against_brute_force(spark):
    rng = np.random.default_rng(11)
    parts = [f"<div class='m{k}'><p>menu {k}</p></div>" for k in range(12)]
    rows = []
    for k in range(400):
        host = "hot.example" if k < 300 else f"h{k % 9}.example"
        chosen = [parts[j] for j in rng.choice(12, 3, replace=False, p=np.r_[[0.03] * 6, [0.82 / 6] * 6])]
        rows.append((k, f"http://{host}/{k}", f"<body>{chosen[0]}{chosen[1]}<p>own {k % 390}</p>{chosen[2]}</body>"))
    out = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), many_pages=20).collect()}
    bodies: dict = {}
    where: dict = {}
    for _, url, page in rows:
        host, blocks = url.split("/")[2], blocks_of(page)[0]
        bodies.setdefault(host, set()).add(tuple(blocks))
        for b in blocks:
            where.setdefault((host, b), set()).add(tuple(blocks))
    template = {hb for hb, pages in where.items() if len(pages) >= 4 and (len(pages) >= 0.2 * len(bodies[hb[0]]) or len(pages) >= 20)}
    assert any(h == "hot.example" and len(where[h, b]) < 0.2 * len(bodies[h]) for h, b in template)
    for k, url, page in rows:
        assert out[k] == "\n".join(b for b in blocks_of(page)[0] if (url.split("/")[2], b) not in template)


def test_templates_inside_articles(spark):
    notice = "<p>Follow us for more</p>"
    rows = [(k, f"http://a.example/{k}", f"<article><h1>T{k}</h1><p>Own {k}</p>{notice if k % 4 else ''}<p>Quoted.</p></article>" if k < 30 else f"<article><p>Other {k}</p></article>") for k in range(70)]
    rows += [(100 + k, "http://b.example/", f"<div class='x{k}'>a</div><article><p>Mirrored article</p></article>") for k in range(9)]
    out = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1] == "T1\nOwn 1\nFollow us for more\nQuoted."  # on under half of the host's pages
    assert {out[100 + k] for k in range(9)} == {"Mirrored article"}
    most = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows[:30], "page_id long, url string, html string")).collect()}
    assert most[1] == "T1\nOwn 1" and most[4] == "T4\nOwn 4"


def test_hostile_pages_take_linear_time():
    began = time.monotonic()
    for page in ("<!" * 500_000, "<div>" * 100_000 + "x", "<a " * 300_000, '<a "' * 200_000, "<p>x" * 100_000, "<ul><li>x" * 50_000, "</" * 500_000):
        blocks_of(page)
    assert time.monotonic() - began < 60
    assert text("<p>" * 3 + "a</p></p>b<!x") == "a\nb" and text("<p>x</p><p title='y>z</p><p>w</p>") == "x\nz\nw"


def test_url_rules(spark):
    cases = [
        ("HTTP://WWW.Example.com/en/1?x", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
        ("http://example.com", "example.com", "", None, "allow"),
        ("http://notexample.com/fr", "notexample.com", "/fr", "com/", "allow"),
        ("x://a.net/es/?q", "a.net", "/es/", "net/es/", "block"),
        ("x://a.net#/es/", "a.net", "", None, "block"),
        ("a.net/es/", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("://", "", "", None, "allow"),
        ("http://h.org?x/://y", "h.org", "", None, "allow"),
    ]
    rows = [(k, c[0], None, 1) for k, c in enumerate(cases)] + [(99, "x://a.net/es/2", "", 1)]
    out = {r.page_id: r for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string, host int"), RULES).collect()}
    for k, (_, *want) in enumerate(cases):
        assert [out[k].host, out[k].path, out[k].rule, out[k].verdict] == want
    assert judge_urls(spark.createDataFrame([], "page_id long, url string, html string"), RULES).count() == 0


def test_propagation_against_brute_force(spark):
    rng = np.random.default_rng(8)
    hosts = [f"h{k}" for k in range(25)]
    links = sorted({(str(a), str(b)) for a, b in rng.choice(hosts, (70, 2)) if a != b})
    seeds = [("h0", 1.0, 0.0), ("h1", 0.6, 0.4), ("h2", 0.0, 1.0), ("h3", 0.0, 0.0)]
    got = {r.host: (r.trust, r.distrust) for r in propagate(
        spark.createDataFrame(seeds, "host string, trust double, distrust double"), spark.createDataFrame(links, "src string, dst string"), rounds=80, tolerance=1e-9
    ).collect()}
    t, d = {h: 0.0 for h in hosts}, {h: 0.0 for h in hosts}
    seed = {h: (a, b) for h, a, b in seeds}
    out = {h: [b for a, b in links if a == h] for h in hosts}
    into = {h: [a for a, b in links if b == h] for h in hosts}
    for _ in range(200):
        t = {h: seed.get(h, (0, 0))[0] + 0.85 * sum(t[a] / len(out[a]) for a in into[h]) for h in hosts}
        d = {h: seed.get(h, (0, 0))[1] + 0.85 * sum(d[b] / len(into[b]) for b in out[h]) for h in hosts}
    for h in hosts:
        assert np.allclose(got.get(h, (0, 0)), (t[h], d[h]), atol=1e-6)


def brute_verdicts(pages, rules, threshold=0.1):
    """Verdicts of pages (id, url, html) by another way: links by a small parser, walks of every host counted out."""
    from html.parser import HTMLParser

    def parts(url):
        rest = (url or "").partition("://")[2]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        return rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]

    def fit(host, path):
        return max([(len(r), v) for v, r in rules for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)], default=(0, None))[1]

    class Links(HTMLParser):
        def handle_starttag(self, tag, attrs):
            self.found += [parts("x:" + v.partition(":")[2] if v.startswith("http") else "x:" + v)[0] for k, v in attrs if k == "href" and v and "//" in v]

    links, own = set(), {}
    for _, url, html in pages:
        host, path = parts(url)
        own.setdefault(host, []).append(fit(host, path))
        parser = Links()
        parser.found = []
        parser.feed(html or "")
        links |= {(host, d) for d in parser.found if host and d != host}
    share = lambda h, v: s if h and (s := sum(x == v for x in own.get(h, [])) / max(1, len(own.get(h, [])))) > 0.5 else 0.0
    hosts = {h for h in own if h} | {h for e in links for h in e}
    out = {h: [b for a, b in links if a == h] for h in hosts}
    into = {h: [a for a, b in links if b == h] for h in hosts}

    def rank(seed, takes, gives):
        value = dict.fromkeys(hosts, 0.0)
        for _ in range(400):
            value = {h: seed[h] + 0.85 * sum(value[x] / len(gives[x]) for x in takes[h]) for h in hosts}
        return value

    seeded = {h for h in hosts if share(h, "allow") or share(h, "block")}
    trust, distrust = rank({h: share(h, "allow") for h in hosts}, into, out), rank({h: share(h, "block") for h in hosts}, out, into)
    most_t = rank({h: float(h in seeded or not into[h]) for h in hosts}, into, out)
    most_d = rank({h: float(h in seeded or not out[h]) for h in hosts}, out, into)
    part = lambda a, b, h: a[h] / b[h] if b.get(h) else 0.0
    verdicts = {}
    for k, url, _ in pages:
        host, path = parts(url)
        bad = bool(host) and part(distrust, most_d, host) >= threshold and part(distrust, most_d, host) > part(trust, most_t, host)
        verdicts[k] = fit(host, path) or ("block" if bad else "allow")
    return verdicts


def test_verdicts_against_brute_force(spark):
    rng = np.random.default_rng(21)
    names = ["example.com/en", "www.example.com/en", "a.net/es", "b.net/fr", "c.net/it", *[f"h{k}.org/x" for k in range(30)]]
    pages = []
    for k in range(90):
        mine = names[rng.integers(0, len(names))] if k >= len(names) else names[k]
        to = [names[j] for j in rng.integers(0, len(names), rng.integers(0, 4))]
        pages.append((k, f"https://{mine}/{k}", "".join(f"<p><a class=x href='http://{t}/'>t</a>" for t in to)))
    out = {r.page_id: r.verdict for r in judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES).collect()}
    want = brute_verdicts(pages, RULES)
    assert out == want
    assert {v for k, v in want.items() if ".org" in pages[k][1]} == {"allow", "block"}


def test_linked_hosts_follow_blocked_ones(spark):
    link = '<a href="http://bad.net/es/1">x</a><a HREF=//other.org/>y</a>'
    rows = [(1, "http://bad.net/es/1", ""), (2, "http://farm.org/", link), (3, "http://clean.org/", '<a href="http://other.org/">y</a>')]
    out = {r.page_id: r.verdict for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()}
    assert out == {1: "block", 2: "block", 3: "allow"}


def test_distrust_does_not_thin_out_with_in_links(spark, monkeypatch):
    from tidemark.llm import linkgraph

    rows = [(0, "http://bad.net/es/1", "")] + [(k, f"http://farm{k}.org/", "<a href='http://bad.net/'>x</a>") for k in range(1, 31)]
    rows += [(40, "http://second.org/", "<a href='http://farm1.org/'>x</a>")]
    rows += [(41, "http://large.org/", "<a href='http://bad.net/'>x</a>" + "".join(f"<a href='http://o{k}.org/'>x</a>" for k in range(20)))]
    out = {r.page_id: r.verdict for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()}
    assert out == {k: "block" for k in [*range(31), 40]} | {41: "allow"}
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    seed = spark.createDataFrame([("a", 1.0, 0.0)], "host string, trust double, distrust double")
    got = {r.host: r.trust for r in propagate(seed, loop, tolerance=1e-3).collect()}
    assert abs(got["a"] - 1 / (1 - 0.85**2)) < 0.01
    monkeypatch.setattr(linkgraph, "MOST_ROUNDS", 2)
    with pytest.raises(RuntimeError):
        propagate(seed, loop)
