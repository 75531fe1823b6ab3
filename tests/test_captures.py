"""Captured pages with awkward markup, and against the standard library's parser."""

from __future__ import annotations

from html.parser import HTMLParser

from tests.oracle import connect, difference
from tidemark.plans import registry, web
from tidemark.sources.captures import capture_of, captures, tags

AT = "https://site.org/a/page?x=1"


def test_attributes_in_any_form():
    page = """<HTML><head><META content='One &amp; two' NAME=description><Link href="/real" rel='nofollow canonical'><BASE HREF="//other.net/b/"><title>A
    title</TITLE><title>another</title></head><body><a class="x>y" HREF = 'one.html' >First <b>link</b></a><a href=two>x<a href="/three?a=1&amp;b=2">three</a>
    <a name=here>none</a><a href="mailto:a@b">m</a><a href="javascript:x()">j</a><a href='ONE.html#top'></a><a/href=four>4</a><a href>e</a></body>"""
    got = capture_of(page, AT)
    assert (got["title"], got["description"], got["canonical"]) == ("A title", "One & two", "https://other.net/real")
    assert [(x["url"], x["title"]) for x in got["links"]] == [
        ("https://other.net/b/one.html", "First link"), ("https://other.net/b/two", "x"), ("https://other.net/three?a=1&b=2", "three"),
        ("https://other.net/b/ONE.html#top", "ONE.html"), ("https://other.net/b/four", "4"),
    ]


def test_text():
    hidden = "<script>if (a<b) '</p><main>x'</script><style>p{}</style><noscript><p>no</p></noscript><template><a href=/t>t</a></template><svg><title>s</title></svg>"
    assert capture_of(f"{hidden}<p>One<br>two <i>three</i><div>four</div>", AT) | {"links": 0} == {"title": "page", "description": "Onetwo three", "canonical": AT, "text": "Onetwo threefour", "links": 0}
    assert capture_of(f"<body>a<main>b {hidden}<article>c</article></main>d<article>e</article>", AT)["text"] == "b c"
    assert capture_of("<article>in</article>out<main></main>", AT)["text"] == "in" and capture_of("<h1>Head</h1>x", AT)["title"] == "Head"
    assert capture_of("1 < 2 &lt; 3 <4> <!-- a > b --> <!doctype x> <?php ?> end", AT)["text"] == "1 < 2 < 3 <4> end"
    assert capture_of(None, None) == {"title": "Source page", "description": "", "canonical": "", "text": "", "links": []}
    assert capture_of("<a href=x>t</a>", "no url")["links"] == [] and capture_of("<a href='http://[x'>t</a>", AT)["links"] == []


def test_what_does_not_end_takes_the_rest():
    for rest in ("<a href='x", "<!-- x", "<p class=", "<p", "<script>x", "<a b=\"c>d"):
        assert capture_of("<p>shown</p>" + rest + " lost", AT)["text"] == "shown"
    long = "<a '" * 50_000 + "<p " * 50_000
    assert sum(1 for _ in tags(long)) < 10  # in one pass


def test_agrees_with_the_standard_parser(spark):
    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.hrefs, self.parts, self.hidden, self.title = [], [], 0, 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style")
            self.title += tag == "title"
            self.hrefs += [v for k, v in attrs if tag == "a" and k == "href" and v]

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style")
            self.title -= tag == "title"

        def handle_data(self, data):
            if not self.hidden and not self.title:
                self.parts.append(data)

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        plain = Plain()
        plain.feed((r.html or "").replace("<article>", "<x>").replace("</article>", "</x>"))
        plain.close()
        got = capture_of((r.html or "").replace("<article>", "<x>").replace("</article>", "</x>"), r.url)
        assert got["text"] == " ".join("".join(plain.parts).split()) and len(got["links"]) == len(plain.hrefs)


def test_links_are_bounded_and_told_apart(spark):
    page = "".join(f"<a href='/p{k % 100}{x}'>t{k}</a>" for k in range(200) for x in ("", "?utm_source=z", ".pdf"))
    rows = spark.createDataFrame([(1, AT, page), (2, None, None)], "id long, url string, html string")
    got = {r.id: r for r in captures(rows, "id").collect()}
    assert [len(got[1].links), len(got[1].pdf_links), len(got[2].links)] == [80, 40, 0]
    assert got[1].links[0].asDict() == {"url": "https://site.org/p0", "title": "t0"} and got[1].pdf_links[1].title == "t1"
    assert captures(rows.limit(0), "id").count() == 0


def test_references_without_a_semicolon(spark, tmp_path):
    """Query and SQL decode them alike: a title that was cut inside of one ends so."""
    pages = ["<title>a &amp b&amp</title><article><h1>x&amp</h1><p>Ly &lt 1&gt &quot;q&quot &amp;lt; &ampx; &#39;</p></article>", "<title>&ltb&gt;</title>&amp"]
    rows = [(k, f"https://x.org/{k}", html) for k, html in enumerate(pages)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/p")
    next((tmp_path / "p").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    expected = connect(str(tmp_path)).execute(registry.ORACLE_SQL["captured_pages"]).to_arrow_table()
    assert not difference(web.captured_pages(spark, str(tmp_path)).toArrow(), expected)
    assert sorted(expected["title"].to_pylist()) == ["<b>", "a & b&"]


def test_every_link_counts(spark, tmp_path):
    """Links beyond the short lists are counted too, PDF links among them, as SQL does; a page of very many takes no time that grows with their square."""
    page = lambda n: "<title>t</title>" + "".join(f'<a href="/p{k % n}{".pdf" if k % n % 3 == 0 else ""}">t{k}</a>' for k in range(2 * n))
    rows = spark.createDataFrame([(k, f"https://x.org/{k}", page(n)) for k, n in enumerate((1, 200, 30_000))], "page_id long, url string, html string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/p")
    next((tmp_path / "p").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    expected = connect(str(tmp_path)).execute(registry.ORACLE_SQL["captured_pages"]).to_arrow_table()
    assert not difference(web.captured_pages(spark, str(tmp_path)).toArrow(), expected)
    assert sorted(expected["links"].to_pylist()) == [1, 200, 30_000]
    links = captures(rows.filter("page_id = 1"), "page_id").first().all_links
    assert [(x.url, x.title, x.pdf) for x in links] == [(f"https://x.org/p{k}{'.pdf' if k % 3 == 0 else ''}", f"t{k}", k % 3 == 0) for k in range(200)]
