"""Open sources by id or canonical url, and every condition of a public change."""

from __future__ import annotations

from tidemark.operators import visibility


def test_open_sources(spark):
    sources = spark.createDataFrame([(1, "https://www.a.org/x/"), (2, "https://b.org/y?utm_source=z"), (3, "https://B.org/Y"), (None, "https://c.org"), (4, None)], "id long, url string")
    rows = [(1, None, False), (9, "https://a.org/x", False), (None, "HTTP://A.org/x#f", False), (None, "https://b.org/y", False), (None, "https://c.org/", False), (None, "https://d.org", False), (None, None, False), (None, "", False), (1, None, True), (4, "u", False)]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "n int, source_id long, source_url string, hidden boolean")
    got = {r.n: r.open for r in visibility.with_open_source(frame, sources).collect()}
    assert got == dict(enumerate([True, False, True, True, True, False, False, False, False, True]))  # and one row a change


def test_every_condition(spark):
    good = {"id": 1, "award": "a", "source_id": 5, "source_url": "u", "hidden": False, "useful": True}
    source = {"id": 5, "award": "a", "url": "u", "open": True, "allowed": True}
    published, member, shown = {"award": "a", "verified": True, "active": True}, {"award": "a", "source_id": 5}, {"id": 1, "award": "a", "source_id": 5, "schema": "visual-event-evidence-v1"}

    def why(change=None, s=None, p=None, m=None, e=None):
        frame = lambda base, edit, ddl: spark.createDataFrame([] if edit == "none" else [tuple((base | (edit or {})).values())], ddl)
        return visibility.public(
            frame(good, change, "id long, award string, source_id long, source_url string, hidden boolean, useful boolean"), frame(source, s, "id long, award string, url string, open boolean, allowed boolean"),
            frame(published, p, "award string, verified boolean, active boolean"), frame(member, m, "award string, source_id long"), frame(shown, e, "id long, award string, source_id long, schema string"),
        ).first().why_not

    assert why() is None
    cases = [
        ({"p": "none"}, "not_verified"), ({"p": {"verified": None}}, "not_verified"), ({"p": {"active": False}}, "award_not_active"), ({"s": "none"}, "source_missing"), ({"change": {"source_id": None}}, "source_missing"),
        ({"s": {"open": False}}, "source_not_open"), ({"s": {"award": "b"}}, "source_of_another_award"), ({"s": {"url": "U"}}, "another_url"), ({"change": {"source_url": None}}, "another_url"),
        ({"m": {"source_id": 6}}, "source_not_published"), ({"e": "none"}, "no_evidence"), ({"e": {"schema": "v0"}}, "no_evidence"), ({"e": {"source_id": 4}}, "no_evidence"),
        ({"change": {"hidden": True}}, "hidden"), ({"s": {"allowed": False}}, "source_not_allowed"), ({"change": {"useful": None}}, "not_useful"),
    ]
    for edit, reason in cases:
        assert why(**edit) == reason
