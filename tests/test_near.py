"""Operators that SQL can't express, against brute force, and edge cases of the gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import documents as D
from tidemark.operators import gates as G
from tidemark.operators import near, states
from tidemark.plans import flows, matches
from tidemark.streaming import ledger

DATA = "/root/testdata/sf0.001"


def test_near_duplicate_changes_query(spark):
    rows = [r.asDict() for r in matches.change_rows(spark, DATA).collect()]
    scopes: dict = {}
    for r in sorted(rows, key=lambda r: (r["ts"], r["n"])):
        scopes.setdefault((r["user_id"], r["subject"]), []).append(r)
    kept = []
    for members in scopes.values():
        seen, told = set(), []
        for r in members:
            words, ideas = set(r["words"]), set(r["concepts"])
            if r["key"] in seen:
                continue
            seen.add(r["key"])
            telling = len(words) >= 8 or (len(words) >= 4 and ideas)
            overlaps = [(len(words & w), min(len(words), len(w)), len(words | w), bool(ideas & i)) for w, i in told]
            if telling and any((n >= 10 and n >= 0.72 * s and n >= 0.45 * u) or (c and n >= 7 and n >= 0.55 * s) for n, s, u, c in overlaps):
                continue
            kept.append(r["event_id"])
            if telling:
                told.append((words, ideas))
    assert sorted(r.event_id for r in matches.near_duplicate_changes(spark, DATA).collect()) == sorted(kept)
    assert 0 < len(kept) < len(rows)


def test_near_duplicates_of_little(spark):
    schema = "scope string, t int, key string, words array<string>, concepts array<string>"
    none = spark.createDataFrame([], schema)
    assert near.without_near_duplicates(none, ["scope"], ["t"], "key", "words", "concepts").count() == 0
    rows = [("a", 2, "x", [], []), ("a", 1, "x", [], []), (None, 1, "x", [], []), (None, 2, "y", ["w"], []), ("a", 3, None, [], [])]
    out = near.without_near_duplicates(spark.createDataFrame(rows, schema), ["scope"], ["t"], "key", "words", "concepts").collect()
    assert sorted((str(r.scope), r.t, r.key) for r in out) == [("None", 1, "x"), ("None", 2, "y"), ("a", 1, "x")]


def test_near_duplicates_neither_broadcast_nor_round_by_scope(spark, monkeypatch):
    """Frames that grow with the changes are joined by shuffles (groups meet one row a run), and rounds don't grow with the number of scopes."""
    told: list = []
    keep, settle = near.stored, near.first_independent

    def noting(frame, name):
        told.append((name, frame._jdf.queryExecution().executedPlan().toString()))
        return keep(frame, name)

    monkeypatch.setattr(near, "stored", noting)
    monkeypatch.setattr(near, "first_independent", lambda links: settle(links, run=64))
    words = [f"word{k:02d}" for k in range(16)]
    rows = [(f"s{k}", t, f"{k} {t}", words[: 12 + t % 4], []) for t in range(16) for k in range(40)]
    frame = spark.createDataFrame(rows, "scope string, t int, key string, words array<string>, concepts array<string>")
    found = near.without_near_duplicates(frame, ["scope"], ["t"], "key", "words", "concepts")
    assert sorted((r.scope, r.t) for r in found.collect()) == sorted((f"s{k}", 0) for k in range(40))
    plans = [plan for name, plan in told if name != "groups"] + [found._jdf.queryExecution().executedPlan().toString()]
    assert not [plan for plan in plans if "BroadcastHashJoin" in plan or "BroadcastNestedLoopJoin" in plan]
    assert [name for name, _ in told].count("settled") <= 2


def test_budget_admission(spark):
    out = flows.budget_admission(spark, DATA).collect()
    events = {r.event_id: r.ts for r in spark.read.parquet(f"{DATA}/events.parquet").collect()}
    left: dict = {}
    for r in sorted(out, key=lambda r: (events[r.event_id], r.event_id)):
        rest = left.setdefault((r.user_id, r.day), 150)
        assert r.admitted == (r.amount <= rest)
        left[r.user_id, r.day] -= r.amount if r.admitted else 0
    assert {r.admitted for r in out} == {True, False}
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, 9), ("a", 3, 2), ("a", 4, 1), (None, 1, 5)], "lane string, t int, x int")
    got = {(r.lane, r.t): r.admitted for r in states.admitted(rows, ["lane"], ["t"], "x", 10).collect()}
    assert got == {("a", 1): False, ("a", 2): True, ("a", 3): False, ("a", 4): True, (None, 1): True}


def test_admission_of_a_hot_key(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    amounts = [None if k % 91 == 0 else -3 if k % 77 == 0 else int(x) for k, x in enumerate(rng.choice([0, 1, 2, 3, 7, 50, 400, 5000], 40_000))]
    rows = [("hot" if k % 3 else None if k % 2 else "b", int(k), x) for k, x in enumerate(amounts)]
    frame = spark.createDataFrame(rows, "lane string, t long, x long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for cap in (0, 150, 60_000):
            out = states.admitted(frame, ["lane"], ["t"], "x", cap, spark.createDataFrame([("b", 100), ("other", 7)], "lane string, spent long"))
            left, want = {"hot": cap, None: cap, "b": cap - 100}, {}
            for lane, t, x in rows:
                want[t] = x is not None and 0 <= x <= left[lane]
                left[lane] -= x if want[t] else 0
            assert {r.t: r.admitted for r in out.collect()} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_outcomes():
    import numpy as np

    rng = np.random.default_rng(0)
    for cap in (1, 30, 500):
        amounts = [int(x) for x in rng.integers(-2, cap + 5, 25)]
        starts, taken = states.outcome(amounts, cap)
        for left in range(cap + 1):
            rest = left
            for x in amounts:
                rest -= x if 0 <= x <= rest else 0
            assert left - rest == taken[np.searchsorted(starts, left, side="right") - 1]


def test_admission_as_a_stream(spark, tmp_path):
    import pytest
    from pyspark.errors import StreamingQueryException

    def stop(batch):
        if batch == 1:
            raise RuntimeError("stopped")

    want = flows.budget_admission(spark, DATA)
    rows = want.drop("admitted").join(spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "ts"), "event_id").withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))
    for k in range(3):
        rows.filter(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    to, progress = f"file://{tmp_path}/to", f"file://{tmp_path}/progress"
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    with pytest.raises(StreamingQueryException):
        ledger.admit_batches(stream, to, progress, ["user_id", "day"], ["ts", "event_id"], "amount", 150, stop)
    got = ledger.admit_batches(stream, to, progress, ["user_id", "day"], ["ts", "event_id"], "amount", 150).collect()
    spent: dict = {}
    for r in sorted(got, key=lambda r: (r.event_id % 3, r.ts, r.event_id)):  # a batch is a file
        left = 150 - spent.get((r.user_id, r.day), 0)
        assert r.admitted == (r.amount <= left)
        spent[r.user_id, r.day] = 150 - left + (r.amount if r.admitted else 0)
    assert len(got) == rows.count()


def test_overlapping_rectangles_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    make = lambda n: [(int(k % 3), int(k), *map(float, (x, x + w, y, y + h))) for k, (x, y, w, h) in enumerate(zip(rng.integers(-40, 60, n), rng.integers(0, 50, n), rng.integers(0, 30, n), rng.integers(1, 9, n)))]
    boxes, crops = make(120), make(60)
    schema = "page int, id int, x1 double, x2 double, y1 double, y2 double"
    found = near.overlapping(spark.createDataFrame(boxes, schema), spark.createDataFrame(crops, schema), "page", 7.0)
    want = {(a[1], b[1]) for a in boxes for b in crops if a[0] == b[0] and a[2] < b[3] and b[2] < a[3] and a[4] < b[5] and b[4] < a[5]}
    got = [(r.id, r.crop_id) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)


def test_best_by_tokens_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    make = lambda n: [(int(k), sorted({f"w{min(int(w), 30)}" for w in rng.zipf(1.4, int(rng.integers(0, 9)))})) for k in range(n)]
    asked, known = make(120), make(60)
    for least in (0.3, 0.5, 1.0):
        out = near.best_by_tokens(spark.createDataFrame(asked, "r long, t array<string>"), spark.createDataFrame(known, "a long, t array<string>"), "r", "a", "t", least).collect()
        want = {}
        for r, x in asked:
            best = max(((round(len(set(x) & set(y)) / max(len(x), len(y)), 6), -a) for a, y in known if x and y), default=(0, 0))
            if best[0] >= least:
                want[r] = (-best[1], best[0])
        assert {r.r: (r.a, r.score) for r in out} == want and want


def test_gates_of_nothing(spark):
    row = spark.createDataFrame([(None, None, None)], "url string, metadata string, text string")
    url, meta, text = F.col("url"), F.col("metadata"), F.col("text")
    r = row.select(
        G.hard_blocked(url).alias("blocked"), G.trackable(url).alias("trackable"), G.review_status(meta).alias("review"), G.source_quality(url, text, meta, "public").alias("quality"),
        G.health_kind(text, text, text).alias("health"), G.useful_summary(text).alias("useful"), G.identity_score(text, F.coalesce(text, F.lit("")), text, F.lit(False)).alias("identity"),
        D.kind(meta).alias("kind"), D.canonical("metadata").alias("canonical"), D.excerpt("url", "text").alias("excerpt"),
    ).first()
    assert (r.blocked, r.trackable, r.review.status, r.quality.reason, r.health, r.useful, r.identity) == (False, False, "unreviewed", "missing_url", "pending", False, 0.0)
    assert (r.kind, r.canonical, tuple(r.excerpt)) == (None, None, (0, "", ""))


def greedy(rows):
    """Ids of kept rows (id, scope, key, words, concepts), in order; kept ones are looked up by word."""
    kept, seen, index, sets = [], set(), {}, {}
    for n, scope, key, words, concepts in sorted(rows):
        if (scope, key) in seen:
            continue
        seen.add((scope, key))
        own, ideas = set(words), set(concepts)
        if len(own) >= 8 or len(own) >= 4 and ideas:
            shared: dict = {}
            for w in own:
                for other in index.get((scope, w), ()):
                    shared[other] = shared.get(other, 0) + 1
            if any(
                ideas & sets[o][1] and k >= 7 and k >= 0.55 * min(len(own), len(sets[o][0])) or k >= 10 and k >= 0.72 * min(len(own), len(sets[o][0])) and k >= 0.45 * len(own | sets[o][0])
                for o, k in shared.items()
            ):
                continue
            sets[n] = own, ideas
            for w in own:
                index.setdefault((scope, w), []).append(n)
        kept.append(n)
    return kept


def test_near_duplicates_of_a_hot_scope(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    texts: list = []
    for _ in range(1500):  # copies of copies, so that what stays depends on the order
        base = [int(w) for w in rng.integers(0, 3000, int(rng.integers(5, 24)))]
        for _ in range(int(rng.integers(1, 9))):
            base = [int(rng.integers(0, 3000)) if rng.random() < 0.12 else w for w in base]
            texts.append((sorted({f"word{w}" for w in base}), [["c1"], ["c2"], ["c1", "c2"], []][rng.integers(0, 4)]))
    rng.shuffle(texts := np.array(texts, dtype=object))
    texts = [*texts, *texts[:500]]
    rows = [(n, ["hot", "hot", "b", None][n % 4], f"k{n // 2 if n % 10 == 1 else n}", *t) for n, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "n long, scope string, key string, words array<string>, concepts array<string>")
    got = [r.n for r in near.without_near_duplicates(frame, ["scope"], ["n"], "key", "words", "concepts").collect()]
    want = greedy(rows)
    assert sorted(got) == want and 1000 < len(want) < len(rows) - 1000


def test_first_independent_rows(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    chain = [(k + 1, k) for k in range(300)]
    for links in (chain, [(int(max(a, b)), int(min(a, b))) for a, b in rng.integers(0, 400, (900, 2)) if a != b], chain + chain):
        kept: dict = {}
        for k in range(401):
            kept[k] = not any(kept[e] for later, e in links if later == k)
        got = {r.later: r.kept for r in near.first_independent(spark.createDataFrame(links, "later long, earlier long"), run=50).collect()}
        assert got == {k: kept[k] for k in {later for later, _ in links}}


def test_best_weighted_against_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    parts = {"words": 0.8, "host": 0.05, "sponsor": 0.25}

    def make(n):
        word = lambda k: f"w{min(int(rng.zipf(1.3)), 200)}" if k else "common"
        return [(int(k), [word(j) for j in range(int(rng.integers(0, 6)))], [f"h{rng.integers(0, 3)}"] if rng.random() < 0.9 else None, [f"s{rng.integers(0, 40)}" for _ in range(int(rng.integers(0, 3)))]) for k in range(n)]

    asked, known = make(250), make(300)
    schema = "words array<string>, host array<string>, sponsor array<string>"
    frames = spark.createDataFrame(asked, "r long, " + schema), spark.createDataFrame(known, "a long, " + schema)

    def score(x, y):
        out = 0.0
        for weight, p, q in zip(parts.values(), x[1:], y[1:]):
            p, q = set(p or []), set(q or [])
            out += weight * len(p & q) / max(len(p), len(q)) if p or q else 0
        return round(out, 9)

    for least in (0.01, 0.3, 0.9):
        for own in (False, True):
            want = {}
            for x in asked:
                best = max((score(x, y), -y[0]) for y in known if not own or x[0] != y[0])
                if best[0] >= least:
                    want[x[0]] = (-best[1], best[0])
            got = {r.r: (r.a, r.score) for r in near.best_weighted(*frames, "r", "a", parts, least, others_only=own).collect()}
            assert got == want and want


def sets_in_languages(n, seed):
    """Rows of words, host and path: most rows of a few hosts and languages, whose words, apart from the very frequent ones, are their own."""
    import numpy as np

    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        lang = int(min(rng.zipf(1.6), 4))
        words = sorted({f"{lang}w{min(int(w), 5000)}" for w in rng.zipf(1.25, int(rng.integers(0, 9)))})
        rows.append((k, None if k % 37 == 0 else words, [f"h{min(int(rng.zipf(1.4)), 60)}"], [f"l{lang}", f"n{rng.integers(0, n)}"] if k % 41 else None))
    return rows


def test_best_weighted_never_joins_pairs(spark, monkeypatch):
    """Requests meet awards in blocks within tasks, several of them here, and no join or shuffle carries a pair: what is shuffled is one row a request."""
    monkeypatch.setattr(near, "RUN", 500)
    monkeypatch.setattr(near, "BLOCK", 4_000)
    blocks, keep = [], near.stored
    monkeypatch.setattr(near, "stored", lambda frame, name: blocks.append(keep(frame, name)) or blocks[-1])
    parts, rows = {"words": 0.8, "host": 0.05, "path": 0.35}, sets_in_languages(900, 11)
    frame = spark.createDataFrame(rows, "r int, words array<string>, host array<string>, path array<string>")
    found = near.best_weighted(frame, frame.withColumnRenamed("r", "a"), "r", "a", parts, 0.2, others_only=True, null_unlike=True)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    want: dict = {}
    for x in rows:
        for y in rows:
            if x[0] == y[0] or any((p is None and q) or (q is None and p) for p, q in zip(x[1:], y[1:])):
                continue
            score = round(sum(w * len(set(p or []) & set(q or [])) / max(len(p or []), len(q or []), 1) for w, p, q in zip(parts.values(), x[1:], y[1:])), 9)
            if score >= 0.2:
                want[x[0]] = max(want.get(x[0], (0.0, 0)), (score, -y[0]))
    assert {r.r: (r.score, -r.a) for r in found.collect()} == want and len(want) > 800
    assert found.dtypes == [("r", "int"), ("a", "int"), ("score", "double")]
    files = [{v for r in spark.read.parquet(f).collect() for v in r.path or [] if v[0] == "l"} for f in blocks[0].inputFiles()]  # sorted by language
    assert len(files) > 5 and sum(map(len, files)) <= len(files) + 4
    none = near.best_weighted(frame.limit(0), frame.limit(0).withColumnRenamed("r", "a"), "r", "a", {"words": 1.0}, 0.2)
    assert none.count() == 0 and near.best_weighted(frame, frame.limit(0).withColumnRenamed("r", "a"), "r", "a", parts, 0.2).count() == 0


def test_best_weighted_match_of_odd_pages(spark, tmp_path):
    """Pages without an address or HTML, as SQL has them: what isn't known is unlike anything known."""
    from tests.oracle import connect, difference
    from tidemark.plans import registry

    title = "<title>one two three</title>"
    rows = [
        (1, "https://a.org/en/1", title), (2, "https://a.org/en/2", "<title>one two four</title>"), (3, None, title), (4, "https://a.org/en/4", None), (5, "no address", "<title></title>"),
        (6, "no address", "x"), (None, "https://a.org/en/1", title), (7, None, None), (8, "HTTPS://A.org/EN/1", "<title>ONE Two</title>"), (9, "https://b.org", "<title>é Ünï</title>"),
        (10, "://", "<title>one</title>"), (11, "https://", "<title>one</title>"), (2, "https://b.org/en/2", "<title>one two four seven</title>"),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/p")
    next((tmp_path / "p").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    expected = connect(str(tmp_path)).execute(registry.ORACLE_SQL["best_weighted_match"]).to_arrow_table()
    assert not difference(matches.best_weighted_match(spark, str(tmp_path)).toArrow(), expected) and expected.num_rows == 6
