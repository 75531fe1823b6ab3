"""The pipeline's stages against brute force."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from tidemark.llm import simhash
from tidemark.llm.shared import materialize


def shingles(text: str | None) -> set:
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def first_of_groups(rows: list[tuple]) -> set:
    """The smallest doc_id of each group linked at an exact similarity of 0.8."""
    sets = {r[0]: shingles(r[1]) for r in rows}
    label = {k: k for k in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return set(label.values())


def edited(rng, low: int, high: int) -> list[tuple]:
    """Texts of the given lengths and copies with some words replaced."""
    texts: list = [None, "", " ", "one two", "One  two", "one three"]
    for _ in range(40):
        base = [f"w{k}" for k in rng.integers(0, 100_000, int(rng.integers(low, high)))]
        texts.append(" ".join(base))
        for changes in (1, 2, 3, 5, 7, 9):
            copy = list(base)
            for at in rng.integers(0, len(base), changes):
                copy[at] = f"v{rng.integers(0, 100_000)}"
            texts.append(" ".join(copy))
    return [(k, t) for k, t in enumerate(texts)]


def test_near_duplicates_reach_the_similarity(spark):
    rows = edited(np.random.default_rng(6), 150, 300)
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    want = first_of_groups(rows)
    assert got == want and len(want) < len(rows) - 100
    assert corpus_pipeline.near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string"), "").count() == 0


def test_near_duplicates_of_short_texts_and_in_pieces(spark, monkeypatch):
    """Texts of a few shingles around the threshold, with buckets cut into pieces and leaders: every pair is found."""
    for name, value in (("CROWD", 8), ("LED", 4), ("COUNTED", 1), ("OPEN_FILES", 2)):
        monkeypatch.setattr(simhash, name, value)
    rng = np.random.default_rng(9)
    rows = edited(rng, 5, 16)
    passage = [f"p{k}" for k in range(30)]
    for _ in range(60):  # near copies of one text, linked in part through others only, and others that share most of it
        copy = [f"c{rng.integers(0, 9)}" if rng.random() < 0.02 else w for w in passage]
        rows += [(len(rows), " ".join(copy)), (len(rows) + 1, " ".join(copy[:20] + [f"x{k}" for k in rng.integers(0, 10**6, 12)]))]
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert got == first_of_groups(rows)


def test_a_shared_passage_crowds_no_bucket(spark, monkeypatch):
    """Texts that share a passage and little else don't meet on it, so what is compared grows with the texts, not with their pairs."""
    monkeypatch.setattr(simhash, "COUNTED", 1)
    monkeypatch.setattr(simhash, "CROWD", 64)
    written: dict = {}
    keep = simhash.materialize

    def counting(frame, name):
        out = keep(frame, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(simhash, "materialize", counting)
    rng = np.random.default_rng(3)
    shared = " ".join(f"s{k}" for k in range(24))
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 10**6, 76)) + " " + shared) for k in range(1500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.similar_components(frame, 0.8).filter("doc_id <> component_id").count() == 0
    assert written["crowded-shingles"] == 0 and written["links"] == 0


def test_pairs_are_passed_on_once(spark, monkeypatch):
    """Texts that share half of their words meet in many tasks; what these pass on hardly grows with their number."""
    written: dict = {}
    keep = simhash.materialize

    def noting(frame, name):
        written[name] = keep(frame, name)
        return written[name]

    monkeypatch.setattr(simhash, "materialize", noting)
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(60):
        base = [f"w{k}" for k in rng.integers(0, 10**6, 400)]
        for _ in range(5):
            cut = int(rng.integers(0, 270))
            rows.append((len(rows), " ".join(base[:cut] + [f"v{k}" for k in rng.integers(0, 10**6, 130)] + base[cut + 130 :])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    passed: dict = {}
    for tasks in (2, 16):
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        try:
            got = {r.doc_id: r.component_id for r in simhash.similar_components(frame, 0.8).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)
        assert set(got.values()) == first_of_groups(rows)
        pairs = written["met-pairs"].filter("NOT known").select("a", "b")
        passed[tasks] = pairs.count(), pairs.distinct().count()
    assert passed[16][0] <= 3.5 * passed[16][1] and passed[16][1] > 200


def test_pivots_discard_sets_before_they_are_intersected(spark, tmp_path, monkeypatch):
    """Sets too far from each other by their distances to the pivots aren't intersected; no similar pair is discarded."""
    rng = np.random.default_rng(8)
    rows = edited(rng, 150, 300)
    folder = f"file://{tmp_path}/sets"
    sets = simhash.shingle_sets(spark.createDataFrame(rows, "doc_id long, text string"), 5, 1, folder).collect()
    address, texts = {r.doc_id: r.address for r in sets}, dict(rows)
    reader, met, intersect = simhash.SetReader(folder, 0.8), [], np.intersect1d
    monkeypatch.setattr(simhash.np, "intersect1d", lambda *a, **b: met.append(1) or intersect(*a, **b))
    ids = [k for k, t in rows if len((t or "").split()) > 30][:140]
    pairs = [(a, b) for a in ids for b in ids if a < b]
    own = {k: shingles(texts[k]) for k in ids}
    near = [5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b]) for a, b in pairs]
    assert [reader.similar(address[a], address[b])[0] for a, b in pairs] == near
    assert 20 < sum(near) <= len(met) < 0.2 * len(pairs)


CLASH = "doc_id long, text string, source string, toxicity string, copies int, n_tokens string"


def test_near_duplicates_keep_one_row_of_each_group(spark):
    a, b = " ".join(f"w{k}" for k in range(40)), " ".join(f"v{k}" for k in range(40))
    rows = [(1, a), (1, a), (2, a), (None, a), (None, b), (None, b), (3, None), (4, ""), (5, "  "), (None, None), (7, "some other words that stay here"), (7, "words of the same id but of another text")]
    rows += [(9, "x " * 200_000), (8, "x  " * 200_000)]
    frame = spark.createDataFrame([(*r, "s", "clash", k // 2 if r[0] else None, None) for k, r in enumerate(rows)], CLASH)
    for _ in range(2):
        got = corpus_pipeline.near_duplicates(spark, materialize(frame, "docs"), "")
        assert got.columns == frame.columns
        kept = sorted(((r.doc_id or 0, (r.text or "").split()[:2]) for r in got.collect()))
        assert kept == [(0, ["v0", "v1"]), (1, ["w0", "w1"]), (3, []), (7, ["some", "other"]), (7, ["words", "of"]), (8, ["x", "x"])]


def test_mixing_stage(spark):
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(["w"] * int(n)), f"s{k % 3}") for k, n in enumerate(rng.integers(1, 60, 300))] + [(None, "a b c", "s1")] * 40 + [(5, "again five", "s2"), (5, "again five", None)]
    rows += [(1000, None, "s0"), (1001, "", "s0")]
    frame = spark.createDataFrame([(*r, "clash", 3, None) for r in rows], CLASH)
    out = corpus_pipeline.mixing(spark, frame, "")
    assert out.columns == frame.columns
    got = [tuple(r)[:3] for r in out.collect()]
    sizes: dict = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    taken: dict = {}
    for _, text, source in got:
        taken[source] = taken.get(source, 0) + len(text.split())
    names = ["s0", "s1", "s2", None]  # weights 3, 1, 2, 3: the null source and s0 stop at twice their sizes
    total, left = 1.5 * sum(sizes.values()), dict(zip(names, (3, 1, 2, 3)))
    target: dict = {}
    while left:
        level = (total - sum(target.values())) / sum(left.values())
        full = [s for s in left if level * left[s] >= 2 * sizes[s]]
        target |= {s: 2.0 * sizes[s] for s in full} if full else {s: level * w for s, w in left.items()}
        left = {s: w for s, w in left.items() if s not in full} if full else {}
    assert all(abs(taken.get(s, 0) - target[s]) <= 60 for s in names)
    for row in set(got):
        assert got.count(row) <= 2 * rows.count(row)


def test_stages_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    none.write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
    assert corpus_pipeline.mixing(spark, none, "").columns == none.columns


def test_whole_pipeline(spark):
    """Every stage of a run over sf0.001 against brute force on what it was given."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    given, stages = [docs], dict(corpus_pipeline.STAGES)
    for name in ("toxicity", "near_duplicates", "mixing"):
        given.append(materialize(stages[name](spark, given[-1], sf_dir), name))
        assert given[-1].columns == docs.columns
    tables = [[tuple(r) for r in frame.collect()] for frame in given]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    gone = {r[0] for r in tables[0]} - {r[0] for r in tables[1]}
    assert set(tables[1]) <= set(tables[0]) and sum(labels.get(k, 0) for k in gone) >= 0.8 * sum(labels.get(k, 0) for k in gone if k in labels)
    assert {r[0] for r in tables[2]} == first_of_groups(tables[1]) and set(tables[2]) <= set(tables[1])
    assert set(tables[3]) <= set(tables[2]) and all(tables[3].count(r) in (0, 1, 2) for r in tables[2])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r[0], hashlib.sha256(np.array(coder.encode_ordinary(r[1] or ""), dtype="<u4").tobytes()).hexdigest()) for r in tables[3])
    assert sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()) == want
