"""op1, op4, op5, op7 and op8 against brute force, and their edge cases."""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.bpe import Encoder, bpe_round_trip
from tidemark.llm.mixing import mix_sources
from tidemark.llm.simhash import disjoint_bands, fingerprint, hex_of, shingle_hashes, simhash_components
from tidemark.llm.token_files import scan_token_files, token_counts
from tidemark.llm.toxicity import fit_toxicity, score_toxicity

RANKS = P.path("byte_bpe_50k.tiktoken")
END = 50256
TEXTS = [None, "", " ", "Hello  world's end!\n\n", "naïve café 123 ½ 日本語 🙂🙂", "a" * 3000, "\u0000\ufffd\u00a0x", "the the the", "the the the", "  lead\t\ttabs  "]


@pytest.fixture(scope="module")
def coder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, f"s{k % 3}" if k % 4 else None, k, "clash") for k, t in enumerate(TEXTS)] + [(None, "no id", "s1", 1, None), (7, "the the the", "s1", 1, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int, toxicity string")


def test_bpe_agrees_with_tiktoken(docs, coder):
    out = bpe_round_trip(docs, RANKS, P.PATTERN).collect()
    assert len(out) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in out:
        ids = coder.encode_ordinary(texts[r.doc_id] or "")
        raw = np.array(ids, dtype="<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
        )
        assert r.toxicity in ("clash", None)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text(alphabet="ab \n'sß9", max_size=200), max_size=8))
def test_merge_replay_agrees_with_tiktoken(texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = _encoder()
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}) if not _CODER else _CODER[0]
    _CODER[:] = [want]
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in enc.encode(texts)] == [want.encode_ordinary(t) for t in texts]


_CODER: list = []
_ENCODER: list = []


def _encoder() -> Encoder:
    if not _ENCODER:
        _ENCODER.append(Encoder(RANKS, P.PATTERN))
    return _ENCODER[0]


def test_bpe_of_nothing(docs):
    assert bpe_round_trip(docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_token_counts(docs, coder):
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in token_counts(docs, RANKS, P.PATTERN, END).collect()))
    want = sorted(((r.doc_id is None, r.doc_id or 0, len(coder.encode_ordinary(r.text or ""))) for r in docs.collect()))
    assert got == want
    assert token_counts(docs.limit(0), RANKS, P.PATTERN, END).count() == 0


def test_scan_stitches_documents_across_blocks(spark, tmp_path):
    rng = np.random.default_rng(5)
    files = {}
    for name, tail in (("a", []), ("b", [7, 8]), ("empty", None), ("one", [1] * 50)):
        lengths = [] if tail is None or name == "one" else rng.integers(0, 40, 60).tolist() + [300, 0, 0]
        ids = [x for n in lengths for x in [*rng.integers(0, 1000, n).tolist(), END]] + (tail or [])
        (tmp_path / f"{name}.bin").write_bytes(np.array(ids, dtype="<u2").tobytes())
        files[f"file://{tmp_path}/{name}.bin"] = lengths + ([len(tail)] if tail else [])
    frame = spark.createDataFrame([(p,) for p in [*files, next(iter(files))]], "path string")
    got: dict = {}
    for r in scan_token_files(frame, END, block_bytes=64).collect():
        got.setdefault(r.path, {})[r.ordinal] = r.n_tokens
    assert {p: [d[k] for k in sorted(d)] for p, d in got.items()} == {p: n for p, n in files.items() if n}


def naive_fingerprint(text: str | None, shingle: int) -> int:
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    runs = [b" ".join(words[k : k + shingle]) for k in range(len(words) - shingle + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values: list[int], distance: int) -> list[int]:
    label = list(range(len(values)))
    for _ in values:
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if bin(a ^ b).count("1") <= distance:
                    label[i] = label[j] = min(label[i], label[j])
    return label


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aB \t\u00a0éZ\n", max_size=60))
def test_fingerprint(text):
    assert int(fingerprint(shingle_hashes(text, 3))[0]) == naive_fingerprint(text, 3)


def test_simhash_components(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(300)]
    texts = [None, "", "one", "one", "two words"]
    for _ in range(25):
        base = rng.choice(words, rng.integers(3, 120)).tolist()
        texts.append(" ".join(base))
        for _ in range(int(rng.integers(0, 4))):
            base = list(base)
            base[int(rng.integers(0, len(base)))] = str(rng.choice(words))
            texts.append(" ".join(base))
    rows = [(100 - k, t, k) for k, t in enumerate(texts)]
    out = simhash_components(spark.createDataFrame(rows, "doc_id long, text string, component_id int"), shingle=3, lanes=1, distance=3)
    got = {r.doc_id: (r.f, r.component_id) for r in out.select("doc_id", hex_of(out["fp"]).alias("f"), "component_id").collect()}
    fps = [naive_fingerprint(t, 3) for t in texts]
    label = components(fps, 3)
    for k, (doc_id, _, _) in enumerate(rows):
        smallest = min(rows[j][0] for j in range(len(rows)) if label[j] == label[k])
        assert got[doc_id] == (f"{fps[k]:016x}", smallest)


def test_simhash_crowded_bucket_and_nothing(spark, monkeypatch):
    from tidemark.llm import simhash

    monkeypatch.setattr(simhash, "PIECE", 4)  # many pieces a bucket
    base = 0x0F0F_0F0F_0F0F_0F0F
    rng = np.random.default_rng(1)
    values = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 16, (60, 2))} | {0, 2**64 - 1})
    frame = spark.createDataFrame([(bytearray(v.to_bytes(8, "big")),) for v in values], "fp binary")
    links = [(int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")) for r in simhash.near_links(frame, 1, 3, disjoint_bands(64, 3), pivots=4).collect()]
    root = {v: v for v in values}
    for _ in values:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    label = components(values, 3)
    assert [values.index(root[v]) for v in values] == label
    many = simhash.near_links(frame, 1, 3, simhash.combined_bands(64, 3, 6), pivots=4).collect()
    assert len(simhash.combined_bands(64, 3, 6)) == 20 and {(r.a, r.b) for r in many}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_components(none, shingle=3, lanes=1, distance=3).count() == 0


def test_mixing(spark):
    rng = np.random.default_rng(9)
    rows = [(k, " ".join(["w"] * int(n)), s) for k, (n, s) in enumerate(zip(rng.integers(0, 60, 900), rng.choice(["a", "b", "c", "d"], 900, p=[0.85, 0.1, 0.03, 0.02])))]
    rows += [(k + 900, "x y z", None) for k in range(40)] + [(2000, None, "a"), (2000, None, "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = sorted(map(tuple, mix_sources(frame).select("doc_id", "size", "source_size", "target", "taken", "source").collect()), key=str)
    again = sorted(map(tuple, mix_sources(frame.repartition(5)).select("doc_id", "size", "source_size", "target", "taken", "source").collect()), key=str)
    assert first == again and len(first) == len(rows)
    sizes: dict = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    names = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] >= 2 * sizes[s]}
        if not full:
            target |= {s: share * weight[s] for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    taken: dict = {}
    for _, size, source_size, goal, n, source in first:
        assert source_size == sizes[source] and abs(goal - target[source]) < 1e-6 and n in (0, size, 2 * size)
        taken[source] = taken.get(source, 0) + n
    for s in names:
        assert abs(taken[s] - target[s]) <= max(60, 0.02 * target[s])
    assert mix_sources(frame.limit(0)).count() == 0


def test_mixing_of_equal_rows(spark, monkeypatch):
    from tidemark.llm import mixing

    monkeypatch.setattr(mixing, "WRITTEN_TOGETHER", 7)
    rows = [(1, "a b c", "s")] * 90 + [(k, "d e", "s") for k in range(2, 40)] + [(1, "a b c", "t")] * 5 + [(None, "x", None)] * 20
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix_sources(frame).select("doc_id", "source", "size", "copies", "taken", "target", "source_size").collect()
    assert len(out) == len(rows) and all(r.taken == r.copies * r.size and 0 <= r.copies <= 2 for r in out)
    of = [r.copies for r in out if r.doc_id == 1 and r.source == "s"]
    assert len(of) == 90 and max(of) - min(of) <= 1
    for source in ("s", "t", None):
        mine = [r for r in out if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 3
    again = mix_sources(frame.repartition(3)).select("doc_id", "source", "size", "copies", "taken", "target", "source_size").collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_bounded_sample(spark):
    from tidemark.llm.shared import bounded_sample

    frame = spark.range(20_000)
    few = [r.id for r in bounded_sample(frame, "id", 100).collect()]
    assert few == [r.id for r in frame.selectExpr("id", "xxhash64(id) h").orderBy("h").limit(100).collect()]
    assert bounded_sample(frame, "id", 50_000).count() == 20_000


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    bad, good = ["scumbag", "moronic", "idiotic"], [f"{a}{b}ing" for a in ("gard", "sail", "walk", "read") for b in ("en", "er", "ab", "ul")]
    rows, labels = [], []
    for k in range(300):
        toxic = int(rng.random() < 0.3)
        words = rng.choice(good, 30).tolist() + (rng.choice(bad, 2).tolist() if toxic else [])
        rng.shuffle(words)
        rows.append((k, " ".join(words), "x"))
        labels.append((k, toxic))
    rows += [(None, "no id", None), (500, None, "y"), (501, "", "y"), (501, "", "y"), (502, "walkening " * 20_000, "z")]
    labels += [(None, 1), (3, None), (0, 1), (999, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxicity string")
    model = fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int").filter("doc_id IS NULL OR doc_id % 3 <> 1"))
    out = score_toxicity(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r.toxicity <= 1 for r in out)
    held = {k: t for k, t in labels[:300] if k % 3 == 1}
    wrong = sum((r.toxicity >= 0.7) != bool(held[r.doc_id]) for r in out if r.doc_id in held)
    assert wrong <= 2
    assert all(r.toxicity < 0.7 for r in out if r.doc_id is None or r.doc_id >= 500)
    nothing = fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert score_toxicity(docs.limit(0), nothing).count() == 0
    assert {round(r.toxicity, 6) for r in score_toxicity(docs, nothing).collect()} == {0.5}


def test_toxicity_features_against_brute_force(spark):
    from tidemark.llm import toxicity as T

    rng = np.random.default_rng(4)
    words = ["straße", "ñandú", "walk", "日本", "rude", "kind"]
    rows, labels = [], []
    for k in range(240):
        toxic = int(k % 3 == 0)
        rows.append((k, " ".join(rng.choice(words[:4], 12).tolist() + (["RÜDE  oaf"] if toxic and k % 6 else []))))
        labels.append((k, toxic))
    rows += [(k, None) for k in range(240, 244)]
    labels += [(k, k % 2) for k in range(240, 244)]
    model = fit_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    grams = lambda t: {g[j : j + n] for g in [" " + " ".join((t or "").lower().split()) + " "] for n in (3, 4, 5) for j in range(len(g) - n + 1)}
    buckets: dict = {}
    by_label: tuple = ({}, {})
    for (k, t), (_, y) in zip(rows, labels):
        for b in {_bucket_of(g, T) for g in grams(t)}:
            by_label[y][b] = by_label[y].get(b, 0) + 1
    n1, n0 = sum(y for _, y in labels), sum(1 - y for _, y in labels)
    for b in set(by_label[0]) | set(by_label[1]):
        a, c = by_label[1].get(b, 0), by_label[0].get(b, 0)
        e = (a + c) * n1 / (n1 + n0)
        chi = (a - e) ** 2 * (1 / e + 1 / (a + c - e)) + ((a - e) ** 2 * (1 / (n1 - e) + 1 / (n0 - (a + c - e))) if a + c < n1 + n0 else 0)
        if chi > 29.7:
            buckets[b] = np.log((a + 1) / (n1 + 2)) - np.log((c + 1) / (n0 + 2))
    assert buckets and dict(zip(model.buckets.tolist(), np.round(model.ratios, 9).tolist())) == {b: round(r, 9) for b, r in buckets.items()}


def _bucket_of(gram: str, T) -> int:
    """The bucket of one n-gram, hashed by hand."""
    h = 0
    for c in gram:
        h = (h * 0x100000001B3 + ord(c)) % 2**64
    return (h * 0x9E3779B97F4A7C15 % 2**64) >> (64 - T.BITS)


def test_logistic_reaches_the_optimum():
    from tidemark.llm.toxicity import logistic

    rng = np.random.default_rng(6)
    scale = rng.normal(size=40)
    found = [np.flatnonzero(rng.random(40) < 0.2) for _ in range(300)] + [np.empty(0, dtype=np.int64)]
    x = np.zeros((301, 40))
    for k, f in enumerate(found):
        x[k, f] = scale[f]
    y = (x @ rng.normal(size=40) + rng.normal(size=301) > 0.3).astype(float)
    w, b = logistic(found, scale, y, 0.0)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (p - y) + w).max() < 0.05 and abs((p - y).sum()) < 0.05


def test_thin_query_of_toxicity(spark, tmp_path):
    from tidemark.llm.queries import QUERIES

    import zlib

    rows = [(k, f"some words {k % 7} here" + (" you moronic scumbag" if k % 5 == 0 else "")) for k in range(200)] + [(None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(180)], "doc_id long, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    out = QUERIES["op5_toxicity"](spark, f"file://{tmp_path}")
    assert dict(out.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    for r in out.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 3 == 1)
        assert r.predicted == int(r.score >= 0.7) == int(r.doc_id is not None and r.doc_id % 5 == 0)


def test_pieces_are_those_of_tiktoken_for_every_character():
    """Every code point between letters, numbers, marks and spaces: tiktoken's own Unicode version decides what a letter is."""
    from tidemark.llm.bpe import Encoder

    from tidemark.llm.bpe import load_ranks

    coder = Encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    real = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    rng = np.random.default_rng(3)
    odd = [0x10940, 0x1E900, 0x16D40, 0x10D50, 0x1C89, 0xA7CB, 0x2FFC, 0x378, 0x10FFFF, 0x0300, 0x20, 0x61, 0x31, 0x27, 0x73, 0x0A, 0x85, 0x2028]
    texts = ["".join(chr(c) for c in rng.choice(odd, 12)) for _ in range(3000)]
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(f"x{c}y {c}8" for c in every[k : k + 0x800]) for k in range(0, len(every), 0x800)]
    for k in range(0, len(texts), 100):
        for text, ids in zip(texts[k : k + 100], coder.encode(texts[k : k + 100])):
            assert np.frombuffer(ids, "<u4").tolist() == real.encode_ordinary(text)
