"""op12 against the tokenizer on whole texts, and its edge cases."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.packing import WordEncoder, binary_lengths, binary_pieces, numbered
from tidemark.llm.queries import QUERIES, WORDS

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(P.path(WORDS))


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, texts, tokenizer, largest=2048):
    """Rows (key, start, length, crc, doc_tokens, sequence_id, offset): each id in one piece, powers of two, one piece a sequence."""
    by: dict = {}
    for r in rows:
        by.setdefault(r[0], []).append(r[1:])
    assert set(by) == set(texts)
    for key, text in texts.items():
        ids, at = ids_of(tokenizer, text), 0
        for start, length, crc, total, _, offset in sorted(by[key]):
            assert start == at and total == len(ids) and offset == 0 and length <= largest and length & length - 1 == 0
            assert crc == zlib.crc32(np.array(ids[at : at + length], dtype="<u4").tobytes())
            at += length
        assert at == len(ids)
        lengths = [length for _, length, *_ in sorted(by[key])]
        assert lengths == sorted(lengths, reverse=True) and all(lengths.count(x) == 1 for x in lengths if x < largest)
    sequences = [r[5] for r in rows]
    assert sorted(sequences) == list(range(len(rows)))
    of = [length for _, length in sorted((r[5], r[2]) for r in rows)]
    assert of == sorted(of, reverse=True)  # equal lengths lie together


def test_query(spark, tokenizer):
    out = QUERIES["op12_binary_packing"](spark, DATA)
    assert dict(out.dtypes) == dict.fromkeys(["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], "bigint")
    check([tuple(r) for r in out.collect()], {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}, tokenizer)


def test_awkward_texts(tokenizer):
    coder = WordEncoder(P.path(WORDS))
    texts = [
        "", " ", "\n\t \r\n", "a", "it's we'LL 'S", "x y  z", "a ́b é ẹ́", "ΑΣ ΣΑΣ. ΌΣΟΣ", "İI ß ẞ", "日本語 テキスト", "😀😀 👩‍👩‍👧", "<|endoftext|> a<|startoftext|>b",
        "\x1c\x1d a\x0bb\x0cc", "각 ᄀ ᅡ", "x" * 5000, "1234 5 ½ Ⅷ", "a b\u0085c", "﻿hi", "̀ a", "co­op", "\x00 \x01",
    ]
    rng = np.random.default_rng(5)
    alphabet = list("ab'sS.=,_<|>-̸É× \n\t\r.0é́ ΣσİI中😀‍\x1c\x0b　½")
    texts += ["".join(rng.choice(alphabet, rng.integers(1, 60))) for _ in range(2000)]
    texts += [t.replace("<|", "") for t in texts[:20]] + ["x≠y =́a .a.́ a.'s x'.s it's. A_b--c", "É. éà,è È×÷ÿ.", "a\u0301. .\u0301a"]
    for many in (texts, [t for t in texts if "<|" not in t]):
        for t, ids in zip(many, coder(many), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_long_texts_are_cut_at_spaces(tokenizer, monkeypatch):
    monkeypatch.setattr("tidemark.llm.packing.AT_ONCE", 50)
    monkeypatch.setattr("tidemark.llm.packing.HELD_WORDS", 20)
    coder, rng = WordEncoder(P.path(WORDS)), np.random.default_rng(2)
    text = " ".join("".join(rng.choice(list("abcé'1\n"), rng.integers(1, 30))) for _ in range(800))
    for got in coder([text, "", text]):
        want, text = text, "" if text else want
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(want, add_special_tokens=False).ids


def test_lengths():
    assert [binary_lengths(n, 8) for n in (1, 7, 8, 29)] == [[1], [4, 2, 1], [8], [8, 8, 8, 4, 1]] and binary_lengths(3, 1) == [1, 1, 1]


def test_nulls_repeats_empty_and_clashing(spark, tokenizer):
    schema = "doc_id string, text string, start int, part string, length int"
    assert numbered(binary_pieces(spark.createDataFrame([], schema), P.path(WORDS), 1, 8)).collect() == []
    rows = [("a", "one two three"), ("b", None), (None, ""), ("c", "word " * 3000)]
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], schema).repartition(3)
    pieces = numbered(binary_pieces(frame, P.path(WORDS), 1, 8).withColumn("crc", F.crc32("tokens")))
    got = [(r.doc_id, r.start, r.length, r.crc, r.doc_tokens, r.sequence_id, r.offset) for r in pieces.collect()]
    check(got, dict(rows), tokenizer, 8)
    twice = numbered(binary_pieces(frame.union(frame), P.path(WORDS), 1, 8))
    assert twice.count() == 2 * len(got) == twice.select("sequence_id").distinct().count()
    with pytest.raises(ValueError):
        binary_pieces(frame, P.path(WORDS), 1, 12)
