"""op13 against brute force with many pivots, groups and blocks, and its edge cases."""

from __future__ import annotations

import numpy as np
import pytest

from tidemark.llm import negatives
from tidemark.llm.negatives import first_k, hard_negatives, neighbourhoods


def brute(rows, every, scale=256, k=5, least=(80, 100)):
    good = [(i, label, np.floor(scale * np.array(v, dtype=float)).astype(int)) for i, label, v in rows]
    out = []
    anchors: dict = {}
    for i, label, v in good:
        if i % every == 0 and (i not in anchors or (label, v.tolist()) < anchors[i]):
            anchors[i] = (label, v.tolist())
    for a, (label, q) in anchors.items():
        scored = sorted((-int(np.dot(q, v)), i, other) for i, other, v in good if i != a)
        for s, i, _ in [x for x in scored if x[2] == label][:k]:
            fits = [(j, -t) for t, j, other in scored if other != label and least[0] * -s <= least[1] * -t <= least[1] * -s][:k]
            out += [(a, i, rank + 1, j, -s, t) for rank, (j, t) in enumerate(fits)]
    return sorted(out)


def clustered(n, seed, centres=6, width=12, spread=0.2):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((centres, width))
    return [(k, str(int(rng.integers(0, 4))), (middle[rng.integers(0, centres)] + spread * rng.standard_normal(width)).tolist()) for k in range(n)]


def frame_of(spark, rows):
    return spark.createDataFrame([(i, label, v, 1) for i, label, v in rows], "vec_id long, label string, embedding array<double>, score int")


def found(frame, every, **more):
    return sorted(tuple(r) for r in hard_negatives(frame, frame.filter(f"vec_id % {every} = 0"), **more).collect())


@pytest.mark.parametrize("spread", [0.05, 0.3, 3.0])
def test_against_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(negatives, "GROUP", 16)
    monkeypatch.setattr(negatives, "BLOCK", 100)
    rows = clustered(900, 3, spread=spread)
    rows[11:40] = [(k, label, rows[10][2]) for k, label, _ in rows[11:40]]  # equal rows tie
    want = brute(rows, 10)
    assert want and found(frame_of(spark, rows), 10, cell=60) == want


def test_bounds_leave_rows_out(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(negatives, "GROUP", 8)
    monkeypatch.setattr(negatives, "BLOCK", 64)
    kept = negatives.anew

    def counting(frame, keys, *more):
        if "block" in keys:
            sizes.append((frame.count(), frame.select("home", "slice").distinct().count()))
        return kept(frame, keys, *more)

    monkeypatch.setattr(negatives, "anew", counting)
    rows = clustered(1200, 5, centres=8, spread=0.02)
    assert found(frame_of(spark, rows), 10, cell=50) == brute(rows, 10)
    (_, _), (copies, groups) = sizes
    assert groups > 4 and copies < 0.5 * groups * len(rows)


def test_rows_that_take_no_part(spark):
    rows = clustered(300, 7)
    odd = [(1000, "a", None), (1010, "a", [float("nan")] * 12), (1020, "a", [None] + [1.0] * 11), (1030, "a", [float("inf")] * 12), (1040, "a", [1.0] * 3), (None, "a", [1.0] * 12), (1050, None, [1.0] * 12), (1060, "a", [])]
    zero = [(2000, "0", [0.0] * 12), (2001, "0", [0.0] * 12)]
    assert found(frame_of(spark, rows + odd + zero), 10) == brute(rows + zero, 10)
    assert found(frame_of(spark, odd), 10) == [] and found(frame_of(spark, []), 10) == []
    assert found(frame_of(spark, rows[:1]), 1) == []  # no other row
    assert found(frame_of(spark, [(k, "same", v) for k, _, v in rows]), 10) == []  # no other label


def test_repeated_ids(spark):
    rows = clustered(200, 9)
    rows += rows[20:25] + [(10, rows[10][1], rows[11][2]), (33, "3", rows[40][2])]
    assert found(frame_of(spark, rows), 10) == brute(rows, 10)


def test_hot_vector_and_label(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 100)
    rows = clustered(600, 11, spread=1.0)
    rows = [(k, "hot" if k % 3 == 0 else label, rows[7][2] if k % 3 == 1 else v) for k, label, v in rows]
    assert found(frame_of(spark, rows), 20, cell=100) == brute(rows, 20)


def test_parts():
    scores = np.array([[1.0, 3, 3, 3, 0], [-np.inf, 1, -np.inf, 2, 2]])
    assert first_k(scores, 2).tolist() == [[False, True, True, False, False], [False, False, False, True, True]]
    assert first_k(scores, 4).tolist()[1] == [False, True, False, True, True]
    pivots = np.random.default_rng(0).standard_normal((20, 3))
    parts = neighbourhoods(pivots, np.ones(20), 4)
    assert sorted(np.bincount(parts)) == [5, 5, 5, 5] and set(neighbourhoods(pivots[:2], np.zeros(2), 9)) == {0, 1}
    assert neighbourhoods(pivots[:1], np.ones(1), 3).tolist() == [0]
