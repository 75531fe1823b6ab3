"""op11 against a tree built by hand, proofs included, and its edge cases."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm.merkle import digest, folded, leaf_of, manifest, siblings


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves: list[str]) -> tuple[str, list[list[tuple[list[str], int]]]]:
    """Root, and for each leaf its (run, slot) level by level."""
    paths: list[list] = [[] for _ in leaves]
    under = [[k] for k in range(len(leaves))]
    while len(leaves) > 1:
        runs = [leaves[k : k + 16] for k in range(0, len(leaves), 16)]
        for r, run in enumerate(runs):
            for slot in range(len(run)):
                for leaf in under[16 * r + slot]:
                    paths[leaf].append((run, slot))
        under = [sum(under[k : k + 16], []) for k in range(0, len(under), 16)]
        leaves = [H(*run) for run in runs]
    return leaves[0], paths


def expected(rows: list[tuple]) -> list[tuple]:
    """(id, leaf, subroot, root, proof) of rows (id, group, leaf)."""
    groups: dict = {}
    for i, g, leaf in rows:
        groups.setdefault(g, []).append((i is not None, i or 0, leaf, i))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = {g: tree([leaf for _, _, leaf, _ in sorted(groups[g])]) for g in names}
    root, over = tree([built[g][0] for g in names])
    out = []
    for g, top in zip(names, over):
        for (_, _, leaf, i), path in zip(sorted(groups[g]), built[g][1]):
            proof = "".join(h for run, slot in path + top for k, h in enumerate(run) if k != slot)
            out.append((i, leaf, built[g][0], root, H(proof)))
    return out


SIZES = {"one": 1, "sixteen": 16, "more": 17, "é": 2, "Z": 273, None: 5}


@pytest.mark.parametrize("groups", [SIZES, {"only": 1}, {"only": 300}, {f"g{k:02}": 1 + k % 3 for k in range(40)}])
def test_roots_and_proofs(spark, groups):
    rows = [(None if g is None and k == 2 else 7 * k % n if g == "sixteen" else n - k, g, H(str((g, k // 2 if g == "more" else k)))) for g, n in groups.items() for k in range(n)]
    frame = spark.createDataFrame(rows, "id long, g string, leaf string")
    got = manifest(frame, "g", "id").select("id", "leaf", "subroot", "root", digest(siblings(F.col("path"))).alias("proof"), folded(F.col("path"), F.col("leaf")).alias("back"))
    got = got.collect()
    assert all(r.back == r.root for r in got)
    key = lambda r: tuple(map(str, r))
    assert sorted([(r.id, r.leaf, r.subroot, r.root, r.proof) for r in got], key=key) == sorted(expected(rows), key=key)


def test_a_changed_leaf_folds_to_another_root(spark):
    rows = [(k, "ab"[k % 2], H(str(k))) for k in range(40)]
    changed = [(i, g, H("x") if i == 6 else leaf) for i, g, leaf in rows]
    frame = spark.createDataFrame(rows, "id long, g string, leaf string")
    r = manifest(frame, "g", "id").filter("id = 6").select("root", folded(F.col("path"), F.lit(H("x"))).alias("other")).first()
    assert r.root == expected(rows)[0][3] and r.other == expected(changed)[0][3] != r.root


def test_empty_repeated_and_clashing(spark):
    schema = "id long, g string, leaf string, root int, path string, n int, tree int, place int, at int, digest int"
    assert manifest(spark.createDataFrame([], schema), "g", "id").collect() == []
    rows = [(1, "a", H("x"), 9, "p", 1, 2, 3, 4, 5)] * 3
    got = manifest(spark.createDataFrame(rows, schema), "g", "id").collect()
    assert [(r.id, r.root, r.n, r.tree, r.place, r["at"], r.digest) for r in got] == [(1, H(*[H("x")] * 3), 1, 2, 3, 4, 5)] * 3


def test_leaves(spark):
    long = "Ä" * 300_000
    rows = [(1, None, "a:b", 5, "T"), (None, "é", "", None, None), (2, "-", "en", 0, long)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = [r[0] for r in frame.select(leaf_of(*[F.col(c) for c in frame.columns])).collect()]
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    assert got == [H(*map(field, r)) for r in rows]
