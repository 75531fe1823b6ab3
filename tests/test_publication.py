"""Several tables become visible together or not at all; of two writers one wins."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.sources import publication as P


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/tables"


def frame(spark, *ids):
    return spark.createDataFrame([(i, f"v{i}") for i in ids], "id long, v string")


def ids(spark, root, table, version=None):
    return sorted(r.id for r in P.read(spark, root, table, version).collect())


def test_versions(spark, root):
    assert P.current(spark, root) == 0
    assert P.publish(spark, root, {"a": frame(spark, 1), "b": frame(spark, 2)}, 0) == 1
    assert P.publish(spark, root, {"a": frame(spark, 3, 4)}, 1) == 2  # b stays as it was
    assert (ids(spark, root, "a"), ids(spark, root, "b"), ids(spark, root, "a", 1)) == ([3, 4], [2], [1])
    assert P.publish(spark, root, {"a": frame(spark).limit(0)}, 2) == 3 and ids(spark, root, "a") == []


def test_a_failing_check_leaves_the_old_version(spark, root, tmp_path):
    rules = {"positive": ("b", F.col("id") > 0), "named": ("b", F.col("v") != "v0")}
    P.publish(spark, root, {"a": frame(spark, 1), "b": frame(spark, 2)}, 0, rules)
    with pytest.raises(P.Refused, match="positive"):
        P.publish(spark, root, {"a": frame(spark, 5), "b": frame(spark, 2, -1)}, 1, rules)
    with pytest.raises(P.Refused):  # null isn't met
        P.publish(spark, root, {"b": spark.createDataFrame([(None, "x")], "id long, v string")}, 1, rules)
    assert P.current(spark, root) == 1 and ids(spark, root, "a") == [1]
    assert len(list((tmp_path / "tables/staged").iterdir())) == 1  # what was staged is gone


def test_of_two_writers_one_wins(spark, root, monkeypatch):
    P.publish(spark, root, {"a": frame(spark, 1)}, 0)
    with pytest.raises(P.Stale):
        P.publish(spark, root, {"a": frame(spark, 2)}, 0)
    swap = P._swap

    def overtaken(spark, root, version, body):  # another writer publishes after the first look at the version
        monkeypatch.setattr(P, "_swap", swap)
        P.publish(spark, root, {"a": frame(spark, 7)}, version - 1)
        swap(spark, root, version, body)

    monkeypatch.setattr(P, "_swap", overtaken)
    with pytest.raises(P.Stale):
        P.publish(spark, root, {"a": frame(spark, 8)}, 1)
    assert P.current(spark, root) == 2 and ids(spark, root, "a") == [7]


def test_retire(spark, root, tmp_path):
    for k in range(4):
        P.publish(spark, root, {"a": frame(spark, k)} | ({"b": frame(spark, 9)} if not k else {}), k)
    assert P.retire(spark, root, 2) == [1, 2]
    assert ids(spark, root, "a", 3) == [2] and ids(spark, root, "b") == [9]
    assert P.versions(spark, root) == [3, 4] and P.retire(spark, root, 2) == []
