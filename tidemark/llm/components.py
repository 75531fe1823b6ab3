"""Connected components over links held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def component_roots(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root, the smallest node of its component, for every node of links(a, b) that isn't a root itself.

    Alternates large-star and small-star steps, which ends after a number of rounds logarithmic in
    the number of nodes. Every round pre-aggregates the smallest neighbour of a node and is written
    to the shared folder. Links to itself, repeated links and an empty table are allowed.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    edges = materialize(edges, "edges")
    seen = _state(edges)
    for _ in range(most_rounds):
        if seen[0] == 0:
            break
        both = edges.union(edges.select("b", "a"))  # large star: larger neighbours go to the smallest one
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("m"))
        least = materialize(least, "smallest")  # a table of its own: a node of very many links can then be split in the join
        large = both.filter("b > a").join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.filter("a != b").distinct(), "large-star")
        least = materialize(large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")), "smallest")  # small star: so do the smaller ones
        small = large.join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(small.union(least.select("node", "m")).filter("a != b").distinct(), "small-star")
        now = _state(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _state(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
