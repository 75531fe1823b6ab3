"""Approximate nearest neighbours by stable projections and a kd-tree.

Unit vectors are projected onto a few Gaussian (2-stable) directions. A kd-tree fitted on a bounded
sample of projections deals all rows into cells; every cell has a kd-tree of its own. A query
visits leaves in the order of their projected distance and verifies their rows on the original vectors. It stops
once the projected distance p of the next leaf satisfies a chi-square test: a row as near as the k-th
found, d, has a squared projected distance of d^2 times a chi-square variable with as many
degrees as there are directions, so it lies beyond p with probability under 1 - confidence.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_sample, materialize
from .vectors import common_length, for_slices, in_slices, lists, matrix, usable

#: Rows that the cells' tree is fitted on at most (those with the smallest hashes of vec_id).
SAMPLE = 10_000
#: Rows of a cell and of a leaf of its own tree, about; cells with more rows are dealt into several blocks.
CELL, LEAF = 2_048, 64
#: Queries that meet a block at once, about: a task holds no more of them and no more than a block's rows, however many there are.
QUERIES = 16_384
#: Directions of the projection, and the probability that a true neighbour isn't missed by the stopping test.
DIRECTIONS, CONFIDENCE = 8, 0.98
#: What rounding may add to a squared distance, between vectors or projected.
SLACK = 1e-9


def chi_square_quantile(p: float, degrees: int) -> float:
    """The value below which a chi-square variable with an even number of degrees lies with probability p."""
    assert degrees % 2 == 0 and 0 < p < 1
    half = degrees // 2
    low, high = 0.0, 1e4
    for _ in range(200):
        x = (low + high) / 2
        below = 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(half))
        low, high = (x, high) if below < p else (low, x)
    return (low + high) / 2


def tree_of(points: np.ndarray, leaf: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Row numbers of each leaf of a kd-tree that halves along the widest axis, and the leaves' least and largest corners."""
    todo, leaves = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        part = points[rows]
        spread = part.max(axis=0) - part.min(axis=0)
        if len(rows) <= leaf or not spread.max() > 0:
            leaves += [rows[k : k + leaf] for k in range(0, len(rows), leaf)]
            continue
        order = np.argsort(part[:, spread.argmax()], kind="stable")
        half = len(rows) // 2
        todo += [rows[order[half:]], rows[order[:half]]]
    low = np.array([points[r].min(axis=0) for r in leaves])
    high = np.array([points[r].max(axis=0) for r in leaves])
    return leaves, low, high


def cells_of(sample: np.ndarray, depth: int) -> np.ndarray:
    """Splits of a complete tree of the given depth in heap order, as axis and value; equal values are kept on one side."""
    splits = np.zeros((2**depth - 1, 2))
    groups = {0: np.arange(len(sample))}
    for node in range(len(splits)):
        rows = groups.pop(node)
        if len(rows):
            part = sample[rows]
            axis = int((part.max(axis=0) - part.min(axis=0)).argmax())
            value = float(np.median(part[:, axis]))
        else:
            axis, value = 0, 0.0
            part = np.empty((0, sample.shape[1]))
        splits[node] = axis, value
        left = part[:, axis] < value
        groups[2 * node + 1], groups[2 * node + 2] = rows[left], rows[~left]
    return splits


def cell_of(points: np.ndarray, splits: np.ndarray, depth: int) -> np.ndarray:
    """The cell of each point."""
    node = np.zeros(len(points), dtype=np.int64)
    every = np.arange(len(points))
    for _ in range(depth):
        axis, value = splits[node, 0].astype(np.int64), splits[node, 1]
        node = 2 * node + 1 + (points[every, axis] >= value)
    return node - len(splits)


def boxes_of(splits: np.ndarray, depth: int, directions: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest corners of all cells."""
    n = len(splits)
    low, high = np.full((2 * n + 1, directions), -np.inf), np.full((2 * n + 1, directions), np.inf)
    for node in range(n):
        axis, value = int(splits[node, 0]), splits[node, 1]
        for child in (2 * node + 1, 2 * node + 2):
            low[child], high[child] = low[node], high[node]
        high[2 * node + 1, axis] = value
        low[2 * node + 2, axis] = value
    return low[n:], high[n:]


def away(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances from points to boxes."""
    gap = np.maximum(0, np.maximum(low[None] - points[:, None], points[:, None] - high[None]))
    return (gap**2).sum(axis=2)


def cosines(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines of one vector with rows, summed alike for equal rows."""
    return (rows * q).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((q * q).sum()))


def search_block(table: pa.Table, queries: pa.Table, k: int, factor: float) -> pa.Table:
    """The k nearest rows of a block for each query, by leaves of the block's tree until the test holds."""
    ids, raw, points = table["vec_id"].to_numpy(), matrix(table["v"]), matrix(table["p"])
    asked, of, at = queries["query_id"].to_numpy(), matrix(queries["v"]), matrix(queries["p"])
    reach = queries["reach"].to_numpy()  # squared distance of the k-th neighbour known so far
    out: list[tuple[int, int, float]] = []
    if len(ids) and len(asked):
        unit = raw / np.sqrt((raw * raw).sum(axis=1))[:, None]
        wanted = of / np.sqrt((of * of).sum(axis=1))[:, None]
        leaves, low, high = tree_of(points, LEAF)
        gaps = away(at, low, high)
        turn = np.argsort(gaps, axis=1, kind="stable")
        best = np.full((len(asked), k), np.inf)  # squared distances of the nearest, ascending
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in asked]
        every = np.arange(len(asked))
        going = every
        for step in range(len(leaves)):
            bound = np.minimum(reach[going], best[going, -1])
            going = going[gaps[going, turn[going, step]] <= factor * bound + SLACK]
            if not len(going):
                break
            here = turn[going, step]
            order = np.argsort(here, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(here[order])) + 1):
                rows, who = leaves[here[part[0]]], going[part]
                distance = np.maximum(0, 2 - 2 * (wanted[who] @ unit[rows].T))
                distance[ids[rows][None] == asked[who][:, None]] = np.inf
                limit = np.minimum(reach[who], best[who, -1])[:, None] + SLACK
                close = distance <= limit
                for i in np.flatnonzero(close.any(axis=1)):
                    j, near = who[i], np.flatnonzero(close[i])
                    found[j].append((rows[near], distance[i, near]))
                    best[j] = np.sort(np.concatenate([best[j], distance[i, near]]))[:k]
        for j in every:
            if found[j]:
                rows, distance = (np.concatenate(x) for x in zip(*found[j]))
                keep = (distance <= best[j, -1] + SLACK) & np.isfinite(distance)
                rows = rows[keep]
                scores = cosines(of[j], raw[rows])
                for m in np.lexsort((ids[rows], -scores))[:k]:
                    out.append((int(asked[j]), int(ids[rows[m]]), float(scores[m])))
    columns = list(zip(*out)) or [[], [], []]
    return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding",
    directions: int = DIRECTIONS, confidence: float = CONFIDENCE, cell: int = CELL, seed: int = 7,
) -> DataFrame:
    """query_id, rank, vec_id and score: for each query its k rows of largest cosine found, all others if fewer.

    queries is a subset of the rows of vectors. Ties go to the smaller vec_id. Vectors that are null, zero, or
    hold null or non-finite components take no part, nor do those of another length than most of vectors; a
    query isn't its own neighbour, nor is a repeated row with its id. Repeated ids count as rows of their own.
    """
    spark = vectors.sparkSession
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    base = usable(vectors, vec_id, embedding).filter(length > 0)
    width, n = common_length(base)
    base = base.filter(F.size("v") == width)
    sample = bounded_sample(base, "vec_id", SAMPLE, n).select("v").toArrow()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sample.num_rows:
        return spark.createDataFrame([], schema)
    rows = matrix(sample["v"])
    axes = np.random.default_rng(seed).standard_normal((rows.shape[1], directions))
    project = lambda m: (m / np.sqrt((m * m).sum(axis=1))[:, None]) @ axes
    depth = max(0, min(int(math.log2(SAMPLE)) - 2, math.ceil(math.log2(max(1, n / cell)))))  # a few sampled rows a cell at least
    splits = cells_of(project(rows), depth)
    low, high = boxes_of(splits, depth, directions) if depth else (np.full((1, directions), -np.inf), np.full((1, directions), np.inf))
    test = chi_square_quantile(confidence, directions)

    def located(batches):
        for batch in batches:
            v = matrix(batch.column(1))
            p = project(v) if len(v) else np.empty((0, directions))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), lists(p), pa.array(cell_of(p, splits, depth))], names=["vec_id", "v", "p", "cell"]
            )

    placed = materialize(base.select("vec_id", "v").mapInArrow(located, "vec_id long, v array<double>, p array<double>, cell long"), "placed-vectors")
    counts = placed.groupBy("cell").agg(F.ceil(F.count("*") / cell).cast("int").alias("blocks"))
    counts = materialize(counts, "cells")
    blocks = placed.join(counts, "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks").cast("long")).cast("int")).drop("blocks")
    asked = usable(queries, vec_id, embedding).filter((length > 0) & (F.size("v") == width)).select(F.col("vec_id"), "v").mapInArrow(located, placed.schema)
    asked = materialize(asked.withColumnRenamed("vec_id", "query_id"), "placed-queries")
    unit, n_asked = ["cell", "block", "slice"], asked.count()
    found = "query_id long, vec_id long, score double"

    def home(mine: pa.Table, asked: pa.Table) -> pa.Table:
        return search_block(mine, asked.append_column("reach", pa.array(np.full(asked.num_rows, np.inf))), k, test)

    at_home = asked.join(counts, "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks").cast("long")).cast("int")).drop("blocks")
    at_home, slices = in_slices(at_home, QUERIES, n_asked)
    first = for_slices(blocks, at_home, unit[:2], slices).groupBy(*unit).cogroup(at_home.groupBy(*unit)).applyInArrow(home, found)
    first = materialize(first, "hits-at-home")
    kth = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
    reach = F.when(F.col("n") >= k, F.greatest(F.lit(0.0), 2 - 2 * F.col("worst"))).otherwise(float("inf"))
    bound = materialize(kth.select(F.col("query_id").alias("of"), reach.alias("reach")), "reach")

    def routes(batches):
        for batch in batches:
            points, reaches = matrix(batch.column(2)), np.asarray(batch.column(3))
            together = max(1, 1_000_000 // len(low))  # queries whose distances to all cells are held at once
            for first in range(0, batch.num_rows, together):
                part = slice(first, first + together)
                row, cell = np.nonzero(away(points[part], low, high) <= test * reaches[part, None] + SLACK)
                for start in range(0, len(row), 20_000):
                    some = pa.array(row[start : start + 20_000] + first)
                    taken = [batch.column(c).take(some) for c in range(5)]
                    yield pa.RecordBatch.from_arrays([*taken, pa.array(cell[start : start + 20_000])], names=["query_id", "v", "p", "reach", "home", "cell"])

    bounded = asked.join(bound, F.col("query_id") == F.col("of"), "left").select("query_id", "v", "p", F.coalesce("reach", F.lit(float("inf"))).alias("reach"), F.col("cell").alias("home"))
    routed = bounded.mapInArrow(routes, "query_id long, v array<double>, p array<double>, reach double, home long, cell long")
    every_block = routed.join(counts, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    searched = (F.col("cell") == F.col("home")) & (F.col("block") == F.pmod(F.xxhash64("query_id"), F.col("blocks").cast("long")))
    every_block = every_block.filter(~searched).drop("blocks", "home")  # the first pass has found at least as much there

    def there(mine: pa.Table, asked: pa.Table) -> pa.Table:
        return search_block(mine, asked, k, test)

    every_block, slices = in_slices(every_block, QUERIES, n_asked)
    hits = for_slices(blocks, every_block, unit[:2], slices).groupBy(*unit).cogroup(every_block.groupBy(*unit)).applyInArrow(there, found).union(first)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
