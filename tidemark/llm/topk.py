"""Exact top-k inner products over vectors sorted by length.

Rows are dealt into bands of falling length. A query first meets the longest rows, which gives the score that its k-th
result has at least. It goes on to the bands whose longest row could reach that score by Cauchy-Schwarz.
Within a band, vectors are rotated by the right singular vectors of the data: the partial sum of the
leading coordinates plus the product of the residual lengths bounds the whole product, and only
rows whose bound reaches the score are multiplied out in full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize
from .vectors import common_length, for_slices, in_slices, matrix, usable

#: Bands of length at most, and rows that are searched together, about: at least and at most. Every block gets its own copy of the queries that reach it.
BANDS, BLOCK, LARGEST_BLOCK = 256, 4_096, 32_768
#: Queries that meet a block at once, about: a task holds no more of them and no more than a block's rows, however many there are.
QUERIES = 16_384
#: Share of all squared lengths that the leading rotated coordinates hold.
LEADING = 0.5
#: Queries that are multiplied together, and the share of pairs left by the bounds from which on all of a piece are.
TOGETHER, DENSE = 256, 0.05


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """Components as floor(scale * x)."""
    return vectors.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))


def rotation(vectors: DataFrame) -> tuple[np.ndarray, int]:
    """Right singular vectors of all rows, by falling singular value, and how many of them hold LEADING of the squared lengths."""

    def gram(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                m = matrix(batch.column(0))
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["k", "x"])

    sums = vectors.select("v").mapInArrow(gram, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).orderBy("k").toArrow()
    d = int(round(sums.num_rows**0.5))
    values, axes = np.linalg.eigh(sums["x"].to_numpy().reshape(d, d))
    values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
    held = np.cumsum(values) / max(values.sum(), 1e-300)
    return np.ascontiguousarray(axes), min(d, int(np.searchsorted(held, LEADING)) + 1)


def best_of(ids: np.ndarray, rows: np.ndarray, asked: np.ndarray, of: np.ndarray, least: np.ndarray, k: int, axes: np.ndarray, lead: int) -> tuple[np.ndarray, ...]:
    """query_id, vec_id and score of each query's k best rows that reach its least score."""
    norms = np.sqrt((rows * rows).sum(axis=1))
    order = np.lexsort((ids, -norms))
    ids, rows, norms = ids[order], rows[order], norms[order]
    turned, turned_q = rows @ axes, of @ axes
    rest = np.sqrt((turned[:, lead:] ** 2).sum(axis=1))
    rest_q = np.sqrt((turned_q[:, lead:] ** 2).sum(axis=1))
    norms_q = np.sqrt((of * of).sum(axis=1))
    out = []
    for start in range(0, len(asked), TOGETHER):
        part = slice(start, start + TOGETHER)
        mine, q, low = asked[part], of[part], least[part].copy()
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in mine]
        for at in range(0, len(ids), 512):
            piece = slice(at, at + 512)
            going = np.flatnonzero(norms_q[part] * norms[at] + 0.5 >= low)  # rows from here on are no longer than this one
            if not len(going):
                break
            bound = turned_q[part][going, :lead] @ turned[piece, :lead].T + rest_q[part][going, None] * rest[None, piece]
            reach = bound + 0.5 >= low[going][:, None]  # products are whole numbers: half of one covers rounding
            pairs = np.count_nonzero(reach)
            if not pairs:
                continue
            if pairs > DENSE * reach.size:  # so many are left that multiplying them out one by one would take longer
                product = np.rint(q[going] @ rows[piece].T)
                who, what = np.nonzero(reach & (product >= low[going][:, None]))
                exact = product[who, what]
            else:
                who, what = np.nonzero(reach)
                exact = np.rint(np.einsum("ij,ij->i", q[going][who], rows[piece][what]))
            use = (exact >= low[going][who]) & (ids[piece][what] != mine[going][who])
            who, what, exact = going[who[use]], what[use], exact[use]
            cuts = np.searchsorted(who, np.arange(len(mine) + 1))
            for j in np.unique(who):
                a, b = cuts[j], cuts[j + 1]
                held[j].append((ids[piece][what[a:b]], exact[a:b]))
                if sum(len(x) for x, _ in held[j]) >= k:
                    i, s = (np.concatenate(x) for x in zip(*held[j]))
                    top = np.lexsort((i, -s))[:k]
                    held[j] = [(i[top], s[top])]
                    low[j] = max(low[j], s[top][-1])
        for j, parts in enumerate(held):
            if parts:
                i, s = (np.concatenate(x) for x in zip(*parts))
                top = np.lexsort((i, -s))[:k]
                out.append((np.full(len(top), mine[j]), i[top], s[top]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, dtype=np.int64),) * 2 + (np.empty(0),)


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score (long): for each query its k rows of largest inner product of floor(scale * x), all others if fewer.

    queries is a subset of the rows of vectors. Exact, ties to the smaller vec_id. Vectors that are null or
    hold null or non-finite components take no part, nor do those of another length than most of vectors; zero
    vectors do. A query isn't its own result, nor is a repeated row with its id.
    """
    spark = vectors.sparkSession
    base = usable(vectors, vec_id, embedding)
    width, n = common_length(base)
    base = integers(base.filter(F.size("v") == width), scale)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    base = materialize(base.withColumn("norm", norm), "integer-vectors")
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    axes, lead = rotation(base)
    block_rows = max(BLOCK, min(LARGEST_BLOCK, n // BANDS))
    n_bands = max(1, min(BANDS, -(-n // block_rows)))
    cuts = sorted(set(base.approxQuantile("norm", [i / n_bands for i in range(1, n_bands)], 0.2 / n_bands))) if n_bands > 1 else []
    edges = np.array(cuts)

    def banded(batches):
        for batch in batches:  # band 0 holds the longest rows
            band = len(edges) - np.searchsorted(edges, batch.column(2).to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(band.astype(np.int64))], names=["vec_id", "v", "norm", "band"])

    rows = base.mapInArrow(banded, "vec_id long, v array<double>, norm double, band long")
    counts = materialize(rows.groupBy("band").agg(F.max("norm").alias("longest"), F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")), "bands")
    blocks = rows.join(counts.select("band", "blocks"), "band").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks").cast("long")).cast("int"))
    blocks = blocks.select("band", "block", "vec_id", "v")
    asked = integers(usable(queries, vec_id, embedding).filter(F.size("v") == width), scale).select(F.col("vec_id").alias("query_id"), "v", norm.alias("norm"))
    asked = materialize(asked, "integer-queries")
    asked, slices = in_slices(asked, QUERIES, asked.count())
    found = "query_id long, vec_id long, score long"

    def search(mine: pa.Table, asked: pa.Table) -> pa.Table:
        q, i, s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if mine.num_rows and asked.num_rows:
            q, i, s = best_of(
                mine["vec_id"].to_numpy(), matrix(mine["v"]), asked["query_id"].to_numpy(), matrix(asked["v"]), asked["least"].to_numpy(), k, axes, lead
            )
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s.astype(np.int64))})

    nothing = F.lit(float("-inf"))
    longest = [(r["band"], r["longest"], r["blocks"]) for r in counts.orderBy("band").collect()]  # BANDS rows at most
    block = F.pmod(F.xxhash64("query_id"), F.lit(longest[0][2]).cast("long")).cast("int")
    start = asked.select(F.lit(longest[0][0]).cast("long").alias("band"), block.alias("block"), "slice", "query_id", "v", nothing.alias("least"))
    unit = ["band", "block", "slice"]
    first = for_slices(blocks, start, unit[:2], slices).groupBy(*unit).cogroup(start.groupBy(*unit)).applyInArrow(search, found)
    kth = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
    kth = materialize(kth.filter(F.col("n") >= k).select(F.col("query_id").alias("of"), F.col("worst").cast("double").alias("least")), "least-scores")
    bands = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(float(m)).alias("longest"), F.lit(s).alias("blocks")) for b, m, s in longest])
    bounded = asked.join(kth, F.col("query_id") == F.col("of"), "left").withColumn("least", F.coalesce("least", nothing))
    reached = F.filter(bands, lambda b: b["longest"] * F.col("norm") + 0.5 >= F.col("least"))
    routed = bounded.withColumn("b", F.explode(reached)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("b.blocks") - 1)))
    routed = routed.select(F.col("b.band").cast("long").alias("band"), "block", "slice", "query_id", "v", "least")
    hits = for_slices(blocks, routed, unit[:2], slices).groupBy(*unit).cogroup(routed.groupBy(*unit)).applyInArrow(search, found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
