"""Hard negatives by a Voronoi-partitioned, distributed exact nearest-neighbour join.

Vectors get one coordinate more, so that all are equally long; with zero there, the anchors' largest inner products are then
their nearest rows. Rows and anchors are assigned to the nearest of a few pivots. Anchors of neighbouring pivots form groups; the
distances of a group's anchors to each pivot, and how far they have to look, bound which rows can serve one of them
(triangle inequality on the row's own distance to its pivot). Only such rows are copied to a group; group and rows
meet in blocks of bounded size, each joined exactly on whole numbers.

Positives are a first join within a label; their scores tell how far the second one, for negatives, has to look.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_sample, materialize
from .topk import integers
from .vectors import common_length, lists, matrix, usable

#: Pivots at most, rows of a pivot that are aimed at, and rows of the sample that pivots are fitted on.
PIVOTS, CELL, SAMPLE = 256, 4_096, 4_096
#: Anchors of a group and rows of a block, about; no task holds more than one of each. Anchors that are multiplied together.
GROUP, BLOCK, TOGETHER = 4_096, 16_384, 64


def fitted_pivots(sample: np.ndarray, count: int, steps: int = 4) -> np.ndarray:
    """Means of count parts of a sample, each row being in the part of its nearest mean; fewer if the sample has fewer different rows."""
    different = np.unique(sample, axis=0)
    pivots = different[np.random.default_rng(13).permutation(len(different))[:count]].astype(float)
    for _ in range(steps):
        near = distances(sample, pivots).argmin(axis=1)
        for k in np.unique(near):
            pivots[k] = sample[near == k].mean(axis=0)
    return pivots


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of every row of a to every row of b."""
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0))


def neighbourhoods(pivots: np.ndarray, weights: np.ndarray, parts: int) -> np.ndarray:
    """A number below parts for each pivot: the pivots are halved by weight along their longest axis until there are so many parts."""
    out, todo, made = np.zeros(len(pivots), dtype=np.int64), [np.arange(len(pivots))], 1
    while made < parts and (big := max(todo, key=lambda p: (len(p) > 1) * weights[p].sum())).size > 1:
        axis = np.linalg.svd(pivots[big] - pivots[big].mean(axis=0), full_matrices=False)[2][0]
        order = big[np.argsort(pivots[big] @ axis, kind="stable")]
        half = np.clip(np.searchsorted(np.cumsum(weights[order]), weights[order].sum() / 2) + 1, 1, len(order) - 1)
        todo = [p for p in todo if p is not big] + [order[:half], order[half:]]
        made += 1
    for k, p in enumerate(todo):
        out[p] = k
    return out


def first_k(scores: np.ndarray, k: int) -> np.ndarray:
    """Mask of each row's k largest scores above -inf, of equal ones the first."""
    if scores.shape[1] <= k:
        return scores > -np.inf
    least = np.partition(scores, -k, axis=1)[:, -k, None]
    above, equal = scores > least, (scores == least) & (scores > -np.inf)
    return above | equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True))


def results(query_id: np.ndarray, vec_id: np.ndarray, score: np.ndarray, **more: np.ndarray) -> pa.Table:
    """A table of results, with more columns after the first."""
    return pa.table({"query_id": query_id} | more | {"vec_id": vec_id, "score": score.astype(np.int64)})


def best_of_block(anchors: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """query_id, vec_id and score of each anchor's k best other rows."""
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    if not anchors.num_rows or not rows.num_rows:
        return results(*out[0])
    order = np.argsort(rows["vec_id"].to_numpy(), kind="stable")
    ids, v = rows["vec_id"].to_numpy()[order], matrix(rows["v"])[order]
    mine, of = anchors["query_id"].to_numpy(), matrix(anchors["q"])
    for at in range(0, len(mine), TOGETHER):
        asked = mine[at : at + TOGETHER]
        scores = np.rint(of[at : at + TOGETHER] @ v.T)
        scores[asked[:, None] == ids] = -np.inf
        who, what = np.nonzero(first_k(scores, k))
        out.append((asked[who], ids[what], scores[who, what]))
    return results(*(np.concatenate(x) for x in zip(*out)))


def negatives_of_block(anchors: pa.Table, rows: pa.Table, k: int, least: tuple[int, int]) -> pa.Table:
    """query_id, place, vec_id and score: for each of an anchor's positive scores its k best rows of other labels up to that score and from its part `least` on."""
    out = [(np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0))]
    if not anchors.num_rows or not rows.num_rows:
        return results(out[0][0], out[0][2], out[0][3], place=out[0][1])
    order = np.argsort(rows["vec_id"].to_numpy(), kind="stable")
    ids, v = rows["vec_id"].to_numpy()[order], matrix(rows["v"])[order]
    # labels are compared by number
    known, code = np.unique(np.concatenate([rows["label"].to_numpy(zero_copy_only=False), anchors["label"].to_numpy(zero_copy_only=False)]), return_inverse=True)
    labels, own = code[: len(ids)][order], code[len(ids) :]
    mine, of, positives = anchors["query_id"].to_numpy(), matrix(anchors["q"]), anchors["scores"].to_pylist()
    low = np.array([-(-min(p) * least[0] // least[1]) for p in positives], dtype=float)
    high = np.array([max(p) for p in positives], dtype=float)
    for at in range(0, len(mine), TOGETHER):
        part = slice(at, at + TOGETHER)
        scores = np.rint(of[part] @ v.T)
        who, what = np.nonzero((scores >= low[part, None]) & (scores <= high[part, None]) & (labels != own[part, None]))
        s = scores[who, what]
        order = np.lexsort((what, -s, who))
        who, what, s = who[order], what[order], s[order]
        cuts = np.searchsorted(who, np.arange(len(mine[part]) + 1))
        for j in np.unique(who):
            span = slice(cuts[j], cuts[j + 1])
            p = np.array(positives[at + j])
            starts = np.searchsorted(-s[span], -p)
            ends = np.minimum(np.searchsorted(-s[span], least[0] * -p / least[1], side="right") + 1, cuts[j + 1] - cuts[j])
            for place, (a, b) in enumerate(zip(starts, np.minimum(ends, starts + k))):
                fits = np.arange(a, b)
                fits = fits[least[0] * p[place] <= least[1] * s[span][fits]]  # whole numbers: exact
                if len(fits):
                    out.append((np.full(len(fits), mine[at + j]), np.full(len(fits), place, np.int32), ids[what[span][fits]], s[span][fits]))
    q, t, i, s = (np.concatenate(x) for x in zip(*out))
    return results(q, i, s, place=t)


def grouped(anchors: DataFrame, homes: np.ndarray) -> DataFrame:
    """Anchors(scope, cell, …) with their group: scope, home (of their cell) and slice, so many that one holds about GROUP anchors at most."""
    home = F.element_at(F.array(*[F.lit(int(h)) for h in homes]), F.col("cell") + 1)
    rows = anchors.withColumn("home", home)
    counts = rows.groupBy("scope", "home").agg(F.ceil(F.count("*") / GROUP).cast("long").alias("slices"))
    return rows.join(counts, ["scope", "home"]).withColumn("slice", F.pmod(F.xxhash64("query_id"), F.col("slices")).cast("int")).drop("slices")


def anew(frame: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """Columns of a frame, the keys under new identities, for a cogroup with a frame that they come from as well."""
    return frame.select(*[F.col(c).alias(c) for c in keys], *more)


def served(rows: DataFrame, anchors: DataFrame, bounds: DataFrame, search: Callable[[pa.Table, pa.Table], pa.Table], schema: str, slack: float) -> DataFrame:
    """Results of search(anchors of a group, block of rows that may serve it) over all such pairs.

    rows(scope, cell, gap, vec_id, …) meet bounds(scope, home, slice, cell, low, high, reach, near): the range of the distances of
    the group's anchors to the pivot of a cell, how far the group looks, and how near rows are of use.
    """
    group, pair = ["scope", "home", "slice"], ["scope", "home", "slice", "cell", "block"]
    in_cell = rows.groupBy("scope", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"), F.min("gap").alias("least"), F.max("gap").alias("most"))
    in_cell = materialize(in_cell, "cells")
    low, high, reach = F.col("low"), F.col("high"), F.col("reach") + slack
    useful = bounds.join(in_cell, ["scope", "cell"]).filter((low - F.col("most") <= reach) & (F.col("least") - high <= reach) & (high + F.col("most") >= F.col("near") - slack))
    useful = useful.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))).select(*group, "cell", "block", "low", "high", "reach", "near")
    useful = materialize(useful, "routes")
    dealt = rows.join(in_cell.select("scope", "cell", "blocks"), ["scope", "cell"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).drop("blocks")
    gap = F.col("gap")
    copies = dealt.join(useful, ["scope", "cell", "block"]).filter((low - gap <= reach) & (gap - high <= reach) & (high + gap >= F.col("near") - slack))
    copies = anew(copies, pair, "vec_id", "label", "v")
    asked = anchors.drop("cell").join(useful.select(*pair), group)
    return asked.groupBy(*pair).cogroup(copies.groupBy(*pair)).applyInArrow(search, schema)


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, scale: int = 256, least: tuple[int, int] = (80, 100),
    vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cell: int = CELL,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score (long) for anchors among the rows of vectors.

    Scores are inner products of floor(scale * x). An anchor's positives are its first other rows of its label by falling score, then
    rising id; to each come the first rows of other labels, in the same order, whose score is at most the positive's and at least the part
    least[0] / least[1] of it, so a positive of a score below zero has none. Rows with a null id or label, null vectors, vectors with null or
    non-finite components and those of another length than most take no part; zero vectors do. Rows of an anchor's own id are never its
    positives or negatives; repeated rows of another id count one by one; an anchor's id that comes repeatedly is one anchor, of
    the smallest label and vector. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"

    def of(frame: DataFrame) -> DataFrame:
        kept = frame.filter(F.col(f"`{label}`").isNotNull()).withColumn("__label", F.col(f"`{label}`").cast("string"))
        return usable(kept, vec_id, embedding, "__label").withColumnRenamed("__label", "label")

    base = of(vectors)
    width, n = common_length(base)
    if not n:
        return spark.createDataFrame([], result)
    base = integers(base.filter(F.size("v") == width), scale)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    base = materialize(base.withColumn("square", square), "labelled-vectors")
    largest = base.agg(F.max("square")).first()[0]
    asked = integers(of(anchors).filter(F.size("v") == width), scale).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row"))
    asked = asked.select("vec_id", "row.*").withColumn("square", F.lit(largest))  # the coordinate that anchors get is zero

    def augmented(v: np.ndarray, square: np.ndarray) -> np.ndarray:
        return np.column_stack([v, np.sqrt(np.maximum(largest - square, 0))])

    some = bounded_sample(base, "vec_id", SAMPLE, n).select("v", "square").toArrow()
    pivots = fitted_pivots(augmented(matrix(some["v"]), some["square"].to_numpy()), int(min(PIVOTS, max(1, -(-n // cell)))))

    def placed(batches):
        for batch in batches:
            if batch.num_rows:
                d = distances(augmented(matrix(batch.column(2)), batch.column(3).to_numpy()), pivots)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near])], names=["vec_id", "label", "v", "cell", "gap"])

    layout = "vec_id long, label string, v array<double>, cell int, gap double"
    rows = materialize(base.select("vec_id", "label", "v", "square").mapInArrow(placed, layout), "placed-rows")
    asked = materialize(asked.select("vec_id", "label", "v", "square").mapInArrow(placed, layout), "placed-anchors").withColumnsRenamed({"vec_id": "query_id", "v": "q"}).drop("gap")
    weight = np.zeros(len(pivots))
    for r in asked.groupBy("cell").count().collect():  # a row a pivot
        weight[r["cell"]] = r["count"]
    labels = max(1, rows.agg(F.approx_count_distinct("label")).first()[0])
    slack = 1e-6 * (1 + largest**0.5)

    # positives: within a label, as far as the nearest known rows of the label are by way of their pivots
    homes = neighbourhoods(pivots, weight, int(-(-weight.sum() // (GROUP * labels))) or 1)
    of_label = grouped(asked.withColumn("scope", F.col("label")), homes)
    of_label = materialize(of_label, "anchors-by-label")
    order = Window.partitionBy("scope", "cell").orderBy("gap", "vec_id")
    own = rows.withColumn("scope", F.col("label"))
    nearest = own.select("scope", "cell", "gap", "vec_id").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= positives + 1)
    groups = of_label.groupBy("scope", "home", "slice").agg(F.count("*").alias("n")).drop("n")
    known = anew(groups.join(nearest, "scope"), ["scope", "home", "slice"], "cell", "gap", "vec_id")
    key, bounded = ["scope", "home", "slice"], "scope string, home int, slice int, cell int, low double, high double, reach double, near double"

    def table_of(key: pa.Table, d: np.ndarray, reach: float, near: float) -> pa.Table:
        m = len(pivots)
        first = [pa.array([key[c][0].as_py()] * m, t) for c, t in (("scope", pa.string()), ("home", pa.int32()), ("slice", pa.int32()))]
        last = [pa.array(np.arange(m, dtype=np.int32)), pa.array(d.min(axis=0)), pa.array(d.max(axis=0)), pa.array(np.full(m, float(reach))), pa.array(np.full(m, float(near)))]
        return pa.Table.from_arrays([*first, *last], names=["scope", "home", "slice", "cell", "low", "high", "reach", "near"])

    def to_pivots(anchors: pa.Table) -> np.ndarray:
        q = matrix(anchors["q"])
        return distances(np.column_stack([q, np.zeros(len(q))]), pivots)

    nothing = pa.table({"scope": pa.array([], pa.string()), "home": pa.array([], pa.int32()), "slice": pa.array([], pa.int32()), "cell": pa.array([], pa.int32())} | {c: pa.array([], pa.float64()) for c in ("low", "high", "reach", "near")})

    def bounds_of_positives(anchors: pa.Table, known: pa.Table) -> pa.Table:
        if not anchors.num_rows:
            return nothing
        d, ids = to_pivots(anchors), anchors["query_id"].to_numpy()
        reach = np.full(len(ids), np.inf)
        if known.num_rows:
            by_way = d[:, known["cell"].to_numpy()] + known["gap"].to_numpy()
            by_way[ids[:, None] == known["vec_id"].to_numpy()] = np.inf
            if known.num_rows >= positives:
                reach = np.partition(by_way, positives - 1, axis=1)[:, positives - 1]
        return table_of(anchors, d, reach.max(), 0.0)

    bounds = of_label.groupBy(*key).cogroup(known.groupBy(*key)).applyInArrow(bounds_of_positives, bounded)
    hits = served(own, of_label, bounds, lambda a, b: best_of_block(a, b, positives), "query_id long, vec_id long, score long", slack)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = hits.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives)
    found = materialize(found.filter("score >= 0"), "positives")  # none reaches its part of a score below zero

    # negatives: among all labels, as far as the least of an anchor's positives asks for
    homes = neighbourhoods(pivots, weight, int(-(-weight.sum() // GROUP)) or 1)
    theirs = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda x: x["score"]).alias("scores"))  # `positives` of them at most
    every = materialize(grouped(asked.join(theirs, "query_id").withColumn("scope", F.lit("")), homes), "anchors-with-positives")

    def bounds_of_negatives(anchors: pa.Table) -> pa.Table:
        d, q = to_pivots(anchors), matrix(anchors["q"])
        whole = (q * q).sum(axis=1) + largest
        least_score = np.array([min(p) for p in anchors["scores"].to_pylist()]) * least[0] / least[1]
        most_score = np.array([max(p) for p in anchors["scores"].to_pylist()])
        reach, near = (np.sqrt(np.maximum(whole - 2 * s, 0)) for s in (least_score, most_score))
        return table_of(anchors, d, reach.max(), near.min())

    bounds = every.groupBy(*key).applyInArrow(bounds_of_negatives, bounded)
    hits = served(
        rows.withColumn("scope", F.lit("")), every, bounds, lambda a, b: negatives_of_block(a, b, negatives, least), "query_id long, place int, vec_id long, score long", slack
    )
    best = Window.partitionBy("query_id", "place").orderBy(F.desc("score"), "vec_id")
    hits = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    chosen = found.select(F.col("query_id").alias("anchor_id"), (F.col("place") - 1).alias("at"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hits.join(chosen, (F.col("query_id") == F.col("anchor_id")) & (F.col("place") == F.col("at")))
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
