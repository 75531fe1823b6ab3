"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Trained on labelled rows only. Hashed n-grams of 3 to 5 characters (code points) of the lower-cased text are counted
by class over the training sample. Those whose counts differ significantly between the classes are the features, each
scaled by the log ratio of its smoothed rates, and a logistic regression is fitted on their presence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_sample, materialize

#: Labelled rows that the classifier is fitted on at most: those with the smallest hashes of doc_id.
MAX_TRAINING_ROWS = 20_000
ORDERS = (3, 4, 5)
BITS = 20
CHUNK = 1 << 14
#: Chance that any bucket at all counts as a feature without cause (a chi-square test for each, by Bonferroni).
SIGNIFICANCE = 0.05


@dataclass(frozen=True)
class ToxicityModel:
    """buckets: hashed n-grams; ratios: their log-count ratios; weights: learned weights times ratios."""

    buckets: np.ndarray
    ratios: np.ndarray
    weights: np.ndarray
    bias: float

    def places(self) -> np.ndarray:
        """The feature of each bucket, -1 for none."""
        return places(self.buckets)

    def scores(self, texts: Iterator[str | None], place: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each whole text."""
        sums = [self.weights[present(t, place)].sum() for t in texts]
        return 1 / (1 + np.exp(-np.clip(np.array(sums, dtype=np.float64) + self.bias, -500, 500)))


def places(buckets: np.ndarray) -> np.ndarray:
    place = np.full(1 << BITS, -1, dtype=np.int32)
    place[buckets] = np.arange(len(buckets), dtype=np.int32)
    return place


def hashed(text: str | None) -> np.ndarray:
    """Buckets of all n-grams of code points of the lower-cased text, white space as single spaces."""
    raw = f" {' '.join((text or '').lower().split())} ".encode("utf-32-le", "replace")
    codes = np.frombuffer(raw, dtype="<u4").astype(np.uint64)
    out, gram = [], codes
    with np.errstate(over="ignore"):
        for order in range(2, max(ORDERS) + 1):
            if len(codes) < order:
                break
            gram = gram[:-1] * np.uint64(0x100000001B3) + codes[order - 1 :]
            if order in ORDERS:
                out.append((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS))
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, dtype=np.int64)


def present(text: str | None, place: np.ndarray) -> np.ndarray:
    """The features that occur in the text."""
    found = place[hashed(text)]
    return np.unique(found[found >= 0])


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, significance: float = SIGNIFICANCE,
    text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
) -> ToxicityModel:
    """Fits the classifier on docs(doc_id, text) that labels(doc_id, toxic 0/1) marks.

    Null ids and null labels take no part; an id labelled both ways counts as toxic; of repeated
    ids the smallest text is used. Without both classes, or without a significant n-gram, the model is a constant.
    """
    marked = labels.select(F.col(f"`{doc_id}`").alias("of"), F.col(f"`{label}`").alias("toxic"))
    marked = marked.filter(F.col("of").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("of")
    sample = bounded_sample(marked.agg(F.max("toxic").cast("int").alias("toxic")), "of", max_rows)
    sample = materialize(sample, "toxicity-labels")
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(sample), F.col("id") == F.col("of"))  # max_rows short rows at most
    texts = materialize(texts.groupBy("of", "toxic").agg(F.min("text").alias("text")), "toxicity-texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, some = np.zeros((2, 1 << BITS), dtype=np.int32), False
        for batch in batches:
            for mark, t in zip(batch.column(0), batch.column(1)):
                counts[mark.as_py(), np.unique(hashed(t.as_py()))] += 1
                some = True
        if some:
            cut = counts.reshape(2, -1, CHUNK)
            chunks = [(k, cut[1, k].tobytes(), cut[0, k].tobytes()) for k in range(cut.shape[1])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*chunks)], names=["chunk", "toxic", "other"])

    sizes = {row["toxic"]: row["count"] for row in texts.groupBy("toxic").count().collect()}
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    prior = float(np.log((n_toxic + 1) / (n_other + 1)))
    constant = ToxicityModel(np.empty(0, dtype=np.int64), np.empty(0), np.empty(0), prior)
    if not n_toxic or not n_other:
        return constant
    least = NormalDist().inv_cdf(1 - significance / (1 << BITS) / 2) ** 2

    def telling(frame: pd.DataFrame) -> pd.DataFrame:
        with_it = np.stack([sum(np.frombuffer(x, dtype=np.int32).astype(np.float64) for x in frame[c]) for c in ("toxic", "other")])
        all_of = np.array([[n_toxic], [n_other]], dtype=np.float64)
        expected = with_it.sum(0) * all_of / all_of.sum()
        rest = all_of.sum() - with_it.sum(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            chi = ((with_it - expected) ** 2 / expected + (with_it - expected) ** 2 / (rest * all_of / all_of.sum())).sum(0)
        significant = np.flatnonzero(np.nan_to_num(chi, nan=0.0, posinf=0.0) > least)
        ratio = np.log((with_it[0] + 1) / (n_toxic + 2)) - np.log((with_it[1] + 1) / (n_other + 2))
        return pd.DataFrame({"bucket": frame["chunk"].iloc[0] * CHUNK + significant, "ratio": ratio[significant]})

    counted = texts.select("toxic", "text").mapInArrow(count, "chunk long, toxic binary, other binary")
    kept = counted.groupBy("chunk").applyInPandas(telling, "bucket long, ratio double").orderBy("bucket").toPandas()  # 2 ** BITS rows at most
    if not len(kept):
        return constant
    buckets, ratios = kept["bucket"].to_numpy(), kept["ratio"].to_numpy()
    place, short = places(buckets), np.dtype("u2" if len(buckets) <= 1 << 16 else "i4")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [present(t.as_py(), place).astype(short).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["of", "toxic", "found"])

    schema = f"of {texts.schema['of'].dataType.simpleString()}, toxic int, found binary"
    data = texts.select("of", "toxic", "text").mapInArrow(rows, schema).orderBy(F.xxhash64("of"), "of").toPandas()  # max_rows short rows at most
    found = [np.frombuffer(x, dtype=short) for x in data["found"]]
    toxic = data["toxic"].to_numpy(dtype=np.float64)
    del data
    weights, bias = logistic(found, ratios, toxic, prior)
    return ToxicityModel(buckets, ratios, weights * ratios, bias)


def logistic(found: list[np.ndarray], scale: np.ndarray, y: np.ndarray, bias: float, penalty: float = 1.0, steps: int = 40) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on features that are scale[k] where k is in found and 0 elsewhere; the bias goes without penalty.

    Newton's steps are solved by conjugate gradients over the entries that aren't 0, kept by row and by feature.
    """
    columns, lengths = np.concatenate(found), np.array([len(x) for x in found])
    values, rows = scale[columns], np.repeat(np.arange(len(found), dtype=np.int32), lengths)
    order = np.argsort(columns, kind="stable")
    of_feature, by_feature = rows[order], values[order]
    counts = np.bincount(columns, minlength=len(scale))

    def sums(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out, some = np.zeros(len(sizes)), sizes > 0
        if some.any():
            out[some] = np.add.reduceat(x, (np.cumsum(sizes) - sizes)[some])
        return out

    times = lambda w: sums(values * w[:-1][columns], lengths) + w[-1]
    back = lambda r: np.append(sums(by_feature * r[of_feature], counts), r.sum())
    ridge, sign = np.append(np.full(len(scale), penalty), 1e-6), 2 * y - 1
    w = np.append(np.zeros(len(scale)), bias)
    margins = times(w)
    loss = lambda m, w: np.logaddexp(0, -sign * m).sum() + (ridge * w * w).sum() / 2
    held = loss(margins, w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(margins, -30, 30)))
        curvature = np.maximum(p * (1 - p), 1e-9)
        diagonal = np.append(sums(by_feature**2 * curvature[of_feature], counts), curvature.sum()) + ridge
        step, residual = np.zeros(len(w)), -(back(p - y) + ridge * w)
        direction = z = residual / diagonal
        rz = residual @ z
        goal = rz / 100
        for _ in range(50):
            moved = back(curvature * times(direction)) + ridge * direction
            length = rz / (direction @ moved)
            step, residual = step + length * direction, residual - length * moved
            z = residual / diagonal
            was, rz = rz, residual @ z
            if rz <= goal:
                break
            direction = z + rz / was * direction
        along, size = times(step), 1.0
        while size > 1e-4 and loss(margins + size * along, w + size * step) > held:
            size /= 2
        w, margins, before = w + size * step, margins + size * along, held
        held = loss(margins, w)
        if before - held <= 1e-3 * held:
            break
    return w[:-1], float(w[-1])


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Adds toxicity (double, 0 to 1) to docs, in place of a column of that name.

    Null and empty texts are scored as texts without words; other columns pass unchanged.
    """
    others = [c for c in docs.columns if c != "toxicity"]
    frame = docs.select(*[F.col(f"`{c}`") for c in others])
    if dict(docs.dtypes)[text] != "string" or text not in others:  # else the text isn't sent to Python twice
        frame = docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").cast("string").alias("__text"))
    at = others.index(text) if len(frame.columns) == len(others) else len(others)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "toxicity"] + ["toxicity double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = model.places()
        for batch in batches:
            scores = model.scores((t.as_py() for t in batch.column(at)), place)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(scores, pa.float64())], names=[*others, "toxicity"])

    return frame.mapInArrow(run, schema)
