"""States folded from events: leases, budgets, stages, pointers, and what changed between two versions of a table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.runs import in_runs, same, with_previous, with_summaries
from tidemark.sources.scratch import stored


def lease_state(last_kind: Column, age: Column, failures: Column, lease: int, base: int, most: int) -> Column:
    """idle, claimed, expired or backoff of a lane, from its last event (claim, beat, done, fail), its age in seconds and failures in a row."""
    wait = F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), F.least(F.greatest(failures - 1, F.lit(0)), F.lit(20))))
    held = last_kind.isin("claim", "beat")
    return F.when(held & (age < lease), "claimed").when(held, "expired").when((last_kind == "fail") & (age < wait), "backoff").otherwise("idle")


def failures_in_a_row(frame: DataFrame, keys: list[str], order: list[str], failed: Column) -> DataFrame:
    """keys and failures: how many failed rows follow the last that didn't fail. Two aggregates; no key is sorted."""
    rank = F.struct(*order)
    last_good = frame.filter(~failed).groupBy(*keys).agg(F.max(rank).alias("__good"))
    bad = frame.filter(failed).join(last_good, keys, "left").filter(F.col("__good").isNull() | (rank > F.col("__good")))
    return bad.groupBy(*keys).agg(F.count("*").alias("failures"))


def outcome(amounts: list, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """What a row of requests takes of any amount that is left: from each start (the first is 0) up to the next one it takes the same total.

    A request splits the range that it fits for a part of only, so there are as many parts as different totals, never more than cap + 1.
    """
    starts, taken = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    for x in amounts:
        if not (0 < x <= cap):
            continue  # takes nothing
        need = x + taken  # of what was left at first
        ends = np.append(starts[1:], cap + 1)
        cut = (need > starts) & (need < ends)
        taken = np.where(need <= starts, taken + x, taken)
        if cut.any():
            at = np.flatnonzero(cut) + 1
            starts, taken = np.insert(starts, at, need[cut]), np.insert(taken, at, taken[cut] + x)
    same = np.append(True, taken[1:] != taken[:-1])
    return starts[same], taken[same]


def admitted(requests: DataFrame, keys: list[str], order: list[str], amount: str, cap: int, spent: DataFrame | None = None) -> DataFrame:
    """Adds admitted: whether a request fits in what its key's earlier admitted ones have left of the cap; those that don't fit are passed over.

    A key's requests lie in runs. Where they lie in several, each run's part of them is a chunk: chunks are summarised at once as what they take of any amount that
    is left (outcome), and the summaries are gone through in order, which tells what is left for each chunk. Then all runs are replayed at once, each with all
    the keys in it. Amounts are whole numbers; null and negative ones are refused, zero is admitted. spent(*keys, spent): what keys have spent before.
    """
    runs = in_runs(requests.withColumn("__x", F.coalesce(F.col(amount).cast("long"), F.lit(-1))), keys, [F.col(c).asc_nulls_first() for c in order])
    columns, of_key = requests.columns, ", ".join(f"`{k}` {runs.schema[k].dataType.simpleString()}" for k in keys)
    before = F.lit(0).cast("long") if spent is None else F.coalesce(F.col("s.spent").cast("long"), F.lit(0))
    known = lambda frame: frame if spent is None else frame.alias("r").join(spent.alias("s"), same(keys, "r", "s"), "left")

    def summarise(key: tuple, chunk: pa.Table) -> pa.Table:
        starts, taken = outcome(chunk.sort_by("__at")["__x"].to_pylist(), cap)
        return pa.table({k: pa.array([v.as_py()], v.type) for k, v in zip([*keys, "__run"], key)} | {"starts": pa.array([starts]), "taken": pa.array([taken])})

    def go_through(key: tuple, chunks: pa.Table) -> pa.Table:
        chunks = chunks.sort_by("__run")
        left, lefts = cap - chunks["__before"][0].as_py(), []
        for starts, taken in zip(chunks["starts"].to_pylist(), chunks["taken"].to_pylist()):
            lefts.append(left)
            left -= taken[np.searchsorted(starts, left, side="right") - 1] if left >= 0 else 0
        return chunks.select([*keys, "__run"]).append_column("__left", pa.array(lefts, pa.int64()))

    def replay(run: pa.Table) -> pa.Table:
        run = run.sort_by("__at")
        fits, last, left = [], None, 0
        for x, first, whole in zip(run["__x"].to_pylist(), run["__first"].to_pylist(), run["__left"].to_pylist()):
            if first != last:  # another key begins
                last, left = first, whole
            fits.append(0 <= x <= left)
            left -= x if fits[-1] else 0
        return run.select(columns).append_column("admitted", pa.array(fits, pa.bool_()))

    of_run = runs.groupBy(*keys, "__run").agg(F.min("__at").alias("__first"))
    split = of_run.groupBy(*keys).agg(F.count("*").alias("__runs")).filter("__runs > 1").drop("__runs")  # no more than there are runs
    chunks = runs.alias("r").join(split.alias("s"), same(keys, "r", "s"), "left_semi").groupBy(*keys, "__run").applyInArrow(summarise, f"{of_key}, __run int, starts array<long>, taken array<long>")
    chunks = known(chunks).select(*[F.col(f"r.{c}" if spent is not None else c) for c in chunks.columns], before.alias("__before"))
    lefts = stored(chunks.groupBy(*keys).applyInArrow(go_through, f"{of_key}, __run int, __left long"), "left-of-caps")
    of_run = known(of_run).select(*[F.col(f"r.{c}" if spent is not None else c) for c in of_run.columns], (cap - before).alias("__whole"))
    of_run = of_run.alias("r").join(lefts.alias("s"), same([*keys, "__run"], "r", "s"), "left").select("r.*", F.coalesce("s.__left", "r.__whole").alias("__left"))
    rows = with_summaries(runs, keys, of_run, ["__first", "__left"])
    return rows.groupBy("__run").applyInArrow(replay, frame_schema(requests, "admitted boolean"))


def frame_schema(frame: DataFrame, more: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields) + ", " + more


def misplaced(frame: DataFrame, keys: list[str], order: list[Column], stage: str) -> DataFrame:
    """Adds previous (stage before, null at first) and legal: the stage is the next one, or a restart at the first."""
    rows = with_previous(frame, keys, order, {"previous": stage})
    return rows.withColumn("legal", (F.col(stage) == 0) | F.coalesce(F.col(stage) == F.col("previous") + 1, F.lit(False)))


def captured(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys and change (insert, delete, update) between two versions of a table; rows that are the same in both are left out. Keys are unique and not null."""
    state = lambda frame, name: frame.select(*keys, F.struct(*columns).alias(name))
    both = state(old, "__old").join(state(new, "__new"), keys, "full")
    change = F.when(F.col("__old").isNull(), "insert").when(F.col("__new").isNull(), "delete").when(~F.col("__old").eqNullSafe(F.col("__new")), "update")
    return both.select(*keys, change.alias("change")).filter("change IS NOT NULL")


def revision(frame: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many rows, and a sum of hashes that any change of a row moves; the order of rows doesn't matter."""
    return frame.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]), 256), 1, 8), 16, 10).cast("long")).alias("revision"))
