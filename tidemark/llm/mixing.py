"""Mixing sources to target weights by entropy balancing.

Rates r of documents minimise the relative entropy to one copy each, subject to the words taken
from every source and to a cap on the rate. The dual is convex with one multiplier a source:
r = min(cap, exp(multiplier * size / scale)). Documents of a source with equal sizes share a rate,
so Newton's iterations run in Spark over counts by source and size. The rates are then rounded
into whole copies, with the rounding error carried from larger to smaller documents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Documents whose rounding errors are carried among themselves, about, and equal rows that are written out from one array.
ROUNDED_TOGETHER, WRITTEN_TOGETHER = 1_000, 1_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """source_no and target for sizes(source, source_size), one row a source.

    Sources in code-point order, null last, take the weights in turn and share `share` of all
    sizes; a target stops at cap times its source's size and the excess goes to the others by weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source, not a document
    turn = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("source_no", F.row_number().over(order) - 1)
    rows = rows.withColumn("weight", F.element_at(turn, (F.col("source_no") % len(weights) + 1).cast("int")))
    rows = rows.withColumn("most", F.col("source_size") * cap)
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "source_no")
    full = F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) * share - full) / left)
    level = F.max("level").over(everything)  # the level rises while sources fill up, and falls after
    return rows.select("source", "source_no", "source_size", F.least("most", level * F.col("weight")).alias("target"))


def balance(counts: DataFrame, targets: DataFrame, cap: float, steps: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """multiplier and scale by source_no: the dual's minimum, found by Newton steps kept within brackets.

    counts(source_no, size, n); targets(source_no, source_size, target). Sums are exact decimals,
    so reruns agree to the last digit. Sources that don't settle within the steps are an error.
    """
    top = math.log(cap)
    exact = lambda c: F.sum(c.cast("decimal(38,6)")).cast("double")
    shape = counts.filter("size > 0").groupBy("source_no").agg(
        (exact(F.col("n") * F.col("size") * F.col("size").cast("double")) / exact(F.col("n") * F.col("size"))).alias("scale"),
        F.min("size").alias("least"),
    )
    full = F.col("target") >= F.col("source_size") * cap
    state = targets.filter("target > 0").join(shape, "source_no").select(
        "source_no", "target", "scale",
        (F.col("scale") * top / F.col("least")).alias("high"),
        F.lit(-1e9).alias("low"),
        F.when(full, F.col("scale") * top / F.col("least")).otherwise(F.log(F.col("target") / F.col("source_size"))).alias("multiplier"),
        full.alias("done"),
    )
    state = materialize(state, "multipliers")
    for _ in range(steps):
        if not state.filter("NOT done").limit(1).count():
            break
        x = F.col("size") / F.col("scale")
        tilt = F.col("multiplier") * x
        words = F.col("n") * F.col("size")
        taken = counts.filter("size > 0").join(state.filter("NOT done"), "source_no").groupBy("source_no").agg(
            exact(words * F.when(tilt >= top, F.lit(cap)).otherwise(F.exp(tilt))).alias("taken"),
            exact(F.when(tilt < top, words * x * F.exp(tilt)).otherwise(F.lit(0.0))).alias("slope"),
        )
        off = F.col("taken") - F.col("target")
        high, low = F.when(off > 0, F.col("multiplier")).otherwise(F.col("high")), F.when(off < 0, F.col("multiplier")).otherwise(F.col("low"))
        newton = F.col("multiplier") - off / F.col("slope")
        middle = F.when(F.col("low") < -1e8, F.col("multiplier") - 4).otherwise((F.col("low") + F.col("high")) / 2)
        stepped = state.join(taken, "source_no", "left").withColumn("high", high).withColumn("low", low)
        settled = F.col("done") | F.coalesce(F.abs(off) <= F.col("target") * tolerance, F.lit(True))
        stepped = stepped.withColumn("done", settled)
        within = (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        stepped = stepped.withColumn("multiplier", F.when(F.col("done"), F.col("multiplier")).when(within, newton).otherwise(middle))
        state = materialize(stepped.select(*state.columns), "multipliers")
    else:
        if state.filter("NOT done").limit(1).count():
            raise RuntimeError(f"rates have not settled in {steps} steps")
    return state.select("source_no", "multiplier", "scale")


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """How often each document is taken so that the sources' words come near their targets.

    Returns every row of docs as doc_id, source, size (words), source_size, target (its source's),
    rate, copies (whole, at most cap) and taken (copies * size). Null texts have size 0 and, like all texts
    without words, take no copies; a null source is a source, the last one. Repeated rows each count: those equal in doc_id, source and text
    are rounded together, as one row with their number, and differ by one copy at most. Results depend on the rows alone.
    """
    named = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").cast("string").alias("text"))
    measured = materialize(
        named.select(
            "doc_id", "source",
            F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
            F.xxhash64("doc_id", "text").alias("hash"),
        ),
        "sizes",
    )
    by_size = materialize(measured.groupBy("source", "size").agg(F.count("*").alias("n")), "source-sizes")
    sums = by_size.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("source_docs"))
    targets = materialize(
        source_targets(sums, weights, share, cap).alias("t").join(sums.alias("s"), F.expr("t.source <=> s.source")).select("t.*", "s.source_docs"), "targets"
    )
    counts = by_size.alias("c").join(targets.alias("t"), F.expr("c.source <=> t.source")).select("t.source_no", "c.size", "c.n")
    tilts = balance(counts, targets, cap)
    sources = targets.join(tilts, "source_no", "left").select(
        F.col("source").alias("of"), "source_no", "source_size", "target",
        F.coalesce("multiplier", F.lit(0.0)).alias("multiplier"), F.coalesce("scale", F.lit(1.0)).alias("scale"),
        F.ceil(F.col("source_docs") / ROUNDED_TOGETHER).cast("long").alias("groups"),
    )
    sources = materialize(sources, "sources")
    rate = F.when(F.col("size") == 0, 0.0).otherwise(F.least(F.lit(float(cap)), F.exp(F.col("multiplier") * F.col("size") / F.col("scale"))))
    equal = measured.groupBy("doc_id", "source", "size", "hash").agg(F.count("*").alias("n"))
    rows = equal.join(sources, F.expr("source <=> of")).select(
        "doc_id", "source", "size", "source_size", "target", rate.alias("rate"), "hash", "n", "source_no", F.pmod("hash", "groups").alias("group")
    )

    def rounded(table: pa.Table) -> pa.Table:
        size, rates, rows_of = table["size"].to_numpy(), table["rate"].to_numpy().tolist(), table["n"].to_pylist()
        order = np.lexsort((table["hash"].to_numpy(), -size))
        copies, carry, most = np.zeros(len(size), dtype=np.int64), 0.0, math.floor(cap)
        sizes = size.tolist()
        for k in order.tolist():
            if sizes[k]:
                wanted = rates[k] * sizes[k] * rows_of[k] + carry
                copies[k] = min(most * rows_of[k], max(0, math.floor(wanted / sizes[k] + 0.5)))
                carry = wanted - int(copies[k]) * sizes[k]
        return table.select([*kept, "n"]).append_column("all", pa.array(copies))

    kept = ["doc_id", "source", "size", "source_size", "target", "rate"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in kept) + ", n long, all long"
    taken = rows.groupBy("source_no", "group").applyInArrow(rounded, schema)
    least, more = F.floor(F.col("all") / F.col("n")), F.col("all") % F.col("n")
    shares = F.array(F.struct((least + 1).alias("copies"), more.alias("times")), F.struct(least.alias("copies"), (F.col("n") - more).alias("times")))
    shared = taken.select(*kept, F.explode(shares).alias("s")).filter("s.times > 0").select(*kept, "s.copies", "s.times")
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / WRITTEN_TOGETHER))
    lots = shared.withColumn("part", F.explode(parts)).withColumn("lot", F.least(F.lit(WRITTEN_TOGETHER), F.col("times") - F.col("part") * WRITTEN_TOGETHER).cast("int"))
    each = lots.withColumn("one", F.explode(F.array_repeat(F.lit(1), F.col("lot"))))
    return each.select(*kept, "copies", (F.col("copies") * F.col("size")).alias("taken"))
