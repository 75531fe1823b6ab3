"""Merkle manifest of a dataset: a tree of SHA-256 hashes for each group of rows, and one over the groups' roots.

Every parent is stored with its preimage, the concatenated hexadecimal hashes of its children. A leaf's path is the list
of its ancestors' preimages with the slot of 64 characters that the leaf's branch fills in each: cutting
the slot out leaves the siblings, that is the proof, and putting another hash there folds a changed
leaf up to the root that it would lead to. Parents are built level by level, 16 children each at most; paths then go
down level by level, so that a row joins its lowest parent only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.runs import ranked

from .shared import materialize

#: Children of a node, as a power of two, and characters of a hash.
FAN_BITS, DIGITS = 4, 64
FAN = 1 << FAN_BITS


def digest(preimage: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of a string in UTF-8."""
    return F.sha2(preimage.cast("binary"), 256)


def field(c: Column) -> Column:
    """A value with its length in UTF-8 bytes before it, `-` for null: no two rows of values concatenate to the same string."""
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    """Hash of a row of values."""
    return digest(F.concat(*[field(v) for v in values]))


def siblings(path: Column) -> Column:
    """Hashes of a path's siblings in one string, level by level from below, left to right: preimages without the path's own slots."""
    cut = lambda p: F.overlay(p["preimage"], F.lit(""), p["slot"] * DIGITS + 1, F.lit(DIGITS))
    return F.array_join(F.transform(path, cut), "")


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf leads to among the siblings of a path."""
    return F.aggregate(path, leaf, lambda h, p: digest(F.overlay(p["preimage"], h, p["slot"] * DIGITS + 1, F.lit(DIGITS))))


def parents(nodes: DataFrame) -> list[DataFrame]:
    """The levels above nodes(tree, n, at, digest), each with its preimage: trees of n nodes, placed from 0, get one every 16 until one is left."""
    most, levels = nodes.agg(F.max("n")).first()[0] or 0, []
    while most > 1:
        children = F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"])  # FAN at most
        above = nodes.filter("n > 1").groupBy("tree", F.ceil(F.col("n") / FAN).alias("n"), F.shiftright("at", FAN_BITS).alias("at")).agg(F.array_join(children, "").alias("preimage"))
        nodes = materialize(above.withColumn("digest", digest(F.col("preimage"))), "tree-level")
        levels.append(nodes)
        most = -(-most // FAN)
    return levels


def roots(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """tree and digest of each tree's last node."""
    out = nodes.filter("n = 1").select("tree", "digest")
    for level in levels:
        out = out.unionByName(level.filter("n = 1").select("tree", "digest"))
    return out


def with_paths(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Nodes with their path up to the root of their tree and on through tops(tree, path, …), whose other columns come with it.

    A level meets the one above on the parent's place: 16 rows at most to each.
    """
    more = [c for c in tops.columns if c not in ("tree", "path")]
    above = None
    for level in [*reversed(levels), nodes]:
        own = [c for c in level.columns if c not in ("tree", "n", "at")]
        done = level.filter("n = 1").join(tops, "tree").select("tree", "n", "at", *own, "path", *more)
        if above is not None:
            up = above.select("tree", F.col("at").alias("up"), F.col("preimage").alias("around"), F.col("path").alias("rest"), *more)
            step = F.array(F.struct(F.col("around").alias("preimage"), (F.col("at") % FAN).cast("int").alias("slot")))
            below = level.filter("n > 1").withColumn("up", F.shiftright("at", FAN_BITS)).join(up, ["tree", "up"])
            done = done.unionByName(below.select("tree", "n", "at", *own, F.concat(step, F.col("rest")).alias("path"), *more))
        above = done
    return above


def manifest(leaves: DataFrame, group: str, key: str, leaf: str = "leaf") -> DataFrame:
    """Rows of leaves with subroot (of their group), root (of all) and path, an array of (preimage, slot) from the lowest parent to the root.

    Within a group leaves are ordered by key, null first, then by their hash; groups by name, null first. Equal rows take
    places of their own. A group of one leaf has it as its subroot; a single group's subroot is the root; an empty table gives
    no rows. The other columns of leaves stay (of columns with the names of results and of __ the result's holds).
    """
    made = ("subroot", "root", "path")
    rows = leaves.select(*[F.col(f"`{c}`").alias(f"own_{c}") for c in leaves.columns if c not in made])
    rows = materialize(rows, "leaves")  # the texts are read once
    order = [F.col(f"`own_{key}`").asc_nulls_first(), F.col(f"`own_{leaf}`").asc()]
    placed = ranked(rows, [f"own_{group}"], order, "place", "n")
    names = materialize(ranked(rows.select(F.col(f"`own_{group}`").alias("name")).distinct(), [], [F.col("name").asc_nulls_first()], "tree"), "groups")
    nodes = placed.join(names, placed[f"own_{group}"].eqNullSafe(names["name"]))
    nodes = materialize(nodes.drop("name").withColumns({"at": F.col("place") - 1, "digest": F.col(f"`own_{leaf}`")}).drop("place"), "placed-leaves")
    levels = parents(nodes.select("tree", "n", "at", "digest"))
    subroots = materialize(roots(nodes, levels), "subroots")
    count = subroots.count()
    over = subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), (F.col("tree") - 1).alias("at"), "digest", F.col("tree").alias("of"))
    upper = parents(over.drop("of"))
    path = F.lit(None).cast("array<struct<preimage:string,slot:int>>")
    top = roots(over, upper).select("tree", F.coalesce(path, F.array()).alias("path"), F.col("digest").alias("root"))
    tops = with_paths(over, upper, top).select(F.col("of").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    tops = materialize(tops, "paths-of-groups")
    done = with_paths(nodes, levels, tops)
    return done.select(*[F.col(f"`own_{c}`").alias(c) for c in leaves.columns if c not in made], "subroot", "root", "path")
