"""Changes between versions of a text: sentences, dates and amounts added and removed, and what becomes of a change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.sources.scratch import stored

from .keyed import with_previous_id


def version_pairs(snapshots: DataFrame, keys: list[str], id: str, body: str) -> DataFrame:
    """Snapshots with the id, hash and text of the version before (previous_id, previous_hash, previous_text) and whether content has changed.

    First versions have none and no change. Versions are found on ids alone; texts are looked up by id afterwards, so no key's texts meet in one task.
    """
    light = with_previous_id(snapshots.select(*keys, id), keys, id, "previous_id").select(id, "previous_id")
    hashed = snapshots.withColumn("hash", F.sha2(body, 256))
    before = hashed.select(F.col(id).alias("previous_id"), F.col("hash").alias("previous_hash"), F.col(body).alias("previous_text"))
    pairs = hashed.join(light, id).join(before, "previous_id", "left")
    return pairs.withColumn("changed", F.col("previous_hash").isNotNull() & (F.col("hash") != F.col("previous_hash")))


def structured_diff(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """Adds added and removed (sentences), dates_added and amounts_added: set differences, in order of appearance."""
    before, after = T.sentences(F.col(old)), T.sentences(F.col(new))
    return pairs.withColumns({
        "added": F.array_except(after, before),
        "removed": F.array_except(before, after),
        "dates_added": F.array_except(T.date_phrases(F.col(new)), T.date_phrases(F.col(old))),
        "amounts_added": F.array_except(T.money_phrases(F.col(new)), T.money_phrases(F.col(old))),
    })


def sentence_counts(snapshots: DataFrame, keys: list[str], id: str, body: str) -> DataFrame:
    """id, n_added and n_removed: different sentences that each version has beyond the one before it and lacks of it. First versions, and those after one without a text, have no row.

    Sentences are hashed where they are read, so texts are neither shuffled nor joined: versions are found on ids, and arrays of 64-bit hashes meet.
    """
    rows = snapshots.select(*keys, id, F.transform(T.sentences(F.col(body)), lambda s: F.xxhash64(s)).alias("__new"))
    rows = stored(rows, "sentences")
    ids = with_previous_id(rows.select(*keys, id), keys, id, "__before").filter("__before IS NOT NULL").select(id, "__before")
    before = rows.select(F.col(id).alias("__before"), F.col("__new").alias("__old")).filter("__old IS NOT NULL")
    pairs = ids.join(rows.select(id, "__new"), id).join(before, "__before")
    return pairs.select(id, F.size(F.array_except("__new", "__old")).alias("n_added"), F.size(F.array_except("__old", "__new")).alias("n_removed"))


def change_class() -> Column:
    """What a structured diff amounts to, the first rule that holds."""
    return (
        F.when(F.size("amounts_added") > 0, "amount")
        .when(F.size("dates_added") > 0, "date")
        .when(F.size("added") > 0, "added_text")
        .when(F.size("removed") > 0, "removed_text")
        .otherwise("none")
    )


def first_rule(rules: list[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """The reason of the first rule (reason, condition) that holds; null conditions don't."""
    return F.coalesce(*[F.when(c, F.lit(reason)) for reason, c in rules], F.lit(otherwise))


def summary(old: Column, new: Column) -> Column:
    """One sentence on what changed, the first that applies: amounts, dates, added text, removed text, nothing."""
    nothing = F.lit("No award-relevant wording changed in the stored excerpt.")
    amounts = F.array_except(T.money_phrases(new), T.money_phrases(old))
    dates = F.array_except(T.date_phrases(new), T.date_phrases(old))
    listed = lambda opening, items, most: F.concat(F.lit(opening), F.array_join(F.slice(items, 1, most), ", "), F.lit("."))
    said = lambda opening, text: F.concat(F.lit(opening + ': "'), text, F.lit('".'))
    return (
        F.when(old == new, nothing).when(F.size(amounts) > 0, listed("New funding amount language appeared: ", amounts, 3)).when(F.size(dates) > 0, listed("Added date context: ", dates, 4))
        .when((F.length(new) >= 35) & ~F.contains(old, new), said("Added text includes", new)).when((F.length(old) >= 35) & ~F.contains(new, old), said("Removed text includes", old)).otherwise(nothing)
    )


def expands(old: Column, new: Column) -> Column:
    """Whether a newer text is a longer capture of the same page: it begins with the older one, or holds its end well before its own."""
    compact = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    tail = F.trim(F.right(old, F.lit(180)))
    goes_on = (F.length(tail) >= 60) & F.contains(new, tail) & (F.position(tail, new) - 1 + F.length(tail) < F.length(new) - 40)
    longer = (F.length(old) >= 500) & (F.length(new) > F.length(old) + 80)
    return longer & (F.startswith(new, old) | F.startswith(compact(new), compact(old)) | goes_on)
