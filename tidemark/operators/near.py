"""Near things: changes that say the same, names that match best, rectangles that overlap. No operator here meets rows in all pairs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.runs import ranked, same
from tidemark.operators.weighted import Best, Index, Sets
from tidemark.sources.scratch import file_system, stored

# How much two changes of one scope must share. At least so many words, and such parts of the smaller set and of both.
ALIKE = (10, 0.72, 0.45)
#: The same with a concept in common; the part of both doesn't matter then.
ALIKE_IN_CONCEPT = (7, 0.55)
# Features (values of sets) in a run of rows, and in a block that a task indexes.
RUN, BLOCK = 2**16, 2**21
# A value that so many rows' part shares is common, and how many of these, the most common, sort rows at most.
COMMON_PART, MOST_COMMON = 256, 256
# Words that say nothing of a change.
COMMON_WORDS = [
    "about", "acceptance", "added", "after", "again", "award", "before", "changed", "changes", "check", "clarifies", "college", "complete", "congress", "current", "details", "during",
    "eligible", "eligibility", "following", "however", "information", "necessary", "participants", "policy", "preferred", "previous", "program", "requirement", "requirements", "section",
    "source", "student", "students", "summary", "updated", "while",
]


def change_words(c: Column) -> Column:
    """Different words of five letters or more that tell what a change is about."""
    words = F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 5) & ~w.isin(COMMON_WORDS) & ~w.rlike("^[0-9]+$")))


def alike(own: str, other: str, own_concepts: str, other_concepts: str) -> Column:
    """Whether two sets of words tell of the same change."""
    both = F.size(F.array_intersect(own, other))
    smaller, every = F.least(F.size(own), F.size(other)), F.size(own) + F.size(other) - both
    in_concept = F.arrays_overlap(own_concepts, other_concepts) & (both >= ALIKE_IN_CONCEPT[0]) & (both >= ALIKE_IN_CONCEPT[1] * smaller)
    return in_concept | (both >= ALIKE[0]) & (both >= ALIKE[1] * smaller) & (both >= ALIKE[2] * every)


def unsent(frame: DataFrame) -> DataFrame:
    """A frame that grows with the input and is joined by a shuffle, never broadcast: words that repeat much make its files far smaller than its rows, which the driver would gather."""
    return frame.hint("merge")


def rarest_first(sets: DataFrame, keys: list[str], id: str, words: str) -> DataFrame:
    """Sets with their words in an array ordered from the rarest of the key, ties by the word."""
    rows = sets.select(*keys, id, F.explode(words).alias("__word"))
    often = rows.groupBy(*keys, "__word").agg(F.count("*").alias("__often"))
    joined = rows.alias("r").join(unsent(often).alias("s"), same([*keys, "__word"], "r", "s"))
    ordered = joined.groupBy(F.col(f"r.{id}").alias(id)).agg(F.array_sort(F.collect_list(F.struct("__often", "r.__word"))).alias("__words"))  # one set's words
    return sets.drop(words).join(unsent(ordered.select(id, F.transform("__words", lambda w: w["__word"]).alias(words))), id)


def earlier_alike(sets: DataFrame, scope: list[str], place: str, words: str, concepts: str) -> DataFrame:
    """later and earlier: places of all pairs of one scope whose sets are alike.

    A pair shares a certain part of its smaller set at least, so one of so many of that set's rarest words as may be missed, and one more, is in the larger
    set. Rows meet on those alone; each pair counts at the first such word.
    """
    sets = stored(rarest_first(sets, scope, place, words), "sets-of-words")
    size = F.size(words)
    may_miss = size - F.greatest(F.lit(min(ALIKE[0], ALIKE_IN_CONCEPT[0])), F.ceil(size * min(ALIKE[1], ALIKE_IN_CONCEPT[1]) - 1e-9).cast("int"))
    first = F.slice(words, F.lit(1), F.greatest(may_miss + 1, F.lit(0)))
    small = sets.select(*scope, F.col(place).alias("a"), F.col(words).alias("wa"), F.col(concepts).alias("ca"), first.alias("fa"), F.explode(first).alias("__word"))
    large = sets.select(*scope, F.col(place).alias("b"), F.col(words).alias("wb"), F.col(concepts).alias("cb"), F.explode(words).alias("__word"))
    on = same([*scope, "__word"], "s", "l") & ((F.size("wa") < F.size("wb")) | (F.size("wa") == F.size("wb")) & (F.col("a") < F.col("b")))
    met = small.alias("s").join(unsent(large).alias("l"), on).filter(F.get(F.array_intersect("fa", "wb"), F.lit(0)) == F.col("s.__word"))
    return met.filter(alike("wa", "wb", "ca", "cb")).select(F.greatest("a", "b").alias("later"), F.least("a", "b").alias("earlier"))


def first_independent(links: DataFrame, run: int = 20_000, most_rounds: int = 1_000) -> DataFrame:
    """later and kept for every row that has links(later, earlier) to earlier ones: a row is kept unless an earlier kept one is linked to it.

    Rows with no earlier link are kept. Runs of places are gone through at once, each in a task and in order, as far as what they ask about is settled; the
    next round knows what this one has settled. Every round settles the first run that is open, and all that hang on settled rows only, so
    places that are linked should lie close together.
    """

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        known: dict[int, bool | None] = {}
        frame = frame.sort_values("later")  # so all links of an earlier one of this run have been gone through
        for later, earlier, kept in zip(frame["later"].tolist(), frame["earlier"].tolist(), frame["kept"].astype("boolean").tolist()):
            state, own = known.get(earlier, None if pd.isna(kept) else kept), known.get(later, True)
            known[later] = False if state or own is False else None if state is None or own is None else True
        return pd.DataFrame({"later": list(known), "kept": pd.array(list(known.values()), dtype="boolean")})

    links = stored(links.distinct(), "links")
    followers = links.select(F.col("later").alias("l")).distinct()
    first = links.join(unsent(followers), F.col("earlier") == F.col("l"), "left")  # those that hang on nothing are kept
    open_links = stored(first.select("later", "earlier", F.when(F.col("l").isNull(), F.lit(True)).alias("kept")), "open-links")
    done = None
    for _ in range(most_rounds):
        now = open_links.groupBy(F.floor(F.col("later") / run).alias("run")).applyInPandas(settle, "later long, kept boolean")
        now = stored(now.filter("kept IS NOT NULL"), "settled")
        done = now if done is None else done.unionByName(now)
        rest = open_links.join(unsent(now.select(F.col("later").alias("l"))), F.col("later") == F.col("l"), "left_anti")
        told = now.select(F.col("later").alias("e"), F.col("kept").alias("k"))
        rest = rest.join(unsent(told), F.col("earlier") == F.col("e"), "left").select("later", "earlier", F.coalesce("kept", "k").alias("kept"))
        open_links = stored(rest, "open-links")
        if open_links.isEmpty():
            return done
    raise RuntimeError(f"not settled in {most_rounds} rounds")


def without_near_duplicates(changes: DataFrame, scope: list[str], order: list[str], key: str, words: str, concepts: str) -> DataFrame:
    """Changes without those that an earlier kept one of their scope tells already: an equal key, or words alike.

    Equal keys go first, by an aggregate, and rows of equal words and concepts then stand or fall together: an earlier kept row that is alike one of them is alike all.
    Of these groups, pairs that are alike are found through rare words, and settled in order in rounds; no scope is met in one task. A scope's groups have
    places next to each other, so rounds are as many as the largest scope's runs and don't grow with the number of scopes.
    Null keys go, as do null scopes' partners: nulls are a scope. order holds no nulls and tells rows of a scope apart.
    """
    rest = [c for c in changes.columns if c not in (*scope, key)]
    once = changes.filter(F.col(key).isNotNull()).groupBy(*scope, key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    once = stored(once.select(*scope, key, *[F.col(f"__row.{c}").alias(c) for c in rest]).withColumns({"__w": F.array_sort(F.array_distinct(words)), "__c": F.array_sort(F.array_distinct(concepts))}), "changes")
    telling = (F.size("__w") >= 8) | (F.size("__w") >= 4) & (F.size("__c") > 0)
    groups = once.filter(telling).groupBy(*scope, "__w", "__c").agg(F.min(F.struct(*order)).alias("__began"))
    groups = stored(ranked(groups, [], [*[F.col(c).asc_nulls_first() for c in scope], F.col("__began").asc(), F.col("__w").asc(), F.col("__c").asc()], "__place"), "groups")
    links = earlier_alike(groups.select(*scope, "__place", "__w", "__c"), scope, "__place", "__w", "__c")
    dropped = first_independent(links).filter("NOT kept").select(F.col("later").alias("__place"))
    dropped = groups.join(unsent(dropped), "__place").select(*scope, "__w", "__c", F.lit(True).alias("__dropped"))
    repeats = groups.filter(alike("__w", "__w", "__c", "__c")).select(*scope, "__w", "__c", "__began")  # only their first row tells something new
    rows = once.alias("r").join(unsent(dropped).alias("s"), same([*scope, "__w", "__c"], "r", "s"), "left_anti").select("r.*")
    rows = rows.alias("r").join(unsent(repeats).alias("s"), same([*scope, "__w", "__c"], "r", "s"), "left").select("r.*", "s.__began")
    return rows.filter(F.col("__began").isNull() | (F.col("__began") == F.struct(*order))).select(*scope, key, *rest)


def best_by_tokens(requests: DataFrame, awards: DataFrame, request: str, award: str, tokens: str, least: float) -> DataFrame:
    """request, award and score: the award that shares most words with a request, as a part of the larger set, at least `least`; ties to the smaller award.

    Words are ordered from the rarest among the awards. Two sets that reach `least` share a word among the first of each, all but so many as may be
    missed, so rows meet on those alone and words of very many awards bring hardly any together. tokens are sets; empty ones match nothing.
    """
    often = awards.select(F.explode(tokens).alias("__word")).groupBy("__word").agg(F.count("*").alias("__often"))

    def rarest_first(frame: DataFrame, id: str, name: str) -> DataFrame:
        words = frame.select(id, F.explode(tokens).alias("__word")).join(often, "__word", "left").withColumn("__often", F.coalesce("__often", F.lit(0)))
        sets = words.groupBy(id).agg(F.array_sort(F.collect_list(F.struct("__often", "__word"))).alias(name))  # one row's words
        sets = sets.withColumn(name, F.transform(name, lambda w: w["__word"]))
        size = F.size(name)
        return sets.withColumn("__first", F.explode(F.slice(name, F.lit(1), size - F.ceil(size * least - 1e-9).cast("int") + 1)))

    met = rarest_first(requests, request, "__own").join(rarest_first(awards, award, "__other"), "__first")
    shared = F.size(F.array_intersect("__own", "__other")) / F.greatest(F.size("__own"), F.size("__other"))
    scored = met.select(request, award, F.round(shared, 6).alias("score")).filter(F.col("score") >= least)
    best = scored.groupBy(request).agg(F.max_by(F.struct(award, "score"), F.struct("score", -F.col(award))).alias("__best"))
    return best.select(request, F.col(f"__best.{award}").alias(award), F.col("__best.score").alias("score"))


def best_weighted(
    requests: DataFrame, awards: DataFrame, request: str, award: str, parts: dict[str, float], least: float, others_only: bool = False, null_unlike: bool = False,
) -> DataFrame:
    """request, award and score: for each request the award of the highest score, at least `least` (above 0), ties to the smaller award.

    parts: names of columns of sets of strings (words of a name, a host) to their weight; a part adds its weight times what both share of the larger set, nothing
    if either is empty or null. null_unlike: a null part is unlike any set that isn't empty, such pairs have no score. others_only: an award doesn't match the
    request of its own id. Ids are integers; null ones match nothing.

    Awards are sorted by what is common in all parts but the heaviest (a language, a host) and written in blocks of a fixed size. A task has a run of requests,
    sorted likewise, and goes through the blocks, the nearest first; pairs never travel. Within a block a feature (a value of a part) of a request adds at
    most its part's weight over the request's own number of values. Features are looked up from the rarest of the block; looking up stops where all that are left
    can't add up to the best score that the request has found in this block and those before. So a word of very many awards is met only by requests that nothing
    else decides, and most requests leave out blocks of other hosts and languages. The work of reading and indexing blocks grows with runs times blocks, in arrays.
    """
    names, weights = list(parts), [float(w) for w in parts.values()]
    empty = F.array().cast("array<string>")
    features = sum((F.size(F.coalesce(p, empty)) for p in names), F.lit(0))
    sets = lambda frame, id: frame.filter(F.col(id).isNotNull()).select(F.col(id).cast("long").alias(id), *[F.array_distinct(F.array_compact(F.col(p).cast("array<string>"))).alias(p) for p in names]).filter(features > 0)
    asked, known = sets(requests, request), sets(awards, award)
    n, of_awards = known.agg(F.count("*"), F.coalesce(F.sum(features), F.lit(0))).first()
    of_requests = asked.agg(F.coalesce(F.sum(features), F.lit(0))).first()[0]

    lighter = sorted(names, key=lambda p: -parts[p])[1:]
    of_part = [F.arrays_zip(F.array_repeat(F.lit(p), F.size(F.coalesce(p, empty))).alias("part"), F.coalesce(p, empty).alias("value")) for p in lighter]
    often = known.select(F.explode(F.concat(*of_part)).alias("v")).groupBy("v").agg(F.count("*").alias("often")).filter(F.col("often") * COMMON_PART >= n) if lighter else None
    common = [r.v for r in often.orderBy(F.desc("often"), "v").limit(MOST_COMMON).collect()] if lighter else []
    context = [F.array_join(F.array_sort(F.array_intersect(F.coalesce(p, empty), F.array(*[F.lit(v.value) for v in common if v.part == p]).cast("array<string>"))), " ") for p in lighter]

    def placed(frame: DataFrame, id: str, runs: int) -> DataFrame:
        by = [*context, F.col(id)]
        return frame.repartitionByRange(runs, *by).sortWithinPartitions(*by)

    files = sorted(stored(placed(known, award, of_awards // RUN + 1), "blocks-of-awards").inputFiles())
    n_blocks = min(len(files), of_awards // BLOCK + 1)
    blocks = [files[k * len(files) // n_blocks : (k + 1) * len(files) // n_blocks] for k in range(n_blocks)]
    size = min(max(RUN, of_requests // (4 * requests.sparkSession.sparkContext.defaultParallelism)), BLOCK // 8)
    n_runs = of_requests // size + 1

    def read(block: list[str]) -> pa.Table:
        return pa.concat_tables([pq.read_table(name, filesystem=fs) for fs, name in map(file_system, block)])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)  # a run
        if not sum(b.num_rows for b in rows):
            return
        run = Sets(pa.Table.from_batches(rows), request, names)
        best, at = Best(run, weights, least, others_only, null_unlike), TaskContext.get().partitionId() / n_runs
        for k in sorted(range(n_blocks), key=lambda k: abs(k / n_blocks - at)):
            best.go_through(Index(read(blocks[k]), award, names))
        yield pa.RecordBatch.from_arrays([pa.array(x[best.found]) for x in (run.ids, best.award, best.score)], names=[request, award, "score"])

    found = placed(asked, request, n_runs).mapInArrow(search, f"`{request}` long, `{award}` long, score double")
    best = found.groupBy(request).agg(F.max_by(F.struct(award, "score"), F.struct("score", -F.col(award))).alias("__best"))  # an id may have several rows
    kind = lambda frame, id: frame.schema[id].dataType
    return best.select(F.col(request).cast(kind(requests, request)), F.col(f"__best.{award}").cast(kind(awards, award)).alias(award), F.col("__best.score").alias("score"))


def overlapping(boxes: DataFrame, crops: DataFrame, on: str, width: float) -> DataFrame:
    """Pairs of boxes and crops of one `on` whose open rectangles overlap: boxes(on, x1, x2, y1, y2, …) and crops likewise, with names ending in 2 for crops' own columns.

    Both are dealt into strips of x of the given width and meet strip by strip; a pair counts in the strip where the later of the two begins.
    """
    strip = lambda c: F.floor(c / width)
    own = boxes.withColumn("__strip", F.explode(F.sequence(strip(F.col("x1")), strip(F.col("x2")))))
    other = crops.select(F.col(on), *[F.col(c).alias(f"crop_{c}") for c in crops.columns if c != on])
    other = other.withColumn("__strip", F.explode(F.sequence(strip(F.col("crop_x1")), strip(F.col("crop_x2")))))
    met = own.join(other, [on, "__strip"]).filter(F.col("__strip") == strip(F.greatest("x1", "crop_x1")))
    return met.filter((F.col("x1") < F.col("crop_x2")) & (F.col("crop_x1") < F.col("x2")) & (F.col("y1") < F.col("crop_y2")) & (F.col("crop_y1") < F.col("y2"))).drop("__strip")
