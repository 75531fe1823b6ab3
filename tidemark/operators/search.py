"""Ranked search by name: awards by words and aliases, organisations by keys."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T


@dataclass(frozen=True)
class Alias:
    """Queries that stand for awards: their words, phrases of which the name must hold one, openings that come first, in order, and phrases that support a match."""

    queries: list[str]
    targets: list[str]
    prefixes: list[str] = field(default_factory=list)
    support: list[str] = field(default_factory=list)


def alias_rank(query: str, aliases: list[Alias], name: Column) -> Column:
    """The best rank by which an alias of the query fits a name (a search key), null if none does: 1 and tenths by opening, 2 with support, else 5."""
    words = set(_plain(query).split())
    ranks = []
    for alias in aliases:
        if not any(set(_plain(q).split()) <= words for q in alias.queries):
            continue
        holds = lambda phrases: F.greatest(F.lit(False), F.lit(False), *[F.contains(name, F.lit(_plain(p))) for p in phrases])
        rank = F.when(holds(alias.support), 2.0).otherwise(5.0)
        for k, prefix in reversed(list(enumerate(alias.prefixes))):
            rank = F.when(name.startswith(_plain(prefix)), 1 + k / 10).otherwise(rank)
        ranks.append(F.when(holds(alias.targets), rank))
    return F.least(*ranks, *ranks) if ranks else F.lit(None).cast("double")


def _plain(text: str) -> str:
    kept = text.lower().replace("&", " and ").replace("'", "").replace("’", "")
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in kept).split())


def search_rank(query: str, name: Column, summary: Column, aliases: list[Alias] | None = None) -> Column:
    """0 equal, 1 and 5 by alias, 2 prefix, 3 part of the name, 4 all words in the name, 6 part of the summary (by alias one more), 7 all words in both; null if nothing fits."""
    q = F.lit(_plain(query))
    own, other = T.search_key(name), T.search_key(F.coalesce(summary, F.lit("")))
    both = F.concat_ws(" ", own, other)
    words = T.tokens(F.lit(query))
    every = lambda where: (F.size(words) > 0) & F.forall(words, lambda w: F.contains(where, w))
    plain = (
        F.when(own == q, 0.0).when(F.startswith(own, q), 2.0).when(F.contains(own, q), 3.0).when(every(own), 4.0)
        .when(F.contains(other, q), 6.0).when(every(both), 7.0)
    )
    return F.least(plain, alias_rank(query, aliases or [], own), alias_rank(query, aliases or [], both) + 1) if aliases else plain


def ranked_search(frame: DataFrame, query: str, name: str, summary: str, order: list[str], aliases: list[Alias] | None = None) -> DataFrame:
    """Rows that match a query, with their search_rank (an int without aliases), best first."""
    rank = search_rank(query, F.col(name), F.col(summary), aliases)
    found = frame.withColumn("rank", rank if aliases else rank.cast("int")).filter("rank IS NOT NULL")
    return found.orderBy("rank", F.col(name).asc_nulls_last(), *order)


def loose_key(c: Column) -> Column:
    """An organisation's name without case, hyphens and commas."""
    return T.lookup_key(F.regexp_replace(c, "[-,]", " "))


def organization_rank(query: str, name: Column) -> Column:
    """0 equal, 1 prefix, 2 prefix but for hyphens and commas, 3 all words, 4 part, 10 otherwise."""
    q, own = T.lookup_key(F.lit(query)), T.lookup_key(name)
    loose_q, loose = loose_key(F.lit(query)), loose_key(name)
    words = F.slice(F.filter(F.split(loose_q, " "), lambda w: F.length(w) >= 2), 1, 8)
    every = (F.size(words) > 0) & F.forall(words, lambda w: F.contains(loose, w))
    return (
        F.when(q == "", 10).when((own == q) | (loose == loose_q), 0).when(F.startswith(own, q), 1).when(F.startswith(loose, loose_q), 2).when(every, 3)
        .when(F.contains(own, q) | F.contains(loose, loose_q), 4).otherwise(10)
    )
