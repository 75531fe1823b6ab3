"""URL filters: rules by host and path, and trust propagated over the host graph.

Trust is a personalised PageRank from hosts that rules allow, along links; distrust is one from
hosts that rules block, against links. Both thin out where a host shares them with many others, so each
is held against its most: what it would be if all hosts where such walks end (seeds, and hosts with no links in that direction) were
seeds of the kind. A host is blocked where its part of the most distrust reaches a threshold and exceeds its part of the most trust.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: Share of a host's value that its links pass on.
DAMPING = 0.85
#: Least part of the most distrust of a blocked host.
DISTRUST = 0.1
#: Rounds after which values that still move are an error.
MOST_ROUNDS = 1_000
#: Share of a host's pages that rules must exceed to make it a seed: rules for a few paths say little about the host.
SEED_SHARE = 0.5


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both empty for a null url or one without `://`."""
    value = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
    rest = F.when(F.instr(value, "://") > 0, F.expr("substring(__v, instr(__v, '://') + 3)")).otherwise("")
    named = pages.withColumn("__v", value).withColumn("__rest", rest)
    host = F.regexp_extract("__rest", r"^([^/?#]*)", 1)
    ascii_lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return named.withColumn("host", ascii_lower).withColumn("path", F.regexp_extract("__rest", r"^[^/?#]*([^?#]*)", 1)).drop("__v", "__rest")


def rule_struct(rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits host and path, as struct(verdict, rule), else null. rules: (verdict, host and path)."""
    fit = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last to fit wins
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        fit = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(fit)
    return fit


def host_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Distinct links src, dst between different hosts, from absolute links in the html of pages with a host."""
    target = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""
    links = pages.filter("host != ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.col(f"`{html}`"), F.lit(target), 1)).alias("dst"))
    dst = F.translate("dst", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return links.select("src", dst.alias("dst")).filter("src != dst").distinct()


def propagate(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, rounds: int | None = None, tolerance: float = 1e-6) -> DataFrame:
    """host, trust, distrust, most_trust and most_distrust, for seeds(host, trust, distrust) and links(src, dst), as scores above zero.

    value = seed + damping * what neighbours pass on. Trust is passed in equal parts to the hosts linked to,
    distrust to the hosts that link. The most of each is passed on alike, from seeds of 1 at all seeds of
    either kind and at hosts that nothing links to (trust) or that link to nothing (distrust).
    Stops when no value moves by more than this part of it, or after rounds if given; without rounds, values that
    don't settle are an error.
    """
    out = links.groupBy("src").agg(F.count("*").alias("n_out"))
    into = links.groupBy("dst").agg(F.count("*").alias("n_in"))
    edges = materialize(links.join(out, "src").join(into, "dst"), "host-edges")
    seeds = seeds.select("host", "trust", "distrust").filter("trust > 0 OR distrust > 0")
    zero, one = F.lit(0.0), F.lit(1.0)
    values = ["trust", "distrust", "most_trust", "most_distrust"]
    ends = out.withColumnRenamed("src", "host").join(into.withColumnRenamed("dst", "host"), "host", "full").filter("n_out IS NULL OR n_in IS NULL").join(seeds, "host", "left_anti")
    ends = ends.select("host", zero.alias("trust"), zero.alias("distrust"), F.when(F.col("n_in").isNull(), one).otherwise(zero).alias("most_trust"), F.when(F.col("n_out").isNull(), one).otherwise(zero).alias("most_distrust"))
    state = materialize(seeds.withColumns({"most_trust": one, "most_distrust": one}).unionByName(ends), "seeds")
    starts = state.select("host", *[F.col(v).alias(f"seed_{v}") for v in values])
    if not edges.limit(1).count():
        return state
    for _ in range(MOST_ROUNDS if rounds is None else rounds):
        forward = edges.join(state, edges["src"] == state["host"]).select(
            F.col("dst").alias("host"), *[(F.col(v) / F.col("n_out") if not v.endswith("distrust") else zero).alias(v) for v in values]
        )
        back = edges.join(state, edges["dst"] == state["host"]).select(
            F.col("src").alias("host"), *[(F.col(v) / F.col("n_in") if v.endswith("distrust") else zero).alias(v) for v in values]
        )
        passed = forward.union(back).groupBy("host").agg(*[F.sum(v).alias(f"passed_{v}") for v in values])
        rows = passed.join(starts, "host", "full").join(state.withColumnsRenamed({v: f"was_{v}" for v in values}), "host", "left")
        new = rows.select(
            "host",
            *[(F.coalesce(f"seed_{v}", zero) + damping * F.coalesce(f"passed_{v}", zero)).alias(v) for v in values],
            *[F.coalesce(f"was_{v}", zero).alias(f"was_{v}") for v in values],
        )
        new = materialize(new, "trust")
        moved = new.agg(F.max(F.greatest(*[F.when(F.col(v) > 0, F.abs(F.col(v) - F.col(f"was_{v}")) / F.col(v)).otherwise(zero) for v in values]))).first()[0]
        state = new.select("host", *values)
        if moved is None or moved <= tolerance:
            break
    else:
        if rounds is None:
            raise RuntimeError(f"trust has not settled in {MOST_ROUNDS} rounds")
    return state


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", html: str = "html", distrust: float = DISTRUST, seed_share: float = SEED_SHARE) -> DataFrame:
    """Adds host, path, rule and verdict (allow or block) to pages, and the host's trust and distrust.

    The longest fitting rule decides; pages without one follow their host: blocked if its distrust over the most
    distrust (see propagate) reaches the threshold and exceeds its trust over the most trust, else allowed. A host is a trusted (blocked) seed, by the
    share of its pages that rules allow (block), if that share exceeds seed_share. A null url, or one without `://`, has an empty host, no rule
    and is allowed; null html has no links; repeated rows are judged alike; columns of pages with
    the added names are replaced, all others pass.
    """
    added = ("host", "path", "rule", "verdict", "trust", "distrust")
    plain = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c not in added])
    located = with_host_and_path(plain, url)
    judged = located.withColumn("__fit", rule_struct(rules))
    share = lambda verdict: F.avg(F.when(F.col("__fit.verdict") == verdict, 1.0).otherwise(0.0))
    shares = judged.filter("host != ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked"))
    seed = lambda c: F.when(F.col(c) > seed_share, F.col(c)).otherwise(0.0)
    seeds = shares.select("host", seed("allowed").alias("trust"), seed("blocked").alias("distrust"))
    ranks = propagate(seeds, materialize(host_links(located, html), "host-links"))
    part = lambda v: F.when(F.col(f"most_{v}") > 0, F.col(v) / F.col(f"most_{v}")).otherwise(0.0)
    bad = (part("distrust") >= distrust) & (part("distrust") > part("trust"))
    ranks = materialize(ranks.select(F.col("host").alias("__host"), "trust", "distrust", bad.alias("__bad")), "host-ranks")
    rows = judged.join(ranks, F.col("host") == F.col("__host"), "left").drop("__host")
    rows = rows.withColumn("trust", F.coalesce("trust", F.lit(0.0))).withColumn("distrust", F.coalesce("distrust", F.lit(0.0)))
    verdict = F.coalesce(F.col("__fit.verdict"), F.when(F.col("__bad"), "block").otherwise("allow"))
    return rows.withColumn("rule", F.col("__fit.rule")).withColumn("verdict", verdict).drop("__fit", "__bad")
