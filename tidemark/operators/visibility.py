"""Which changes the public sees: those of open sources, and of these the ones of a verified award with evidence of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import urls as U

# Schemas of evidence that can be shown.
EVIDENCE_SCHEMAS = ["visual-event-evidence-v1", "visual-event-evidence-v2"]


def with_open_source(changes: DataFrame, sources: DataFrame, source_id: str = "source_id", source_url: str = "source_url", hidden: str = "hidden") -> DataFrame:
    """Changes with open: whether their source is among sources(id, url), the open and monitorable ones.

    A change with a source's id belongs to it by id alone, whatever its url; one without belongs to any source whose url has the same canonical key, and one
    without either to none. Hidden changes are never open. Ids and keys are looked up as sets, so sources that share a url don't repeat a change.
    """
    ids = sources.select(F.col("id").alias("__id")).filter("__id IS NOT NULL").distinct().withColumn("__by_id", F.lit(True))
    keys = sources.select(U.canonical_key(F.col("url")).alias("__key")).filter("__key <> ''").distinct().withColumn("__by_key", F.lit(True))
    rows = changes.join(ids, F.col(source_id) == F.col("__id"), "left")
    rows = rows.join(keys, F.when(F.col(source_id).isNull() & (F.coalesce(source_url, F.lit("")) != ""), U.canonical_key(F.col(source_url))) == F.col("__key"), "left")
    found = F.coalesce(F.when(F.col(source_id).isNotNull(), F.col("__by_id")).otherwise(F.col("__by_key")), F.lit(False))
    return rows.select(*changes.columns, (found & ~F.col(hidden)).alias("open"))


def public(changes: DataFrame, sources: DataFrame, publications: DataFrame, members: DataFrame, evidence: DataFrame) -> DataFrame:
    """Changes with why_not: the first reason for which the public doesn't see them, null if it does.

    changes(id, award, source_id, source_url, hidden, useful); sources(id, award, url, open, allowed: by the gates of the public and of monitoring);
    publications(award, verified, active), one row an award; members(award, source_id), the sources that a publication allows; evidence(id, award, source_id, schema),
    one row a change at most.
    A null in what is compared is no match.
    """
    s = sources.select(F.col("id").alias("__id"), F.col("award").alias("__s_award"), F.col("url").alias("__s_url"), F.col("open").alias("__s_open"), F.col("allowed").alias("__s_allowed"))
    known = publications.select(F.col("award").alias("__p_award"), "verified", "active")
    member = members.select(F.col("award").alias("__m_award"), F.col("source_id").alias("__m_source")).distinct()
    e = evidence.filter(F.col("schema").isin(EVIDENCE_SCHEMAS)).select(F.col("id").alias("__e_id"), F.col("award").alias("__e_award"), F.col("source_id").alias("__e_source"))
    rows = changes.join(known, F.col("award") == F.col("__p_award"), "left").join(s, F.col("source_id") == F.col("__id"), "left")
    rows = rows.join(member, (F.col("award") == F.col("__m_award")) & (F.col("source_id") == F.col("__m_source")), "left").join(e, F.col("id") == F.col("__e_id"), "left")
    holds = lambda c: F.coalesce(c, F.lit(False))
    rules = [
        ("not_verified", holds(F.col("verified"))), ("award_not_active", holds(F.col("active"))), ("source_missing", F.col("__id").isNotNull()), ("source_not_open", holds(F.col("__s_open"))),
        ("source_of_another_award", holds(F.col("__s_award") == F.col("award"))), ("another_url", holds(F.col("__s_url") == F.col("source_url"))), ("source_not_published", F.col("__m_source").isNotNull()),
        ("no_evidence", holds((F.col("__e_award") == F.col("award")) & (F.col("__e_source") == F.col("source_id")))), ("hidden", ~holds(F.col("hidden"))),
        ("source_not_allowed", holds(F.col("__s_allowed"))), ("not_useful", holds(F.col("useful"))),
    ]
    return rows.select(*changes.columns, F.coalesce(*[F.when(~met, F.lit(reason)) for reason, met in rules]).alias("why_not"))
