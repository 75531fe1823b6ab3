"""A corpus pipeline of four stages; each one reads what the one before has written."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import bpe_round_trip
from tidemark.llm.mixing import mix_sources
from tidemark.llm.queries import RANKS, TOXIC
from tidemark.llm.shared import materialize
from tidemark.llm.simhash import similar_components
from tidemark.llm.toxicity import fit_toxicity, score_toxicity

#: Least similarity of near-duplicates: five-word shingles that two texts share, of all different ones of both.
SIMILARITY = 0.8
#: Hashes of rows, of eight bytes each, that are broadcast at most.
BROADCAST_ROWS = 2_000_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier trained on the labels doesn't call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    columns = docs.columns
    return score_toxicity(docs, fit_toxicity(docs, labels)).filter(F.col("toxicity") < TOXIC).select(*columns)


def with_keys(docs: DataFrame) -> DataFrame:
    """Adds __key: doc_id, null last, and a hash of the whole row. Rows of one key are equal."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.withColumn("__key", F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), row.alias("row")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more): that of the smallest doc_id.

    A null doc_id counts as the largest; of rows with one doc_id the smallest hash of the row decides, and of equal rows any is kept.
    Null texts and texts without words are a group. The other groups' rows all stay, nothing is kept for an empty table.
    """
    keyed = with_keys(docs)
    groups = similar_components(keyed, SIMILARITY, doc_id="__key")
    members = groups.groupBy(F.col("doc_id").alias("__of"), "component_id").agg(F.count("*").alias("__rows"))
    members = members.filter("__of <> component_id OR __rows > 1").select("__of", (F.col("__of") == F.col("component_id")).alias("__repeated"))
    members = materialize(members, "repeated-or-dropped")
    if members.count() <= BROADCAST_ROWS:  # texts that no listed row can equal stay where they are; only the others are shuffled to be told by their whole keys
        listed = F.broadcast(members.select(F.col("__of.row").alias("__listed")).distinct())
        met = lambda how: keyed.join(listed, F.col("__key.row") == F.col("__listed"), how)
        once = met("left_anti").unionByName(met("left_semi").join(members, F.col("__key") == F.col("__of"), "left_anti"))
    else:
        once = keyed.join(members, F.col("__key") == F.col("__of"), "left_anti")
    once = once.select(*docs.columns)
    if not members.filter("__repeated").limit(1).count():
        return once
    equal = keyed.join(members.filter("__repeated"), F.col("__key") == F.col("__of"), "left_semi")
    return once.unionByName(equal.groupBy("__key").agg(F.any_value(F.struct(*docs.columns)).alias("__row")).select("__row.*"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not, once or twice.

    Equal rows are mixed one by one: together they come as often as their copies add up to. Documents without words, null texts
    among them, have no share in a mix of words and go.
    """
    keyed = with_keys(docs)
    mixed = mix_sources(keyed, doc_id="__key").groupBy(F.col("doc_id").alias("__of")).agg(F.sum("copies").cast("int").alias("__copies"), F.count("*").alias("__rows"))
    mixed = materialize(mixed.filter("__copies > 0"), "copies")
    taken = keyed.join(mixed.filter("__rows = 1"), F.col("__key") == F.col("__of")).select(*docs.columns, "__copies")
    if mixed.filter("__rows > 1").limit(1).count():
        equal = keyed.join(mixed.filter("__rows > 1"), F.col("__key") == F.col("__of")).groupBy("__key").agg(
            F.any_value(F.struct(*docs.columns)).alias("__row"), F.any_value("__copies").alias("__copies")
        )
        taken = taken.unionByName(equal.select("__row.*", "__copies"))
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of decoded bytes of the mixed documents."""
    return bpe_round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("tokens", tokens)]
#: The stages are models and iterations that SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
