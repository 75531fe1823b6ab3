"""The queries opN_<name> of the subpackage and their SQL."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .bpe import bpe_round_trip
from .html_text import main_text
from .linkgraph import judge_urls
from .merkle import digest, folded, leaf_of, manifest, siblings
from .mixing import mix_sources
from .negatives import hard_negatives
from .packing import binary_pieces, numbered
from .simhash import hex_of, simhash_components
from .token_files import token_counts
from .topk import top_products
from .toxicity import fit_toxicity, score_toxicity
from .warc import warc_round_trip

RANKS = "byte_bpe_50k.tiktoken"
#: An id that the vocabulary leaves free.
END_OF_DOCUMENT = 50256
#: Tokenizer of packed sequences, the id that ends a document there, and tokens of the longest sequence.
WORDS, END_OF_PACKED, LONGEST_SEQUENCE = "word_bpe_49k.json", 1, 2048
#: Scores from which on a document counts as toxic.
TOXIC = 0.7
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, scanned from flat token files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, END_OF_DOCUMENT)


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows found for every vec_id divisible by 50, by cosine."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


def op3_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of floor(64 * x) for every vec_id divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_products(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20, scale=64)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of decoded bytes of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return bpe_round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from two thirds of the labels by a checksum of doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    model = fit_toxicity(docs, labels.filter(~held_out))
    scored = score_toxicity(docs.withColumn("held_out", held_out), model)
    return scored.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= TOXIC).cast("int").alias("predicted"))


def op6_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to .warc.zst archives and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return warc_round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights 3, 1, 2 repeating, at 150% of all words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents: 3-word shingles, links at 3 differing bits of 64, exact."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = simhash_components(docs, shingle=3, lanes=1, distance=3)
    return found.select("doc_id", hex_of(found["fp"]).alias("fingerprint"), "component_id")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_text(pages)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of all documents, and the root that those with a tampered text lead to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    leaves = docs.select("doc_id", "source", leaf_of(*rest, F.col("text")).alias("leaf"), F.when(tampered, leaf_of(*rest, lower)).alias("tampered"))
    out = manifest(leaves, "source", "doc_id").select(
        "doc_id", "leaf", "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"),
        folded(F.col("path"), F.coalesce("tampered", "leaf")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents of 2, 4, … 2,048 tokens or one, each a sequence of its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pieces = binary_pieces(docs, public_tokenizers.path(WORDS), END_OF_PACKED, LONGEST_SEQUENCE)
    pieces = pieces.withColumns({"length": F.col("length").cast("long"), "ids_crc32": F.crc32("tokens")}).drop("tokens")
    return numbered(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vec_id divisible by 100; a seventh of the labels is moved on by one first."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = vectors.withColumn("label", moved)
    return hard_negatives(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


_ALL = (
    op1_token_counts, op2_nearest_neighbours, op3_top_products, op4_byte_bpe, op5_toxicity,
    op6_warc_zstd, op7_mix_sources, op8_simhash_dedup, op9_main_text, op10_url_filters,
    op11_merkle_manifest, op12_binary_packing, op13_hard_negatives,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

ORACLE_SQL: dict[str, str] = {
    "op3_top_products": """
        WITH v AS (SELECT vec_id::BIGINT AS vec_id, [floor(64 * x) for x in embedding::DOUBLE[]] AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len(embedding) > 0),
        s AS (SELECT q.vec_id AS query_id, b.vec_id, list_dot_product(q.v, b.v)::BIGINT AS score
              FROM v q JOIN v b ON q.vec_id % 20 = 0 AND q.vec_id <> b.vec_id)
        SELECT query_id, rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 20
    """,
    "op6_warc_zstd": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        q AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY html) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM q
    """,
    "op11_merkle_manifest": """
        WITH RECURSIVE d AS (
            SELECT row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
                   doc_id, text, [doc_id::VARCHAR, source, lang, n_chars::VARCHAR] AS head,
                   list_reduce(list_prepend(4294967295::UBIGINT, [ascii(c)::UBIGINT for c in string_split(doc_id::VARCHAR, '')]), lambda a, b:
                       list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS sum
            FROM documents),
        e AS (SELECT *, array_to_string([CASE WHEN x IS NULL THEN '-' ELSE strlen(x) || ':' || x END for x in head], '') AS said,
                     CASE WHEN xor(sum, 4294967295::UBIGINT) % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed FROM d),
        leaves AS (SELECT doc_id, tree, n, pos, sha256(said || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(said || coalesce(strlen(changed) || ':' || changed, '-')) AS put FROM e),
        nodes AS (SELECT tree, n::BIGINT AS n, pos::BIGINT AS pos, 0 AS level, leaf AS h, '' AS pre FROM leaves UNION ALL
                  SELECT tree, (n + 15) // 16, pos // 16, level + 1, sha256(string_agg(h, '' ORDER BY pos)), string_agg(h, '' ORDER BY pos) FROM nodes WHERE n > 1 GROUP BY tree, n, pos // 16, level),
        tops AS (SELECT tree, h AS subroot, tree AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
        over AS (SELECT n::BIGINT AS n, pos::BIGINT AS pos, 0 AS level, subroot AS h, '' AS pre FROM tops UNION ALL
                 SELECT (n + 15) // 16, pos // 16, level + 1, sha256(string_agg(h, '' ORDER BY pos)), string_agg(h, '' ORDER BY pos) FROM over WHERE n > 1 GROUP BY n, pos // 16, level),
        climb AS (SELECT doc_id, leaf, tree, n::BIGINT AS n, pos::BIGINT AS pos, 0 AS level, put AS h, '' AS proof FROM leaves UNION ALL
                  SELECT doc_id, leaf, c.tree, p.n, p.pos, p.level, sha256(left(p.pre, 64 * (c.pos % 16)) || c.h || substr(p.pre, 64 * (c.pos % 16) + 65)),
                         proof || left(p.pre, 64 * (c.pos % 16)) || substr(p.pre, 64 * (c.pos % 16) + 65)
                  FROM climb c JOIN nodes p ON c.n > 1 AND p.tree = c.tree AND p.level = c.level + 1 AND p.pos = c.pos // 16),
        rise AS (SELECT doc_id, leaf, subroot, t.n::BIGINT AS n, t.pos::BIGINT AS pos, 0 AS level, h, proof FROM climb c JOIN tops t ON c.tree = t.tree AND c.n = 1 UNION ALL
                 SELECT doc_id, leaf, subroot, p.n, p.pos, p.level, sha256(left(p.pre, 64 * (c.pos % 16)) || c.h || substr(p.pre, 64 * (c.pos % 16) + 65)),
                        proof || left(p.pre, 64 * (c.pos % 16)) || substr(p.pre, 64 * (c.pos % 16) + 65)
                 FROM rise c JOIN over p ON c.n > 1 AND p.level = c.level + 1 AND p.pos = c.pos // 16)
        SELECT doc_id, leaf, subroot, o.h AS root, sha256(proof) AS proof_sha256, r.h AS folded_root, r.h = o.h AS verified FROM rise r JOIN over o ON o.n = 1 AND r.n = 1
    """,
    "op13_hard_negatives": """
        WITH v AS (SELECT vec_id::BIGINT AS vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x) for x in embedding::DOUBLE[]] AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND label IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len(embedding) > 0),
        s AS (SELECT q.vec_id AS anchor_id, b.vec_id, q.label = b.label AS same, list_dot_product(q.v, b.v)::BIGINT AS score
              FROM v q JOIN v b ON q.vec_id % 100 = 0 AND q.vec_id <> b.vec_id),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
        QUALIFY rank <= 5
    """,
}
