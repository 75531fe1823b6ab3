"""Token counts of documents in flat token files by a separator scan.

A token file is nothing but unsigned little-endian ids, each document followed by an end-of-document
id. The scan cuts files into blocks of bytes without regard to documents, finds the identifiers of
each block at once, and stitches documents that run across blocks with a prefix sum over block
summaries: how many documents ended before, and how many tokens were left open.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import load_ranks
from .shared import file_system, materialize, shared_dir

#: Bytes of a block of the scan.
BLOCK_BYTES = 4 << 20


def write_token_files(
    docs: DataFrame, folder: str, ranks_path: str, pattern: str, end: int, width: int = 2, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """Writes whole texts as token files, one a task; returns path, ordinal and doc_id of the documents in them.

    Null and empty texts are documents of no tokens. Files of failed attempts have names of their
    own and are not in the result, so read the result once it is written.
    """
    frame = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(ranks_path), special_tokens={})
        if max(coder.max_token_value, end) >= 256**width:
            raise ValueError(f"ids up to {max(coder.max_token_value, end)} don't fit into {width} bytes")
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.bin"
        out, ordinal = None, 0
        for batch in batches:
            if out is None and batch.num_rows:
                out = fs.open_output_stream(f"{base}/{name}")
            for value in batch.column(1):
                out.write(np.array([*coder.encode_ordinary(value.as_py()), end], dtype=f"<u{width}").tobytes())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{name}"] * n, pa.string()), pa.array(np.arange(ordinal, ordinal + n)), batch.column(0)], names=["path", "ordinal", "doc_id"]
            )
            ordinal += n
        if out is not None:
            out.close()

    return frame.mapInArrow(run, f"path string, ordinal long, doc_id {frame.schema['doc_id'].dataType.simpleString()}")


def scan_token_files(files: DataFrame, end: int, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """path, ordinal and n_tokens (without the end identifier) of every document of the token files in files(path).

    Tokens after the last identifier of a file are a last document; an empty file has none. Paths
    listed repeatedly are read once.
    """
    step = block_bytes - block_bytes % width

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = file_system(path)
                size = fs.get_file_info(name).size
                if size % width:
                    raise ValueError(f"{path}: {size} bytes are no whole number of ids")
                starts = np.arange(0, size, step)
                if len(starts):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(starts)), pa.array(np.arange(len(starts))), pa.array(starts), pa.array(np.minimum(step, size - starts))],
                        names=["path", "block", "start", "size"],
                    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, block, start, size in zip(*(c.to_pylist() for c in batch.columns)):
                fs, name = file_system(path)
                with fs.open_input_file(name) as source:
                    ids = np.frombuffer(source.read_at(size, start), dtype=f"<u{width}")
                at = np.flatnonzero(ids == end)
                lengths = np.diff(at, prepend=-1) - 1  # of the documents that end in this block, as far as they lie in it
                tail = len(ids) - (int(at[-1]) + 1 if len(at) else 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([block], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([tail], pa.int64()), pa.array([lengths], pa.list_(pa.int64()))],
                    names=["path", "block", "ends", "tail", "lengths"],
                )

    blocks = files.select("path").distinct().mapInArrow(sizes, "path string, block long, start long, size long")
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = blocks.repartition(n, "path", "block").mapInArrow(scan, "path string, block long, ends long, tail long, lengths array<long>")
    found = materialize(found, "scanned-blocks")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summaries = found.select("path", "block", "ends", "tail")
    summaries = summaries.withColumn("first", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    # tokens since the last identifier before this block: all tails since the last block with one, its own included
    summaries = summaries.withColumn("total", F.coalesce(F.sum("tail").over(before), F.lit(0)))
    summaries = summaries.withColumn("reset", F.max(F.when(F.col("ends") > 0, F.col("block"))).over(before))
    anchor = F.when(F.col("ends") > 0, F.col("total"))
    summaries = summaries.withColumn("anchor", F.last(anchor, ignorenulls=True).over(before))
    summaries = summaries.withColumn("open", F.col("total") - F.coalesce("anchor", F.lit(0)))
    last = F.lead("block").over(Window.partitionBy("path").orderBy("block")).isNull()
    summaries = summaries.select(
        F.col("path").alias("p"), F.col("block").alias("b"), "first", "open",
        F.when(last, F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("open") + F.col("tail"))).alias("unended"),
    )
    stitched = found.join(summaries, (F.col("path") == F.col("p")) & (F.col("block") == F.col("b")))
    closed = stitched.select("path", "first", "open", F.posexplode("lengths").alias("k", "length")).select(
        "path", (F.col("first") + F.col("k")).alias("ordinal"), (F.col("length") + F.when(F.col("k") == 0, F.col("open")).otherwise(0)).alias("n_tokens")
    )
    unended = stitched.filter("unended > 0").select("path", (F.col("first") + F.col("ends")).alias("ordinal"), F.col("unended").alias("n_tokens"))
    return closed.union(unended)


def token_counts(docs: DataFrame, ranks_path: str, pattern: str, end: int, width: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and n_tokens of every row of docs, counted in the token files written for it. Null and empty texts count 0."""
    spark = docs.sparkSession
    written = write_token_files(docs, shared_dir(spark, "tokens"), ranks_path, pattern, end, width, text, doc_id)
    written = materialize(written, "token-files")
    counted = scan_token_files(written.select("path"), end, width).withColumnsRenamed({"path": "p", "ordinal": "o"})
    joined = written.join(counted, (F.col("path") == F.col("p")) & (F.col("ordinal") == F.col("o")), "left")
    return joined.select("doc_id", "n_tokens")
