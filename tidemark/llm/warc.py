"""WARC archives in Zstandard: a dictionary in a leading skippable frame, then one frame a record.

Writers and readers work on whole files in the shared folder, one task a file; files are rolled
over at a size, written under a name of their own attempt and listed by the tasks that succeeded.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_sample, file_system, materialize, shared_dir

#: Bytes of compressed records after which a writer starts the next file.
ROLL = 64 << 20
#: Payloads that the dictionary is trained on at most, and how much of each is read for that.
SAMPLE_ROWS, SAMPLE_BYTES = 400, 16_384
DICTIONARY_BYTES, LEAST_SAMPLES = 32 << 10, 16
#: Equal payloads shorter than this are stored each.
LEAST_REVISIT = 100
# Magic numbers of the .warc.zst format.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528


class WarcError(ValueError):
    """An archive that isn't as it should be."""


def train_dictionary(pages: DataFrame, payload: str = "html", rows: int = SAMPLE_ROWS, size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary from the heads of a bounded sample of different payloads (chosen by hash, equal ones once).

    Empty for fewer than LEAST_SAMPLES payloads, and where the trainer finds too little in them (short or all alike): archives then
    begin with an empty frame and records are compressed without a dictionary, whole all the same.
    """
    heads = pages.filter(F.length(payload) > 0).select(F.substring(payload, 1, SAMPLE_BYTES // 4).alias("head"), F.xxhash64(payload).alias("h"))
    chosen = [r["h"] for r in bounded_sample(heads.select("h").distinct(), "h", rows).collect()]
    if not chosen:
        return b""
    found = heads.filter(F.col("h").isin(chosen)).groupBy("h").agg(F.min("head").alias("head")).orderBy("h").collect()
    heads = [r["head"].encode("utf-8", "replace") for r in found]
    try:
        return zstandard.train_dictionary(size, heads).as_bytes() if len(heads) >= LEAST_SAMPLES else b""
    except zstandard.ZstdError:
        return b""


def name_of(page_id: str | None) -> str:
    """The record id of a page; any string may be one."""
    return f"<urn:page:{quote(page_id, safe='')}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def id_of(name: str | None) -> str | None:
    """The page of a record id."""
    return unquote(name[10:-1]) if name and name.startswith("<urn:page:") else None


def record_bytes(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit holds the HTTP headers only, with the length of the whole payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name_of(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.insert(3, f"WARC-Target-URI: {quote(url, safe='%:/?#[]@!$&()*+,;=~' + chr(39))}")
    if revisit:
        lines += [f"WARC-Refers-To: {name_of(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, dictionary: bytes, payload: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Writes every row of pages(page_id, url, payload, refers_to, revisit, digest) as a record; returns the files as path, records, size."""
    frame = pages.select(
        F.col(page_id).cast("string"), F.col(url).cast("string"), F.coalesce(F.col(payload), F.lit("")), "digest", F.col("refers_to").cast("string"), "revisit"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        squeeze = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True, write_content_size=True)
        name = uuid.uuid4().hex  # of this attempt
        files, out, records, written = [], None, 0, 0

        def done() -> None:
            nonlocal out
            if out is not None:
                out.close()
                files.append((f"{folder}/{name}-{len(files):05d}.warc.zst", records, written))
                out = None

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out = fs.open_output_stream(f"{base}/{name}-{len(files):05d}.warc.zst")
                    head = zstandard.ZstdCompressor().compress(dictionary) if dictionary else b""
                    head = struct.pack("<II", SKIPPABLE, len(head)) + head
                    out.write(head)
                    records, written = 0, len(head)
                frame = squeeze.compress(record_bytes(row[0], row[1], row[2].encode("utf-8", "replace"), row[3], row[4], row[5]))
                out.write(frame)
                records, written = records + 1, written + len(frame)
                if written >= ROLL:
                    done()
        done()
        if files:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*files)], names=["path", "records", "size"])

    return frame.mapInArrow(run, "path string, records long, size long")


def frames_of(path: str) -> Iterator[bytes]:
    """The records of a .warc.zst file, a frame each, decoded with the dictionary of its leading skippable frame."""
    fs, name = file_system(path)
    with fs.open_input_stream(name) as source:
        head = source.read(8)
        if len(head) < 8:
            raise WarcError(f"{path}: no leading frame")
        magic, length = struct.unpack("<II", head)
        if magic != SKIPPABLE:
            raise WarcError(f"{path}: the leading frame isn't a skippable one")
        held = source.read(length)
        if len(held) < length:
            raise WarcError(f"{path}: the dictionary is cut short")
        if held[:4] == struct.pack("<I", FRAME):
            held = zstandard.ZstdDecompressor().decompress(held)
        expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held) if held else None)
        rest = b""
        while True:
            rest = rest or source.read(1 << 20)
            if not rest:
                return
            one, parts = expand.decompressobj(), []
            while not one.eof:
                if not rest and not (rest := source.read(1 << 20)):
                    raise WarcError(f"{path}: the last frame is cut short")
                parts.append(one.decompress(rest))
                rest = one.unused_data if one.eof else b""
            yield b"".join(parts)


def headers_of(lines: bytes) -> dict[str, str]:
    """Header fields with lower-case names; continuation lines are joined."""
    fields: dict[str, str] = {}
    name = ""
    for line in lines.split(b"\r\n"):
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and name:
            fields[name] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        if not colon:
            raise WarcError(f"not a header: {text[:80]}")
        name = name.strip().lower()
        fields[name] = value.strip()
    return fields


def parse_record(raw: bytes) -> dict[str, object]:
    """Validates a record's version, headers, lengths and digests; returns its type, ids, url and payload (None for revisits)."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not found or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError(f"not a WARC record: {version[:40]!r}")
    fields = headers_of(lines)
    missing = [x for x in ("warc-type", "warc-record-id", "warc-date", "content-length") if x not in fields]
    if missing or not fields["content-length"].isdigit():
        raise WarcError(f"headers missing or wrong: {missing or 'content-length'}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"{fields['warc-record-id']}: the block has {len(rest) - 4} bytes, not {length}")
    block = rest[:length]
    if (want := fields.get("warc-block-digest", "")).startswith("sha256:") and hashlib.sha256(block).hexdigest() != want[7:]:
        raise WarcError(f"{fields['warc-record-id']}: the block's digest is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(headers_of(http.partition(b"\r\n")[2])["content-length"])
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise WarcError(f"{fields['warc-record-id']}: the payload differs from its length or digest")
    return {
        "page_id": id_of(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"],
        "payload_bytes": size, "payload_digest": digest, "refers_to": id_of(fields.get("warc-refers-to")), "payload": None if revisit else payload,
    }


def read_archives(spark: SparkSession, files: DataFrame, keep_payload: bool = True) -> DataFrame:
    """The records of files(path): page_id, url, record_type, payload_bytes, payload_digest, refers_to (strings but for the length) and payload."""
    columns = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * keep_payload
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    schema = "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string" + ", payload binary" * keep_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for raw in frames_of(path):
                    row = parse_record(raw)
                    held += 200 + (len(row["payload"] or b"") if keep_payload else 0)
                    rows.append([row[c] for c in columns])
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=columns)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=columns)

    tasks = max(1, files.count())
    return files.select("path").repartition(tasks, F.xxhash64("path")).mapInArrow(run, schema)


def warc_round_trip(pages: DataFrame, payload: str = "html", page_id: str = "page_id", url: str = "url", keep_payload: bool = False) -> DataFrame:
    """Writes pages as archives in the shared folder and reads them back, one row a record, as read_archives returns them.

    Of equal payloads of at least 100 bytes the one with the smallest page_id is a response and the
    others revisit it. Null payloads are empty; rows with that same smallest page_id are all
    responses; rows without a page_id revisit it, too, and come back with a null page_id. Groups of nothing but null ids are all responses.
    """
    body = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit(""))
    frame = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("html"))
    frame = frame.withColumn("digest", F.sha2(F.encode("html", "utf-8"), 256))
    first = frame.filter(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = materialize(first.filter("n > 1 AND first IS NOT NULL").select(F.col("digest").alias("of"), "first"), "repeated-payloads")
    linked = frame.join(first, F.col("digest") == F.col("of"), "left").withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    linked = linked.withColumn("refers_to", F.when(F.col("revisit"), F.col("first")))
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    files = materialize(write_archives(linked, folder, train_dictionary(frame)), "warc-files")
    records = read_archives(spark, files, keep_payload)
    kind = frame.schema["page_id"].dataType
    typed = lambda c: F.col(c).cast(kind).alias(c)
    return records.select(typed("page_id"), *[F.col(c) for c in records.columns if c not in ("page_id", "refers_to")], typed("refers_to"))
