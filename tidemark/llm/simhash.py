"""SimHash near-duplicate detection with pivot distance tables.

Every text gets a fingerprint of its word shingles. Distances of all fingerprints to a fixed set
of reference fingerprints (pivots) form a table, computed once for each different fingerprint and carried along;
by the triangle inequality two fingerprints within a distance d differ by at most d in every coordinate, so pairs whose
coordinates differ by more are discarded and the survivors verified on the fingerprints themselves. Bands of bits only
deal fingerprints to tasks: those that agree on a band meet there, sorted by their first coordinate. Bands that cover the
fingerprint in more blocks than the distance lose no pair (pigeonhole); sampled bands suit larger distances.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.scratch import drop_dir

from .components import component_roots
from .shared import file_system, materialize, shared_dir

#: Rows of a band's bucket that are compared with each other in one piece; larger buckets are dealt out as pairs of pieces.
PIECE = 256
#: One in so many fingerprints is looked at to tell which buckets are crowded. The pieces only deal out work: no pair is lost if the guess is off.
COUNTED = 16
#: Cells that shingles are hashed to, to tell common ones; sets of a shingle that are compared in one piece; from how many on they are first compared with one of them.
CELLS, CROWD, LED = 1 << 24, 1024, 32
#: Files of sets that a task keeps open at most.
OPEN_FILES = 64
#: Pairs that a task holds before it settles and passes on their links.
HELD_LINKS = 150_000
#: Pairs to be verified that a task holds before it passes on the different ones of them.
HELD_PAIRS = 1_000_000
#: Shingles of sets that a task keeps in memory at least before it forgets those read, and pairs whose verdict it remembers.
HELD_SHINGLES, HELD_VERDICTS = 4_000_000, 500_000
#: Bytes of a shingle's hash in a set's file, and bits of a set's address that count hashes in its file; the others name the file.
HASH_BYTES, OFFSET_BITS = 6, 40
#: Bits of a row's number that hold its set's size, as far as they can; the shingle's hash of 8 * HASH_BYTES bits stands above them.
SIZE_BITS = 64 - 8 * HASH_BYTES
#: Pivots of sets, as a power of 2: each holds all shingles whose hashes begin with the same bits.
PIVOT_BITS = 6
#: First shingles of a set, by tags of 32 bits, that all its rows carry, so that a pair which shares one of them is passed on in one bucket only.
HEADS = 3
SEED = 42


def sorted_once(values: np.ndarray) -> np.ndarray:
    """The different values in order, by a plain sort, which takes a part of np.unique's time here."""
    out = np.sort(values)
    return out[np.concatenate([[True], out[1:] != out[:-1]])] if len(out) else out


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted 64-bit hashes of the different runs of `shingle` words (A-Z lower-cased); of all words if fewer; none for no words.

    Words are hashed by XXH64, and those of a run are the digits of a number whose bits are mixed; runs of different lengths differ in their lane.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), dtype=">u8").astype(np.uint64)
    run = min(shingle, len(words))
    out = h[: len(h) - run + 1].copy()
    for k in range(1, run):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[k : k + len(out)]
    return sorted_once(mixed(out, run))


def shingle_hashes(text: str | None, shingle: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of `shingle` words (A-Z lower-cased), repeats included; of all words if fewer; none for no words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, seed)], dtype=np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = (starts + lengths)[shingle - 1 :].tolist()
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends)), dtype=np.uint64, count=n)


def mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Another 64 bits for each hash; lane 0 is the hash itself."""
    if lane == 0:
        return h
    with np.errstate(over="ignore"):
        h = h + np.uint64((0x9E3779B97F4A7C15 * lane) % 2**64)  # the finalizer of SplitMix64
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """One 64-bit word for each lane: a bit is 1 if set in over half the hashes."""
    out = np.zeros(lanes, dtype=np.uint64)
    if len(hashes):
        for lane in range(lanes):
            ones = np.zeros(64, dtype=np.int64)
            for start in range(0, len(hashes), 65_536):
                part = mixed(hashes[start : start + 65_536], lane).astype("<u8")
                ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[lane] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, shingle: int, lanes: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and fp (big-endian bytes of the lanes, lane 0 first) of every whole text; null and wordless texts get zeros."""
    frame = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t.as_py(), shingle), lanes).astype(">u8").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary())], names=["doc_id", "fp"])

    return frame.mapInArrow(run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, fp binary")


def disjoint_bands(bits: int, distance: int) -> list[list[int]]:
    """distance + 1 bands that cover all bits: fingerprints within the distance agree on one of them. Few bands, but large buckets."""
    return [list(map(int, x)) for x in np.array_split(np.arange(bits), distance + 1)]


def combined_bands(bits: int, distance: int, blocks: int) -> list[list[int]]:
    """Bands of all bits of blocks - distance blocks together, exact too, whose buckets stay small for billions of fingerprints.

    64 bits, distance 3 and 6 blocks make 20 bands of 31 to 33 bits.
    """
    parts = [list(map(int, x)) for x in np.array_split(np.arange(bits), blocks)]
    return [sorted(b for part in chosen for b in part) for chosen in combinations(parts, blocks - distance)]


def sampled_bands(bits: int, width: int, count: int, seed: int = SEED) -> list[list[int]]:
    """count bands of width bits, sampled anew for each band."""
    rng = np.random.default_rng(seed)
    return [sorted(map(int, rng.choice(bits, width, replace=False))) for _ in range(count)]


def shingle_sets(docs: DataFrame, shingle: int, lanes: int, folder: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fp, address and digest of the set of different shingles of every whole text; the set is written to a flat file of the folder.

    fp counts each shingle once, so that it estimates the similarity of sets. digest is equal for
    equal sets. The file holds at the address the set's size, then its sorted hashes, of 48 bits each: two sets of 1,000 shingles
    hold different ones of one hash in 4 of a thousand million cases.
    """
    frame = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, at = TaskContext.get().taskAttemptId(), 0  # differs between attempts
        assert number < 2 ** (63 - OFFSET_BITS)
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/{number}.sets") as out:
            for batch in batches:
                fps, addresses, digests = [], [], []
                for t in batch.column(1):
                    hashes = shingle_set(t.as_py(), shingle)
                    fps.append(fingerprint(hashes, lanes).astype(">u8").tobytes())
                    addresses.append((number << OFFSET_BITS) + at)
                    digests.append(xxhash.xxh3_128_digest(hashes.astype("<u8").tobytes()))
                    short = sorted_once(hashes >> np.uint64(64 - 8 * HASH_BYTES))
                    out.write(packed_hashes(np.concatenate([np.array([len(short)], dtype=np.uint64), short])))
                    at += len(short) + 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(fps, pa.binary()), pa.array(addresses, pa.int64()), pa.array(digests, pa.binary())],
                    names=["doc_id", "fp", "address", "digest"],
                )

    return frame.mapInArrow(run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, fp binary, address long, digest binary")


def packed_hashes(values: np.ndarray) -> bytes:
    """The low HASH_BYTES bytes of each value."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def unpacked_hashes(raw: bytes, n: int) -> np.ndarray:
    """The first n values of packed_hashes."""
    wide = np.zeros((n, 8), dtype=np.uint8)
    wide[:, :HASH_BYTES] = np.frombuffer(raw, dtype=np.uint8, count=n * HASH_BYTES).reshape(n, HASH_BYTES)
    return wide.view("<u8").ravel()


class SetReader:
    """Sets of shingle_sets by address, and whether two of them reach a similarity; remembers what it has read lately.

    Sets are told apart by a table of distances to pivots before they are intersected. The distance is the number of shingles that only one of
    both has; a pivot is all shingles of a region of hashes, so a set's distance to it follows from its size and how many it has there, which is what the table
    holds. By the triangle inequality two sets differ by as much as their counts do, in each region, and regions have nothing in
    common, so these differences add up.
    """

    def __init__(self, folder: str, similarity: float):
        self.fs, self.base = file_system(folder)
        self.similarity, self.files, self.sets, self.held = similarity, {}, {}, 0
        self.tables: dict[int, np.ndarray] = {}
        self.verdicts: dict[tuple[int, int], bool] = {}

    def read(self, address: int) -> np.ndarray:
        if address not in self.sets:
            number, at = address >> OFFSET_BITS, HASH_BYTES * (address & (1 << OFFSET_BITS) - 1)
            if number not in self.files:
                if len(self.files) >= OPEN_FILES:
                    self.files.pop(next(iter(self.files))).close()
                self.files[number] = self.fs.open_input_file(f"{self.base}/{number}.sets")
            raw = self.files[number].read_at(8192, at)
            n = int(unpacked_hashes(raw, 1)[0])
            if len(raw) < HASH_BYTES * (n + 1):
                raw = self.files[number].read_at(HASH_BYTES * (n + 1), at)
            if self.held > HELD_SHINGLES:
                self.sets.clear()
                self.tables.clear()
                self.held = 0
            self.sets[address] = unpacked_hashes(raw, n + 1)[1:]
            self.held += n
        return self.sets[address]

    def table(self, address: int) -> np.ndarray:
        """The set's shingles in each pivot."""
        if address not in self.tables:
            regions = (self.read(address) >> np.uint64(8 * HASH_BYTES - PIVOT_BITS)).astype(np.int64)
            self.tables[address] = np.bincount(regions, minlength=1 << PIVOT_BITS)
        return self.tables[address]

    def similar(self, a: int, b: int) -> tuple[bool, bool]:
        """Whether shared shingles are at least that part of all different ones of both, and whether this was looked up anew."""
        pair = (a, b) if a < b else (b, a)
        known = self.verdicts.get(pair)
        if known is not None:
            return known, False
        x, y = self.read(a), self.read(b)
        if min(len(x), len(y)) < self.similarity * max(len(x), len(y)) - 1e-9:
            found = False
        elif np.abs(self.table(a) - self.table(b)).sum() > (1 - self.similarity) / (1 + self.similarity) * (len(x) + len(y)) + 1e-9:
            found = False  # similar sets differ by no more
        else:
            shared = len(np.intersect1d(x, y, assume_unique=True))
            found = shared >= self.similarity * (len(x) + len(y) - shared) - 1e-9
        if len(self.verdicts) > HELD_VERDICTS:
            self.verdicts.clear()
        self.verdicts[pair] = found
        return found, True


def spanning(edges: list[tuple[np.ndarray, np.ndarray]], width: int) -> Iterator[pa.RecordBatch]:
    """Links that join what the edges join: each of their ends to the smallest that it reaches. Empties the list."""
    if not edges:
        return
    both = np.concatenate([np.concatenate([a for a, _ in edges]), np.concatenate([b for _, b in edges])]).astype(">u8")
    names, at = np.unique(both.view(np.dtype((np.void, 8 * width))).ravel(), return_inverse=True)
    half = len(at) // 2
    a, b, label = at[:half], at[half:], np.arange(len(names))
    while True:  # labels fall to the smallest reached, with halving of paths
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for ends in (a, b, label[a], label[b]):
            np.minimum.at(new, ends, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    there = np.flatnonzero(label != np.arange(len(names)))
    raw = [x.tobytes() for x in names]
    yield pa.RecordBatch.from_arrays([pa.array([raw[k] for k in there], pa.binary()), pa.array([raw[k] for k in label[there]], pa.binary())], names=["a", "b"])
    edges.clear()


def near_links(fps: DataFrame, lanes: int, distance: int, bands: list[list[int]], pivots: int = 16) -> DataFrame:
    """Links a > b (binary) between distinct fingerprints fp that differ in at most `distance` bits, found through the bands.

    The links returned span the same components as all links: within a task a fingerprint is
    linked to the smallest one that it reaches there, so no group is written out as all its pairs.
    """
    coordinate = np.dtype("u1" if 64 * lanes < 256 else ">u2")
    pivots = max(1, pivots)
    ahead = pivots * coordinate.itemsize  # bytes of a fingerprint's coordinates, which a packed one begins with
    bits = np.array([[b // 64, b % 64] for band in bands for b in band], dtype=np.int64)
    cuts = np.cumsum([0] + [len(b) for b in bands]).tolist()
    refs = np.random.default_rng(SEED).integers(0, 2**64, (pivots, lanes), dtype=np.uint64)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            words = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=">u8").reshape(n, lanes).astype(np.uint64)
            table = np.stack([np.bitwise_count(words ^ r).sum(axis=1, dtype=np.int16) for r in refs], axis=1)
            packed = np.concatenate([table.astype(coordinate).view(np.uint8).reshape(n, ahead), words.astype(">u8").view(np.uint8).reshape(n, 8 * lanes)], axis=1)
            packed = pa.array([r.tobytes() for r in packed], pa.binary())
            for band, (start, end) in enumerate(zip(cuts, cuts[1:])):
                key = np.zeros(n, dtype=np.uint64)
                for lane, bit in bits[start:end]:
                    key = (key << np.uint64(1)) | ((words[:, lane] >> np.uint64(bit)) & np.uint64(1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, band, dtype=np.int32)), pa.array(key.astype(np.int64)), packed], names=["band", "key", "packed"]
                )

    schema = "band int, key long, packed binary"
    rows = fps.select("fp").mapInArrow(keyed, schema)
    counted = fps.filter(F.pmod(F.xxhash64("fp"), F.lit(COUNTED)) == 0).select("fp").mapInArrow(keyed, schema)
    crowded = counted.groupBy("band", "key").agg((F.count("*") * COUNTED).alias("count")).filter(F.col("count") > PIECE)
    crowded = crowded.select("band", "key", F.ceil(F.col("count") / PIECE).cast("int").alias("pieces"))
    crowded = materialize(crowded, "crowded-buckets")  # few as a rule: with their size known, the rows needn't be shuffled to meet them
    piece = F.pmod(F.xxhash64("packed"), F.col("pieces").cast("long")).cast("int")
    dealt = (
        rows.join(crowded, ["band", "key"], "left")
        .withColumn("pieces", F.coalesce("pieces", F.lit(1)))
        .withColumn("piece", piece)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .select(
            F.xxhash64("band", "key", F.least("piece", "other"), F.greatest("piece", "other")).alias("bucket"),
            "packed",
        )
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        edges: list[tuple[np.ndarray, np.ndarray]] = []

        def settle(bucket: np.ndarray, words: np.ndarray, table: np.ndarray) -> None:
            live, step = np.arange(len(bucket)), 0
            while len(live):
                step += 1
                live = live[live + step < len(bucket)]
                live = live[bucket[live] == bucket[live + step]]
                live = live[table[live + step, 0] - table[live, 0] <= distance]  # rows are sorted by it: later ones are farther off
                near = live
                for p in range(1, pivots):
                    near = near[np.abs(table[near, p] - table[near + step, p]) <= distance]
                near = near[np.bitwise_count(words[near] ^ words[near + step]).sum(axis=1, dtype=np.int64) <= distance]
                if len(near):
                    edges.append((words[near], words[near + step]))

        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column(0).to_numpy()
            packed = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(-1, ahead + 8 * lanes)
            words = np.ascontiguousarray(packed[:, ahead:]).view(">u8").astype(np.uint64)
            table = np.ascontiguousarray(packed[:, :ahead]).view(coordinate).astype(np.int16)
            if held:
                bucket, words, table = (np.concatenate([a, b]) for a, b in zip(held[0], (bucket, words, table)))
            last = np.searchsorted(bucket, bucket[-1])  # the last bucket may go on in the next batch
            settle(bucket[:last], words[:last], table[:last])
            held = [(bucket[last:], words[last:], table[last:])]
            if sum(len(a) for a, _ in edges) > HELD_LINKS:
                yield from spanning(edges, lanes)
        if held:
            settle(*held[0])
        yield from spanning(edges, lanes)

    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "packed").mapInArrow(compare, "a binary, b binary")


def common_shingles(sets: DataFrame, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Cells of hashed shingles and their level from 1: those of which one in 4 * COUNTED of sets(address) hold several, and several times as many as on average.

    Counted over the distinct sets. The cells are many more than a sample of 6 GB has shingles to spare, so that how common a shingle may be hardly
    rises with the table. It tells which shingles are met last and nothing else, so no pair depends on it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held = SetReader(folder, 1.0), [np.empty(0, dtype=np.int64)]
        for batch in batches:
            for address in batch.column(0).to_pylist():
                held.append((reader.read(address) % np.uint64(CELLS)).astype(np.int64))
            there, n = np.unique(np.concatenate(held), return_counts=True)
            held = [np.empty(0, dtype=np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(n)], names=["cell", "n"])

    cells = sets.filter(F.pmod(F.xxhash64("address"), F.lit(4 * COUNTED)) == 0).select("address").mapInArrow(count, "cell long, n long")
    cells = materialize(cells.groupBy("cell").agg(F.sum("n").alias("n")), "shingle-cells")
    most = 3 + 4 * (cells.agg(F.sum("n")).first()[0] or 0) / CELLS
    hot = cells.filter(F.col("n") > most).toArrow()  # a quarter of CELLS at most
    return hot["cell"].to_numpy().astype(np.int32), 1 + np.log2(hot["n"].to_numpy() / most).astype(np.uint8)


def similar_links(sets: DataFrame, similarity: float, distance: int, folder: str) -> DataFrame:
    """Links a > b (addresses as eight bytes) between sets(fp, address) of a folder of shingle_sets that reach a similarity; they span the components of all such pairs.

    Two sets that reach it share one of the first shingles of both, in any order that is the same for all: of s shingles those that may be
    missed, a fifth at 0.8, and one more. Common shingles come last in that order, so those that share a passage and little else hardly
    meet. Sets that meet on a shingle are compared if their sizes allow it and their fingerprints differ in
    at most `distance` bits, which leaves out none at a distance of five or six deviations, and verified; pairs connected already are passed over.
    A row is five numbers: its shingle with the set's size in the low bits, the fingerprint of one lane, the address, and in two the tags of the set's first shingles
    and the shingle's place in the order. Tags have buckets of their own, so a pair that shares some of them is passed on where the smallest is, and nowhere else. Others are
    passed on where they meet early enough: were it their first shingle in common, so much would be left to share. That holds where they do meet first, so no pair is lost, and
    pairs passed on hardly grow with the tasks in which they meet. Pairs are written first and verified once each; only a large bucket's sets are
    verified there, so that a group of near copies isn't written as all its pairs.
    """
    cells, levels = common_shingles(sets, folder)  # few as a rule
    names = ["key", "fp", "address", "heads", "place"]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, level = SetReader(folder, similarity), np.zeros(CELLS, dtype=np.uint8)
        level[cells] = levels
        for batch in batches:
            parts, held = [], 0
            fps = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=">i8").tolist()
            for fp, address in zip(fps, batch.column(1).to_pylist()):
                h = reader.read(address)
                if not len(h):
                    continue
                first = np.lexsort((h, level[(h % np.uint64(CELLS)).astype(np.int64)]))[: len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1]
                tags = (h[first[:HEADS]] >> np.uint64(8 * HASH_BYTES - 32)) | np.uint64(1)  # never 0, which stands for none
                buckets = np.concatenate([h[first], tags << np.uint64(8 * HASH_BYTES - 32)])
                key = (buckets << np.uint64(SIZE_BITS)) | np.uint64(min(len(h), (1 << SIZE_BITS) - 1))
                heads = np.zeros(HEADS, dtype=np.uint64)
                heads[: len(tags)] = tags
                place = np.zeros(len(key), dtype=np.uint64)
                place[: len(first)] = np.arange(len(first))
                two = np.full(len(key), (heads[0] << np.uint64(32)) | heads[1]), (heads[2] << np.uint64(32)) | place
                parts.append((key.view(np.int64), np.full(len(key), fp), np.full(len(key), address), *(x.view(np.int64) for x in two)))
                held += len(key)
                if held > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], names=names)
                    parts, held = [], 0
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], names=names)

    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = sets.select("fp", "address").repartitionByRange(n, "address").sortWithinPartitions("address")  # read in the order of the files
    layout, shingle = ", ".join(f"{x} long" for x in names), F.shiftright("key", SIZE_BITS)
    rows = sets.mapInArrow(keyed, layout).withColumn("shingle", shingle)
    counted = sets.filter(F.pmod(F.xxhash64("address"), F.lit(COUNTED)) == 0).mapInArrow(keyed, layout)
    crowded = counted.groupBy(shingle.alias("shingle")).agg((F.count("*") * COUNTED).alias("count")).filter(F.col("count") > CROWD)
    crowded = materialize(crowded.select("shingle", F.ceil(F.col("count") / CROWD).cast("int").alias("pieces")), "crowded-shingles")
    piece = F.pmod(F.xxhash64("address"), F.col("pieces").cast("long")).cast("int")
    dealt = rows.join(crowded, "shingle", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1))).withColumn("piece", piece)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    size = F.col("key").bitwiseAND((1 << SIZE_BITS) - 1)
    # a pair of pieces shares its bucket with another shingle at worst: that only adds pairs to look at
    of_pieces = F.shiftleft(F.xxhash64("shingle", F.least("piece", "other"), F.greatest("piece", "other")), SIZE_BITS).bitwiseOR(size)
    whole = lambda c, pieced: F.when(F.col("pieces") == 1, F.col(c)).otherwise(pieced).alias(c)  # noqa: E731  in pieces every pair is due
    dealt = dealt.select(whole("key", of_pieces), "fp", "address", whole("heads", F.lit(0)), whole("place", F.lit(0)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, edges, held = SetReader(folder, similarity), [], None
        pairs: list[np.ndarray] = []  # larger address first

        def told(known: bool) -> Iterator[pa.RecordBatch]:
            """Passes on the links known, or the pairs still to be verified, and forgets them."""
            if known:
                for batch in spanning(edges, 1):
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.ones(batch.num_rows, dtype=bool))], names=["a", "b", "known"])
            elif pairs:
                once = np.unique(np.concatenate(pairs).astype(">u8").view("V16").ravel()).view("V8").reshape(-1, 2)
                pairs.clear()
                ends = [pa.array([x.tobytes() for x in once[:, k]], pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ends, pa.array(np.zeros(len(once), dtype=bool))], names=["a", "b", "known"])

        def links_of(bucket: np.ndarray, size: np.ndarray, words: np.ndarray) -> None:
            """Adds the links within each large bucket, and the pairs of small ones that are due there; rows are in the order of bucket and size."""
            low = np.uint64(0xFFFFFFFF)
            tags = np.stack([words[:, 2] >> np.uint64(32), words[:, 2] & low, words[:, 3] >> np.uint64(32)], axis=1)
            place = (words[:, 3] & low).astype(np.int64)
            fp, (address, at) = words[:, 0], np.unique(words[:, 1], return_inverse=True)
            label, address = np.arange(len(address)), address.tolist()

            def verify(k: int, others: np.ndarray) -> None:
                for j in others.tolist():
                    a, b = label[at[k]], label[at[j]]
                    if a != b:
                        similar, anew = reader.similar(address[at[k]], address[at[j]])
                        if similar:
                            label[label == max(a, b)] = min(a, b)
                            if anew:
                                edges.append((words[[k], 1:2], words[[j], 1:2]))

            def due(one: np.ndarray, other: np.ndarray) -> np.ndarray:
                """Pairs with tags in common are due in the bucket of the smallest, others where enough is left to share if this is the first shingle shared."""
                a, b = tags[one, :, None], tags[other, None, :]
                least = np.where(((a == b) & (a > 0)).any(axis=2), tags[one], low + np.uint64(1)).min(axis=1)
                left = np.minimum(size[one] - place[one], size[other] - place[other])
                enough = left >= similarity / (1 + similarity) * (size[one] + size[other]) - 1e-9
                enough |= np.maximum(size[one], size[other]) == (1 << SIZE_BITS) - 1  # larger than told
                own = (least << np.uint64(64 - 32)).view(np.int64) >> SIZE_BITS
                return np.where(least > low, enough, bucket[one] == own)

            def met_by(one: np.ndarray, other: np.ndarray) -> None:
                if len(one):
                    pair = words[one, 1], words[other, 1]
                    pairs.append(np.stack([np.maximum(*pair), np.minimum(*pair)], axis=1))

            def near(k: int, others: np.ndarray) -> np.ndarray:
                others = others[label[at[others]] != label[at[k]]]
                fits = (np.minimum(size[others], size[k]) >= similarity * np.maximum(size[others], size[k]) - 1e-9) & (np.bitwise_count(fp[others] ^ fp[k]) <= distance)
                return others[fits]

            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            lengths = np.diff(np.append(starts, len(bucket)))
            small = np.repeat(lengths <= LED, lengths)
            live, step = np.flatnonzero(small), 0
            while len(live):
                step += 1
                live = live[live + step < len(bucket)]
                live = live[(bucket[live] == bucket[live + step]) & (size[live] >= similarity * size[live + step] - 1e-9)]  # later ones are larger
                near_ones = live[(np.bitwise_count(fp[live] ^ fp[live + step]) <= distance) & (at[live] != at[live + step])]
                near_ones = near_ones[due(near_ones, near_ones + step)]
                met_by(near_ones, near_ones + step)
            for start, length in zip(starts[lengths > LED].tolist(), lengths[lengths > LED].tolist()):
                rows = np.arange(start, start + length)
                leader = start + length // 2
                verify(leader, near(leader, rows))  # a group of near copies is joined here; only what isn't goes on
                for k in rows[label[at[rows]] != label[at[leader]]].tolist():
                    verify(k, near(k, rows))

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            bucket, size = key >> SIZE_BITS, key & ((1 << SIZE_BITS) - 1)
            words = np.stack([batch.column(k).to_numpy() for k in range(1, 5)], axis=1).view(np.uint64)
            if held:
                bucket, size, words = (np.concatenate([a, b]) for a, b in zip(held, (bucket, size, words)))
            last = np.searchsorted(bucket, bucket[-1])  # the last bucket may go on in the next batch
            links_of(bucket[:last], size[:last], words[:last])
            held = (bucket[last:], size[last:], words[last:])
            if len(edges) > HELD_LINKS:
                yield from told(True)
            if sum(map(len, pairs)) > HELD_PAIRS:
                yield from told(False)
        if held:
            links_of(*held)
        yield from told(True)
        yield from told(False)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, edges = SetReader(folder, similarity), []
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=">u8").astype(np.uint64) for k in (0, 1))
            similar = np.array([reader.similar(*pair)[0] for pair in zip(a.tolist(), b.tolist())])
            edges.append((a[similar, None], b[similar, None]))
            if sum(len(x) for x, _ in edges) > HELD_LINKS:
                yield from spanning(edges, 1)
        yield from spanning(edges, 1)

    met = dealt.repartition(n, shingle).sortWithinPartitions("key").mapInArrow(compare, "a binary, b binary, known boolean")
    met = materialize(met, "met-pairs")
    pairs = met.filter("NOT known").select("a", "b").distinct().repartitionByRange(n, "a", "b").sortWithinPartitions("a", "b")
    return met.filter("known").select("a", "b").unionByName(pairs.mapInArrow(verified, "a binary, b binary"))


def components_of(distinct: DataFrame, key: str, links: DataFrame) -> DataFrame:
    """key and component_id (the smallest `least` of the component) for distinct(key, fp, least) and links between fps.

    Names and smallest members are tables of their own, so that a join can split a component of very many members.
    """
    roots = component_roots(links)
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(F.col(key).alias("of"), "least", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "members")
    smallest = materialize(named.groupBy("root").agg(F.min("least").alias("component_id")), "smallest-members")
    return materialize(named.join(smallest, "root").select("of", "component_id"), "components")


def simhash_components(
    docs: DataFrame,
    shingle: int = 3,
    lanes: int = 1,
    distance: int = 3,
    bands: list[list[int]] | None = None,
    pivots: int = 16,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """Groups documents whose fingerprints are linked, directly or through others.

    Returns doc_id, fp (binary) and component_id, the smallest doc_id of the group, for every row
    of docs; repeated rows stay repeated, a null doc_id counts as the largest, null and empty texts
    share the zero fingerprint. Fingerprints link at `distance` or fewer differing bits out of
    64 * lanes. bands=None combines three of distance + 3 blocks of bits, which is exact; their number grows with the
    cube of the distance, so distances of dozens ask for bands of their own (sampled_bands, which isn't exact).
    """
    fp = materialize(fingerprints(docs, shingle, lanes, text, doc_id), "fingerprints")
    least = materialize(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    bands = bands or combined_bands(64 * lanes, distance, distance + 3)
    links = materialize(near_links(least, lanes, distance, bands, pivots), "links")
    of_fp = components_of(least, "fp", links)
    return fp.join(of_fp, F.col("fp") == F.col("of")).select("doc_id", "fp", "component_id")


def similar_components(docs: DataFrame, similarity: float, shingle: int = 5, distance: int = 27, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Groups documents whose sets of shingles reach a similarity (shared by all different ones), directly or through others.

    Returns doc_id and component_id as simhash_components does; texts without words form a group. All pairs are
    found (similar_links), and each is verified on the sets, so nothing below the similarity is linked.
    """
    folder = shared_dir(docs.sparkSession, "shingle-sets")
    rows = materialize(shingle_sets(docs, shingle, 1, folder, text, doc_id), "fingerprints")
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.min(F.struct("address", "fp")).alias("first"))
    least = least.select("digest", "least", F.col("first.fp").alias("short"), F.col("first.address").alias("address"))
    least = materialize(least.withColumn("fp", F.unhex(F.lpad(F.hex("address"), 16, "0"))), "distinct-sets")  # sets go by their address from here on
    links = materialize(similar_links(least.select(F.col("short").alias("fp"), "address"), similarity, distance, folder), "links")
    drop_dir(docs.sparkSession, folder)  # all pairs are judged
    of_set = components_of(least, "digest", links)
    return rows.join(of_set, F.col("digest") == F.col("of")).select("doc_id", "component_id")


def hex_of(fp: Column) -> Column:
    """Lower-case hexadecimal digits of a fingerprint."""
    return F.lower(F.hex(fp))
