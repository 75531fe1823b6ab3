"""Byte-level BPE encoding and decoding by merge replay over the distinct words of a corpus block.

An inverted index maps each token pair to the positions where it occurs among all distinct words.
The merges are applied in rank order over the whole index; each one touches only the neighbours
of the positions it rewrites. Ranks decide every word on its own, so each Spark task replays the
merges over the words of its own blocks of documents and nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of documents that are encoded together.
BLOCK_CHARS = 2_000_000
#: Places of one pair from which on they are merged as arrays.
BULK = 24
#: Words whose ids a worker remembers between blocks, give or take those of a block.
REMEMBERED = 300_000

# Letters, numbers and white space up to U+024F, where most texts stay.
LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
NUMBERS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
SPACES = "\t-\r \u0085\u00a0"
#: A rewriting of the GPT-2 pattern for texts without characters beyond U+024F.
LATIN = re.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
BEYOND = re.compile("[^\u0000-\u024f]")


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def class_of(escape: str) -> str:
    """What stands for `escape` (a letter, a number, white space) within brackets: the characters that tiktoken itself counts as such."""
    import tiktoken

    coder = tiktoken.Encoding("class", pat_str=escape, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    codes = np.frombuffer(bytes(coder.encode_ordinary(every)).decode().encode("utf-32-le"), dtype="<u4").astype(np.int64)
    return "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in np.split(codes, np.flatnonzero(np.diff(codes) > 1) + 1))


def with_classes(pattern: str) -> str:
    """A pattern with tiktoken's classes spelled out, as libraries know characters of different Unicode versions."""
    classes = {e: class_of(e) for e in (r"\p{L}", r"\p{N}", r"\s") if e in pattern or e == r"\s"}
    out, within = [], False
    for part in re.split(r"(\\p\{[LN]\}|\\.|[\[\]])", pattern):
        if part in ("[", "]"):
            within = part == "["
            out.append(part)
        elif part in classes:
            out.append(classes[part] if within else f"[{classes[part]}]")
        elif part == r"\S" and not within:
            out.append(f"[^{classes[r'\s']}]")
        else:
            out.append(part)
    return "".join(out)


class MergeReplay:
    """Encodes sets of words by replaying ranked merges over an inverted pair index."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.n = max(ranks.values()) + 1
        self.bytes = [b""] * self.n
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        #: Every pair of tokens whose bytes make a token, as left * n + right, and that token's rank.
        self.pairs = {
            left * self.n + right: rank
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None
        }
        self.keys = np.array(sorted(self.pairs), dtype=np.int64)
        self.made = np.array([self.pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        lengths = np.array([len(t) for t in self.bytes], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        self.lengths = lengths
        self.flat = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)

    def ranks_of(self, keys: np.ndarray) -> np.ndarray:
        """The ranks of many pairs at once, -1 for those that form no token."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.made[at], -1)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        whole = self.ranks.get
        out: list[bytes | None] = [None if (r := whole(w)) is None else r.to_bytes(4, "little") for w in words]
        split = [k for k, ids in enumerate(out) if ids is None and words[k]]
        for k, word in enumerate(words):
            if not word:
                out[k] = b""
        if not split:
            return out
        lengths = np.array([len(words[k]) for k in split], dtype=np.int64)
        starts = np.cumsum(lengths + 1) - lengths  # a gap stands before each word and after the last
        size = int(starts[-1] + lengths[-1] + 1)
        tok = np.full(size, -(self.n * self.n), dtype=np.int64)  # no pair with a gap is a key
        letters = np.frombuffer(b" ".join([words[k] for k in split]), dtype=np.uint8)
        tok[1:-1] = np.array(self.byte_ids, dtype=np.int64)[letters]
        tok[starts - 1] = -(self.n * self.n)
        self.replay(tok)
        alive = np.flatnonzero(tok >= 0)
        ids = tok[alive].astype("<u4").tobytes()
        cuts = np.searchsorted(alive, np.concatenate([starts, [size]])).tolist()
        for i, k in enumerate(split):
            out[k] = ids[4 * cuts[i] : 4 * cuts[i + 1]]
        return out

    def replay(self, tok: np.ndarray) -> None:
        """Applies all merges to words laid end to end between gaps; swallowed tokens become gaps."""
        n, size, gap = self.n, len(tok), -(self.n * self.n)
        before, after = np.arange(-1, size - 1), np.arange(1, size + 1)
        index: dict[int, list[int]] = {}  # rank of a pair -> positions of its left token
        heap: list[int] = []

        def add(ranks: np.ndarray, places: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order].tolist()
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(places)]
            for rank, start, end in zip(ranks[cuts[:-1]].tolist(), cuts, cuts[1:]):
                if rank in index:
                    index[rank] += places[start:end]
                else:
                    index[rank] = places[start:end]
                    heapq.heappush(heap, rank)

        first = self.ranks_of(tok[:-1] * n + tok[1:])
        there = np.flatnonzero(first >= 0)
        if len(there):
            add(first[there], there)
        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank)
            if len(places) >= BULK:
                places = self.merge_many(rank, np.unique(np.array(places)), tok, before, after, add)
            if places:
                self.merge_few(rank, sorted(places), memoryview(tok), memoryview(before), memoryview(after), index, heap)

    def merge_many(self, rank, places, tok, before, after, add) -> list[int]:
        """Merges all places that don't meet each other at once; returns the others, to be merged one by one."""
        n, gap = self.n, -(self.n * self.n)
        places = places[after[places] < len(tok)]
        rights = after[places]
        valid = self.ranks_of(tok[places] * n + tok[rights]) == rank
        places, rights = places[valid], rights[valid]
        if not len(places):
            return []
        nexts, prevs = after[rights], before[places]
        new_right, new_left = self.ranks_of(rank * n + tok[nexts]), self.ranks_of(tok[prevs] * n + rank)
        lower = min(x[x >= 0].min(initial=rank) for x in (new_right, new_left)) < rank or self.pairs.get(rank * n + rank, rank) < rank
        if lower or (rights[:-1] == places[1:]).any():
            return places.tolist()
        meet = nexts[:-1] == places[1:]
        alone = ~(np.append(meet, False) | np.append(False, meet))
        rest = places[~alone].tolist()
        places, rights, nexts, prevs, new_right, new_left = (x[alone] for x in (places, rights, nexts, prevs, new_right, new_left))
        tok[places], tok[rights] = rank, gap
        after[places] = nexts
        before[nexts] = places
        ranks = np.concatenate([new_right, new_left])
        at = np.concatenate([places, prevs])[ranks >= 0]
        if len(at):
            add(ranks[ranks >= 0], at)
        return rest

    def merge_few(self, rank, places, tok, before, after, index, heap) -> None:
        """Merges places from left to right."""
        n, size, gap, rank_of = self.n, len(tok), -(self.n * self.n), self.pairs.get
        for i, at in enumerate(places):
            b_at = after[at]
            if b_at >= size or rank_of(tok[at] * n + tok[b_at]) != rank:
                continue  # a neighbour has taken one of the two
            nxt, prev = after[b_at], before[at]
            tok[at] = rank
            tok[b_at] = gap
            after[at] = nxt
            before[nxt] = at
            lower = False
            for key, place in ((rank * n + tok[nxt], at), (tok[prev] * n + rank, prev)):
                new = rank_of(key)
                if new is not None:
                    if new in index:
                        index[new].append(place)
                    else:
                        index[new] = [place]
                        heapq.heappush(heap, new)
                    lower = lower or new < rank
            if lower and i + 1 < len(places):  # a lower rank arose: it goes first, the rest of this one after it
                if rank in index:
                    index[rank] += places[i + 1 :]
                else:
                    index[rank] = places[i + 1 :]
                    heapq.heappush(heap, rank)
                return

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that a sequence of ids stands for."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ends):
            return b""
        shift = np.repeat(self.starts[ids] - ends + lengths, lengths)
        return self.flat[np.arange(ends[-1]) + shift].tobytes()


class Encoder:
    """Whole texts to ids: distinct words of a block are replayed together, then looked up."""

    def __init__(self, ranks_path: str, pattern: str):
        self.replay = MergeReplay(load_ranks(ranks_path))
        self.pattern = regex.compile(with_classes(pattern))
        import public_tokenizers

        self.latin = pattern == public_tokenizers.PATTERN
        #: Ids of words that occurred of late, and of those before them; the latter go when the former fill up.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        """The pieces that are encoded separately."""
        if self.latin and not BEYOND.search(text):
            return LATIN.findall(text)
        return [m.group() for m in self.pattern.finditer(text)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.young) > REMEMBERED // 2:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        split = [self.words(t) for t in texts]
        fresh = []
        for word in {w for ws in split for w in ws if w not in young}:
            if (ids := old.get(word)) is None:
                fresh.append(word)
            else:
                young[word] = ids
        young.update(zip(fresh, self.replay.encode([w.encode("utf-8", "replace") for w in fresh])))
        return [b"".join(map(young.__getitem__, ws)) for ws in split]


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(ranks_path, pattern)


def blocks(texts: Iterable[str | None], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Start and texts of runs of documents of about limit characters; null counts as empty."""
    start, held, size = 0, [], 0
    for k, text in enumerate(texts):
        held.append(text or "")
        size += len(held[-1])
        if size >= limit:
            yield start, held
            start, held, size = k + 1, [], 0
    if held:
        yield start, held


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encodes and decodes every whole text.

    Adds to docs, in place of columns of these names: n_tokens long, ids_sha256 and decoded_sha256
    string, and with keep_ids also ids (array of int). The text column itself goes unless keep_ids
    is set, in which case all columns stay. Null and empty texts have no tokens (digests of nothing);
    repeated rows are encoded alike; other columns pass unchanged.
    """
    made = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "array<int>"} if keep_ids else {})
    others = [f for f in docs.schema.fields if f.name not in made and (keep_ids or f.name != text)]
    frame = docs.select(F.col(f"`{text}`").cast("string").alias("__text"), *[F.col(f"`{f.name}`") for f in others])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + [f"{k} {v}" for k, v in made.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        for batch in batches:
            counts, shas, decoded, ids = [], [], [], []
            for _, texts in blocks(t.as_py() for t in batch.column(0)):
                for raw in enc.encode(texts):
                    array = np.frombuffer(raw, dtype="<u4")
                    counts.append(len(array))
                    shas.append(hashlib.sha256(raw).hexdigest())
                    decoded.append(hashlib.sha256(enc.replay.decode(array)).hexdigest())
                    if keep_ids:
                        ids.append(array.astype(np.int32))
            columns = [batch.column(k + 1) for k in range(len(others))]
            columns += [pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())]
            columns += [pa.array(ids, pa.list_(pa.int32()))] if keep_ids else []
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in others] + list(made))

    return frame.mapInArrow(run, schema)
