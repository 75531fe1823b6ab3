"""Packing by power-of-two decomposition.

Every document's tokens are split into pieces whose lengths are the binary digits of its length: as many of the largest
length as fit, then falling powers of two. Each piece is a sequence of its own, so none crosses documents and none
is padded; sequences of equal length lie together in one folder, from which batches of one shape are drawn.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_dir

#: Characters that are split into words at a time, words whose ids a task remembers, and the longest that it does.
AT_ONCE, HELD_WORDS, LONGEST_WORD = 1 << 22, 400_000, 64
#: Words that are given to the tokenizer as one text.
WORDS_IN_LINE = 256
#: Where a letter of ASCII or Latin-1 meets other ASCII than letters, digits, white space and the apostrophe, tokens end and no characters compose.
LETTER, MARK = r"[a-z\x{df}-\x{f6}\x{f8}-\x{ff}]", r"[!-&(-/:-@\[-`{-~]"
#: Bytes of tokens that a task gathers before it passes them on.
PASSED_ON = 8 << 20


class WordEncoder:
    """Ids of whole texts by a lower-casing tokenizer whose tokens don't cross white space, as little-endian unsigned 32-bit numbers.

    Many texts are cut into words at once, and each different word is given to the tokenizer once while it is remembered. Words end at
    spaces, tabs and line ends, and where letters meet punctuation; ASCII is lower-cased first, so fewer are different. Texts that may hold
    the name of a special token are only cut at white space.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {"": b""}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # tokens that end a word
        self.ends[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True

    def ids(self, words: list[str]) -> list[bytes]:
        """Ids of words of small letters, given to the tokenizer many at a time and told apart by the tokens that end a word."""
        lines = [" ".join(words[k : k + WORDS_IN_LINE]) for k in range(0, len(words), WORDS_IN_LINE)]
        flat = np.array([k for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False) for k in e.ids], dtype="<u4")
        cuts = [0, *(4 * (np.flatnonzero(self.ends[flat]) + 1)).tolist()]
        if len(cuts) != len(words) + 1 or cuts[-1] != 4 * len(flat):
            raise ValueError("the tokenizer doesn't end each word with one token of its own")
        raw = flat.tobytes()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def of_words(self, words: list[str]) -> list[bytes]:
        """Ids of different words."""
        found = list(map(self.known.get, words))
        new = [w for w, x in zip(words, found) if x is None]
        if new:
            plain = [w for w in new if w.isascii() and w.isalpha() and w.islower()]
            coded = dict(zip(plain, self.ids(plain)))
            odd = [w for w in new if w not in coded]
            coded |= {w: np.array(e.ids, dtype="<u4").tobytes() for w, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False))}
            rest = map(coded.__getitem__, new)
            found = [next(rest) if x is None else x for x in found]
            if len(self.known) + len(new) > HELD_WORDS:
                self.known = {"": b""}
            self.known.update((w, coded[w]) for w in new[:HELD_WORDS] if len(w) <= LONGEST_WORD)
        return found

    def of_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        column = pa.array(texts, pa.string())
        special = pc.any(pc.match_substring(column, "<|")).as_py()
        for space in "\n\t\r":
            column = pc.replace_substring(column, space, " ")
        if not special:
            column = pc.ascii_lower(column)
            for before, after in ((LETTER, MARK), (MARK, LETTER)):
                column = pc.replace_substring_regex(column, f"({before})({after})", r"\1 \2")
        words = pc.split_pattern(column, " ")
        coded = words.flatten().dictionary_encode()
        ids = self.of_words(coded.dictionary.to_pylist())
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, first, code = np.frombuffer(b"".join(ids), dtype="<u4"), np.cumsum(length) - length, coded.indices.to_numpy()
        ends = np.cumsum(length[code])
        out = flat[np.repeat(first[code] - ends + length[code], length[code]) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[words.offsets.to_numpy() - words.offsets[0].as_py()].tolist()
        return [out[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]

    def __call__(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text in turn; long ones are cut at spaces."""
        held, size, parts = [], 0, []
        for text in texts:
            at = 0
            while True:
                end = text.find(" ", at + AT_ONCE)
                held.append((text[at:end] if end >= 0 else text[at:], end < 0))
                size += len(held[-1][0])
                if size > AT_ONCE:
                    yield from self.settled(held, parts)
                    held, size = [], 0
                if end < 0:
                    break
                at = end
        yield from self.settled(held, parts)

    def settled(self, held: list[tuple[str, bool]], parts: list[bytes]) -> Iterator[bytes]:
        """Ids of texts that end among the parts held; parts: of the text that goes on."""
        for ids, (_, ends) in zip(self.of_texts([t for t, _ in held]) if held else [], held):
            parts.append(ids)
            if ends:
                yield b"".join(parts)
                parts.clear()


def binary_lengths(n: int, largest: int) -> list[int]:
    """Falling powers of two up to `largest` (one of them) that add up to n: the largest as often as it fits, each other once at most."""
    rest = n % largest
    return [largest] * (n // largest) + [1 << b for b in range(largest.bit_length() - 2, -1, -1) if rest >> b & 1]


def binary_pieces(docs: DataFrame, tokenizer: str, end: int, largest: int = 2048, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each piece of every whole text: doc_id, start, length, tokens (binary, little-endian unsigned 32-bit ids) and doc_tokens.

    A document is its ids and the id `end`, so null and empty texts are one piece of one token. Pieces are written to the shared
    folder, a folder for each length; part and nth are the task and the place among its pieces of that length. Repeated rows
    are documents of their own. No rows for an empty table.
    """
    if largest < 1 or largest & largest - 1:
        raise ValueError(f"{largest} is no power of two")
    frame = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    schema = f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, start long, tokens binary, doc_tokens long, part int, nth long, length int"
    last = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = WordEncoder(tokenizer), TaskContext.get().partitionId(), dict.fromkeys(binary_lengths(2 * largest - 1, largest), 0)

        def passed(own: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            start, tokens, total, nth, length = zip(*rows)
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
            columns = [pa.array(x, k) for x, k in zip((start, tokens, total, [part] * len(rows), nth, length), kinds)]
            return pa.RecordBatch.from_arrays([own, *columns], names=["doc_id", "start", "tokens", "doc_tokens", "part", "nth", "length"])

        for batch in batches:
            rows, of, held = [], [], 0
            for k, ids in enumerate(encode(x.as_py() for x in batch.column(1))):
                ids += last
                at, n = 0, len(ids) // 4
                for length in binary_lengths(n, largest):
                    rows.append((at, ids[4 * at : 4 * (at + length)], n, seen[length], length))
                    of.append(k)
                    seen[length] += 1
                    at += length
                    held += 4 * length
                    if held > PASSED_ON:
                        yield passed(batch.column(0).take(pa.array(of)), rows)
                        rows, of, held = [], [], 0
            if rows:
                yield passed(batch.column(0).take(pa.array(of)), rows)

    folder = shared_dir(docs.sparkSession, "sequences")
    frame.mapInArrow(run, schema).write.partitionBy("length").parquet(folder)
    return docs.sparkSession.read.schema(schema).parquet(folder)


def numbered(pieces: DataFrame) -> DataFrame:
    """Pieces with sequence_id, gapless from 0, and offset (0: a piece is a whole sequence) in place of part and nth.

    Sequences of a length have consecutive ids, the longest first. Ids are prefix sums of counts by length and task, so no piece is moved or sorted.
    """
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    of_length = counts.groupBy("length").agg(F.sum("n").alias("all"))
    longer = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)  # one row a length
    of_length = of_length.select("length", F.coalesce(F.sum("all").over(longer), F.lit(0)).alias("longer"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).join(of_length, "length")
    first = first.select("length", "part", (F.col("before") + F.col("longer")).alias("first"))
    rest = [c for c in pieces.columns if c not in ("part", "nth")]
    return pieces.join(first, ["length", "part"]).select(*rest, (F.col("first") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
