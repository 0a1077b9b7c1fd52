"""Best-fit packing of tokenised documents into sequences of a fixed length, in bulk rounds.

Pieces and gaps are range-sorted by length. Lengths are whole numbers up to the capacity, so equal pieces
form at most ``capacity`` runs and so do equal gaps; a round takes the longest run of open pieces and
sweeps to its successor, the run of smallest gaps that hold it. Piece i of a run goes to gap i of the other
(conflicts are settled by rank), the gaps shrink, and the next round follows until no piece is open. Where no
gap is large enough, new sequences are opened. A round works on whole runs, however many documents they
hold, so the number of rounds depends on the capacity and not on the data, and the outcome is that of
best-fit decreasing over single documents. Only run lengths leave the executors; ranks inside a run are
counted by many tasks and every piece finds its place by its rank.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from aisle.llm.bpe import LETTERS, is_simple
from aisle.llm.common import stored, text_of
from aisle.llm.memo import Recalled, slices_by_size

CAPACITY = 2048
END = 0
VOCABULARY = "word_bpe_49k.json"
REMEMBERED = 150_000  # words whose ids a worker keeps, in each of two generations
SIGNS = rb"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""  # of simple texts
SLICE_BYTES = 1_000_000  # texts of so many bytes, or one longer text, are encoded at a time


class WordTokens:
    """Ids of whole texts, looked up word by word.

    The tokenizer never merges across white space, and a word's letters, digits and signs are merged apart. So
    words are kept with their ids, and a new word of a simple text is put together from its parts, which are
    words themselves. Words of other texts go through the tokenizer's own normalisation. Added tokens such as
    <|endoftext|> are found in the raw text first, as the library does, and what stands between them is encoded by
    itself.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        added = {token.content: number for number, token in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = {content: number.to_bytes(4, "little") for content, number in added.items()}
        self.between = re.compile(f"({'|'.join(map(re.escape, sorted(added, key=len, reverse=True)))})") if added else None
        self.parts = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+")
        # how the vocabulary writes each byte above ASCII
        write = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.shown = {}
        for two in (chr(c) for c in range(0x80, 0x800)):
            self.shown |= zip(two.encode(), write(two)[0][0], strict=True)
        self.as_bytes = [number.to_bytes(4, "little") for number in range(1 + max(self.tokenizer.get_vocab().values()))]
        self.remembered = remembered
        self.known = Recalled(self._simple_word, remembered)
        self.raw: dict[bytes, bytes] = {}

    def _simple_word(self, word: bytes) -> bytes:
        letters = word.rstrip(SIGNS)
        if not (letters.isalpha() or letters.decode().isalpha()):
            parts = [part.encode() for part in self.parts.findall(word.decode())]
            return self._part(word) if len(parts) == 1 else b"".join(map(self.known.__getitem__, parts))
        if len(letters) == len(word):
            return self._part(word)
        return self.known[letters] + self.known[word[len(letters) :]]  # signs after a word are one part

    def _part(self, part: bytes) -> bytes:
        shown = part.decode() if part.isascii() else part.decode("latin-1").translate(self.shown)
        return b"".join([self.as_bytes[x.id] for x in self.tokenizer.model.tokenize(shown)])

    def _learn_any(self, new: list[bytes]) -> None:
        found = self.tokenizer.encode_batch_fast([word.decode() for word in new], add_special_tokens=False)
        for word, ids in zip(new, found, strict=True):
            self.raw[word] = np.asarray(ids.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if self.between is None or not any(map(self.between.search, texts)):
            return self._encode_plain(texts)
        cut = [self.between.split(text) for text in texts]  # added tokens stand at odd places
        plain = iter(self._encode_plain([part for parts in cut for part in parts[::2]]))
        return [b"".join(self.added[part] if i % 2 else next(plain) for i, part in enumerate(parts)) for parts in cut]

    def _encode_simple(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, text.lower().encode().split()))

    def _encode_other(self, texts: list[str]) -> list[bytes]:
        cut = [text.encode().split() for text in texts]
        wanted = set(chain.from_iterable(cut))
        new = wanted.difference(self.raw)
        if len(self.raw) + len(new) > self.remembered:
            self.raw.clear()
            new = wanted
        if new:
            self._learn_any(list(new))
        return [b"".join(map(self.raw.__getitem__, words)) for words in cut]

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        self.known.age()
        simple = [is_simple(text) for text in texts]
        from_other = iter(self._encode_other([text for text, ok in zip(texts, simple, strict=True) if not ok]))
        return [
            self._encode_simple(text) if ok else next(from_other) for text, ok in zip(texts, simple, strict=True)
        ]


@lru_cache(maxsize=2)
def worker_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit) of every document.

    A document is its tokens and one END; only one longer than the capacity is cut. A null or empty text is
    END alone. Repeated rows each give their pieces; other columns are not read.
    """
    source = docs.select("doc_id", text_of().alias("text"))
    schema = StructType(
        [
            source.schema["doc_id"],
            StructField("piece", IntegerType(), False),
            StructField("start", LongType(), False),
            StructField("length", LongType(), False),
            StructField("ids", BinaryType(), False),
        ]
    )
    end, step = np.asarray([END], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = worker_tokens(path)
        for batch in batches:
            for part in slices_by_size(batch, "text", SLICE_BYTES):
                at, piece, ids = [], [], []
                for i, found in enumerate(tokens.encode(part.column("text").to_pylist())):
                    whole = found + end
                    cuts = [whole[j : j + step] for j in range(0, len(whole), step)]
                    at.extend([i] * len(cuts))
                    piece.extend(range(len(cuts)))
                    ids.extend(cuts)
                number = np.asarray(piece, "int64")
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(at, pa.int64())),
                        pa.array(number.astype("int32")),
                        pa.array(number * capacity),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    schema.names,
                )

    return source.mapInArrow(run, schema)


class Move(NamedTuple):
    """Ranks first_rank .. +count of the pieces of one length go to sequences from ``sequence``, each taking
    ``each`` of them one after another from ``offset``."""

    length: int
    first_rank: int
    count: int
    sequence: int
    each: int
    offset: int


def matched_runs(counts: dict[int, int], capacity: int) -> list[Move]:
    """Rounds of best fit over runs: ``counts`` has the number of pieces of each length."""
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by gap: (first sequence, how many)
    gaps: list[int] = []
    moves: list[Move] = []
    opened = 0

    def leave(gap: int, sequence: int, many: int) -> None:
        if gap > 0 and many > 0:
            if not runs[gap]:
                insort(gaps, gap)
            runs[gap].append((sequence, many))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            place = bisect_left(gaps, length)
            if place < len(gaps):
                gap = gaps[place]
                sequence, many = runs[gap].pop()
                if not runs[gap]:
                    gaps.pop(place)
            else:
                gap, sequence = capacity, opened
                many = -(-left // (capacity // length))
                opened += many
            each = gap // length
            full, rest = divmod(min(left, many * each), each)
            for start, number, taken in ((sequence, full, each), (sequence + full, 1 if rest else 0, rest)):
                if number:
                    moves.append(Move(length, rank, number * taken, start, taken, capacity - gap))
                    leave(gap - taken * length, start, number)
                    rank += number * taken
                    left -= number * taken
            used = full + (1 if rest else 0)
            leave(gap, sequence + used, many - used)
    return moves


def ranked(rows: DataFrame, total: int) -> DataFrame:
    """Add ``rank`` from 0 inside each length, by doc_id and piece within random parts.

    Each length is split into parts, so that a length held by a third of the pieces is counted by many
    tasks. There are at most capacity x parts part sizes, which are added up and joined as a table.
    """
    parts = min(1024, max(64, total // 1_000_000))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    sizes = dealt.groupBy("length", "part").count()
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("length", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    return (
        dealt.withColumn("inside", F.row_number().over(inside) - 1)
        .join(shifts, ["length", "part"])
        .withColumn("rank", F.col("before") + F.col("inside"))
        .drop("part", "before", "inside")
    )


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Sequences are numbered from 0 and filled from 0 without gaps. The ids themselves come from
    :func:`pieces` under the same doc_id and piece. An empty table gives an empty result. The tokenised
    table without the ids is stored first, so counts and ranks are of the same rows.
    """
    cut = pieces(docs, path, capacity).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")
    )
    rows = stored(cut, "pieces")
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most capacity rows
    moves = sorted(matched_runs(counts, capacity))
    shift = 1 << 40
    table = np.asarray(moves, "int64").reshape(-1, len(Move._fields))
    keys = table[:, 0] * shift + table[:, 1]

    @F.pandas_udf("struct<sequence_id bigint, offset bigint>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        move = table[np.searchsorted(keys, length.to_numpy() * shift + rank.to_numpy(), side="right") - 1]
        turn, slot = np.divmod(rank.to_numpy() - move[:, 1], move[:, 4])
        return pd.DataFrame({"sequence_id": move[:, 3] + turn, "offset": move[:, 5] + slot * move[:, 0]})

    placed = ranked(rows, sum(counts.values())).withColumn("place", place("length", "rank"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")
