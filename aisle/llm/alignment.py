"""Alignment of two tokenizers over the same bytes, by pointer jumping.

Byte-level tokens A of " " + text and pieces B of text (whose model puts the space in front) cover the same bytes.
Where an A and a B token end at one byte a group ends. Every token points to its farthest-right overlapping
token: the token of the other tokenizer that holds its last byte, and itself if that ends a group. Pointers
are doubled, for all tokens at once, until nothing changes; every token then points to the terminal token of
its group, which labels it.

Neither tokenizer merges across the place where a space follows another character that is not white space. A
worker encodes each such segment of a text once and looks its ids up afterwards.

How many documents hold a pair of ids linked is counted in Spark: the distinct pairs of every document are stored,
added up per task and then by pair. The commonest pairs, at most MOST_COMMON of them, go to every worker as a
sorted table; the others, none of which is in more documents than any common one, are joined by pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from aisle.llm.common import stored, text_of
from aisle.llm.memo import Memo, slices_by_size
from aisle.llm.pieces import SPACE, PieceEncoder

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
MOST_COMMON = 1_000_000  # pairs whose counts every worker holds, 17 bytes each
REMEMBERED_CHARS = 12_000_000  # characters of segments whose ids a worker keeps
BATCH_CHARS = 1_000_000  # texts of so many bytes, or one longer text, are aligned at a time
WIDE = 64  # links of a group beyond which its ids are counted before they are paired
HELD_PAIRS = 2_000_000  # pairs of documents that a task gathers before it adds them up

# White space as any library may understand it, after which a segment doesn't end.
_WHITE = "\t-\r\x1c-\x20\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff"
_AFTER_WHITE = re.compile(f"[{_WHITE}] ")
_SEGMENT_END = re.compile(f"(?<=[^{_WHITE}])(?= )")


def group_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terminal A token of each A and of each B token, both given by their rising end offsets.

    The last ends are equal, so every pointer leads right until it stands on an A token that ends with a B token.
    """
    n = len(ends_a)
    over = np.searchsorted(ends_b, ends_a)  # the B token that holds the last byte of each A token
    own = ends_b[over] == ends_a
    points = np.concatenate([np.where(own, np.arange(n), n + over), np.searchsorted(ends_a, ends_b)])
    while True:
        further = points[points]
        if np.array_equal(further, points):
            return points[:n], points[n:]
        points = further


def _byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers and the segments seen; one instance per worker."""

    def __init__(self, path_a: str, path_b: str, remembered: int = REMEMBERED_CHARS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path_a)
        self.tokenizer.encode_special_tokens = True
        value = _byte_values()
        self.bytes_a = [b""] * self.tokenizer.get_vocab_size(True)
        for token, number in self.tokenizer.get_vocab(False).items():
            self.bytes_a[number] = bytes(value[c] for c in token)
        with open(path_b, "rb") as file:
            self.encoder = PieceEncoder(file.read())
        self.bytes_b = [b.replace(SPACE.encode(), b" ") for b in self.encoder.bytes_of]
        self.lengths_a, self.lengths_b = (np.asarray([len(b) for b in x], "i8") for x in (self.bytes_a, self.bytes_b))
        self.size_b = len(self.bytes_b)
        # how a token is shown inside and at the end of its side of a group
        self.shown = [f"{i}{end}" for ends, side in ((",|", self.bytes_a), (",;", self.bytes_b)) for i in range(len(side)) for end in ends]
        self.known = Memo(remembered)

    def cut(self, text: str) -> list[str]:
        """Segments of " " + text."""
        text = " " + text
        if not self.encoder.by_word:
            return [text]
        if _AFTER_WHITE.search(text):
            return _SEGMENT_END.split(text)
        return [" " + word for word in text[1:].split(" ")]

    def learn(self, segments: list[str]) -> list[tuple[bytes, bytes]]:
        """A and B ids of segments, as little-endian unsigned 32-bit integers."""
        found = self.tokenizer.encode_batch_fast(segments, add_special_tokens=False)
        pieces = self.encoder.encode_words([s.replace(" ", SPACE) for s in segments])
        return [(np.asarray(x.ids, "<u4").tobytes(), ids) for x, ids in zip(found, pieces, strict=True)]

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """A and B ids of each text; None where it is empty or either side's bytes are not those of " " + text."""
        cut = [self.cut(text) if text else [] for text in texts]
        self.known.learn(chain.from_iterable(cut), self.learn)
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        for text, segments in zip(texts, cut, strict=True):
            sides = [np.frombuffer(b"".join(ids), "<u4") for ids in zip(*map(self.known.__getitem__, segments), strict=True)]
            given = [b"".join(map(b.__getitem__, ids.tolist())) for b, ids in zip((self.bytes_a, self.bytes_b), sides, strict=False)]
            out.append((sides[0], sides[1]) if segments and given[0] == given[1] == f" {text}".encode() else None)
        return out


class Batch(NamedTuple):
    """Groups and links of several texts: per text the numbers, the groups as text, and its distinct linked pairs."""

    numbers: np.ndarray  # n_a, n_b, n_groups, n_links
    groups: list[str]
    pairs: list[bytes]
    times: list[bytes]


def aligned_texts(aligner: Aligner, texts: list[str]) -> Batch:
    out = Batch(np.zeros((len(texts), 4), "i8"), [""] * len(texts), [b""] * len(texts), [b""] * len(texts))
    found = aligner.tokens(texts)
    fine = [i for i, sides in enumerate(found) if sides is not None]
    if not fine:
        return out
    sides = list(zip(*(found[i] for i in fine), strict=True))
    ids_a, ids_b = (np.concatenate(side).astype("i8") for side in sides)
    edge_a, edge_b = (np.cumsum([0, *map(len, side)]) for side in sides)
    label_a, label_b = group_ends(np.cumsum(aligner.lengths_a[ids_a]), np.cumsum(aligner.lengths_b[ids_b]))
    last = np.flatnonzero(label_a == np.arange(len(label_a)))  # one A token ends each group
    first_a, first_b = np.r_[0, last[:-1] + 1], np.searchsorted(label_b, last)
    many_a, many_b = last + 1 - first_a, np.diff(np.r_[first_b, len(ids_b)])
    text_of_group = np.searchsorted(edge_a, first_a, side="right") - 1

    # A tokens of a group, then its B tokens
    shown = np.empty(len(ids_a) + len(ids_b), "i8")
    ends_a, ends_b = np.zeros(len(ids_a), "i8"), np.zeros(len(ids_b), "i8")
    ends_a[last] = 1
    ends_b[first_b + many_b - 1] = 1
    shown[np.arange(len(ids_a)) + np.repeat(first_b, many_a)] = 2 * ids_a + ends_a
    shown[np.arange(len(ids_b)) + np.repeat(last + 1, many_b)] = 2 * (len(aligner.bytes_a) + ids_b) + ends_b

    keys, times = _linked(ids_a, ids_b, many_a, many_b, first_b, text_of_group, aligner.size_b, len(aligner.bytes_a))
    numbers = np.stack(
        [
            np.diff(edge_a),
            np.diff(edge_b),
            np.bincount(text_of_group, minlength=len(fine)),
            np.add.reduceat(many_a * many_b, np.searchsorted(text_of_group, np.arange(len(fine)))),
        ],
        axis=1,
    )
    all_pairs = aligner.size_b * len(aligner.bytes_a)
    edge = np.searchsorted(keys, np.arange(len(fine) + 1) * all_pairs)
    for k, i in enumerate(fine):
        part = shown[edge_a[k] + edge_b[k] : edge_a[k + 1] + edge_b[k + 1]]
        mine = slice(edge[k], edge[k + 1])
        out.numbers[i] = numbers[k]
        out.groups[i] = "".join(map(aligner.shown.__getitem__, part.tolist()))[:-1]
        out.pairs[i] = (keys[mine] - k * all_pairs).astype("<i8").tobytes()
        out.times[i] = times[mine].astype("<i8").tobytes()
    return out


def _linked(ids_a, ids_b, many_a, many_b, first_b, text_of_group, size_b: int, size_a: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, pair) as text * size_a * size_b + pair, rising, and how many links each has.

    In a group of many links, ids that it holds several times are counted first, so long runs stay small.
    """
    group_a = np.repeat(np.arange(len(many_a)), many_a)
    wide = many_a * many_b > WIDE
    base = text_of_group * size_a * size_b

    def product(group, a, start, count, b):
        left = np.repeat(np.arange(len(a)), count)
        right = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)
        return left, right, base[group[left]] + a[left] * size_b + b[right]

    plain = ~wide[group_a]
    group = group_a[plain]
    _, _, single = product(group, ids_a[plain], first_b[group], many_b[group], ids_b)
    keys, times = np.unique(single, return_counts=True)
    if wide.any():
        counted = []
        for ids, many in ((ids_a, many_a), (ids_b, many_b)):
            group = np.repeat(np.arange(len(many)), many)
            ids, group = ids[wide[group]], group[wide[group]]
            order = np.lexsort((ids, group))
            ids, group = ids[order], group[order]
            fresh = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (ids[1:] != ids[:-1])])
            counted.append((group[fresh], ids[fresh], np.diff(np.r_[fresh, len(ids)])))
        (group, a, times_a), (group_b, b, times_b) = counted
        start, stop = np.searchsorted(group_b, group), np.searchsorted(group_b, group, side="right")
        left, right, more = product(group, a, start, stop - start, b)
        keys, times = np.concatenate([keys, more]), np.concatenate([times, times_a[left] * times_b[right]])
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        fresh = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        keys, times = keys[fresh], np.add.reduceat(times, fresh)
    return keys, times


@lru_cache(maxsize=2)
def worker_aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times of every document.

    ``groups`` has the ids in order, groups joined by ``;``, either side by ``,``, A from B by ``|``. ``pairs`` are
    the distinct linked pairs as little-endian 64-bit A id * size of B + B id, rising; ``times`` how many links
    each has. Texts that are null, empty or that the tokens do not give back have zeros and empty values.
    Whole texts of any length; repeated rows each give a row; other columns are not read; an empty table gives
    an empty result.
    """
    source = docs.select("doc_id", text_of().alias("text"))
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    schema = StructType(
        [
            source.schema["doc_id"],
            *[StructField(name, LongType(), False) for name in numbers],
            StructField("groups", StringType(), False),
            StructField("pairs", BinaryType(), False),
            StructField("times", BinaryType(), False),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = worker_aligner(path_a, path_b)
        for batch in batches:
            for part in slices_by_size(batch, "text", BATCH_CHARS):
                found = aligned_texts(aligner, part.column("text").to_pylist())
                values = [*map(pa.array, found.numbers.T.copy()), pa.array(found.groups, pa.string())]
                values += [pa.array(x, pa.binary()) for x in (found.pairs, found.times)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *values], schema.names)

    return source.mapInArrow(run, schema)


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """pair, a, documents (how many rows hold the pair) and best (no pair of the same A id is in more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counts(held: list[np.ndarray]) -> pa.RecordBatch:
            pair, many = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(many)], ["pair", "many"])

        held, size = [], 0
        for batch in batches:
            for value in batch.column("pairs"):
                held.append(np.frombuffer(value.as_buffer(), "<i8"))
                size += len(held[-1])
                if size > HELD_PAIRS:
                    yield counts(held)
                    held, size = [], 0
        if held:
            yield counts(held)

    counted = rows.select("pairs").mapInArrow(run, "pair bigint, many bigint").groupBy("pair").agg(F.sum("many").alias("documents"))
    counted = stored(counted.withColumn("a", F.floor(F.col("pair") / size_b)), "pair-counts")
    best = counted.groupBy("a").agg(F.max("documents").alias("most"))  # at most one row per id of A
    return counted.join(F.broadcast(best), "a").select("pair", "a", "documents", (F.col("documents") == F.col("most")).alias("best"))


def common_above(counts: DataFrame, most: int) -> int:
    """The smallest power of two such that at most ``most`` pairs are in that many documents."""
    by_size = counts.groupBy(F.length(F.bin("documents")).alias("bits")).count().collect()  # at most 64 rows
    held, least = 0, 63
    for bits, count in sorted(((r["bits"], r["count"]) for r in by_size), reverse=True):
        held += count
        if held > most:
            break
        least = bits
    return 1 << (least - 1)


def agreement(docs: DataFrame, path_a: str, path_b: str, most_common: int = MOST_COMMON) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A pair's count is the number of documents that hold it linked. n_best counts the links whose pair has the
    highest count of all pairs of its A id, ties included; count_sum adds up the counts of all links.
    """
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    kept = align(docs, path_a, path_b).select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times")
    rows = stored(kept.withColumn("row", F.monotonically_increasing_id()), "aligned")
    with open(path_b, "rb") as file:
        size_b = len(PieceEncoder(file.read()).bytes_of)
    counts = pair_counts(rows, size_b)
    least = common_above(counts, most_common)
    common = counts.filter(F.col("documents") >= least).orderBy("pair").toArrow()  # at most most_common rows
    table, many, best = (common.column(name).to_numpy() for name in ("pair", "documents", "best"))

    def places(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per row: its key, pairs, times, places in the table, and which pairs stand there."""
        for row, pairs, times in zip(batch.column("row").to_pylist(), batch.column("pairs"), batch.column("times"), strict=True):
            mine, often = np.frombuffer(pairs.as_buffer(), "<i8"), np.frombuffer(times.as_buffer(), "<i8")
            at = np.minimum(np.searchsorted(table, mine), max(len(table) - 1, 0))
            yield row, mine, often, at, table[at] == mine if len(table) else np.zeros(len(mine), bool)

    def from_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for _, _, often, at, here in places(batch):
                often, at = often[here], at[here]
                sums.append((int(often[best[at]].sum()), int((often * many[at]).sum())))
            n_best, count_sum = np.asarray(sums, "i8").reshape(-1, 2).T.copy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(n_best), pa.array(count_sum)], [*shown, "n_best", "count_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, mine, often, _, here in places(batch):
                if not here.all():
                    rest = [pa.array(np.full((~here).sum(), row)), pa.array(mine[~here]), pa.array(often[~here])]
                    yield pa.RecordBatch.from_arrays(rest, ["row", "pair", "times"])

    shown = [c for c in rows.columns if c not in ("pairs", "times")]
    schema = StructType([*(f for f in rows.schema.fields if f.name in shown), StructField("n_best", LongType()), StructField("count_sum", LongType())])
    result = rows.select(*shown, "pairs", "times").mapInArrow(from_common, schema)
    rare = counts.filter(F.col("documents") < least)
    if not rare.isEmpty():
        wanted = rows.select("row", "pairs", "times").mapInArrow(others, "row bigint, pair bigint, times bigint")
        sums = wanted.join(rare, "pair").groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
            F.sum(F.col("times") * F.col("documents")).alias("more_sum"),
        )
        result = (
            result.join(sums, "row", "left")
            .withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0)))
            .withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0)))
        )
    return result.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
