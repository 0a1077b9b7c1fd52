"""Hard negatives for training pairs, found exactly through an inverted multi-index.

Vectors are halved, and a codebook for each half sorts them into cells (code of the first half, code of the second).
All rows are indexed: ordered by cell and cut into blocks of bounded size, so rows that share one cell fill several
blocks. For an anchor the inner product with any row of a cell is at most the sum of two half-scores, each the
product with the code and the anchor's length times the radius around it. A search visits the cells of a block
from a heap in falling order of that sum, and stops when the next sum can't change what was found: the best
rows of its own label, or, per positive, the best rows of other labels inside the positive's window of scores.

1. Anchors look for their positives in the block where they stand; that gives a least score.
2. They go to the other blocks whose highest sum reaches it; the best of all blocks are the positives.
3. With the windows of their positives they go to the blocks that reach the lowest window for the negatives.

Anchors meet a block as a stream: a task holds one block and one batch of anchors at a time.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisle.llm.common import stored

ANCHOR_EVERY = 50
CHANGED_EVERY, LABELS = 7, 10
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # percent of the positive's score between which a negative's score lies
SCALE = 256
CODES = 16  # of either half
SAMPLE = 20_000  # rows that the codebooks are fitted on; all rows are indexed
BLOCK_ROWS = 16_384
LEAST_BLOCKS = 32
VISIT_ROWS = 2048  # rows that are scored together, or one larger cell


class Codebooks(NamedTuple):
    size: int  # components of a vector; shorter ones are filled with zeros
    halves: tuple[np.ndarray, np.ndarray]

    def split(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return vectors[..., : self.size // 2], vectors[..., self.size // 2 :]

    def codes(self, vectors: np.ndarray) -> list[np.ndarray]:
        return [nearest(half, book) for half, book in zip(self.split(vectors), self.halves, strict=True)]


def nearest(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book**2).sum(axis=1) - 2 * (points @ book.T), axis=1)


def fitted(points: np.ndarray, codes: int = CODES, rounds: int = 12) -> np.ndarray:
    """Centres of ``points`` by Lloyd's rounds from points far from each other; the same for the same points."""
    centers = points[:1]
    while len(centers) < codes:
        far = ((points[:, None] - centers[None]) ** 2).sum(axis=2).min(axis=1) if len(points) else np.zeros(0)
        if not len(far) or far.max() == 0:
            break
        centers = np.concatenate([centers, points[[far.argmax()]]])
    for _ in range(rounds if len(centers) else 0):
        code = nearest(points, centers)
        count = np.bincount(code, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, code, points)
        centers = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centers)
    return centers if len(centers) else np.zeros((1, points.shape[1]))


def vectors_of(column: pa.ListArray, size: int) -> np.ndarray:
    """Rows of a list column, filled with zeros to ``size``."""
    ends = np.asarray(column.offsets)
    lengths = np.diff(ends)
    flat = np.asarray(column.values)[ends[0] : ends[-1]]
    if (lengths == size).all():
        return flat.reshape(len(column), size)
    out = np.zeros((len(column), size), "i8")
    out[np.arange(size) < lengths[:, None]] = flat
    return out


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, vector (array of bigint) of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    label = F.col("label").cast("bigint")
    return embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.when(F.col("vec_id") % CHANGED_EVERY == 0, (label + 1) % LABELS).otherwise(label).alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("vector"),
    )


def learn(rows: DataFrame, sample: int = SAMPLE, codes: int = CODES) -> Codebooks:
    """Codebooks of at most ``sample`` rows, chosen by a hash of their ids."""
    size = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toArrow()
    column = chosen.column("vector").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    points = vectors_of(column, size).astype(float)
    return Codebooks(size, (fitted(points[:, : size // 2], codes), fitted(points[:, size // 2 :], codes)))


def index(rows: DataFrame, books: Codebooks, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The stored index: block, key (of the row), code_1, code_2, vec_id, label, vector; rows ordered by cell."""
    coded_schema = "vec_id bigint, label bigint, vector array<bigint>, code_1 int, code_2 int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = books.codes(vectors_of(batch.column("vector"), books.size).astype(float))
                columns = [*batch.columns, *(pa.array(c.astype("i4")) for c in codes)]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "code_1", "code_2"])

    blocks = max(LEAST_BLOCKS, rows.count() // block_rows + 1)
    order = ("code_1", "code_2", "vec_id")
    dealt = rows.mapInArrow(run, coded_schema).repartitionByRange(blocks, *order).sortWithinPartitions(*order)
    return stored(
        dealt.select(F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("key"), "*"), "multi-index"
    )


class Cells(NamedTuple):
    """Cells by block: their codes and the radii of either half around them; one line per block and cell."""

    block: np.ndarray
    codes: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    longest: float  # length of the longest vector


def summary(indexed: DataFrame, books: Codebooks) -> Cells:
    """The cells of every block, at most blocks + CODES * CODES lines as blocks follow the order of the cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = vectors_of(batch.column("vector"), books.size).astype(float)
                codes = [np.asarray(batch.column(c)) for c in ("code_1", "code_2")]
                away = [
                    np.sqrt(((half - book[code]) ** 2).sum(axis=1))
                    for half, book, code in zip(books.split(vectors), books.halves, codes, strict=True)
                ]
                long = np.sqrt((vectors**2).sum(axis=1))
                values = [batch.column("block"), *map(pa.array, (*codes, *away, long))]
                yield pa.RecordBatch.from_arrays(values, ["block", "code_1", "code_2", "away_1", "away_2", "long"])

    measured = indexed.mapInArrow(run, "block int, code_1 int, code_2 int, away_1 double, away_2 double, long double")
    most = [F.max(c).alias(c) for c in ("away_1", "away_2", "long")]
    lines = measured.groupBy("block", "code_1", "code_2").agg(*most).orderBy("block", "code_1", "code_2").toArrow()
    column = lambda name: lines.column(name).to_numpy()
    long = column("long")
    return Cells(
        column("block"),
        (column("code_1"), column("code_2")),
        (column("away_1"), column("away_2")),
        float(long.max()) if len(long) else 0.0,
    )


def slack(lengths, longest: float):
    """More than the rounding errors of a bound."""
    return 1e-6 + 1e-9 * lengths * longest


def reachable(anchors: DataFrame, cells: Cells, books: Codebooks) -> DataFrame:
    """The anchors with ``target``: once for every block that may hold a row with at least their ``least`` score.

    A null ``least`` is reached everywhere.
    """
    first = np.flatnonzero(np.r_[True, cells.block[1:] != cells.block[:-1]]) if len(cells.block) else np.zeros(0, int)
    blocks = cells.block[first]
    schema = anchors.withColumn("target", F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                vectors = vectors_of(batch.column("vector"), books.size).astype(float)
                bound = np.zeros((len(vectors), len(cells.block)))
                for half, book, code, radius in zip(books.split(vectors), books.halves, cells.codes, cells.radii, strict=True):
                    bound += (half @ book.T)[:, code] + np.sqrt((half**2).sum(axis=1))[:, None] * radius
                best = np.maximum.reduceat(bound, first, axis=1)
                best += slack(np.sqrt((vectors**2).sum(axis=1)), cells.longest)[:, None]
                least = np.asarray([-np.inf if x is None else x for x in batch.column("least").to_pylist()])
                row, block = np.nonzero(best >= least[:, None])
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row)).columns, pa.array(blocks[block])], schema.names)

    return anchors.mapInArrow(run, schema)


class Block:
    """One block of the index in memory, its rows ordered by cell."""

    def __init__(self, table: pa.Table, books: Codebooks):
        table = table.sort_by([("code_1", "ascending"), ("code_2", "ascending"), ("vec_id", "ascending")]).combine_chunks()
        column = lambda name: table.column(name).to_numpy()
        self.ids, self.labels = column("vec_id"), column("label")
        self.vectors = vectors_of(table.column("vector").chunk(0), books.size)
        self.largest = int(np.abs(self.vectors).max(initial=0))
        self.as_float = self.vectors.astype(float)
        self.longest = float(np.sqrt((self.as_float**2).sum(axis=1)).max(initial=0))
        self.books = books
        codes = column("code_1"), column("code_2")
        edges = np.flatnonzero(np.r_[True, (np.diff(codes[0]) != 0) | (np.diff(codes[1]) != 0), True])
        self.cells = {
            (int(codes[0][s]), int(codes[1][s])): (int(s), int(e)) for s, e in zip(edges[:-1], edges[1:], strict=True)
        }
        self.codes, self.radii = [], []
        for half, book, code in zip(books.split(self.as_float), books.halves, codes, strict=True):
            away = np.sqrt(((half - book[code]) ** 2).sum(axis=1))
            held = np.unique(code)
            self.codes.append(held)
            self.radii.append(np.asarray([away[code == c].max() for c in held]))

    def scores(self, vector: np.ndarray, start: int, end: int) -> np.ndarray:
        """Exact inner products: floating point while sums stay below 2**53, else whole numbers of any size."""
        if len(vector) * self.largest * int(np.abs(vector).max(initial=0)) < 1 << 53:
            return (self.as_float[start:end] @ vector.astype(float)).astype("i8")
        return np.asarray([sum(map(int.__mul__, row, vector.tolist())) for row in self.vectors[start:end].tolist()], object)

    def visits(self, vector: np.ndarray) -> Iterator[tuple[list[tuple[int, int]], float]]:
        """Ranges of rows in falling order of their cells' bounds, each with the bound of all that follow."""
        half_scores, orders = [], []
        for half, book, code, radius in zip(self.books.split(vector.astype(float)), self.books.halves, self.codes, self.radii, strict=True):
            value = book[code] @ half + np.sqrt((half**2).sum()) * radius
            order = np.argsort(-value)
            orders.append(code[order].tolist())
            half_scores.append(value[order].tolist())
        (left, right), (codes_1, codes_2) = half_scores, orders
        more = float(slack(np.sqrt((vector.astype(float) ** 2).sum()), self.longest))
        heap = [(-left[0] - right[0], 0, 0)]
        ranges, held = [], 0
        while heap:
            _, i, j = heapq.heappop(heap)
            if j + 1 < len(right):
                heapq.heappush(heap, (-left[i] - right[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(left):
                heapq.heappush(heap, (-left[i + 1] - right[0], i + 1, 0))
            cell = self.cells.get((codes_1[i], codes_2[j]))
            if cell:
                ranges.append(cell)
                held += cell[1] - cell[0]
            if held >= VISIT_ROWS or not heap:
                yield ranges, -heap[0][0] + more if heap else -np.inf
                ranges, held = [], 0

    def scored(self, vector: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
        """(ids, labels, scores, bound of all that follow) visit by visit."""
        for ranges, bound in self.visits(vector):
            merged = []
            for start, end in sorted(ranges):
                if merged and merged[-1][1] == start:
                    merged[-1][1] = end
                else:
                    merged.append([start, end])
            parts = [(self.ids[s:e], self.labels[s:e], self.scores(vector, s, e)) for s, e in merged]
            if len(parts) == 1:
                yield *parts[0], bound
            elif parts:
                yield *(np.concatenate(x) for x in zip(*parts, strict=True)), bound
            else:
                yield self.ids[:0], self.labels[:0], np.zeros(0, "i8"), bound

    def best_of_label(self, own: int, label: int, vector: np.ndarray, least: int | None, many: int) -> list[tuple[int, int]]:
        """(score, id) of the first ``many`` other rows of the label that score at least ``least``."""
        found: list[tuple[int, int]] = []
        for ids, labels, scores, bound in self.scored(vector):
            fit = (labels == label) & (ids != own)
            if least is not None:
                fit &= scores >= least
            found = first(found, ids[fit], scores[fit], many)
            floor = found[-1][0] if len(found) == many else least
            if floor is not None and bound < floor:
                break
        return found

    def best_in_windows(
        self, label: int, vector: np.ndarray, windows: list[tuple[int, int]], many: int
    ) -> list[list[tuple[int, int]]]:
        """Per window (low, high) the first ``many`` (score, id) of other labels inside it."""
        found: list[list[tuple[int, int]]] = [[] for _ in windows]
        for ids, labels, scores, bound in self.scored(vector):
            other = labels != label
            ids, scores = ids[other], scores[other]
            certain = True
            for k, (low, high) in enumerate(windows):
                floor = found[k][-1][0] if len(found[k]) == many else low
                fit = (scores >= floor) & (scores <= high)
                found[k] = first(found[k], ids[fit], scores[fit], many)
                certain &= bound < (found[k][-1][0] if len(found[k]) == many else low)
            if certain:
                break
        return found


def first(found: list[tuple[int, int]], ids: np.ndarray, scores: np.ndarray, many: int) -> list[tuple[int, int]]:
    """The first ``many`` of ``found`` and new rows: higher scores first, ties by smaller id."""
    if not len(ids):
        return found
    order = np.lexsort((ids, -scores))[:many]
    return sorted([*found, *zip(scores[order].tolist(), ids[order].tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[:many]


def search(indexed: DataFrame, anchors: DataFrame, books: Codebooks, many: int) -> DataFrame:
    """key, place, score, id of what each anchor finds in its ``target`` block.

    Anchors without windows (null ``lows``) look for rows of their own label, as place 0; others for rows of other
    labels in each of their windows.
    """
    as_rows = indexed.select("block", F.lit(0).alias("kind"), "key", "vec_id", "label", "vector", "code_1", "code_2")
    as_anchors = anchors.withColumnRenamed("target", "block").withColumn("kind", F.lit(1))
    both = as_rows.unionByName(as_anchors, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, block = None, [], None
        for whole in batches:
            number_of, kind_of = np.asarray(whole.column("block")), np.asarray(whole.column("kind"))
            edges = np.flatnonzero(np.r_[True, (np.diff(number_of) != 0) | (np.diff(kind_of) != 0), True])
            for start, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                batch = whole.slice(start, end - start)
                if number_of[start] != number:
                    number, held, block = number_of[start], [], None
                if kind_of[start] == 0:
                    held.append(batch.select(["vec_id", "label", "vector", "code_1", "code_2"]))
                    continue
                if block is None:
                    block = Block(pa.Table.from_batches(held), books)
                    held = []
                yield found_in(block, batch, books, many)

    return both.mapInArrow(run, "key bigint, place int, score bigint, id bigint")


def found_in(block: Block, batch: pa.RecordBatch, books: Codebooks, many: int) -> pa.RecordBatch:
    vectors = vectors_of(batch.column("vector"), books.size)
    columns = (batch.column(c).to_pylist() for c in ("key", "vec_id", "label", "least", "lows", "highs"))
    out = []
    for vector, key, own, label, least, lows, highs in zip(vectors, *columns, strict=True):
        if lows is None:
            lists = [block.best_of_label(own, label, vector, least, many)]
        else:
            lists = block.best_in_windows(label, vector, list(zip(lows, highs, strict=True)), many)
        out.extend((key, place, score, id_) for place, items in enumerate(lists) for score, id_ in items)
    values = list(zip(*out, strict=True)) or [[]] * 4
    kinds = pa.int64(), pa.int32(), pa.int64(), pa.int64()
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["key", "place", "score", "id"])


def best(found: DataFrame, many: int) -> DataFrame:
    """The first ``many`` of each anchor and place over all blocks, numbered from 1 as ``rank``."""
    order = Window.partitionBy("key", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= many)


def mine(embeddings: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null id, label or vector, or any null or non-finite component, take no part. Components become
    floor(256 x), scores are integer inner products; shorter vectors count as filled with zeros. Where vec_id
    is divisible by 7 the label first becomes (label + 1) % 10. An anchor (vec_id divisible by 50) has as positives
    the first 5 other rows of its label, and for each the first 3 rows of other labels whose score lies between 50
    and 95 percent of the positive's. Higher scores come first, ties by smaller vec_id. Repeated rows are rows of
    their own, but no row is a positive of a row with its vec_id. The result is exact. An empty table, or one
    without anchors, gives an empty result; other columns are not read.
    """
    rows = usable(embeddings)
    books = learn(rows)
    indexed = index(rows, books, block_rows)
    cells = summary(indexed, books)
    null = lambda kind: F.lit(None).cast(kind)
    anchors = indexed.filter(F.col("vec_id") % ANCHOR_EVERY == 0).select("block", "key", "vec_id", "label", "vector")
    windowless = [null("array<bigint>").alias("lows"), null("array<bigint>").alias("highs")]
    at_home = anchors.select(F.col("block").alias("target"), "key", "vec_id", "label", "vector", null("bigint").alias("least"), *windowless)
    home = stored(search(indexed, at_home, books, POSITIVES), "home-positives")
    floors = home.groupBy("key").agg(F.when(F.count("*") == POSITIVES, F.min("score")).alias("least"))
    searching = anchors.join(floors, "key", "left").select("block", "key", "vec_id", "label", "vector", "least", *windowless)
    away = reachable(searching, cells, books).filter("target <> block").drop("block")
    elsewhere = search(indexed, away, books, POSITIVES)
    positives = stored(best(home.unionByName(elsewhere), POSITIVES), "positives")

    windowed = F.struct("rank", *_window_bounds())
    listed = positives.groupBy("key").agg(F.array_sort(F.collect_list(windowed)).alias("w"))  # POSITIVES at most
    windows = listed.select(
        "key",
        F.array_min("w.low").alias("least"),
        F.col("w.low").alias("lows"),
        F.col("w.high").alias("highs"),
    )
    hunting = anchors.drop("block").join(windows, "key").select("key", "vec_id", "label", "vector", "least", "lows", "highs")
    negatives = best(search(indexed, reachable(hunting, cells, books), books, NEGATIVES), NEGATIVES)
    numbered = positives.select(
        "key", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    named = anchors.select("key", F.col("vec_id").alias("anchor_id"))
    return (
        negatives.join(numbered, ["key", "place"])
        .join(named, "key")
        .select(
            "anchor_id",
            "positive_id",
            F.col("rank").cast("int").alias("rank"),
            F.col("id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        )
    )


def _window_bounds() -> list[Column]:
    """Smallest and largest whole score between LOW and HIGH percent of ``score``, in whole numbers."""
    low = F.expr(f"CAST(-floor(CAST(-{LOW} AS DECIMAL(38, 0)) * score / 100) AS BIGINT)")
    high = F.expr(f"CAST(floor(CAST({HIGH} AS DECIMAL(38, 0)) * score / 100) AS BIGINT)")
    return [low.alias("low"), high.alias("high")]
