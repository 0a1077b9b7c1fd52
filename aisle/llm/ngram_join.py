"""Near-duplicate join: Jaccard similarity of five-word shingle sets, found through signature trees.

1. Every text becomes its set of distinct shingle hashes. Texts with equal sets are one class, so copies are
   never compared; only one class of each kind goes on.
2. Shingles are dealt to buckets by hash, packed as arrays. A bucket counts in how many classes each of its
   shingles occurs and hands on those in two or more. Two sets with similarity t share a shingle among the
   first n - ceil(t n) + 1 of each, in any common order; in the order of rising frequency the shingles of one
   class alone come first, so a class with enough of its own has no partner and is done.
3. Of the rest, the classes that share a prefix shingle stand together. First each is compared with the leader
   that most of its shingles name, and with one class of another group, which ties large groups together with
   two comparisons per class. Then a signature tree per shingle (nodes with OR- and AND-combined bitmaps,
   size ranges and known groups) is traversed against itself: a pair of nodes is left out when its sizes, its
   largest possible overlap, or a common known group rule out a new link. A shingle of many classes is cut into
   blocks, whose summaries are the top level of its tree: each pair of blocks that is left is a task's work.
4. Candidate pairs are checked exactly on their shared shingles, and components are taken over the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisle.llm.common import attach_groups, stored, text_of
from aisle.llm.components import components
from aisle.llm.memo import slices_by_size

WORDS = 5
PERCENT = 80
BUCKET_SHINGLES = 1 << 20
LEAST_BUCKETS = 128
PACKED_BYTES = 8_000_000  # texts of so many bytes, or one longer text, are packed at a time
SLICE_BYTES = 1_000_000  # texts of so many bytes, or one longer text, are cut into words at a time
REMEMBERED = 100_000  # words whose hashes a worker keeps
LEAF = 16
FAN_OUT = 4
BLOCK_ROWS = 2048  # rows of one shingle that one tree holds
BITS = 512
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class _WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_sets(texts: list[str], known: _WordHashes, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, A-Z in lower case."""
    import xxhash

    sets = []
    for text in texts:
        found = text.encode("utf-8", "surrogatepass").lower().split()
        if len(found) < words:
            seed = len(found)
            sets.append(np.asarray([xxhash.xxh3_64_intdigest(b" ".join(found), seed)] if found else [], "u8"))
            continue
        single = np.fromiter(map(known.__getitem__, found), "u8", len(found))
        value = single[: len(found) - words + 1].copy()
        for step in range(1, words):
            value *= _ODD
            value ^= value >> np.uint64(29)
            value += single[step : len(found) - words + 1 + step]
        value ^= value >> np.uint64(31)
        value *= _MIX
        value ^= value >> np.uint64(27)
        sets.append(np.unique(value))
    return sets


def set_key(shingles: np.ndarray) -> int | None:
    """Signed 64-bit key of a set; equal sets have equal keys, the empty set has none."""
    import xxhash

    if not len(shingles):
        return None
    value = xxhash.xxh3_64_intdigest(shingles.tobytes(), len(shingles))
    return value - (1 << 64) if value >= 1 << 63 else value


def signed(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and the key of the shingle set of every document."""
    source = docs.select("doc_id", text_of().alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            for part in slices_by_size(batch, "text", SLICE_BYTES):
                sets = shingle_sets(part.column("text").to_pylist(), known, words)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_key(s) for s in sets], pa.int64()),
                    ],
                    ["doc_id", "n_shingles", "set_id"],
                )

    return source.mapInArrow(run, f"doc_id {kind}, n_shingles bigint, set_id bigint")


def _packed(docs: DataFrame, bits: int, words: int) -> DataFrame:
    """Shingles dealt to 2**bits buckets: per batch of texts and bucket the classes, their sizes, how many
    shingles of each are here, and the next 32 bits of those shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            for part in slices_by_size(batch, "text", PACKED_BYTES):
                classes = {}
                for few in slices_by_size(part, "text", SLICE_BYTES):
                    classes.update((set_key(s), s) for s in shingle_sets(few.column("text").to_pylist(), known, words))
                classes.pop(None, None)
                if not classes:
                    continue
                sets = list(classes.values())
                sizes = np.fromiter(map(len, sets), "i4", len(sets))
                owner = np.repeat(np.arange(len(sets), dtype="i4"), sizes)
                values = np.concatenate(sets)
                bucket = (values >> np.uint64(64 - bits)).astype("i4")
                order = np.argsort(bucket, kind="stable")
                owner, values = owner[order], values[order]
                cells = ((values << np.uint64(bits)) >> np.uint64(32)).astype("<u4")
                edge = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
                ids = np.fromiter(classes, "<i8", len(classes))
                rows = []
                for b in np.flatnonzero(np.diff(edge)):
                    mine = owner[edge[b] : edge[b + 1]]
                    first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
                    held = mine[first]
                    counts = np.diff(np.r_[first, len(mine)]).astype("<i4")
                    rows.append(
                        (int(b), ids[held].tobytes(), sizes[held].astype("<i4").tobytes(), counts.tobytes(), cells[edge[b] : edge[b + 1]].tobytes())
                    )
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int32(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "ids", "sizes", "counts", "cells"]
                )

    source = docs.select(text_of().alias("text"))
    return source.mapInArrow(run, "bucket int, ids binary, sizes binary, counts binary, cells binary")


def _shared(packed: DataFrame) -> DataFrame:
    """Per class and bucket the shingles that other classes have too: set_id, n, n_shared, hashes, degrees."""

    def run(table: pa.Table) -> pa.Table:
        join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        bucket = np.uint64(table.column("bucket")[0].as_py())
        counts = join("counts", "<i4")
        ids, sizes = np.repeat(join("ids", "<i8"), counts), np.repeat(join("sizes", "<i4"), counts)
        cells = join("cells", "<u4")
        order = np.lexsort((ids, cells))
        ids, sizes, cells = ids[order], sizes[order], cells[order]
        fresh = np.r_[True, (cells[1:] != cells[:-1]) | (ids[1:] != ids[:-1])]  # a class may come from several batches
        ids, sizes, cells = ids[fresh], sizes[fresh], cells[fresh]
        first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        runs = np.diff(np.r_[first, len(cells)])
        degree = np.repeat(runs, runs)
        many = degree > 1
        ids, sizes, cells, degree = ids[many], sizes[many], cells[many], degree[many]
        order = np.argsort(ids, kind="stable")
        ids, sizes = ids[order], sizes[order]
        hashes = ((bucket << np.uint64(32)) | cells[order].astype("u8")).astype("<u8")
        degree = np.minimum(degree[order], 2**31 - 1).astype("<i4")
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, int)
        ends = np.r_[first[1:], len(ids)] if len(ids) else first
        return pa.table(
            {
                "set_id": pa.array(ids[first], pa.int64()),
                "n": pa.array(sizes[first].astype("i8")),
                "n_shared": pa.array(ends - first, pa.int64()),
                "hashes": pa.array([hashes[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()),
                "degrees": pa.array([degree[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()),
            }
        )

    return packed.groupBy("bucket").applyInArrow(run, "set_id bigint, n bigint, n_shared bigint, hashes binary, degrees binary")


def _prefixes(shared: DataFrame, percent: int) -> DataFrame:
    """Classes that may have a partner: set_id, n, hashes (sorted shared shingles), bitmap, prefix."""
    need = F.expr(f"n - (({percent} * n + 99) div 100) + 1")
    grouped = shared.groupBy("set_id").agg(
        F.max("n").alias("n"),
        F.sum("n_shared").alias("n_shared"),
        F.collect_list(F.struct("hashes", "degrees")).alias("parts"),
    )
    able = grouped.withColumn("open", need - (F.col("n") - F.col("n_shared"))).filter("open > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts, count in zip(batch.column("parts").to_pylist(), batch.column("open").to_pylist(), strict=True):
                hashes = np.frombuffer(b"".join(p["hashes"] for p in parts), "<u8")
                degrees = np.frombuffer(b"".join(p["degrees"] for p in parts), "<i4")
                chosen = hashes[np.lexsort((hashes, degrees))[:count]]
                spot = (hashes * _ODD) >> np.uint64(64 - BITS.bit_length() + 1)
                bitmap = np.zeros(BITS, bool)
                bitmap[spot.astype("i8")] = True
                out.append((np.sort(hashes).tobytes(), np.packbits(bitmap).tobytes(), chosen.astype("i8").tolist()))
            columns = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("set_id"),
                    batch.column("n"),
                    pa.array(columns[0], pa.binary()),
                    pa.array(columns[1], pa.binary()),
                    pa.array(columns[2], pa.list_(pa.int64())),
                ],
                ["set_id", "n", "hashes", "bitmap", "prefix"],
            )

    return able.select("set_id", "n", "open", "parts").mapInArrow(
        run, "set_id bigint, n bigint, hashes binary, bitmap binary, prefix array<bigint>"
    )


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose similarity reaches the threshold, checked on their shared shingles."""
    side = lambda name: sets.select(
        F.col("set_id").alias(name), F.col("n").alias(f"n_{name}"), F.col("hashes").alias(f"hashes_{name}")
    )
    both = pairs.join(side("u"), "u").join(side("v"), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            sizes = np.asarray(batch.column("n_u")) + np.asarray(batch.column("n_v"))
            for a, b, size in zip(batch.column("hashes_u"), batch.column("hashes_v"), sizes, strict=True):
                x, y = np.frombuffer(a.as_py(), "<u8"), np.frombuffer(b.as_py(), "<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (int(size) - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "u bigint, v bigint")


class SignatureTree:
    """Rows of one shingle in a tree: each level holds, per node, the OR and AND of its bitmaps, its sizes, the
    most shared shingles and the range of known groups."""

    def __init__(self, ids, sizes, shared, groups, bitmaps, sides=None):
        """With ``sides`` (0 or 1 for each row) only pairs across the sides are looked for."""
        self.across = sides is not None
        sides = np.zeros(len(ids), "i8") if sides is None else sides
        order = np.lexsort((ids, groups, sizes, sides))
        self.sides = sides[order]
        self.ids, self.sizes, self.shared, self.groups = ids[order], sizes[order], shared[order], groups[order]
        self.bitmaps = bitmaps[order]
        self.row = (self.bitmaps, self.bitmaps, self.sizes, self.sizes, self.shared, self.groups, self.groups, self.sides, self.sides)
        self.levels = [self._level(*self.row, LEAF)]
        while len(self.levels[-1][0]) > 1:
            self.levels.append(self._level(*self.levels[-1], FAN_OUT))

    @staticmethod
    def _level(some, all_, least, most, shared, low, high, side_low, side_high, width):
        starts = np.arange(0, len(some), width)
        return (
            np.bitwise_or.reduceat(some, starts, axis=0),
            np.bitwise_and.reduceat(all_, starts, axis=0),
            np.minimum.reduceat(least, starts),
            np.maximum.reduceat(most, starts),
            np.maximum.reduceat(shared, starts),
            np.minimum.reduceat(low, starts),
            np.maximum.reduceat(high, starts),
            np.minimum.reduceat(side_low, starts),
            np.maximum.reduceat(side_high, starts),
        )

    def _possible(self, percent, a, b):
        """Whether nodes a and b can hold a new link, for arrays of node pairs."""
        some_a, all_a, least_a, most_a, shared_a, low_a, high_a, first_a, last_a = a
        some_b, all_b, least_b, most_b, shared_b, low_b, high_b, first_b, last_b = b
        outside_a = np.bitwise_count(all_a & ~some_b).sum(axis=1)  # each is a shingle of a that b has not
        outside_b = np.bitwise_count(all_b & ~some_a).sum(axis=1)
        overlap = np.minimum(shared_a - outside_a, shared_b - outside_b)
        known = (low_a == high_a) & (low_b == high_b) & (low_a == low_b)
        sizes = (100 * most_a >= percent * least_b) & (100 * most_b >= percent * least_a)
        beside = (first_a == last_a) & (first_b == last_b) & (first_a == first_b) & self.across
        return sizes & ~known & ~beside & ((100 + percent) * overlap >= percent * (least_a + least_b))

    def pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows that may be linked and are in no common group yet."""
        a = b = np.zeros(1, int)
        for depth in range(len(self.levels) - 1, -1, -1):
            node = self.levels[depth]
            inside = (a == b) & (node[5][a] != node[6][a]) & ((node[7][a] != node[8][a]) | (not self.across))
            ok = self._possible(percent, [x[a] for x in node], [x[b] for x in node]) | inside
            a, b = a[ok], b[ok]
            below, width = (self.levels[depth - 1][0], FAN_OUT) if depth else (self.bitmaps, LEAF)
            a, b = self._children(a, b, width, len(below))
        row = self.row
        apart = a < b
        a, b = a[apart], b[apart]
        out = [np.zeros(0, int)], [np.zeros(0, int)]
        for start in range(0, len(a), 100_000):
            x, y = a[start : start + 100_000], b[start : start + 100_000]
            ok = self._possible(percent, [r[x] for r in row], [r[y] for r in row])
            out[0].append(x[ok])
            out[1].append(y[ok])
        a, b = np.concatenate(out[0]), np.concatenate(out[1])
        return self.ids[a], self.ids[b]

    @staticmethod
    def _children(a, b, width, count):
        grid = np.arange(width)
        x = (a[:, None, None] * width + grid[None, :, None]) + np.zeros((1, 1, width), int)
        y = (b[:, None, None] * width + grid[None, None, :]) + np.zeros((1, width, 1), int)
        x, y = x.ravel(), y.ravel()
        ok = (x < count) & (y < count) & (x <= y)
        return x[ok], y[ok]


COLUMNS = ("set_id", "n", "n_shared", "known", "bitmap")


def _streamed(rows: DataFrame, keys: tuple[str, ...], run, schema: str) -> DataFrame:
    """``run`` on one Arrow table per value of the keys. Rows of a key stand together, in order, in one partition and
    are read as a stream, so a task holds the rows of one key."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.asarray(batch.column(key)) for key in keys]
            edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if held and any(held[-1].column(key)[-1].as_py() != c[start] for key, c in zip(keys, columns, strict=True)):
                    yield from run(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(start, end - start))
        if held:
            yield from run(pa.Table.from_batches(held))

    return rows.mapInArrow(whole, schema)


def _candidates(part: pa.Table, percent: int, sides: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v) of one tree."""
    if part.num_rows < 2:
        return
    bitmaps = np.frombuffer(b"".join(part.column("bitmap").to_pylist()), "u8").reshape(-1, BITS // 64)
    values = [np.asarray(part.column(name)) for name in COLUMNS[:-1]]
    u, v = SignatureTree(*values, bitmaps, sides).pairs(percent)
    if len(u):
        both = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"])


def _tree_pairs(rows: DataFrame, mixed: DataFrame, percent: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Candidate pairs (u, v) from the rows and shingles of :func:`_crossing`.

    A shingle of at most ``block_rows`` rows has one tree. Larger ones are cut into blocks (:func:`_blocks`), and each
    pair of blocks that may hold a new link has a tree of its own.
    """
    plain = rows.filter(F.col("rows") <= block_rows).select("shingle", *COLUMNS)
    dealt = plain.repartition("shingle").sortWithinPartitions("shingle")
    schema = "u bigint, v bigint"
    found = _streamed(dealt, ("shingle",), lambda part: _candidates(part, percent), schema)
    hot = rows.filter(F.col("rows") > block_rows).select("shingle", *COLUMNS)
    if mixed.filter(F.col("rows") > block_rows).isEmpty():
        return found.distinct()
    blocks = _blocks(hot, block_rows)
    pairs = _block_pairs(blocks, percent)
    ends = F.array(F.struct(F.col("a").alias("block"), F.lit(0).alias("side")), F.struct(F.col("b").alias("block"), F.lit(1).alias("side")))
    wanted = pairs.select("a", "b", F.inline(ends)).filter("a <> b OR side = 0")
    members = blocks.join(wanted, "block").select("a", "b", "side", *COLUMNS)
    spread = members.repartition("a", "b").sortWithinPartitions("a", "b")

    def across(part: pa.Table) -> Iterator[pa.RecordBatch]:
        alone = part.column("a")[0] == part.column("b")[0]
        yield from _candidates(part, percent, None if alone else np.asarray(part.column("side")))

    return found.unionByName(_streamed(spread, ("a", "b"), across, schema)).distinct()


def _blocks(hot: DataFrame, block_rows: int) -> DataFrame:
    """The rows with ``block``: at most ``block_rows`` rows of one shingle, neighbours by known group and size.

    The order is cut by range, so a shingle of any size is sorted by many tasks.
    """
    order = ("shingle", "known", "n", "set_id")
    ordered = hot.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        number, held, shingle = 0, 0, None
        for batch in batches:
            values = np.asarray(batch.column("shingle"))
            out = np.empty(len(values), "i8")
            edges = np.flatnonzero(np.r_[True, values[1:] != values[:-1], True]) if len(values) else []
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                if values[start] != shingle:
                    number, held, shingle = number + 1, 0, values[start]
                place = held + np.arange(end - start)
                out[start:end] = number + place // block_rows
                number, held = number + int(place[-1] // block_rows), int(place[-1] % block_rows) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((task << 32) + out)], [*batch.schema.names, "block"])

    schema = "shingle bigint, set_id bigint, n bigint, n_shared bigint, known bigint, bitmap binary, block bigint"
    return stored(ordered.mapInArrow(run, schema), "shingle-blocks")


def _block_pairs(blocks: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of blocks of one shingle, a <= b, whose sizes, shares and known groups allow a new link.

    A block of one known group is not paired with itself or with another block of that group.
    """
    summary = stored(
        blocks.groupBy("shingle", "block").agg(
            F.min("n").alias("least"),
            F.max("n").alias("most"),
            F.max("n_shared").alias("shared"),
            F.min("known").alias("low"),
            F.max("known").alias("high"),
        ),
        "block-summaries",
    )
    side = lambda name: summary.select("shingle", *[F.col(c).alias(f"{c}_{name}") for c in summary.columns[1:]])
    new = "NOT (low_a = high_a AND low_b = high_b AND low_a = low_b)"
    sizes = f"100 * most_a >= {percent} * least_b AND 100 * most_b >= {percent} * least_a"
    overlap = f"({100 + percent}) * least(shared_a, shared_b) >= {percent} * (least_a + least_b)"
    both = side("a").join(side("b"), "shingle").filter(f"block_a <= block_b AND {new} AND {sizes} AND {overlap}")
    return both.select(F.col("block_a").alias("a"), F.col("block_b").alias("b"))


def links(docs: DataFrame, table: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """Verified links (u, v) between classes of ``table`` (see :func:`signed`) that tie each component together.

    Between classes that are already known to be connected further links are not looked for.
    """
    total = table.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    bits = max(LEAST_BUCKETS, total // BUCKET_SHINGLES + 1).bit_length()
    sets = stored(_prefixes(_shared(_packed(docs, bits, words)), percent), "shingle-sets")
    size = (F.length("hashes") / 8).cast("bigint")
    # the leader of a shingle is the class with the smallest part of its own, such as the original of many copies
    narrow = sets.select("set_id", (size / F.col("n")).alias("part"), F.explode("prefix").alias("shingle"))
    heads = (
        narrow.groupBy("shingle")
        .agg(F.max_by("set_id", F.struct("part", "set_id")).alias("other"), F.count("*").alias("rows"))
        .filter("rows > 1")
    )
    voted = attach_groups(narrow, stored(heads, "leaders"), "shingle", "rows", _prefix_rows(sets))
    stars = stored(_most_voted(voted, sets, percent), "star-links")
    # a class is known by its leader, or by its leader's leader
    upper = stars.select(F.col("u").alias("v"), F.col("v").alias("top"))
    known = stars.join(upper, "v", "left").select(F.col("u").alias("set_id"), F.coalesce("top", "v").alias("known"))
    base = sets.select("set_id", "n", size.alias("n_shared"), "bitmap", "prefix")
    crossing, _ = _crossing(base, known)
    other = F.when(F.col("known") == F.col("low"), F.col("high")).otherwise(F.col("low"))
    second = stored(_most_voted(crossing.withColumn("other", other), sets, percent), "star-links")
    stars = stars.unionByName(second)
    grouped = components(stars).select(F.col("vertex").alias("set_id"), F.col("component").alias("known"))
    more = _verified(stored(_tree_pairs(*_crossing(base, grouped), percent), "candidates"), sets, percent)
    return stars.unionByName(more)


def _most_voted(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of each class to the ``other`` that most of its shingles name: one comparison per class."""
    votes = rows.filter("set_id <> other").groupBy("set_id", "other").count()
    chosen = votes.groupBy("set_id").agg(F.max_by("other", F.struct("count", "other")).alias("v"))
    return _verified(chosen.select(F.col("set_id").alias("u"), "v"), sets, percent)


def _crossing(base: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (shingle, set_id, n, n_shared, known, bitmap, low, high, rows) of the shingles that several known groups
    share; a class in no group is known by itself, low and high are the outer groups of a shingle, rows its size.
    With them, the shingles themselves (shingle, low, high, rows)."""
    described = base.join(known, "set_id", "left").withColumn("known", F.coalesce("known", "set_id"))
    described = stored(described, "described")
    rows = described.select("set_id", "n", "n_shared", "known", "bitmap", F.explode("prefix").alias("shingle"))
    mixed = (
        rows.groupBy("shingle")
        .agg(F.min("known").alias("low"), F.max("known").alias("high"), F.count("*").alias("rows"))
        .filter("low < high")
    )
    mixed = stored(mixed, "mixed-shingles")
    return attach_groups(rows, mixed, "shingle", "rows", _prefix_rows(described)), mixed


def _prefix_rows(sets: DataFrame) -> int:
    """How many rows the prefixes of all classes give: the total that sizes of shingles add up to."""
    return sets.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]


def near_duplicates(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Two documents are linked when 100 |A n B| >= percent |A u B| for their sets of distinct shingles of
    ``words`` words, A-Z in lower case; a text of fewer words is one shingle. component_id is the smallest
    doc_id that links reach, the document itself included; a null id counts only where there is no other.
    Null, empty and white texts have no shingles and no links: component_id is their own doc_id. Repeated
    rows each give a row. Other columns are not read; an empty table gives an empty result.
    """
    table = stored(signed(docs, words), "shingle-classes")
    found = components(links(docs, table, percent, words))
    classes = table.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("first"), F.count("*").alias("members"))
    placed = classes.join(found.withColumnRenamed("vertex", "set_id"), "set_id", "left").withColumn(
        "component", F.coalesce("component", "set_id")
    )
    placed = stored(placed, "placed-classes")
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("held"))
    tops = attach_groups(placed, least, "component", "held", placed.count()).select("set_id", "members", "component_id")
    own = table.filter("set_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    rows = attach_groups(table.filter("set_id IS NOT NULL"), tops, "set_id", "members", table.count())
    return rows.select("doc_id", "n_shingles", "component_id").unionByName(own)


def keep_one(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """The documents whose id is the smallest of their group of near duplicates, all columns as they were.

    Rows without an id stay. Rows that share an id are one document: they stay together when any of them does.
    """
    found = near_duplicates(docs, percent, words)
    dropped = (
        found.groupBy("doc_id")
        .agg(F.min((F.col("doc_id") != F.col("component_id")).cast("int")).alias("dropped"))
        .filter("dropped = 1")
        .select("doc_id")
    )
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
