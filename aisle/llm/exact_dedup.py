"""Exact deduplication by two Bloom passes: only rows with a possibly repeated hash are shuffled.

Pass one cuts every hash to a cell (a 64-bit word of the filter and three bits in it) and counts the
cells, combined map-side; the cells counted twice make the filter. Pass two tests every row against the
filter: a row that fails is the only one of its text and goes straight to the result, a row that passes
is grouped by its full hash, so a false positive costs a little shuffle and never a wrong answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisle.llm.common import WHITE_SPACE, attach_groups, stored, text_of

BITS_PER_ROW = 16
MOST_WORDS = 1 << 20  # 8 MB of bits: beyond it the filter gets fuller and more rows are shuffled, none is lost


def text_hash(text: Column) -> Column:
    """SHA-256, in lower-case hex, of the text with each run of white space as one space."""
    return F.sha2(F.regexp_replace(text, WHITE_SPACE, " "), 256)


def filter_words(rows: int) -> int:
    """64-bit words of a filter for so many rows: a power of two between 1024 and MOST_WORDS."""
    wanted = max(1024, rows * BITS_PER_ROW // 64)
    return min(MOST_WORDS, 1 << (wanted - 1).bit_length())


def cell(key: str, words: int) -> list[Column]:
    """The word and the mask of three bits in it that stand for a hash."""
    h = F.xxhash64(key)
    place = lambda shift: F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int")
    bit = lambda shift: F.call_function("shiftleft", F.lit(1).cast("bigint"), place(shift))
    return [
        h.bitwiseAND(F.lit(words - 1)).alias("word"),
        bit(40).bitwiseOR(bit(46)).bitwiseOR(bit(52)).alias("mask"),
    ]


def repeated_filter(hashes: DataFrame, key: str, words: int) -> DataFrame:
    """Bloom filter of the hashes that may occur twice: (word, bits), at most ``words`` rows."""
    counted = hashes.select(*cell(key, words)).groupBy("word", "mask").count()
    return counted.filter("count > 1").groupBy("word").agg(F.bit_or("mask").alias("bits"))


def marked(rows: DataFrame, key: str, bloom: DataFrame, words: int) -> DataFrame:
    """Rows with ``maybe``: whether the filter holds their hash. The filter's size is bounded by ``words``."""
    word, mask = cell(key, words)
    found = rows.withColumns({"word": word, "mask": mask}).join(F.broadcast(bloom), "word", "left")
    held = F.coalesce(F.col("bits"), F.lit(0).cast("bigint")).bitwiseAND(F.col("mask")) == F.col("mask")
    return found.withColumn("maybe", held).drop("word", "mask", "bits")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty and all empty texts are equal. Of equal texts the smallest doc_id stays,
    a null id only when there is no other. Of repeated rows with that id one is kept. An empty table
    gives an empty result; other columns are not read.
    """
    hashed = stored(docs.select("doc_id", text_hash(text_of()).alias("text_sha256")), "text-hashes")
    total = hashed.count()
    words = filter_words(total)
    bloom = repeated_filter(hashed, "text_sha256", words)
    rows = marked(hashed, "text_sha256", bloom, words)
    alone = rows.filter(~F.col("maybe")).select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    repeated = rows.filter("maybe").groupBy("text_sha256", "doc_id").agg(F.count("*").alias("copies"))
    groups = repeated.groupBy("text_sha256").agg(
        F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")
    )
    members = attach_groups(repeated, groups, "text_sha256", "group_size", total)
    copy = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy")
    together = members.select("*", copy).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        "text_sha256",
    )
    return alone.unionByName(together)


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents themselves without exact copies, all columns as they were.

    Rows whose hash cannot be repeated stay in their tasks. The others are reduced to the first row of
    each text map-side before they move, so a text holding a third of the rows moves once per task.
    Ties on doc_id are broken by the other columns, which must be comparable.
    """
    keyed = docs.select(F.struct("*").alias("row"), text_hash(text_of(docs["text"])).alias("text_sha256"))
    hashes = stored(keyed.select("text_sha256"), "text-hashes")
    words = filter_words(hashes.count())
    bloom = stored(repeated_filter(hashes, "text_sha256", words), "repeated-hashes")
    rows = marked(keyed, "text_sha256", bloom, words)
    order = F.struct(F.col("row.doc_id").isNull().alias("no_id"), F.col("row.doc_id").alias("id"), F.col("row"))
    first = rows.filter("maybe").groupBy("text_sha256").agg(F.min(order).alias("first")).select("first.row")
    return rows.filter(~F.col("maybe")).select("row").unionByName(first).select("row.*")
