"""Document fingerprints from closed syncmers, with Spark's own functions only.

A text is read as tokens: runs of non-white characters, runs longer than PIECE cut into pieces of it.
Every K consecutive tokens are a k-mer; its inner substrings are the K-S+1 runs of S tokens. The k-mer is
a closed syncmer when the smallest inner hash is the first or the last of them. That depends on nothing
outside the k-mer, so the same passage gives the same anchors wherever it stands. The fingerprint is all of a
text's anchors in order. Texts are matched by place: an anchor and the next one at their distance are a link, and
likeness is that of the full sets of links. A passage that moves as a whole keeps its links, words in another
order don't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisle.llm.common import let, stored, text_of
from aisle.plans.positions import positions

K, S = 5, 2
PIECE = 12
KEY = ["id", "no_id", "text_key"]  # of a document


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([^ \t-\r]{1,%d})" % PIECE), F.lit(1))


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """Closed syncmers in text order: array of (at, hash), ``at`` counted in tokens from 0.

    A text of fewer than ``k`` tokens is one k-mer; a text without tokens (null, empty, white) has none.
    """
    at = lambda array, i, step: F.get(array, i + F.lit(step))

    def closed(words: Column, inner: Column) -> Column:
        edge = lambda i: F.least(at(inner, i, 0), at(inner, i, k - s))
        middle = lambda i: F.least(*[at(inner, i, j) for j in range(1, k - s)], edge(i))
        chosen = F.filter(F.sequence(F.lit(0), F.size(words) - F.lit(k)), lambda i: edge(i) <= middle(i))
        return F.transform(
            chosen, lambda i: F.struct(i.alias("at"), F.hash(*[at(words, i, j) for j in range(k)]).alias("hash"))
        )

    def found(words: Column) -> Column:
        one = F.array(F.struct(F.lit(0).alias("at"), F.hash(F.array_join(words, " ")).alias("hash")))
        inner = F.transform(
            F.sequence(F.lit(0), F.size(words) - F.lit(s)), lambda i: F.xxhash64(*[at(words, i, j) for j in range(s)])
        )
        return (
            F.when(F.size(words) == 0, F.slice(one, 1, 0))
            .when(F.size(words) < k, one)
            .otherwise(let(inner, lambda hashes: closed(words, hashes)))
        )

    return let(tokens(text), found)


def hashes(found: Column) -> Column:
    """All distinct hashes of the anchors."""
    return F.array_distinct(F.transform(found, lambda x: x["hash"]))


def links(found: Column) -> Column:
    """Distinct hashes of every anchor with the next one and the tokens between them; of a lone anchor itself."""

    def linked(all_: Column) -> Column:
        pairs = F.zip_with(
            all_,
            F.slice(all_, 2, F.size(all_)),
            lambda here, there: F.when(there.isNotNull(), F.hash(here["hash"], there["hash"], there["at"] - here["at"])),
        )
        return F.when(F.size(all_) < 2, hashes(all_)).otherwise(F.array_distinct(F.array_compact(pairs)))

    return let(found, linked)


def shown(found: Column) -> Column:
    """Anchors as a string of place:hash in text order, both hexadecimal; empty for a text without tokens."""
    return F.array_join(
        F.transform(found, lambda x: F.concat(F.lower(F.hex(x["at"])), F.lit(":"), F.lower(F.lpad(F.hex(x["hash"].cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")))), ","
    )


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two sets of links. Two empty ones are alike (1.0), an empty and another one are not (0.0)."""
    shared = let(F.size(F.array_intersect(a, b)), lambda both: both / (F.size(a) + F.size(b) - both))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(shared)


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, anchors, and the distinct hashes and links of every document."""
    found = docs.select("doc_id", anchors(text_of()).alias("anchors"))
    return found.withColumns({"hashes": hashes(F.col("anchors")), "links": links(F.col("anchors"))})


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third is the next document's start.

    The next document is the one with the next smaller doc_id, after the smallest the largest; null ids
    come last. Repeated rows (equal id and text) are one document here: each gets the same row, and their
    next document is the next different one. Rows with equal ids and other texts follow one another by a
    hash of the text. A single document is its own next. Null text counts as empty; other columns are
    not read.

    Ids are numbered over range partitions, never in one window. Texts move once, by their own key; what
    moves to the neighbour is the start of a text, cut to what the neighbour needs, and the text's links.
    """
    text = text_of()
    # null ids are equal here: KEY says so in plain columns, by which rows are dealt once for all that follows
    base = docs.select(
        text.alias("text"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.isnull("doc_id").alias("no_id"), F.xxhash64(text).alias("text_key")
    )
    doc_id = F.when(~F.col("no_id"), F.col("id")).alias("doc_id")
    single = base.groupBy(doc_id, "text_key").agg(F.first(F.length("text").cast("bigint")).alias("n_chars"))
    numbered = stored(
        positions(single, [("doc_id", False)], [("text_key", True)], spread=True).select(
            F.coalesce("doc_id", F.lit(0)).alias("id"), F.isnull("doc_id").alias("no_id"), "text_key", "n_chars", "row_no", "group_rows"
        ),
        "document-order",
    )
    following = numbered.select(*[F.col(c).alias(f"next_{c}") for c in KEY], F.col("row_no").alias("next_no"))
    order = numbered.withColumn("next_no", F.col("row_no") % F.col("group_rows") + 1).join(following, "next_no")
    wanted = order.select(
        *[F.col(f"next_{c}").alias(c) for c in KEY], *[F.col(c).alias(f"for_{c}") for c in KEY], F.expr("n_chars div 3").alias("cut")
    )
    starts = (
        base.join(wanted, KEY)
        .select(
            *[F.col(f"for_{c}").alias(c) for c in KEY],
            F.expr("substring(text, 1, int(cut))").alias("start"),
            "cut",
            links(anchors(F.col("text"))).alias("next_links"),
        )
        .dropDuplicates(KEY)
    )
    edited = base.join(starts, KEY).select(
        doc_id,
        "next_links",
        F.length("text").cast("bigint").alias("n_chars"),
        "text",
        F.concat(F.expr("substring(text, 1, int(length(text) - cut))"), F.col("start")).alias("edited"),
    )

    def compared(own: Column, changed: Column) -> Column:
        near = lambda mine: F.struct(
            shown(own).alias("fingerprint"),
            shown(changed).alias("edited_fingerprint"),
            let(links(changed), lambda other: likeness(mine, other)).alias("near_edited"),
            likeness(mine, F.col("next_links")).alias("near_next"),
        )
        return let(links(own), near)

    found = F.array(let(anchors(F.col("text")), lambda own: let(anchors(F.col("edited")), lambda changed: compared(own, changed))))
    # the explode hands on a computed value, so that its fields are not each evaluated again
    return edited.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.explode(found).alias("found")
    ).select("doc_id", "n_chars", "edited_sha256", "found.*")

