"""The operators as named queries over the documents table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aisle.llm import alignment, bpe, exact_dedup, fingerprints, licenses, lm, negatives, ngram_join, packing, pieces, pii, quality, toxicity
from aisle.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_syncmer_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edited_fingerprints(read_table(spark, folder, "documents"))


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read_table(spark, folder, "documents"), tokenizer_path(packing.VOCABULARY))


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, folder, "documents"))


def op4_quality_co_training(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, folder, "documents"))


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_pii(read_table(spark, folder, "documents"))


def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path, pattern = tokenizer_path(bpe.VOCABULARY), public_tokenizers.PATTERN
    return bpe.digests(bpe.decode(bpe.encode(read_table(spark, folder, "documents"), path, pattern), path, pattern))


def op9_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(read_table(spark, folder, "documents"))


def op10_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(read_table(spark, folder, "documents"))


def op11_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    path = tokenizer_path(pieces.VOCABULARY)
    encoded = pieces.encode(read_table(spark, folder, "documents"), path).select("doc_id", "ids")  # the digests need no spans
    return pieces.digests(pieces.decode(encoded, path))


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    paths = tokenizer_path(alignment.BYTE_LEVEL), tokenizer_path(alignment.PIECES)
    return alignment.agreement(read_table(spark, folder, "documents"), *paths)


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return negatives.mine(read_table(spark, folder, "embeddings"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline  # stands beside the package, not in it

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_syncmer_fingerprints,
        op2_best_fit_packing,
        op3_license_scan,
        op4_quality_co_training,
        op5_toxicity,
        op6_exact_dedup,
        op7_pii,
        op8_byte_bpe,
        op9_lm_scores,
        op10_ngram_jaccard,
        op11_sentencepiece,
        op12_token_alignment,
        op13_hard_negatives,
        pipeline,
    )
}

EXACT_DEDUP_SQL = r"""
WITH hashed AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \t-\r]+', ' ', 'g')) AS text_sha256
    FROM documents
), ranked AS (
    SELECT doc_id, text_sha256, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
           count(*) OVER (PARTITION BY text_sha256) AS group_size,
           row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) AS place
    FROM hashed
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM ranked
"""

ORACLES: dict[str, str] = {"op6_exact_dedup": EXACT_DEDUP_SQL}
