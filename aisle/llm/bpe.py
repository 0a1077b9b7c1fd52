"""Byte-level BPE through a sentencepiece model written directly from a rank vocabulary.

Nothing is trained. Every byte stands for one character of its own (byte b as U+0100+b), every token of the
vocabulary becomes a piece of such characters scored by its negative rank, and normalisation is the
identity; sentencepiece then merges the best-ranked neighbours first, leftmost of equals, which is the
rank order of the vocabulary. Texts are cut into pre-tokens, each encoded by itself; decoding maps ids to
pieces, pieces to bytes.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from aisle.llm.common import text_of

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
REMEMBERED = 400_000  # pre-tokens whose ids a worker keeps
BATCH_CHARS = 4_000_000  # texts of so many characters, or one longer text, are encoded at a time

# Unicode white space, spelt out because libraries differ in what \s means.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Latin letters whose lower case is one letter and has no context; with ASCII they make a simple text.
LETTERS = "a-zA-Z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0132-\u0137\u0139-\u0148\u014a-\u017f"
_SIMPLE = re.compile(f"[ -~\t-\r{LETTERS}]*")
_TO_CHARS = {b: 0x100 + b for b in range(256)}


def is_simple(text: str) -> bool:
    """Whether a text holds only ASCII and common Latin letters, which Python's ``re`` cuts fast."""
    return _SIMPLE.fullmatch(text) is not None


def spelt(pattern: str, letters: str, numbers: str, space: str) -> str:
    """A pre-token pattern with its character classes written out."""
    for short, long in ((r"\p{L}", letters), (r"\p{N}", numbers)):
        pattern = pattern.replace(f" ?{short}+", f" ?[{long}]+").replace(short, long)
    return pattern.replace(r"[^\s", f"[^{space}").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def as_chars(data: bytes) -> str:
    return data.decode("latin-1").translate(_TO_CHARS)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece i is the token of the i-th smallest rank; the last is unknown."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
        model.pieces.add(piece=as_chars(token), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unknown>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.unk_piece = "<unknown>"
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


class ByteBpe:
    """Encoder and decoder of one vocabulary; one instance per worker."""

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        ordered = sorted(self.ranks.items(), key=lambda item: item[1])
        self.rank_of = np.asarray([rank for _, rank in ordered], "<i4")
        self.bytes_of = {rank: token for token, rank in ordered}
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.ranks))
        self.any_text = regex.compile(spelt(pattern, r"\p{L}", r"\p{N}", _SPACE))
        self.simple_text = re.compile(spelt(pattern, LETTERS, "0-9", r" \t-\r"))
        self.remembered = remembered
        self.known: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        parts = [x.encode("utf-8", "surrogatepass") for x in new]
        found = self.processor.encode([as_chars(x) for x in parts], num_threads=1)
        for text, part, ids in zip(new, parts, found, strict=True):
            whole = self.ranks.get(part)  # a pre-token that is a token by itself is not merged
            self.known[text] = (self.rank_of[ids] if whole is None else np.asarray([whole], "<i4")).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        cut = [(self.simple_text if is_simple(x) else self.any_text).findall(x) for x in texts]
        wanted = set(chain.from_iterable(cut))
        new = list(wanted - self.known.keys())
        if len(self.known) + len(new) > self.remembered:
            self.known.clear()
            new = list(wanted)
        for start in range(0, len(new), 10_000):
            self._learn(new[start : start + 10_000])
        get = self.known.__getitem__
        return [b"".join(map(get, parts)) for parts in cut]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def worker_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def batches_by_size(values: list, most: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of a batch whose values have at most ``most`` items together, or one larger value."""
    start = held = 0
    for i, value in enumerate(values):
        if held and held + len(value) > most:
            yield start, i
            start, held = i, 0
        held += len(value)
    if values:
        yield start, len(values)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every text. Null and empty texts have no ids.

    Texts are whole, whatever their length; repeated rows each give a row; other columns are not read.
    """
    source = docs.select("doc_id", text_of().alias("text"))
    schema = StructType([source.schema["doc_id"], StructField("ids", ArrayType(IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path, pattern)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, end in batches_by_size(texts):
                found = bpe.encode(texts[start:end])
                ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype="int32")
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, end - start), ids], ["doc_id", "ids"])

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows of ``encoded`` with ``decoded``, the bytes its ids stand for."""
    schema = StructType([*encoded.schema.fields, StructField("decoded", BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path, pattern)
        for batch in batches:
            column = batch.column("ids")
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                decoded = [bpe.decode(ids) for ids in column.slice(start, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids in decimal joined by commas and of the decoded bytes."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
