"""SentencePiece encoding that keeps, for every piece, the bytes of the original text it stands for.

A text is normalised as the model's file says: at each place the longest entry of the compiled character map that
the text continues with is replaced, other characters stay, spaces are escaped, and a dummy space may go in
front. While that happens every normalised byte notes where in the original text its entry began, and one more
place notes where the last entry ended. The normalised text is then encoded, and as pieces follow one another
without gaps, the sums of their lengths, looked up in those notes, are the original spans.

No piece of a usual vocabulary has a space after another character. The merges of a text are then those of its
words, and a worker encodes each word once. For other vocabularies the whole text is one word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

from aisle.llm.common import text_of
from aisle.llm.memo import Memo, slices_by_size

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"  # how pieces write a space
REMEMBERED_CHARS = 8_000_000  # characters of words whose ids a worker keeps
BATCH_CHARS = 1_000_000  # texts of so many bytes, or one longer text, are encoded at a time


def map_entries(compiled: bytes) -> dict[bytes, bytes]:
    """The entries (prefix, replacement) of a compiled character map.

    The map is a double-array trie of 32-bit units, its size in front, and the replacements behind it, each
    ended by a zero byte. The trie is walked level by level, all nodes of a level at once.
    """
    if not compiled:
        return {}
    size = int.from_bytes(compiled[:4], "little")
    units = np.frombuffer(compiled[4 : 4 + size], "<u4").astype("i8")
    values = compiled[4 + size :]
    below = (units >> 10) << ((units & (1 << 9)) >> 6)
    label = units & ((1 << 31) | 0xFF)
    has_value = (units >> 8) & 1 == 1
    letters = np.arange(1, 256)
    entries = {}
    nodes, keys = below[:1], [b""]
    while len(keys):
        child = nodes[:, None] ^ letters
        inside = child < len(units)
        node, letter = np.nonzero(inside & (label[np.where(inside, child, 0)] == letters))
        at = child[node, letter]
        keys = [keys[n] + bytes([b]) for n, b in zip(node.tolist(), letters[letter].tolist(), strict=True)]
        nodes = at ^ below[at]
        for i in np.flatnonzero(has_value[at]):
            start = int(units[nodes[i]] & 0x7FFFFFFF)
            entries[keys[i]] = values[start : values.index(b"\0", start)]
    return entries


class Normaliser:
    """Longest-prefix normalisation of one model, with the source of every normalised byte."""

    def __init__(self, spec, kept: list[str] = (), suffix: bool = False):
        """``spec`` is the model's normaliser; pieces in ``kept`` are user-defined and pass unchanged."""
        entries = {k.decode(): v.decode() for k, v in map_entries(spec.precompiled_charsmap).items()}
        entries |= {piece: piece for piece in kept if piece}
        self.entries = {k: v for k, v in entries.items() if k != v or k in kept}
        self.longest = max(map(len, self.entries), default=0)
        first = "".join(map(re.escape, sorted({k[0] for k in self.entries})))
        self.may_start = re.compile(f"[{first}]") if first else None
        self.kept, self.suffix = set(kept), suffix
        self.dummy, self.trim, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces

    def steps(self, text: str) -> Iterator[tuple[str, str]]:
        """(what is read, what is written) from left to right, the longest entry first."""
        at = 0
        while at < len(text):
            for size in range(min(self.longest, len(text) - at), 0, -1):
                if (read := text[at : at + size]) in self.entries:
                    yield read, self.entries[read]
                    break
            else:
                size, read = 1, text[at]
                yield read, read
            at += size

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and per UTF-8 byte of it, and once more for its end, the place in the original."""
        space = SPACE if self.escape else " "
        if not text:
            return "", np.zeros(1, "i8")
        if not self.trim and not self.suffix and (self.may_start is None or not self.may_start.search(text)):
            data = np.frombuffer(text.encode(), "u1")
            begins = np.maximum.accumulate(np.where((data & 0xC0) == 0x80, 0, np.arange(len(data))))
            source = np.repeat(begins, np.where(data == 32, len(space.encode()), 1))
            front = len(space.encode()) if self.dummy else 0
            whole = np.zeros(front + len(source) + 1, "i8")
            whole[front:-1], whole[-1] = source, len(data)
            return (space if self.dummy else "") + text.replace(" ", space), whole
        out, source, consumed, after_space, lead = [], [], 0, self.trim, self.trim
        dummy = self.dummy and not self.suffix
        for read, written in self.steps(text):
            if lead and written == " ":
                consumed += len(read.encode())
                continue
            lead = False
            if dummy:
                out.append(space)
                source += [consumed] * len(space.encode())
                dummy = False
            if after_space:
                written = written.lstrip(" ")
            if written:
                after_space = self.trim and written.endswith(" ")
                shown = written.replace(" ", space)
                out.append(shown)
                source += [consumed] * len(shown.encode())
            consumed += len(read.encode())
        whole = "".join(out)
        if self.trim:
            while whole.endswith(space):
                whole = whole[: -len(space)]
                consumed = source[len(whole.encode())]
                del source[len(whole.encode()) :]
        if whole and self.suffix and self.dummy:
            whole += space
            source += [consumed] * len(space.encode())
        return whole, np.asarray([*source, consumed], "i8")


class PieceEncoder:
    """Encoder of one model; one instance per worker."""

    def __init__(self, model: bytes, remembered: int = REMEMBERED_CHARS):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto.FromString(model)
        kinds = pb.ModelProto.SentencePiece
        kept = [p.piece for p in proto.pieces if p.type == kinds.USER_DEFINED]
        self.normalise = Normaliser(proto.normalizer_spec, kept, proto.trainer_spec.treat_whitespace_as_suffix)
        self.by_word = proto.trainer_spec.byte_fallback and not any(SPACE in p.piece.lstrip(SPACE) for p in proto.pieces)
        as_byte = lambda piece: bytes([int(piece[3:5], 16)])  # noqa: E731  "<0x41>"
        self.bytes_of = [as_byte(p.piece) if p.type == kinds.BYTE else p.piece.encode() for p in proto.pieces]
        self.length_of = np.asarray([len(b) for b in self.bytes_of], "i8")
        proto.normalizer_spec.Clear()
        proto.normalizer_spec.name = "identity"
        proto.normalizer_spec.add_dummy_prefix = False
        proto.normalizer_spec.remove_extra_whitespaces = False
        proto.normalizer_spec.escape_whitespaces = False
        self.words = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.unknown, self.begin, self.end = self.words.unk_id(), self.words.bos_id(), self.words.eos_id()
        self.known = Memo(remembered)
        self.cut = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of normalised words, as little-endian unsigned 32-bit integers."""
        return [np.asarray(ids, "<u4").tobytes() for ids in self.words.encode(words, num_threads=1)]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text with begin and end, and the len + 1 original byte offsets that its inner pieces meet at."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        normal = [self.normalise(text) for text in texts]
        cut = [self.cut.findall(text) if self.by_word else [text] * bool(text) for text, _ in normal]
        self.known.learn(chain.from_iterable(cut), self.encode_words)
        get = self.known.__getitem__
        found = []
        for words, (text, source) in zip(cut, normal, strict=True):
            ids = np.frombuffer(b"".join(map(get, words)), "<u4")
            lengths = self.length_of[ids]
            if not self.by_word and (ids == self.unknown).any():
                lengths = self._lengths(text)
            whole, edges = np.empty(len(ids) + 2, "<u4"), np.zeros(len(ids) + 1, "i8")
            whole[0], whole[1:-1], whole[-1] = self.begin, ids, self.end
            np.cumsum(lengths, out=edges[1:])
            found.append((whole, source[edges]))
        return found

    def _lengths(self, text: str) -> np.ndarray:
        """Lengths of the pieces of a normalised text; an unknown piece is as long as what it replaces."""
        return np.asarray([len(piece.encode()) for piece in self.words.encode(text, out_type=str)], "i8")


@lru_cache(maxsize=2)
def worker_decoder(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def worker_pieces(path: str) -> PieceEncoder:
    with open(path, "rb") as file:
        return PieceEncoder(file.read())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, starts, ends of every whole text.

    ``ids`` are little-endian unsigned 32-bit integers, with the begin and end ids. ``starts`` and ``ends`` have the
    span of each id in the bytes of the original text; begin and end have the empty spans at either end. Of a
    character written as several byte pieces the last has its span. A null or empty text has the begin and end
    ids alone. Repeated rows each give a row; other columns are not read; an empty table gives an empty result.
    """
    source = docs.select("doc_id", text_of().alias("text"))
    spans = ArrayType(IntegerType(), False)
    schema = StructType(
        [source.schema["doc_id"], StructField("ids", BinaryType(), False), StructField("starts", spans, False), StructField("ends", spans, False)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_pieces(path)
        for batch in batches:
            for part in slices_by_size(batch, "text", BATCH_CHARS):
                found = encoder.encode_all(part.column("text").to_pylist())
                at = pa.array(np.cumsum([0, *(len(ids) for ids, _ in found)], dtype="int32"))
                zero = np.zeros(1, "i8")
                starts = np.concatenate([x for _, edges in found for x in (zero, edges)])
                ends = np.concatenate([x for _, edges in found for x in (zero, edges[1:], edges[-1:])])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([ids.tobytes() for ids, _ in found], pa.binary()),
                        pa.ListArray.from_arrays(at, pa.array(starts.astype("i4"))),
                        pa.ListArray.from_arrays(at, pa.array(ends.astype("i4"))),
                    ],
                    schema.names,
                )

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encoded`` with ``decoded``, the text that the library gives for their ids."""
    schema = StructType([*encoded.schema.fields, StructField("decoded", StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = worker_decoder(path)
        for batch in batches:
            for part in slices_by_size(batch, "ids", BATCH_CHARS):
                ids = [np.frombuffer(x, "<u4").tolist() for x in part.column("ids").to_pylist()]
                decoded = pa.array(processor.decode(ids, num_threads=1), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded text in UTF-8."""
    return decoded.select(
        "doc_id",
        (F.length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
