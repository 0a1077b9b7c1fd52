"""Toxicity by compression distance: windows of a text under a toxic and an ordinary zstandard dictionary.

Both dictionaries end with the same prose of ordinary documents, so what is common costs the same under either.
In front of it the toxic dictionary has the segments that set toxic documents apart, the ordinary one as many
common segments of ordinary documents. A window that compresses shorter under the toxic dictionary holds such
segments; how many windows do, and by how much, is calibrated to a probability on labelled documents that the
dictionaries have not seen. Labels are read for learning alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisle.llm.common import remainder, text_of

PER_CLASS = 3000  # labelled documents of either kind that the classifier is fitted on, at most
BASE_BYTES = 250_000  # ordinary prose in both dictionaries, at most, chosen by a hash over the whole texts
WINDOW, STEP = 72, 60
# Reaches the whole dictionary and takes matches of four bytes, at a cost of a few microseconds a window.
SEARCH = {"window_log": 20, "hash_log": 18, "chain_log": 20, "search_log": 6, "min_match": 4, "target_length": 16, "strategy": 5}
SEGMENT = range(4, 15)  # bytes of a segment: starts of words and whole words
EVIDENCE = 12.0  # least log-likelihood ratio by which a segment sets toxic documents apart
PURITY = 20  # least ratio of the shares of toxic and ordinary documents that hold a segment
STEPS_UP = (1, 2, 3, 4, 6)
THRESHOLD = 0.3


class Model(NamedTuple):
    toxic: bytes
    ordinary: bytes
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the constant


def plain(text: str) -> bytes:
    """UTF-8 with A-Z in lower case and single spaces, one at either end."""
    return b" " + b" ".join(text.encode("utf-8", "surrogatepass").lower().split()) + b" "


def windows(data: bytes) -> list[bytes]:
    """Overlapping windows over all bytes."""
    return [data[i : i + WINDOW] for i in range(0, max(1, len(data) - WINDOW + STEP), STEP)]


def by_hash(found: Iterable[bytes], most: int) -> bytes:
    """Different pieces in the order of their hash, up to ``most`` bytes."""
    chosen, held = [], 0
    for piece in sorted(set(found), key=lambda p: (crc32(p), p)):
        held += len(piece) + 1
        if held > most:
            break
        chosen.append(piece)
    return b" ".join(chosen)


def segments(data: bytes) -> set[bytes]:
    found = set()
    for word in set(data.split()):
        word = b" " + word.strip(b".,;:!?#$%&*|\"'()") + b" "
        found.update(word[: n + 1] for n in SEGMENT if len(word) > n)
    return found


def telling_segments(toxic: list[bytes], ordinary: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Segments that set toxic documents apart, and common segments of ordinary ones, rarest first."""
    a, b = Counter(), Counter()
    for held, texts in ((a, toxic), (b, ordinary)):
        for text in texts:
            held.update(segments(text))
    na, nb = len(toxic), len(ordinary)

    def evidence(x: int, y: int) -> float:
        mean = (x + y) / (na + nb)
        return 2 * (x * np.log(x / na / mean) + (y * np.log(y / nb / mean) if y else 0))

    apart = {s for s, x in a.items() if x >= 3 and x / na > PURITY * (b[s] + 0.5) / nb and evidence(x, b[s]) > EVIDENCE}
    chosen: set[bytes] = set()
    for s in sorted(apart, key=len):
        shorter = next((s[:n] for n in range(len(s) - 1, 4, -1) if s[:n] in chosen), None)
        if shorter is None:
            chosen.add(s)
        elif a[s] >= 0.8 * a[shorter]:  # the same word, told more fully
            chosen.discard(shorter)
            chosen.add(s)
    common = [s for s, _ in b.most_common(20 * len(chosen) + 1000) if s not in apart and len(s) == 7]
    return sorted(chosen, key=lambda s: (a[s], s)), common[: len(chosen)][::-1]


@lru_cache(maxsize=2)
def _compressors(toxic: bytes, ordinary: bytes):
    import zstandard

    made = []
    for content in (toxic, ordinary):
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        settings = zstandard.ZstdCompressionParameters(
            **SEARCH, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        dictionary.precompute_compress(compression_params=settings)
        made.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings))
    return made


def features(text: str, toxic: bytes, ordinary: bytes) -> np.ndarray:
    """How many bytes shorter the windows are under the toxic dictionary, summed up for a whole text."""
    under_toxic, under_ordinary = (c.compress for c in _compressors(toxic, ordinary))
    gain = np.asarray([len(under_ordinary(w)) - len(under_toxic(w)) for w in windows(plain(text))], float)
    n = len(gain)
    above = [np.log1p((gain >= s).sum()) for s in STEPS_UP]
    rates = [np.sqrt((gain >= s).mean()) for s in STEPS_UP]
    return np.asarray([*above, *rates, min(gain.max(), 12), gain.mean(), np.log(n), np.log1p((gain <= -2).sum())])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + keep * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(keep) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str], toxic: list[int], totals: tuple[int, int] | None = None) -> Model:
    """Dictionaries from two thirds of the documents, calibration on the rest.

    ``totals`` has the numbers of all ordinary and toxic labels that the documents stand for.

    Without documents of both kinds the score is the same for all texts.
    """
    label = np.asarray(toxic, float)
    data = [plain(t) for t in texts]
    third = np.zeros(len(label), bool)
    for kind in (0, 1):  # every third document of either kind calibrates
        third[np.flatnonzero(label == kind)[2::3]] = True
    bad = [d for d, y, t in zip(data, label, third, strict=True) if y == 1 and not t]
    good = [d for d, y, t in zip(data, label, third, strict=True) if y == 0 and not t]
    if not bad or not good or not third.any():
        share = float(label.mean()) if len(label) else 0.0
        constant = np.log((share + 1e-6) / (1 - share + 1e-6))
        size = len(STEPS_UP) * 2 + 4
        return Model(b"", b"", np.zeros(size), np.ones(size), np.r_[np.zeros(size), constant])
    telling, common = telling_segments(bad, good)
    # the odd or the even windows of a text, so that its pieces do not overlap
    base = by_hash((w for d in good for w in windows(d)[crc32(d) % 2 :: 2]), BASE_BYTES)
    dictionaries = [b"".join(head) + b" " + base for head in (telling, common)]
    rest = np.flatnonzero(third)
    x = np.stack([features(texts[i], *dictionaries) for i in rest])
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    per_row = np.asarray([totals[k] / (label == k).sum() for k in (0, 1)]) if totals else np.ones(2)
    weight = per_row[label[rest].astype(int)]
    return Model(*dictionaries, center, scale, logistic((x - center) / scale, label[rest], weight))


def probability(model: Model, texts: list[str]) -> np.ndarray:
    if not model.toxic or not texts:
        return np.full(len(texts), 1 / (1 + np.exp(-model.weights[-1])))
    x = np.stack([features(t, model.toxic, model.ordinary) for t in texts])
    value = ((x - model.center) / model.scale) @ model.weights[:-1] + model.weights[-1]
    return 1 / (1 + np.exp(-np.clip(value, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, divisor: int = 4, left_out: int = 2, most: int = PER_CLASS) -> Model:
    """Fit on labelled documents outside the held-out remainder, at most ``most`` of either kind by a hash of the id.

    The ids are chosen from the labels alone and broadcast (2 x most rows); only their texts reach the driver, one
    text an id: of repeated ids the first by the text's order.
    """
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(divisor) != left_out))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = usable.filter("toxic = 1").orderBy(*order).limit(most).unionByName(
        usable.filter("toxic = 0").orderBy(*order).limit(most)
    )
    told = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = told.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    number = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows], (number.get(0, 0), number.get(1, 0)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text; null and empty texts are scored as texts without words."""
    source = docs.select("doc_id", text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = probability(model, batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Repeated rows each give a row; other columns are not read; an empty table gives an empty result.
    """
    return score(docs, learn(docs, labels)).select(
        "doc_id",
        (remainder(4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, all columns as they were; nothing is shuffled.

    Only the texts go to the Python workers, and only scores come back.
    """

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(probability(model, texts.tolist()))

    return docs.filter(scored(text_of(docs["text"])) < threshold)
