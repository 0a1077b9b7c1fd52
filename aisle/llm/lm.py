"""Language-model scores from a log-bilinear model trained in numpy by noise-contrastive estimation.

Tokens are words (A-Z in lower case) and one end per text. The model predicts a class of the next token from
the token before it: each of the FREQUENT most frequent words is a class of its own, the other words fall in
ENDINGS classes by their last letters, and inside such a class a word has its share of the class's training
count, with half a count for words never seen. Scores are therefore normalised over all words.

Everything the model learns from is counted over all training texts: token counts (shuffled by word, so they
grow with the corpus), sizes of the classes, and the table of class pairs, which is bounded by the number of
classes and is what the driver trains on. The expectation that noise-contrastive estimation samples is taken
exactly over that table. Rare words never have to fit in memory together: texts send them, packed by bucket,
to where their counts are, and get sums of logarithms back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisle.llm.bpe import batches_by_size
from aisle.llm.common import attach_groups, remainder, stored, text_of

FREQUENT = 767  # words with a class of their own, besides the end
ENDINGS = 256
DIMENSIONS = 32
NOISE = 20
ROUNDS = 300
LEAST_BUCKETS = 64
DOCS_PER_BUCKET = 4000
CHECK_EVERY = 10  # one training text in so many is kept to check the model
PRIOR = 20.0  # pairs by frequency that every context starts from
BLOCK = 16  # contexts whose counts travel together
BATCH_CHARS = 6_000_000  # texts of so many characters, or one longer text, are counted at a time
REMEMBERED = 250_000  # words whose keys a worker keeps
HELD_KEYS = 1_500_000  # distinct words of the batches that a worker adds up before it sends them
END = 0  # the key of the end; no word has it
_LOW = np.uint64(ENDINGS - 1)


class _WordKeys(dict):
    """64-bit keys of words, remembered: a hash whose last byte is the class of the word's ending."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > REMEMBERED:
            self.clear()
        ending = xxhash.xxh3_64_intdigest(word.rstrip(b".,;:!?")[-2:]) & (ENDINGS - 1)
        value = self[word] = (xxhash.xxh3_64_intdigest(word) | 1 << 63) & ~(ENDINGS - 1) | ending
        return value


def token_keys(texts: list[str], known: _WordKeys) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the tokens of all texts, one after another, and the number of tokens of each text."""
    cut = [text.encode("utf-8", "surrogatepass").lower().split() for text in texts]
    lengths = np.fromiter(map(len, cut), "i8", len(cut))
    words = np.fromiter(map(known.__getitem__, chain.from_iterable(cut)), "u8", int(lengths.sum()))
    return np.insert(words, np.cumsum(lengths), np.uint64(END)), lengths + 1


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys << np.uint64(1)) >> np.uint64(64 - bits)).astype("i4")


def _by_bucket(bits: int, keys: np.ndarray, *others: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    bucket = _bucket(keys, bits)
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
    arrays = [a[order] for a in (keys, *others)]
    for b in np.flatnonzero(np.diff(edge)):
        yield int(b), [a[edge[b] : edge[b + 1]] for a in arrays]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def token_counts(training: DataFrame, bits: int) -> DataFrame:
    """Count of every token: one row per bucket of keys, (bucket, keys, counts) as packed arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = _WordKeys(), [], 0

        def send() -> pa.RecordBatch:
            keys, counts = (np.concatenate(side) for side in zip(*held, strict=True))
            rows = [(b, k.tobytes(), c.tobytes()) for b, (k, c) in _by_bucket(bits, *_summed(keys, counts))]
            kinds = (pa.int32(), pa.binary(), pa.binary())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["bucket", "keys", "counts"])

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, end in batches_by_size(texts, BATCH_CHARS):
                keys, _ = token_keys(texts[start:end], known)
                held.append(np.unique(keys, return_counts=True))
                size += len(held[-1][0])
                if size > HELD_KEYS:
                    yield send()
                    held.clear()
                    size = 0
        if held:
            yield send()

    def merge(table: pa.Table) -> pa.Table:
        join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        keys, counts = _summed(join("keys", "<u8"), join("counts", "<i8"))
        return pa.table(
            {
                "bucket": table.column("bucket").slice(0, 1),
                "keys": pa.array([keys.tobytes()], pa.binary()),
                "counts": pa.array([counts.tobytes()], pa.binary()),
            }
        )

    kind = "bucket int, keys binary, counts binary"
    return training.select(text_of().alias("text")).mapInArrow(run, kind).groupBy("bucket").applyInArrow(merge, kind)


class Vocabulary(NamedTuple):
    keys: np.ndarray  # of the frequent tokens, ascending; the end is always among them
    counts: np.ndarray
    tokens: int  # N
    types: int  # V
    rare_mass: np.ndarray  # per ending class: counts of its rare words, half a count each, half for the unseen


def frequent_tokens(counts: DataFrame, most: int = FREQUENT) -> Vocabulary:
    """What is the same for every text: the frequent tokens and totals; bounded by ``most`` and ENDINGS."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                keys, number = np.frombuffer(k, "<u8"), np.frombuffer(c, "<i8")
                best = np.lexsort((keys, -number))[: most + 1]
                ending = (keys & _LOW).astype("i8")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.r_[keys[best].astype("i8"), np.arange(ENDINGS)]),
                        pa.array(np.r_[number[best], np.bincount(ending, number, ENDINGS).astype("i8")]),
                        pa.array(np.r_[np.full(len(best), -1), np.bincount(ending, minlength=ENDINGS)]),
                    ],
                    ["key", "number", "types"],
                )

    rows = stored(counts.mapInArrow(top, "key bigint, number bigint, types bigint"), "frequent-tokens")
    best = rows.filter("types < 0").orderBy(F.col("key") != END, F.desc("number"), "key").limit(most + 1).collect()
    totals = rows.filter("types >= 0").groupBy("key").agg(F.sum("number").alias("n"), F.sum("types").alias("t")).collect()
    held = {r["key"] % (1 << 64): r["number"] for r in best if r["key"] != END}
    held[END] = next((r["number"] for r in best if r["key"] == END), 0)
    keys = np.asarray(sorted(held), "u8")
    number = np.asarray([held[int(k)] for k in keys], "i8")
    mass, types = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in totals:
        mass[r["key"]], types[r["key"]] = r["n"], r["t"]
    n, v = int(mass.sum()), int(types.sum())
    ending = (keys & _LOW).astype("i8")
    seen = number > 0
    np.subtract.at(mass, ending, number)
    np.subtract.at(types, ending, seen.astype(float))
    return Vocabulary(keys, number, n, v, mass + 0.5 * (types + 1))


def classes_of(keys: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Class of each token, and whether it is a rare one."""
    place = np.minimum(np.searchsorted(vocabulary.keys, keys), len(vocabulary.keys) - 1)
    rare = vocabulary.keys[place] != keys
    return np.where(rare, len(vocabulary.keys) + (keys & _LOW).astype("i8"), place), rare


def _contexts(classes: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """Class before each token; a text starts after an end."""
    before = np.r_[end, classes[:-1]]
    before[np.r_[0, np.cumsum(lengths)[:-1]]] = end
    return before


def pair_counts(training: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """How often each class follows each class, over all training texts: a table of fixed size to learn from and
    one, of every CHECK_EVERYth text by its hash, to stop and weigh the model by."""
    size = len(vocabulary.keys) + ENDINGS
    end = int(np.searchsorted(vocabulary.keys, END))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = _WordKeys(), np.zeros(2 * size * size, "<i8")
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, stop in batches_by_size(texts, BATCH_CHARS):
                keys, lengths = token_keys(texts[start:stop], known)
                classes, _ = classes_of(keys, vocabulary)
                check = [zlib.crc32(t.encode("utf-8", "surrogatepass")) % CHECK_EVERY == 0 for t in texts[start:stop]]
                row = _contexts(classes, lengths, end) + size * np.repeat(np.asarray(check, int), lengths)
                np.add(table, np.bincount(row * size + classes, minlength=len(table)), out=table)
        cut = table.reshape(2 * size, size)
        blocks = [(i // BLOCK, cut[i : i + BLOCK]) for i in range(0, 2 * size, BLOCK) if cut[i : i + BLOCK].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([b for b, _ in blocks], pa.int32()), pa.array([x.tobytes() for _, x in blocks], pa.binary())], ["block", "counts"]
        )

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), "<i8") for x in table.column("counts"))
        return pa.table({"block": table.column("block").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    kind = "block int, counts binary"
    blocks = training.select(text_of().alias("text")).mapInArrow(run, kind).groupBy("block").applyInArrow(add, kind)
    counts = np.zeros((2 * size, size))
    for row in blocks.collect():  # 2 x size / BLOCK rows
        part = np.frombuffer(bytes(row["counts"]), "<i8").reshape(-1, size)
        counts[row["block"] * BLOCK : row["block"] * BLOCK + len(part)] = part
    return counts[:size], counts[size:]


class LogBilinear(NamedTuple):
    """score(context c, class w) = (contexts[c] @ mixing) . targets[w] + bias[w], normalised over classes, and mixed
    with the frequencies of the classes by ``share``."""

    contexts: np.ndarray
    mixing: np.ndarray
    targets: np.ndarray
    bias: np.ndarray
    share: float
    frequencies: np.ndarray

    def own(self) -> np.ndarray:
        """Probabilities of the bilinear part, for every context."""
        score = (self.contexts @ self.mixing) @ self.targets.T + self.bias
        score = np.exp(score - score.max(axis=1, keepdims=True))
        return score / score.sum(axis=1, keepdims=True)

    def log10_probabilities(self) -> np.ndarray:
        return np.log10(self.share * self.own() + (1 - self.share) * self.frequencies)


def train(
    counts: np.ndarray, check: np.ndarray | None = None, dimensions: int = DIMENSIONS, noise: int = NOISE, rounds: int = ROUNDS, seed: int = 0
) -> LogBilinear:
    """Noise-contrastive estimation with ``noise`` draws from the class frequencies per observed pair, in
    expectation over the table of pairs; Adam steps. Pairs of ``check`` decide when to stop and how much of the
    class frequencies to mix in, so that few texts are not learnt by heart."""
    check = counts if check is None or not check.any() else check
    size = len(counts)
    draw = np.random.default_rng(seed)
    q = (counts.sum(axis=0) + check.sum(axis=0) + 0.5) / (counts.sum() + check.sum() + 0.5 * size)
    spread = dimensions**-0.5
    values = [
        draw.normal(0, spread, (size, dimensions)).astype("f4"),
        (np.eye(dimensions) + draw.normal(0, 0.01, (dimensions, dimensions))).astype("f4"),
        draw.normal(0, 0.1 * spread, (size, dimensions)).astype("f4"),
        np.log(q).astype("f4"),
    ]
    if not counts.any():
        return LogBilinear(*values, 0.0, q)
    # each context starts from PRIOR pairs drawn by the frequencies, and weighs by the root of its pairs
    held = counts.sum(axis=1, keepdims=True)
    weight = np.where(held > 0, 1 / np.sqrt(np.maximum(held, 1)), 0)
    weight /= (counts * weight).sum()
    positive = ((counts + PRIOR * q) * weight * size).astype("f4")
    negative = (noise * (held + PRIOR) * weight * size * q).astype("f4")
    shift = np.log(noise * q).astype("f4")
    first = [np.zeros_like(v) for v in values]
    second = [np.zeros_like(v) for v in values]
    best, top = None, -np.inf
    shares = np.linspace(0, 0.98, 50)
    for step in range(1, rounds + 1):
        contexts, mixing, targets, bias = values
        predicted = contexts @ mixing
        score = predicted @ targets.T + bias - shift
        sure = 1 / (1 + np.exp(-score))
        grad = positive * (1 - sure) - negative * sure
        back = grad @ targets
        grads = [back @ mixing.T, contexts.T @ back, grad.T @ predicted, grad.sum(axis=0)]
        rate = 0.05 * (1 - step / (rounds + 1))
        for value, g, m, s in zip(values, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            value += rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        if step % 20 == 0 or step == rounds:
            model = LogBilinear(*[v.copy() for v in values], 1.0, q)
            seen = np.nonzero(check)
            own, times, common = model.own()[seen], check[seen], q[seen[1]]
            told = [(times * np.log(share * own + (1 - share) * common)).sum() for share in shares]
            if max(told) > top:
                best, top = model._replace(share=float(shares[int(np.argmax(told))])), max(told)
    return best


def _rare_requests(docs: DataFrame, vocabulary: Vocabulary, bits: int) -> DataFrame:
    """Rare words of each different text, packed by bucket: texts, how many words of each, words, times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known = _WordKeys()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, end in batches_by_size(texts, BATCH_CHARS):
                distinct = {xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")): t for t in texts[start:end]}
                keys, lengths = token_keys(list(distinct.values()), known)
                _, rare = classes_of(keys, vocabulary)
                owner = np.repeat(np.arange(len(lengths)), lengths)[rare]
                keys = keys[rare]
                order = np.lexsort((keys, owner))
                owner, keys = owner[order], keys[order]
                first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])]) if len(keys) else np.zeros(0, int)
                times = np.diff(np.r_[first, len(keys)]).astype("<u4")
                ids = np.fromiter(distinct, "u8", len(distinct))
                rows = []
                for b, (k, o, t) in _by_bucket(bits, keys[first], owner[first], times):
                    head = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
                    many = np.diff(np.r_[head, len(o)]).astype("<u4")
                    rows.append((b, ids[o[head]].tobytes(), many.tobytes(), k.tobytes(), t.tobytes()))
                if rows:
                    kinds = [pa.int32(), *[pa.binary()] * 4]
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["bucket", "texts", "many", "keys", "times"])

    kind = "bucket int, texts binary, many binary, keys binary, times binary"
    return docs.select(text_of().alias("text")).mapInArrow(run, kind)


def _rare_sums(requests: DataFrame, counts: DataFrame) -> DataFrame:
    """Per text: the sum of log10(c + 0.5) over its rare tokens and how many of them are known."""

    def answer(asked: pa.Table, counted: pa.Table) -> pa.Table:
        join = lambda table, name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        texts = np.repeat(join(asked, "texts", "<u8"), join(asked, "many", "<u4"))
        keys, times = join(asked, "keys", "<u8"), join(asked, "times", "<u4")
        order = np.lexsort((keys, texts))
        texts, keys, times = texts[order], keys[order], times[order].astype("f8")
        if len(keys):  # the same text may come from several batches
            fresh = np.r_[True, (keys[1:] != keys[:-1]) | (texts[1:] != texts[:-1])]
            texts, keys, times = texts[fresh], keys[fresh], times[fresh]
        words, number = join(counted, "keys", "<u8"), join(counted, "counts", "<i8")
        c = np.zeros(len(keys))
        if len(words) and len(keys):
            place = np.minimum(np.searchsorted(words, keys), len(words) - 1)
            c = np.where(words[place] == keys, number[place], 0)
        first = np.flatnonzero(np.r_[True, texts[1:] != texts[:-1]]) if len(texts) else np.zeros(0, int)
        add = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)
        return pa.table(
            {
                "text_key": pa.array(texts[first].astype("i8")),
                "logs": pa.array(add(times * np.log10(c + 0.5)), pa.float64()),
                "known": pa.array(add(times * (c > 0)).astype("i8")),
            }
        )

    kind = "text_key bigint, logs double, known bigint"
    both = requests.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(answer, kind)
    return both.groupBy("text_key").agg(F.sum("logs").alias("logs"), F.sum("known").alias("known"))


def _frequent_part(docs: DataFrame, vocabulary: Vocabulary, model: LogBilinear) -> DataFrame:
    """Per document what needs no rare counts: doc_id, held_out, text_key, n_tokens, n_common, common_logs, n_rare, own."""
    source = docs.select("doc_id", "held_out", text_of().alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    end = int(np.searchsorted(vocabulary.keys, END))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known, table = _WordKeys(), model.log10_probabilities()
        common = np.r_[np.log10(vocabulary.counts + 0.5), np.zeros(ENDINGS)]
        inside = np.r_[np.zeros(len(vocabulary.keys)), np.log10(vocabulary.rare_mass)]
        seen = np.r_[vocabulary.counts > 0, np.zeros(ENDINGS, bool)].astype("i8")
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, stop in batches_by_size(texts, BATCH_CHARS):
                part = texts[start:stop]
                keys, lengths = token_keys(part, known)
                classes, rare = classes_of(keys, vocabulary)
                first = np.r_[0, np.cumsum(lengths)[:-1]]
                own = table[_contexts(classes, lengths, end), classes] - inside[classes]
                text_key = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in part]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, stop - start),
                        batch.column("held_out").slice(start, stop - start),
                        pa.array(np.asarray(text_key, "u8").astype("i8")),
                        pa.array(lengths),
                        pa.array(np.add.reduceat(seen[classes], first)),
                        pa.array(np.add.reduceat(common[classes], first)),
                        pa.array(np.add.reduceat(rare.astype("i8"), first)),
                        pa.array(np.add.reduceat(own.astype("f8"), first)),
                    ],
                    ["doc_id", "held_out", "text_key", "n_tokens", "n_common", "common_logs", "n_rare", "own"],
                )

    return source.mapInArrow(
        run,
        f"doc_id {kind}, held_out boolean, text_key bigint, n_tokens bigint, n_common bigint, common_logs double, n_rare bigint, own double",
    )


def score(docs: DataFrame, divisor: int = 5, left_out: int = 1) -> DataFrame:
    """Scores of every whole text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts whose crc32(doc_id) modulo ``divisor`` is ``left_out`` are not learnt from. Null and empty texts
    consist of the end alone. Repeated rows are counted, and scored, each. Without training texts every token
    is unseen. Other columns are not read; an empty table gives an empty result.
    """
    split = docs.select("doc_id", "text", (remainder(divisor) == left_out).alias("held_out"))
    training = split.filter(~F.col("held_out"))
    wanted = max(LEAST_BUCKETS, min(1 << 20, docs.count() // DOCS_PER_BUCKET))
    bits = (wanted - 1).bit_length()
    counts = stored(token_counts(training, bits), "token-counts")
    vocabulary = frequent_tokens(counts)
    model = train(*pair_counts(training, vocabulary))
    part = stored(_frequent_part(split, vocabulary, model), "frequent-part")
    sums = _rare_sums(_rare_requests(split, vocabulary, bits), counts)
    copies = part.filter("n_rare > 0").groupBy("text_key").agg(F.count("*").alias("copies"))
    answers = stored(copies.join(sums, "text_key"), "rare-sums")
    rare = attach_groups(part.filter("n_rare > 0"), answers, "text_key", "copies", part.count())
    none = part.filter("n_rare = 0").withColumns({"copies": F.lit(1).cast("bigint"), "logs": F.lit(0.0), "known": F.lit(0).cast("bigint")})
    base = float(np.log10(vocabulary.tokens + 0.5 * (vocabulary.types + 1)))
    return rare.unionByName(none).select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_common") + F.col("known")).alias("n_known"),
        F.lit(vocabulary.tokens).cast("bigint").alias("train_tokens"),
        (F.col("common_logs") + F.col("logs") - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        (F.col("own") + F.col("logs")).alias("score"),
    )
