"""Quality by co-training: a text view and a metadata view teach each other, then score all documents together.

Each view is a logistic model of its own features. In every round each view scores all documents without a label,
those it is surest of, good and poor in the proportion of the labels, become pseudo-labels of the other view, and
the other view learns from them as well. Nothing is sampled: a fit adds up gradients and Hessians inside the tasks,
and what a view is sure of is a cut of its logits, found from a histogram over all documents. At last both views are
weighed against each other on labelled documents that neither learnt from.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisle.llm.common import remainder, stored, text_of

ROUNDS = 4
PER_ROUND = 0.06  # of all documents without a label: by so much the part that a view names grows in a round
TAUGHT = 0.25  # weight of all pseudo-labels in the last round, as a part of the weight of all labels
FIRST_STEPS, STEPS = 6, 2  # Newton steps of the first fit, and of a round, which starts from the last weights
BINS = 1920  # of the histogram of logits between -LIMIT and LIMIT
LIMIT = 30.0
RIDGE = 1.0
REACH = 2.0  # longest Newton step
SPREAD = 8.0  # standard deviations beyond which a figure of a text counts no more
GROUPS = 16  # tasks that add up what the tasks of a step found
SALTS = 16  # parts of the rows of one id when labels are joined
SHAPES = 16  # figures of a text
SOURCES, LANGUAGES = 64, 16  # hashed one-hot columns
THRESHOLD = 0.5


def text_features(text: str) -> list[float]:
    """Shape of a whole text: repetition, signs, lengths of words and lines."""
    words = text.split()
    lines = [line for line in text.split("\n") if line.strip()]
    n, m, k = max(1, len(text)), max(1, len(words)), max(1, len(lines))
    letters = sum(map(str.isalpha, text)) / n
    spaces = text.count(" ") / n
    common = Counter(words).most_common(3)
    repeated = sum(a == b for a, b in zip(words, words[1:], strict=False)) / m
    squeezed = len(zlib.compress(text.encode("utf-8", "surrogatepass"), 1)) / max(1, len(text.encode("utf-8", "surrogatepass")))
    rows = [
        letters,
        spaces,
        1 - letters - spaces,
        len(set(words)) / m,
        common[0][1] / m if common else 0.0,
        sum(c for _, c in common) / m,
        repeated,
        len(set(lines)) / k,
        min(sum(map(len, words)) / m, 40) / 10,
        math.log1p(m / k),
        math.log1p(m),
        squeezed,
        sum(map(str.isdigit, text)) / n,
        sum(map(str.isupper, text)) / n,
        (text.count("|") + text.count("#") + text.count("$") + text.count("%") + text.count("&") + text.count("*")) / n,
        text.count(".") / m,
    ]
    return rows


def hashed(value: str | None, slots: int) -> int:
    return zlib.crc32((value or "").encode("utf-8", "surrogatepass")) % slots


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id and what both views see of a document. Columns source, lang and n_chars may be missing or null."""

    def given(name: str, kind: str):
        return (F.col(name).try_cast(kind) if name in docs.columns else F.lit(None).cast(kind)).alias(name)

    source = docs.select("doc_id", text_of().alias("text"), given("source", "string"), given("lang", "string"), given("n_chars", "bigint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [
                pa.array([hashed(v, n) for v in batch.column(c).to_pylist()], pa.int32())
                for c, n in (("source", SOURCES), ("lang", LANGUAGES))
            ]
            shape = pa.array([text_features(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), shape, *slots, batch.column("n_chars")],
                ["doc_id", "shape", "source_slot", "lang_slot", "n_chars"],
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, shape array<float>, source_slot int, lang_slot int, n_chars bigint")


def views_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Feature matrices of the text view and of the page view."""
    n = batch.num_rows
    shape = np.asarray(batch.column("shape").flatten(), float).reshape(n, -1)
    page = np.zeros((n, SOURCES + LANGUAGES + 3))
    page[np.arange(n), np.asarray(batch.column("source_slot"))] = 1
    page[np.arange(n), SOURCES + np.asarray(batch.column("lang_slot"))] = 1
    unknown = np.asarray(batch.column("n_chars").is_null())
    size = np.log1p(np.maximum(0, np.asarray(batch.column("n_chars").fill_null(0), float)))
    page[:, -3:] = np.stack([size, size * size / 10, unknown], axis=1)
    return np.concatenate([shape, shape * shape], axis=1), page


def with_labels(rows: DataFrame, labels: DataFrame, divisor: int, left_out: int) -> DataFrame:
    """``rows`` with ``quality`` (null without a usable label) and ``part``: 'fit', 'join', 'free' or 'out'.

    Of several labels of one id the larger counts. Labels of the held-out remainder and others than 0 and 1 are not
    used, and their documents teach nothing. A quarter of the labelled ids is kept for joining the views.
    """
    usable = F.col("quality").isin(0, 1) & (remainder(divisor) != left_out)
    told = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.when(usable, F.col("quality").cast("int"))).alias("quality"))
    # merged at every size: from packed files and without the salts the planner takes this for small, and the driver would broadcast it
    told = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("told", F.lit(True)).hint("merge")
    # a null id has no label; given a value by task it does not gather all rows without an id in one
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    named = salted.filter("doc_id IS NOT NULL").join(told, ["doc_id", "salt"], "left")
    bare = salted.filter("doc_id IS NULL").withColumns({"quality": F.lit(None).cast("int"), "told": F.lit(None).cast("boolean")})
    part = (
        F.when(F.col("told").isNull(), "free")
        .when(F.col("quality").isNull(), "out")
        .when(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 3, "join")
        .otherwise("fit")
    )
    return named.unionByName(bare).withColumn("part", part).drop("salt", "told", "doc_id")


Sums = Callable[[pa.RecordBatch], np.ndarray]


def total(rows: DataFrame, sums: Sums, size: int) -> np.ndarray:
    """Sum over all rows of a vector that ``sums`` gives for a batch.

    One vector leaves a task, GROUPS at most reach the driver. All are added in the order of their tasks, so the same
    stored rows give the same sum to the last bit.
    """
    blob = "part int, value binary"

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                value += sums(batch)
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "value": [value.tobytes()]})

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted((p, v) for b in batches for p, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        if held:
            value = np.sum([np.frombuffer(v) for _, v in held], axis=0)
            yield pa.RecordBatch.from_pydict({"part": pa.array([held[0][0]], pa.int32()), "value": [value.tobytes()]})

    each = rows.mapInArrow(inside, blob)
    found = sorted((r["part"], bytes(r["value"])) for r in each.repartition(GROUPS, "part").mapInArrow(across, blob).collect())
    return np.sum([np.frombuffer(v) for _, v in found], axis=0) if found else np.zeros(size)


class View(NamedTuple):
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.c_[np.clip((x - self.center) / self.scale, -SPREAD, SPREAD), np.ones(len(x))]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.standard(x) @ self.weights, -LIMIT, LIMIT)


class Cut(NamedTuple):
    """The logits at or below ``low`` and at or above ``high`` name a document poor or good."""

    low: float
    high: float
    poor: float  # weight of each document named poor
    good: float

    def named(self, logit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Quality and weight that a document gets as a pseudo-label; weight 0 names nothing."""
        good = logit >= self.high
        return good.astype(float), np.where(good, self.good, np.where(logit <= self.low, self.poor, 0.0))


def sure(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -LIMIT, LIMIT)))


def slope(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient and Hessian of the weighted logistic loss of some rows, in one vector."""
    p = sure(x @ w)
    return np.r_[x.T @ (weight * (p - y)), ((x * (weight * p * (1 - p))[:, None]).T @ x).ravel()]


def newton(w: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The weights after one step, at most REACH long, with a ridge on all but the constant."""
    keep = np.full(len(w), RIDGE)
    keep[-1] = 1e-6
    gradient, hessian = sums[: len(w)] + keep * w, sums[len(w) :].reshape(len(w), len(w))
    step = np.linalg.solve(hessian + np.diag(keep) + 1e-9 * np.eye(len(w)), gradient)
    return w - step * min(1.0, REACH / max(REACH, float(np.linalg.norm(step))))


def cut(histogram: np.ndarray, wanted: float, share: float, budget: float) -> Cut:
    """Whole bins from either end with at least ``wanted`` documents, by ``share`` good ones, or all that lean there.

    Documents named good and poor weigh ``budget`` in that proportion, and so much less as ties make them more than
    wanted. A view that leans to one side alone tells nothing apart and names nothing.
    """
    edges = np.linspace(-LIMIT, LIMIT, BINS + 1)
    middle = BINS // 2
    places, weights = [], []
    for side, part in ((histogram[:middle], 1 - share), (histogram[: middle - 1 : -1], share)):
        many = np.cumsum(side)
        place = min(int(np.searchsorted(many, wanted * part)), middle - 1)
        places.append(place)
        weights.append(budget * part / many[place] * min(1.0, wanted * part / many[place]) if many[place] else 0.0)
    if not all(weights):
        weights = [0.0, 0.0]
    return Cut(edges[places[0] + 1], edges[BINS - places[1] - 1], *weights)


def bins(logit: np.ndarray) -> np.ndarray:
    """Histogram whose bins hold the logits that :class:`Cut` tells apart by their edges."""
    edges = np.linspace(-LIMIT, LIMIT, BINS + 1)
    middle = edges[BINS // 2]
    # poor bins are closed above, good bins below, as are the cuts
    place = np.where(logit < middle, np.searchsorted(edges, logit, side="left") - 1, np.searchsorted(edges, logit, side="right") - 1)
    return np.bincount(np.clip(place, 0, BINS - 1), minlength=BINS).astype(float)


class Model(NamedTuple):
    text: View
    page: View
    join: np.ndarray  # weights of both logits and a constant

    def scores(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.logit(text), self.page.logit(page)
        return sure(a), sure(b), sure(a * self.join[0] + b * self.join[1] + self.join[2])


def co_train(rows: DataFrame, rounds: int = ROUNDS) -> Model | float:
    """Fit both views on the labels and on each other's sure guesses, and join them on the labels kept aside.

    ``rows`` are read once a step and must not change between. Without both qualities among the labels to fit the
    share of good ones is returned instead.
    """
    widths = 2 * SHAPES, SOURCES + LANGUAGES + 3
    fit, free, kept = (rows.filter(F.col("part") == part) for part in ("fit", "free", "join"))
    number = {(r["part"], r["quality"]): r["count"] for r in rows.groupBy("part", "quality").count().collect()}
    poor, good = number.get(("fit", 0), 0), number.get(("fit", 1), 0)
    if not poor or not good:
        labelled = {q: sum(n for (_, k), n in number.items() if k == q) for q in (0, 1)}
        return labelled[1] / max(1, sum(labelled.values()))

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = np.concatenate(views_of(batch), axis=1)
        return np.r_[len(x), x.sum(axis=0), (x * x).sum(axis=0)]

    n, *rest = total(rows, moments, 2 * sum(widths) + 1)
    mean, square = np.asarray(rest).reshape(2, -1) / n
    scale = np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-3
    at = slice(None, widths[0]), slice(widths[0], None)
    views = [View(mean[s], scale[s], np.zeros(w + 1)) for s, w in zip(at, widths, strict=True)]
    sizes = [(w + 1) * (w + 2) for w in widths]

    def step(views: list[View], teachers: list[View], cuts: list[Cut] | None) -> list[View]:
        """One Newton step of both views. With cuts, each learns from what the other teacher names as well."""

        def sums(batch: pa.RecordBatch) -> np.ndarray:
            seen = views_of(batch)
            quality = np.asarray(batch.column("quality").fill_null(-1), float)
            found = []
            for v in (0, 1):
                y, weight = np.maximum(quality, 0), (quality >= 0).astype(float)
                if cuts is not None:
                    guess, heavy = cuts[1 - v].named(teachers[1 - v].logit(seen[1 - v]))
                    y, weight = np.where(quality < 0, guess, y), np.where(quality < 0, heavy, weight)
                found.append(slope(views[v].standard(seen[v]), y, weight, views[v].weights))
            return np.concatenate(found)

        told = total(fit if cuts is None else rows.filter(F.col("part").isin("fit", "free")), sums, sum(sizes))
        return [view._replace(weights=newton(view.weights, part)) for view, part in zip(views, np.split(told, sizes[:1]), strict=True)]

    def histograms(batch: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([bins(view.logit(x)) for view, x in zip(views, views_of(batch), strict=True)])

    for _ in range(FIRST_STEPS):
        views = step(views, views, None)
    open_ = number.get(("free", None), 0)
    for turn in range(1, rounds + 1 if open_ else 0):
        found = np.split(total(free, histograms, 2 * BINS), 2)
        budget = TAUGHT * turn / rounds * (poor + good)
        cuts = [cut(h, PER_ROUND * turn * open_, good / (poor + good), budget) for h in found]
        teachers = views
        for _ in range(STEPS):
            views = step(views, teachers, cuts)

    join = np.asarray([0.5, 0.5, 0.0])
    if number.get(("join", 0)) and number.get(("join", 1)):

        def joined(batch: pa.RecordBatch) -> np.ndarray:
            x = np.stack([view.logit(v) for view, v in zip(views, views_of(batch), strict=True)], axis=1)
            y = np.asarray(batch.column("quality"), float)
            return slope(np.c_[x, np.ones(len(x))], y, np.ones(len(x)), join)

        for _ in range(FIRST_STEPS):
            join = newton(join, total(kept, joined, 12))
    return Model(*views, join)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, text_score, page_score, score, predicted (1 is good quality).

    Whole texts are read, once; null counts as empty. Repeated rows each teach and give a row; further columns are
    not read, and values of n_chars that are no numbers count as null; an empty table gives an empty result.
    """
    rows = stored(with_features(docs), "quality-features")
    model = co_train(stored(with_labels(rows, labels, 4, 2), "quality-labelled"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [np.full(batch.num_rows, model)] * 3 if isinstance(model, float) else model.scores(*views_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, found)], ["doc_id", "text_score", "page_score", "score"])

    scored = rows.mapInArrow(run, f"doc_id {kind}, text_score double, page_score double, score double")
    return scored.select(
        "doc_id",
        (remainder(4) == 2).alias("held_out"),
        "text_score",
        "page_score",
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
