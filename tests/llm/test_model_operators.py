"""Tokenizers, packing, language model, toxicity and quality against libraries, plain versions and held-out rows."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from aisle.llm import bpe, lm, packing, quality, toxicity

tokenizers = pytest.importorskip("public_tokenizers")
WORD_PATH = tokenizers.path(packing.VOCABULARY)
BYTE_PATH = tokenizers.path(bpe.VOCABULARY)
DATA = Path("/root/testdata/sf0.01")
SCHEMA = "doc_id bigint, text string, ids string, length int, row string"
ODD = [
    None, "", "  a  b\n\n c", "I'm it's IT'S don't  x\x1c y\x85z \xa0q", "Σας ΟΔΟΣ ΣΣ İstanbul ﬁ ½ ² x²y 一二三 ́a é 　 end ",
    "<|endoftext|> a<|startoftext|>b", "a" * 3000, "!!!???...   \t\t\n", "ŉ ĸ ß ẞ ſ Ǆ ǅ", "🙂🙂 👨‍👩‍👧", " 12 345 6.7e-9 ٣٤", "word " * 5000, "word", "word",
]


def table(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", 1, "r") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def rows(df):
    return [r.asDict() for r in df.collect()]


def held_out(doc_id, divisor, left) -> bool:
    return zlib.crc32(str(doc_id).encode()) % divisor == left


def test_ids_are_those_of_the_reference_encoder_and_decode_to_the_text(spark):
    import tiktoken

    with open(BYTE_PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    plain = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe.encode(table(spark, ODD), BYTE_PATH, tokenizers.PATTERN)
    found = {r["doc_id"]: r for r in rows(bpe.digests(bpe.decode(encoded, BYTE_PATH, tokenizers.PATTERN)))}
    for i, text in enumerate(ODD):
        ids = plain.encode_ordinary(text or "")
        assert found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_pieces_are_the_library_ids_cut_at_the_capacity(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_PATH)
    texts = [*ODD, "one<|endoftext|>two <|startoftext|> Three", "<|endoftext|>", "é<|endoftext|>日本 <|endoftext"]
    found: dict[int, list] = {}
    for r in rows(packing.pieces(table(spark, texts), WORD_PATH)):
        found.setdefault(r["doc_id"], []).append(r)
    assert 49407 in library.encode(texts[-2], add_special_tokens=False).ids
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        cut = [ids[j : j + 2048] for j in range(0, len(ids), 2048)]
        mine = sorted(found[i], key=lambda r: r["piece"])
        assert [np.frombuffer(r["ids"], "<u4").tolist() for r in mine] == cut
        assert [(r["piece"], r["start"], r["length"]) for r in mine] == [(j, 2048 * j, len(c)) for j, c in enumerate(cut)]


def test_common_words_are_merged_once_however_many_rare_ones_pass_by():
    from tokenizers import Tokenizer

    merged = Counter()

    class Counted(packing.WordTokens):
        def _part(self, part):
            merged[part if isinstance(part, str) else part.decode()] += 1
            return super()._part(part)

    library, words = Tokenizer.from_file(WORD_PATH), Counted(WORD_PATH, remembered=40)
    common = [f"common{c}" for c in "abcdefghij"]
    for i in range(60):
        rare = ["".join(random.Random(100 * i + k).choices("abcdefghé", k=12)) + random.Random(k).choice(["", ".", "'s.", "7%"]) for k in range(15)]
        text = " ".join([*common, *rare, *common, "it's", "(IT'S)", "''s"])
        ids = np.frombuffer(words.encode([text])[0], "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
    assert {merged[word] for word in common} == {1}
    assert len(words.known) + len(words.known.before) < 250


def plain_best_fit(lengths, capacity):
    gaps = []
    for length in sorted(lengths, reverse=True):
        fitting = [g for g in gaps if g >= length]
        if fitting:
            gaps.remove(min(fitting))
            gaps.append(min(fitting) - length)
        else:
            gaps.append(capacity - length)
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_runs_pack_as_well_as_single_best_fit(seed):
    draw = random.Random(seed)
    lengths = [draw.choice([draw.randint(1, 100), draw.randint(1, 30), 50]) for _ in range(draw.choice([0, 1, 50, 800]))]
    moves = packing.matched_runs(Counter(lengths), 100)
    held: dict[int, list] = {}
    for m in moves:
        for turn in range(m.count):
            at = m.offset + turn % m.each * m.length
            held.setdefault(m.sequence + turn // m.each, []).append((at, m.length))
    assert sum(m.count for m in moves) == len(lengths)
    for spans in held.values():
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0
        assert spans[-1][0] + spans[-1][1] <= 100
    assert sorted(held) == list(range(len(held)))
    assert len(held) == plain_best_fit(lengths, 100)


def test_packed_sequences_have_no_gap_and_every_piece(spark):
    found = rows(packing.pack(table(spark, ODD * 3, [i % 20 for i in range(len(ODD) * 3)]), WORD_PATH))
    cut = packing.pieces(table(spark, ODD * 3, [i % 20 for i in range(len(ODD) * 3)]), WORD_PATH)
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in found) == Counter(
        (r["doc_id"], r["piece"], zlib.crc32(r["ids"])) for r in rows(cut)
    )
    sequences: dict[int, list] = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in sequences.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
        assert spans[-1][0] + spans[-1][1] <= packing.CAPACITY


def test_scores_match_plain_counts_and_the_model_beats_them(spark):
    draw = random.Random(1)
    tongues = [[f"{c}{i}{e}" for i in range(60)] for c, e in (("a", "ing"), ("b", "keit"))]
    texts = [" ".join(draw.choice(draw.choice(tongues) if k % 9 == 0 else tongues[k % 2]) for _ in range(40)) for k in range(200)]
    texts += [None, "", "The the THE unseen-word", texts[0], texts[0]]
    df = table(spark, texts)
    counts: Counter = Counter()
    words = lambda t: (t or "").lower().split() + [None]
    for i, t in enumerate(texts):
        if not held_out(i, 5, 1):
            counts.update(words(t))
    n, v = sum(counts.values()), len(counts)
    found = {r["doc_id"]: r for r in rows(lm.score(df))}
    for i, t in enumerate(texts):
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t))
        r = found[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held_out(i, 5, 1), len(words(t)), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in words(t))
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    out = [r for r in found.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_rare_words_get_the_same_sums_as_frequent_ones(spark, monkeypatch):
    texts = [f"common words here and word{i} word{i % 7}" for i in range(60)]
    full = {r["doc_id"]: r["base_score"] for r in rows(lm.score(table(spark, texts)))}
    frequent = lm.frequent_tokens
    monkeypatch.setattr(lm, "frequent_tokens", lambda counts: frequent(counts, 3))
    few = {r["doc_id"]: r["base_score"] for r in rows(lm.score(table(spark, texts)))}
    assert few == pytest.approx(full)


def test_probabilities_are_normalised():
    counts = np.random.default_rng(0).integers(0, 50, (40, 40)).astype(float)
    model = lm.train(counts, rounds=200)
    table = 10.0 ** model.log10_probabilities()
    assert np.allclose(table.sum(axis=1), 1, atol=1e-4)
    told = (counts * np.log(table)).sum()
    assert told > (counts * np.log(counts.sum(axis=0) / counts.sum())).sum()


def test_scores_without_training_texts(spark):
    ids = [i for i in range(100) if held_out(i, 5, 1)][:3]
    found = rows(lm.score(table(spark, ["some words", None, "x"], ids)))
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 and math.isfinite(r["score"]) for r in found)


def labelled(spark, count=400):
    draw = random.Random(2)
    plain = [f"{a}{b}{c}" for a in ("st", "er", "in", "an") for b in ("the", "ou", "ed", "re") for c in ("ly", "nd", "on", "")]
    bad = ["idiotic", "worthless", "pathetic"]
    texts, labels = [], []
    for i in range(count):
        words = [draw.choice(plain) for _ in range(draw.randint(20, 120))]
        toxic = i % 5 == 0
        poor = i % 4 == 0
        if toxic:
            for _ in range(3):
                words[draw.randrange(len(words))] = draw.choice(bad)
        if poor:
            words = [w for w in words for _ in range(3)]
        texts.append(" ".join(words))
        labels.append((i, int(not poor), int(toxic)))
    return table(spark, texts), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), labels


def test_toxicity_on_held_out_rows_and_label_independence(spark):
    docs, labels, told = labelled(spark)
    found = {r["doc_id"]: r for r in rows(toxicity.classify(docs, labels))}
    out = [(found[i]["predicted"], toxic) for i, _, toxic in told if found[i]["held_out"]]
    assert sum(p == t for p, t in out) / len(out) > 0.9
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in rows(toxicity.classify(docs, turned))}
    assert again == {i: r["score"] for i, r in found.items()}


def test_toxicity_takes_its_prose_from_whole_texts():
    pieces = [f"piece{i:05d}".encode() for i in range(2000)]
    held = toxicity.by_hash(iter(pieces * 2), 3000).split(b" ")
    assert held == sorted(set(pieces), key=lambda p: (zlib.crc32(p), p))[: len(held)] and len(held) == 3000 // 11
    depth = sorted(int(p[5:]) for p in held)
    assert depth[0] < 200 and depth[-1] > 1800  # from all over, not the openings


def test_toxicity_reads_one_text_of_a_repeated_id(spark):
    docs, labels, _ = labelled(spark)
    one = toxicity.learn(docs, labels)
    many = toxicity.learn(docs.unionByName(docs), labels)
    assert one.toxic == many.toxic and one.ordinary == many.ordinary and np.array_equal(one.weights, many.weights)


def test_toxicity_defines_null_empty_and_missing_labels(spark):
    docs, labels, _ = labelled(spark, 120)
    odd = table(spark, [None, "", "  "], [1000, 1001, None])
    model = toxicity.learn(docs, labels)
    found = [r["score"] for r in rows(toxicity.score(odd, model))]
    assert len(set(found)) == 1 and 0 <= found[0] <= 1
    none = toxicity.classify(docs, labels.limit(0)).select("score").distinct().collect()
    assert len(none) == 1 and 0 <= none[0][0] <= 1
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and 60 < kept.count() < 120


def test_quality_on_held_out_rows(spark):
    docs, labels, told = labelled(spark)
    few = labels.filter("doc_id % 3 < 2 or doc_id > 300")
    found = {r["doc_id"]: r for r in rows(quality.classify(docs, few))}
    out = [(found[i]["predicted"], good) for i, good, _ in told if found[i]["held_out"]]
    assert sum(p == g for p, g in out) / len(out) > 0.9
    assert len(rows(quality.classify(docs, labels.limit(0)))) == len(told)


def plain_co_training(seen, labels, count):
    """The same rounds over plain matrices: ``seen`` has both views, ``labels`` the quality by row, None or 'out'."""
    given = np.asarray([labels.get(i, -1) for i in range(count)], float)
    center, scale = [x.mean(axis=0) for x in seen], [x.std(axis=0) + 1e-3 for x in seen]
    xs = [np.c_[np.clip((x - c) / s, -8, 8), np.ones(count)] for x, c, s in zip(seen, center, scale, strict=True)]

    def step(x, w, y, weight):
        p = 1 / (1 + np.exp(-(x @ w)))
        keep = np.r_[np.ones(len(w) - 1), 1e-6]
        hessian = sum(h * np.outer(r, r) for r, h in zip(x, weight * p * (1 - p), strict=True)) + np.diag(keep + 1e-9)
        move = np.linalg.solve(hessian, x.T @ (weight * (p - y)) + keep * w)
        return w - move / max(1, np.linalg.norm(move) / 2)

    ws = [np.zeros(x.shape[1]) for x in xs]
    for _ in range(quality.FIRST_STEPS):
        ws = [step(x, w, np.maximum(given, 0), given >= 0) for x, w in zip(xs, ws, strict=True)]
    share, open_, told = given[given >= 0].mean(), (given == -1).sum(), (given >= 0).sum()
    for turn in range(1, quality.ROUNDS + 1):
        wanted, guesses = quality.PER_ROUND * turn * open_, []
        for x, w in zip(xs, ws, strict=True):
            logit = np.clip(x @ w, -30, 30)
            low = next((e / 32 for e in range(-959, 0) if (logit[given == -1] <= e / 32).sum() >= wanted * (1 - share)), 0)
            high = next((e / 32 for e in range(959, 0, -1) if (logit[given == -1] >= e / 32).sum() >= wanted * share), 0)
            budget, heavy = quality.TAUGHT * turn / quality.ROUNDS * told, np.zeros(count)
            sides = [((given == -1) & (logit <= low) & (logit < 0), 1 - share), ((given == -1) & (logit >= high) & (logit >= 0), share)]
            if all(side.any() for side, _ in sides):
                for side, part in sides:
                    heavy[side] = budget * part / side.sum() * min(1, wanted * part / side.sum())
            guesses.append((logit >= high, heavy))
        for _ in range(quality.STEPS):
            new = []
            for v in (0, 1):
                guess, heavy = guesses[1 - v]
                new.append(step(xs[v], ws[v], np.where(given >= 0, given, guess), np.where(given >= 0, 1, heavy)))
            ws = new
    return ws, xs


def test_quality_rounds_match_plain_matrices(spark):
    docs, _, told = labelled(spark, 240)
    docs = docs.withColumns({"source": F.concat(F.lit("s"), F.col("doc_id") % 4), "n_chars": F.length("text")}).drop("length")
    few = spark.createDataFrame([(i, q) for i, q, _ in told if i % 3], "doc_id bigint, quality int")
    rows_ = quality.with_labels(quality.with_features(docs), few, 4, 2).persist()
    model = quality.co_train(rows_)
    held = rows_.toArrow().to_batches()
    seen = [np.concatenate([quality.views_of(b)[v] for b in held if b.num_rows]) for v in (0, 1)]
    parts = [(r["part"], r["quality"]) for b in held for r in b.to_pylist()]
    labels = {i: {"fit": q, "free": -1}.get(part, -2) for i, (part, q) in enumerate(parts)}
    assert Counter(p for p, _ in parts)["free"] == 80 and {p for p, _ in parts} == {"fit", "join", "free", "out"}
    ws, xs = plain_co_training(seen, labels, len(parts))
    for view, w, x in zip((model.text, model.page), ws, xs, strict=True):
        assert np.allclose(view.weights, w, atol=1e-6) and np.allclose(x @ w, x @ view.weights, atol=1e-5)


def test_quality_finds_the_rare_kind(spark):
    docs, labels, told = labelled(spark)
    found = {r["doc_id"]: r for r in rows(quality.classify(docs, labels.filter("doc_id % 3 < 2 or doc_id > 300")))}
    out = [(found[i]["score"], found[i]["predicted"], good) for i, good, _ in told if found[i]["held_out"]]
    poor = [s for s, _, good in out if not good]
    fine = [s for s, _, good in out if good]
    area = sum((p < f) + 0.5 * (p == f) for p in poor for f in fine) / (len(poor) * len(fine))
    caught = [good for _, p, good in out if p == 0]
    assert area > 0.95 and caught.count(0) / len(poor) > 0.85 and caught.count(0) / len(caught) > 0.85


def test_quality_defines_odd_rows(spark):
    docs, labels, _ = labelled(spark, 120)
    odd = docs.withColumn("n_chars", F.when(F.col("doc_id") % 2 == 0, "many").otherwise("12")).withColumn("quality", F.lit("x")).withColumn("part", F.lit(1))
    more = odd.unionByName(odd.limit(3)).unionByName(odd.limit(2).withColumn("doc_id", F.lit(None).cast("bigint")).withColumn("text", F.lit(None).cast("string")))
    found = rows(quality.classify(more, labels.unionByName(labels).unionByName(labels.limit(1).withColumn("doc_id", F.lit(None).cast("bigint")))))
    assert len(found) == 125 and all(0 <= r["score"] <= 1 for r in found)
    assert len({r["text_score"] for r in found if r["doc_id"] is None}) == 1  # their pages differ
    assert quality.classify(docs.limit(0), labels).collect() == []
    none = {r["score"] for r in rows(quality.classify(docs, labels.filter("quality = 1")))}
    assert none == {1.0}


def test_quality_never_sends_all_labels_to_the_driver(spark, tmp_path):
    docs = [(i, i) for i in range(200)] + [(7, 200), (7, 201), (None, 202)]
    given = [(i, q) for i in range(0, 200, 2) for q in (0, i % 4 // 2)] + [(5, 3), (6, None), (None, 1)]
    spark.createDataFrame(given, "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels"))
    labels = spark.read.parquet(str(tmp_path / "labels"))  # files so small that the planner would broadcast them
    held = quality.with_labels(spark.createDataFrame(docs, "doc_id bigint, row int"), labels, 4, 2)
    found = {r["row"]: (r["quality"], r["part"]) for r in rows(held)}
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert len(found) == len(docs)
    for i, row in docs:
        if i is None or i % 2 and i != 5:
            assert found[row] == (None, "free")
        elif i == 5 or held_out(i, 4, 2):
            assert found[row] == (None, "out")
        else:
            assert found[row][0] == i % 4 // 2 and found[row][1] in ("fit", "join")


@pytest.mark.skipif(not DATA.is_dir(), reason="the documents are not here")
def test_classifiers_on_the_given_documents(spark):
    docs, labels = (spark.read.parquet(str(DATA / f"{name}.parquet")) for name in ("documents", "labels"))
    told = {r["doc_id"]: r for r in labels.collect()}
    for run, name, least in ((toxicity.classify, "toxic", 0.9), (quality.classify, "quality", 0.9)):
        out = [r for r in rows(run(docs, labels)) if r["held_out"] and r["doc_id"] in told]
        assert sum(r["predicted"] == told[r["doc_id"]][name] for r in out) / len(out) >= least


@pytest.mark.parametrize("run", [lambda d: packing.pack(d, WORD_PATH), lm.score, lambda d: bpe.encode(d, BYTE_PATH, tokenizers.PATTERN)])
def test_empty_tables_give_empty_results(spark, run):
    assert run(table(spark, [])).collect() == []
