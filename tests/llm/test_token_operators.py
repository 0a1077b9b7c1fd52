"""SentencePiece encoding, token alignment and hard negatives against the libraries and plain versions."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from aisle.llm import alignment, negatives, pieces

tokenizers = pytest.importorskip("public_tokenizers")
BYTE_PATH, PIECE_PATH = tokenizers.path(alignment.BYTE_LEVEL), tokenizers.path(pieces.VOCABULARY)
ODD = [
    None, "", " ", "  two  spaces ", "\n\t x", "one", "one", "a" * 20_000, "=" * 5000, "-=" * 2000, "<s> </s> <unk> <0x41>", "<|endoftext|> x",
    "▁ literal ▁▁", "nul\x00 in", "😀 é 日本語 ﷺ ½ ﬁ ①", "it's we'll I'd", "line\n\nbreaks 　 wide", "x " * 3000,
]


def fuzzed(seed: int, many: int) -> list[str]:
    draw = random.Random(seed)
    parts = [*"ab cdeé ñ  \t\nßﬁ①½Ǻ▁　한글日本😀\x00\x01<s>0>…=-'", "<|endoftext|>", " the", "​", "ﷺ"]
    return ["".join(draw.choice(parts) for _ in range(draw.randrange(30))) for _ in range(many)]


def table(spark, texts):
    """Documents with columns whose names clash with those inside the operators."""
    rows = [(i, t, "w", 1, b"x", 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string, row int, pairs binary, n_a int").repartition(3)


def library(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def test_digests_are_those_of_the_library(spark):
    with open(PIECE_PATH, "rb") as file:
        plain = library(file.read())
    texts = [*ODD, *fuzzed(1, 200)]
    encoded = pieces.encode(table(spark, texts), PIECE_PATH)
    found = {r["doc_id"]: r for r in pieces.digests(pieces.decode(encoded, PIECE_PATH)).collect()}
    spans = {r["doc_id"]: r for r in encoded.collect()}
    for i, text in enumerate(texts):
        ids = plain.encode(text or "", add_bos=True, add_eos=True)
        assert found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256(plain.decode(ids).encode()).hexdigest()
        size = len((text or "").encode())
        assert (spans[i]["starts"][0], spans[i]["ends"][0]) == (0, 0) and (spans[i]["starts"][-1], spans[i]["ends"][-1]) == (size, size)
        assert spans[i]["starts"][2:-1] == spans[i]["ends"][1:-2]


@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("flags", [(True, False, True), (True, True, True), (False, True, True)])
def test_spans_are_the_librarys_under_any_character_map(rule, flags):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(PIECE_PATH, "rb") as file:
        model = pb.ModelProto.FromString(file.read())
    if rule != "identity":
        spec = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec()
        model.normalizer_spec.CopyFrom(pb.NormalizerSpec.FromString(spec))
        assert len(pieces.map_entries(model.normalizer_spec.precompiled_charsmap)) > 200_000
    spec = model.normalizer_spec
    spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = flags
    raw = model.SerializeToString()
    plain, encoder = library(raw), pieces.PieceEncoder(raw)
    texts = [text or "" for text in [*ODD, *fuzzed(2, 500)]]
    for text, (ids, edges) in zip(texts, encoder.encode_all(texts), strict=True):
        assert ids.tolist() == plain.encode(text, add_bos=True, add_eos=True)
        expected = [(p.begin, p.end) for p in plain.encode(text, return_type="proto").pieces]
        assert list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) == expected


def plain_agreement(texts: list[str | None]) -> list[tuple]:
    from tokenizers import Tokenizer

    a_tokens = Tokenizer.from_file(BYTE_PATH)
    a_tokens.encode_special_tokens = True
    with open(PIECE_PATH, "rb") as file:
        b_tokens = library(file.read())
    value = alignment._byte_values()
    docs = []
    for text in texts:
        docs.append(None)
        if not text:
            continue
        a, b = a_tokens.encode(" " + text, add_special_tokens=False).ids, b_tokens.encode(text)
        names = [b_tokens.id_to_piece(i) for i in b]
        parts_a = [bytes(value[c] for c in a_tokens.id_to_token(i)) for i in a]
        parts_b = [bytes([int(n[3:5], 16)]) if b_tokens.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(b, names, strict=True)]
        if not b"".join(parts_a) == b"".join(parts_b) == f" {text}".encode():
            continue
        ends_a, ends_b = np.cumsum([*map(len, parts_a)]).tolist(), np.cumsum([*map(len, parts_b)]).tolist()
        groups, start = [], 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            inside = lambda ids, ends: [i for i, e in zip(ids, ends, strict=True) if start < e <= cut]  # noqa: B023, E731
            groups.append((inside(a, ends_a), inside(b, ends_b)))
            start = cut
        docs[-1] = (len(a), len(b), groups)
    count: Counter = Counter()
    for doc in filter(None, docs):
        count.update({(x, y) for ga, gb in doc[2] for x in ga for y in gb})
    top: dict = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for doc in docs:
        if doc is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for ga, gb in doc[2] for x in ga for y in gb]
        shown = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in doc[2])
        best = sum(count[p] == top[p[0]] for p in links)
        out.append((doc[0], doc[1], len(doc[2]), len(links), best, sum(count[p] for p in links), hashlib.sha256(shown.encode()).hexdigest()))
    return out


def test_alignment_and_counts_are_those_of_plain_loops(spark):
    texts = [t if t is None else t[:600] for t in [*ODD, *fuzzed(3, 300)]]
    expected = plain_agreement(texts)
    for most_common in (alignment.MOST_COMMON, 100, 0):
        found = {r[0]: tuple(r)[1:] for r in alignment.agreement(table(spark, texts), BYTE_PATH, PIECE_PATH, most_common).collect()}
        assert [found[i] for i in range(len(texts))] == expected


def test_pointers_lead_to_the_last_token_of_each_group():
    ends_a, ends_b = np.array([2, 4, 7, 8, 12, 20]), np.array([1, 3, 5, 6, 8, 13, 19, 20])
    label_a, label_b = alignment.group_ends(ends_a, ends_b)
    assert label_a.tolist() == [3, 3, 3, 3, 5, 5] and label_b.tolist() == [3] * 5 + [5] * 3


def test_long_runs_are_linked_through_counted_ids(spark):
    found = alignment.agreement(table(spark, ["=-" * 30_000 + "x" * 40_001]), BYTE_PATH, PIECE_PATH).collect()[0]
    assert plain_agreement(["=-" * 30_000 + "x" * 40_001])[0] == tuple(found)[1:]


def test_empty_tables_give_empty_results(spark):
    nothing = table(spark, [None]).filter("doc_id < 0")
    assert pieces.digests(pieces.decode(pieces.encode(nothing, PIECE_PATH), PIECE_PATH)).collect() == []
    assert alignment.agreement(nothing, BYTE_PATH, PIECE_PATH).collect() == []


def plain_negatives(data: list[tuple]) -> list[tuple]:
    rows = [
        (i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
        for i, label, v, *_ in data
        if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for anchor, label, vector in rows:
        if anchor % 50:
            continue
        scored = sorted((-sum(map(int.__mul__, vector, v)), i, other) for i, other, v in rows)
        for score, positive, _ in [x for x in scored if x[2] == label and x[1] != anchor][:5]:
            fit = [x for x in scored if x[2] != label and 50 * -score <= 100 * -x[0] <= 95 * -score][:3]
            out += [(anchor, positive, rank + 1, i, -score, -s) for rank, (s, i, _) in enumerate(fit)]
    return sorted(out)


SCHEMA = "vec_id bigint, label int, embedding array<double>, block string, key int"


@pytest.mark.parametrize("kind", ["clusters", "one vector", "spread", "odd", "empty"])
def test_negatives_equal_all_pairs(spark, kind):
    draw = np.random.default_rng(4)
    centers = draw.normal(size=(9, 7)) * 2
    made = {
        "clusters": lambda: [(i, i % 4, (centers[i % 9] + draw.normal(size=7) * 0.2).tolist()) for i in range(600)],
        "one vector": lambda: [(i, i % 3, [1.0, 0.5, -0.25] if i % 3 else draw.normal(size=3).tolist()) for i in range(400)],
        "spread": lambda: [(i, i % 10, draw.normal(size=16).tolist()) for i in range(300)],
        "odd": lambda: [
            *[(i, i % 3, draw.normal(size=5).tolist()) for i in range(-60, 60)],
            (100, None, [1.0]), (150, 1, None), (200, 1, [1.0, float("nan")]), (250, 1, [None]), (None, 1, [1.0]), (300, 2, []),
            (350, 1, [float("-inf")]), (400, 2, [0.5, 0.5]), (450, 5, [1e12, -1e12, 3.0, 0.0, 0.0]), (0, 0, [0.3] * 5), (50, 2, [0.1] * 5),
        ],
        "empty": lambda: [],
    }
    data = [(*row, "b", 1) for row in made[kind]()]
    found = sorted(map(tuple, negatives.mine(spark.createDataFrame(data, SCHEMA).repartition(3), block_rows=50).collect()))
    assert found == plain_negatives(data)
    assert bool(found) == (kind != "empty")
