"""Fingerprints, exact and near duplicates, licenses and personal data against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import re

import pytest
from pyspark.sql import functions as F

from aisle.llm import components, exact_dedup, fingerprints, licenses, ngram_join, pii

SCHEMA = "doc_id bigint, text string, word string, bits bigint, row string"
PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls read long books under a bright moon near the old mill"
ODD = [None, "", "   \n\t", "one", "one", "short text", "a" * 5000, "x " * 3000, PROSE, PROSE.upper(), PROSE.replace(" ", "  "), "🙂 ünï ßtraße 日本語"]


def table(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "w", 1, "r") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def edited(text: str, at: int) -> str:
    words = text.split()
    words[at] = f"changed{at}"
    return " ".join(words)


@pytest.fixture(scope="module")
def mixed(spark):
    long = " ".join(f"{w}{i}" for i in range(8) for w in PROSE.split())
    texts = [*ODD, long, edited(long, 3), edited(edited(long, 3), 90), edited(edited(long, 150), 60), long + " tail of it"]
    ids = [*range(100, 100 + len(texts)), 7, 7, 8, None, None]
    return table(spark, [*texts, PROSE, PROSE, long, long, "null id"], ids)


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_exact_groups_match_a_plain_grouping(mixed):
    groups: dict[str, list] = {}
    for r in rows(mixed):
        text = re.sub(r"[ \t-\r]+", " ", r["text"] or "")
        groups.setdefault(hashlib.sha256(text.encode()).hexdigest(), []).append(r["doc_id"])
    found = rows(exact_dedup.exact_groups(mixed))
    assert len(found) == mixed.count()
    for r in found:
        ids = groups[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == min((i for i in ids if i is not None), default=None)
    kept = [r["text_sha256"] for r in found if r["kept"]]
    assert sorted(kept) == sorted(groups)


def test_a_full_filter_changes_no_result(mixed, monkeypatch):
    before = sorted(map(repr, rows(exact_dedup.exact_groups(mixed))))
    monkeypatch.setattr(exact_dedup, "filter_words", lambda rows: 1)
    assert sorted(map(repr, rows(exact_dedup.exact_groups(mixed)))) == before


def test_keep_first_keeps_whole_rows_and_columns(mixed):
    kept = exact_dedup.keep_first(mixed)
    assert kept.columns == mixed.columns
    expected = {r["text_sha256"]: r["keep_id"] for r in rows(exact_dedup.exact_groups(mixed))}
    found = kept.select("doc_id", exact_dedup.text_hash(F.coalesce("text", F.lit(""))).alias("h")).collect()
    assert {r["h"]: r["doc_id"] for r in found} == expected and len(found) == len(expected)


def plain_tokens(text: str) -> list[str]:
    return [run[i : i + fingerprints.PIECE] for run in re.findall(r"[^ \t-\r]+", text) for i in range(0, len(run), fingerprints.PIECE)]


def spark_hash64(words: list[str]) -> int:
    import xxhash

    value = 42
    for w in words:
        value = xxhash.xxh64_intdigest(w.encode(), seed=value)
    return value - (1 << 64) if value >> 63 else value


def test_anchors_are_the_closed_syncmers(spark):
    texts = [t for t in ODD if t] + [" ".join(f"w{i * i % 37}" for i in range(200))]
    df = table(spark, texts).select("text", fingerprints.anchors(F.col("text")).alias("a"))
    k, s = fingerprints.K, fingerprints.S
    for r in df.collect():
        tokens = plain_tokens(r["text"])
        at = [x["at"] for x in r["a"]]
        if len(tokens) < k:
            assert at == ([0] if tokens else [])
            continue
        inner = [spark_hash64(tokens[i : i + s]) for i in range(len(tokens) - s + 1)]
        expected = []
        for i in range(len(tokens) - k + 1):
            window = inner[i : i + k - s + 1]
            if min(window) in (window[0], window[-1]):
                expected.append(i)
        assert at == expected


def test_edited_fingerprints_follow_the_descending_order(spark):
    texts = {5: "a b c d e f g h i j", 9: None, 2: "zwölf Boxkämpfer jagen Viktor", 7: "x" * 50, 4: "a b c d e f g h i j", None: "last one"}
    df = table(spark, list(texts.values()), list(texts))
    order = [9, 7, 5, 4, 2, None]
    found = {r["doc_id"]: r for r in rows(fingerprints.edited_fingerprints(df))}
    assert len(found) == len(texts)
    for here, following in zip(order, order[1:] + order[:1], strict=True):
        text, after = texts[here] or "", texts[following] or ""
        cut = len(text) // 3
        expected = text[: len(text) - cut] + after[:cut]
        assert found[here]["n_chars"] == len(text)
        assert found[here]["edited_sha256"] == hashlib.sha256(expected.encode()).hexdigest()
        assert 0 <= found[here]["near_edited"] <= 1 and 0 <= found[here]["near_next"] <= 1
    assert found[5]["fingerprint"] == found[4]["fingerprint"] and found[5]["near_next"] == 1.0


def test_repeated_rows_and_single_documents_have_a_next(spark):
    found = rows(fingerprints.edited_fingerprints(table(spark, ["same text here", "same text here", "other"], [3, 3, 3])))
    assert len(found) == 3
    alone = rows(fingerprints.edited_fingerprints(table(spark, ["only one text"])))
    assert alone[0]["near_next"] == 1.0 and alone[0]["edited_sha256"] == hashlib.sha256(b"only one only").hexdigest()


def test_moved_passages_keep_their_links_and_shuffled_words_do_not(spark):
    words = [f"w{i}" for i in range(600)]
    moved = [*words[300:], *words[:300]]
    blocks = [words[i : i + 6] for i in range(0, 600, 6)]
    shuffled = [w for block in blocks[::-1] for w in block]
    gaps = [w for block in blocks for w in (*block, f"new{block[0]}")]
    for other, least, most in ((moved, 0.95, 0.9999), (shuffled, 0.0, 0.6), (gaps, 0.0, 0.6)):
        found = {r["doc_id"]: r for r in rows(fingerprints.edited_fingerprints(table(spark, [" ".join(words), " ".join(other)], [2, 1])))}
        assert least <= found[2]["near_next"] <= most, (other[:8], found[2]["near_next"])


def test_long_texts_keep_all_anchors_and_their_exact_likeness(spark):
    words = [f"w{i}" for i in range(6000)]
    changed = [*words[:2500], *(f"new{i}" for i in range(20)), *words[2520:]]
    df = table(spark, [" ".join(words), " ".join(changed)], [2, 1])
    found = {r["doc_id"]: r for r in rows(fingerprints.edited_fingerprints(df))}
    anchors = {r["doc_id"]: [(x["at"], x["hash"]) for x in r["anchors"]] for r in rows(fingerprints.fingerprint(df))}
    assert len(anchors[2]) > 2000
    for i in (1, 2):
        assert found[i]["fingerprint"] == ",".join(f"{at:x}:{value & 0xFFFFFFFF:08x}" for at, value in anchors[i])
    a, b = ({(x[1], y[1], y[0] - x[0]) for x, y in itertools.pairwise(anchors[i])} for i in (2, 1))
    assert found[2]["near_next"] == len(a & b) / len(a | b) < 1.0
    assert found[2]["fingerprint"] != found[1]["fingerprint"]


def plain_components(documents: list[tuple], percent=80, words=5) -> list[tuple]:
    sets = []
    for _, text in documents:
        found = (text or "").encode().lower().split()
        grams = {tuple(found[i : i + words]) for i in range(len(found) - words + 1)} or ({tuple(found)} if found else set())
        sets.append(grams)
    group = list(range(len(documents)))
    for a, b in itertools.combinations(range(len(documents)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    out = []
    for i, (doc_id, _) in enumerate(documents):
        ids = [documents[j][0] for j in range(len(documents)) if group[j] == group[i] and documents[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids, default=None) if sets[i] else doc_id))
    return out


def test_near_duplicates_match_all_pairs(mixed):
    documents = [(r["doc_id"], r["text"]) for r in rows(mixed)]
    found = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(ngram_join.near_duplicates(mixed))]
    assert sorted(map(repr, found)) == sorted(map(repr, plain_components(documents)))


def test_near_duplicates_in_a_large_group_with_a_common_passage(spark):
    import random

    draw = random.Random(5)
    passage = " ".join(f"common{i}" for i in range(30))
    base = [f"base{i}" for i in range(120)]
    texts = []
    for i in range(150):
        if i % 3:
            words = list(base)
            for _ in range(draw.randrange(1, 4)):
                words[draw.randrange(len(words))] = f"v{draw.randrange(10_000)}"
        else:
            words = [f"u{i}x{j}" for j in range(draw.randrange(5, 60))]
        texts.append(" ".join(words) + " " + passage)
    found = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(ngram_join.near_duplicates(table(spark, texts)))]
    assert sorted(found) == sorted(plain_components(list(enumerate(texts))))


def test_tree_finds_every_pair_within_bounds():
    import numpy as np

    draw = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        base = draw.integers(0, 2**63, 40).astype("u8")
        sets += [base, np.r_[base[:38], draw.integers(0, 2**63, 2).astype("u8")]]
    bitmaps = []
    for s in sets:
        bits = np.zeros(ngram_join.BITS, bool)
        bits[(s % ngram_join.BITS).astype(int)] = True
        bitmaps.append(np.frombuffer(np.packbits(bits).tobytes(), "u8"))
    n = np.full(len(sets), 40)
    ids = np.arange(len(sets))
    u, v = ngram_join.SignatureTree(ids, n, n, ids, np.stack(bitmaps)).pairs(80)
    found = {tuple(sorted(p)) for p in zip(u.tolist(), v.tolist(), strict=True)}
    linked = {(i, i + 1) for i in range(0, len(sets), 2)}
    assert linked <= found and len(found) < 300
    sides = (ids // 3) % 2
    u, v = ngram_join.SignatureTree(ids, n, n, ids, np.stack(bitmaps), sides).pairs(80)
    across = {tuple(sorted(p)) for p in zip(u.tolist(), v.tolist(), strict=True)}
    assert across == {(a, b) for a, b in found if sides[a] != sides[b]}


def test_blocks_of_a_hot_shingle_find_what_one_tree_finds(spark):
    import random

    draw = random.Random(8)
    data = []
    for i in range(300):
        n = draw.randrange(20, 60)
        bits = bytes(i % 8 if k == i % 40 else 0 for k in range(ngram_join.BITS // 8))
        data.append((i % 2 if i < 280 else i, i, n, n, i if i % 10 == 0 else -(i % 3), bytearray(bits)))
    schema = "shingle bigint, set_id bigint, n bigint, n_shared bigint, known bigint, bitmap binary"
    plain = spark.createDataFrame(data, schema)
    mixed = plain.groupBy("shingle").agg(F.count("*").alias("rows"))
    rows_ = plain.join(mixed, "shingle")
    pairs = {size: sorted(map(tuple, ngram_join._tree_pairs(rows_, mixed, 80, size).collect())) for size in (1000, 64, 7)}
    assert len(pairs[1000]) > 1000 and pairs[1000] == pairs[64] == pairs[7]
    blocks = ngram_join._blocks(rows_.drop("rows"), 7)
    assert blocks.groupBy("block").agg(F.count("*").alias("c"), F.countDistinct("shingle").alias("s")).filter("c > 7 OR s > 1").isEmpty()
    assert blocks.count() == 300


def test_components_of_stars_chains_and_pairs(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (20, 30), *[(40, i) for i in range(41, 80)]]
    found = dict(map(tuple, components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()))
    assert [found[i] for i in (1, 5, 9, 7, 30, 79)] == [1, 1, 7, 7, 20, 40] and len(found) == 5 + 3 + 2 + 40


def test_keep_one_keeps_the_smallest_id_and_rows_without(mixed):
    kept = rows(ngram_join.keep_one(mixed))
    expected = {r["doc_id"] for r in rows(ngram_join.near_duplicates(mixed)) if r["doc_id"] == r["component_id"] and r["doc_id"] is not None}
    assert {r["doc_id"] for r in kept if r["doc_id"] is not None} == expected
    assert sum(r["doc_id"] is None for r in kept) == 2


def plain_licenses(text: str) -> list[tuple]:
    def grams(value):
        words = re.sub(r"[^\w\n]|_", " ", value.lower()).replace("\n", " ").split()
        return {" ".join(p) for p in zip(words, words[1:], strict=False)} or set(words)

    lines = text.split("\n")
    segments = list(enumerate(lines, 1)) + ([(0, " ".join(lines))] if len(lines) > 1 else [])
    found = []
    for number, segment in segments:
        mine = grams(segment)
        scored = [(2 * len(mine & grams(t)) / (len(mine) + len(grams(t))), name) for name, t in sorted(licenses.TEMPLATES.items()) if mine]
        best = max((s for s, _ in scored), default=0)
        if best >= licenses.THRESHOLD:
            found.append((number, next(name for s, name in scored if s == best), round(best, 9)))
    return found


def test_license_scan_matches_a_plain_scan(spark):
    apache = licenses.TEMPLATES["Apache-2.0-header"]
    texts = [
        None, "", "\n\n", "Released under the MIT License.", f"Some prose.\n{licenses.TEMPLATES['MIT']}\nMore of it.",
        apache, apache.replace(". ", ".\n"), apache.replace("software", "material"), "license", "This work is licensed",
        "  licensed UNDER cc by-nc 4.0  ", *licenses.TEMPLATES.values(), PROSE,
    ]
    found: dict[int, list] = {i: [] for i in range(len(texts))}
    for r in rows(licenses.scan_licenses(table(spark, texts))):
        found[r["doc_id"]].append((r["segment"], r["license"], round(r["dice"], 9)))
    for i, text in enumerate(texts):
        assert sorted(found[i]) == sorted(plain_licenses(text or ""))


def best_windows(text: str, name: str) -> float:
    """The highest Dice coefficient of any words in a row, by trying all."""
    split = lambda value: re.sub(r"[\W_]+", " ", value.lower()).split()
    words, known = split(text), set(zip(split(licenses.TEMPLATES[name]), split(licenses.TEMPLATES[name])[1:], strict=False))
    best = 0.0
    for i in range(len(words)):
        mine = set()
        for pair in zip(words[i:], words[i + 1 :], strict=False):
            mine.add(pair)
            best = max(best, 2 * len(mine & known) / (len(mine) + len(known)))
    return best


def test_license_windows_are_found_inside_long_documents(spark):
    import textwrap

    long = "\n".join(f"{PROSE} line {i}" for i in range(30))
    wrapped = {name: "\n".join(f" * {x}" for x in textwrap.wrap(licenses.TEMPLATES[name], 60)) for name in ("Apache-2.0-header", "MIT-grant", "ISC", "GPL-3.0-header", "MPL-2.0")}
    texts = [f"{long}\n{w}\n{long}" for w in wrapped.values()]
    one_line = long.replace("\n", " ")
    texts += [f"{long}\n{one_line} {licenses.TEMPLATES[name]} {one_line}" for name in wrapped]
    names = [*wrapped, *wrapped]
    texts += [
        f"{PROSE} Released under the MIT License, {PROSE}\n{PROSE} licensed under CC BY-NC 4.0 {PROSE}",
        f"{long}\n{licenses.TEMPLATES['ISC'].replace('fee', 'any fee').replace('copy,', 'copy it,')} {PROSE}",
        f"{PROSE} {'work work ' * 500}{licenses.TEMPLATES['MPL-2.0'].replace('Public', 'Public ' * 900)} {PROSE}",
        long,
    ]
    found: dict[int, list] = {i: [] for i in range(len(texts))}
    for r in rows(licenses.scan_licenses(table(spark, texts))):
        found[r["doc_id"]].append((r["segment"], r["license"], round(r["dice"], 9)))
    for i, name in enumerate(names):
        assert (31, name, 1.0) in found[i]
    assert sorted(found[10]) == [(1, "MIT", 1.0), (2, "CC-BY-NC-4.0", 1.0)]
    assert found[11] == [(31, "ISC", round(best_windows(texts[11], "ISC"), 9))] and found[11][0][2] < 1
    assert found[12] == [(1, "MPL-2.0", round(best_windows(texts[12], "MPL-2.0"), 9))]
    assert found[13] == []


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text: str) -> list[str]:
    spans = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": lambda m, d: True,
                "ip": lambda m, d: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda m, d: 14 <= len(d) <= 19 and luhn(d),
                "phone": lambda m, d: 10 <= len(d) <= 15,
            }[kind](m, digits)
            if ok:
                spans.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(spans)]


PII_TEXTS = [
    None, "", "no data", "mail a.b+c@d-e.example.com, x@y.z_u@v.w! a@b@c.d", "ünï é@x.de 🙂 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004",
    "4539 1488 0343 6467 and 4539148803436468 and 4539-1488-0343-6467 or 4 5 3", "+1 (555) 010-9999. +49.30.123456-- +1 2 +123456789012345678",
    "1" * 3000, "a" * 3000 + "@b.c", "1 2 3 4 5 " * 500, "9.9.9.9+1 234 567 8901x@y.com", "١٢٣.1.1.1 +1٢34567890", "@a.b c@.d e@f. g@h.i.",
]


def test_base_spans_match_the_plain_patterns(spark):
    found = {r["doc_id"]: r for r in rows(pii.find_pii(table(spark, PII_TEXTS)))}
    for i, text in enumerate(PII_TEXTS):
        expected = plain_spans(text or "")
        assert found[i]["base_sha256"] == hashlib.sha256(",".join(expected).encode()).hexdigest(), text
        assert [found[i][f"n_{k}"] for k in pii.KINDS] == [sum(s.startswith(k + ":") for s in expected) for k in pii.KINDS]
        assert set(expected) <= set(found[i]["spans"].split(","))


def test_patterns_discover_unseen_identifiers_and_leave_others(spark):
    texts = [f"please write to user{i}@mail{i}.example.com today" for i in range(8)]
    texts += ["please write to someone(at)example today", "we saw odd(at)sign there", "please write to us"]
    found = {r["doc_id"]: r["spans"] for r in rows(pii.find_pii(table(spark, texts)))}
    assert found[8] == "email:16:34" and found[9] == "" and found[10] == ""


def test_patterns_with_few_instances_count_in_a_large_corpus(spark):
    texts = [f"please write to user{i}@mail{i}.example.com today" for i in range(8)] + ["please write to someone(at)example today"]
    many = ["\n".join(f"reply from person x{i}n{j}@host.example.com" for j in range(400)) for i in range(30)]
    found = {r["doc_id"]: r["spans"] for r in rows(pii.find_pii(table(spark, [*texts, *many])))}
    assert found[8] == "email:16:34"


def test_word_pairs_too_common_to_be_sure_are_not_counted_in_all_texts(spark, monkeypatch):
    """Only patterns that may become sure are counted over the corpus; what is found stays the same."""
    counted, plain = [], pii.occurrences

    def watched(docs, patterns):
        counted.append((docs.count(), {r["pattern"] for r in patterns.select("pattern").collect()}))
        return plain(docs, patterns)

    monkeypatch.setattr(pii, "occurrences", watched)
    known = [f"please contact {'abcdefgh'[i]}@example.org now" for i in range(8)]
    common = [f"end of the {'abcdefgh'[i]}@example.net" for i in range(8)] + ["one of the two of the most of the others"] * 1200
    odd = ["please contact zed(at)example", "out of the yod(at)example"]
    texts = [*known, *common, *odd]
    found = {r["doc_id"]: r["spans"] for r in rows(pii.find_pii(table(spark, texts)))}
    whole = set().union(*[patterns for docs, patterns in counted if docs == len(texts)])
    assert "please contact" in whole and "of the" not in whole
    assert found[len(texts) - 2] == "email:15:29" and found[len(texts) - 1] == ""
    assert all(found[i] == "email:15:28" for i in range(8))


def test_masking_replaces_spans_and_keeps_the_rest(spark):
    df = table(spark, ["call +1 (555) 010-9999 or a@b.cd now", None, "clean"]).withColumn("n_chars", F.length("text").cast("bigint"))
    found = {r["doc_id"]: r for r in rows(pii.mask_pii(df))}
    assert found[0]["text"] == "call [PHONE] or [EMAIL] now" and found[0]["n_chars"] == 27
    assert found[1]["text"] is None and found[2]["text"] == "clean" and found[2]["word"] == "w"


@pytest.mark.parametrize(
    "run",
    [exact_dedup.exact_groups, exact_dedup.keep_first, fingerprints.edited_fingerprints, ngram_join.near_duplicates, ngram_join.keep_one, licenses.scan_licenses, pii.find_pii, pii.mask_pii],
)
def test_empty_tables_give_empty_results(spark, run):
    assert run(table(spark, [])).collect() == []
