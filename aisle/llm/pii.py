"""Personal data by bootstrapped contextual extraction, with Spark's own functions only.

Seeds are the spans of four strict patterns (e-mail, IP address, payment card, phone), tested further and
always kept. The two words before a seed are a lexical pattern. Looser shapes give candidates: an address with
no proper domain, IPv6, digits that fail a test. Patterns and instances form a graph; a pattern is worth the
share of all its occurrences in the corpus that precede a known instance, an instance is worth what its patterns
leave no doubt about, and both are reckoned in turns. Candidates that high-confidence patterns support are added
to the spans. The graph holds one row per (pattern, kind, instance), counted map-side, so an identifier that
stands in a third of all texts is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisle.llm.common import attach_groups, let, stored, text_of

KINDS = ["email", "ip", "card", "phone"]
ROUNDS = 3
LEAST_INSTANCES = 3
CELLS = 1 << 17  # hash cells by which word pairs are sifted before they are counted
PART = 64  # in a PARTth of the documents a pattern may already be too common to become a sure one
PATTERN_CONFIDENCE = 0.5
INSTANCE_CONFIDENCE = 0.8
CONTEXT_CHARS = 80

# A match starts where a run of its first characters starts, or right after the last match: elsewhere in a run it
# could not match when the start of the run does not. So no run is read twice, however long it is.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?:\G|(?<![^ \t-\r@]))(?:[^ \t-\r@]++@|[^ \t-\r@(\[]++(?:\(at\)|\[at\]))[^ \t-\r@]++",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Fa-f:])",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"(?<![0-9+.-])[0-9(][0-9 ().-]+[0-9]",
}
_HINT = {"email": r"@|\(at\)|\[at\]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits has a valid check digit."""

    def weighed(i: Column) -> Column:
        digit = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        double = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return F.when(i % 2 == 0, double).otherwise(digit)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + weighed(i))
    return total % 10 == 0


def _small(part: Column) -> Column:
    """At most 255, whatever zeros it starts with."""
    plain = F.regexp_replace(part, "^0+", "")
    return (F.length(plain) <= 3) & (F.coalesce(F.expr("int(null)"), F.when(F.length(plain) <= 3, F.concat(F.lit("0"), plain)).cast("int")) <= 255)


_VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), _small),
    "card": lambda v: let(_digits(v), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False))),
    "phone": lambda v: F.length(_digits(v)).between(10, 15),
}
_LIKELY = {
    "email": lambda v: F.length(v) >= 6,
    "ip": lambda v: F.length(v) >= 6,
    "card": lambda v: F.length(_digits(v)).between(12, 19),
    "phone": lambda v: F.length(_digits(v)).between(7, 15),
}


def matches(text: Column, pattern: str, hint: str, kind: int, valid) -> Column:
    """Valid matches as an array of (start, kind, end, value), in code points from 0."""
    empty = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"

    def placed(between: Column, found: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            value = F.get(found, i)
            start = state["at"] + F.length(F.get(between, i))
            end = start + F.length(value)
            span = F.struct(
                start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), value.alias("value")
            )
            spans = F.when(valid(value), F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
            return F.struct(end.alias("at"), spans.alias("spans"))

        zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(empty).alias("spans"))
        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), zero, step)["spans"]

    found = let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda m: F.when(F.size(m) > 0, let(F.split(text, pattern, -1), lambda b: placed(b, m))),
    )
    return F.coalesce(F.when(text.rlike(hint), found), F.array().cast(empty))


def base_spans(text: Column) -> Column:
    """Spans of the strict patterns by start, then kind."""
    each = [matches(text, STRICT[k], _HINT[k], i, _VALID[k]) for i, k in enumerate(KINDS)]
    return F.array_sort(F.concat(*each))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def _pattern(text: Column, start: Column) -> Column:
    """The two words before a place, on the same line; null when there are not two."""
    first = F.greatest(start - CONTEXT_CHARS, F.lit(0))
    left = F.substring_index(F.substring(text, (first + 1).cast("int"), (start - first).cast("int")), "\n", -1)
    return let(_words(left), lambda w: F.when(F.size(w) >= 2, F.array_join(F.slice(w, -2, 2), " ")))


def located(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, text_key, base (strict spans), and graph (spans of both sorts with their pattern).

    A candidate that meets a base span is none.
    """
    rows = docs.select("doc_id", text_of().alias("text"))

    def described(spans: Column, text: Column, seed: bool) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"),
                s["kind"].alias("kind"),
                s["end"].alias("end"),
                F.lower(s["value"]).alias("instance"),
                _pattern(text, s["start"]).alias("pattern"),
                F.lit(seed).alias("seed"),
            ),
        )

    def both(base: Column, text: Column) -> Column:
        loose = F.concat(*[matches(text, LOOSE[k], _HINT[k], i, _LIKELY[k]) for i, k in enumerate(KINDS)])
        free = F.filter(
            loose, lambda c: ~F.exists(base, lambda b: (c["start"] < b["end"]) & (b["start"] < c["end"]))
        )
        return F.struct(base.alias("base"), F.concat(described(base, text, True), described(free, text, False)).alias("graph"))

    found = let(F.col("text"), lambda t: let(base_spans(t), lambda b: both(b, t)))
    return rows.select("doc_id", F.xxhash64("text").alias("text_key"), found.alias("found")).select(
        "doc_id", "text_key", "found.base", "found.graph"
    )


def occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """How often each pattern (two words in a row) of ``patterns`` stands in the corpus; their other columns are kept.

    Pairs outside the patterns' hash cells, at most CELLS rows that are broadcast, are left out first; the others are
    counted map-side before they move.
    """
    pair = lambda w: F.when(
        F.size(w) >= 2,
        F.transform(
            F.sequence(F.lit(0), F.size(w) - F.lit(2)), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + F.lit(1)))
        ),
    )
    cell = F.pmod(F.xxhash64("pattern"), F.lit(CELLS)).alias("cell")
    pairs = docs.select(F.explode(let(_words(text_of()), pair)).alias("pattern")).select("pattern", cell)
    sifted = pairs.join(F.broadcast(patterns.select(cell).distinct()), "cell", "left_semi")
    return sifted.groupBy("pattern").agg(F.count("*").alias("occurrences")).join(patterns, "pattern")


def hopeful_patterns(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """Of the ``patterns`` (pattern, most, other columns) those whose share may still reach PATTERN_CONFIDENCE.

    ``most`` is the most occurrences of a pattern that can precede known instances of one kind, null if there are too
    few instances. What stands in a PARTth of the documents stands in the corpus, so a pattern that is too common there,
    such as "of the", can't become a sure one and need not be counted in all texts.
    """
    some = patterns.filter("most IS NOT NULL")
    part = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(PART)) == 0)
    common = occurrences(part, some).filter(F.col("most") < PATTERN_CONFIDENCE * F.col("occurrences"))
    return some.join(common.select("pattern"), "pattern", "left_anti")


def accepted_instances(docs: DataFrame, spans: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, instance) of the candidates that high-confidence patterns support, by scoring the graph in turns.

    ``spans`` has one row per span with its kind, instance, pattern and seed.
    """
    edges = stored(
        spans.filter("pattern IS NOT NULL")
        .groupBy("pattern", "kind", "instance")
        .agg(F.count("*").alias("times"), F.max(F.col("seed").cast("double")).alias("seed")),
        "pattern-instances",
    )
    of_kind = [F.col("kind") == i for i in range(len(KINDS))]
    most = [F.when(F.count_if(k) >= LEAST_INSTANCES, F.sum(F.when(k, F.col("times")))) for k in of_kind]
    frequent = stored(
        edges.groupBy("pattern")
        .agg(F.count("*").alias("instances"), F.greatest(*most).alias("most"))
        .filter(F.col("instances") >= LEAST_INSTANCES),
        "frequent-patterns",
    )
    hopeful = stored(hopeful_patterns(docs, frequent).select("pattern"), "hopeful-patterns")
    counts = occurrences(docs, hopeful)
    # a pattern without a count is never sure, but its instances and seeds belong to the graph
    counted = stored(frequent.drop("most").join(counts, "pattern", "left"), "pattern-occurrences")
    total = edges.count()
    graph = stored(
        attach_groups(edges, counted, "pattern", "instances", total)
        .drop("instances")
        .withColumn("source", F.concat_ws(":", F.col("kind").cast("string"), F.col("pattern"))),
        "pattern-graph",
    )
    scores = graph.groupBy("kind", "instance").agg(F.max("seed").alias("score"))
    for _ in range(rounds):
        held = graph.join(scores, ["kind", "instance"])
        patterns = stored(
            held.groupBy("source")
            .agg(
                (F.sum(F.col("times") * F.col("score")) / F.max("occurrences")).alias("confidence"),
                F.sum((F.col("score") > 0).cast("int")).alias("support"),
                F.count("*").alias("instances"),
            )
            .filter((F.col("confidence") >= PATTERN_CONFIDENCE) & (F.col("support") >= LEAST_INSTANCES))
            .select("source", "instances", F.least("confidence", F.lit(0.999)).alias("confidence")),
            "sure-patterns",
        )
        sure = attach_groups(graph, patterns, "source", "instances", total).select("kind", "instance", "seed", "confidence")
        doubt = F.coalesce(F.sum(F.log1p(-F.col("confidence"))), F.lit(0.0))
        scores = stored(
            sure.unionByName(graph.select("kind", "instance", "seed", F.lit(None).cast("double").alias("confidence")))
            .groupBy("kind", "instance")
            .agg(F.greatest(F.max("seed"), F.lit(1.0) - F.exp(doubt)).alias("score")),
            "instance-scores",
        )
    known = graph.groupBy("kind", "instance").agg(F.max("seed").alias("seed")).filter("seed = 0")
    return scores.filter(F.col("score") >= INSTANCE_CONFIDENCE).join(known, ["kind", "instance"]).select("kind", "instance")


def discovered(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Added spans per document: doc_id, text_key, more (array of start, kind, end)."""
    spans = found.select("doc_id", "text_key", F.explode("graph").alias("s")).select("doc_id", "text_key", "s.*")
    accepted = accepted_instances(docs, spans)
    candidates = spans.filter("NOT seed").withColumn("entity", F.concat_ws(":", F.col("kind").cast("string"), F.col("instance")))
    named = candidates.groupBy("kind", "instance", "entity").agg(F.count("*").alias("times"))
    good = stored(named.join(accepted, ["kind", "instance"]).select("entity", "times"), "accepted-instances")
    total = good.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    rows = attach_groups(candidates, good, "entity", "times", total)
    span = F.struct("start", "kind", "end")
    return rows.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(span)).alias("more"))


def _with_more(rows: DataFrame, more: DataFrame) -> DataFrame:
    """``rows`` with the added spans of their document, null ids being equal."""
    other = more.withColumnsRenamed({"doc_id": "_other_id", "text_key": "_other_key"})
    on = rows["doc_id"].eqNullSafe(other["_other_id"]) & (rows["text_key"] == other["_other_key"])
    return rows.join(other, on, "left").drop("_other_id", "_other_key")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Numbers and hash are of the base spans (kind:start:end in code points, by start, then kind); ``spans`` lists
    these and the discovered ones. Null and empty texts have none. Rows with equal id and text get the same
    spans. Other columns are not read; an empty table gives an empty result.
    """
    found = stored(located(docs), "located")
    rows = _with_more(found.select("doc_id", "text_key", "base"), discovered(docs, found))
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("bigint")
    every = F.array_sort(F.concat(plain, F.coalesce("more", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))))
    return rows.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_listed(plain), 256).alias("base_sha256"),
        _listed(every).alias("spans"),
    )


def mask_pii(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets, such as [EMAIL]; n_chars follows the text.

    Spans that meet are replaced as one, by the kind of the first. Texts without spans stay as they are.
    """
    found = stored(located(docs), "located")
    more = discovered(docs, found)
    keyed = docs.select(
        F.struct("*").alias("row"), F.col("doc_id"), F.xxhash64(text_of(docs["text"])).alias("text_key")
    )
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def masked(text: Column, spans: Column) -> Column:
        def step(state: Column, s: Column) -> Column:
            before = F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
            fresh = F.concat(state["out"], before, F.get(names, s["kind"]))
            apart = s["start"] >= state["at"]
            return F.struct(
                F.greatest(state["at"], s["end"]).alias("at"), F.when(apart, fresh).otherwise(state["out"]).alias("out")
            )

        zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
        end = lambda state: F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), F.length(text)))
        return F.aggregate(spans, zero, step, end)

    def changed(text: Column) -> Column:
        added = F.coalesce("more", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
        plain = F.transform(base_spans(text), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
        return let(F.array_sort(F.concat(plain, added)), lambda s: F.when(F.size(s) > 0, masked(text, s)).otherwise(text))

    rows = _with_more(keyed, more)
    text = F.when(F.col("row.text").isNotNull(), let(F.col("row.text"), changed))
    done = rows.select(F.col("row"), text.alias("masked"))
    own = {"text": F.col("masked"), "n_chars": F.coalesce(F.length("masked").cast("bigint"), F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return done.select(*[(own.get(c) if own.get(c) is not None else F.col(f"row.{c}")).alias(c) for c in docs.columns])
