"""License scan: segments of a text against license templates by Dice coefficient over word bigrams.

A segment is a line, the whole text when it has several lines, or a window: words in a row anywhere in the text,
across line ends and inside lines. Text and templates are normalised alike (lower case, everything but letters and
digits as one space). 2|A n B| / (|A| + |B|) >= t needs t/(2-t) |B| <= |A| <= (2-t)/t |B| and
t/(2-t) |B| <= |A n B|, so a template is compared only with segments of a fitting size, and windows are sought only
in texts with that many of its bigrams. Nothing is shuffled: templates are a small parameter and become constants
of the plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisle.llm.common import let, text_of

THRESHOLD = 0.8
COMMON = set("a an and any as at be by for free in is it may not of on or other that the this to under with work you".split())

# Short notices and grants by which licenses are named in texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:"
    ),
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def normalised(text: Column) -> Column:
    """Lower case; runs of anything but letters and digits as one space, line ends kept."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")


def pairs_of(words: Column) -> Column:
    """Pairs of neighbouring words in text order; a single word is its own pair."""
    pair = lambda i: F.concat(F.get(words, i), F.lit(" "), F.get(words, i + F.lit(1)))
    return F.when(F.size(words) < 2, words).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(words) - F.lit(2)), pair)
    )


def bigrams(words: Column) -> Column:
    """Distinct pairs of neighbouring words; a single word is its own bigram."""
    return F.array_distinct(pairs_of(words))


def words_of(line: Column) -> Column:
    return F.filter(F.split(line, "[ \n]+"), lambda w: w != "")


def template_bigrams(text: str) -> list[str]:
    words = "".join(c if c.isalpha() or c.isdecimal() else " " for c in text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)} or set(words))


def telling_words(sets: dict[str, list[str]], threshold: float) -> list[str]:
    """Words of which every matching window has one: it lacks too few bigrams to do without all of them."""
    chosen = set()
    for pairs in sets.values():
        lacking = len(pairs) - math.ceil(len(pairs) * threshold / (2 - threshold) - 1e-9)
        left = set(pairs)
        for word in sorted({w for p in pairs for w in p.split()}, key=lambda w: (w not in chosen, w in COMMON, -len(w), w)):
            if len(pairs) - len(left) > lacking:
                break
            chosen.add(word)
            left = {p for p in left if word not in p.split()}
    return sorted(chosen)


def windows_in(pairs: Column, sets: dict[str, list[str]], threshold: float) -> Column:
    """The best windows of a text's ``pairs``: array of (shared, dice, license, start, end), places in pairs, none overlapping.

    The best window of a template starts and ends with a bigram of it, as others at its edge only add to its size.
    From each such start the bigram sets of all windows are the beginnings of the distinct pairs that follow, so
    every window is compared. Of overlapping windows the one with more shared bigrams stays, then that with the
    higher Dice coefficient, the first by name and by place.
    """
    reach = (2 - threshold) / threshold
    known = {name: F.array(*[F.lit(x) for x in s]) for name, s in sets.items()}
    any_known = F.array(*[F.lit(x) for x in sorted(set().union(*sets.values()))])
    need = {name: math.ceil(len(s) / reach - 1e-9) for name, s in sets.items()}
    kind = "array<struct<shared:int,dice:double,license:string,start:int,end:int>>"

    def of_template(here: Column, name: str) -> Column:
        """``here`` holds the template's bigrams that the text has."""
        size, mine = len(sets[name]), known[name]
        most = math.floor(size * reach + 1e-9)
        near = 4 * most

        def following(i: Column) -> Column:
            """The distinct pairs from ``i`` on, as far as a window can grow; read beyond ``near`` only when pairs repeat."""
            part = F.array_distinct(F.slice(pairs, i + F.lit(1), F.lit(near)))
            return let(
                part,
                lambda p: F.slice(
                    F.when(
                        (F.size(p) < most) & (F.size(F.array_intersect(p, mine)) < F.size(here)) & (i + F.lit(near) < F.size(pairs)),
                        F.array_distinct(F.slice(pairs, i + F.lit(1), F.size(pairs))),
                    ).otherwise(p),
                    1,
                    most,
                ),
            )

        def longest(grown: Column, i: Column) -> Column:
            """The window from ``i`` with the highest Dice coefficient, of equal ones the shortest."""
            ends = F.filter(
                F.transform(grown, lambda x, m: F.when(F.array_contains(here, x), m + F.lit(1))), lambda m: m.isNotNull()
            )
            each = F.transform(
                ends,
                lambda m, q: F.struct(
                    (F.lit(2.0) * (q + F.lit(1)) / (m + F.lit(size))).alias("dice"), (-m).alias("less"), (q + F.lit(1)).alias("shared")
                ),
            )

            def placed(top: Column) -> Column:
                last = F.array_position(F.slice(pairs, i + F.lit(1), F.size(pairs)), F.get(grown, -top["less"] - F.lit(1)))
                return F.when(
                    top["dice"] >= threshold,
                    F.struct(
                        top["shared"].alias("shared"),
                        top["dice"].alias("dice"),
                        F.lit(name).alias("license"),
                        i.alias("start"),
                        (i + last.cast("int")).alias("end"),
                    ),
                )

            return let(F.array_max(each), placed)

        def from_start(i: Column) -> Column:
            return let(
                following(i), lambda g: F.when(F.size(F.array_intersect(g, mine)) >= need[name], longest(g, i))
            )

        starts = F.filter(
            F.sequence(F.lit(0), F.size(pairs) - F.lit(1)), lambda i: F.array_contains(here, F.get(pairs, i))
        )
        return F.filter(F.transform(starts, from_start), lambda w: w.isNotNull())

    def all_found(hits: Column) -> Column:
        def one(name: str) -> Column:
            return let(
                F.array_intersect(hits, known[name]),
                lambda here: F.when(F.size(here) >= need[name], of_template(here, name)).otherwise(F.array().cast(kind)),
            )

        each = [one(name) for name in sets]
        ranked = F.array_sort(
            F.transform(
                F.concat(*each),
                lambda w: F.struct(
                    (-w["shared"]).alias("a"), (-w["dice"]).alias("b"), w["license"].alias("c"), w["start"].alias("d"), w.alias("w")
                ),
            )
        )

        def step(kept: Column, r: Column) -> Column:
            met = F.exists(kept, lambda k: (k["start"] < r["w"]["end"]) & (r["w"]["start"] < k["end"]))
            return F.when(met, kept).otherwise(F.concat(kept, F.array(r["w"])))

        return F.aggregate(ranked, F.array().cast(kind), step)

    return let(
        F.array_intersect(pairs, any_known),
        lambda hits: F.when(F.size(hits) >= min(need.values()), all_found(hits)).otherwise(F.array().cast(kind)),
    )


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Segments that match a license: doc_id, segment (line from 1, 0 for the whole text), license, dice.

    One row per line or whole text: the template with the highest Dice coefficient, of equal ones the first by name.
    One row more per window (see ``windows_in``), its segment being the line in which it starts, unless it only
    repeats its line or the whole text: that one's license is the same or has more than half of the window's
    template in its own. Null and empty texts have no segments. Repeated rows each give their rows. Other columns are not read.
    """
    sets = {name: template_bigrams(text) for name, text in sorted(templates.items())}
    columns = {name: F.array(*[F.lit(x) for x in s]) for name, s in sets.items()}
    reach = (2 - threshold) / threshold
    least = min(len(s) for s in sets.values()) / reach
    most = max(len(s) for s in sets.values()) * reach

    def cut(lines: Column) -> Column:
        each = F.transform(lines, lambda line, i: F.struct((i + 1).alias("segment"), line.alias("line")))
        text = F.array(F.struct(F.lit(-1).alias("segment"), F.array_join(lines, "\n").alias("line")))
        return F.when(F.size(lines) > 1, F.concat(each, text)).otherwise(text)

    def score(pairs: Column, name: str) -> Column:
        size, known = len(sets[name]), columns[name]
        dice = F.lit(2.0) * F.size(F.array_intersect(pairs, known)) / (F.size(pairs) + F.lit(size))
        return F.when(
            F.size(pairs).between(size / reach, size * reach), F.struct(dice.alias("dice"), F.lit(name).alias("license"))
        )

    def best(pairs: Column) -> Column:
        """An array of at most one (dice, license)."""
        scored = F.filter(
            F.array(*[score(pairs, name) for name in sets]), lambda x: x.isNotNull() & (x["dice"] >= threshold)
        )
        top = let(scored, lambda all_: F.filter(all_, lambda x: x["dice"] == F.array_max(all_)["dice"]))
        return F.when(F.size(pairs).between(least, most), F.slice(top, 1, 1))

    def of_words(w: Column) -> Column:
        # a segment has at most one bigram per word, and at least as many as different words but one
        fits = (F.size(w) <= most + 1) | (F.size(F.array_distinct(w)) <= most + 1)
        return F.when((F.size(w) >= least) & fits, let(bigrams(w), best))

    def of_line(line: Column) -> Column:
        return F.when(F.length(line) >= least, let(words_of(line), of_words))  # at least one character per word

    def within(name: str) -> Column:
        """The licenses whose match makes a window of ``name`` inside it no news."""
        mine = set(sets[name])
        return F.array(*[F.lit(n) for n, s in sets.items() if n == name or 2 * len(mine & set(s)) > len(mine)])

    repeats = F.create_map(*[c for name in sets for c in (F.lit(name), within(name))])

    telling = F.array(*[F.lit(w) for w in telling_words(sets, threshold)])

    def of_text(text: Column) -> Column:
        """An array of (dice, license, segment) of the whole text and the windows that are more than it or their line."""

        def added(windows: Column, whole: Column) -> Column:
            def fresh(lines: Column, places: Column) -> Column:
                def news(w: Column) -> Column:
                    first, last = F.get(places, w["start"]), F.get(places, w["end"])
                    line = F.when((first == last) & (F.size(lines) > 1), of_line(F.get(lines, first - 1)))
                    told = F.concat(*[F.coalesce(F.transform(x, lambda b: b["license"]), F.array().cast("array<string>")) for x in (line, whole)])
                    return ~F.arrays_overlap(told, F.element_at(repeats, w["license"]))

                return F.transform(
                    F.filter(windows, news),
                    lambda w: F.struct(w["dice"].alias("dice"), w["license"].alias("license"), F.get(places, w["start"]).alias("segment")),
                )

            numbered = lambda lines: F.flatten(F.transform(lines, lambda line, i: F.transform(words_of(line), lambda _: i + F.lit(1))))
            return let(
                F.split(text, "\n", -1),
                lambda lines: let(numbered(lines), lambda places: fresh(lines, places)),
            )

        def found(w: Column, whole: Column) -> Column:
            told = F.transform(
                whole,
                lambda b: F.struct(
                    b["dice"].alias("dice"), b["license"].alias("license"), F.when(text.contains("\n"), 0).otherwise(1).alias("segment")
                ),
            )
            windows = lambda pairs: let(windows_in(pairs, sets, threshold), lambda x: F.when(F.size(x) > 0, added(x, whole)))
            more = F.when((F.size(w) >= F.lit(2)) & F.arrays_overlap(w, telling), let(pairs_of(w), windows))
            none = F.array().cast("array<struct<dice:double,license:string,segment:int>>")
            return F.concat(F.coalesce(told, none), F.coalesce(more, none))

        return F.when(F.length(text) >= least, let(words_of(text), lambda w: let(of_words(w), lambda whole: found(w, whole))))

    def of_segment(s: Column) -> Column:
        told = F.transform(
            of_line(s["line"]), lambda b: F.struct(b["dice"].alias("dice"), b["license"].alias("license"), s["segment"].alias("segment"))
        )
        return F.when(s["segment"] >= 0, told).otherwise(of_text(s["line"]))

    # each explode hands on a computed value, so that nothing above it is evaluated again
    segments = docs.select("doc_id", F.explode(let(F.split(normalised(text_of()), "\n", -1), cut)).alias("s"))
    found = segments.select("doc_id", F.explode(of_segment(F.col("s"))).alias("best"))
    return found.select("doc_id", F.col("best.segment").cast("bigint").alias("segment"), "best.license", "best.dice")
