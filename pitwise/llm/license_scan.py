"""License scans: Dice coefficient of word bigrams against licence templates.

Text is normalised (lower case; runs of anything but letters and digits become
one blank).  Units are a document's lines, its paragraphs (between blank lines)
and the whole text.  A unit matches a template if
2 * |A & B| / (|A| + |B|) over the sets of word bigrams is at least
``percent`` / 100.  Size bounds prune first: a match needs
|B| * p / (200 - p) <= |A| <= |B| * (200 - p) / p, so a unit whose size fits no
template is never compared, and each unit only meets templates of its size.

Notices that share their lines or paragraphs with other words: of a licence
that no unit matches, all windows of the text are compared, that is all runs
of bigrams, across lines too, that begin with one of the template's and are up
to (200 - p) / p times as long as the template.  (A run that begins otherwise
matches less well than without its beginning.)

Licences whose notices differ in few words are told apart by ``required``
bigrams, all of which a match of this licence must hold as far as the template
does (version numbers, Lesser, Affero, the parts of Creative Commons names), and
by ``absent`` ones, none of which it may hold.  So another version's notice is
not taken for this one's.  A ``families`` entry names a family only, as the
words that all BSD licences share, and comes after all other matches.

Any match shares |B| * p / (200 - p) bigrams or more with its template, so a
document is looked at further only for templates of which it holds as many.

All licences that match are returned, each with its best match: families
come last, units before windows, then the highest coefficient, then the first unit.  The best
match of a document is the first of these, then the first name.  All steps are
DataFrame functions on a row; nothing is shuffled.  Null and empty texts have
no units and no licence; units of one word have no bigrams; repeated rows are
scanned one by one.  Only doc_id and text are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitwise.llm.tables import let

# The wording of public licence notices.
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. ")
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ")
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("BSD-3-Clause", _BSD_START + _BSD_THIRD + _BSD_END),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MPL-1.1", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "Copyright. All rights reserved."),
]
REQUIRED = {
    "AGPL-3.0": ["affero general", "version 3"],
    "Apache-2.0": ["apache license", "version 2"],
    "BSD-2-Clause": ["bsd 2"],
    "BSD-3-Clause": ["bsd 3", "3 neither"],
    "CC-BY-4.0": ["attribution 4", "by 4"],
    "CC-BY-NC-4.0": ["attribution noncommercial", "by nc", "nc 4", "noncommercial 4"],
    "CC-BY-NC-ND-4.0": ["nc nd", "nd 4", "noderivatives 4", "noncommercial noderivatives"],
    "CC-BY-NC-SA-4.0": ["nc sa", "noncommercial sharealike", "sa 4", "sharealike 4"],
    "CC-BY-ND-4.0": ["attribution noderivatives", "by nd", "nd 4", "noderivatives 4"],
    "CC-BY-SA-4.0": ["attribution sharealike", "by sa", "sa 4", "sharealike 4"],
    "GPL-2.0": ["gnu general", "version 2"],
    "GPL-3.0": ["gnu general", "version 3"],
    "LGPL-2.1": ["2 1", "lesser general"],
    "LGPL-3.0": ["lesser general", "version 3"],
    "MIT": ["mit license"],
    "MPL-1.1": ["1 1", "mozilla public"],
    "MPL-2.0": ["2 0", "mozilla public"],
}
ABSENT = {"BSD-2-Clause": ["neither the"]}
FAMILIES = ["BSD"]


def _words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def bigrams(text: str) -> list[str]:
    """Sorted distinct word bigrams of a normalised text."""
    words = _words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def bounds(size: int, percent: int) -> tuple[int, int]:
    """Least and greatest unit sizes that can match a template of this size."""
    return -(-size * percent // (200 - percent)), size * (200 - percent) // percent


def marks(name: str, text: str) -> tuple[list[str], list[str]]:
    """The bigrams that a match of this template must hold, and those it must not."""
    grams = bigrams(text)
    return [g for g in REQUIRED.get(name, []) if g in grams], ABSENT.get(name, [])


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _template(name: str, text: str, percent: int) -> Column:
    """A template, the bounds of its matches' sizes, and the most bigrams of a window (repeated ones count)."""
    grams, (must, never) = bigrams(text), marks(name, text)
    least, most = bounds(len(grams), percent)
    return F.struct(
        F.lit(name).alias("name"), F.lit(int(name in FAMILIES)).alias("family"), _strings(must).alias("must"), _strings(never).alias("never"), _strings(grams).alias("grams"), F.lit(least).alias("least"), F.lit(most).alias("most"),
        F.lit(bounds(len(_words(text)) - 1, percent)[1]).alias("reach"))


def _matches(both: Column, size: Column, template: Column, percent: int) -> Column:
    return F.lit(200) * both >= F.lit(percent) * (size + F.size(template["grams"]))


def _dice(both: Column, size: Column, template: Column) -> Column:
    return 2 * both / (size + F.size(template["grams"]))


def _match(window: int, dice: Column, template: Column, unit: Column) -> Column:
    return F.struct(template["family"].alias("family"), F.lit(window).alias("window"), (-dice).alias("minus"), template["name"].alias("name"), unit.cast("long").alias("unit"))


def _marked(grams: Column, template: Column) -> Column:
    """Whether grams hold all that the template requires and nothing it excludes."""
    return (F.size(F.array_intersect(grams, template["must"])) == F.size(template["must"])) & ~F.arrays_overlap(grams, template["never"])


def _of_unit(grams: Column, unit: Column, template: Column, percent: int) -> Column:
    """The match of a unit's set of bigrams, else null."""
    size = F.size(grams)
    found = let(F.size(F.array_intersect(grams, template["grams"])), lambda both: F.when(
        _matches(both, size, template, percent) & _marked(grams, template), _match(0, _dice(both, size, template), template, unit)))
    return F.when(size.between(template["least"], template["most"]), found)


def _of_windows(cells: Column, sizes: Column, template: Column, percent: int) -> Column:
    """The best match of the windows, else null.  cells: per bigram of the text
    (gram, prev: where it last occurred, or -1); sizes: the lines' words."""

    def from_start(marks: Column, i: Column) -> Column:
        """(minus, i) of the best window that begins with bigram i."""

        def longer(acc: Column, mark: Column) -> Column:
            new = mark["prev"] < i
            size, both = acc["size"] + new.cast("int"), acc["both"] + (new & mark["hit"]).cast("int")
            must, never = acc["must"] + (new & mark["must"]).cast("int"), acc["never"] | mark["never"]
            best = F.when(_matches(both, size, template, percent) & (must == F.size(template["must"])) & ~never, F.greatest(acc["best"], _dice(both, size, template))).otherwise(acc["best"])
            return F.struct(size.alias("size"), both.alias("both"), must.alias("must"), never.alias("never"), best.alias("best"))

        zero = F.struct(F.lit(0).alias("size"), F.lit(0).alias("both"), F.lit(0).alias("must"), F.lit(False).alias("never"), F.lit(0.0).alias("best"))
        return F.struct((-F.aggregate(F.slice(marks, i + 1, template["reach"]), zero, longer, lambda acc: acc["best"])).alias("minus"), i.alias("i"))

    def best_of(marks: Column, hits: Column) -> Column:
        near = F.filter(hits, lambda i, k: F.get(hits, k + template["least"] - 1) - i < template["reach"])
        return F.array_min(F.filter(F.transform(near, lambda i: from_start(marks, i)), lambda x: x["minus"] < 0))

    def line_of(i: Column) -> Column:
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("line"))
        return F.aggregate(sizes, zero, lambda acc, n: F.struct(
            (acc["end"] + n).alias("end"), (acc["line"] + (acc["end"] + n <= i).cast("int")).alias("line")), lambda acc: acc["line"])

    known = F.transform(cells, lambda c: F.struct(
        c["prev"].alias("prev"), *(F.array_contains(template[of], c["gram"]).alias(to) for of, to in (("grams", "hit"), ("must", "must"), ("never", "never")))))
    best = let(known, lambda m: let(
        F.filter(F.transform(m, lambda x, i: F.when(x["hit"], i)), lambda i: i.isNotNull()), lambda hits: best_of(m, hits)))
    return let(best, lambda b: F.when(b.isNotNull(), _match(1, -b["minus"], template, line_of(b["i"]))))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_lines (lines with a word), license (null if
    none), dice (null if none), unit (the number of the unit: lines from 0,
    then paragraphs, then the text; the line where a window begins; -1 if
    none) of the best match, and licenses: array of (name, dice, unit, window)
    of all licences that match, the best first."""
    known = F.array(*(_template(name, text, percent) for name, text in templates))
    all_grams = F.array(*map(F.lit, sorted({g for _, text in templates for g in bigrams(text)})))
    least = min(bounds(len(bigrams(text)), percent)[0] for _, text in templates)
    none = F.array().cast("array<string>")

    def words(unit: Column) -> Column:
        return F.filter(F.split(unit, " "), lambda w: w != "")

    def pairs(w: Column) -> Column:
        two = F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.when(F.size(w) > least, two).otherwise(none)

    def grams(unit: Column) -> Column:
        return F.array_distinct(let(words(unit), pairs))

    flat = F.regexp_replace(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")
    rows = docs.select("doc_id", flat.alias("flat")).select("doc_id", "flat", F.split("flat", "\n").alias("lines"), let(words(F.translate("flat", "\n", " ")), pairs).alias("places"))
    # a column that lambdas use, or that is used more than once, gets a projection of its own, so that it is evaluated once
    rows = rows.select("doc_id", "flat", "lines", "places", F.array_intersect("places", all_grams).alias("common"))
    near = F.when(F.size("common") >= least, F.filter(known, lambda t: (F.size(F.array_intersect("common", t["grams"])) >= t["least"]) & (
        F.size(F.array_intersect("common", t["must"])) == F.size(t["must"]))))
    n_lines = F.size(F.filter("lines", lambda x: F.trim(x) != ""))
    rows = rows.select("doc_id", "flat", "lines", "places", n_lines.cast("long").alias("n_lines"), near.alias("near"))

    # one line is its own paragraph, and one paragraph the text: the later unit of two alike never is the first
    paragraphs = let(F.split("flat", r"\n *\n"), lambda p: F.concat(
        F.when(F.size("lines") > 1, F.transform(p, lambda x: F.translate(x, "\n", " "))).otherwise(none),
        F.when(F.size(p) > 1, F.array(F.translate("flat", "\n", " "))).otherwise(none)))
    # sets repeat no words, so only the lower bound of a unit's word count is
    # strict; the upper bound holds for the set, which is checked per template
    sets = F.transform(F.concat("lines", paragraphs), lambda u: F.when(F.length(u) >= least, grams(u)).otherwise(none))
    of_units = F.filter(F.flatten(F.transform(sets, lambda s, i: F.transform("near", lambda t: _of_unit(s, i, t, percent)))), lambda m: m.isNotNull())
    rows = rows.select("doc_id", "n_lines", "lines", "places", "near", F.when(F.size("near") > 0, of_units).alias("found"))
    rest = F.when(F.size("near") > 0, F.filter("near", lambda t: ~F.exists("found", lambda m: m["name"] == t["name"])))
    rows = rows.select("doc_id", "n_lines", "lines", "places", "found", rest.alias("rest"))

    placed = F.sort_array(F.transform("places", lambda g, i: F.struct(g.alias("gram"), i.alias("i"))))
    cells = let(placed, lambda p: F.sort_array(F.transform(p, lambda x, k: F.struct(
        x["i"].alias("i"), F.when(F.get(p, k - 1)["gram"] == x["gram"], F.get(p, k - 1)["i"]).otherwise(-1).alias("prev"), x["gram"].alias("gram")))))
    sizes = F.transform("lines", lambda x: F.size(words(x)))
    of_windows = let(cells, lambda c: let(sizes, lambda n: F.filter(
        F.transform("rest", lambda t: _of_windows(c, n, t, percent)), lambda m: m.isNotNull())))
    found = F.when(F.size("rest") > 0, F.concat("found", of_windows)).otherwise(F.col("found"))
    best = lambda f: F.transform(F.array_distinct(F.transform(f, lambda m: m["name"])), lambda name: F.array_min(F.filter(f, lambda m: m["name"] == name)))
    rows = rows.select("doc_id", "n_lines", F.when(F.size("found") + F.size("rest") > 0, F.sort_array(let(found, best))).alias("all"))
    rows = rows.select("doc_id", "n_lines", "all", F.get("all", F.lit(0)).alias("b"))
    licenses = F.transform("all", lambda m: F.struct(
        m["name"].alias("name"), F.round(-m["minus"], 6).alias("dice"), m["unit"].alias("unit"), (m["window"] == 1).alias("window")))
    return rows.select(
        "doc_id", "n_lines", F.col("b.name").alias("license"), F.round(-F.col("b.minus"), 6).alias("dice"), F.coalesce("b.unit", F.lit(-1)).cast("long").alias("unit"),
        F.coalesce(licenses, F.array().cast("array<struct<name:string,dice:double,unit:bigint,window:boolean>>")).alias("licenses"))
