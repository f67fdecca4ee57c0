"""License scan in DataFrame operations only: Dice coefficient over word bigrams against templates.

Units are the lines of a text, the whole text where it has several lines, and word windows: notices that are wrapped
over lines of a longer text or lie within a longer line.  Normalised words are
runs of ASCII letters and digits, lower-cased.  A template with b bigrams can reach a Dice
coefficient t only with units of t/(2-t)*b to (2-t)/t*b distinct bigrams; a unit of n words has at most
n-1 bigrams, and with d distinct words at least d-1, so most units are ruled out before any bigram is made.

Such a unit also shares more than t/(2-t)*b of the template's bigrams, so it lacks fewer than the rest of them: of any
``missing + 1`` chosen bigrams it holds one, and with it both words of that bigram.  Texts and lines without the words
of any such bigram are left out by plain substring tests before they are normalised; no match is lost by it.

A window runs from one bigram of a template to another and has as many bigrams, with repeats, as the template's size
bounds allow.  It counts where neither lines nor the whole text show the notice: it overlaps no matching line, it is
not of the licence that the whole text matches, and if it lies in one line, that line was not compared as a whole with
this template, nor with one of the same licence of which it shares more bigrams outside the window than inside.  Of overlapping
windows the one that shares most bigrams counts (ties: Dice, licence name, the first); if that one's line was compared,
none of them does, rather than a poorer one of another licence.  A matching line that is part of a wrapped notice of
another licence, which shares more bigrams, counts as that notice.
"""

from __future__ import annotations

import math
import operator
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Line number of the whole text.
WHOLE = -1

#: Fixed values: (licence, notice or text), from the public licence texts and their usual notices.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation; either version 2 of the License, "
                "or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
                 "License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "Lesser General Public License as published by the Free Software Foundation, either version 3 of the "
                 "License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
                 "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the "
                 "License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
                "MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-3.0", "Licensed under CC BY 3.0."),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    ("Proprietary", "All rights reserved."),
)


def template_bigrams(templates=TEMPLATES) -> list[tuple[str, list[str]]]:
    """(licence, distinct bigrams in order) of each template, normalised like the units."""
    out = []
    for name, text in templates:
        words = re.findall("[a-z0-9]+", text.lower())
        out.append((name, list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))))
    return out


def needed_words(grams: list[list[str]], threshold: float) -> dict[str, list[str]]:
    """Pairs of words, as {longer: [others]}: every unit that matches one of the templates holds both words of a pair."""
    needed = {}
    for g in grams:
        for long, other in needed_pairs(g, threshold):
            needed.setdefault(long, set()).add(other)
    return {w: sorted(others) for w, others in sorted(needed.items())}


def needed_pairs(g: list[str], threshold: float) -> list[tuple[str, str]]:
    """(longer word, other word) of a template's bigrams of which every matching unit holds one."""
    # shared >= t * (unit + b) / 2 and unit >= shared, so shared >= t / (2 - t) * b; the margin covers rounding
    missing = len(g) - math.ceil(threshold / (2 - threshold) * len(g) - 1e-9)
    pairs = sorted((sorted(gram.split(" "), key=lambda w: (-len(w), w)) for gram in g), key=lambda p: (-len(p[0]), p))
    return [tuple(p) for p in pairs[: missing + 1]]


def holds_pair(text: Column, needed: dict[str, list[str]]) -> Column:
    """Whether the lower-cased text holds both words of a pair anywhere (null: null)."""
    def holds(low):
        return reduce(operator.or_, [F.contains(low, F.lit(w)) & reduce(operator.or_, [F.contains(low, F.lit(o)) for o in others])
                                     for w, others in needed.items()])
    # the array makes the lower-cased text a variable, which is computed once for all tests
    return F.exists(F.array(F.lower(text)), holds)


def normalised_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")), " "), "")


def _column(expression: Column) -> Column:
    """The expression behind a generator, so that it is computed once and not copied into lambdas."""
    return F.explode_outer(F.array(expression))


def windows(rows: DataFrame, grams: list[tuple[str, list[str]]], threshold: float) -> DataFrame:
    """Per template and first bigram the best window: doc_id, text, license, number, shared, dice, first, last, from_line,
    to_line, and whether its line was ``compared`` as a whole."""
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    table = []
    for number, (name, g) in enumerate(grams):
        chosen = {frozenset(p) for p in needed_pairs(g, threshold)}
        table.append(F.struct(F.lit(number).alias("number"), F.lit(name).alias("license"), F.array(*map(F.lit, g)).alias("grams"),
                              F.array(*[F.lit(f" {x} ") for x in g if frozenset(x.split(" ")) in chosen]).alias("needed"),
                              F.lit(math.ceil(len(g) * low - 1e-9)).alias("least"), F.lit(int(len(g) * high + 1e-9)).alias("most")))
    rows = rows.select("doc_id", "text", _column(F.concat(
        F.lit(" "), F.lower(F.regexp_replace("text", "[^A-Za-z0-9]+", " ")), F.lit(" "))).alias("flat"))
    able = F.filter(F.array(*table), lambda t: F.exists(t["needed"], lambda g: F.contains(F.col("flat"), g)))
    rows = rows.select("doc_id", "text", "flat", _column(able).alias("able")).where(F.size("able") > 0)
    rows = rows.select("doc_id", "text", "able", _column(F.array_remove(F.split("flat", " "), "")).alias("words"))
    rows = rows.select("doc_id", "text", "able", _column(
        F.transform(F.sequence(F.lit(0), F.size("words") - 2),
                    lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1)))).alias("grams"))
    rows = rows.select("doc_id", "text", "grams", F.explode_outer("able").alias("t"))
    rows = rows.select("doc_id", "text", "grams", "t", _column(
        F.filter(F.sequence(F.lit(0), F.size("grams") - 1),
                 lambda i: F.array_contains(F.col("t.grams"), F.get("grams", i)))).alias("at")).where(F.size("at") >= F.col("t.least"))
    dense = F.filter(F.sequence(F.lit(0), F.size("at") - F.col("t.least")),
                     lambda i: F.get("at", i + F.col("t.least") - 1) - F.get("at", i) < F.col("t.most"))
    rows = (rows.select("doc_id", "text", "grams", "t", "at", F.explode_outer(dense).alias("i")).where(F.col("i").isNotNull())
            .select("doc_id", "text", "grams", "t", "at", "i", F.get("at", F.col("i")).alias("first")))

    def scored(last):
        unit = F.slice("grams", F.col("first") + 1, last - F.col("first") + 1)
        shared = F.size(F.array_intersect(unit, F.col("t.grams")))
        return F.struct((F.lit(2.0) * shared / (F.size(F.array_distinct(unit)) + F.size("t.grams"))).alias("dice"),
                        (-last).alias("last"), shared.alias("shared"))
    ends = F.filter(F.slice("at", F.col("i") + F.col("t.least"), F.col("t.most")),
                    lambda z: z - F.col("first") < F.col("t.most"))
    rows = (rows.select("doc_id", "text", "grams", "t", "first", _column(F.array_max(F.transform(ends, scored))).alias("best"))
            .where(F.col("best.dice") >= threshold))
    # line numbers: words before the end of each line
    counts = F.transform(F.split("text", "\n", -1), lambda line: F.size(normalised_words(line)))
    sums = F.aggregate(counts, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    rows = rows.select("doc_id", "text", "grams", "t", "first", (-F.col("best.last")).alias("last"), "best.dice", "best.shared", _column(sums).alias("sums"))
    line = lambda word: F.size(F.filter("sums", lambda n: n <= word)) - 1
    rows = rows.select("*", line(F.col("first")).alias("from_line"), line(F.col("last") + 1).alias("to_line"))
    begin = F.get("sums", F.col("from_line"))
    own = F.array_distinct(F.slice("grams", begin + 1, F.get("sums", F.col("from_line") + 1) - begin - 1))
    rows = rows.select("doc_id", "text", "t", "dice", "shared", "first", "last", "from_line", "to_line", _column(
        F.when(F.col("from_line") == F.col("to_line"), own)).alias("own"))
    # a line of a template's size has been compared as it is, and so have the shorter notices that are part of it
    compared = F.exists(F.array(*table), lambda t: (t["license"] == F.col("t.license"))
                        & (F.size("own") >= F.size(t["grams"]) * F.lit(low)) & (F.size("own") <= F.size(t["grams"]) * F.lit(high))
                        & ((t["grams"] == F.col("t.grams")) | (F.size(F.array_intersect("own", t["grams"])) > 2 * F.col("shared"))))
    return rows.select("doc_id", "text", "t.license", "t.number", "shared", "dice", "first", "last", "from_line", "to_line",
                       (F.col("own").isNotNull() & compared).alias("compared"))


def license_scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, n_units, dice): per document and licence found, matching units and the best coefficient.

    A unit counts for its best template (ties: the first in licence name order) if Dice >= ``threshold``.
    Null, empty and unlicensed texts give no rows; units of one word have no bigrams and never match;
    rows with one doc_id are counted together; other columns are ignored.
    """
    grams = template_bigrams(templates)
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    fewest, most = min(len(g) for _, g in grams) * low, max(len(g) for _, g in grams) * high
    table = F.array(*[F.struct(F.lit(n).alias("license"), F.array(*map(F.lit, g)).alias("grams")) for n, g in grams])

    # explode_outer and CASE instead of filters: Catalyst would copy a filter's array expressions into the lambdas
    text, needed = F.col("text"), needed_words([g for _, g in grams], threshold)
    numbered = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("line"), x.alias("unit")))
    lines = F.filter(numbered, lambda u: holds_pair(u["unit"], needed))
    whole = F.array(F.struct(F.lit(WHOLE).alias("line"), text.alias("unit")))
    rows = docs.select("doc_id", "text").where(holds_pair(text, needed))
    units = (rows.select("doc_id", "text", F.explode_outer(F.when(F.contains(text, F.lit("\n")), F.concat(lines, whole))
                                                           .otherwise(lines)).alias("u"))
             .select("doc_id", "text", "u.line", normalised_words(F.col("u.unit")).alias("words")))
    pairs = F.transform(F.sequence(F.lit(0), F.size("words") - 2),
                        lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1)))
    possible = (F.size("words") - 1 >= F.lit(fewest)) & (F.size(F.array_distinct("words")) - 1 <= F.lit(most))
    units = units.select("doc_id", "text", "line", F.when(possible, F.array_distinct(pairs)).alias("grams"))
    able = F.filter(table, lambda t: (F.size("grams") >= F.size(t["grams"]) * F.lit(low))
                    & (F.size("grams") <= F.size(t["grams"]) * F.lit(high)))
    held = F.transform(able, lambda t: F.struct(t.alias("t"), F.size(F.array_intersect(F.col("grams"), t["grams"])).alias("shared")))
    scored = F.transform(held, lambda h: F.struct(
        (F.lit(2.0) * h["shared"] / (F.size("grams") + F.size(h["t"]["grams"]))).alias("dice"),
        h["t"]["license"].alias("license"), h["shared"].alias("shared")))
    best = F.reduce(scored, F.struct(F.lit(0.0).alias("dice"), F.lit("").alias("license"), F.lit(0).alias("shared")),
                    lambda a, b: F.when((b["dice"] > a["dice"]) | ((b["dice"] == a["dice"]) & (b["license"] < a["license"])), b)
                    .otherwise(a))
    found = (units.select("doc_id", "text", "line", F.when(F.col("grams").isNotNull(), best).alias("best"))
             .select("doc_id", "text", "line", F.explode_outer(F.when(F.col("best.dice") >= threshold, F.array("best"))).alias("hit"))
             .where(F.col("hit").isNotNull()))
    # rows equal in doc_id and text give equal units, so their number is that of the units by that of the distinct ones
    wide = windows(rows, grams, threshold)
    no_window = F.lit(None).cast("struct<fewer:int,cost:double,license:string,first:int,last:int,from_line:int,to_line:int,number:int,compared:boolean>")
    both = found.select("doc_id", F.md5("text").alias("row"), F.struct("line", "hit.license", "hit.dice", "hit.shared").alias("unit"),
                        no_window.alias("window")).unionByName(
        wide.select("doc_id", F.md5("text").alias("row"), F.lit(None).cast("struct<line:int,license:string,dice:double,shared:int>").alias("unit"),
                    F.struct((-F.col("shared")).alias("fewer"), (-F.col("dice")).alias("cost"), "license", "first", "last", "from_line", "to_line", "number", "compared").alias("window")))
    rows = both.groupBy("doc_id", "row").agg(F.collect_set("unit").alias("units"), F.collect_set("window").alias("windows"),
                                             F.count(F.lit(1)).alias("n"))
    within = lambda u, w: u["line"].between(w["from_line"], w["to_line"])
    # a line that is part of a wrapped notice of another licence is that notice, not a poorer one of its own
    part = lambda u: F.exists("windows", lambda w: within(u, w) & (w["from_line"] < w["to_line"])
                              & (-w["fewer"] > u["shared"]) & (w["license"] != u["license"]))
    rows = rows.select("doc_id", (F.col("n") / (F.size("units") + F.size("windows"))).cast("long").alias("n"), "windows",
                       _column(F.filter("units", lambda u: ~part(u))).alias("units"))
    free = F.array_sort(F.filter("windows", lambda w: ~F.exists("units", lambda u: within(u, w))))
    rows = rows.select("doc_id", "units", "n", _column(free).alias("windows"))
    apart = F.aggregate("windows", F.filter("windows", lambda w: F.lit(False)), lambda kept, w: F.when(
        F.exists(kept, lambda k: (k["first"] <= w["last"]) & (w["first"] <= k["last"])), kept).otherwise(F.concat(kept, F.array(w))))
    new = F.filter(apart, lambda w: ~w["compared"] & ~F.exists("units", lambda u: (u["line"] == WHOLE) & (u["license"] == w["license"])))
    pair = lambda x, dice: F.struct(x["license"].alias("license"), dice.alias("dice"))
    hits = F.concat(F.transform("units", lambda u: pair(u, u["dice"])), F.transform(new, lambda w: pair(w, -w["cost"])))
    return (rows.select("doc_id", "n", F.explode_outer(hits).alias("hit")).where(F.col("hit").isNotNull())
            .groupBy("doc_id", F.col("hit.license").alias("license"))
            .agg(F.sum("n").alias("n_units"), F.max("hit.dice").alias("dice")))
