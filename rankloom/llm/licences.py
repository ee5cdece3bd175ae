"""Licence scans: whole texts, or their lines, against licence templates, by Dice coefficient over word bigrams; DataFrame
functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .licence_texts import OPENINGS, WHOLE

#: Notices by which licences are declared, with the licence's identifier.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


@dataclass(frozen=True)
class LicenceScan:
    """A line matches a template when 100 * 2 * |common bigrams| >= percent * (|line's| + |template's|)."""

    templates: tuple[tuple[str, str], ...] = TEMPLATES
    percent: int = 80


@dataclass(frozen=True)
class TextScan(LicenceScan):
    """As LicenceScan, for spans of words of the whole text; also with licence texts as templates."""

    templates: tuple[tuple[str, str], ...] = TEMPLATES + WHOLE + OPENINGS


def python_words(text: str) -> list[str]:
    """As normalised(), for the templates on the driver."""
    return "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)).split()


def python_bigrams(text: str) -> list[str]:
    """As bigrams(), for the templates on the driver."""
    words = python_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def bigrams(words: Column) -> Column:
    """Distinct word bigrams of an array of words."""
    n = F.size(words)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))))


def normalised(line: Column) -> Column:
    """A-Z lower-cased, runs of characters other than a-z and 0-9 as one space, none at the ends."""
    low = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def scan_licences(df: DataFrame, scan: LicenceScan = LicenceScan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every match: id_col, line_no (from 0), licence, template_no, common, line_bigrams, template_bigrams, dice.

    Lines are parted by \\n. By the bound 2 * min / (n + t) on the coefficient, a line of n distinct bigrams meets only
    templates of between percent * n / (200 - percent) and (200 - percent) * n / percent bigrams: word counts prune lines
    before their bigrams are built (a line of w words has w - 1 bigrams at most), distinct sizes prune the templates.
    The templates are literals of the plan, as many as the scan names; no join, no shuffle.

    Null and empty texts, and lines of fewer than two words, match nothing; texts of any length are read whole; a null id
    and repeated rows are carried through; an empty table gives an empty one; other columns are not read.
    """
    grams = [(licence, k, python_bigrams(text)) for k, (licence, text) in enumerate(scan.templates)]
    if any(not g for _, _, g in grams):
        raise ValueError("a template needs two words")
    p = scan.percent
    least = min(len(g) for _, _, g in grams) * p / (200 - p)
    lines = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n", -1)).alias("line_no", "line"))
    words = lines.select("id", "line_no", F.split(normalised(F.col("line")), " ").alias("words")).where(F.size("words") - 1 >= least)
    sized = words.select("id", "line_no", bigrams(F.col("words")).alias("b"))

    def match(licence: str, k: int, g: list[str]) -> Column:
        n, t = F.size("b"), len(g)
        fits = (n * p <= F.lit(t * (200 - p))) & (n * (200 - p) >= F.lit(t * p))
        common = F.size(F.array_intersect("b", F.array(*map(F.lit, g))))
        return F.when(fits, F.struct(F.lit(licence).alias("licence"), F.lit(k).alias("template_no"), common.alias("common"), n.alias("line_bigrams"), F.lit(t).alias("template_bigrams")))

    found = sized.select("id", "line_no", F.explode(F.filter(F.array(*[match(*g) for g in grams]), lambda m: m.isNotNull() & (200 * m["common"] >= p * (m["line_bigrams"] + m["template_bigrams"])))).alias("m")).select("id", "line_no", "m.*")
    dice = 2 * F.col("common").cast("double") / (F.col("line_bigrams") + F.col("template_bigrams"))
    return found.select(F.col("id").alias(id_col), "line_no", "licence", "template_no", "common", "line_bigrams", "template_bigrams", dice.alias("dice"))


def scan_texts(df: DataFrame, scan: TextScan = TextScan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every match in a whole text: id_col, word_no (from 0), n_words, licence, template_no, common, span_bigrams,
    template_bigrams, dice.

    A span is a run of normalised words, across lines and sentences, that begins and ends with a bigram of the template and
    has at most (200 - percent) / percent times as many bigrams as the template has. It matches by distinct bigrams, as a
    line does. Of a template's matches that overlap, the one of the higher coefficient stays, then the first, then the
    shortest; each match is one that stays or overlaps one that does. Spans of different templates may overlap.

    A match has percent * t / (200 - percent) bigrams of a template of t at least, so a template is met only by texts that
    have as many of it, and a span begins only where as many follow within its greatest length. The templates are
    literals of the plan; no join, no shuffle. Nulls, ids and repeated rows are as in scan_licences().
    """
    grams = [python_bigrams(text) for _, text in scan.templates]
    if not all(grams):
        raise ValueError("a template needs two words")
    p = scan.percent
    least = [-(-p * len(g) // (200 - p)) for g in grams]
    longest = [(len(python_words(text)) - 1) * (200 - p) // p for _, text in scan.templates]
    of = lambda values, k: F.element_at(F.array(*map(F.lit, values)), k + 1)
    within = lambda g: F.filter("hits", lambda h: h["x"].isin(g))

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = df.select(F.col(id_col).alias("id"), F.split(normalised(text), " ").alias("w"))
    pairs = words.select("id", F.zip_with("w", F.slice("w", 2, F.size("w")), lambda a, b: F.concat(a, F.lit(" "), b)).alias("b"))
    known = sorted(set().union(*grams))
    hit = F.transform("b", lambda x, i: F.when(x.isin(known), F.struct(i.alias("at"), x.alias("x"))))
    hits = pairs.select("id", "b", F.filter(hit, lambda h: h.isNotNull()).alias("hits"))
    met = hits.select("id", "b", F.array(*map(within, grams)).alias("met"))
    enough = lambda m: (F.size(m["h"]) >= of(least, m["k"])) & (F.size(F.array_distinct(F.transform(m["h"], lambda h: h["x"]))) >= of(least, m["k"]))
    found = met.select("id", "b", F.explode(F.filter(F.transform("met", lambda h, k: F.struct(k.alias("k"), h.alias("h"))), enough)).alias("m"))
    k = F.col("k")
    some = found.select("id", "b", F.col("m.k").alias("k"), F.transform("m.h", lambda h: h["at"]).alias("at"))
    some = some.select("id", "b", "k", "at", of(least, k).alias("least"), of(longest, k).alias("longest"), of(map(len, grams), k).alias("t"), F.element_at(F.array(*[F.array(*map(F.lit, g)) for g in grams]), k + 1).alias("g"))

    m, fewest = F.size("at"), F.col("least") - 1
    starts = F.filter(F.sequence(F.lit(0), m - 1 - fewest), lambda i: F.get("at", i + fewest) - F.get("at", i) < F.col("longest"))
    ends = lambda i: F.filter(F.sequence(i + fewest, F.least(m - 1, i + F.col("longest") - 1)), lambda j: F.get("at", j) - F.get("at", i) < F.col("longest"))
    spans = F.flatten(F.transform(starts, lambda i: F.transform(ends(i), lambda j: F.struct(F.get("at", i).alias("a"), F.get("at", j).alias("z")))))
    part = lambda s: F.slice("b", s["a"] + 1, s["z"] - s["a"] + 1)
    sized = F.transform(spans, lambda s: F.struct(s["a"].alias("a"), s["z"].alias("z"), F.size(F.array_distinct(part(s))).alias("n"), F.size(F.array_intersect(part(s), "g")).alias("c")))
    good = F.filter(sized, lambda s: 200 * s["c"] >= p * (s["n"] + F.col("t")))
    order = F.array_sort(F.transform(good, lambda s: F.struct((-2 * s["c"].cast("double") / (s["n"] + F.col("t"))).alias("d"), s["a"].alias("a"), s["z"].alias("z"), s["n"].alias("n"), s["c"].alias("c"))))
    kept = some.select("id", "k", "t", order.alias("s"))
    best = F.aggregate("s", F.filter("s", lambda s: F.lit(False)), lambda acc, s: F.when(F.exists(acc, lambda o: (o["a"] <= s["z"]) & (s["a"] <= o["z"])), acc).otherwise(F.concat(acc, F.array(s))))
    out = kept.select("id", "k", "t", F.explode(best).alias("s"))
    return out.select(
        F.col("id").alias(id_col), F.col("s.a").alias("word_no"), (F.col("s.z") - F.col("s.a") + 2).alias("n_words"), of([name for name, _ in scan.templates], k).alias("licence"),
        k.alias("template_no"), F.col("s.c").alias("common"), F.col("s.n").alias("span_bigrams"), F.col("t").alias("template_bigrams"), (-F.col("s.d")).alias("dice"),
    )


def licences_by_document(matches: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each document with a match: n_matches, licence and dice of the best (ties: first line, first template)."""
    best = F.max_by(F.struct("licence", "dice", "line_no"), F.struct("dice", -F.col("line_no"), -F.col("template_no")))
    return matches.groupBy(id_col).agg(F.count("*").alias("n_matches"), best.alias("b")).select(id_col, "n_matches", F.col("b.licence").alias("licence"), F.col("b.dice").alias("dice"), F.col("b.line_no").cast("long").alias("line_no"))
