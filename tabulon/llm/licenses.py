"""Licence notices in texts by Dice coefficient over word bigrams, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_DICE = 0.8

# Notices as their licences' publishers word them.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def template_bigrams(text: str) -> list[str]:
    words = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def size_bounds(n: int, dice: float = LEAST_DICE) -> tuple[int, int]:
    """Bigrams a text may have that reaches `dice` with n bigrams."""
    return math.ceil(n * dice / (2 - dice) - 1e-9), math.floor(n * (2 - dice) / dice + 1e-9)


def rarity(word: str) -> int:
    """How rare a word should be in prose: long ones and those with digits are."""
    return len(word) + 4 * any(c.isdigit() for c in word)


def needed(dice: float = LEAST_DICE) -> list[str]:
    """Bigrams of which every match holds one: of each template as many as a match can't all lack."""
    out = set()
    for _, text in TEMPLATES:
        grams = template_bigrams(text)
        low, _ = size_bounds(len(grams), dice)
        shared = math.ceil(dice * (low + len(grams)) / 2 - 1e-9)
        out |= set(sorted(grams, key=lambda g: (-max(map(rarity, g.split())), g))[: len(grams) - shared + 1])
    return sorted(out)


def telling_words(grams: list[str]) -> list[str]:
    """Words of which every bigram of `grams` holds one: its rarer word."""
    out: list[str] = []
    for gram in grams:
        word = max(gram.split(), key=rarity)
        if word not in out:
            out.append(word)
    return [w for w in out if not any(v != w and v in w for v in out)]


def _bigrams(unit: Column) -> Column:
    words = F.split(unit, " ")
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))


def license_scan(docs: DataFrame, dice: float = LEAST_DICE) -> DataFrame:
    """The best licence notice of each document: doc_id, license, dice, n_notices.

    Units are the lines of a text and the whole text, with A-Z as a-z and everything but a-z and 0-9 as a
    space. A unit matches a template if the Dice coefficient of their sets of word bigrams is at least `dice`;
    templates whose size can't reach it aren't compared, and units without any of the bigrams that a match must
    hold aren't looked at further, nor texts without any of those bigrams' telling words. n_notices counts matching units; of equal coefficients the licence first in
    order is named. One pass, no shuffle.

    Texts without a match, empty and null ones have null license and dice and n_notices 0. Rows are
    independent: repeated rows repeat, nulls in other columns don't matter. A single-word unit has no bigram and no match.
    """
    rx = "(?:^| )(?:" + "|".join(needed(dice)) + ")(?: |$)"
    # one projection for each step: what is referred to more than once is then computed once
    worth = F.lit(False)
    for word in telling_words(needed(dice)):
        worth = worth | F.contains("__low", F.lit(word))
    rows = docs.select("doc_id", "text", F.lower("text").alias("__low"))
    rows = rows.select("doc_id", F.when(worth, F.col("text")).alias("__text"))
    rows = rows.select("doc_id", F.regexp_replace(F.translate("__text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9\n]+", " ").alias("__plain"))
    rows = rows.select("doc_id", "__plain", F.split("__plain", "\n").alias("__lines"))
    units = F.when(F.size("__lines") > 1, F.concat("__lines", F.array(F.regexp_replace("__plain", "\n", " ")))).otherwise(F.col("__lines"))
    rows = rows.select("doc_id", F.filter(units, lambda u: u.rlike(rx)).alias("__units"))
    rows = rows.select("doc_id", F.transform("__units", lambda u: _bigrams(F.trim(F.regexp_replace(u, " +", " ")))).alias("__grams"))
    templates = []
    for name, text in TEMPLATES:
        words = template_bigrams(text)
        low, high = size_bounds(len(words), dice)
        templates.append(F.struct(F.lit(name).alias("name"), F.lit(low).alias("low"), F.lit(high).alias("high"), F.array(*map(F.lit, words)).alias("grams")))
    table = F.array(*templates)

    def best(unit: Column) -> Column:
        near = F.filter(table, lambda t: F.size(unit).between(t["low"], t["high"]))
        scores = F.transform(near, lambda t: F.struct((-2.0 * F.size(F.array_intersect(unit, t["grams"])) / (F.size(unit) + F.size(t["grams"]))).alias("d"), t["name"].alias("name")))
        return F.array_min(F.filter(scores, lambda s: s["d"] <= -dice + 1e-12))

    rows = rows.select("doc_id", F.filter(F.transform("__grams", best), lambda h: h.isNotNull()).alias("__hits"))
    rows = rows.select("doc_id", "__hits", F.array_min("__hits").alias("__top"))
    return rows.select("doc_id", F.col("__top.name").alias("license"), (-F.col("__top.d")).alias("dice"), F.when(F.col("__hits").isNull(), F.lit(0)).otherwise(F.size("__hits")).cast("long").alias("n_notices"))


def oracle(dice: float = LEAST_DICE) -> str:
    rows = ", ".join(f"('{name}', [{', '.join(f"'{g}'" for g in template_bigrams(text))}])" for name, text in TEMPLATES)
    return f"""
WITH templates(name, grams) AS (VALUES {rows}),
plain AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(lower(text), '[^a-z0-9\\n]+', ' ', 'g') AS t FROM documents),
lines AS (SELECT r, string_split(t, chr(10)) AS l, replace(t, chr(10), ' ') AS whole FROM plain WHERE t IS NOT NULL),
units AS (SELECT r, row_number() OVER () AS u, string_split(trim(regexp_replace(unit, ' +', ' ', 'g')), ' ') AS w
          FROM (SELECT r, unnest(CASE WHEN len(l) > 1 THEN list_append(l, whole) ELSE l END) AS unit FROM lines)),
grams AS (SELECT r, u, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM units WHERE len(w) > 1),
cand AS (SELECT * FROM grams WHERE list_has_any(g, (SELECT list_distinct(flatten(list(grams))) FROM templates))),
scores AS (SELECT r, u, name, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS d FROM cand, templates),
hits AS (SELECT r, u, max(d) AS d FROM scores WHERE d >= {dice} - 1e-12 GROUP BY r, u),
best AS (SELECT r, max(d) AS d, count(*) AS n FROM hits GROUP BY r),
named AS (SELECT b.r, b.d, b.n, min(s.name) AS name FROM best b JOIN scores s ON s.r = b.r AND s.d = b.d GROUP BY b.r, b.d, b.n)
SELECT p.doc_id, named.name AS license, named.d AS dice, CAST(coalesce(named.n, 0) AS BIGINT) AS n_notices FROM plain p LEFT JOIN named ON named.r = p.r
"""
