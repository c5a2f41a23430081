"""License scans as an exact set-similarity join, in DataFrame operations only.

A block is a window of consecutive words, over line ends too, that starts with a
word of the template and is ``1 / threshold`` times as long as the template. Windows
are compared with their template as sets of words. Template words are ordered by the
number of documents that hold them, rarest first, counted over all documents. A
window that holds ``threshold`` of a template must hold one of its first words
in that order (prefix filter), have enough template words among its words (length
filter), and enough of them from the first common one on (positional filter); the
few windows left are verified exactly. Of templates with fewer than ``WHOLE`` different
words every word must be held, because there one other word makes another license.
Templates are a short list kept in the plan, so no row leaves its task but the counts
of template words.

Phrases are found as consecutive words anywhere, over line ends too. Only A-Z are
lower-cased.

Defined results: a null text has no words; the last windows of a text end with it; every
window that meets a template is given, overlapping ones too; a repeated document is scanned
again; an empty table gives an empty table; a template without words is an error; other
columns pass through and columns named like the added ones are replaced.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
WHOLE = 10  # different words from which on a template may be held in part

#: (phrase, label)
PHRASES = [
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
]

#: (label, template). The wording of the licenses' own notices.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "You may not use this file except in compliance with the License"),
    (
        "apache",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "You can redistribute it and/or modify it under the terms of the GNU General Public License"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    (
        "bsd",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    (
        "boost",
        "Distributed under the Boost Software License, Version 1.0",
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software",
    ),
]

BLOCKS = "array<struct<word: bigint, words: bigint, label: string, containment: double>>"
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str) -> list[str]:
    return [w for w in re.split(_NOT_WORD, text.lower()) if w]


def normal(text: Column) -> Column:
    """The words, each followed by one space; one space before the first."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_replace(F.concat(F.lit(" "), lowered, F.lit(" ")), _NOT_WORD, " ")


def window(template: str, threshold: float = THRESHOLD) -> int:
    """Words of the blocks compared with a template."""
    return math.ceil(len(_words(template)) / threshold - 1e-9)


def least(template: str, threshold: float = THRESHOLD) -> int:
    """Different words of a template that a block must hold."""
    n = len(set(_words(template)))
    return n if n < WHOLE else math.ceil(threshold * n - 1e-9)


def _literal(values: Sequence) -> Column:
    return F.array(*[F.lit(v) for v in values])


def word_frequencies(norm: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """Documents that hold each word of a small vocabulary, over all rows (column ``_norm``)."""
    held = F.array_intersect(F.split("_norm", " "), _literal(vocabulary))
    rows = norm.select(F.explode(held).alias("word")).groupBy("word").count().collect()
    return {word: 0 for word in vocabulary} | {r["word"]: r["count"] for r in rows}


def scan_licenses(
    docs: DataFrame,
    text: str = "text",
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``docs`` with ``n_words``, ``places`` (first word and label of every phrase) and ``blocks``
    (first word, length in words, label and containment of every block that meets a template)."""
    sets = [set(_words(t)) for _, t in templates]
    if not all(sets):
        raise ValueError("a template has no words")
    norm = docs.drop("n_words", "places", "blocks").withColumn("_norm", normal(F.col(text)))
    rank = {}
    if sets:
        counts = word_frequencies(norm, sorted(set().union(*sets)))
        rank = {w: k for k, w in enumerate(sorted(counts, key=lambda w: (counts[w], w)))}
    rows = [
        (label, sorted(rank[w] for w in words), least(t, threshold), window(t, threshold))
        for (label, t), words in zip(templates, sets)
    ]
    scanned = norm.withColumns({"_n": _n_words(), "_places": _places(phrases)})
    if rows:
        scanned = _with_hits(scanned, rows, rank).withColumn("_blocks", _blocks(rows))
    else:
        scanned = scanned.withColumn("_blocks", F.array().cast(BLOCKS))
    kept = [c for c in norm.columns if c != "_norm"]
    return scanned.select(*kept, F.col("_n").alias("n_words"), F.col("_places").alias("places"), F.col("_blocks").alias("blocks"))


def _n_words() -> Column:
    spaces = F.octet_length("_norm") - F.octet_length(F.replace(F.col("_norm"), F.lit(" "), F.lit("")))
    return (spaces - 1).cast("bigint")


def _places(phrases: Sequence[tuple[str, str]]) -> Column:
    """Texts that do not hold a phrase at all are passed over by a plain string search."""
    words = F.split(F.btrim("_norm"), " ")
    parts = []
    empty = F.array().cast("array<struct<word: bigint, label: string>>")
    for phrase, label in phrases:
        rows = _starts(words, _words(phrase), label)
        parts.append(F.when(F.contains("_norm", F.lit(f" {' '.join(_words(phrase))} ")), rows).otherwise(empty))
    return F.concat(*parts) if parts else F.array().cast("array<struct<word: bigint, label: string>>")


def _starts(words: Column, wanted: list[str], label: str) -> Column:
    opening = F.filter(F.transform(words, lambda w, i: F.when(w == wanted[0], i)), lambda i: i.isNotNull())

    def whole(i: Column) -> Column:
        same = F.lit(True)
        for k in range(1, len(wanted)):
            same = same & F.coalesce(F.get(words, i + k) == wanted[k], F.lit(False))
        return same

    return F.transform(
        F.filter(opening, whole), lambda i: F.struct(i.cast("bigint").alias("word"), F.lit(label).alias("label"))
    )


def _with_hits(norm: DataFrame, rows: list[tuple[str, list[int], int, int]], rank: dict[str, int]) -> DataFrame:
    """Adds ``_held``, the ranks of the template words a text holds, and ``_hits``, their places.

    A text that holds too few words of every template has no places.
    """
    vocabulary = _literal(sorted(rank, key=rank.get))
    split = norm.withColumn("_split", F.split(F.btrim("_norm"), " "))
    held = F.transform(F.array_intersect("_split", vocabulary), lambda w: F.array_position(vocabulary, w).cast("int") - 1)
    split = split.withColumn("_held", held)
    places = F.filter(
        F.transform("_split", lambda w, i: F.struct(i.alias("at"), (F.array_position(vocabulary, w).cast("int") - 1).alias("rank"))),
        lambda h: h["rank"] >= 0,
    )
    enough = F.exists(_templates(rows), lambda t: F.size(F.array_intersect("_held", t["ranks"])) >= t["need"])
    return split.withColumn("_hits", F.when(enough, places).otherwise(F.array().cast("array<struct<at: int, rank: int>>")))


def _templates(rows: list[tuple[str, list[int], int, int]]) -> Column:
    return F.array(*[
        F.struct(
            F.lit(label).alias("label"), _literal(ranks).alias("ranks"), F.lit(need).alias("need"), F.lit(words).alias("words"),
            F.lit(ranks[len(ranks) - need]).alias("last"),
        )
        for label, ranks, need, words in rows
    ])


def _blocks(rows: list[tuple[str, list[int], int, int]]) -> Column:
    """The windows that meet a template. A template is passed over where the whole text holds too few of its words."""

    def of(t: Column) -> Column:
        own = F.filter("_hits", lambda h: F.array_contains(t["ranks"], h["rank"]))
        # an array of one array: the places are found once, not at every use
        return F.flatten(F.transform(F.array(own), lambda hits: _meeting(hits, t)))

    met = F.filter(_templates(rows), lambda t: F.size(F.array_intersect("_held", t["ranks"])) >= t["need"])
    return F.flatten(F.transform(met, of)).cast(BLOCKS)


def _meeting(hits: Column, t: Column) -> Column:
    """The windows, each starting at one of ``hits``, that hold enough words of template ``t``."""
    starts = F.transform(hits, lambda h, k: F.struct(h["at"].alias("at"), k.alias("k")))
    # length filter: as many template words as needed, repeated ones included, before the window ends
    long = F.filter(starts, lambda s: F.coalesce(F.get(hits, s["k"] + t["need"] - 1)["at"] < s["at"] + t["words"], F.lit(False)))

    def ranked(s: Column) -> Column:
        inside = F.filter(F.slice(hits, s["k"] + 1, t["words"]), lambda h: h["at"] < s["at"] + t["words"])
        held = F.array_sort(F.array_distinct(F.transform(inside, lambda h: h["rank"])))
        return F.struct(s["at"].alias("at"), held.alias("held"))

    def candidate(w: Column) -> Column:
        first = F.get(w["held"], F.lit(0))
        left = F.size(t["ranks"]) + 1 - F.array_position(t["ranks"], first)
        return (first <= t["last"]) & (left >= t["need"]) & (F.size(w["held"]) >= t["need"])

    def row(w: Column) -> Column:
        share = F.size(w["held"]) / F.size(t["ranks"]).cast("double")
        words = F.least(t["words"].cast("bigint"), F.size("_split") - w["at"].cast("bigint"))
        return F.struct(w["at"].alias("word"), words.alias("words"), t["label"].alias("label"), share.alias("containment"))

    return F.transform(F.filter(F.transform(long, ranked), candidate), row)
