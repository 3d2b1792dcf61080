"""License scan: fixed phrases, and an exact set-similarity join of text blocks with templates.

A text block is a run of words, across line ends, as long as a template and a quarter more.  It
meets the template when it holds at least the threshold's share of the template's distinct
words.  The words of all templates are ordered by the number of texts in the whole corpus that
hold them, rarest first; then

* prefix filter: a block must hold one of a template's first n - need + 1 words, so only blocks
  around such words are looked at, found by one lookup from word to templates,
* length filter: a text must have at least ``need`` words,
* positional filter: with a shared word at place i of the template and none before it, at most
  n - i words can be shared; the words of the prefix are the ones for which that is enough,

and the blocks that pass are counted exactly.  No filter can drop a block that meets the
threshold.  Templates are a parameter and go into the plan as one literal table, whatever their
number; the scan is one pass over the rows after one pre-aggregated count of template words.
A text is cut into words only if it holds one of the rarest words as characters.

Everything is column expressions.  Defined results: null text has no words; a text without
hits has no labels and score 0; repeated rows come back each; an empty table gives an
empty table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import LETTER_WORD_RAW, ROW, kept_row, text_of

# Base phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# The notices that a file or page carries, and their labels.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
            "software and associated documentation files to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain "
                 "a copy of the license at"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms "
            "of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
            "permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("proprietary", "all rights reserved no part of this work may be reproduced without permission"),
)
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A block is longer than its template by this part of it.
SLACK = 4


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(LETTER_WORD_RAW)).cast("long")


def lower_words(text: Column) -> Column:
    """Words with A-Z in lower case."""
    return F.regexp_extract_all(F.translate(text, UPPER, SMALL), F.lit(LETTER_WORD_RAW), F.lit(0))


def block_length(template: str) -> int:
    """Words of the blocks that are compared with a template."""
    n = len(template.split())
    return n + max(1, n // SLACK)


def word_order(docs: DataFrame, text: str, vocabulary: list[str]) -> list[str]:
    """The words, those first that the fewest texts hold as characters.

    The result is bounded by the vocabulary.
    """
    low = docs.select(F.lower(text_of(text)).alias("low"))
    counts = low.agg(
        *[F.count_if(F.col("low").contains(w)).alias(f"n{i}") for i, w in enumerate(vocabulary)]
    ).first()
    return [w for _, w in sorted(zip(counts, vocabulary))]


def _all_of(words: Column, at: Column, phrase: list[str]) -> Column:
    same = F.get(words, at) == phrase[0]
    for j, word in enumerate(phrase[1:], 1):
        same = same & (F.get(words, at + j) == word)
    return same


def scan(
    docs: DataFrame,
    text: str = "text",
    threshold: float = 0.9,
    carry: list[str] | None = None,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
) -> DataFrame:
    """(``ROW``, n_words, n_base, first_word, last_word, base_labels, labels, score).

    ``phrases`` are (words, label), ``templates`` (label, words), all in lower case.  The label
    lists are arrays, sorted.  ``score`` is 1 where a phrase stands, else the largest share of a
    template that a block holds, if it meets the threshold, else 0.
    """
    vocabulary = sorted({w for p, _ in phrases for w in p.split()} | {w for _, t in templates for w in t.split()})
    order = {w: i for i, w in enumerate(word_order(docs, text, vocabulary))}
    sets = [sorted(set(t.split()), key=order.__getitem__) for _, t in templates]
    needs = [math.ceil(threshold * len(t)) for t in sets]
    of_word: dict[str, list[int]] = {}
    for k, (words, need) in enumerate(zip(sets, needs)):
        for w in words[: len(words) - need + 1]:
            of_word.setdefault(w, []).append(k)
    spelled = [p.split() for p, _ in phrases]
    rarest = [min(p, key=order.__getitem__) for p in spelled]
    rows = docs.select(kept_row(docs, carry), text_of(text).alias("t"))
    rows = rows.select(ROW, "t", F.lower("t").alias("low"))
    may_hold = F.lit(False)
    for w in sorted({*of_word, *rarest}, key=order.__getitem__):
        may_hold = may_hold | F.col("low").contains(w)
    none = F.array().cast("array<string>")
    rows = rows.select(ROW, "t", F.when(may_hold, lower_words(F.col("t"))).alias("w"))
    rows = rows.select(
        ROW,
        F.when(F.col("w").isNull(), count_words(F.col("t"))).otherwise(F.size("w").cast("long")).alias("n_words"),
        F.coalesce("w", none).alias("w"),
    )
    n = F.size("w")
    starts = [
        F.when(
            (n >= len(p)) & F.array_contains("w", rare),
            F.filter(F.sequence(F.lit(0), n - len(p)), _standing(p)),
        ).otherwise(F.array().cast("array<int>")).alias(f"s{i}")
        for i, (p, rare) in enumerate(zip(spelled, rarest))
    ]
    hits = F.filter(
        F.transform("w", lambda x, i: F.struct(i.alias("i"), x.alias("x"))),
        lambda e: e["x"].isin(*of_word) if of_word else F.lit(False),
    )
    rows = rows.select(ROW, "n_words", "w", *starts, hits.alias("hits"))
    found = F.lit(None).cast("array<struct<k:int,shared:int>>")
    if templates:
        found = F.flatten(F.transform("hits", _met(sets, [block_length(t) for _, t in templates], of_word)))
    enough = F.filter(
        F.coalesce(found, F.array().cast("array<struct<k:int,shared:int>>")),
        lambda m: m["shared"] >= F.get(F.lit(needs or [0]), m["k"]),
    )
    columns = [f"s{i}" for i in range(len(phrases))]
    rows = rows.select(ROW, "n_words", *columns, enough.alias("met"))
    places = F.concat(*[F.col(c) for c in columns]) if columns else F.array().cast("array<int>")
    base = F.array_compact(
        F.array(*[F.when(F.size(c) > 0, label) for c, (_, label) in zip(columns, phrases)])
    ).cast("array<string>")
    names, sizes = F.lit([label for label, _ in templates] or [""]), F.lit([float(len(t)) for t in sets] or [1.0])
    best = F.array_max(F.transform("met", lambda m: m["shared"] / F.get(sizes, m["k"])))
    return rows.select(
        ROW,
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.sort_array(F.array_distinct(base)).alias("base_labels"),
        F.sort_array(F.array_union(base, F.transform("met", lambda m: F.get(names, m["k"])))).alias("labels"),
        F.when(F.size(places) > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )


def _standing(phrase: list[str]):
    def standing(at: Column) -> Column:
        return _all_of(F.col("w"), at, phrase)

    return standing


def _met(sets: list[list[str]], lengths: list[int], of_word: dict[str, list[int]]):
    """From a hit to (template, most shared words of a block that holds the hit)."""
    table, spans = F.lit(sets), F.lit(lengths)
    templates_of = F.map_from_arrays(F.lit(list(of_word)), F.lit(list(of_word.values())))

    def of_template(hit: Column):
        def best(k: Column) -> Column:
            length = F.get(spans, k)
            begin = F.greatest(hit["i"] - length + 1, F.lit(0))
            shared = F.transform(
                F.sequence(begin, hit["i"]),
                lambda s: F.size(F.array_intersect(F.get(table, k), F.slice("w", s + 1, length))),
            )
            return F.struct(k.cast("int").alias("k"), F.array_max(shared).alias("shared"))

        return best

    def met(hit: Column) -> Column:
        return F.transform(F.element_at(templates_of, hit["x"]), of_template(hit))

    return met
