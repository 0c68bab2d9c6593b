"""License notices found by an exact set-similarity join of text blocks with templates.

A template of ``n`` words is compared with every window of ``width = ceil(SPREAD * n / threshold)`` words of the
text's word stream, whatever its line ends, by containment: |window and template| / |template| >= threshold, that is an
overlap of at least ``need = ceil(threshold * |template|)`` distinct tokens. So a notice may be wrapped over any number of
lines and may have words in between (comment marks, names), but words scattered more widely are no notice.

A block is ``2 * W`` words, ``W`` the largest width, and one starts every ``W`` words: each window lies whole in one block.
Blocks are joined with the templates as token sets, which avoids comparing all pairs:

* tokens are in one global order, from rare to frequent over all blocks;
* prefix filter: two sets with the overlap share a token among the first ``size - need + 1`` of each;
* length filter: a block with fewer tokens than ``need`` cannot match;
* positional filter: from a common token on, each side must still have ``need`` tokens.

What passes is verified by the exact overlap of the block and then of each of its windows of the template's width. Licences share
most of their words, so a window must also have the template's ``DECIDING`` words (a notice without "mit" is no MIT notice, however
alike), and may not begin with a variant's ("lesser", "sa"). Only the templates' and the variants' vocabulary takes part (other
tokens add to no overlap), so the prefix index is as large as the templates and is the one thing broadcast. All steps are
DataFrame expressions.

Beside that, phrases are found at their exact word positions.

Defined cases: a null or empty text has no words, empty labels, null first and last word and score 0;
line ends only separate words; blocks repeat freely; repeated rows each get their result; an empty
table gives an empty result; further columns, whatever their names, are left aside; a very long text is one array of words.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recall.llm.rows import written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.8
SPREAD = 2  # words of a window for each word that a notice needs

PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Heads and passages of public licence notices, by label.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "released under the apache license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at apache org"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license version 2 1"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license version 3"),
    ("bsd", "released under the bsd license"),
    ("bsd", "licensed under the bsd license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0"),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial international license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "copyright all rights reserved no part may be reproduced without written permission"),
]

#: Words that tell licences apart. Those of them that a template has must all be in its window; those that it
#: lacks may not be among the window's first words, as many as the template has and one.
DECIDING = {
    "mit", "apache", "gnu", "general", "lesser", "affero", "bsd", "cc", "by", "sa", "nc", "nd", "creative", "commons", "sharealike",
    "noncommercial", "noderivatives", "mozilla", "unencumbered", "granted", "fee", "redistribution", "permitted", "reserved", "reproduced",
}
#: Of these, the ones that make another licence of a template that lacks them.
VARIANTS = {"lesser", "affero", "sa", "nc", "nd", "sharealike", "noncommercial", "noderivatives"}


def deciding(text: str) -> list[str]:
    """The words that must be in a template's window."""
    return sorted(DECIDING & set(re.findall(WORD, text.lower())))


def excluded(text: str) -> list[str]:
    """The words that make it another licence: only a template with a deciding word has any."""
    return sorted(VARIANTS - set(re.findall(WORD, text.lower()))) if deciding(text) else []


def template_sets(templates: list[tuple[str, str]]) -> list[tuple[str, frozenset[str]]]:
    return [(label, frozenset(re.findall(WORD, text.lower()))) for label, text in templates]


def needed(tokens: frozenset[str], threshold: float) -> int:
    return max(1, math.ceil(threshold * len(tokens) - 1e-9))


def widths(templates: list[tuple[str, str]], threshold: float) -> list[int]:
    """Words of the windows that each template is compared with."""
    return [math.ceil(SPREAD * len(re.findall(WORD, text.lower())) / threshold - 1e-9) for _, text in templates]


def starts_of(words: Column, phrase: str) -> Column:
    """Positions where the phrase's words stand one after the other."""
    parts = phrase.split(" ")
    inside = reduce(lambda a, b: a & b, [F.array_contains(words, p) for p in parts])
    here = F.filter(
        F.sequence(F.lit(0), F.size(words) - len(parts)),
        lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == p for k, p in enumerate(parts)]))
    return F.when(inside & (F.size(words) >= len(parts)), here).otherwise(F.array().cast("array<int>"))


def parsed(source: DataFrame, phrases: list[tuple[str, str]], vocabulary: list[str], least: int, width: int) -> DataFrame:
    """Per row of ``located(docs)``: at, doc_id, n_words, phrase positions and labels, blocks.

    ``blocks``: the words of each block that has at least ``least`` vocabulary tokens, all other words null. Lower-casing
    beyond A-Z changes no phrase, template or word boundary: a letter stays a letter.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce("doc.text", F.lit(""))), F.lit(f"({WORD})"), 1)
    tokens = source.select("at", F.col("doc.doc_id").alias("doc_id"), words.alias("words")) \
        .select("at", "doc_id", "words", F.transform("words", lambda w: F.when(w.isin(vocabulary), w)).alias("known"))
    own = F.array(*[F.lit(t) for t in vocabulary])
    n_blocks = F.greatest(F.lit(1), F.ceil(F.size("known") / width).cast("int") - 1)
    blocks = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda i: F.slice("known", i * width + 1, 2 * width))
    found = tokens.select(
        "at", "doc_id", F.size("words").cast("long").alias("n_words"),
        *[starts_of(F.col("words"), phrase).alias(f"p{i}") for i, (phrase, _) in enumerate(phrases)],
        F.filter(blocks, lambda b: F.size(F.array_intersect(own, b)) >= least).alias("blocks"))
    places = F.concat(*[F.col(f"p{i}") for i in range(len(phrases))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, label) for i, (_, label) in enumerate(phrases)]))
    return found.select(
        "at", "doc_id", "n_words", F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(labels)).alias("base_labels"), "blocks")


def candidates(blocks: DataFrame, templates: list[tuple[str, frozenset[str]]], threshold: float) -> DataFrame:
    """The columns of ``blocks`` and ``template, label, tokens, need, overlap``: one row for each block
    (a set of tokens in ``block``) and template with the overlap."""
    spark = blocks.sparkSession
    counted = blocks.select(F.explode("block").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    frequency = {r["token"]: r["n"] for r in counted.collect()}  # at most the templates' vocabulary
    order = sorted({t for _, tokens in templates for t in tokens}, key=lambda t: (frequency.get(t, 0), t))
    index = []
    for i, (label, tokens) in enumerate(templates):
        need, ordered = needed(tokens, threshold), [t for t in order if t in tokens]
        for pos, token in enumerate(ordered[:len(ordered) - need + 1]):
            index.append((token, i, label, ordered, need, pos))
    index = spark.createDataFrame(index, "token string, template int, label string, tokens array<string>, need int, t_pos int")
    ranked = blocks.withColumn("block", F.array_intersect(F.array(*[F.lit(t) for t in order]), "block"))
    least = min(needed(tokens, threshold) for _, tokens in templates)
    prefix = ranked.select("*", F.posexplode(F.slice("block", F.lit(1), F.greatest(F.lit(0), F.size("block") - least + 1))).alias("pos", "token"))
    found = prefix.join(F.broadcast(index), "token").filter(
        (F.size("block") >= F.col("need"))
        & (F.col("pos") <= F.size("block") - F.col("need"))
        & (F.least(F.size("block") - F.col("pos"), F.size("tokens") - F.col("t_pos")) >= F.col("need")))
    common = F.array_intersect("block", "tokens")
    # A pair meets at each common token of its prefixes; the first of them stands for it.
    return found.withColumn("overlap", F.size(common)).filter((F.col("overlap") >= F.col("need")) & (F.get(common, F.lit(0)) == F.col("token")))


def containment() -> Column:
    return F.col("overlap") / F.size("tokens")


def matches(blocks: DataFrame, templates: list[tuple[str, frozenset[str]]], threshold: float) -> DataFrame:
    """``at, label, containment`` of every block ``(at, block)`` and template at or above the threshold."""
    return candidates(blocks, templates, threshold).select("at", "label", containment().alias("containment"))


def notices(blocks: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """``at, label, containment``: the best window of each block ``(at, words)`` and template, where it reaches the threshold."""
    texts = [text for _, text in templates]
    per_template = lambda values: F.get(F.array(*values), F.col("template"))
    strings = lambda words: F.array(*[F.lit(w) for w in words]).cast("array<string>")
    must, never = (per_template([strings(rule(t)) for t in texts]) for rule in (deciding, excluded))
    found = candidates(blocks.withColumn("block", F.array_compact("words")), template_sets(templates), threshold)
    # A block without the deciding words has no such window.
    found = found.withColumn("must", must).filter(F.size(F.array_except("must", F.array_compact("words"))) == 0).withColumn("never", never)
    found = found.withColumn("width", per_template([F.lit(w) for w in widths(templates, threshold)])).withColumn(
        "head", per_template([F.lit(len(re.findall(WORD, t.lower())) + 1) for t in texts]))
    # A best window may be moved to start with one of the template's words.
    starts = F.filter(F.sequence(F.lit(1), F.size("words")), lambda i: F.array_contains("tokens", F.coalesce(F.get("words", i - 1), F.lit(""))))

    def overlap(i: Column) -> Column:
        window = F.slice("words", i, F.col("width"))
        fits = (F.size(F.array_intersect("must", window)) == F.size("must")) & ~F.coalesce(
            F.arrays_overlap("never", F.array_compact(F.slice("words", i, F.col("head")))), F.lit(False))
        return F.when(fits, F.size(F.array_intersect("tokens", window))).otherwise(0)

    best = F.array_max(F.transform(starts, overlap))
    return found.withColumn("overlap", best).filter("overlap >= need").select("at", "label", containment().alias("containment"))


def scan(source: DataFrame, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES,
         threshold: float = THRESHOLD) -> DataFrame:
    """at, doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per row of ``located(docs)``.

    ``score`` is 1 with a phrase, else the largest containment of a matching template, else 0.
    """
    sets = template_sets(templates)
    vocabulary = sorted({t for _, tokens in sets for t in tokens} | {t for _, text in templates for t in excluded(text)})
    least = min(needed(tokens, threshold) for _, tokens in sets)
    rows = written(parsed(source, phrases, vocabulary, least, max(widths(templates, threshold))), "license-tokens")
    found = notices(rows.select("at", F.explode("blocks").alias("words")), templates, threshold)
    by_row = found.groupBy("at").agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    none = F.array().cast("array<string>")
    return rows.drop("blocks").join(by_row, "at", "left").select(
        "at", "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"))
