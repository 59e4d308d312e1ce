"""License scans by an exact set-similarity join of text blocks with license templates (containment).

A text is its words (letters, digits and non-ASCII characters; A-Z lower-cased). Blocks of
``2 * STRIDE`` words start every ``STRIDE`` words, so every passage of up to ``STRIDE`` words lies
whole in one of them. A template is a set of words; a block meets it if it holds at least the
template's share of them. Phrases are templates of share 1 whose words must also stand consecutively;
their places are counted, each in the block in whose first half it starts.

The join, DataFrame operations only:

1. Words outside all templates can't add to an overlap. The others are counted over all documents and
   ordered from the rarest (ties by the word): the global order, as long as the templates are.
2. A block and a template that share ``need`` of ``n`` words share one of the template's first
   ``n - need + 1`` (prefix filter). Blocks without any such word go at once, in the scan of the texts.
3. The others' ordered words are joined with the prefix index. A first common word at place ``i`` of the
   template and ``j`` of the block leaves at most ``1 + min(n - i, b - j)`` common words (positional
   filter); blocks of fewer than ``need`` ordered words go (length filter). Overlaps are then counted.

Only the order and the template index are held as literals or broadcast; both are bounded by the
templates. Candidate blocks are written once; rows of equal id and text are scanned once.

Defined results: null text is empty; null ids are kept as ids of their own; rows that repeat get equal
results; further columns of the input are not read and may have any name; an empty table gives an
empty result. A text of any length is cut into blocks inside its row.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import col, stored

#: Words from one block's start to the next; a block has twice as many.
STRIDE = 64
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """``share`` of the distinct words of ``text`` must stand in a block; ``phrase``: all of them,
    consecutively and in order."""

    label: str
    text: str
    share: float = 0.8
    phrase: bool = False

    @property
    def words(self) -> list[str]:
        return re.findall(WORD, self.text.translate(str.maketrans(UPPER, LOWER)))

    @property
    def tokens(self) -> list[str]:
        return sorted(set(self.words))

    @property
    def need(self) -> int:
        n = len(self.tokens)
        return n if self.phrase else max(1, math.ceil(self.share * n - 1e-9))


# Opening sentences of public license notices.
NOTICES = [
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
             "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. "
             "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    Template("mit", "Released under the MIT License."),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("all-rights-reserved", "Copyright. All rights reserved. No part may be reproduced without permission"),
]


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def global_order(docs: DataFrame, text_col: str, templates: list[Template]) -> list[str]:
    """The templates' words, rarest in ``docs`` first; one small row a word comes to the driver."""
    vocabulary = sorted({w for t in templates for w in t.tokens})
    counts = (docs.select(F.explode(words_of(col(text_col))).alias("w")).where(F.col("w").isin(vocabulary))
              .groupBy("w").count())
    seen = {r["w"]: r["count"] for r in counts.collect()}
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def _index(spark, templates: list[Template], order: list[str]) -> DataFrame:
    """One row for each template and word of its prefix: place ``i`` from 1, of ``n``, ``need``."""
    rank, rows = {w: k for k, w in enumerate(order)}, []
    for number, t in enumerate(templates):
        tokens = sorted(t.tokens, key=rank.__getitem__)
        prefix = tokens[:len(tokens) - t.need + 1]
        rows += [(w, i + 1, number, t.label, t.phrase, len(tokens), t.need, tokens, prefix, t.words) for i, w in enumerate(prefix)]
    return spark.createDataFrame(rows, "token string, i int, template int, label string, phrase boolean, n int, need int, "
                                       "tokens array<string>, prefix array<string>, wording array<string>")


def _scan(docs: DataFrame, templates: list[Template], order: list[str], id_col: str, text_col: str) -> DataFrame:
    """A row of the input each: ``doc_id, n_words``, the blocks with a word of some prefix (``k, w``),
    and the text's digest where there are any. Written once."""
    rank = {w: k for k, w in enumerate(order)}
    first = sorted({w for t in templates for w in sorted(t.tokens, key=rank.__getitem__)[:len(t.tokens) - t.need + 1]})
    cut = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("t"), words_of(col(text_col)).alias("words"))
    starts = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1, F.lit(STRIDE))).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda s: F.struct((s / STRIDE).cast("int").alias("k"), F.slice("words", s + 1, 2 * STRIDE).alias("w")))
    found = cut.select("doc_id", F.size("words").cast("long").alias("n_words"), "t",
                       F.filter(blocks, lambda b: F.arrays_overlap(b["w"], strings(first))).alias("blocks"))
    return stored(found.select("doc_id", "n_words", F.when(F.size("blocks") > 0, F.sha2(F.coalesce("t", F.lit("")), 256)).alias("digest"),
                               "blocks"), "license-scan")


def _matches(scanned: DataFrame, templates: list[Template], order: list[str]) -> DataFrame:
    """``doc_id, digest, k, template, label, phrase, containment, places, w`` of every block that meets a
    template; rows of equal id and text count once."""
    index = _index(scanned.sparkSession, templates, order)
    once = scanned.where("digest is not null").dropDuplicates(["doc_id", "digest"])
    block = once.select("doc_id", "digest", F.explode("blocks").alias("b")).select("doc_id", "digest", "b.k", "b.w")
    block = block.withColumn("own", F.array_intersect(strings(order), F.col("w")))  # in the global order
    each = block.select("doc_id", "digest", "k", "w", "own", F.size("own").alias("b"), F.posexplode("own").alias("j", "token"))
    pairs = (each.join(F.broadcast(index), "token")
             .where((F.col("b") >= F.col("need")) & (1 + F.least(F.col("n") - F.col("i"), F.col("b") - F.col("j") - 1) >= F.col("need"))
                    & (F.element_at(F.array_intersect("prefix", "own"), 1) == F.col("token"))))  # the first common word only
    same = F.size(F.array_intersect("tokens", "own"))
    places = F.when(F.col("phrase"), F.filter(F.sequence(F.lit(0), F.lit(STRIDE - 1)), lambda p: F.slice("w", p + 1, F.size("wording")) == F.col("wording")))
    met = pairs.withColumn("common", same).where("common >= need").withColumn("at", places).where("not phrase or size(at) > 0")
    return met.select("doc_id", "digest", "k", "template", "label", "phrase", (F.col("common") / F.col("n")).alias("containment"),
                      F.transform("at", lambda p: F.col("k").cast("long") * STRIDE + p).alias("places"), "w")


def _checked(phrases: dict[str, str], templates: list[Template]) -> list[Template]:
    every = [Template(label, text, 1.0, True) for text, label in phrases.items()] + list(templates)
    for t in every:
        if not 0 < len(t.words) <= STRIDE:
            raise ValueError(f"a template has 1 to {STRIDE} words, not {len(t.words)}: {t.text[:60]!r}")
    return every


def find_blocks(docs: DataFrame, phrases: dict[str, str], templates: list[Template] = NOTICES, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """The join's rows, one for each distinct document, block and template met: ``doc_id``, words
    ``from_word`` up to ``to_word`` of the text, their ``text``, ``template`` number (phrases first),
    ``label``, ``containment``, and the ``places`` of a phrase (words from 0)."""
    every = _checked(phrases, templates)
    order = global_order(docs, text_col, every)
    found = _matches(_scan(docs, every, order, id_col, text_col), every, order)
    start = F.col("k").cast("long") * STRIDE
    return found.select("doc_id", start.alias("from_word"), (start + F.size("w")).alias("to_word"), F.array_join("w", " ").alias("text"),
                        "template", "label", "containment", "places")


def licenses(docs: DataFrame, phrases: dict[str, str], templates: list[Template] = NOTICES, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_base`` (places of phrases), ``first_word`` and
    ``last_word`` (their smallest and largest start), ``base_labels``, ``labels`` (of the templates met
    too) and ``score``: the largest containment found, 1 for a phrase, 0 without any."""
    every = _checked(phrases, templates)
    order = global_order(docs, text_col, every)
    scanned = _scan(docs, every, order, id_col, text_col)
    names = F.array_join(F.array_sort(F.collect_set("label")), ",")
    base_names = F.array_join(F.array_sort(F.collect_set(F.when(F.col("phrase"), F.col("label")))), ",")
    summary = _matches(scanned, every, order).groupBy("doc_id", "digest").agg(
        F.coalesce(F.sum(F.when(F.col("phrase"), F.size("places"))), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.array_min("places")).alias("first_word"), F.max(F.array_max("places")).alias("last_word"),
        base_names.alias("base_labels"), names.alias("labels"), F.max("containment").alias("score"))
    some = scanned.where("digest is not null").select("doc_id", "digest", "n_words").alias("l").join(
        summary.alias("r"), F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.digest") == F.col("r.digest")), "left")
    some = some.select("l.doc_id", "n_words", *[c for c in summary.columns if c not in ("doc_id", "digest")])
    none = scanned.where("digest is null").select("doc_id", "n_words")
    out = some.unionByName(none, allowMissingColumns=True)
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
                      F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
                      F.coalesce("score", F.lit(0.0)).alias("score"))
