"""License scans as an exact set-similarity join, in DataFrame functions alone.

Blocks of text and license templates are sets of words; a block is SPAN lines, wherever it begins, so that a notice may be wrapped. A block
matches a template when it holds at least `threshold` of its words.
Words are ranked by how many blocks of the corpus hold them, rarest first. Of a template with n words of which a must be
held, any match holds one of its n - a + 1 rarest words; blocks have as long a prefix. Only pairs that share a
word of both prefixes are joined, those whose first shared words leave room for a words stay, and these are verified.
Words that no template has can't be shared, so blocks are kept as their words of the template vocabulary.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import ascii_lower, stage, texts

#: The phrases whose places are counted, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Lines and sentences of public license notices, with the labels that the method gives.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("reserved", "Copyright. All rights reserved. No part of this publication may be reproduced without permission"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]
THRESHOLD = 0.8
#: Lines in a block.
SPAN = 3
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    """The distinct words of a template."""
    import re

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return list(dict.fromkeys(w for w in re.split(_BETWEEN, lowered) if w))


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def containment_join(blocks: DataFrame, templates: list[tuple[str, list[str], float]], name: str = "blocks") -> DataFrame:
    """(block, template, containment) for all blocks and templates whose containment meets the template's threshold. Exact.

    blocks: block (any id), words (array of distinct words of the template vocabulary, no nulls). templates: key, distinct words, threshold;
    they are constants of the job, and their index is a small local table. Word counts over all blocks come to the driver, one for each
    template word. Blocks without words and templates without words match nothing. Equal templates each give a row.
    """
    spark = blocks.sparkSession
    counts = {r["w"]: r["n"] for r in blocks.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    vocabulary = sorted({w for _, ws, _ in templates for w in ws}, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(vocabulary)}
    index = []
    for key, ws, threshold in templates:
        least = max(1, math.ceil(threshold * len(ws) - 1e-9))
        ranked = sorted(ws, key=rank.__getitem__)
        index += [(w, i, key, ranked, least) for i, w in enumerate(ranked[: len(ws) - least + 1])]
    if not index:
        return blocks.where("false").select("block", F.lit("").alias("template"), F.lit(0.0).alias("containment"))
    first_words = spark.createDataFrame(index, "w string, ti int, template string, ranked array<string>, least int")
    prefix = sorted({x[0] for x in index})
    # only blocks with a word of some prefix, their words rarest first
    likely = blocks.where(F.arrays_overlap("words", _strings(prefix))).select("block", F.array_intersect(_strings(vocabulary), "words").alias("words"))
    placed = likely.select("block", "words", F.posexplode("words").alias("bi", "w")).where(F.col("w").isin(prefix))
    size = F.size("words")
    room = F.lit(1) + F.least(F.size("ranked") - F.col("ti"), size - F.col("bi")) - F.lit(1)
    pairs = placed.join(first_words, "w").where((size >= F.col("least")) & (F.col("bi") <= size - F.col("least")) & (room >= F.col("least")))
    shared = F.size(F.array_intersect("words", "ranked"))
    return pairs.where(shared >= F.col("least")).select("block", "template", (shared / F.size("ranked")).alias("containment")).distinct()


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document: its words, the places of the base phrases, labels and score.

    docs: doc_id, text (null: empty; equal or null ids are rows of their own). Templates are held against blocks of SPAN lines, phrases as templates of
    which all words are needed against whole texts; for texts that the join finds, the places are counted. first_word and last_word
    are null where no phrase stands. score: the greatest containment found, 1 where a phrase stands, else 0. An empty
    table gives no rows. Texts are read once; what the join needs of them is written to the shared folder.
    """
    templates = [(f"{i}:{label}", words_of(t), threshold) for i, (label, t) in enumerate(TEMPLATES)]
    phrases = [(f"*:{label}", words_of(p), 1.0) for p, label in PHRASES.items()]
    vocabulary = _strings(sorted({w for _, ws, _ in templates + phrases for w in ws}))

    low = texts(docs).select("doc_id", ascii_lower(F.col("text")).alias("low"))
    body = F.trim(F.regexp_replace("low", _BETWEEN, " "))
    lines = F.transform(F.split("low", "\n"), lambda x: F.array_intersect(vocabulary, F.split(x, _BETWEEN)))
    rows = low.select("doc_id", F.when(body == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), body, F.lit(" "))).alias("s"), lines.alias("lines"))
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    rows = rows.select("doc_id", "s", "lines", F.array_distinct(F.flatten("lines")).alias("words"), (spaces(F.col("s")) - 1).cast("long").alias("n_words"))
    # cut before each phrase: the words of the first piece stand before the first place, those of the last piece from the last place on
    has = [F.size(F.array_intersect("words", _strings(ws))) == len(ws) for _, ws, _ in phrases]
    may = has[0] | has[1] | has[2]
    cut = F.when(may, F.split("s", " (?=(?:" + "|".join(PHRASES) + ") )", -1))
    found = F.filter(F.array(*[F.when(h & F.contains(F.col("s"), F.lit(f" {p} ")), F.lit(label)) for h, (p, label) in zip(has, PHRASES.items(), strict=True)]), lambda x: x.isNotNull())
    rows = rows.select("doc_id", "n_words", "lines", F.when(may, F.col("words")).alias("words"), cut.alias("cut"), F.when(may, found).alias("found"))
    places = F.struct((F.size("cut") - 1).cast("long").alias("n"), spaces(F.element_at("cut", 1)).cast("long").alias("first"), (F.col("n_words") - spaces(F.element_at("cut", -1))).cast("long").alias("last"), "found")
    kept, _ = stage(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", "lines", "words", F.when(F.size("cut") > 1, places).alias("places")), "license-words")

    none = F.array().cast("array<string>")
    spans = F.transform("lines", lambda x, i: F.array_distinct(F.concat(x, *[F.coalesce(F.get("lines", i + k), none) for k in range(1, SPAN)])))
    blocks = kept.select("row", F.posexplode(spans).alias("line", "words")).where(F.size("words") > 0)
    by_line = containment_join(blocks.select(F.struct("row", "line").alias("block"), "words"), templates)
    by_text = containment_join(kept.where("words is not null").select(F.struct("row", F.lit(-1).alias("line")).alias("block"), "words"), phrases)
    label = F.substring_index("template", ":", -1)
    hits = by_line.union(by_text).select(F.col("block.row").alias("row"), label.alias("label"), F.col("template").startswith("*").alias("base"), "containment")
    hits = hits.groupBy("row").agg(F.collect_set(F.when(~F.col("base"), F.col("label"))).alias("own"), F.collect_set(F.when(F.col("base"), F.col("label"))).alias("base"), F.max(F.when(~F.col("base"), F.col("containment"))).alias("score"))
    out = kept.select("row", "doc_id", "n_words", "places").join(hits, "row", "left")
    base = F.coalesce(F.array_intersect("places.found", "base"), none)
    out = out.select("doc_id", "n_words", "places", "score", base.alias("base"), F.coalesce("own", none).alias("own"))
    at = F.size("base") > 0
    return out.select(
        "doc_id", "n_words", F.when(at, F.col("places.n")).otherwise(F.lit(0)).cast("long").alias("n_base"), F.when(at, F.col("places.first")).alias("first_word"), F.when(at, F.col("places.last")).alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base", "own")), ",").alias("labels"),
        F.when(at, F.lit(1.0)).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
    )
