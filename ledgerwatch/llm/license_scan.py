"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

A template is cut into segments of at most 16 shingles of five words; segments of up to c shingles (c = 1, 2, 4, 8, 16)
are compared with text windows of 2c shingles that overlap by half, so every run of c shingles lies whole in one of them.
A band is one MinHash value. A whole segment of more than c/2 shingles has a similarity of over 1/4 with its window, one
with four fifths of its shingles over 1/5, and with 32 bands they meet with a probability of over 0.9992 (of 1 for c = 1,
where the window is the shingle). Retrieved templates are then verified: the share of their shingles that the document
holds must be 0.8 or more.

A template of under five words is found as a run of just these words: runs of its length that hold its anchor are compared
by their hash, in a class of its own per length.

Only windows with an anchor word are hashed. Each shingle of each template holds an anchor, its longest rarer word, so a window
without anchors shares no shingle with any template. This drops no match, whatever the texts are.

DataFrame functions only. Only values of windows with anchors are joined with the templates; no text is shuffled.

Defined results: null and empty texts match nothing; a template shorter than five words is in a text if all its words follow each other there;
repeated rows give their matches each; an empty table or no templates give no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerwatch.llm.common import id_key, text_of
from ledgerwatch.session import persist_table

SHINGLE = 5
CONTAINED = 0.8
BANDS = 32
CLASSES = (1, 2, 4, 8, 16)
#: Words that say little about licenses; a shingle takes another word as its anchor if it has one.
COMMON = {"this", "that", "with", "from", "have", "which", "will", "under", "other", "above", "following", "into", "form", "work", "use"}
# Notices as the licenses give them.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Notices of under five words.
SHORT = {
    "all-rights-reserved": "All rights reserved.",
    "mit-spdx": "SPDX-License-Identifier: MIT",
    "isc-spdx": "SPDX-License-Identifier: ISC",
    "unlicense-spdx": "SPDX-License-Identifier: Unlicense",
}


def license_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "license string, template string")


def registered_templates(spark: SparkSession) -> DataFrame:
    """The notices of all lengths, as the registered query scans for them."""
    return spark.createDataFrame([*TEMPLATES.items(), *SHORT.items()], "license string, template string")


def _words(text: Column) -> Column:
    """Runs of A-Z, a-z and 0-9, lowered."""
    return F.transform(F.filter(F.split(text, "[^A-Za-z0-9]+", -1), lambda w: w != ""), F.lower)


def _shingles(words: Column) -> Column:
    """Hashes of all runs of five words; of all words if they are fewer; none without words. ``words`` must be a stored column."""

    def at(i: Column) -> Column:
        return F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)])

    none = F.array().cast("array<bigint>")
    last = F.greatest(F.size(words) - SHINGLE, F.lit(0))
    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), last), at)).otherwise(none)


def _values(hashes: Column) -> Column:
    """The MinHash value of each band."""
    bands = F.sequence(F.lit(0), F.lit(BANDS - 1))
    return F.transform(bands, lambda k: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, k))))


def _template_words(templates: DataFrame) -> DataFrame:
    return templates.select("license", _words(F.coalesce("template", F.lit(""))).alias("words"))


def segments(templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(license, shingles), and (license, width, band, value) of the segments of templates of five words or more."""
    held = _template_words(templates).where(F.size("words") >= SHINGLE)
    held = held.select("license", "words", _shingles(F.col("words")).alias("all"))
    size = F.size("all")
    width = reduce(lambda rest, c: F.when(size <= c, F.lit(c)).otherwise(rest), reversed(CLASSES[:-1]), F.lit(CLASSES[-1]))
    cut = held.withColumn("width", width)
    starts = F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.col("width"))
    cut = cut.withColumn("start", F.explode(starts))
    # The last segment reaches back, so that all segments of a long template are whole.
    first = F.greatest(F.least(F.col("start"), size - F.col("width")), F.lit(0))
    cut = cut.select("license", "width", F.slice("all", first + 1, F.col("width")).alias("segment"))
    bands = cut.select("license", "width", F.posexplode(_values(F.col("segment"))).alias("band", "value")).distinct()
    return held.select("license", F.array_distinct("all").alias("template")), bands


def short_runs(templates: DataFrame) -> DataFrame:
    """(license, length, value) of the templates of under five words."""
    held = _template_words(templates).where(F.size("words").between(1, SHINGLE - 1))
    return held.select("license", F.size("words").alias("length"), F.xxhash64("words").alias("value"))


def anchors(templates: DataFrame) -> tuple[list[str], dict[int, list[str]]]:
    """The longest word of each template shingle that is not a common one, and those of the shorter templates by their length.

    The templates are a given list, read by the driver as rules are.
    """
    found, short = set(), {}
    for _, row in _template_words(templates).where(F.size("words") > 0).collect():
        marks = {max(row[k : k + SHINGLE], key=lambda w: (w not in COMMON, len(w), w)) for k in range(max(1, len(row) - SHINGLE + 1))}
        (found if len(row) >= SHINGLE else short.setdefault(len(row), set())).update(marks)
    return sorted(found), {n: sorted(marks) for n, marks in sorted(short.items())}


def _runs(words: Column, marks: dict[int, list[str]]) -> Column:
    """The distinct runs of each length that hold one of its anchors: structs of length and hash. ``words`` must be a stored column."""

    def of(length: int) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(*marks[length]))
        starts = F.flatten(F.transform(places, lambda p: F.sequence(F.greatest(p - (length - 1), F.lit(0)), p)))
        starts = F.filter(F.array_distinct(starts), lambda i: i + length <= F.size(words))
        return F.transform(starts, lambda i: F.struct(F.lit(length).alias("length"), F.xxhash64(F.slice(words, i + 1, F.lit(length))).alias("value")))

    none = F.array().cast("array<struct<length:int,value:bigint>>")
    return F.array_distinct(F.concat(none, *[of(length) for length in marks]))


def license_scan(docs: DataFrame, templates: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and template found: doc_id, license, containment."""
    marks, short_marks = anchors(templates)
    empty = docs.sparkSession.createDataFrame([], "doc_id long, license string, containment double")
    if not marks and not short_marks:
        return empty
    body = text_of(text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), id_key(doc_id).alias("id"), F.xxhash64(body).alias("row"), body.alias("text"))
    rows = rows.where(F.col("text").rlike(f"(?i)(?<![a-z0-9])(?:{'|'.join(sorted({*marks, *itertools.chain(*short_marks.values())}))})(?![a-z0-9])"))
    rows = rows.withColumn("words", _words(F.col("text"))).drop("text")
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get(F.col("words"), i).isin(*marks))
    runs = _runs(F.col("words"), short_marks)
    rows = rows.select("doc_id", "id", "row", F.size("words").alias("n"), places.alias("places"), _shingles(F.col("words")).alias("all"), runs.alias("runs"))
    rows = persist_table(rows, "anchored-texts")
    last = F.greatest(F.col("n") - SHINGLE, F.lit(0))

    def windows(width: int) -> Column:
        """The MinHash values of the windows of a class whose shingles hold an anchor."""
        size = 2 * width if width > 1 else 1

        def around(place: Column) -> Column:
            first = F.greatest(F.floor((place - (SHINGLE - 1) - size) / width) + 1, F.lit(0))
            return F.sequence(first, F.floor(F.least(place, last) / width))

        numbers = F.array_distinct(F.flatten(F.transform("places", around)))
        return F.transform(
            numbers,
            lambda k: F.struct(F.lit(width).alias("width"), _values(F.slice("all", (k * width + 1).cast("int"), F.lit(size))).alias("values")),
        )

    hashed = rows.select("id", "row", F.explode(F.concat(*[windows(c) for c in CLASSES])).alias("w"))
    values = hashed.select("id", "row", "w.width", F.posexplode("w.values").alias("band", "value"))
    shingles, bands = segments(templates)
    hits = values.join(bands, ["width", "band", "value"]).select("id", "row", "license").distinct()
    found = rows.drop("runs").join(hits, ["id", "row"]).join(shingles, "license")
    share = F.size(F.array_intersect("template", "all")) / F.size("template")
    found = found.select("doc_id", "license", share.alias("containment"))
    found = found.where(F.col("containment") >= CONTAINED)
    short = rows.select("doc_id", F.explode("runs").alias("r")).select("doc_id", "r.*").join(short_runs(templates), ["length", "value"])
    return found.unionByName(short.select("doc_id", "license", F.lit(1.0).alias("containment")))
