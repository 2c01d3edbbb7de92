"""License scans: MinHash bands over overlapping windows, verified by containment.

Texts become lower-cased words and word 5-grams. A template of s grams is
looked for in windows of 2 s grams that start every s grams, so that any
stretch of s grams lies whole in one window. A window that contains a share c
of a template has a Jaccard similarity of at least c s / (2 s + (1 - c) s);
with c = 0.8 that is 0.36, and BANDS = 24 bands of one minimum each retrieve it
with probability 1 - 0.64**24 > 0.9999. The exact containment of the template's
grams in the window then decides.

A text that lacks certain words cannot hold a share c of a notice's grams: for
each notice the longest words are taken until fewer than c s of its grams do
without all of them. Texts with none of these words are left out before any
hashing; nothing is lost by that.

A minimum of a window can only equal a template's minimum if it is a gram of
the template. So windows without any template gram cannot be retrieved, and
minima are computed for the other windows only; nothing is lost by that.

The templates are a fixed table of known size and are broadcast. Documents are
mapped without a shuffle until the best window of a document and license is
chosen. Defined results: null, empty and short texts give no row; repeated rows
count once; a null id is kept as an id; further columns don't matter; an empty
table gives an empty result; long texts are scanned whole.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
BANDS = 24
CONTAINED = 0.8
#: License notices as their publishers word them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0 International."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def words(text: Column) -> Column:
    """The words of a text in lower case."""
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")


def grams(text: Column) -> Column:
    """Hashes of the word 5-grams of a text in order; empty for under five words."""
    ids = F.transform(words(text), lambda w: F.xxhash64(w))
    # a one-element array gives the word hashes a name, so that they are made once
    return F.transform(
        F.array(ids),
        lambda h: F.when(F.size(h) < SHINGLE, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(SHINGLE)]))
        ),
    )[0]


def minima(window: Column) -> Column:
    """One minimum of the window's grams for each band."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.array_min(F.transform(window, lambda g: F.xxhash64(g, b))))


def needed_words(notice: list[str], contained: float) -> list[str]:
    """Words of a notice of which a text needs one to hold a share ``contained`` of its grams; none if it has no gram."""
    rest = {tuple(notice[i : i + SHINGLE]) for i in range(len(notice) - SHINGLE + 1)}
    least, out = contained * len(rest), []
    for word in sorted(set(notice), key=lambda w: (-len(w), w)):
        if not rest or len(rest) < least:
            break
        out.append(word)
        rest = {g for g in rest if word not in g}
    return out


def templates(spark: SparkSession, notices: tuple = TEMPLATES) -> DataFrame:
    """template, license, size (grams), the template's grams and its words."""
    rows = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "\\'")) for i, (name, text) in enumerate(notices))
    rows = spark.sql(f"SELECT * FROM VALUES {rows} AS t(template, license, notice)")
    return rows.select("template", "license", F.array_distinct(grams(F.col("notice"))).alias("own"), words(F.col("notice")).alias("words")).withColumn("size", F.size("own"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple = TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """doc_id, license, containment (share of the notice's grams), first_word (of the window)."""
    spark = docs.sparkSession
    known = templates(spark, notices)
    every = [g for (own,) in known.select("own").collect() for g in own]  # of the notices alone
    sizes = sorted({n for (n,) in known.select("size").collect()})
    needed = sorted({w for (notice,) in known.select("words").collect() for w in needed_words(notice, contained)})
    # a one-element array gives the lowered text a name, so that it is made once
    may = F.exists(F.array(F.lower(F.col(text_col))), lambda t: reduce(or_, [F.contains(t, F.lit(w)) for w in needed], F.lit(False)))
    found = (
        docs.filter(may).select(F.col(id_col), grams(F.col(text_col)).alias("grams"))
        .withColumn("common", F.array_intersect("grams", F.lit(every)))
        .filter(F.size("common") > 0)
    )
    # named too: an inlined column would be made again for each position
    hits = found.withColumn("at", F.transform(F.array("common"), lambda c: F.filter(F.sequence(F.lit(0), F.size("grams") - 1), lambda i: F.array_contains(c, F.get("grams", i))))[0])
    windows = (
        hits.select(id_col, "grams", "at", F.explode(F.lit(sizes)).alias("size"))
        .withColumn("slot", F.explode(F.array_distinct(F.flatten(F.transform("at", lambda p: F.array(F.floor(p / F.col("size")), F.floor(p / F.col("size")) - 1))))))
        .filter("slot >= 0 or size(grams) < size")
        .withColumn("slot", F.greatest(F.col("slot"), F.lit(0)))
        .select(id_col, "size", (F.col("slot") * F.col("size")).alias("first_word"), F.slice("grams", (F.col("slot") * F.col("size") + 1).cast("int"), (2 * F.col("size")).cast("int")).alias("window"))
    )
    banded = windows.select("*", F.posexplode(minima(F.col("window"))).alias("band", "least"))
    bands = known.select("template", "license", "own", "size", F.posexplode(minima(F.col("own"))).alias("band", "least"))
    met = banded.join(F.broadcast(bands), ["size", "band", "least"])
    share = F.size(F.array_intersect("window", "own")) / F.col("size")
    return (
        met.select(id_col, "license", share.alias("containment"), "first_word").filter(F.col("containment") >= contained)
        .groupBy(id_col, "license").agg(F.max(F.struct("containment", (-F.col("first_word")).alias("at"))).alias("best"))
        .select(id_col, "license", F.round("best.containment", 6).alias("containment"), (-F.col("best.at")).alias("first_word"))
    )


def oracle(notices: tuple = TEMPLATES) -> str:
    """DuckDB SQL for ``scan``: every window against every notice."""
    rows = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(notices))
    words = "string_split(trim(regexp_replace(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
    gram = "array_to_string(w[i:i + 4], ' ')"
    return f"""
WITH t AS (SELECT *, {words.format('notice')} AS w FROM (VALUES {rows}) AS v(template, license, notice)),
tg AS (SELECT DISTINCT template, license, {gram} AS g FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM t)),
ts AS (SELECT *, count(*) OVER (PARTITION BY template) AS size FROM tg),
d AS (SELECT doc_id, {words.format('text')} AS w FROM documents),
dg AS (SELECT doc_id, i - 1 AS p, {gram} AS g FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM d)),
m AS (SELECT doc_id, template, license, size, p, g FROM dg JOIN ts USING (g)),
s AS (SELECT *, p // size AS slot FROM m UNION ALL SELECT *, p // size - 1 FROM m WHERE p // size >= 1),
c AS (SELECT doc_id, license, count(DISTINCT g) / max(size) AS containment, slot * max(size) AS first_word FROM s GROUP BY doc_id, template, license, slot)
SELECT doc_id, license, round(max(containment), 6) AS containment, arg_min(first_word, (-containment, first_word)) AS first_word
FROM c WHERE containment >= {CONTAINED} GROUP BY doc_id, license"""
