"""License notices found by MinHash bands over text windows.

Texts are cut into words of letters and digits, and windows of ``WINDOW`` words that overlap by
half. A window's set of five-word shingles gives ``BANDS`` least hashes, a band each; a window
and a window of a template that agree in a band make a candidate. Each candidate is
checked exactly: the share of the template's shingles that the document holds must be at
least 0.8. A notice of at most ``WINDOW - STEP + 1`` words lies whole in some window, whose
``WINDOW - 4`` shingles it shares at least one of; so a band agrees with a chance of at
least 1 / 8, and all 96 miss with a chance under (7/8)**96, about 3 in a million. Longer
notices share more.

A least hash can only agree with a template's if the shingle that has it is one of the
template's. So windows without any shingle of a template, nearly all, are left out before
they are hashed, which changes no result.

Everything is a built-in expression; a row is shuffled only for a window with a shingle of a template. What is broadcast is made from the
templates alone.

Defined results: a null text is an empty one, without licenses. A text of fewer than five
words, like a template, is one shingle. Rows are told apart by place in the table, so rows
with the same id, or none, each get their own result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .frames import materialize, table

SHINGLE = 5
WINDOW, STEP = 12, 6
BANDS = 96
PERCENT = 80

# Names of licenses and usual wordings of their notices, of which a license may
# have several. Each is short enough that the same notice of another license or version
# lacks over a fifth of its shingles. ``bsd-conditions`` is the paragraph of all BSD licenses.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("agpl-3.0", "the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("bsd-3-clause", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-conditions", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("cc-by-4.0", "Licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-2.0", "the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("gpl-3.0", "the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("lgpl-2.1", "the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("lgpl-3.0", "the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("agpl-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("bsd-3-clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("cc-by-4.0", "Licensed under the Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted."),
    ("lgpl-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


def words(text: Column) -> Column:
    """Lower-case words of ASCII letters, digits and any sign beyond ASCII."""
    return F.filter(F.split(F.lower(text), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", -1), lambda w: w != "")


def with_shingles(rows: DataFrame) -> DataFrame:
    """Adds ``shingles``, the hashes of all runs of five words in order; ``text`` is dropped."""
    hashes, n = F.col("__hashes"), F.size("__hashes")
    runs = F.transform(F.sequence(F.lit(1), n - SHINGLE + 1), lambda i: F.xxhash64(*(F.get(hashes, i - 1 + k) for k in range(SHINGLE))))
    whole = F.when(n > 0, F.array(F.xxhash64("__hashes"))).otherwise(F.array().cast("array<bigint>"))
    return (
        rows.withColumn("__words", words(F.col("text")))
        .withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
        .withColumn("shingles", F.when(n >= SHINGLE, runs).otherwise(whole))
        .drop("text", "__words", "__hashes")
    )


def windows(rows: DataFrame, step: int) -> DataFrame:
    """One row for each window of ``shingles``, every ``step`` words, with its ``begin`` and its
    shingles as ``part``."""
    wide = WINDOW - SHINGLE + 1
    begins = F.sequence(F.lit(0), F.greatest(F.size("shingles") - wide + step - 1, F.lit(0)), F.lit(step))
    cut = rows.where(F.size("shingles") > 0).withColumn("begin", F.explode(begins))
    return cut.withColumn("part", F.slice("shingles", F.col("begin") + 1, F.lit(wide))).where(F.size("part") > 0).drop("shingles")


def banded(cut: DataFrame) -> DataFrame:
    """One row for each band of each window: ``band`` and ``least``."""
    return cut.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))).withColumn(
        "least", F.array_min(F.transform("part", lambda h: F.xxhash64(h, F.col("band"))))
    )


def template_rows(spark: SparkSession, templates: Sequence[tuple[str, str]] | DataFrame) -> DataFrame:
    """(template, license, shingles) of each wording; a license may have several."""
    if not isinstance(templates, DataFrame):
        templates = spark.createDataFrame([tuple(t) for t in templates], "license string, text string")
    return with_shingles(templates.select(F.xxhash64("license", "text").alias("template"), "license", "text").dropDuplicates(["template"]))


def scan(
    documents: DataFrame, templates: Sequence[tuple[str, str]] | DataFrame = TEMPLATES, percent: int = PERCENT
) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, n_shingles) of every row, and the verified (row, license, shared, of,
    first): the wording of the license that is held most wholly, ``first`` being the word at
    which the first window that led to any begins. ``templates`` may be a table (license, text)."""
    spark = documents.sparkSession
    own = template_rows(spark, templates)
    known = sorted({h for r in own.collect() for h in r.shingles})  # of the templates
    rows = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    cut = with_shingles(rows).withColumn("__n", F.size("shingles"))
    hit = F.filter(F.transform("shingles", lambda h, i: F.when(h.isin(known), i)), lambda i: i.isNotNull())
    # Of a text, only its size and the windows that have a template's shingle are kept.
    wide = WINDOW - SHINGLE + 1
    begins = F.array_distinct(F.flatten(F.transform("__hits", lambda i: F.filter(
        F.transform(F.sequence(F.lit(0), F.lit((wide - 1) // STEP)), lambda k: (F.floor(i / STEP) - k) * STEP), lambda b: (b >= 0) & (i - b < wide)
    ))))
    parts = F.transform(begins, lambda b: F.struct(b.cast("int").alias("begin"), F.slice("shingles", b.cast("int") + 1, F.lit(wide)).alias("part")))
    found = cut.withColumn("__hits", hit).select(
        "row", "doc_id", F.col("__n").cast("long").alias("n_shingles"),
        F.array_distinct(F.transform("__hits", lambda i: F.get("shingles", i))).alias("held"), parts.alias("windows"),
    )
    found = materialize(found, "scanned")
    bands = F.broadcast(banded(windows(own, 1)).select("template", "band", "least").distinct())
    near = banded(found.where(F.size("windows") > 0).select("row", F.inline("windows"))).join(bands, ["band", "least"])
    candidates = near.groupBy("row", "template").agg(F.min("begin").alias("first"))
    sets = F.broadcast(own.select("template", "license", F.array_distinct("shingles").alias("wanted")))
    shared = F.size(F.array_intersect("held", "wanted"))
    verified = (
        candidates.join(found.select("row", "held"), "row")
        .join(sets, "template")
        .select("row", "license", shared.cast("long").alias("shared"), F.size("wanted").cast("long").alias("of"), F.col("first").cast("long").alias("first"))
        .where(f"100 * shared >= {percent} * of")
    )
    best = F.max(F.struct((F.col("shared") / F.col("of")).alias("share"), "shared", "of")).alias("best")
    verified = verified.groupBy("row", "license").agg(best, F.min("first").alias("first"))
    verified = verified.select("row", "license", "best.shared", "best.of", "first")
    return found.select("row", "doc_id", "n_shingles"), verified


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the licenses whose notices they hold."""
    rows, found = scan(table(spark, sf_dir, "documents"))
    each = found.groupBy("row").agg(
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"), F.count(F.lit(1)).alias("n_licenses"), F.min("first").alias("first_word")
    )
    return rows.join(each, "row", "left").select(
        "doc_id", "n_shingles", F.coalesce("n_licenses", F.lit(0)).alias("n_licenses"), F.coalesce("licenses", F.lit("")).alias("licenses"), "first_word"
    )
