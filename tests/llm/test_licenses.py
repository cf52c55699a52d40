"""License scan against exact containment of every template."""

import re

from keyfold.llm import licenses as l

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def shingles(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(text):
    own = shingles(text)
    return sorted(n for n, t in l.TEMPLATES if 100 * len(own & shingles(t)) >= 80 * len(shingles(t)))


def test_every_template_at_every_offset(spark):
    texts = [f"{'w ' * k}{t.upper() if k % 2 else t}{' z' * (k % 5)}" for k in range(0, 26) for _, t in l.TEMPLATES]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, found = l.scan(docs)
    got = {}
    for r in rows.join(found, "row").collect():
        got.setdefault(r.doc_id, []).append(r.license)
    assert {i: sorted(v) for i, v in got.items()} == {i: brute(t) for i, t in enumerate(texts)}


def test_hostile_rows(spark):
    notice = dict(l.TEMPLATES)
    cut = " ".join(notice["bsd-3-clause"].split()[:-2])
    texts = [None, "", "mit", "Released under MIT", notice["mit"] * 2, "x " * 60_000 + notice["gpl-3.0"], cut, cut[:60], "\n".join(notice.values())]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, notice["mit"] * 2), (None, notice["isc"])]
    docs = spark.createDataFrame([(i, t, 1, "a") for i, t in rows], "doc_id long, text string, row int, license string")
    every, found = l.scan(docs)
    got = {}
    for r in every.join(found, "row", "left").collect():
        got.setdefault((r.row, r.doc_id), []).extend([r.license] if r.license else [])
    assert sorted(((i, sorted(v)) for (_, i), v in got.items()), key=repr) == sorted(((i, brute(t)) for i, t in rows), key=repr)
    assert l.scan(docs.limit(0))[0].count() == 0


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").collect()
    found = l.op9_licenses(spark, sf_dir.replace("sf0.001", "sf0.01"))
    got = {r.doc_id: (r.licenses, r.n_licenses) for r in found.collect()}
    assert got == {r.doc_id: (",".join(brute(r.text)), len(brute(r.text))) for r in docs}
    assert sum(n for _, n in got.values()) > 3


def test_usual_notices(spark):
    gnu = "it under the terms of the GNU {} as published by\n * the Free Software Foundation, either version {} of the License, or\n * (at your option) any later version."
    free = "This program is free software: you can redistribute it and/or modify\n * "
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. "
    third = "Neither the name of Acme Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    pages = [
        (free + gnu.format("General Public License", "3"), ["gpl-3.0"]),
        (free + gnu.format("General Public License", "2"), ["gpl-2.0"]),
        (free + gnu.format("Lesser General Public License", "3"), ["lgpl-3.0"]),
        (free + gnu.format("Lesser General Public License", "2.1"), ["lgpl-2.1"]),
        (free + gnu.format("Affero General Public License", "3"), ["agpl-3.0"]),
        (bsd + third, ["bsd-3-clause", "bsd-conditions"]),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that", ["isc"]),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["cc-by-sa-4.0"]),
        ("\n".join(t for n, t in l.TEMPLATES if n == "isc"), ["isc"]),
    ]
    rows, found = l.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(pages)], "doc_id long, text string"))
    got = {}
    for r in rows.join(found, "row").collect():
        got.setdefault(r.doc_id, []).append(r.license)
    assert {i: sorted(v) for i, v in got.items()} == {i: v for i, (_, v) in enumerate(pages)}


def test_templates_as_a_table(spark):
    own = spark.createDataFrame([("x", "one two three four five six"), ("x", "six five four three two one")], "license string, text string")
    docs = spark.createDataFrame([(1, "one two three four five six. Six five four three two one"), (2, "one two")], "doc_id long, text string")
    rows, found = l.scan(docs, own)
    assert [(r.doc_id, r.license, r.shared, r.of, r.first) for r in rows.join(found, "row").collect()] == [(1, "x", 2, 2, 0)]
